"""Reversible text privacy on Spark: find private values, swap them for stable placeholders, put them back."""
