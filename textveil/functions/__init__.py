"""Column functions: span finding, checksums, keys, literal patterns."""
