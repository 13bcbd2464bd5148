"""Texts that hold the character that marks cuts are cut like any other."""

from pyspark.sql import functions as F
from test_chunk import TEXTS, brute

from textveil.operators import chunk

M = ""
MARKED = [f"has {M} mark. " * 40, f"{M}\n\n{M}a. {M}b " * 30, M * 300, f"Name: Vorin {M}. " * 20 + f"\n\n{M}b{M}b", f"{M}a{M}b. " * 40]


def test_marks_are_ordinary_text(spark):
    assert chunk.CUT == M
    texts = [*TEXTS, *MARKED]
    for size in (10, 120, 150):
        for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", chunk.split(F.col("text"), size).alias("c")).collect():
            assert r.c == brute(texts[r.i], size)


def test_atoms_of_marked_texts(spark):
    row = spark.createDataFrame([(f"One{M}. Two{M}b. Three{M}",)], "text string").select(chunk.pieces(F.col("text"), chunk.SENTENCE).alias("p")).first()
    assert row.p == [f"One{M}. ", f"Two{M}b. ", f"Three{M}"]
