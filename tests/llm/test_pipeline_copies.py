"""The pipeline's near-duplicate stage where ids repeat or are missing."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def words(seed, n=60):
    return " ".join(f"w{seed * 1000 + i}" for i in range(n))


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.drop_copies(spark, docs, "")
    assert out.columns == docs.columns
    return sorted((str(r.doc_id), r.text or "", r.lang) for r in out.collect())


def row(i, text, lang="en"):
    return (i, text, lang, "web", len(text or ""))


def test_repeated_and_null_ids(spark):
    near = words(1) + " tail"
    rows = [row(7, words(1)), row(3, words(2)), row(3, words(2)), row(5, words(3)), row(5, words(4)), row(9, near), row(9, words(5)), row(9, None), row(9, ""), row(9, None)]
    rows += [row(None, words(6)), row(None, words(6)), row(None, words(7)), row(None, None)]
    want = [row(7, words(1)), row(3, words(2)), row(5, words(3)), row(5, words(4)), row(9, words(5)), row(9, None), row(9, ""), *rows[10:]]
    assert kept(spark, rows) == sorted((str(r[0]), r[1] or "", r[2]) for r in want)


def test_nulls_stay_without_repeats(spark):
    rows = [row(1, words(1)), row(2, words(1)), row(None, words(1)), row(None, words(1)), row(None, None)]
    assert kept(spark, rows) == sorted((str(r[0]), r[1] or "", r[2]) for r in [rows[0], *rows[2:]])


def test_all_rows_repeat(spark):
    rows = [row(4, words(1)), row(4, words(1)), row(2, words(1))]
    assert kept(spark, rows) == [("2", words(1), "en")]
