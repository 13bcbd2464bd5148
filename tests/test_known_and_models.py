"""Values from a table, models of the caller's own, words that are common, texts that are long."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textveil.functions.columns import literal_pattern
from textveil.operators import chunk, detect, known, mask, search

TEXTS = [(1, "Zork wrote to a@b.example.com 😀Zork"), (2, None), (3, " "), (4, "Annual: Ann, Ann Lee and ANN; C++ and C, ann"), (4, "Ann"), (None, "Zork Zork")]
VALUES = [("PERSON", "Ann"), ("PERSON", "Ann Lee"), ("PERSON", "Ann"), ("TOOL", "C++"), ("TOOL", "Zork"), ("PERSON", "Zork"), ("X", None), ("X", " "), (None, "Ann"), ("X", "absent word")]


def spans(rows):
    return sorted(str((r.doc_id, r.text, sorted((s.entity_type, s.start, s.end, s.value) for s in r.known))) for r in rows)


def found_plainly(ignore_case):
    import re

    out = []
    for doc, text in TEXTS:
        own = set()
        for kind, value in VALUES:
            if kind and value and value.strip() and text:
                edge = lambda c: r"\b" if c.isalnum() else ""
                p = re.compile(edge(value[0]) + re.escape(value) + edge(value[-1]), re.I if ignore_case else 0)
                own |= {(kind, m.start(), m.end(), m[0]) for m in p.finditer(text)}
        out.append(str((doc, text, sorted(own))))
    return sorted(out)


@pytest.mark.parametrize("ignore_case", [False, True])
def test_known_values(spark, ignore_case):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("variant", F.lit("clash"))
    values = spark.createDataFrame(VALUES, "entity_type string, value string")
    assert spans(known.find(docs, values, ignore_case=ignore_case).collect()) == found_plainly(ignore_case)


def test_known_values_next_to_patterns(spark):
    docs, values = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame([("PERSON", "Ann"), ("PERSON", "Ann Lee"), ("PERSON", "example")], "entity_type string, value string")
    got = {(r.doc_id, r.text): [(s.entity_type, s.value) for s in r.spans] for r in detect.detect(docs, known=values).collect()}
    assert got[4, TEXTS[3][1]] == [("PERSON", "Ann"), ("PERSON", "Ann Lee")] and got[1, TEXTS[0][1]] == [("EMAIL_ADDRESS", "a@b.example.com")] and got[2, None] == []
    assert known.find(docs, values.limit(0)).select(F.max(F.size("known"))).first()[0] == 0 and known.find(docs.limit(0), values).count() == 0
    plan = detect.detect(docs, known=values)._jdf.queryExecution().toString()
    assert "Ann Lee" not in plan


def zork_model():
    """Made here, as workers can't import a test."""

    def model(texts: pd.Series) -> pd.Series:
        places = lambda t: [("PERSON", i, i + 4, 0.99) for i in range(len(t)) if t.startswith("Zork", i)]
        return texts.map(lambda t: None if t is None else [*places(t), ("PERSON", -3, 99, 1.0), ("PERSON", 5, 5, 1.0), ("PERSON", 0, 1, float("nan")), (None, 0, 1, 1.0), ("OTHER", 0, 3, 1.0)])

    return model


def test_model_detectors(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    found = detect.detect(docs, extra=[detect.model_detector(zork_model(), "pandas"), lambda t: F.array(F.struct(F.lit("LOCATION").alias("entity_type"), F.lit(5).alias("start"), F.lit(10).alias("end"), F.lit(0.5).alias("score"), F.lit("ignored").alias("value")))])
    got = {(r.doc_id, r.text): [(s.entity_type, s.start, s.value) for s in r.spans] for r in found.collect()}
    assert got[1, TEXTS[0][1]] == [("PERSON", 0, "Zork"), ("LOCATION", 5, "wrote"), ("EMAIL_ADDRESS", 14, "a@b.example.com"), ("PERSON", 31, "Zork")]
    assert got[2, None] == got[3, " "] == got[4, "Ann"] == [] and found.columns == ["doc_id", "text", "spans"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan
    with pytest.raises(ValueError):
        detect.model_detector(zork_model(), "rows")


def test_model_detectors_in_a_masking_job(spark):
    docs = spark.createDataFrame([(1, "Zork met zork"), (2, "nobody")], "doc_id long, text string")
    out, _, _ = mask.mask_documents(docs, options={"extra": [detect.model_detector(zork_model(), "pandas")]})
    assert sorted(r.masked_text for r in out.collect()) == ["<PERSON_001> met <PERSON_001>", "nobody"]


def test_common_words_are_met_by_pairs(spark):
    """All words are common: values of two words meet few texts more than those that hold them, whatever path the words take."""
    rng = random.Random(1)
    words = [f"w{i:02d}" for i in range(30)]
    texts = spark.createDataFrame([(i, " ".join(rng.choices(words, k=60))) for i in range(400)] + [(None, "w01 w02"), (7, "w03 -- w04 _w05")], "k int, text string")
    values = spark.createDataFrame([(f"{a} {b}",) for a in words for b in words if rng.random() < 0.5] + [("w01",), ("W02",), ("w03 -- w04",), ("--",), ("_w05",), ("",), (None,)], "variant string")
    want = sorted(map(str, map(tuple, texts.crossJoin(values.where("trim(variant) <> ''")).where(F.regexp_like("text", literal_pattern(F.col("variant")))).select("k", "variant").distinct().collect())))
    assert sorted(map(str, map(tuple, search.corpus_leaks(texts, values, "k", common=50).collect()))) == want == sorted(map(str, map(tuple, search.corpus_leaks(texts, values, "k").collect())))
    keyed = texts.withColumn("at", F.monotonically_increasing_id())
    met = search.candidates(keyed, values, "at", common=50).select(F.sum(F.size("variants"))).first()[0]
    assert met < len(want) * 1.1


def test_shares_of_a_common_word(spark, monkeypatch):
    """Ten thousand values around one word that stands in every text: its texts and values are dealt to many tasks."""
    monkeypatch.setattr(search, "SHARE", 5_000)
    monkeypatch.setattr(search, "BROADCAST_CHARS", 0)
    texts = spark.createDataFrame([(i, f"the word ##{i % 700}# here") for i in range(600)], "k int, text string")
    values = spark.createDataFrame([(f"word ##{i}#",) for i in range(10_000)], "variant string")
    said = texts.select("k", F.explode(search.text_keys(F.col("text"))).alias("_w"))
    keyed = values.select("variant", F.lit("word").alias("_w"))
    counts = said.groupBy("_w").agg(F.count(F.lit(1)).alias("n"))
    met = search._met(said.where("_w = 'word'"), keyed, counts, "k")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in met.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 6_000_000 and max(sizes) <= 4 * sorted(sizes)[len(sizes) // 2]
    few = texts.limit(60)
    assert search.corpus_leaks(few, values, "k").count() == 60


@pytest.mark.parametrize("unit", ["Some words stand in here, and more. ", "abcdefghij", "A line.\n\nAnother one with words\n \n", "x😀"])
def test_long_texts_are_cut_in_linear_time(spark, unit):
    took = []
    for n in (200_000, 1_000_000, 4_000_000):
        text = (unit * (n // len(unit) + 1))[:n]
        began = time.perf_counter()
        got = sorted(map(tuple, chunk.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", max_chars=800).select("chunk_no", "chunk_start", "text").collect()))
        took.append(time.perf_counter() - began)
        assert "".join(t for *_, t in got) == text and max(len(t) for *_, t in got) <= 800
        assert [(k, s) for k, s, _ in got] == [(k, sum(len(t) for *_, t in got[:k]) if k < 50 else got[k - 1][1] + len(got[k - 1][2])) for k in range(len(got))]
    assert took[2] < 8 * took[1] + 2
