"""Expressions that are worth much work a row are evaluated once."""

from pyspark.sql import functions as F

from textveil.functions.columns import fold
from textveil.operators import detect


def test_overlaps_are_resolved_over_spans_found_once(spark):
    rows = spark.createDataFrame([(1, "by EMP-000001"), (2, "Name: Ana Kovac\nby EMP-000002")], "doc_id int, text string")
    out = detect.detect(rows, entities=("EMPLOYEE_ID", "PERSON"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("EMP-\\d") == 2  # one extraction and one split
    got = {r.doc_id: [(s.entity_type, s.value) for s in r.spans] for r in out.collect()}
    assert got[1] == [("EMPLOYEE_ID", "EMP-000001")] and got[2][0][0] == "PERSON"


def test_plain_texts_fold_as_others_do(spark):
    plain = "".join(map(chr, range(1, 128)))
    rows = spark.createDataFrame([(plain,), (plain + "\u00c9\u03c2",), ("",), (None,)], "t string")
    assert [r.f for r in rows.select(fold(F.col("t")).alias("f")).collect()] == [plain.lower(), plain.lower() + "\u00e9\u03c3", "", None]
