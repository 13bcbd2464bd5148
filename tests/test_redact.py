"""Redaction by words against trying every spelling in turn."""

from pyspark.sql import functions as F
from test_near import ODD, entries_of

from textveil.operators import mask


def test_redact_is_the_sweep_with_all_spellings(spark):
    plain = [f"Anna{i} Lee" for i in range(20)] + ["bar-baz", "James Bond", "Bond"]
    texts = ["anna3 LEE and james bond", "bond, bar-baz", "x_anna4 lee", "foo_x _x ++ credit", "person_002 éé", None, "", "nobody"]
    for values in (plain, plain + ODD):
        known = entries_of(spark, values, lambda i: ("PERSON", "credit card")[i % 2])
        rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)] + [(None, 9, "bond")], "k long, i int, t string")
        want = rows.join(known, "k", "left").select("i", mask.sweep(F.col("t"), mask.forms_of(F.col("entries"), None))["text"].alias("t"))
        got = mask.redact(rows, known, ["k"], "t")
        assert got.columns == rows.columns
        assert sorted(map(str, got.select("i", "t").collect())) == sorted(map(str, want.collect()))


def test_no_row_carries_the_whole_vault(spark):
    known = entries_of(spark, [f"Name{i}" for i in range(300)], lambda i: "PERSON")
    rows = spark.range(300).selectExpr("0L as k", "id as i", "'to Name' || id as t")
    out = mask.redact(rows, known, ["k"], "t")
    assert "_entries" not in out._jdf.queryExecution().analyzed().toString()
    assert out.where("t rlike '^to <PERSON_[0-9]{3}>$'").count() == 300
