"""Scopes with many spellings, whose vault meets their rows by word, against rows that carry the vault."""

from pyspark.sql import functions as F

from textveil.functions import columns as C
from textveil.operators import mask, vault


def rows_of(spark, values):
    """Of each value a row that introduces it, later rows that mention it and a neighbour in other spellings, and a null scope."""
    data = []
    for scope in (None, 1):
        for i, v in enumerate(values):
            data.append((scope, i, f"say {v} now", [("PERSON", 4, 4 + len(v), 0.9, v)]))
            data.append((scope, i + 1, f"again {v.upper()} and {values[i - 1].lower()}, later {values[(i + 3) % len(values)]}. person_002", []))
    data += [(None, None, f"all of {values[-1]}", []), (2, 0, "nothing", []), (None, 3, None, []), (None, 4, "", [])]
    return spark.createDataFrame(data, f"conv long, seq int, text string, spans {C.SPANS}")


def test_by_word_is_by_row(spark, monkeypatch):
    plain = [f"Quill{i}" for i in range(12)] + ["James Bond", "Bond", "O'Neil", "++", "person_002"]
    for values, how in ((plain, "causal"), (plain + ["_x", "foo_x"], "full")):
        df = rows_of(spark, values)
        got = {}
        for rich in (10_000, 5):
            monkeypatch.setattr(mask, "RICH", rich)
            out, _, _ = mask.mask(df, ["conv"], sweep_scope=how)
            got[rich] = sorted(map(str, out.collect()))
        assert got[5] == got[10_000] and len(got[5]) == df.count()


def test_no_row_carries_a_rich_scope(spark, monkeypatch):
    monkeypatch.setattr(mask, "RICH", 50)
    gathered, entries = [], vault.entries
    monkeypatch.setattr(vault, "entries", lambda minted, *more: (gathered.append(minted.count()), entries(minted, *more))[1])
    df = spark.range(200).select(F.lit(None).cast("long").alias("conv"), F.col("id").cast("int").alias("seq"), F.concat(F.lit("to Name"), "id").alias("text"))
    df = df.withColumn("spans", F.array(C.span("PERSON", F.lit(3), F.length("text"), 0.9, F.substr("text", F.lit(4)))))
    out, _, _ = mask.mask(df, ["conv"])
    assert out.count() == 200 and out.where("masked_text rlike '^to <PERSON_[0-9]{3}>$' and size(leaks) = 0").count() == 200
    assert gathered == [0]  # no entry of the scope is gathered into an array
