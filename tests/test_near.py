"""Spellings that a text's words tell of, against trying every spelling in turn."""

import random
import time

from pyspark.sql import functions as F

from textveil.operators import mask, vault

ODD = ["Credit", "x <PERSON_001>", "_001>", "person_002", "_x", "foo", "x_", "²b", "a²", "++", "#", "é", "İstanbul", "οδος", "straße", "card_001", "-5 km", "km", "O'Neil", "(a) b", " "]


def entries_of(spark, values, kind):
    mentions = spark.createDataFrame([(0, 0, i, kind(i), v) for i, v in enumerate(values)], "k long, seq int, start int, entity_type string, value string")
    minted = vault.mint(mentions, ["k"])
    return vault.entries(minted, ["k"], vault.variants(mentions, minted, ["k"]))


def test_near_changes_nothing(spark):
    rng = random.Random(5)
    words = ["foo", "foo_x", "bar", "baz", "James", "Bond", "km", "abc-5", "a²b", "x", "o'neil", "ISTANBUL", "ΟΔΟΣ", "STRASSE", "straße", "person", "credit", "card_001", "++", "(A)", "B", "foo_xfoo", "ée", "_001"]
    joiners = [" ", " ", " ", "-", "_", ".", "\n", "", "<", ">"]
    plain = [" ".join(rng.choices(words, k=rng.randint(1, 2))) for _ in range(30)]
    texts = ["".join(rng.choice(words) + rng.choice(joiners) for _ in range(rng.randint(0, 25))) for _ in range(150)] + [None, ""]
    parting = lambda v: v.startswith("_") or v.endswith(("_", "\u0301"))  # while one of these is likely, all spellings stay
    for values in (plain, plain + ODD, [v for v in plain + ODD if not parting(v)]):
        known = entries_of(spark, values, lambda i: ("PERSON", "credit card")[i % 2])
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("k", F.lit(0).cast("long")).join(known, "k").withColumn("forms", mask.forms_of(F.col("entries"), None))
        near = rows.select("i", "text", "forms", mask.near(F.col("text"), F.col("forms")).alias("near"), mask.near(F.col("text"), F.col("forms"), sweeping=False).alias("seen"))
        got = near.select("i", mask.sweep(F.col("text"), F.col("forms")).alias("a"), mask.sweep(F.col("text"), F.col("near")).alias("b"), mask.leaks(F.col("text"), F.col("forms")).alias("c"), mask.leaks(F.col("text"), F.col("seen")).alias("d"), F.size("near").alias("n"), F.size("forms").alias("m")).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r.a == r.b and (r.c or []) == (r.d or []), (texts[r.i], r)
        assert sum(len(r.a.sealed) for r in got) > 300 and any(r.n < r.m for r in got) == (not any(map(parting, values)))


def test_cost_of_a_scope_with_many_spellings(spark):
    """800 texts of 8,000 characters, swept with 10 and with 1,000 spellings, of which each text holds one."""
    filler = " ".join(f"word{i % 700} and" for i in range(900))[:7900]
    spent = {}
    for n in (10, 10, 1000):
        number = (F.col("id") % n).cast("string")
        texts = spark.range(800).select(F.lit(0).cast("long").alias("k"), F.concat(F.lit(filler + " anna"), number, F.lit(" lee"), number).alias("text")).repartition(4).cache()
        known = entries_of(spark, [f"Anna{i} Lee{i}" for i in range(n)], lambda i: "PERSON").cache()
        assert texts.count() == 800 and known.count() == 1
        start = time.monotonic()
        out = mask.redact(texts, known, ["k"], "text").agg(F.sum(F.regexp_like("text", F.lit(r" <PERSON_\d{3,}>$")).cast("int")).alias("n")).first()
        spent[n] = time.monotonic() - start
        assert out.n == 800
        texts.unpersist(), known.unpersist()
    assert spent[1000] < 3 * spent[10] + 1  # 7 to 8 times when every spelling was looked for in every text
