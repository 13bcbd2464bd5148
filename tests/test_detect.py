import random
import re

import pytest
from pyspark.sql import functions as F

from textveil.functions import columns as C
from textveil.functions import patterns as P
from textveil.operators import detect

CASES = [
    ("Filed by EMP-004217 last night.", {}, [("EMPLOYEE_ID", "EMP-004217")]),
    ("client = OpenAI(api_key='sk-proj-4Xq82LmZpR7vNw1KdTfA9BcE')", {}, [("API_KEY", "sk-proj-4Xq82LmZpR7vNw1KdTfA9BcE")]),
    ("Approve the transfer of 50,000 RSD.", {}, []),
    ("Approve the transfer of 50,000 RSD.", {"detect_money": True}, [("MONEY_AMOUNT", "50,000 RSD")]),
    ("Patient SSN is 432-56-7890.", {}, [("US_SSN", "432-56-7890")]),
    ("Transfer to RS35260005601001611379 today.", {}, [("IBAN_CODE", "RS35260005601001611379")]),
    ("transfer to IBAN DE89370400440532013000", {}, [("IBAN_CODE", "DE89370400440532013000")]),
    ("transfer to IBAN DE99370400440532013000", {}, []),
    ("transfer to IBAN DE99370400440532013000", {"mask_malformed": True}, [("IBAN_CODE", "DE99370400440532013000")]),
    ("The number 0412987654321.", {}, [("NATIONAL_ID", "0412987654321")]),
    ("The number 4428374023740.", {}, []),
    ("The number 4428374023740.", {"mask_malformed": True}, [("NATIONAL_ID", "4428374023740")]),
    ("ID number: 0412987654321", {}, [("NATIONAL_ID", "0412987654321")]),
    ("ID number: 534532532534", {}, [("NATIONAL_ID", "534532532534")]),
    ("Full name: Vorin Meklic\nID number: 4428374023740\nEmail: vorin@example.com\nPhone: +381 60 123 4567", {}, [("PERSON", "Vorin Meklic"), ("NATIONAL_ID", "4428374023740"), ("EMAIL_ADDRESS", "vorin@example.com"), ("PHONE_NUMBER", "+381 60 123 4567")]),
    ("Transaction: wire transfer approved", {}, []),
    ("ID number: 343", {}, []),
    ("Full name: A", {}, []),
    ("Email: not-an-email", {}, []),
    ("Phone: banana", {}, []),
    ("Full  name: Vorin Meklic", {}, []),  # doubled inner blank
    ("see 50$ and 50$x", {"detect_money": True}, [("MONEY_AMOUNT", "50$")]),
    ("commit 9fceb02d0ae598e95dc970b74767f19372d61af8 ISO 27001, Flight LH1234", {"mask_malformed": True}, []),
    ("host 10.0.14.201 and 🙂 x@y.example.com", {}, [("IP_ADDRESS", "10.0.14.201"), ("EMAIL_ADDRESS", "x@y.example.com")]),
    ("   ", {}, []),
    (None, {}, []),
]


def test_detection_cases(spark):
    for options in ({}, {"detect_money": True}, {"mask_malformed": True}):
        own = [c for c in CASES if c[1] == options]
        rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(own)], "i int, text string")
        for r in rows.select("i", "text", detect.spans_of(F.col("text"), **options).alias("s")).collect():
            assert [(s.entity_type, s.value) for s in r.s] == own[r.i][2], r.text
            assert all(r.text[s.start : s.end] == s.value for s in r.s)


def test_places_equal_finditer(spark):
    texts = ["é1 22🙂333", "", "none", "7", "a1b2c3", "١٢ x"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", C.places(F.col("text"), r"(?U)\d+").alias("p")).collect()
    for r in rows:
        assert [(p.s, p.e, p.v) for p in r.p] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", r.text)]


def brute(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        if not any(s[1] < k[2] and k[1] < s[2] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def test_overlaps(spark):
    rng = random.Random(1)
    groups = [[("A" if rng.random() < 0.5 else "B", s := rng.randrange(40), s + rng.randrange(1, 12), rng.choice([0.4, 0.5, 0.9]), "v") for _ in range(rng.randrange(12))] for _ in range(60)]
    groups += [[("PERSON", 0, 5, 0.9, "v"), ("PERSON", 5, 10, 0.9, "v")], []]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], f"i int, s {C.SPANS}").select("i", detect.resolve(F.col("s")).alias("k")).collect()
    for r in rows:
        assert {tuple(x)[1:3] for x in r.k} == {x[1:3] for x in brute(groups[r.i])}
        assert [x.start for x in r.k] == sorted(x.start for x in r.k)


def test_checksums(spark):
    ids = ["0101990500003", "1503857100129", "0412987654321", "4428374023740", "1234567890123", "123", None]
    got = [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").orderBy("i").select(C.jmbg_valid(F.col("x")).alias("v")).collect()]
    assert got == [True, True, True, False, False, False, False]


def test_labels_are_not_values(spark):
    found = detect.fields(F.col("text"))
    inside = detect.drop_labels(F.array(C.span("PERSON", F.lit(0), F.lit(5), 0.9, F.lit("Email"))), found)
    assert spark.createDataFrame([("Email: x@y.com",)], "text string").select(F.size(inside)).first()[0] == 0


def test_value_list_and_own_detector(spark):
    rows = spark.createDataFrame([("Al met Al, not Also.", ["Al", "x.y"])], "text string, v array<string>")
    got = rows.select(detect.value_spans(F.col("text"), F.col("v"), "PERSON", 0.9).alias("s")).first().s
    assert [(x.start, x.end) for x in got] == [(0, 2), (7, 9), (15, 17)]
    plug = lambda t: detect.value_spans(t, F.array(F.lit("met")), "PERSON", 0.9)
    assert [x.value for x in rows.select(detect.spans_of(F.col("text"), extra=[plug]).alias("s")).first().s] == ["met"]


def test_literal_pattern_edges(spark):
    cases = [("Al", "Al signed. Also", 1), ("C++", "C++ and c++x", 2), ("a\\Eb", "x a\\Eb y", 1), ("ÉMILE", "émile émilee", 1)]
    for value, text, n in cases:
        assert spark.createDataFrame([(value, text)], "v string, t string").select(F.regexp_count("t", C.literal_pattern(F.col("v")))).first()[0] == n


def test_unknown_match_mode():
    with pytest.raises(ValueError):
        C.match_key(None, "fuzzy")


def test_pattern_table():
    assert {e[0] for e in P.PATTERNS} <= set(P.DEFAULT_ENTITIES)


def test_own_pattern_table(spark):
    own = [("TICKET", "ticket", r"\bT-\d+\b", 0.9, "T-", None), ("EMAIL_ADDRESS", "mail", r"\S+@\S+", 0.5, "@", None), ("OTHER", "other", "x", 0.9, "x", None)]
    rows = spark.createDataFrame([("T-12 x@y z",)], "text string")
    got = rows.select(detect.spans_of(F.col("text"), patterns=own, entities=("TICKET", "EMAIL_ADDRESS")).alias("s")).first().s
    assert [(x.entity_type, x.value) for x in got] == [("TICKET", "T-12"), ("EMAIL_ADDRESS", "x@y")]


def test_further_patterns(spark):
    """Kinds that the cases above leave out: written, near their context words or not, and with wrong checksums."""
    card = lambda body: next(body + str(d) for d in range(10) if sum(int(c) if i % 2 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(body + str(d))) % 10 == 0)
    good = card("400000123456789")
    bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    cases = [
        (f"paid with {good}", [("CREDIT_CARD", good)]),
        (f"paid with {bad}", []),
        ("token ghp_" + "a1" * 20, [("API_KEY", "ghp_" + "a1" * 20)]),
        ("passport A12345678 shown", [("US_PASSPORT", "A12345678")]),
        ("item A12345678 shown", []),
        ("driver license B7654321", [("US_DRIVER_LICENSE", "B7654321")]),
        ("her medical license AB1234567", [("MEDICAL_LICENSE", "AB1234567")]),
        ("SSN 000-12-3456 and 123-00-4567", []),
        ("at 300.1.1.1 or 1.2.3", []),
        ("Card number: 4000 0012 3456 7899", [("CREDIT_CARD", "4000 0012 3456 7899")]),
        ("Address: 12 Long Lane", [("LOCATION", "12 Long Lane")]),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string").select("i", "text", detect.spans_of(F.col("text")).alias("s")).collect()
    for r in rows:
        assert [(s.entity_type, s.value) for s in r.s] == cases[r.i][1], r.text
