import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from textveil.functions import columns as C
from textveil.operators import detect, mask, restore, review, vault
from textveil.sources import masked_name

VAULT = "scope int, seq int, start int, entity_type string, value string"


def masked(spark, rows, **options):
    """rows: (scope, seq, text, [(type, start, end)]) masked with spans given by hand."""
    data = [(a, b, t, [(k, s, e, 0.9, t[s:e]) for k, s, e in spans]) for a, b, t, spans in rows]
    df = spark.createDataFrame(data, f"scope int, seq int, text string, spans {C.SPANS}")
    out, minted, spelled = mask.mask(df, ["scope"], **options)
    return {(r.scope, r.seq): r for r in out.collect()}, minted, spelled


def test_masking_cases(spark):
    rows = [
        (1, 0, "James Bond emailed james@example.com about the audit.", [("PERSON", 0, 10), ("EMAIL_ADDRESS", 19, 36)]),
        (2, 0, "AB", [("PERSON", 0, 1), ("PERSON", 1, 2)]),
        (3, 0, "Nothing here.", []),
        (4, 0, "James Bond filed it. Ask JAMES BOND for the date.", [("PERSON", 0, 10)]),
        (5, 0, "Al signed it. Also, the deadline moved.", [("PERSON", 0, 2)]),
        (6, 0, "James came. Then James Bond left.", [("PERSON", 0, 5)]),
        (7, 0, "Ann is here.", []),
        (7, 1, "Ann again.", [("PERSON", 0, 3)]),
        (7, 2, "Once more Ann.", []),
        (8, 0, "price $5 \\ x", [("PERSON", 6, 8)]),
    ]
    out, _, _ = masked(spark, rows)
    assert out[1, 0].masked_text == "<PERSON_001> emailed <EMAIL_ADDRESS_001> about the audit."
    assert out[1, 0].entity_counts == {"PERSON": 1, "EMAIL_ADDRESS": 1}
    assert out[2, 0].masked_text == "<PERSON_001><PERSON_002>"
    assert out[3, 0].masked_text == "Nothing here." and out[3, 0].sealed == []
    assert out[4, 0].masked_text.count("<PERSON_001>") == 2 and out[4, 0].sealed == ["James Bond"]
    assert out[5, 0].masked_text == "<PERSON_001> signed it. Also, the deadline moved."
    assert out[6, 0].masked_text == "<PERSON_001> came. Then <PERSON_001> Bond left."
    assert out[7, 0].masked_text == "Ann is here." and out[7, 2].masked_text == "Once more <PERSON_001>."
    assert out[8, 0].masked_text == "price <PERSON_001> \\ x"
    full, _, _ = masked(spark, rows, sweep_scope="full")
    assert full[7, 0].masked_text == "<PERSON_001> is here." and not any(r.leaks for r in full.values())


def test_vault_rules(spark):
    rows = [(1, 0, 0, "PERSON", "James Bond"), (1, 1, 3, "PERSON", "james   BOND"), (1, 1, 0, "PERSON", "Maria"), (1, 2, 0, "EMAIL_ADDRESS", "Maria"), (2, 0, 0, "PERSON", "Maria")]
    found = spark.createDataFrame(rows, VAULT)
    v = vault.mint(found, ["scope"], secret="s")
    got = {(r.scope, r.entity_type, r.original): (r.placeholder, r.fingerprint) for r in v.collect()}
    assert {k: p for k, (p, _) in got.items()} == {(1, "PERSON", "James Bond"): "<PERSON_001>", (1, "PERSON", "Maria"): "<PERSON_002>", (1, "EMAIL_ADDRESS", "Maria"): "<EMAIL_ADDRESS_001>", (2, "PERSON", "Maria"): "<PERSON_001>"}
    assert got[1, "PERSON", "James Bond"][1] == hmac.new(b"s", b"PERSON:james bond", hashlib.sha256).hexdigest()[:12]
    assert vault.mint(found, ["scope"], match="exact").where("scope = 1 and entity_type = 'PERSON'").count() == 3
    forms = vault.variants(found, v, ["scope"])
    c = vault.canonicalized(forms, v, ["scope"]).collect()
    assert [(r.placeholder, r.spellings, r.restored_as) for r in c] == [("<PERSON_001>", ["James Bond", "james   BOND"], "James Bond")]
    tokens = spark.createDataFrame([(1, "PERSON_001"), (1, "<PERSON_002>"), (1, "PERSON_009")], "scope int, token string")
    assert sorted((r.token, r.original) for r in vault.lookup(tokens, v, ["scope"]).collect()) == [("<PERSON_002>", "Maria"), ("PERSON_001", "James Bond"), ("PERSON_009", None)]
    whole = vault.mint(found.withColumn("seq", F.col("scope") * 10 + F.col("seq")), [])
    assert sorted((r.entity_type, r.idx, r.original) for r in whole.collect()) == [("EMAIL_ADDRESS", 1, "Maria"), ("PERSON", 1, "James Bond"), ("PERSON", 2, "Maria")]
    again = vault.carried(v, found.where("seq = 1"), ["scope"])
    assert again.where("in_this_input").count() == 2
    with pytest.raises(ValueError):
        vault.mint(found, ["scope"], match="fuzzy")


def test_fingerprint_of_a_long_key(spark):
    got = spark.range(1).select(C.fingerprint(F.lit("T"), F.lit("V"), "k" * 99)).first()[0]
    assert got == hmac.new(b"k" * 99, b"T:v", hashlib.sha256).hexdigest()[:12]


#: Spellings of one placeholder, from a rule: what may stand around it, between type and number, the type's case, the zeros.
AROUND = ("{}", "<{}>", "*<{}>*", "'{}'", "{{{}}}", "«{}»", "{}.", "({}),")
REPLIES = [a.format(f"{k}{j}{'0' * z}1") for a in AROUND for k in ("PERSON", "person", "Person") for j in "_- " for z in (0, 2, 3)]
SAME = ["", "no tokens", "PERSON", "PERSON_", "_001", "PERSON__001", "PERSON_77", "PLACE_1", "ROOM 12", "PERSONS_001", "PERSON_001x"]


def test_restore(spark):
    rows = [(1, 0, 0, "PERSON", "James Bond"), (1, 0, 1, "ORDER", "first"), (1, 0, 2, "ORDER", "PERSON_001")]
    v = vault.mint(spark.createDataFrame(rows, VAULT), ["scope"])
    texts = [*REPLIES, *SAME, "see ORDER_002", "the user PERSON_001's account"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "scope int, i int, text string")
    got = {r.i: r.restored for r in restore.restore(df, v, ["scope"]).collect()}
    for i, t in enumerate(texts):
        if t in REPLIES:
            assert "James Bond" in got[i]
        elif t in SAME:
            assert got[i] == t
    assert got[len(texts) - 2] == "see PERSON_001" and got[len(texts) - 1] == "the user James Bond's account" and got[texts.index("«PERSON_001»")] == "«James Bond»"
    joined = {r.i: r.restored for r in restore.restore_by_join(df, v, "i").collect()}
    assert joined == got
    wide = df.select(F.lit("<A_10000> A_10000").alias("text"))
    assert wide.select(F.size(restore.tokens(F.col("text"), 4))).first()[0] == 0 and wide.select(F.size(restore.tokens(F.col("text")))).first()[0] == 2


def test_document_round_trip(spark):
    text = "Name: Vorin Meklic\n" + "filler words here. " * 30 + "\nmail vorin@example.com or ask Vorin Meklic."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "plain")], "doc_id int, text string")
    out, minted, _ = mask.mask_documents(docs, max_chars=200)
    got = {r.doc_id: r for r in out.collect()}
    assert "Vorin" not in got[1].masked_text and got[1].leaks == [] and got[1].sealed == ["Vorin Meklic"]
    assert all(text[s.start : s.end] == s.value for s in got[1].spans)
    assert got[2].masked_text == "" and got[3].masked_text is None and got[4].masked_text == "plain"
    back = restore.restore(out.select("doc_id", F.col("masked_text").alias("text")), minted, ["doc_id"])
    assert back.where("doc_id = 1").first().restored == text


def test_guard(spark):
    rows = spark.createDataFrame([(1, ["x"]), (2, [])], "i int, leaks array<string>")
    released, held = mask.guard(rows)
    assert [r.i for r in released.collect()] == [2] and [r.i for r in held.collect()] == [1]
    with pytest.raises(ValueError):
        mask.guard(rows, "raise")


def test_review(spark):
    text = "Kevin met Sarah Chen in Vienna. VIENNA!"
    data = [(1, 0, text, [("PERSON", 0, 5, 0.3, "Kevin"), ("PERSON", 10, 20, 0.9, "Sarah Chen"), ("LOCATION", 24, 30, 0.3, "Vienna"), ("LOCATION", 32, 38, 0.4, "VIENNA")])]
    df = spark.createDataFrame(data, f"scope int, seq int, text string, spans {C.SPANS}")
    said = spark.createDataFrame([("PERSON", "kevin", " No "), ("LOCATION", "Vienna", "n"), ("PERSON", "Sarah Chen", "n")], "entity_type string, value_key string, answer string")
    out, minted, _ = mask.mask(df, ["scope"], decisions=said)
    r = out.first()
    assert r.masked_text == "Kevin met <PERSON_001> in Vienna. VIENNA!" and minted.count() == 1 and r.leaks == [] and len(r.declined) == 3
    for answer, declined in (("y", 0), ("", 0), (None, 0), ("no", 1)):
        one = spark.createDataFrame([("PERSON", "Kevin", answer)], "entity_type string, value_key string, answer string")
        assert review.decide(df, one).select(F.size("declined")).first()[0] == declined
    q = review.queue(detect.explode_spans(df, "scope"), said.where("entity_type = 'PERSON'"))
    assert [(x.value_key, x.n, x.max_score) for x in q.collect()] == [("vienna", 2, 0.4)]


def test_corpus_leaks(spark):
    texts = spark.createDataFrame([(1, "james bond was here"), (2, "nothing"), (3, "cost ++ and C++"), (4, "bondage of james")], "k int, text string")
    values = spark.createDataFrame([("James Bond",), ("++",)], "variant string")
    assert sorted(map(tuple, mask.corpus_leaks(texts, values, "k").collect())) == [(1, "James Bond"), (3, "++")]


def test_masked_name(spark):
    names = ["a/b.txt", "b.tar.gz", "a.b/c"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(masked_name(F.col("n"))).collect()]
    assert got == ["a/b.masked.txt", "b.tar.masked.gz", "a.b/c.masked"]
