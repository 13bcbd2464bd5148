"""Known values in other cases, and one vault for a whole corpus."""

import sys
import unicodedata

from pyspark.sql import functions as F

from textveil.functions import columns as C
from textveil.operators import mask, restore


def test_folds_are_as_wide_as_patterns(spark):
    """Every two letters that the pattern takes for one have one fold, alone and inside a word."""
    alike: dict[str, set] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.category(c)[0] in "LNSM" and (forms := {x for f in (c.upper(), c.lower(), c.title(), c.casefold()) for x in (f, f.lower(), f.upper()) if len(x) == 1} | {c}) - {c}:
            for x in forms:
                alike.setdefault(x, set()).update(forms)
    pairs = sorted({(a, b) for c, forms in alike.items() for a in forms | {c} for b in forms | {c} if a != b} | {("i", "\u0130"), ("\u0130", "i"), ("s", "\u017f"), ("\u03c3", "\u03c2"), ("\u03a3", "\u03c2"), ("k", "\u212a")})
    assert len(pairs) > 2500
    rows = spark.createDataFrame(pairs, "a string, b string")
    forms = [(F.col("a"), F.col("b"))] + [(F.concat(F.lit(p), "a", F.lit(q)), F.concat(F.lit(p), "b", F.lit(q))) for p, q in (("x", ""), ("", "x"), ("Ax", "."))]
    for a, b in forms:
        met = rows.where(F.regexp_like(b, C.literal_pattern(a)))
        assert met.count() > 2000 and met.where(~F.contains(C.fold(b), C.fold(a))).isEmpty()


def test_other_cases_are_swept_and_reported(spark):
    forms = F.array(F.struct(F.lit("<P_1>").alias("placeholder"), F.lit("Jess Ross").alias("variant")), F.struct(F.lit("<P_$2\\>").alias("placeholder"), F.lit("ΟΔΟΣ").alias("variant")))
    text = "JE\u017fS ROSS, je\u017f\u017f ro\u017f\u017f and οδος, οδοσ; ΟΔΟΣ.Α"
    row = spark.createDataFrame([(text,)], "t string").select(mask.leaks(F.col("t"), forms).alias("l"), mask.sweep(F.col("t"), forms).alias("s")).first()
    assert row.l == ["Jess Ross", "ΟΔΟΣ"] and row.s.sealed == row.l
    assert row.s.text == "<P_1>, <P_1> and <P_$2\\>, <P_$2\\>; <P_$2\\>.Α"


def test_corpus_leaks_equal_all_pairs(spark):
    values = ["James Bond", "++", " ++", "C++", "_x", "x_", "a\u00b2", "\u00b2", "\u2167", "jess", "e\u0301", "-", "Al", " ", "", None, "x-y", "(a) b", "\u0130s", "#1"]
    texts = ["james  bond", "JAMES BOND!", "a ++ b", "c++", "_X_", "ax_ x_1", "foo a\u00b2", "foo\u00b2 b", "\u2167 vi", "JE\u017fS", "e\u0301 x", "al-Al", "x-yz x-y", "see (A) B", "is \u0130S", "no #1 #12", "", None, "- -"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    v = spark.createDataFrame([(x,) for x in values], "variant string")
    want = t.join(v.where("trim(variant) <> ''"), F.regexp_like("text", C.literal_pattern(F.col("variant")))).select("k", "variant")
    got = mask.corpus_leaks(t, v, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 15


DOCS = [(3, "Name: Ann Lee\nmail a@x.example.com"), (1, "Name: Bo Ray\n" + "filler words. " * 30 + "Bo Ray and ann lee met."), (7, "ANN LEE wrote to A@X.EXAMPLE.COM."), (None, "Client: Cy Fox\nBO RAY"), (3, None), (9, ""), (9, "plain")]


def test_one_vault_for_all(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    out, minted, spelled = mask.mask_corpus(docs, max_chars=120)
    got = out.collect()
    by_id = {(r.doc_id, (r.text or "")[:3]): r for r in got}
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, DOCS)) and all(r.leaks == [] for r in got)
    names = {r.original: r.placeholder for r in minted.collect()}
    assert names == {"Cy Fox": "<PERSON_001>", "Bo Ray": "<PERSON_002>", "Ann Lee": "<PERSON_003>", "a@x.example.com": "<EMAIL_ADDRESS_001>"}
    assert by_id[7, "ANN"].masked_text == "<PERSON_003> wrote to <EMAIL_ADDRESS_001>." and by_id[None, "Cli"].masked_text == "Client: <PERSON_001>\n<PERSON_002>"
    assert by_id[1, "Nam"].masked_text.endswith("<PERSON_002> and <PERSON_003> met.") and by_id[1, "Nam"].sealed == ["Bo Ray", "Ann Lee"]
    assert by_id[9, ""].masked_text == "" and by_id[3, ""].masked_text is None and mask.guard(out)[1].isEmpty()
    more = spark.createDataFrame([(1, "Name: Dee Poe\nCY FOX and Client: x\nName: ann  lee")], "doc_id long, text string")
    again, minted2, spelled2 = mask.mask_corpus(more, known=(minted, spelled))
    assert again.first().masked_text == "Name: <PERSON_004>\n<PERSON_001> and Client: x\nName: <PERSON_003>"
    assert minted2.count() == 5 and sorted(r.variant for r in spelled2.where("idx = 3 and entity_type = 'PERSON'").collect()) == ["Ann Lee", "ann  lee"]
    back = restore.restore_by_join(again.select("doc_id", "masked_text"), minted2, "doc_id", text="masked_text").first().restored
    assert back == "Name: Dee Poe\nCy Fox and Client: x\nName: Ann Lee"
    assert mask.mask_corpus(docs.where("false"))[0].count() == 0
    clash = docs.withColumn("seq", F.lit(1)).withColumn("approved", F.lit(2)).withColumn("entries", F.lit(3))
    assert mask.mask_corpus(clash, max_chars=120)[0].count() == len(DOCS) == mask.mask_documents(clash)[0].count()
