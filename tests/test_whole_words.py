"""Chunks that a long sentence is cut into leave its words whole, so no address is masked by halves."""

import re

import pandas as pd
from pyspark.sql import functions as F
from test_chunk import TEXTS
from test_chunk_marks import MARKED

from textveil.operators import chunk
from textveil.plans import queries


def words(text, size):
    """The chunks: atoms are paragraphs, sentences of long paragraphs, words of long sentences."""
    out = []
    parts = lambda pattern, x: [p for p in re.sub(pattern, "\\1\x00", x).split("\x00") if p]
    atoms = [a for p in parts(r"(\n[ \t]*\n)", text) for s in ([p] if len(p) <= size else parts(r"([.!?]\s+)", p)) for a in ([s] if len(s) <= size else parts(r"(\s)", s))]
    for a in [text] if 0 < len(text) <= size else atoms:
        if out and len(out[-1]) + len(a) <= size:
            out[-1] += a
        else:
            out.append(a)
    return out


def test_words_stay_whole(spark):
    texts = [*TEXTS, *MARKED, "ab " * 50 + "x" * 40 + " \t\n" * 30 + "y@z.org " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for size in (1, 10, 120):
        for r in df.select("i", chunk.split(F.col("text"), size, whole_words=True).alias("c")).collect():
            assert r.c == words(texts[r.i], size) and "".join(r.c) == texts[r.i]
            assert all(len(c) <= size or not re.search(r"\s(?!$)", c) for c in r.c)


#: Sentences of more than 8,000 characters, in which every place of an address falls on a cut.
LONG = [f"{'x' * k} " + "hsr.29@mail5.example.com und " * 700 for k in range(1, 26)] + ["q" * 8100 + "@mail5.example.com ende"]


#: Addresses next to letters, digits and marks of all kinds, touching ones, and the letters that the SQL uses for its own ends.
ADDRESS = "Zoe_Y.x%1@Mail5.example.COM"
EDGES = ["é", "e\u0301", "\u0416", "\u4e2d", "\u0663", "\u203f", "\u200d", "\u24b6", "\U0001d400", "\U0001f130", "\U0001f600", "\u2167", "\u00b2", "\u20ac", "_", ".", "-", "%", "+", "/", "1", "Z", "Y", "\u00a0"]
NEXT_TO = [f"{b}{ADDRESS}{c}" for b in ["", *EDGES] for c in ["", *EDGES]] + [f"{e}.{ADDRESS}" for e in EDGES]
NEXT_TO += [None, "", "plain ÄÖ ZY", "@", "a@b.com.c@d.com", "a@b.com-c@d.com%e@f.com+", "ab@c.comab@c.comÄab@c.com ab@c.comé.ab@c.com", " ".join(f"n{i}@b.org" for i in range(1100))]


def differing(spark, folder, texts):
    """Rows that the query and its SQL don't share, and those they do."""
    import duckdb

    at = f"{folder}/documents.parquet"
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(at)
    got = {tuple(r) for r in queries.mask_document_emails(spark, str(folder)).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{at}')")
    want = set(con.sql(f"SELECT doc_id, masked_sha256, n_spans, released FROM ({queries.ORACLES['mask_document_emails']})").fetchall())
    return got ^ want, {r[0]: r[2:] for r in got & want}


def test_addresses_in_long_sentences(spark, tmp_path):
    apart, shared = differing(spark, tmp_path, LONG)
    assert not apart and [shared[i] for i in range(len(LONG))] == [(700, True)] * 25 + [(1, True)]
    counts = {r.entity_type: r.n for r in queries.entity_counts_by_type(spark, str(tmp_path)).collect()}
    assert counts == {"EMAIL_ADDRESS": 25 * 700 + 1}


def test_addresses_next_to_words_of_all_scripts(spark, tmp_path):
    apart, shared = differing(spark, tmp_path, NEXT_TO)
    assert not apart and len(shared) == len(NEXT_TO)
    assert {shared[i] for i, t in enumerate(NEXT_TO) if t in (f"é{ADDRESS}", f"{ADDRESS}\u4e2d")} == {(1, True)}
