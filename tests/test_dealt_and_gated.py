"""Work that is dealt before it is done, done once, or spared."""

from pyspark.sql import functions as F

from textveil.operators import detect, mask
from textveil.plans import queries
from textveil.streaming import live

EVENTS = "conv_id long, turn long, kind string, text string"


def test_events_go_to_their_tasks_before_detection(spark, tmp_path):
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path))
    plan = live.named_events(stream, "normalized", None)._jdf.queryExecution().analyzed().toString()
    above, _, below = plan.partition("RepartitionByExpression")
    assert "EMP-" in above and below and "EMP-" not in below


class Answers:
    """A map state that counts what it is asked."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def containsKey(self, key):
        self.asked += 1
        return key in self.held

    def getValue(self, key):
        self.asked += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def iterator(self):
        return iter(self.held.items())


def test_a_value_is_asked_of_the_state_once_a_batch():
    import pandas as pd

    class Seen:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    naming = live.Naming()
    naming.handle, naming.seen = None, Seen()
    naming.counts, naming.names, naming.forms, naming.values = (Answers() for _ in range(4))

    def batch(turns, *values):
        spans = [{"entity_type": "PERSON", "start": 0, "end": len(v), "score": 1.0, "value": v} for v in values]
        row = lambda t: {"conv_id": 1, "turn": t, "kind": "turn", "text": " ".join(values), "malformed": False, "spans": spans, "keys": list(map(str.lower, values)), "folds": list(map(str.lower, values)), "folded": " ".join(values).lower(), "tokens": [], "place": 2}
        return [list(x) for f in naming.handleInputRows(("1",), iter([pd.DataFrame([row(t) for t in turns])]), None) for x in f["names"]]

    assert batch(range(5), "Ann", "Bo") == [["<PERSON_001>", "<PERSON_002>"]] * 5
    assert naming.names.asked == 2 and naming.counts.asked == 1
    assert batch([5, 6], "Cy", "bo", "Ann") == [["<PERSON_003>", "<PERSON_002>", "<PERSON_001>"]] * 2
    assert naming.counts.held == {("PERSON",): (3,)}


def test_weak_patterns_are_looked_for_near_their_words_alone(spark):
    texts = ["Passport no. A12345678 was shown", "A12345678 was shown", "DRIVER: A1234567", "the A1234567", "a license number AB1234567", "passport lost " + "x" * 60 + " A12345678"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    entries = [e for e in detect.P.PATTERNS if e[3] < detect.THRESHOLD]
    keep = lambda c: F.filter(c, lambda s: s["score"] >= detect.THRESHOLD)
    rows = df.select("k", keep(detect.matched(F.col("text"), entries)).alias("a"), keep(detect.matched(F.col("text"), entries, False, detect.THRESHOLD)).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and {r.k for r in rows if r.b} == {0, 2, 4}
    gates = lambda c: df.select(c)._jdf.queryExecution().analyzed().toString().lower().count("contains(lower(text")
    assert gates(detect.spans_of(F.col("text"))) >= 3 and gates(detect.matched(F.col("text"), entries)) == 0


def test_both_halves_of_the_guard_read_rows_made_once(spark, tmp_path):
    spark.range(20).selectExpr("id as c_custkey", "'Customer#' || lpad(cast(id as string), 9, '0') as c_name", "cast(id % 25 as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    out = queries.guard_split(spark, str(tmp_path))
    assert "Scan parquet" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.released for r in out.collect()} == {i: i % 5 != 0 for i in range(20)}
    assert mask.guard(spark.createDataFrame([("a", [])], "masked_text string, leaks array<string>"))[1].isEmpty()


def test_a_vault_alone_is_minted_without_masking(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Name: Ann Lee\nmail a@x.example.com"), (2, "Name: Bo Ray, ANN LEE"), (None, "Client: Cy Fox"), (3, None)], "doc_id long, text string")
    _, minted, spelled = mask.mask_corpus(docs)
    want = [sorted(map(str, t.collect())) for t in (minted, spelled)]
    monkeypatch.setattr(mask, "corpus_leaks", None)  # no search is made
    got = [sorted(map(str, t.collect())) for t in mask.mint_corpus(docs)]
    assert got == want and len(got[0]) == 4
