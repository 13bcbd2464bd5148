"""Live conversations: several batches against the batch jobs, batches done again, malformed events, replies in a stream of their own."""

import os
import random

import pytest
from pyspark.sql import functions as F

from textveil.operators import mask
from textveil.plans import jobs
from textveil.streaming import live, mask_turns, sinks

EVENTS = "conv_id long, turn long, kind string, text string"


def turn_text(rng, turn):
    who, mail = rng.choice(["Ann Lee", "Bo Ray", "Cy Fox", "ANN LEE"]), f"m{rng.randint(1, 4)}@x.example.com"
    return rng.choice([f"Name: {who}\nhello", f"mail {mail} and {who.lower()}", f"{who} met cy fox", f"Client: {who}\nEmail: {mail}", "plain"])


def events_of(seed=4, n_conv=12, n_turns=6):
    rng = random.Random(seed)
    out = []
    for c in range(n_conv):
        for t in range(n_turns):
            out.append((c, t, "turn", turn_text(rng, t)))
            if rng.random() < 0.8:
                out.append((c, t, "reply", f"Dear <PERSON_001>, person {rng.randint(1, 4)}, email-address 1"))
            if rng.random() < 0.2:
                out.append((c, t, "reset", None))
    return out


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, max_turns=2, **options):
    live.use_rocksdb(spark)
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    sinks.deliver(live.live(stream, max_turns=max_turns, **options), f"{tmp_path}/out", f"{tmp_path}/state", trigger={"availableNow": True}).awaitTermination()


def test_batches_give_what_the_batch_jobs_give(spark, tmp_path):
    rows = events_of()
    for k in range(3):  # two turns of each conversation a batch
        put(spark, f"{tmp_path}/in", [r for r in rows if r[1] // 2 == k])
        run(spark, tmp_path)
    turns = spark.createDataFrame([(c, t, "user", x) for c, t, k, x in rows if k == "turn"], "conv_id long, turn long, role string, text string")
    replies = spark.createDataFrame([(c, t, x) for c, t, k, x in rows if k == "reply"], "conv_id long, turn long, answer string")
    resets = spark.createDataFrame([(c, t) for c, t, k, _ in rows if k == "reset"], "conv_id long, turn long")
    out, minted, _ = jobs.mask_conversations(turns)
    want = jobs.requests_of(out, replies, "Keep placeholders as they are.", 2, resets)
    told = lambda df, text: sorted(str((r.conv_id, r.turn, r[text], [(m.role, m.content) for m in r.messages])) for r in df.collect())
    assert told(sinks.delivered(spark, f"{tmp_path}/out", "released"), "masked_text") == told(want, "question")
    back = lambda df: sorted(map(str, map(tuple, df.select("conv_id", "turn", "restored").collect())))
    assert back(sinks.delivered(spark, f"{tmp_path}/out", "answers")) == back(jobs.restore_replies(replies, minted))
    for name in ("quarantine", "malformed"):
        assert sinks.delivered(spark, f"{tmp_path}/out", name).isEmpty()
    public = sinks.delivered(spark, f"{tmp_path}/out", "audit_public")
    texts = public.select(F.to_json("payload").alias("p"), "message").collect()
    assert texts and not any(v in (r.p + r.message).lower() for r in texts for v in ("name: ann lee", "name: bo ray", "x.example.com"))
    steps = [r.step for r in public.where("conv_id = 0 and turn = 0").sort("seq").collect()]
    assert steps[:1] == ["pii_detected"] and "llm_request" in steps


def test_a_batch_done_again_gives_no_second_row(spark, tmp_path):
    put(spark, f"{tmp_path}/in", events_of(n_conv=3, n_turns=2))
    run(spark, tmp_path)
    first = {t: sinks.delivered(spark, f"{tmp_path}/out", t).count() for t in sinks.TABLES}
    for kind in ("commits",):  # as if the job had died before it noted the batch
        folder = tmp_path / "state" / kind
        for f in os.listdir(folder):
            os.remove(folder / f)
    run(spark, tmp_path)
    assert {t: sinks.delivered(spark, f"{tmp_path}/out", t).count() for t in sinks.TABLES} == first
    mark = tmp_path / "out" / "_committed"
    for f in os.listdir(mark):  # as if it had died before the last table
        os.remove(mark / f)
    with pytest.raises(FileNotFoundError):
        sinks.delivered(spark, f"{tmp_path}/out", "released")
    with pytest.raises(ValueError):
        sinks.delivered(spark, f"{tmp_path}/out", "vault")


def test_malformed_events_go_aside(spark, tmp_path):
    bad = [(None, 1, "turn", "Name: Zed Zork"), (2, None, "turn", "x"), (2, 0, "turn", None), (2, 1, "odd", "x"), (2, 1, None, "x"), (None, None, None, None)]
    put(spark, f"{tmp_path}/in", [*bad, (2, 1, "turn", "Name: Ann Lee"), (2, 1, "reset", None), (2, 5, "reply", "person 1 and person 9")])
    run(spark, tmp_path)
    rows = lambda t, *c: sorted(map(str, map(tuple, sinks.delivered(spark, f"{tmp_path}/out", t).select(*c).collect())))
    assert rows("malformed", "conv_id", "turn", "kind", "text") == sorted(map(str, bad))
    assert rows("released", "turn", "masked_text") == ["(1, 'Name: <PERSON_001>')"] and rows("answers", "restored") == ["('Ann Lee and person 9',)"]
    put(spark, f"{tmp_path}/in", [(2, 2, "turn", "ann lee again"), (2, 1, "turn", "Name: Bo Ray")])
    run(spark, tmp_path)
    assert rows("released", "turn", "masked_text", "late") == sorted(map(str, [(1, "Name: <PERSON_001>", False), (2, "<PERSON_001> again", False), (1, "Name: <PERSON_002>", True)]))


def test_what_leaks_is_held(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0, "turn", "released", "t", "Ann Lee", None, None, [], ["Ann Lee"], [], False), (1, 1, "turn", "blocked", "Ann Lee", "Ann Lee", None, {"PERSON": 1}, [], ["Ann Lee"], [], False)], live.DONE)
    sinks.write_batch(frame, 0, f"{tmp_path}/out")
    held = sinks.delivered(spark, f"{tmp_path}/out", "quarantine").collect()
    assert [(r.turn, r.leaks) for r in held] == [(1, ["Ann Lee"])]
    steps = sinks.delivered(spark, f"{tmp_path}/out", "audit_public").where("turn = 1").sort("seq").collect()
    assert [r.step for r in steps] == ["pii_detected", "leak_blocked"]
    leaky = spark.createDataFrame([("1", 1, 0, "turn", "see <P_1>", [], [], [{"placeholder": "<Q>", "variant": "<"}], [], False)], live.NAMED)
    judged = live.judged(leaky.withColumn("forms", F.array(F.struct(F.lit("Ann <").alias("placeholder"), F.lit("see").alias("variant")), F.struct(F.lit("<B>").alias("placeholder"), F.lit("Ann").alias("variant")))))
    assert judged.first().status == "released" and mask.unsafe_in(judged.withColumn("leaks", F.array(F.lit("x")))) is not None


def test_mask_turns_survives_null_turns(spark, tmp_path):
    live.use_rocksdb(spark)
    spark.createDataFrame([(1, None, "Name: Ann Lee"), (None, 1, "x"), (1, 1, "Name: Bo Ray"), (1, 2, "bo ray")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("conv_id long, turn int, text string").parquet(f"{tmp_path}/in")
    mask_turns(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    got = sorted(str((r.conv_id, r.turn, r.masked_text, r.status)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(map(str, [(1, None, None, "malformed"), (None, 1, None, "malformed"), (1, 1, "Name: <PERSON_001>", "released"), (1, 2, "<PERSON_001>", "released")]))


def test_replies_in_a_stream_of_their_own(spark, tmp_path):
    live.use_rocksdb(spark)
    asked = [(1, 0, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 00:01:00"), (2, 0, "2024-01-01 00:00:00"), (None, 0, "2024-01-01 00:00:00"), (9, 9, "2024-01-03 00:00:00")]
    told = [(1, 0, "2024-01-01 00:00:30", "a"), (2, 0, "2024-01-01 00:20:00", "b"), (None, 0, "2024-01-01 00:00:30", "c"), (3, 0, "2024-01-01 00:00:00", "d"), (8, 8, "2024-01-03 00:00:00", "e")]
    spark.createDataFrame(asked, "conv_id long, turn long, at string").select("conv_id", "turn", F.col("at").cast("timestamp").alias("asked_at")).write.parquet(f"{tmp_path}/q")
    spark.createDataFrame(told, "conv_id long, turn long, at string, answer string").select("conv_id", "turn", F.col("at").cast("timestamp").alias("answered_at"), "answer").write.parquet(f"{tmp_path}/a")
    q = spark.readStream.schema("conv_id long, turn long, asked_at timestamp").parquet(f"{tmp_path}/q")
    a = spark.readStream.schema("conv_id long, turn long, answered_at timestamp, answer string").parquet(f"{tmp_path}/a")
    live.answered(q, a).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    got = sorted(str((r.conv_id, r.turn, r.answer, r.status)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [(1, 0, "a", "answered"), (1, 2, None, "missing"), (2, 0, None, "missing"), (2, 0, "b", "late"), (3, 0, "d", "late"), (None, 0, None, "missing"), (None, 0, "c", "late")]
    assert got == sorted(map(str, want))
