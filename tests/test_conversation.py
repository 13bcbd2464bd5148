import pytest
from pyspark.sql import functions as F

from textveil.functions.patterns import FAILURES, STEPS
from textveil.operators import conversation, detect, mask, report, vault
from textveil.plans import jobs
from textveil.sources import append_audit, read_texts, write_masked
from textveil.streaming import mask_turns

TURNS = [(1, 0, "user", "Name: Ann Lee\nhello"), (1, 2, "user", "mail a@x.example.com"), (1, 4, "user", "Ann Lee wrote to A@X.EXAMPLE.COM, b@x.example.com"), (2, 0, "user", "nothing"), (2, 1, "assistant", "b@x.example.com")]


def test_history(spark):
    rows = [(1, t, f"q{t}", f"a{t}", t != 2) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, question string, answer string, ok boolean")
    got = {r.turn: [m.content for m in r.history] for r in conversation.with_history(df, ["conv_id"], 2).collect()}
    assert got == {0: [], 1: ["q0", "a0"], 2: ["q0", "a0", "q1", "a1"], 3: ["q0", "a0", "q1", "a1"], 4: ["q1", "a1", "q3", "a3"], 5: ["q3", "a3", "q4", "a4"]}
    out = conversation.requests(conversation.with_history(df, ["conv_id"], 2), "be good").where("turn = 1").first().messages
    assert [(m.role, m.content) for m in out] == [("system", "be good"), ("user", "q0"), ("assistant", "a0"), ("user", "q1")]


def test_masked_turns_and_requests(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string")
    out, _, _ = jobs.mask_conversations(turns)
    got = {(r.conv_id, r.turn): r.masked_text for r in out.collect()}
    assert got[1, 4] == "<PERSON_001> wrote to <EMAIL_ADDRESS_001>, <EMAIL_ADDRESS_002>" and (2, 1) not in got
    replies = spark.createDataFrame([(1, 0, "hi <PERSON_001>")], "conv_id long, turn int, answer string")
    asked = {(r.conv_id, r.turn): len(r.messages) for r in jobs.requests_of(out, replies, "s").collect()}
    assert asked == {(1, 0): 2, (1, 2): 4, (1, 4): 4, (2, 0): 2}


def test_stream_equals_batch(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").where("role = 'user'")
    batch, _, _ = jobs.mask_conversations(turns)
    turns.select("conv_id", "turn", "text").where("turn < 3").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("conv_id long, turn int, text string").parquet(str(tmp_path / "in"))
    start = lambda: mask_turns(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    start().awaitTermination()
    turns.select("conv_id", "turn", "text").where("turn > 3").union(spark.createDataFrame([(1, 1, "late b@x.example.com")], "conv_id long, turn int, text string").where("false")).write.mode("append").parquet(str(tmp_path / "in"))
    start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.conv_id, r.turn): r.masked_text for r in got.collect()} == {(r.conv_id, r.turn): r.masked_text for r in batch.collect()}
    assert got.where("late or n_leaks > 0").count() == 0


def test_idle_conversations_start_anew(spark, tmp_path):
    schema = "conv_id long, turn int, text string"
    rows = [(1, 0, "write to a@x.example.com"), (2, 0, "write to c@x.example.com"), (1, 1, "write to b@x.example.com")]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for row in rows:  # a batch each; the second finds conversation 1 idle
            spark.createDataFrame([row], schema).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            out = mask_turns(source, idle_ms=1).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            job = out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            ended = job.awaitTermination(60)
            job.stop()
            assert ended
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {(r.conv_id, r.turn): r.masked_text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {key: "write to <EMAIL_ADDRESS_001>" for key in ((1, 0), (2, 0), (1, 1))}


def test_failures(spark):
    names = ["APIConnectionError", "APITimeoutError", "RateLimitError", "AuthenticationError", "PermissionDeniedError", "NotFoundError", "BadRequestError", "InternalServerError"]
    rows = [(n, "x") for n in names] + [("WeirdError", "one\ntwo\nthree"), ("WeirdError", ""), ("WeirdError", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, m string").select(conversation.failure_reason(F.col("c"), F.col("m"))).collect()]
    assert set(got[:8]) == {said for _, said in FAILURES} and got[8:] == ["WeirdError: one", "WeirdError: WeirdError", "WeirdError: WeirdError"]


def test_audit_order_and_sinks(spark, tmp_path):
    rows = [(1, 0, "t", "m", "a", "r", {"PERSON": 2, "IP_ADDRESS": 1}, 0, 0, 0, "big", None), (1, 1, "t", "m", None, None, {"PERSON": 1}, 1, 1, 2, "big", None), (1, 2, "t", "m", None, None, None, 0, 0, 2, None, "it's down {n}")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string, masked_text string, answer string, restored string, entity_counts map<string,long>, n_sealed int, n_leaks int, n_history int, model string, error string")
    events = conversation.audit(df, ["conv_id", "turn"])
    of = lambda t: events.where(F.col("turn") == t).orderBy("seq").collect()
    assert [r.step for r in of(0)] == ["input_received", "pii_detected", "leak_check", "masked", "llm_request", "llm_response", "unmasked"]
    assert [r.step for r in of(1)] == ["input_received", "pii_detected", "sealed", "leak_blocked"]
    assert of(2)[-1].step == "llm_failed" and of(2)[-1].message.endswith("it's down {n}")
    assert of(0)[1].payload == {"PERSON": "2", "IP_ADDRESS": "1"} and of(0)[1].message == STEPS["pii_detected"].format(n=3)
    assert of(0)[4].payload == {"text": "m", "model": "big", "history_messages": "0"} and of(2)[1].payload == {}
    assert {r.step for r in events.where("sensitive").collect()} == {"input_received", "unmasked"}
    assert conversation.public_view(events).where("step = 'input_received'").isEmpty()
    append_audit(events, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == events.count()
    (tmp_path / "a.txt").write_text("line one\nline two", "utf-8")
    assert read_texts(spark, str(tmp_path / "a.txt")).first().text == "line one\nline two"
    write_masked(df.select("turn", "masked_text", "text"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).columns == ["turn", "masked_text"]
    with pytest.raises(Exception, match="(?i)exist"):
        write_masked(df.select("turn", "masked_text"), str(tmp_path / "m"))


def test_failures_are_redacted_with_what_is_known_by_then(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string")
    _, minted, spelled = jobs.mask_conversations(turns)
    rows = [(1, 0, "OddError", "failed on ANN LEE and b@x.example.com\nmore"), (1, 4, "OddError", "failed on b@x.example.com"), (2, 0, "OddError", "failed on Ann Lee"), (9, 0, "RateLimitError", "x")]
    got = {(r.conv_id, r.turn): r.error for r in jobs.describe_failures(spark.createDataFrame(rows, "conv_id long, turn int, error_class string, error_message string"), minted, spelled).collect()}
    assert got == {(1, 0): "OddError: failed on <PERSON_001> and b@x.example.com", (1, 4): "OddError: failed on <EMAIL_ADDRESS_002>", (2, 0): "OddError: failed on Ann Lee", (9, 0): dict(FAILURES)["ratelimit"]}


def test_replies_know_the_vault_of_their_turn(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string")
    _, minted, _ = jobs.mask_conversations(turns)
    replies = spark.createDataFrame([(1, 0, "<PERSON_001> <EMAIL_ADDRESS_001>"), (1, 2, "<PERSON_001> <EMAIL_ADDRESS_001>"), (3, 0, "<PERSON_001>")], "conv_id long, turn int, answer string")
    got = {(r.conv_id, r.turn): r.restored for r in jobs.restore_replies(replies, minted).collect()}
    assert got == {(1, 0): "Ann Lee <EMAIL_ADDRESS_001>", (1, 2): "Ann Lee a@x.example.com", (3, 0): "<PERSON_001>"}


def test_a_reset_forgets_the_thread_alone(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string")
    out, _, _ = jobs.mask_conversations(turns)
    replies = spark.createDataFrame([(1, 0, "hi"), (1, 2, "ho")], "conv_id long, turn int, answer string")
    resets = spark.createDataFrame([(1, 1), (1, 4), (5, 0)], "conv_id long, turn int")
    got = {(r.conv_id, r.turn): (r.thread, len(r.messages), r.question) for r in jobs.requests_of(out, replies, "s", resets=resets).collect()}
    assert {k: v[:2] for k, v in got.items()} == {(1, 0): (0, 2), (1, 2): (1, 2), (1, 4): (2, 2), (2, 0): (0, 2)}
    assert got[1, 4][2].startswith("<PERSON_001> wrote to <EMAIL_ADDRESS_001>")


def test_public_rows_hold_no_value(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string")
    out, minted, spelled = jobs.mask_conversations(turns)
    rows = out.select("conv_id", "turn", "text", "masked_text", F.col("masked_text").alias("answer"), F.col("text").alias("restored"), "entity_counts", F.size("sealed").alias("n_sealed"), F.size("leaks").alias("n_leaks"), F.lit(0).alias("n_history"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("error"))
    events = conversation.public_view(conversation.audit(rows, ["conv_id", "turn"]))
    rendered = events.select("conv_id", F.concat_ws(" ", "step", "message", F.to_json("payload")).alias("said"))
    found = rendered.join(vault.entries(minted, ["conv_id"], spelled), "conv_id").where(F.size(mask.leaks(F.col("said"), mask.forms_of(F.col("entries"), None))) > 0)
    assert rendered.count() == 21 and found.isEmpty()


def test_reports(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string")
    said = spark.createDataFrame([("PERSON", "ann lee", "n")], "entity_type string, value_key string, answer string")
    out, minted, _ = jobs.mask_conversations(turns, decisions=said, confirm_below=0.9)
    spans = detect.explode_spans(out, "conv_id", "turn", spans="approved")
    total = report.sealed_and_declined(out).first()
    assert (total.n_sealed, total.n_declined) == (0, 1)
    assert [tuple(r) for r in report.left_by_decision(out, "conv_id").collect()] == [(1, "PERSON", "Ann Lee")]
    assert [tuple(r) for r in report.types_in_order(spans).collect()] == [("EMAIL_ADDRESS", 3)]
    assert [tuple(r) for r in report.distinct_values(spans).collect()] == [("EMAIL_ADDRESS", 2)]
    assert [tuple(r) for r in report.types_found(spans, "conv_id").collect()] == [(1, ["EMAIL_ADDRESS"])]
    assert [tuple(r) for r in report.vault_sizes(minted, ["conv_id"]).collect()] == [(1, 2, ["<EMAIL_ADDRESS_001>", "<EMAIL_ADDRESS_002>"])]
    safe = report.safe_detections(spans, minted, ["conv_id"])
    assert safe.columns == ["conv_id", "entity_type", "score", "placeholder"] and safe.count() == 3
    assert [(r.placeholder, r.n_entries) for r in vault.in_order(minted, ["conv_id"]).collect()] == [("<EMAIL_ADDRESS_001>", 2), ("<EMAIL_ADDRESS_002>", 2)]
    assert [r.n_entries for r in vault.in_order(minted.drop("conv_id"), []).collect()] == [2, 2]
    mentions = mask.mentions_of(out.where("turn = 4"), ["conv_id"])
    first = vault.mint(mask.mentions_of(out.where("turn < 4"), ["conv_id"]), ["conv_id"])
    assert [r.value for r in report.seen_again(mentions, first, ["conv_id"]).collect()] == ["A@X.EXAMPLE.COM"]
