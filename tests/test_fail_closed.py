"""Null scopes, null turns, missing vaults: nothing private is released because nobody looked."""

import os

import pytest
from pyspark.sql import functions as F

from textveil.operators import conversation, mask, report, restore, vault
from textveil.plans import jobs

TURNS = [(None, 0, "Name: James Bond"), (None, 1, "Ask James Bond again"), (None, None, "Later JAMES BOND"), (4, None, "Name: Ann Lee"), (4, 1, "ann lee, and James Bond"), (4, 1, "ann lee"), (5, 0, None), (5, 1, "plain")]


def masked(spark, rows=TURNS):
    turns = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    return jobs.mask_conversations(turns)


def test_null_conversations_and_turns_are_masked(spark):
    out, minted, spelled = masked(spark)
    got = sorted(str((r.conv_id, r.turn, r.masked_text, r.leaks)) for r in out.collect())
    assert got == sorted(map(str, [
        (None, 0, "Name: <PERSON_001>", []), (None, 1, "Ask <PERSON_001> again", []), (None, None, "Later <PERSON_001>", []), (4, None, "Name: <PERSON_001>", []),
        (4, 1, "<PERSON_001>, and James Bond", []), (4, 1, "<PERSON_001>", []), (5, 0, None, []), (5, 1, "plain", []),
    ]))
    assert sorted(str((r.conv_id, r.original)) for r in minted.collect()) == ["(4, 'Ann Lee')", "(None, 'James Bond')"] and spelled.count() == 2
    assert report.vault_sizes(minted, ["conv_id"]).count() == 2 and vault.in_order(minted, ["conv_id"]).count() == 2


def test_null_turns_know_all_of_their_scope(spark):
    out, _, _ = masked(spark, [(1, None, "ask ann lee"), (1, 7, "Name: Ann Lee"), (2, None, "Name: Bo Ray"), (2, 0, "bo ray")])
    assert sorted(r.masked_text for r in out.collect()) == ["<PERSON_001>", "Name: <PERSON_001>", "Name: <PERSON_001>", "ask <PERSON_001>"]


def test_replies_errors_and_requests_of_null_conversations(spark):
    out, minted, spelled = masked(spark)
    said = spark.createDataFrame([(None, 1, "Dear person 1"), (4, 1, "<PERSON_001>")], "conv_id long, turn long, answer string")
    assert sorted(r.restored for r in jobs.restore_replies(said, minted).collect()) == ["Ann Lee", "Dear James Bond"]
    failed = spark.createDataFrame([(None, 1, "OddError", "on james bond"), (None, None, "OddError", "on james bond")], "conv_id long, turn long, error_class string, error_message string")
    assert {r.error for r in jobs.describe_failures(failed, minted, spelled).collect()} == {"OddError: on <PERSON_001>"}
    sent = {(r.conv_id, r.turn, r.question): r for r in jobs.requests_of(out, said, "p").collect()}
    assert len(sent) == len(TURNS) and [m.content for m in sent[None, 1, "Ask <PERSON_001> again"].messages] == ["p", "Ask <PERSON_001> again"]
    held = out.withColumn("masked_text", F.when(F.col("turn") == 0, None).otherwise(F.col("masked_text"))).withColumn("leaks", F.when(F.col("turn").isNull(), None).otherwise(F.col("leaks")))
    assert sorted(str((r.conv_id, r.turn)) for r in jobs.requests_of(held, said, "p").collect()) == ["(4, 1)", "(4, 1)", "(5, 0)", "(5, 1)", "(None, 1)"]


def test_spans_without_a_vault_are_held(spark):
    row = spark.createDataFrame([("Ann", None), ("Ann", "Ann")], "text string, masked string")
    none, one = F.lit(None).cast("array<struct<placeholder:string,variant:string>>"), F.array(F.struct(F.lit(0).alias("start")))
    leaks = row.select("text", F.col("masked").alias("masked_text"), mask.looked(F.col("text"), one, none, F.col("masked"), none).alias("leaks"))
    assert [r.leaks for r in leaks.collect()] == [None, None] and mask.guard(leaks)[0].isEmpty() and mask.guard(leaks)[1].count() == 2
    with pytest.raises(ValueError, match="survived"):
        mask.guard(leaks, "raise")


def test_types_that_differ_in_case_alone(spark):
    """They share their placeholders' spelling; the one first seen is restored."""
    rows = [(1, 0, 0, "PERSON", "Ann"), (1, 0, 9, "Person", "Bo"), (1, 1, 0, "Person", "Cy")]
    minted = vault.mint(spark.createDataFrame(rows, "doc_id long, seq int, start int, entity_type string, value string"), ["doc_id"])
    said = spark.createDataFrame([(1, "person 1, Person 2")], "doc_id long, text string")
    assert restore.restore(said, minted, ["doc_id"]).first().restored == "Ann, Cy"
    assert restore.restore_by_join(said, minted, "doc_id").first().restored == "Ann, Cy"


def test_history_of_null_conversations(spark):
    rows = spark.createDataFrame([(None, 0, "q0", "a0", True), (None, 1, "q1", "a1", True)], "conv_id long, turn int, question string, answer string, ok boolean")
    assert [len(r.history) for r in conversation.with_history(rows, ["conv_id"]).sort("turn").collect()] == [0, 2]


# -- the corpus job ----------------------------------------------------------------------------------------------------
DOCS = [(1, "Name: Ann Lee\nmail ann@x.example.com", "a"), (2, "ANN LEE met Bo", "b"), (3, "Name: Bo Ray", None), (None, None, "c")]


def docs_of(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string")


def test_corpus_job_with_one_vault_and_columns_kept(spark, tmp_path):
    held = jobs.mask_corpus(docs_of(spark), f"{tmp_path}/out", f"{tmp_path}/keys", one_vault=True, keep=("lang",))
    assert held.isEmpty() and sorted(os.listdir(tmp_path)) == ["keys", "out"]
    got = sorted(str(tuple(r)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(map(str, [(1, "Name: <PERSON_001>\nmail <EMAIL_ADDRESS_001>", "a"), (2, "<PERSON_001> met Bo", "b"), (3, "Name: <PERSON_002>", None), (None, None, "c")]))
    known = tuple(spark.read.parquet(f"{tmp_path}/keys/{t}") for t in ("vault", "variants"))
    more = spark.createDataFrame([(9, "Name: Cy Fox\nbo ray", "d")], "doc_id long, text string, lang string")
    jobs.mask_corpus(more, f"{tmp_path}/out2", f"{tmp_path}/keys2", one_vault=True, known=known)
    assert spark.read.parquet(f"{tmp_path}/out2").first().masked_text == "Name: <PERSON_003>\n<PERSON_002>"
    with pytest.raises(ValueError, match="rename"):
        mask.mask_documents(docs_of(spark).withColumnRenamed("lang", "spans"), keep=("spans",))


def test_refused_job_leaves_nothing_behind(spark, tmp_path):
    (tmp_path / "out").mkdir()
    with pytest.raises(FileExistsError):
        jobs.mask_corpus(docs_of(spark), f"{tmp_path}/out", f"{tmp_path}/keys")
    assert os.listdir(tmp_path) == ["out"] and not os.listdir(tmp_path / "out")
    jobs.mask_corpus(docs_of(spark), f"{tmp_path}/out", f"{tmp_path}/keys", overwrite=True)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(DOCS) and sorted(os.listdir(tmp_path / "keys")) == ["variants", "vault"]
    leaky = spark.createDataFrame([(1, "x" * 60 + " bo ray. " + "y" * 60 + "\nName: Bo Ray")], "doc_id long, text string")
    with pytest.raises(ValueError, match="survived"):
        jobs.mask_corpus(leaky, f"{tmp_path}/o3", f"{tmp_path}/k3", max_chars=80, on_leak="raise")
    held = jobs.mask_corpus(leaky, f"{tmp_path}/o3", f"{tmp_path}/k3", max_chars=80)
    assert [tuple(r) for r in held.collect()] == [(1, 1)] and spark.read.parquet(f"{tmp_path}/o3").isEmpty()


def test_masked_copies_of_files(spark, tmp_path):
    source = tmp_path / "in" / "deep"
    source.mkdir(parents=True)
    texts = {"a.txt": "Name: Ann Lee\n", "deep/b.log.txt": "é plain\n", "deep/c": "ann@x.example.com"}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    root = f"{tmp_path}/in/"
    docs = spark.createDataFrame([(root + n, t) for n, t in texts.items()], "doc_id string, text string")
    jobs.mask_corpus(docs, f"{tmp_path}/out", f"{tmp_path}/keys", files=True, root=root)
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "out"): open(os.path.join(d, f)).read() for d, _, files in os.walk(tmp_path / "out") for f in files}
    assert found == {"a.masked.txt": "Name: <PERSON_001>\n", "deep/b.log.masked.txt": "é plain\n", "deep/c.masked": "<EMAIL_ADDRESS_001>"}
    with pytest.raises(Exception, match="in the way"):  # one name is taken: neither the others nor the vault are written
        (tmp_path / "out2").mkdir()
        (tmp_path / "out2" / "a.masked.txt").write_text("mine")
        jobs.mask_corpus(docs, f"{tmp_path}/out2", f"{tmp_path}/keys2", files=True, root=root)
    left = [f for d, _, files in os.walk(tmp_path / "out2") for f in files]
    assert left == ["a.masked.txt"] and (tmp_path / "out2" / "a.masked.txt").read_text() == "mine"
    assert not [x for x in os.listdir(tmp_path / "keys2")] if (tmp_path / "keys2").exists() else True
    with pytest.raises(Exception, match="same name"):
        jobs.mask_corpus(docs.union(docs.limit(1)), f"{tmp_path}/out3", f"{tmp_path}/keys3", files=True, root=root)
