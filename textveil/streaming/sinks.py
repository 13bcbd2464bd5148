"""Where a live job's rows go: released requests, restored answers, the quarantine, malformed events and audit rows, all of a batch or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import conversation
from ..sources import _hadoop

#: The tables that a batch is written to. Only the first and the public audit rows hold no private value.
TABLES = ("released", "answers", "quarantine", "malformed", "audit_public", "audit_sensitive")
#: Numbers of a reply's audit rows go on behind the greatest that its turn can have.
REPLY_SEQ = {"llm_response": 8, "unmasked": 9}


def audit_rows(done: DataFrame, model: str) -> DataFrame:
    """Audit rows of live's rows: a turn's up to the request (or the block), a reply's from the response on."""
    own = done.where(F.col("kind").isin("turn", "reply") & (F.col("status") != "malformed"))
    facts = own.select("conv_id", "turn", "kind", "text", "masked_text", F.col("text").alias("answer"), "restored", "entity_counts", F.size("sealed").alias("n_sealed"), F.when(F.col("status") == "blocked", F.greatest(F.size("leaks"), F.lit(1))).otherwise(0).alias("n_leaks"), F.size("history").alias("n_history"), F.lit(model).alias("model"), F.lit(None).cast("string").alias("error"))
    rows = conversation.audit(facts, ["conv_id", "turn", "kind"])
    of_reply = F.col("step").isin(*REPLY_SEQ)
    rows = rows.where((F.col("kind") == "reply") == of_reply)
    seq = F.coalesce(*[F.when(F.col("step") == step, n) for step, n in REPLY_SEQ.items()], F.col("seq"))
    return rows.withColumn("seq", seq).drop("kind")


def _tables(done: DataFrame, system_prompt: str, model: str) -> dict[str, DataFrame]:
    message = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    requests = done.where("status = 'released'").withColumn("messages", F.concat(message("system", F.lit(system_prompt)), "history", message("user", F.col("masked_text"))))
    events = audit_rows(done, model)
    return {
        "released": requests.select("conv_id", "turn", "masked_text", "messages", "entity_counts", F.size("sealed").alias("n_sealed"), "late"),
        "answers": done.where("status = 'answered'").select("conv_id", "turn", F.col("text").alias("masked_answer"), "restored"),
        "quarantine": done.where("status = 'blocked'").select("conv_id", "turn", "text", "masked_text", "leaks"),
        "malformed": done.where("status = 'malformed'").select("conv_id", "turn", "kind", "text"),
        "audit_public": events.where("not sensitive").drop("sensitive"),
        "audit_sensitive": events.where("sensitive").drop("sensitive"),
    }


def write_batch(done: DataFrame, batch: int, path: str, *, system_prompt: str = "Keep placeholders as they are.", model: str = "model") -> None:
    """One batch of live's rows into all tables. Each batch has folders of its own, which a batch that is done again replaces, and counts
    only once its mark is set, after the last table: readers see all of it, once, or nothing."""
    spark = done.sparkSession
    done = done.persist()
    try:
        for name, df in _tables(done, system_prompt, model).items():
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    finally:
        done.unpersist()
    fs, mark = _hadoop(spark, f"{path}/_committed/{batch}")
    fs.create(mark, True).close()


def deliver(done: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Starts the live job: live's rows go to the tables below path."""
    writer = done.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: write_batch(df, batch, path, **options))
    return writer.trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def delivered(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of the tables, of committed batches alone (batch is a column)."""
    if table not in TABLES:
        raise ValueError(f"table must be one of {TABLES}, got {table!r}")
    fs, marks = _hadoop(spark, f"{path}/_committed")
    batches = sorted(int(x.getPath().getName()) for x in fs.listStatus(marks)) if fs.exists(marks) else []
    if not batches:
        raise FileNotFoundError(f"no batch is committed below {path}")
    return spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/batch={b}" for b in batches])
