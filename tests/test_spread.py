"""Work that lies in one task, or goes through the driver, because a small file says so."""

from pyspark.sql import functions as F

from textveil.functions.joins import meet
from textveil.functions.lineage import TASK_ROWS, spread
from textveil.operators import detect, mask
from textveil.plans import queries


def test_one_row_group_is_dealt_over_tasks(spark, tmp_path):
    n = 3 * TASK_ROWS
    spark.range(n).selectExpr("id as c_custkey", "'Customer#' || lpad(cast(id as string), 9, '0') as c_name", "cast(id % 25 as int) as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = queries.records(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= 3 and rows.count() == n
    assert max(r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) <= 1.2 * TASK_ROWS
    assert spread(spark.range(0)).count() == 0


def test_spans_are_exploded_without_detecting_anew(spark):
    rows = spark.createDataFrame([(1, "by EMP-000001 and EMP-000002"), (2, "nothing"), (3, None)], "doc_id int, text string")
    out = detect.explode_spans(detect.detect(rows, entities=("EMPLOYEE_ID",)), "doc_id").select("doc_id", "value")
    assert sorted(map(tuple, out.collect())) == [(1, "EMP-000001"), (1, "EMP-000002")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EMP-") == detect.detect(rows, entities=("EMPLOYEE_ID",))._jdf.queryExecution().optimizedPlan().toString().count("EMP-")


def test_texts_are_not_broadcast(spark, tmp_path):
    """Files and checkpoints that look small are shuffled all the same."""
    spark.range(50).selectExpr("id as doc_id", "'said Name' || id as text", "'Name' || id as variant").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(meet(t, t.select("doc_id", F.col("text").alias("x")), ["doc_id"]))
    found = mask.corpus_leaks(t, t, "doc_id")
    assert found.count() == 50
    assert "_text" not in "".join(x.split("\n")[1] for x in plan(found).split("BroadcastExchange")[1:])
