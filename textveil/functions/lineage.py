"""Cutting the lineage of tables that several later steps read."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, a local one for a local master;
    on a cluster that is an error, as executors and driver share no local folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


#: Rows that one task takes of a table whose rows are worth much work each.
TASK_ROWS = 10_000


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over tasks by their number. A file of few bytes a row has too few row groups for the work that is made of its
    rows: all of it would lie in one task."""
    rows = df.count()
    few = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / 100))
    return df.repartition(max(1, few, math.ceil(rows / TASK_ROWS)))


def wide(df: DataFrame) -> DataFrame:
    """A join's side that grows with the corpus: it is shuffled. Spark guesses a table's size from its compressed files and the number of
    columns, also behind a checkpoint, and would otherwise broadcast a million texts through the driver."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: later readers don't compute the table anew, and it outlives its executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
