"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this count may be broadcast (8 bytes each, so at most 16 MB); above it, joins shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of text that a task turns into Python objects at a time.
SLICE = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone: extra columns, whatever their names, can't clash with internal ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, a local one for a local master;
    on a cluster that is an error, as executors and driver share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def narrow(small: DataFrame, n: int) -> DataFrame:
    """Marks a table of n ids for broadcast if n is within the bound; else a shuffle join is left to the planner."""
    return F.broadcast(small) if n <= BROADCAST_IDS else small


_HELD: dict = {}


def remembered(key, make: Callable):
    """What a Python worker keeps between tasks under this key. A worker keeps one thing: a task with another key
    drops it, so that the stages of a job don't add up their memories."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, list]]:
    """(place of the first, values) of parts of a text column of at most so many bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, column.slice(at, upto - at).to_pylist()
        at = upto
    pa.default_memory_pool().release_unused()  # of earlier batches


def gather(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches flat[starts[r] : starts[r + 1]] of these rows in turn, and where each ends."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    if not len(rows) or not ends[-1]:
        return flat[:0], ends
    at = np.repeat(starts[rows] - (ends - sizes), sizes)
    at += np.arange(len(at), dtype=at.dtype)
    return flat[at], ends
