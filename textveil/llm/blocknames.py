"""Exact duplicates by deterministic block naming.

Method. A text without its white space is cut into blocks of BLOCK bytes of UTF-8. All blocks of the table are sorted, and a
block's name is its rank among the distinct ones: an integer that equal blocks alone share. Then adjacent names of a
document are paired, the pairs sorted and named in the same way, level by level, until each document has one name.
Level and name are the document's identity. Nothing is hashed for it, so no two texts can collide.

Each naming deals rows by ranges of (block, document), so that a block that a third of all documents hold lies in many tasks.
A task ranks its sorted rows; ranks are lifted by what the tasks before it hold, less one wherever a block goes on over a
border. The text is moved once, at the first level; what later levels move halves from one to the next.

The ranges' bounds are drawn on the driver from samples of what is sorted by. So that it gets no text, blocks are sorted by
their first NEAR bytes, then by a hash, then in full. Equal blocks then still stand together, unless two different ones agree in both and
share a border; tasks and borders look for that, and where it is so the naming is done again in the order of whole blocks.

Edge cases. A null text counts as empty; empty texts are equal to each other, and hold one empty block. Repeated rows are
rows of their own: of rows that agree in length and doc_id one stays. A null doc_id comes after all others in ties, and is
then the keep_id. A text of any length is read whole. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, text_rows

#: Bytes of a block.
BLOCK = 4096
#: Bytes of a block that are sorted by first: all of a pair of names.
NEAR = 16
#: Groups that hold at least this share of all rows are joined by broadcast: there can't be more than so many.
HOT_SHARE = 1000
#: What counts as white space.
BLANKS = " \t\n\x0b\x0c\r"
CARRIED = "row long, pos int, n int, doc_id long, n_chars long, digest string"


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(row, pos, n, doc_id, n_chars, digest, key): the blocks of each row's text; n is their number. What describes the
    document stands on its first block alone."""
    rows = text_rows(docs).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("b", F.translate(F.coalesce("text", F.lit("")), BLANKS, "").cast("binary"))
    rows = rows.select("row", "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "b", F.greatest(F.lit(1), F.ceil(F.octet_length("b") / size)).cast("int").alias("n"))
    # a slice of bytes costs its own length, wherever it lies
    out = rows.select("row", "doc_id", "n_chars", "b", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    first = lambda c: F.when(F.col("pos") == 0, c)
    return out.select("row", "pos", "n", first(F.col("doc_id")).alias("doc_id"), first(F.col("n_chars")).alias("n_chars"), first(F.sha2("b", 256)).alias("digest"), F.substring("b", F.col("pos") * size + 1, F.lit(size)).alias("key"))


def _ranks(batches):
    """Ranks the sorted keys of a task from 1; its first and last keys go along on the first and last row. A row clashes whose key is
    new though what it was dealt by is not."""
    part, rank, last, held = TaskContext.get().partitionId(), 0, (None, None, None), None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(c) for c in ("key", "near", "hash")]
        fresh = np.ones((3, n), dtype=bool)
        for k, c in enumerate(columns):
            if n > 1:
                fresh[k, 1:] = pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            fresh[k, 0] = c[0].as_py() != last[k]
        ranks = rank + np.cumsum(fresh[0])
        first, clash = columns[0][0].as_py(), fresh[0] & ~fresh[1] & ~fresh[2]
        rank, head, last = int(ranks[-1]), first if held is None else None, tuple(c[n - 1].as_py() for c in columns)
        if held is not None:
            yield _out(*held, None)
        held = (batch, ranks, clash, part, head)
    if held is not None:
        yield _out(*held, last[0])


def _out(batch: pa.RecordBatch, ranks: np.ndarray, clash: np.ndarray, part: int, head: bytes | None, tail: bytes | None) -> pa.RecordBatch:
    n = batch.num_rows
    at = lambda value, i: pa.array([value if k == i else None for k in range(n)], pa.binary()) if value is not None else pa.nulls(n, pa.binary())
    kept = [c for c in batch.schema.names if c not in ("key", "near", "hash")]
    columns = [batch.column(c) for c in kept] + [pa.array(ranks), pa.array(clash), pa.array(np.full(n, part, np.int32)), at(head, 0), at(tail, n - 1)]
    return pa.RecordBatch.from_arrays(columns, [*kept, "rank", "clash", "part", "head", "tail"])


def named(rows: DataFrame, whole: bool = False, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """rows (CARRIED, key BINARY) -> (CARRIED, name): the rank of the key among the distinct keys of all rows, from 1. Keys of more than
    NEAR bytes are ordered by their first ones, their hash, then in full; or, with ``whole``, in full alone."""
    near = lambda key: F.substring(key, F.lit(1), F.lit(NEAR))
    keyed = rows.withColumns({"near": near(F.col("key")), "hash": hashed(F.col("key"))})
    order = ["key"] if whole else ["near", "hash"]
    ranged = keyed.repartitionByRange(*order, "row", "pos").sortWithinPartitions(*order, "key", "row", "pos")
    # checkpointed before anything reads the tasks' numbers, as a range partitioning computed anew may draw other bounds
    local = cut(ranged.mapInArrow(_ranks, f"{CARRIED}, rank long, clash boolean, part int, head binary, tail binary"))
    parts = cut(local.groupBy("part").agg(F.max("rank").alias("n"), F.max("clash").alias("clash"), F.max("head").alias("head"), F.max("tail").alias("tail")))
    before = parts.select("part", F.lag("part").over(W.orderBy("part")).alias("before"))  # task numbers alone
    tails = parts.select(F.col("part").alias("before"), F.col("tail").alias("ended"))
    met = parts.join(before, "part").join(tails, "before", "left")
    if not whole:
        alike = (near(F.col("head")) == near(F.col("ended"))) & (hashed(F.col("head")) == hashed(F.col("ended"))) & (F.col("head") != F.col("ended"))
        if met.agg(F.max(F.col("clash") | F.coalesce(alike, F.lit(False)))).first()[0]:
            return named(rows, True)
    borders = met.select("part", parts["n"], F.coalesce(F.col("head") == F.col("ended"), F.lit(False)).cast("long").alias("goes_on"))
    upto = W.orderBy("part")
    lift = borders.select("part", (F.coalesce(F.sum("n").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.sum("goes_on").over(upto.rowsBetween(W.unboundedPreceding, 0))).alias("lift"))
    columns = [c for c in local.columns if c not in ("rank", "clash", "part", "head", "tail")]
    return local.join(F.broadcast(lift), "part").select(*columns, (F.col("rank") + F.col("lift")).alias("name"))  # a row for each task


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(row, doc_id, n_chars, digest, level, name): each row of docs with its identity; equal ones have equal texts."""
    level, found = 0, named(blocks(docs, size))
    most = found.agg(F.max("n")).first()[0] or 1
    about = ["row", "doc_id", "n_chars", "digest"]
    done = [found.where("n = 1").select(*about, F.lit(0).alias("level"), "name")]
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        side = lambda odd: F.coalesce(F.max(F.when(F.col("pos") % 2 == odd, F.col("name"))), F.lit(0))
        pairs = found.where("n > 1").groupBy("row", F.shiftright("pos", 1).alias("at")).agg(F.max("n").alias("n"), *[F.max(c).alias(c) for c in about[1:]], side(0).alias("left"), side(1).alias("right"))
        whole = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
        keyed = pairs.select("row", F.col("at").alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n"), *about[1:], F.concat(whole("left"), whole("right")).alias("key"))
        found = named(keyed, True)  # keys are short
        done.append(found.where("n = 1").select(*about, F.lit(level).alias("level"), "name"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return cut(out)


def groups(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space).

    Of equal texts the row with the most code points stays, then the one with the smallest doc_id."""
    rows = identities(docs, size)
    key = ["level", "name"]
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id", "row"))
    several = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).where("group_size > 1"))
    # an identity that many rows share meets them by broadcast; at most HOT_SHARE groups can be that large
    bound = rows.count() / HOT_SHARE
    hot, cold = F.broadcast(several.where(F.col("group_size") > bound)), several.where(F.col("group_size") <= bound)
    met = rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key, "left"), allowMissingColumns=True)
    alone = F.col("best").isNull()
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, True).otherwise(F.col("best.row") == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
