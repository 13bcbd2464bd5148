"""Approximate nearest neighbours by a robust-pruned directed graph.

Distinct vectors are dealt by hash to shards, one to a task. In each shard a graph is grown: a greedy (beam) search for every
vector proposes neighbours, and pruning keeps the nearest first and drops those that a kept one is closer to by
the relaxation factor, so edges stay few and point in diverse directions; reverse edges are added and pruned
alike. Queries go to every shard in blocks, a beam search in each proposes candidates, and the best of all shards,
measured again in double precision on the original vectors, are the answer. Equal vectors form one node that carries its smallest ids, so ties are exact and copies can't crowd the
graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Neighbours asked for, edges a node, beam, relaxation, queries a block.
NEAREST, DEGREE, BEAM, ALPHA, BLOCK = 5, 20, 48, 1.2, 512
#: Vectors a shard (with the beam above, larger ones find less: see README), blocks that a task meets with one shard,
#: tasks of the search at most.
SHARD, TURN, TASKS = 4096, 16, 20_000


def greedy(unit: np.ndarray, edges: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries at once: the nodes met (rows of ids by nearness, -1 for none) and their similarities."""
    n, m = len(q), len(unit)
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf, np.float32)
    k = min(beam, len(entry))
    s = q @ unit[entry].T
    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
    ids[:, :k], sims[:, :k] = entry[best], np.take_along_axis(s, best, 1)
    seen = np.zeros((n, m), bool)
    seen[:, entry] = True
    done = ids < 0
    rows = np.arange(n)
    while True:
        open_ = np.where(done, -np.inf, sims)
        at = open_.argmax(1)
        live = rows[~done[rows, at]]
        if not len(live):
            return ids, sims
        done[live, at[live]] = True
        near = edges[ids[live, at[live]]]  # (live, degree)
        new = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, ids[live, at[live]][:, None])] = True
        s = np.einsum("ad,akd->ak", q[live], unit[np.maximum(near, 0)])
        s[~new] = -np.inf
        all_s = np.concatenate([sims[live], s], 1)
        keep = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, near, -1)], 1), keep, 1)
        sims[live] = np.take_along_axis(all_s, keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], 1), keep, 1)


def prune(unit: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node of ``own``, at most ``degree`` of its candidates (-1: none): the nearest first, then only
    those that no kept one is nearer to than 1/alpha of their distance to the node."""
    cand = np.where(cand == own[:, None], -1, cand)
    v = unit[np.maximum(cand, 0)]
    d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ad,akd->ak", unit[own], v)))
    d[cand < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    twice = np.zeros(cand.shape, bool)
    by_id = np.argsort(cand, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(cand, by_id, 1)
    np.put_along_axis(twice, by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
    alive = np.isfinite(d) & ~twice
    out = np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    for slot in range(degree):
        at = alive.argmax(1)
        some = alive[rows, at]
        if not some.any():
            break
        out[some, slot] = cand[rows, at][some]
        apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ad,akd->ak", v[rows, at], v)))
        alive &= ~((alpha * apart <= d) & some[:, None])
        alive[rows, at] = False
    return out


def build(unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entry points) of one shard. Nodes come in growing batches in random order; a second pass over all
    nodes prunes with the relaxation on the grown graph."""
    n = len(unit)
    edges = np.full((n, degree), -1, np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    middle = int((unit @ unit.mean(0)).argmax()) if n else 0
    entry = np.unique(np.concatenate([[middle], order[: min(n, 8)]]))
    for a in (1.0, alpha):
        at, size = 0, 32 if a == 1.0 else 512
        while at < n:
            own = order[at : at + size]
            met, _ = greedy(unit, edges, entry, unit[own], beam)
            edges[own] = prune(unit, own, np.concatenate([met, edges[own]], 1), degree, a)
            # reverse edges, pruned with what stands there
            src = np.repeat(own, degree)
            dst = edges[own].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
            for lo in range(0, len(nodes), 512):
                part, f, c = nodes[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
                extra = np.full((len(part), int(c.max())), -1, np.int64)
                for i in range(len(part)):
                    extra[i, : c[i]] = src[f[i] : f[i] + c[i]]
                edges[part] = prune(unit, part, np.concatenate([edges[part], extra], 1), degree, a)
            at += size
            size = min(512, size * 2)
    return edges, entry


def _index(parts):
    """The vectors of one shard -> one row with its graph."""
    import pandas as pd

    frames = [p.to_pandas() for p in parts if p.num_rows]
    if not frames:
        return
    own = pd.concat(frames, ignore_index=True).sort_values("node")
    raw = np.stack(own["v"].to_numpy()).astype(np.float32)
    wide = raw.astype(np.float64)
    edges, entry = build((wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32))
    row = [pa.array([int(own["shard"].iloc[0])], pa.int32()), pa.array([len(own)], pa.int32())]
    row += [pa.array([x.tobytes()], pa.binary()) for x in (own["node"].to_numpy(np.int64), raw, edges.astype(np.int32), entry.astype(np.int32))]
    yield pa.RecordBatch.from_arrays(row, names=["shard", "n", "nodes", "raw", "edges", "entry"])


def _search(k: int, beam: int):
    """Rows of a shard, its graph first and then blocks of queries -> (q_node, node, score)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in ("nodes", "raw", "edges", "entry")}
                v = np.frombuffer(r["raw"], np.float32).reshape(len(r["nodes"]) // 8, -1)
                norm = np.linalg.norm(v.astype(np.float64), axis=1)
                if r["edges"] is not None:
                    nodes, raw, raw_norm = np.frombuffer(r["nodes"], np.int64), v, norm
                    unit = (raw / norm[:, None]).astype(np.float32)
                    edges = np.frombuffer(r["edges"], np.int32).reshape(len(nodes), -1)
                    entry = np.frombuffer(r["entry"], np.int32)
                    continue
                met, _ = greedy(unit, edges, entry, (v / norm[:, None]).astype(np.float32), beam)
                top = met[:, : 4 * k]
                exact = np.einsum("ad,akd->ak", v.astype(np.float64), raw[np.maximum(top, 0)].astype(np.float64)) / (norm[:, None] * raw_norm[np.maximum(top, 0)])
                exact[top < 0] = -np.inf
                keep = np.argsort(-exact, axis=1, kind="stable")[:, : k + 1]
                score, at = np.take_along_axis(exact, keep, 1), np.take_along_axis(top, keep, 1)
                ok = at >= 0
                ids = np.frombuffer(r["nodes"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(1))), pa.array(nodes[at[ok]]), pa.array(score[ok])], names=["q_node", "node", "score"])

    return run


def _blocks(parts):
    """The query vectors of one block -> one row."""
    import pandas as pd

    frames = [p.to_pandas() for p in parts if p.num_rows]
    if not frames:
        return
    own = pd.concat(frames, ignore_index=True)
    row = [pa.array([int(own["block"].iloc[0])], pa.int32()), pa.array([int(own["size"].iloc[0])], pa.int32())]
    row += [pa.array([x.tobytes()], pa.binary()) for x in (own["node"].to_numpy(np.int64), np.stack(own["v"].to_numpy()).astype(np.float32))]
    yield pa.RecordBatch.from_arrays(row, names=["block", "size", "nodes", "raw"])


def _dealt(vectors: DataFrame, each: int, name: str, salt: int) -> tuple[DataFrame, DataFrame, int]:
    """(vectors with a number that stands for one length and hash, the lengths' (size, base, parts), numbers in all): about
    ``each`` vectors a number."""
    sizes = vectors.groupBy("size").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / each).cast("int"))
    spaces = cut(sizes.withColumn("base", F.sum("parts").over(W.orderBy("size")).cast("int") - F.col("parts")).select("size", "base", "parts"))  # a row for each length
    total = spaces.agg(F.sum("parts")).first()[0] or 0
    number = F.col("base") + F.pmod(F.xxhash64("node", F.lit(salt)), F.col("parts")).cast("int")
    return vectors.join(spaces, "size").withColumn(name, number).drop("base", "parts"), spaces, total


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = 50, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score: each query's k nearest found.

    Queries are the rows whose vec_id is divisible by ``every``. Vectors that are null, empty, all zero, or hold null or
    non-finite components take no part; neither do null ids. Vectors of different lengths have no cosine: a query's
    candidates are those of its own length. Rows that repeat an id with an equal vector count once.
    ``shard`` is the number of vectors a shard, about. Equal scores go by the smaller vec_id. Where there are fewer candidates than
    k, all are given; an empty table, or one without queries, gives an empty result; extra columns are not read."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    d = d.where(F.col("vec_id").isNotNull() & sound).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float")))
    d = cut(d.distinct())
    # a class of equal vectors is known by its least id; its k + 1 least ids are all that any answer needs
    classes = cut(d.groupBy("v").agg(F.min("vec_id").alias("node")).withColumn("size", F.size("v")))
    least = d.withColumn("i", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    members = cut(least.join(classes, "v").select("node", F.col("vec_id").alias("member")))
    queries = cut(d.where(F.col("vec_id") % every == 0).join(classes, "v").select(F.col("vec_id").alias("query_id"), F.col("node").alias("q_node")))
    dealt, spaces, shards = _dealt(classes, shard, "shard", 0)
    asked = classes.join(queries.select(F.col("q_node").alias("node")).distinct(), "node", "left_semi")
    asked, _, n_blocks = _dealt(asked, BLOCK, "block", 1)
    if not n_blocks:
        return d.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = cut(dealt.select("shard", "node", "v").repartitionById(shards, "shard").mapInArrow(_index, "shard int, n int, nodes binary, raw binary, edges binary, entry binary"))
    blocks = cut(asked.select("block", "size", "node", "v").repartitionById(n_blocks, "block").mapInArrow(_blocks, "block int, size int, nodes binary, raw binary"))
    # a task holds one shard's graph and meets TURN blocks after it, so a graph travels once for so many blocks
    turns = -(-n_blocks // TURN)
    sent = blocks.join(spaces, "size").withColumn("shard", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("parts") - 1)))
    sent = sent.select((F.col("shard").cast("long") * turns + F.floor(F.col("block") / TURN)).alias("task"), "nodes", "raw", F.lit(None).cast("binary").alias("edges"), F.lit(None).cast("binary").alias("entry"))
    graphs = index.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).select((F.col("shard").cast("long") * turns + F.col("turn")).alias("task"), "nodes", "raw", "edges", "entry")
    width = min(shards * turns, TASKS)
    lined = graphs.union(sent).repartitionById(width, F.pmod("task", F.lit(width)).cast("int")).sortWithinPartitions("task", F.col("edges").isNull())
    found = lined.select("nodes", "raw", "edges", "entry").mapInArrow(_search(k, beam), "q_node long, node long, score double")
    # the best classes of a query vector over all shards, then their members for each query id
    by_score = W.partitionBy("q_node").orderBy(F.desc("score"), "node")
    best = cut(found.withColumn("i", F.row_number().over(by_score)).where(F.col("i") <= k + 1).select("q_node", "node", "score"))
    named = best.join(members, "node").withColumn("i", F.row_number().over(W.partitionBy("q_node").orderBy(F.desc("score"), "member"))).where(F.col("i") <= k + 1)
    lists = cut(named.groupBy("q_node").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("member").alias("vec_id")))).alias("all")))
    own = queries.join(lists, "q_node").select("query_id", F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    out = own.select("query_id", F.posexplode("top").alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
