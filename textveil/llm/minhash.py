"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Method. A shingle's hash, cut to 32 bits, is sent through a first permutation sigma of [0, 2^32); coordinate k of the
signature is the minimum of one second permutation pi over the values shifted circularly by k steps, so two
permutations stand in for ``bands * rows`` of them. Both are bijections (xor-shifts and odd multipliers). Equal bands
propose candidates; every link is confirmed on the full shingle sets.

Nothing is lost to skew: documents with equal shingle sets form one class and only one of them is compared.
In a bucket of candidates no pair list is made. First every member meets its bucket's centre (the member that
shares buckets with most others), which joins a group of m copies in m tests. Buckets that still hold several
components are cut into blocks, and each task holds one block against another and counts what their sets share.

A pair at the threshold of 0.75 shares no band with probability (1 - 0.75^4)^36, about 1e-6; nearer ones
far less (3e-10 at 0.82). Every pair that shares a band and isn't joined otherwise is compared in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gather, narrow, slices, text_rows
from .components import components

BANDS, ROWS, WIDTH = 36, 4, 5
#: Rows, and shingles, of a bucket that one task holds against as many others.
BLOCK, BLOCK_SHINGLES = 512, 500_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Odd multipliers of the bijective mixers; any odd values do.
SIGMA, SIGMA1, SIGMA2, PI, STEP, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x7FEB352D), np.uint32(0x846CA68B), np.uint32(0x85EBCA6B), 0x6C62272E, np.uint64(0x100000001B3)


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; all words as one if there are fewer than width."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes.split: blanks and \\x09-\\x0D
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)  # shorter sequences hash apart from full shingles
    for i in range(min(width, len(h))):
        out = out * BASE + (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29)))
    out ^= out >> np.uint64(32)
    out *= SIGMA
    out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The signatures of non-empty sets: a row of ``size`` circulant minima each."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    z = np.concatenate(sets)
    z = (z >> np.uint64(32)).astype(np.uint32)
    z ^= z >> np.uint32(16)
    z *= SIGMA1
    z ^= z >> np.uint32(15)
    z *= SIGMA2
    z ^= z >> np.uint32(16)  # sigma
    out = np.empty((len(sets), size), np.uint32)
    for k in range(size):
        x = z + np.uint32((k * STEP) & 0xFFFFFFFF)  # the circular shift
        x ^= x >> np.uint32(16)
        x *= PI  # pi
        x ^= x >> np.uint32(13)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of ``bands`` 64-bit keys for each signature."""
    keys = np.empty((len(least), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(least), band + 1, np.uint64)
        for row in range(rows):
            key = (key ^ least[:, band * rows + row].astype(np.uint64)) * SIGMA
            key ^= key >> np.uint64(31)
        keys[:, band] = key
    return keys


def _sign(bands: int, rows: int, width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                yield _emit(batch.column(0).slice(at, len(texts)), [shingle_hashes(t, width) for t in texts], schema)

    def _emit(ids, block, schema):
        full = [s for s in block if len(s)]
        keys = band_keys(minima(full, bands * rows), bands, rows).view(np.int64) if full else np.empty((0, bands), np.int64)
        counts = np.cumsum([0] + [bands * bool(len(s)) for s in block])
        lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(keys.ravel()))
        cls = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in block]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in block], pa.int64()), pa.array(cls, pa.binary()), lists], schema=schema)

    return run


def _sets(width: int):
    schema = pa.schema([("id", pa.int64()), ("hs", pa.list_(pa.int64())), ("sk", pa.list_(pa.int16()))])

    def lists(rows, kind):
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in rows]), pa.int32()), pa.array(np.concatenate(rows), kind))

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                own, rows = [], []
                for i, t in enumerate(texts, at):
                    hs = shingle_hashes(t, width)
                    if xxhash.xxh3_128_digest(hs.tobytes()) == batch.column(2)[i].as_py():  # not another text of a repeated id
                        own.append(batch.column(0)[i].as_py())
                        rows.append(hs.view(np.int64))
                if own:
                    short = [np.unique((r.view(np.uint64) >> np.uint64(48)).astype(np.uint16)).view(np.int16) for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), lists(rows, pa.int64()), lists(short, pa.int16())], schema=schema)

    return run


def _centres(members: DataFrame) -> DataFrame:
    """(key, c): the centre of each bucket, the member that shares buckets with most others, ties to the smaller id.
    Partial aggregates alone, so no bucket is gathered."""
    mass = members.groupBy("id").agg(F.sum("m").alias("mass"))
    best = F.min(F.struct((-F.col("mass")).alias("less"), F.col("id").alias("id")))
    return members.join(mass, "id").groupBy("key").agg(best.alias("x")).select("key", F.col("x.id").alias("c"))


def _meet(threshold: int):
    """The links within one bucket's block, or between two blocks, of members of different components. What a member
    shares with all others that it may be near to is counted at once, on the full sets."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        key, i, j = own["key"].iloc[0], own["i"].iloc[0], own["j"].iloc[0]
        keys = np.stack(own["keys"].to_numpy())
        band = int((keys == key).all(0).argmax())
        ids, label, blk = own["id"].to_numpy(), own["at"].to_numpy(), own["blk"].to_numpy()
        sets = [np.asarray(h, np.int64) for h in own["hs"]]
        size = np.array([len(s) for s in sets])
        words, code = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)])
        flag = np.zeros(len(words), bool)
        at = {x: x for x in own["at"]}  # components, joined as links turn up

        def root(x):
            while at[x] != x:
                at[x] = x = at[at[x]]
            return x

        out = []
        for x in np.flatnonzero(blk == i):
            able = (blk == j) & (label != label[x])
            if i == j:
                able &= np.arange(len(own)) > x
            y = np.flatnonzero(able & (100 * np.minimum(size, size[x]) >= threshold * np.maximum(size, size[x])))
            y = y[~(keys[y, :band] == keys[x, :band]).any(1)]  # pairs are met in their first common bucket
            y = y[[root(label[k]) != root(label[x]) for k in y]] if len(y) else y
            if not len(y):
                continue
            mine = code[starts[x] : starts[x + 1]]
            flag[mine] = True
            shared, ends = gather(code, starts, y)
            both = np.diff(np.concatenate([[0], np.cumsum(flag[shared])])[np.concatenate([[0], ends])])
            flag[mine] = False
            for k in y[100 * both >= threshold * (size[x] + size[y] - both)]:
                a, b = root(label[x]), root(label[k])
                if a != b:
                    at[max(a, b)] = min(a, b)
                    out.append((min(ids[x], ids[k]), max(ids[x], ids[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The links among distinct pairs (a, b).

    First the 16-bit forms of the sets are compared: what they share, and what a set loses by its own
    collisions, bound the true intersection from above, so whatever falls short of the threshold there is no
    link for certain. The others are compared in full."""

    def side(name: str, column: str) -> DataFrame:
        return sets.select(F.col("id").alias(name), F.size("hs").cast("long").alias(f"n{name}"), F.col(column).alias(f"h{name}"))

    near = F.col("both") * 100 >= threshold * (F.col("na") + F.col("nb") - F.col("both"))
    lost = F.least(F.col("na") - F.size("ha"), F.col("nb") - F.size("hb"))
    first = pairs.join(side("a", "sk"), "a").join(side("b", "sk"), "b").where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    first = cut(first.withColumn("both", F.size(F.array_intersect("ha", "hb")).cast("long") + lost).select("a", "b", near.alias("able")))
    able = first.where("able").select("a", "b")
    ids = cut(able.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    needed = sets.join(narrow(ids, ids.count()), "id")
    full = able.join(needed.select(F.col("id").alias("a"), F.col("hs").alias("ha"), F.size("hs").cast("long").alias("na")), "a")
    full = full.join(needed.select(F.col("id").alias("b"), F.col("hs").alias("hb"), F.size("hs").cast("long").alias("nb")), "b")
    tested = cut(full.withColumn("both", F.size(F.array_intersect("ha", "hb")).cast("long")).select("a", "b", near.alias("link")))
    return tested.where("link").select("a", "b")


def link_components(sig: DataFrame, texts: DataFrame, threshold: int, width: int) -> DataFrame:
    """(id, component) of the class representatives that have a link. sig: (id, n, cls, keys), one row a class."""
    rows = sig.select("id", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = cut(rows.join(buckets, "key"))  # buckets with company only
    ids = cut(members.select("id").distinct().join(sig.select("id", "n", "cls", "keys"), "id"))
    n_ids = ids.count()
    comp = sig.sparkSession.createDataFrame([], "id long, component long")
    if not n_ids:
        return comp
    wanted = texts.join(narrow(ids.select(F.col("id").alias("doc_id"), "cls"), n_ids), "doc_id").select("doc_id", "text", "cls")
    sets = cut(wanted.mapInArrow(_sets(width), "id long, hs array<long>, sk array<short>"))
    centres = cut(_centres(members))
    pairs = members.join(centres, "key").where("id <> c").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
    links = _linked(pairs, sets, threshold)
    if not links.isEmpty():
        comp = _joined(comp, links)
    # a centre has met all members of its buckets; a bucket of one component has nothing left to find
    rest = members.select("key", "id").join(centres.withColumnRenamed("c", "id"), ["key", "id"], "left_anti").join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("at"))
    live = rest.groupBy("key").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo < hi").select("key")
    left = cut(rest.join(live, "key"))
    if left.isEmpty():
        return comp
    sized = left.join(ids.select("id", "n"), "id").groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    blocks = sized.select("key", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("n"))
    own = left.join(blocks, "key").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    own = own.select("key", F.least("blk", "x").alias("i"), F.greatest("blk", "x").alias("j"), "blk", "id", "at")
    full = sets.select("id", "hs").join(ids.select("id", "keys"), "id")
    met = own.join(full, "id").groupBy("key", "i", "j").applyInPandas(_meet(threshold), "a long, b long")
    links = cut(met)
    return comp if links.isEmpty() else _joined(comp, links)


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after more links: the links are contracted to components first."""
    a, b = comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), comp.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    lifted = cut(links.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")))
    found = components(lifted.select(F.col("x").alias("a"), F.col("y").alias("b")))
    known = comp.union(lifted.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("x").alias("component")), F.struct(F.col("b").alias("id"), F.col("y").alias("component")))).alias("s")).select("s.id", "s.component")).distinct()
    step = found.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return cut(known.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component")))


def near_duplicates(docs: DataFrame, threshold: int = 75, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), a row for each row of docs.

    threshold: per cent of Jaccard similarity from which documents are linked. component_id is the smallest
    doc_id reachable over links; kept marks that document. Null, empty and wordless texts have no shingles and
    link with nothing; a null doc_id is its own component (null) and is kept. Repeated rows are copies of each
    other; where a doc_id repeats with other texts, the one with the least digest stands for all of them.
    Empty tables give empty results.
    """
    texts = text_rows(docs)
    sig = cut(texts.mapInArrow(_sign(bands, rows, width), "doc_id long, n long, cls binary, keys array<long>"))
    own = sig.where("cls is not null and doc_id is not null").groupBy("doc_id").agg(F.min("cls").alias("cls"))
    own = cut(own)
    classes = cut(own.groupBy("cls").agg(F.min("doc_id").alias("rep")))
    placed = cut(own.join(classes, "cls").select("doc_id", "rep", "cls"))
    firsts = placed.where("doc_id = rep").select("doc_id", "cls")
    reps = sig.join(firsts, ["doc_id", "cls"]).select(F.col("doc_id").alias("id"), "n", "cls", "keys").dropDuplicates(["id"])
    comp = link_components(reps, texts, threshold, width).withColumnRenamed("id", "rep")
    label = placed.join(comp, "rep", "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc_id", "n").join(label, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
