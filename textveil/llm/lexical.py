"""Ranked lexical search, reversed: the items to search for are indexed, and the documents stream by.

Method. The terms of the items form an inverted index (term -> items), which is broadcast. Each task streams its documents'
term counts through it: what a term of a document is worth is added to every item that holds the term, and a document that
beats the least of an item's bounded heap takes its place. The tasks' heaps are merged in two rounds.

Two passes over a compact table, not over texts: texts are cut into terms once, and what remains of a document is its
number of terms and the counts of those terms that occur in an item, written to the shared folder. From that table come N, L
and the terms' document frequencies, and then the scores. All arithmetic is that of 64-bit integers: scores are summed in
doubles only, which is exact, as a sum of an item's terms stays below 2^53 (checked against the index).

The index is broadcast in parts of about INDEX_POSTINGS postings, whose sizes are counted first; where the items need more
parts, the documents are read once for each part.

Edge cases. Items are the distinct rows (item_id, text); a null item_id is an item, and an item without terms has no rows in
the result. A null text has no terms. Documents without any term of an item get no score. Repeated documents each take
a rank; a null doc_id comes last in ties. Texts of any length are read whole, in slices. Without documents or items the result
is empty. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shared_folder, slices, text_rows

TOP = 10
#: Postings (pairs of term and item) that one broadcast holds, some 100 bytes each; an item of more than that has a part of its own.
INDEX_POSTINGS = 500_000
#: Bytes of a text that are cut into terms at a time, cells of the table of scores, and groups of tasks whose heaps are merged first.
SLICE, CELLS, MERGES = 1_000_000, 1_000_000, 64
#: Only A-Z are lower-cased; whatever else is ASCII and neither letter nor digit parts terms.
TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
COMPACT = "doc_id long, n long, terms array<int>, counts array<long>"
HEAP = "part int, item int, doc_id long, score long"


def term_counts(text: str | None) -> Counter:
    """How often each term stands in the text."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(TERM)
    found, at = Counter(), 0
    while at < len(raw):
        stop = raw.find(b" ", at + SLICE)
        stop = len(raw) if stop < 0 else stop
        found.update(raw[at:stop].split())
        at = stop
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(batches):
    for batch in batches:
        for at, texts in slices(batch.column(1)):
            own = [sorted(term_counts(t)) for t in texts]
            rows = np.repeat(np.arange(at, at + len(texts)), [len(x) for x in own])
            flat = [t.decode("utf-8", "surrogatepass") for x in own for t in x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(flat, pa.string())], ["item", "term"])


def _compact(spread):
    """Documents as (doc_id, n, numbers of the terms that an item holds, their counts)."""

    def run(batches):
        number = spread.value["terms"]
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                sizes, terms, counts, ends = [], [], [], [0]
                for t in texts:
                    found = term_counts(t)
                    sizes.append(found.total())
                    known = found.keys() & number.keys()
                    terms.extend(map(number.__getitem__, known))
                    counts.extend(map(found.__getitem__, known))
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return run


class Heaps:
    """The best documents of each item, as bounded heaps; least first, so that the root is what a newcomer has to beat."""

    def __init__(self, n_items: int, top: int):
        self.top, self.heaps, self.least = top, [[] for _ in range(n_items)], np.zeros(n_items)

    def update(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """scores: a row for each document, a column for each item."""
        for i in range(len(ids)):
            for item in np.flatnonzero((scores[i] > 0) & (scores[i] >= self.least)):
                heap, doc = self.heaps[item], ids[i]
                entry = (int(scores[i, item]), doc is not None, -(doc or 0))
                if len(heap) < self.top:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
                if len(heap) == self.top:
                    self.least[item] = heap[0][0]

    def rows(self) -> tuple[list, list, list]:
        flat = [(item, -low if named else None, score) for item, heap in enumerate(self.heaps) for score, named, low in heap]
        return tuple(map(list, zip(*flat))) if flat else ([], [], [])


def worth(weights: np.ndarray, counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's counts add to the score of a document of length norm m."""
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


def _stream(spread, n_docs: int, n_terms: int, top: int):
    """Streams (doc_id, n, terms, counts) through the index; gives the task's heaps."""

    def run(batches):
        from pyspark import TaskContext

        weights, starts, items, n_items = (spread.value[k] for k in ("weights", "starts", "items", "n_items"))
        heaps, most = Heaps(n_items, top), max(1, CELLS // max(1, n_items))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                some = batch.slice(at, most)
                ids, sizes = some.column(0).to_pylist(), some.column(1).to_pylist()
                lists, counts = some.column(2), some.column(3).flatten().to_numpy(zero_copy_only=False)
                terms = lists.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
                m = np.array([10 + 90 * n * n_docs // n_terms for n in sizes], np.int64)
                add = worth(weights[terms], counts, m[doc]).astype(np.float64)
                fan = starts[terms + 1] - starts[terms]
                at_item = np.repeat(starts[terms] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())
                cell = np.repeat(doc, fan) * n_items + items[at_item]
                heaps.update(np.bincount(cell, np.repeat(add, fan), len(ids) * n_items).reshape(len(ids), n_items), ids)
        item, doc, score = heaps.rows()
        if item:
            part = np.full(len(item), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["part", "item", "doc_id", "score"])

    return run


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _parts(postings: DataFrame, bound: int) -> DataFrame:
    """postings (item, item_id, term) with ``block``: items dealt so that a block holds about ``bound`` postings. Blocks are
    counted, and made smaller until none holds more than twice that, or each item has its own."""
    sizes = cut(postings.groupBy("item").agg(F.count(F.lit(1)).alias("size")))
    total, n_items = sizes.agg(F.sum("size"), F.count(F.lit(1))).first()
    n = -(-(total or 0) // bound) or 1
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(n)) if n < (n_items or 1) else F.col("item")
        if n == 1 or n >= n_items or sizes.groupBy(block.alias("b")).agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] <= 2 * bound:
            return postings.withColumn("block", block if n > 1 else F.lit(0).cast("long"))
        n *= 2


def search(docs: DataFrame, items: DataFrame, top: int = TOP, postings: int = INDEX_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``top`` documents of highest score above 0, ties to the smaller doc_id.

    items: (item_id, text); docs: (doc_id, text)."""
    spark = docs.sparkSession
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    listed = cut(listed.withColumn("item", F.monotonically_increasing_id()))
    said = cut(listed.select("item", "text").mapInArrow(_item_terms, "item long, term string"))
    index = cut(_parts(said.join(listed.select("item", "item_id"), "item"), postings))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for row in index.select("block").distinct().sort("block").toLocalIterator():
        out = out.union(_search_part(docs, index.where(F.col("block") == row["block"]), top))
    return out


def _search_part(docs: DataFrame, index: DataFrame, top: int) -> DataFrame:
    """One part of the items, whose postings (counted in _parts) come to the driver and go out as broadcasts."""
    spark = docs.sparkSession
    rows = index.select("item", "item_id", "term").sort("item", "term").collect()
    number, place, names = {}, {}, []
    for r in rows:
        number.setdefault(r["term"], len(number))
        if r["item"] not in place:
            place[r["item"]] = len(names)
            names.append(r["item_id"])
    terms = np.array([number[r["term"]] for r in rows], np.int64)
    item = np.array([place[r["item"]] for r in rows], np.int64)
    order = np.argsort(terms, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(number)))])
    first = spark.sparkContext.broadcast({"terms": {t.encode("utf-8", "surrogatepass"): k for t, k in number.items()}})
    folder = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    text_rows(docs).mapInArrow(_compact(first), COMPACT).write.parquet(folder)
    compact = spark.read.schema(COMPACT).parquet(folder)
    n_docs, n_terms = compact.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(map(tuple, compact.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect()))  # as many as the part has terms
    weights = np.array([weight(n_docs, df.get(k, 0)) for k in range(len(number))], np.int64)
    longest = int(np.bincount(item).max(initial=0))
    if longest * int(weights.max(initial=0)) * 1_000_000 >= 1 << 53:
        raise ValueError(f"an item of {longest} terms could have a score beyond 2^53")
    second = spark.sparkContext.broadcast({"weights": weights, "starts": starts, "items": item[order], "n_items": len(names)})
    heaps = compact.where(F.size("terms") > 0).mapInArrow(_stream(second, n_docs, n_terms, top), HEAP)
    merged = _best(_best(heaps.withColumn("group", F.pmod("part", F.lit(MERGES))), ["item", "group"], top), ["item"], top)
    told = spark.createDataFrame([(k, name) for k, name in enumerate(names)], "item int, item_id long")
    return merged.join(F.broadcast(told), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")  # a row for each item of the part
