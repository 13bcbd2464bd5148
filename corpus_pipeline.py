"""A training-data pipeline over ``documents``: toxicity, quality, near-duplicates, secrets, packing.

Each stage takes what the one before kept, written as Parquet and read again. The first four return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import minhash, packing, quality, secrets, toxicity
from textveil.llm.common import BROADCAST_IDS, cut, shared_folder

#: Words that a worker remembers while it packs: fewer than by default, as executors come here with what earlier stages left.
PACKING_WORDS = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores as toxic go (0.7 and more). Labels of the training share alone are read.

    Null and empty texts stay here, repeated rows are judged row by row, an empty table gives an empty one."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_civil(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go, those of hosts that fail as a whole, and those that fail the stricter limit of a rule that their
    host breaks more often than the corpus.

    Null and empty texts have no words and so go; repeated rows are judged, and count for their host, row by row."""
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; a repeated row (doc_id and text) counts once.

    Every text of a repeated doc_id is judged by itself. Rows with a null doc_id all stay."""
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = cut(minhash.near_duplicates(docs).select("doc_id", "kept"))
        return _without(docs, found.where("not kept").select("doc_id"), "doc_id")
    marked = named.withColumn("_digest", F.coalesce(F.sha2("text", 256), F.lit("")))
    once = marked.dropDuplicates(["doc_id", "_digest"]).repartitionByRange("doc_id", "_digest").sortWithinPartitions("doc_id", "_digest")
    # numbers in the order of doc_id stand for the rows; checkpointed, as a range partitioning computed anew may draw other bounds
    rows = cut(once.withColumn("_row", F.monotonically_increasing_id()))
    found = cut(minhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "kept"))
    kept = _without(rows, found.where("not kept").select("_row"), "_row").select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, key, "left_anti").select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret gives way to a mark of its kind; all documents stay, with n_chars counted anew."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 tokens, packed into sequences.

    A null text counts as empty, which is one piece (its end mark); repeated rows are packed each; an empty table gives no sequence."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), memory=PACKING_WORDS))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("MinHash near-dedup", drop_copies),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]

#: Tokenization, MinHash and the learned score have no SQL form; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; between them the documents go through Parquet in the shared folder."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
