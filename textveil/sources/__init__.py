"""Reading texts and writing masked copies, vaults and audit rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_FORMATS = ("text", "parquet", "json", "csv", "orc")


def read_texts(spark: SparkSession, path: str, fmt: str = "text", *, id_column: str | None = None, text_column: str = "text", schema: str | None = None, **options) -> DataFrame:
    """(doc_id, text): whole files for ``text`` (the id is the path), else a table's id and text columns."""
    if fmt not in TEXT_FORMATS:
        raise ValueError(f"format must be one of {TEXT_FORMATS}, got {fmt!r}")
    if fmt == "text":
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    reader = spark.read.options(**options)
    df = (reader.schema(schema) if schema else reader).format(fmt).load(path)
    return df.select(F.col(id_column or "doc_id").alias("doc_id"), F.col(text_column).alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def masked_name(path: Column) -> Column:
    """``a/b.txt`` -> ``a/b.masked.txt``; a name without an ending gets ``.masked``."""
    return F.when(F.regexp_like(path, F.lit(r"[^/.][^/]*\.[^./]*$")), F.regexp_replace(path, r"(\.[^./]*)$", ".masked$1")).otherwise(F.concat(path, F.lit(".masked")))


def write_masked(released: DataFrame, path: str, *, overwrite: bool = False, fmt: str = "parquet") -> None:
    """Refuses a destination that exists unless told to overwrite. Takes only columns that hold no private value."""
    private = {"text", "spans", "approved", "declined", "sealed", "leaks", "entries"} & set(released.columns)
    released.drop(*private).write.mode("overwrite" if overwrite else "errorifexists").format(fmt).save(path)


def write_vault(vault: DataFrame, variants: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """The mapping goes to a place of its own, to be kept under other access rules than the masked texts."""
    mode = "overwrite" if overwrite else "errorifexists"
    vault.write.mode(mode).parquet(f"{path}/vault")
    variants.write.mode(mode).parquet(f"{path}/variants")


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def refuse_existing(spark: SparkSession, *paths: str) -> None:
    """An error before any work is done, where a destination exists."""
    for path in paths:
        fs, where = _hadoop(spark, path)
        if fs.exists(where):
            raise FileExistsError(f"{path} exists: pass overwrite=True to replace it")


def publish(spark: SparkSession, tables: dict[str, DataFrame], *, overwrite: bool = False, fmt: str = "parquet", before: Callable[[], None] | None = None) -> None:
    """Writes all tables or none: each beside its place first, then, when all are written, moved there. Refuses destinations that
    exist unless told to overwrite, and leaves nothing behind where it fails. before: runs between writing and moving."""
    if not overwrite:
        refuse_existing(spark, *tables)
    staged = {path: f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}" for path in tables}
    try:
        for path, df in tables.items():
            df.write.format(fmt).save(staged[path])
        if before:
            before()
        for path, stage in staged.items():
            fs, where = _hadoop(spark, path)
            if overwrite:
                fs.delete(where, True)
            fs.mkdirs(where.getParent())
            if not fs.rename(_hadoop(spark, stage)[1], where):
                raise OSError(f"could not move the written table to {path}")
    finally:
        for stage in staged.values():
            fs, where = _hadoop(spark, stage)
            fs.delete(where, True)


def append_audit(events: DataFrame, path: str) -> None:
    """Append-only; public and sensitive rows lie in folders of their own, by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("sensitive", "day").parquet(path)


def stream_turns(spark: SparkSession, path: str, schema: str = "conv_id long, turn int, text string") -> DataFrame:
    """Turns that arrive as files."""
    return spark.readStream.schema(schema).parquet(path)
