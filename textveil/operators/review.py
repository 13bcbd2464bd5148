"""Recorded decisions about uncertain detections. Silence masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SPANS
from ..functions.lineage import cut, wide

CONFIRM_BELOW = 0.5


def value_key(value: Column) -> Column:
    """Case ignored, blanks kept."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def masks(answer: Column) -> Column:
    """Only ``n`` and ``no`` decline; any other answer, and none, masks."""
    return ~F.coalesce(F.lower(F.trim(answer)).isin("n", "no"), F.lit(False))


def declined_values(decisions: DataFrame) -> DataFrame:
    """(entity_type, value_key) that may stay in the clear; if any answer for a value masks, it doesn't."""
    rows = decisions.select("entity_type", value_key(F.col("value_key")).alias("value_key"), masks(F.col("answer")).alias("mask"))
    return rows.groupBy("entity_type", "value_key").agg(F.bool_or("mask").alias("mask")).where("not mask").select("entity_type", "value_key")


def decide(df: DataFrame, decisions: DataFrame | None, *, spans: str = "spans", confirm_below: float = CONFIRM_BELOW) -> DataFrame:
    """df with ``approved`` and ``declined`` spans. Spans at or above confirm_below need no decision.

    Rows with uncertain spans alone meet the decisions: their spans are exploded with the row's number, joined and
    put back; without decisions nothing is joined."""
    none = F.lit([]).cast(SPANS)
    if decisions is None:
        return df.withColumn("approved", F.col(spans)).withColumn("declined", none)
    keys = F.array_distinct(F.transform(F.filter(spans, lambda s: s["score"] < confirm_below), lambda s: F.struct(s["entity_type"].alias("entity_type"), value_key(s["value"]).alias("value_key"))))
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))  # detection runs once, and the numbers are fixed
    met = rows.select("_row", F.explode(keys).alias("k")).select("_row", "k.*").join(wide(declined_values(decisions)), ["entity_type", "value_key"], "left_semi")
    own = met.groupBy("_row").agg(F.collect_set(F.concat_ws("\u0001", "entity_type", "value_key")).alias("_no"))
    joined = rows.join(wide(own), "_row", "left").withColumn("_no", F.coalesce("_no", F.lit([]).cast("array<string>")))
    out = lambda s: (s["score"] < confirm_below) & F.array_contains("_no", F.concat_ws("\u0001", s["entity_type"], value_key(s["value"])))
    return joined.withColumn("approved", F.filter(spans, lambda s: ~out(s))).withColumn("declined", F.filter(spans, out)).drop("_row", "_no")


def queue(spans: DataFrame, decisions: DataFrame | None = None, confirm_below: float = CONFIRM_BELOW) -> DataFrame:
    """spans (entity_type, score, value, ...) -> uncertain values without a decision, once each: entity_type, value_key,
    n, max_score, sample."""
    rows = spans.where(F.col("score") < confirm_below).withColumn("value_key", value_key(F.col("value")))
    if decisions is not None:
        rows = rows.join(wide(decisions.select("entity_type", value_key(F.col("value_key")).alias("value_key")).distinct()), ["entity_type", "value_key"], "left_anti")
    return rows.groupBy("entity_type", "value_key").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"), F.min("value").alias("sample"))
