"""Counts and reports that hold no private value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import match_key
from ..functions.joins import meet


def entity_counts(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans per type (and keys)."""
    return spans.groupBy(*keys, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def totals(spans: DataFrame, key: str) -> DataFrame:
    """Lines and totals in one job: per document and type, per document, and in all (nulls mark totals)."""
    return spans.rollup(key, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def distinct_values(spans: DataFrame, match: str = "normalized") -> DataFrame:
    return spans.groupBy("entity_type").agg(F.count_distinct(match_key(F.col("value"), match)).alias("n_values"))


#: Size of a sketch, 2^k registers of 8 bits at most: a standard error of 0.8 per cent.
SKETCH_BITS = 14


def value_sketches(spans: DataFrame, *keys: str, match: str = "normalized") -> DataFrame:
    """(keys..., entity_type, sketch): a sketch of the distinct values of each type, to be kept with a run and merged with other runs'. It
    holds hashes' leading zeros, not values. Null values don't count."""
    return spans.groupBy(*keys, "entity_type").agg(F.hll_sketch_agg(match_key(F.col("value"), match), SKETCH_BITS).alias("sketch"))


def sketched_values(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys..., entity_type, n_runs, n_values): about how many distinct values the runs behind the sketches saw together."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*keys, "entity_type").agg(F.count(F.lit(1)).alias("n_runs"), merged.alias("n_values"))


def types_found(spans: DataFrame, *keys: str) -> DataFrame:
    return spans.groupBy(*keys).agg(F.array_sort(F.collect_set("entity_type")).alias("types"))


def vault_sizes(vault: DataFrame, scope: list[str]) -> DataFrame:
    return vault.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_values"), F.array_sort(F.collect_list("placeholder")).alias("placeholders"))


def safe_detections(spans: DataFrame, vault: DataFrame, scope: list[str], match: str = "normalized") -> DataFrame:
    """Type, score and placeholder of each span, without its value."""
    side = vault.select(*scope, "entity_type", "match_key", "placeholder")
    return meet(spans.withColumn("match_key", match_key(F.col("value"), match)), side, scope, ["entity_type", "match_key"]).select(*scope, "entity_type", "score", "placeholder")


def left_in_clear(with_money: DataFrame, masked: DataFrame, *keys: str) -> DataFrame:
    """Types that are found with amounts switched on but were not masked."""
    return with_money.select(*keys, "entity_type").distinct().exceptAll(masked.select(*keys, "entity_type").distinct())


def types_in_order(spans: DataFrame) -> DataFrame:
    """Spans per type, in the order of the types' names."""
    return entity_counts(spans).orderBy("entity_type")


def sealed_and_declined(masked: DataFrame, *keys: str) -> DataFrame:
    """Per keys (or in all): how many spellings the sweep masked, and how many spans were left in the clear by decision.
    masked: (keys..., sealed, declined), as masking gives them."""
    count = lambda c: F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0))), F.lit(0)).cast("long")
    return masked.groupBy(*keys).agg(count("sealed").alias("n_sealed"), count("declined").alias("n_declined"))


def left_by_decision(masked: DataFrame, *keys: str) -> DataFrame:
    """(keys..., entity_type, value) of the declined spans: for the local report alone, as the values are in the clear."""
    return masked.select(*keys, F.explode("declined").alias("s")).select(*keys, "s.entity_type", "s.value")


def seen_again(mentions: DataFrame, known: DataFrame, scope: list[str], match: str = "normalized") -> DataFrame:
    """The mentions of values that an earlier vault holds."""
    keys = [*scope, "entity_type", "match_key"]
    return meet(mentions.withColumn("match_key", match_key(F.col("value"), match)), known.select(*keys), scope, ["entity_type", "match_key"], "left_semi")


def processed(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(text)).cast("long").alias("n_chars"))
