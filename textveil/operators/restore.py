"""Placeholders back into values, however the reply spells them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import places
from ..functions.joins import meet
from ..functions.patterns import PLACEHOLDER, PLACEHOLDER_PARTS

#: Digits of a number that may be restored.
MAX_INDEX_DIGITS = 9


def tokens(text: Column, max_index_digits: int = MAX_INDEX_DIGITS) -> Column:
    """array<struct<s, e, v, entity_type, idx>> of all that is shaped like a placeholder."""
    parts = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.upper(F.regexp_extract(x["v"], PLACEHOLDER_PARTS, 1)).alias("entity_type"), F.regexp_extract(x["v"], PLACEHOLDER_PARTS, 2).try_cast("long").alias("idx"))
    return F.transform(places(text, PLACEHOLDER.format(digits=max_index_digits)), parts)


def originals(vault: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., _originals): a map from type and number to value and where it was first seen."""
    pair = F.struct(F.concat_ws(" ", "_type", F.col("idx").cast("string")).alias("k"), F.struct(F.col("f.original").alias("v"), F.col("f.first_seq").alias("seen")).alias("v"))
    return once(vault, scope).groupBy(*scope).agg(F.map_from_entries(F.collect_list(pair)).alias("_originals"))


def once(vault: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., _type, idx, f): one entry for each type in capitals and number. Placeholders are read without regard to case, so
    where types differ in case alone, the entry first seen (then the first by place, type and value) answers for both."""
    first = F.min(F.struct("first_seq", "first_start", "entity_type", "original"))
    return vault.groupBy(*scope, F.upper("entity_type").alias("_type"), "idx").agg(first.alias("f"))


def put_back(text: Column, found: Column, table: Column, seq: Column | None = None) -> Column:
    """One pass: a restored value is never looked at again; unknown tokens stay, and those of values first seen after seq."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, t):
        known = F.try_element_at(table, F.concat_ws(" ", t["entity_type"], t["idx"].cast("string")))
        value = F.coalesce(known["v"] if seq is None else F.when(F.coalesce(known["seen"] <= seq, F.lit(True)), known["v"]), t["v"])
        return F.struct(t["e"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, t["s"] - a["at"]), value).alias("out"))

    return F.aggregate(found, zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def restore(df: DataFrame, vault: DataFrame, scope: list[str], *, text: str = "text", into: str = "restored", seq: str | None = None, max_index_digits: int = MAX_INDEX_DIGITS) -> DataFrame:
    """df with ``into``: the text with every placeholder that its scope's vault knows replaced by the first spelling.
    seq: a column with the place (turn, chunk) that a row has in its scope; it is then restored with the vault as of there (a
    null place: with all of it). Null scopes are scopes of their own."""
    rows = meet(df, originals(vault, scope), scope, how="left")
    back = put_back(F.col(text), tokens(F.col(text), max_index_digits), F.col("_originals"), F.col(seq) if seq else None)
    return rows.withColumn(into, F.when(F.col("_originals").isNull(), F.col(text)).otherwise(back)).drop("_originals")


def restore_by_join(df: DataFrame, vault: DataFrame, key: str, *, text: str = "text", max_index_digits: int = MAX_INDEX_DIGITS) -> DataFrame:
    """(key, restored) with a vault of the whole corpus: distinct tokens meet the vault by a shuffle join, and
    each text's few hits go back to it as a map."""
    said = df.select(key, F.explode(F.array_distinct(F.transform(tokens(F.col(text), max_index_digits), lambda t: F.struct(t["entity_type"].alias("_t"), t["idx"].alias("_i"))))).alias("_k")).select(key, "_k.*")
    known = once(vault, []).select(F.col("_type").alias("_t"), F.col("idx").alias("_i"), F.col("f.original").alias("_v"))
    pair = F.struct(F.concat_ws(" ", "_t", F.col("_i").cast("string")).alias("k"), F.struct(F.col("_v").alias("v")).alias("v"))
    own = said.join(known, ["_t", "_i"]).groupBy(key).agg(F.map_from_entries(F.collect_list(pair)).alias("_originals"))
    rows = df.select(key, text).join(own, key, "left")
    back = put_back(F.col(text), tokens(F.col(text), max_index_digits), F.col("_originals"))
    return rows.select(key, F.when(F.col("_originals").isNull(), F.col(text)).otherwise(back).alias("restored"))


def unresolved(df: DataFrame, vault: DataFrame, scope: list[str], *, text: str = "text") -> DataFrame:
    """(scope..., token, entity_type, idx): placeholder-shaped tokens that the vault doesn't know, once each."""
    said = df.select(*scope, F.explode(tokens(F.col(text))).alias("t")).select(*scope, F.col("t.v").alias("token"), F.col("t.entity_type").alias("entity_type"), F.col("t.idx").alias("idx")).distinct()
    return meet(said, vault.select(*scope, F.upper("entity_type").alias("entity_type"), "idx"), scope, ["entity_type", "idx"], "left_anti").select(*scope, "token", "entity_type", "idx")


def verdict(original: Column, restored: Column, n_canonicalized: Column) -> Column:
    return F.when(restored == original, "identical").when(F.coalesce(n_canonicalized, F.lit(0)) > 0, "canonical").otherwise("failed")
