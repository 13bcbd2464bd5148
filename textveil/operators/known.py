"""Detection of values that are known beforehand, from a table of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SPANS, let, literal_pattern, no_spans, span
from ..functions.lineage import cut, wide
from .search import candidates

#: The score of a known value.
SCORE = 0.9


def places_of(text: Column, value: Column, entity_type: Column, score: float, ignore_case: bool) -> Column:
    """The spans of one value in a text, left to right, without overlap, in code points."""
    zero = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def located(gaps: Column, hits: Column) -> Column:
        def step(a, x):
            s = (a["at"] + F.length(x["gap"])).cast("int")
            e = (s + F.length(x["hit"])).cast("int")
            return F.struct(e.alias("at"), F.concat(a["out"], F.array(span(entity_type, s, e, score, x["hit"]))).alias("out"))

        both = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(both, zero, step, lambda a: a["out"])

    pattern = literal_pattern(value, ignore_case)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(F.struct(F.split(text, pattern, -1).alias("g"), hits.alias("h")), lambda x: located(x["g"], x["h"]))


def find(df: DataFrame, values: DataFrame, *, text: str = "text", into: str = "known", score: float = SCORE, ignore_case: bool = False) -> DataFrame:
    """df with ``into``: the spans of all values of a table (entity_type, value) in each text, at this score.

    A value is found wherever it stands, not inside a longer word at an edge that is a letter or digit; overlaps are left to
    resolve, which prefers the longer one. No list stands in the plan: texts and values meet by a shuffle join on the
    values' rarest words. Null and blank values are nowhere; a value listed under several types is found under each; a
    null text has no spans; rows that repeat are rows of their own."""
    listed = values.select(F.col("entity_type").cast("string").alias("entity_type"), F.col("value").cast("string").alias("variant")).where("entity_type is not null").distinct()
    rows = cut(df.withColumn("_known_row", F.monotonically_increasing_id()))  # the numbers are fixed, and what made the texts runs once
    texts = rows.select("_known_row", F.col(text).alias("_text"))
    met = texts.join(wide(candidates(texts, listed, "_known_row", "_text")), "_known_row")
    held = F.filter("variants", lambda v: F.regexp_like("_text", literal_pattern(v, ignore_case)))
    typed = met.select("_known_row", F.explode(held).alias("variant")).join(wide(listed), "variant")
    own = typed.groupBy("_known_row").agg(F.array_sort(F.collect_list(F.struct("variant", "entity_type"))).alias("_values"))
    spans = F.flatten(F.transform("_values", lambda v: places_of(F.col(text), v["variant"], v["entity_type"], score, ignore_case)))
    return rows.join(wide(own), "_known_row", "left").withColumn(into, F.coalesce(spans, no_spans()).cast(SPANS)).drop("_known_row", "_values")
