"""The vault: one numbered placeholder for each distinct private value of a scope.

Mentions: (scope..., seq, start, entity_type, value). Vault rows: (scope..., entity_type, match_key, idx, placeholder,
original, fingerprint, first_seq, first_start). Variants: (scope..., entity_type, idx, variant, variant_no, first_seq).
An empty scope is the whole table: seq then has to order all of it (a struct of document and chunk will do). A null in a scope
column is a scope like any other; a null seq comes before all others, and what is first seen there is visible everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bare, fingerprint, match_key, placeholder
from ..functions.joins import meet
from ..functions.lineage import cut
from .search import opens, standing_words, words_of

SECRET = "not a secret: pass your own"


def first_mentions(mentions: DataFrame, scope: list[str], match: str) -> DataFrame:
    """One row a distinct value: where and how it was first written. Partial aggregation before the shuffle."""
    keyed = mentions.withColumn("match_key", match_key(F.col("value"), match))
    first = F.min(F.struct(F.col("seq"), F.col("start"), F.col("value")))
    return keyed.groupBy(*scope, "entity_type", "match_key").agg(first.alias("f")).select(*scope, "entity_type", "match_key", F.col("f.seq").alias("first_seq"), F.col("f.start").alias("first_start"), F.col("f.value").alias("original"))


def numbered(firsts: DataFrame, scope: list[str]) -> DataFrame:
    """``idx`` from 1 in order of first mention, per scope and type.

    With a scope, one window per scope. For the whole corpus, a window over each type would put a type into one
    task; there rows are range-partitioned by type and place, numbered within partitions, and lifted by the counts
    of the partitions before (a table of partitions x types)."""
    order = ["first_seq", "first_start", "match_key"]
    if scope:
        return firsts.withColumn("idx", F.row_number().over(W.partitionBy(*scope, "entity_type").orderBy(*order)).cast("long"))
    # checkpointed, as a recomputed range partitioning may draw other bounds
    ranged = cut(firsts.repartitionByRange("entity_type", *order).withColumn("part", F.spark_partition_id()))
    local = ranged.withColumn("k", F.row_number().over(W.partitionBy("part", "entity_type").orderBy(*order)))
    counts = ranged.groupBy("part", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("entity_type").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    lifted = local.join(F.broadcast(before.drop("n")), ["part", "entity_type"])  # partitions x types rows
    return lifted.withColumn("idx", (F.col("k") + F.col("before")).cast("long")).drop("part", "k", "before")


def mint(mentions: DataFrame, scope: list[str], *, match: str = "normalized", secret: str = SECRET, known: DataFrame | None = None) -> DataFrame:
    """The vault of these mentions. With ``known`` (an earlier vault), its rows stay and new values are numbered on."""
    firsts = first_mentions(mentions, scope, match)
    keys = [*scope, "entity_type", "match_key"]
    if known is not None:
        firsts = meet(firsts, known.select(*keys), scope, ["entity_type", "match_key"], "left_anti")
    out = numbered(firsts, scope)
    if known is not None:
        top = known.groupBy(*scope, "entity_type").agg(F.max("idx").alias("top"))
        out = meet(out, top, scope, ["entity_type"], "left").withColumn("idx", F.col("idx") + F.coalesce("top", F.lit(0))).drop("top")
    out = out.withColumn("placeholder", placeholder(F.col("entity_type"), F.col("idx"))).withColumn("fingerprint", fingerprint(F.col("entity_type"), F.col("original"), secret))
    columns = [*keys, "idx", "placeholder", "original", "fingerprint", "first_seq", "first_start"]
    return out.select(*columns) if known is None else known.select(*columns).unionByName(out.select(*columns))


def variants(mentions: DataFrame, vault: DataFrame, scope: list[str], match: str = "normalized", known: DataFrame | None = None) -> DataFrame:
    """Every distinct spelling of each entry, in order of first sight. With ``known`` (an earlier run's), its rows stay and new
    spellings are numbered on."""
    keys = [*scope, "entity_type", "match_key"]
    seen = mentions.withColumn("match_key", match_key(F.col("value"), match)).groupBy(*keys, F.col("value").alias("variant")).agg(F.min(F.struct("seq", "start")).alias("f"))
    named = meet(seen, vault.select(*keys, "idx"), scope, ["entity_type", "match_key"])
    ids = [*scope, "entity_type", "idx"]
    if known is not None:
        named = meet(named, known.select(*ids, "variant"), scope, ["entity_type", "idx", "variant"], "left_anti")
    order = W.partitionBy(*ids).orderBy("f.seq", "f.start", "variant")
    out = named.withColumn("variant_no", F.row_number().over(order)).select(*ids, "variant", "variant_no", F.col("f.seq").alias("first_seq"))
    if known is None:
        return out
    top = known.groupBy(*ids).agg(F.max("variant_no").alias("top"))
    out = meet(out, top, scope, ["entity_type", "idx"], "left").withColumn("variant_no", F.col("variant_no") + F.coalesce("top", F.lit(0))).drop("top")
    return known.select(*out.columns).unionByName(out)


def canonicalized(forms: DataFrame, vault: DataFrame, scope: list[str]) -> DataFrame:
    """Entries that saw more than one spelling: placeholder, spellings in order, the one restored."""
    keys = [*scope, "entity_type", "idx"]
    many = forms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("variant_no", "variant"))).alias("v")).where(F.size("v") > 1)
    spellings = F.transform("v", lambda x: x["variant"])
    return meet(many, vault.select(*keys, "placeholder"), scope, ["entity_type", "idx"]).select(*scope, "placeholder", spellings.alias("spellings"), F.get(spellings, F.lit(0)).alias("restored_as"))


def in_order(vault: DataFrame, scope: list[str]) -> DataFrame:
    """All entries in the order in which they were minted, with ``n_entries`` of their scope."""
    sizes = vault.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_entries"))
    rows = meet(vault, sizes, scope) if scope else vault.withColumn("n_entries", F.lit(vault.count()))
    return rows.orderBy(*scope, "first_seq", "first_start", "entity_type", "idx")


def lookup(tokens: DataFrame, vault: DataFrame, scope: list[str], token: str = "token") -> DataFrame:
    """tokens with the vault row of each, found with or without angle brackets (null columns where there is none)."""
    side = vault.withColumn("_bare", bare(F.col("placeholder"))).select(*scope, "_bare", "entity_type", "idx", "original", "fingerprint")
    return meet(tokens.withColumn("_bare", bare(F.col(token))), side, scope, ["_bare"], "left").drop("_bare")


def cross_run_links(left: DataFrame, right: DataFrame) -> DataFrame:
    """Values that two runs with the same secret share, by fingerprint alone."""
    return left.select("fingerprint", F.col("placeholder").alias("left_placeholder")).join(right.select("fingerprint", F.col("placeholder").alias("right_placeholder")), "fingerprint")


def carried(vault: DataFrame, mentions: DataFrame, scope: list[str], match: str = "normalized") -> DataFrame:
    """The vault with ``in_this_input``: whether the entry's value is among these mentions or only carried over."""
    keys = [*scope, "entity_type", "match_key"]
    here = mentions.select(*scope, "entity_type", match_key(F.col("value"), match).alias("match_key")).distinct().withColumn("_here", F.lit(True))
    return meet(vault, here, scope, ["entity_type", "match_key"], "left").withColumn("in_this_input", F.coalesce("_here", F.lit(False))).drop("_here")


def entries(vault: DataFrame, scope: list[str], forms: DataFrame) -> DataFrame:
    """(scope..., entries): each scope's placeholders with all spellings, in minting order, as the sweep needs them.

    What the sweep has to know of a spelling is worked out here, once a scope and not once a text: ``word``, the longest word that
    stands by itself wherever the spelling is met (empty where there is none, or where a placeholder of the scope holds it), and
    ``opens``, whether a match of it may part a word in two."""
    keys = [*scope, "entity_type", "idx"]
    longest = F.array_max(F.transform(standing_words(F.col("variant")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    form = F.struct("variant_no", "variant", "first_seq", F.coalesce(longest, F.lit("")).alias("word"), F.coalesce(opens(F.col("variant")), F.lit(True)).alias("opens"))
    spelled = forms.groupBy(*keys).agg(F.array_sort(F.collect_list(form)).alias("v"))
    row = F.struct("first_seq", "first_start", "entity_type", "idx", "placeholder", F.transform("v", lambda x: F.struct(x["variant"].alias("variant"), x["first_seq"].alias("seen"), x["word"].alias("word"), x["opens"].alias("opens"))).alias("forms"))
    known = meet(vault, spelled, scope, ["entity_type", "idx"]).groupBy(*scope).agg(F.array_sort(F.collect_list(row)).alias("entries"))
    words = F.flatten(F.transform("entries", lambda e: F.transform(e["forms"], lambda f: f["word"])))
    placed = F.array_intersect(words, F.flatten(F.transform("entries", lambda e: words_of(e["placeholder"]))))
    own = lambda f: f.withField("word", F.when(F.array_contains("_placed", f["word"]), "").otherwise(f["word"]))
    marked = F.transform("entries", lambda e: e.withField("forms", F.transform(e["forms"], own)))
    return known.withColumn("_placed", placed).withColumn("entries", F.when(F.size("_placed") > 0, marked).otherwise(F.col("entries"))).drop("_placed")


def spellings(vault: DataFrame, forms: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., f): what ``entries`` has of each spelling as a row of its own, for scopes whose vault doesn't fit a row. f sorts in
    minting order, then spelling order."""
    longest = F.array_max(F.transform(standing_words(F.col("variant")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    rows = meet(forms.withColumnRenamed("first_seq", "seen"), vault.select(*scope, "entity_type", "idx", "placeholder", "first_seq", "first_start"), scope, ["entity_type", "idx"])
    rows = rows.withColumn("_word", F.coalesce(longest, F.lit("")))
    placed = vault.select(*scope, F.explode(words_of(F.col("placeholder"))).alias("_word")).distinct().withColumn("_placed", F.lit(True))
    rows = meet(rows, placed, scope, ["_word"], "left")
    word = F.when(F.col("_placed"), "").otherwise(F.col("_word")).alias("word")
    f = F.struct("first_seq", "first_start", "entity_type", "idx", "variant_no", "variant", "seen", "placeholder", word, F.coalesce(opens(F.col("variant")), F.lit(True)).alias("opens"))
    return rows.select(*scope, f.alias("f"))


def is_visible(entry: Column, seq: Column | None) -> Column:
    return F.lit(True) if seq is None else F.coalesce(entry["first_seq"] <= seq, F.lit(True))
