"""Texts against long lists of values, without a cross join: candidates meet on words, then patterns decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fold, literal_pattern
from ..functions.lineage import cut, wide

#: A character that is neither white space nor a plain letter or digit.
SIGN = r"(?U)([^\s\p{L}\p{Nd}])"
#: Texts from which a word counts as common: values that have no rarer one are keyed by two adjacent words.
COMMON = 1000
#: Candidates that one share of a key's texts may make, words that may be broadcast (their characters are counted first), texts from
#: which a word's texts are dealt to so many shares.
SHARE, BROADCAST_CHARS, HOT, SALTS = 500_000, 10_000_000, 100_000, 32


def _open_edge(value: Column, at: int) -> Column:
    return F.regexp_like(F.substring(value, at, 1), F.lit(r"(?U)^[\w&&[^\p{L}\p{N}]]$"))


def opens(value: Column) -> Column:
    """Whether a match of the value's pattern may begin or end inside a word: an edge is a word character at which the pattern demands no
    word's edge."""
    return _open_edge(value, 1) | _open_edge(value, -1)


def standing_words(value: Column) -> Column:
    """array<string>: words that stand by themselves, and next to each other, in every text in which the value's pattern matches. That
    is so for a run of word characters between others, and at an edge of the value if the pattern demands a word's edge there."""
    left, right = _open_edge(value, 1).cast("int"), _open_edge(value, -1).cast("int")
    runs = F.split(fold(value), r"(?U)\W+")
    return F.filter(F.slice(runs, left + 1, F.greatest(F.lit(0), F.size(runs) - left - right)), lambda w: w != "")


def word_keys(value: Column) -> Column:
    """array<string>: the standing words. A value without one has one key of another kind, its first character that is no plain
    letter or digit."""
    inner, mark = standing_words(value), F.regexp_extract(value, SIGN, 1)
    return F.when(F.size(inner) > 0, F.array_distinct(inner)).when(mark != "", F.array(F.concat(F.lit("\u0001"), fold(mark)))).otherwise(F.lit([]).cast("array<string>"))


def pairs_of(words: Column) -> Column:
    """array<string>: each two adjacent words as one key."""
    both = F.zip_with(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1)), lambda a, b: F.concat(a, F.lit("\u0002"), b))
    return F.when(F.size(words) > 1, F.array_distinct(both)).otherwise(F.lit([]).cast("array<string>"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(fold(text), r"(?U)\W+"), lambda w: w != "")


def text_keys(text: Column) -> Column:
    """All that word_keys may give for a value in this text."""
    marks = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(SIGN), F.lit(1))), lambda c: F.concat(F.lit("\u0001"), fold(c)))
    return F.array_union(words_of(text), marks)


def _spoken(said: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """The rows of said (key, _w) whose word is in the vocabulary. A common word's rows never lie in one task: the vocabulary is
    broadcast if its characters are few; else a word of more than HOT rows has them dealt to SALTS shares, and it alone is repeated."""
    chars = vocabulary.agg(F.coalesce(F.sum(F.length("_w") + 16), F.lit(0))).first()[0]
    if chars <= BROADCAST_CHARS:
        return said.join(F.broadcast(vocabulary), "_w", "left_semi")
    hot = F.broadcast(cut(said.groupBy("_w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("_w", F.lit(SALTS).alias("_n"))))  # a row for each HOT words said at most
    shares = lambda df: df.join(hot, "_w", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    dealt = shares(said).withColumn("_salt", F.pmod(F.xxhash64(key), F.col("_n")).cast("int")).drop("_n")
    lists = shares(vocabulary).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return dealt.join(wide(lists), ["_w", "_salt"], "left_semi").drop("_salt")


def _met(said: DataFrame, keyed: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(key, variant) of said (key, _w) and keyed (variant, _w). A word whose texts and values would make more candidates than a
    share holds has its texts dealt to as many shares as that asks for, and its values given to each."""
    sizes = keyed.groupBy("_w").agg(F.count(F.lit(1)).alias("k")).join(wide(counts), "_w").withColumn("_n", F.ceil(F.col("n") * F.col("k") / SHARE).cast("int"))
    heavy = F.broadcast(cut(sizes.where("_n > 1").select("_w", "_n")))  # a row for each SHARE candidates at most
    texts = said.join(heavy, "_w", "left").withColumn("_salt", F.pmod(F.xxhash64(key), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    lists = keyed.join(heavy, "_w", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return texts.join(wide(lists), ["_w", "_salt"]).select(key, "variant")


def candidates(texts: DataFrame, values: DataFrame, key: str, text: str = "text", common: int = COMMON) -> DataFrame:
    """(key, variants): for each text the values that may stand in it, a superset of those that do (texts without any are left out).

    texts: key unique. A value is keyed by its rarest word, or, where even that one is common, by its rarest two adjacent
    words. Texts are exploded into distinct words, of which only those of values go on. Null and blank values are in no text."""
    listed = values.select("variant").where(F.regexp_like("variant", F.lit(r"(?U)\S"))).distinct()
    words = listed.select("variant", F.explode(word_keys(F.col("variant"))).alias("_w"))
    # the words that count are kept for both uses
    said = cut(_spoken(texts.select(key, F.explode(text_keys(F.col(text))).alias("_w")), words.select("_w").distinct(), key))
    counts = cut(said.groupBy("_w").agg(F.count(F.lit(1)).alias("n")))
    rarest = lambda w, n: w.join(wide(n), "_w", "left").groupBy("variant").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("_w"))).alias("m")).select("variant", "m.n", "m._w")
    keyed = cut(rarest(words, counts))
    plain, met = keyed, None
    pairs = keyed.where(F.col("n") > common).select("variant", F.explode(pairs_of(standing_words(F.col("variant")))).alias("_w"))
    if not pairs.isEmpty():
        pairs = cut(pairs)
        paired = pairs.select("variant").distinct()
        plain = keyed.join(wide(paired), "variant", "left_anti")
        # only texts with a common word of such a value are exploded again
        able = said.join(F.broadcast(cut(keyed.join(wide(paired), "variant", "left_semi").select("_w").distinct())), "_w", "left_semi").select(key).distinct()  # common words: at most all words said by COMMON
        spoken = cut(_spoken(texts.join(wide(able), key, "left_semi").select(key, F.explode(pairs_of(words_of(F.col(text)))).alias("_w")), pairs.select("_w").distinct(), key))
        n_pairs = cut(spoken.groupBy("_w").agg(F.count(F.lit(1)).alias("n")))
        met = _met(spoken, rarest(pairs, n_pairs).where("n > 0").select("variant", "_w"), n_pairs, key)
    own = _met(said, plain.where("n > 0").select("variant", "_w"), counts, key)
    return (own if met is None else own.union(met)).groupBy(key).agg(F.collect_set("variant").alias("variants"))


def corpus_leaks(texts: DataFrame, values: DataFrame, key: str, text: str = "text", common: int = COMMON) -> DataFrame:
    """(key, variant): texts that hold a value of a corpus-wide list (variant), in any case, as its pattern has it. Texts may share a
    key, or have none."""
    rows = cut(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn("_at", F.monotonically_increasing_id()))
    met = rows.join(wide(candidates(rows, values, "_at", "_text", common)), "_at")
    held = F.filter("variants", lambda v: F.regexp_like("_text", literal_pattern(v)))
    return met.select(F.col("_key").alias(key), F.explode(held).alias("variant")).distinct()
