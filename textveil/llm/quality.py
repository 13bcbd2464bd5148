"""Quality rules with host-level verdicts, in DataFrame operations only.

Every document's rule counts come from expressions over its own text. Each rule's failures are then summed by host (the
``source`` column), each host's rate of each rule is shrunk towards the corpus by that rule's beta prior, fitted to all hosts by
moments, and the host's verdicts are joined back: a document goes if it fails a rule itself, if its host's shrunk rate of any
failure says that nearly all of that host is waste, or if its host breaks a rule more often than the corpus does (by LIFT) and
the document fails the stricter limit of that rule. Clean documents of such hosts are far from both limits and stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_folder

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
#: Least words; most repeated words in per cent; symbols and repeated lines allowed (per cent of words, of lines).
MIN_WORDS, MAX_REPEAT, MAX_SYMBOLS, MAX_DUP_LINES = 50, 50, 10, 30
#: So few repeated lines say nothing: a short text may end as it began.
MIN_DUP_LINES = 3
#: A host whose shrunk failure rate is above this goes as a whole; a parameter of judge and keep_good.
MAX_HOST_RATE = 0.9
#: A host whose shrunk rate of a rule is so many times the corpus's is held to that rule's stricter limit.
LIFT = 1.05
#: The stricter limits, in per cent; too few words have none.
STRICT_REPEAT, STRICT_SYMBOLS, STRICT_DUP_LINES = 40, 5, 20
#: The rules that have both limits.
RULES = ("repeats", "symbols", "lines")
#: Host tables up to this many rows (of a short name and a flag) are broadcast.
BROADCAST_HOSTS = 100_000
POSITION_BITS = 20


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once a row however often ``then`` names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: Column) -> Column:
    """Words apart at blanks; the text is trimmed first, so none is empty."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))


def covered(starts: Column) -> Column:
    """How many word positions windows of three at these sorted starts cover."""
    zero = F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, zero, lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["at"])).alias("n")), lambda a: a["n"])


def repeated_words(w: Column, bits: int = POSITION_BITS) -> Column:
    """Words that stand in a 3-word window found twice or more in the list.

    Windows are compared as 64-bit hashes. The upper bits of a hash and the position share one long, so one
    primitive sort brings equal windows together; neighbours are then compared by the full hashes."""
    mask = (1 << bits) - 1

    def packed(h):
        def same(s, x, y):
            return (F.shiftrightunsigned(x, bits) == F.shiftrightunsigned(y, bits)) & (F.get(h, x.bitwiseAND(F.lit(mask).cast("long")).cast("int")) == F.get(h, y.bitwiseAND(F.lit(mask).cast("long")).cast("int")))

        keys = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, bits), bits).bitwiseOR(i.cast("long"))))
        twice = let(keys, lambda s: F.filter(s, lambda x, i: same(s, x, F.get(s, i - 1)) | same(s, x, F.get(s, i + 1))))
        return covered(F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.lit(mask).cast("long")))))

    def wide(h):  # more windows than positions fit
        keys = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        twice = let(keys, lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        return covered(F.sort_array(F.transform(twice, lambda x: x["i"])))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    none = F.lit(0).cast("long")
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).when(F.size(h) <= mask, packed(h)).otherwise(wide(h)))
    return F.when(F.size(w) < 4, none).otherwise(found)


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one struct column ``_q``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (all long)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counted = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeated_words(w).alias("r")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    q = F.struct(
        counted["n"].alias("n_words"),
        counted["c"].alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        by_line["d"].alias("n_dup_lines"),
        counted["r"].alias("n_repeat_words"),
        by_line["n"].alias("n_lines"),
    )
    return docs.withColumn("_q", q)


def base_failed(q: str = "_q") -> Column:
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT * F.col(f"{q}.n_words"))


def broken(q: str = "_q", strict: bool = False) -> dict[str, Column]:
    """Whether a document breaks each of RULES, at its usual or its stricter limit."""
    repeat, symbols, lines = (STRICT_REPEAT, STRICT_SYMBOLS, STRICT_DUP_LINES) if strict else (MAX_REPEAT, MAX_SYMBOLS, MAX_DUP_LINES)
    part = lambda n, limit, of: 100 * F.col(f"{q}.{n}") > limit * F.col(f"{q}.{of}")
    return {
        "repeats": part("n_repeat_words", repeat, "n_words"),
        "symbols": part("n_symbols", symbols, "n_words"),
        "lines": (F.col(f"{q}.n_dup_lines") >= MIN_DUP_LINES) & part("n_dup_lines", lines, "n_lines"),
    }


def rule_failed(q: str = "_q") -> Column:
    """The base rules and the two of the method's own: too many symbols, too many repeated lines."""
    own = broken(q)
    return base_failed(q) | own["symbols"] | own["lines"]


def rated_by(q: str = "_q") -> list[Column]:
    """What hosts are rated by: any failure, and each rule's."""
    return [rule_failed(q).alias("failed"), *[c.alias(name) for name, c in broken(q).items()]]


def host_verdicts(rated: DataFrame, max_rate: float = MAX_HOST_RATE, lift: float = LIFT) -> DataFrame:
    """rated (host, failed, RULES..., all boolean) -> (host, n, failures, rate, host_failed, and for each rule rate_<rule> and
    strict_<rule>), rates shrunk by beta priors.

    A prior's mean is the corpus rate and its weight comes from the spread of the hosts' rates, between 1
    and 1,000 documents. Null hosts give no row. Rules whose column is missing have no verdict."""
    names = ["failed", *[r for r in RULES if r in rated.columns]]
    hosts = cut(rated.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in names]))
    sums = [x for c in names for x in (F.sum(c).alias(f"f_{c}"), F.sum(F.col(c) * F.col(c) / F.col("n")).alias(f"s_{c}"))]
    m = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *sums).first()
    out = hosts
    for c in names:
        mean = (m[f"f_{c}"] / m["n"]) if m["n"] else 0.0
        spread = max(0.0, m[f"s_{c}"] / m["n"] - mean * mean - mean * (1 - mean) * m["k"] / m["n"]) if m["n"] else 0.0  # less what chance alone gives
        weight = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0
        rate = (F.col(c) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        out = out.withColumn("rate", rate).withColumn("host_failed", F.col("rate") > max_rate) if c == "failed" else out.withColumn(f"rate_{c}", rate).withColumn(f"strict_{c}", F.col(f"rate_{c}") > lift * mean)
    return out.withColumnRenamed("failed", "failures").drop(*RULES)


def failing(hosts: DataFrame) -> tuple[DataFrame, int]:
    """(host, host_failed, strict_<rule>...) of the hosts with a verdict, marked for broadcast within the bound, and their number."""
    flags = ["host_failed", *[f"strict_{r}" for r in RULES]]
    bad = cut(hosts.where(" or ".join(flags)).select("host", *flags))
    n = bad.count()
    return (F.broadcast(bad) if n <= BROADCAST_HOSTS else bad), n


def condemned(strict: dict[str, Column]) -> Column:
    """Whether the host's verdict, joined to a document, drops it; strict: whether it breaks each rule's stricter limit."""
    held = [F.col(f"strict_{r}") & strict[r] for r in RULES]
    return F.coalesce(F.col("host_failed") | held[0] | held[1] | held[2], F.lit(False))


def judge(docs: DataFrame, source: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs (doc_id, text, source, ...) -> a row each: doc_id, the counts, base_failed, kept, host_failed (whether the host's
    verdict alone drops it).

    Null and empty texts have no words and so fail. A null host has no verdict of its own. Repeated rows are
    judged (and counted for their host) row by row; an empty table gives an empty result."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col(source).cast("string").alias("host"))
    counted = cut(metrics(own).select("doc_id", "host", "_q"))
    bad, n = failing(host_verdicts(counted.select("host", *rated_by()), max_rate))
    out = counted.join(bad, "host", "left").withColumn("_host", condemned(broken(strict=True))) if n else counted.withColumn("_host", F.lit(False))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *(F.col(f"_q.{n}").alias(n) for n in names), base_failed().alias("base_failed"), (~rule_failed() & ~F.col("_host")).alias("kept"), (~rule_failed() & F.col("_host")).alias("host_failed"))


def keep_good(docs: DataFrame, source: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with all their columns, whatever their names. Every text is counted once:
    the verdicts lie beside the rows in a table in the shared folder, from which hosts are rated and rows are taken."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row).select("row", F.col("row.text").cast("string").alias("text"), F.col(f"row.`{source}`").cast("string").alias("host"))
    near = [c.alias(f"near_{r}") for r, c in broken(strict=True).items()]
    failed = metrics(own).select(F.when(~rule_failed(), F.col("row")).alias("row"), "host", *rated_by(), *near)
    place = f"{shared_folder(docs.sparkSession)}/quality-{uuid.uuid4().hex}"
    failed.write.parquet(place)
    rated = docs.sparkSession.read.schema(failed.schema).parquet(place)
    bad, n = failing(host_verdicts(rated.select("host", "failed", *RULES), max_rate))
    good = rated.where("not failed")
    return (good.join(bad, "host", "left").where(~condemned({r: F.col(f"near_{r}") for r in RULES})) if n else good).select("row.*")
