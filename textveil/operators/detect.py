"""Detection of private values as one array of spans a row."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.columns import digits, hits_of, iban_valid, jmbg_valid, let, located, luhn_valid, no_spans, places, span

#: Characters before a match that are searched for context words, what they add, and the default least score.
WINDOW, BOOST, THRESHOLD = 40, 0.35, 0.4


def pattern_spans(text: Column, entry: tuple, mask_malformed: bool = False) -> Column:
    """Spans of one pattern entry; checksummed kinds keep what is valid (score 1), and malformed ones at their score if asked."""
    return matched(text, [entry], mask_malformed)


def matched(text: Column, entries: list[tuple], mask_malformed: bool = False, least: float = 0.0) -> Column:
    """Spans of all these pattern entries. Only the matching is written out for each: offsets, scores and checksums are one
    expression over what matched, so that the plan grows by little with an entry.

    least: the score that the caller goes by. A weak entry, which reaches it by a context word alone, is looked for only in texts that
    hold such a word; what it would match elsewhere is below."""
    if not entries:
        return no_spans()

    def found(entry: tuple) -> Column:
        kind, name, expression, score, must, validator = entry
        facts = [F.lit(kind).alias("kind"), F.lit(float(score)).alias("score"), F.lit(validator or "").alias("check"), F.lit(list(P.CONTEXT.get(name, ()))).cast("array<string>").alias("words")]
        out = hits_of(text, expression, lambda gaps, hits: F.struct(*facts, gaps.alias("gaps"), hits.alias("hits")))
        if name in P.GATES:
            out = F.when(F.regexp_like(text, F.lit(P.GATES[name])), out)
        if score < least and not validator:
            out = F.when(reduce(or_, [F.contains(F.lower(text), F.lit(w)) for w in P.CONTEXT.get(name, ())], F.lit(False)), out)
        return F.when(F.contains(text, F.lit(must)), out) if must else out

    # entries without a substring of their own all need a digit: most chunks skip them after one look
    parts = [F.array(*[found(e) for e in entries if e[4]])]
    if numeric := [found(e) for e in entries if not e[4]]:
        parts.append(F.when(F.regexp_like(text, F.lit(r"\p{Nd}")), F.array(*numeric)).otherwise(F.array()))
    spans = F.transform(F.array_compact(F.concat(*parts)), lambda m: F.transform(located(m["gaps"], m["hits"]), lambda x: rated(text, m, x, mask_malformed)))
    return F.coalesce(F.filter(F.flatten(spans), lambda s: s["score"] >= 0), no_spans())


def rated(text: Column, entry: Column, x: Column, mask_malformed: bool) -> Column:
    """The span of one match: its entry's score, raised where a context word stands shortly before it, or what its checksum makes of
    it (below 0: none)."""
    near = F.lower(F.substring(text, F.greatest(F.lit(1), x["s"] - WINDOW + 1), F.least(x["s"], F.lit(WINDOW))))
    rate = F.when((F.size(entry["words"]) > 0) & F.exists(entry["words"], lambda w: F.contains(near, w)), F.least(F.lit(1.0), entry["score"] + BOOST)).otherwise(entry["score"])
    malformed = F.when(entry["check"] != "luhn", rate).otherwise(-1.0) if mask_malformed else F.lit(-1.0)
    checked = F.when(entry["check"] == "", rate)
    for name, valid, score in (("jmbg", jmbg_valid, 1.0), ("iban", iban_valid, 1.0), ("luhn", luhn_valid, 0.95)):
        checked = checked.when(entry["check"] == name, F.when(valid(x["v"]), score).otherwise(malformed))
    return span(entry["kind"], x["s"], x["e"], checked, x["v"])


def fields(text: Column) -> Column:
    """array<struct<entity_type, l_start, l_end, start, end, value>> of ``Label: value`` lines with a known label."""
    known = F.create_map(*[F.lit(x) for kind, labels in P.FIELD_LABELS.items() for label in labels for x in (label, kind)])

    def parts(x: Column) -> Column:
        # each group is taken out of the line once
        return let(F.struct(*[F.regexp_extract(x["v"], P.FIELD_PARTS, i).alias(f"p{i}") for i in (1, 2, 3, 4)]), lambda p: placed(x, p))

    def placed(x: Column, p: Column) -> Column:
        l_start = x["s"] + F.length(p["p1"])
        l_end = l_start + F.length(p["p2"])
        start = l_end + F.length(p["p3"])
        kind = F.try_element_at(known, F.lower(F.trim(p["p2"])))
        return F.struct(kind.alias("entity_type"), l_start.alias("l_start"), l_end.alias("l_end"), start.alias("start"), (start + F.length(p["p4"])).alias("end"), p["p4"].alias("value"))

    found = F.filter(F.transform(places(text, P.FIELD_LINE), parts), lambda f: f["entity_type"].isNotNull())
    kind = "array<struct<entity_type:string,l_start:int,l_end:int,start:int,end:int,value:string>>"
    return F.when(F.contains(text, F.lit(":")), found.cast(kind)).otherwise(F.lit([]).cast(kind))


def plausible(entity_type: Column, value: Column) -> Column:
    """Long enough, with enough digits; an e-mail address needs its @."""
    out = F.lit(True)
    for kind, (chars, n) in P.PLAUSIBLE.items():
        fits = (F.length(value) >= chars) & (F.length(digits(value)) >= n)
        if kind == "EMAIL_ADDRESS":
            fits = fits & F.contains(value, F.lit("@"))
        out = F.when(entity_type == kind, fits).otherwise(out)
    return out


def field_spans(found: Column) -> Column:
    good = F.filter(found, lambda f: plausible(f["entity_type"], f["value"]))
    return F.transform(good, lambda f: span(f["entity_type"], f["start"], f["end"], P.FIELD_SCORE, f["value"]))


def drop_labels(spans: Column, found: Column) -> Column:
    """Without spans that lie inside a known label (whether or not its value is plausible)."""
    return F.filter(spans, lambda s: ~F.exists(found, lambda f: (f["l_start"] <= s["start"]) & (s["end"] <= f["l_end"])))


def value_spans(text: Column, values: Column, entity_type: str, score: float) -> Column:
    """Every place of the listed values (array<string>), each value left to right without overlap; case counts."""
    quoted = lambda v: F.concat(F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), no_spans().alias("out"))

    def one(v: Column) -> Column:
        gaps = F.split(text, quoted(v), -1)

        def step(a, gap):
            s = (a["at"] + F.length(gap)).cast("int")
            e = (s + F.length(v)).cast("int")
            more = F.concat(a["out"], F.array(span(entity_type, s, e, score, v)))
            return F.struct(e.alias("at"), (a["i"] + 1).alias("i"), more.alias("out"))

        return let(gaps, lambda g: F.aggregate(F.slice(g, 1, F.size(g) - 1), zero, step, lambda a: a["out"]))

    some = F.filter(values, lambda v: (v != "") & F.contains(text, v))
    return F.coalesce(F.flatten(F.transform(some, one)), no_spans())


def resolve(spans: Column) -> Column:
    """The strongest spans that don't overlap: by score, then length, then start (then type); in text order.
    Touching spans don't overlap."""

    def rank(a, b):
        la, lb = a["end"] - a["start"], b["end"] - b["start"]
        return (
            F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
            .when(la > lb, -1).when(la < lb, 1)
            .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["entity_type"] < b["entity_type"], -1).when(a["entity_type"] > b["entity_type"], 1).otherwise(0)
        )

    clash = lambda kept, c: F.exists(kept, lambda k: (c["start"] < k["end"]) & (k["start"] < c["end"]))
    kept = lambda x: F.aggregate(F.array_sort(x, rank), no_spans(), lambda acc, c: F.when(clash(acc, c), acc).otherwise(F.concat(acc, F.array(c))))
    in_order = lambda x: F.array_sort(kept(x), lambda a, b: (a["start"] - b["start"]).cast("int"))
    return let(spans, lambda x: F.when(F.size(x) < 2, x).otherwise(in_order(x)))  # spans are found once, not for each mention here


def spans_of(
    text: Column,
    *,
    threshold: float = THRESHOLD,
    entities: Iterable[str] = P.DEFAULT_ENTITIES,
    detect_money: bool = False,
    mask_malformed: bool = False,
    patterns: Iterable[tuple] = P.PATTERNS,
    extra: Iterable[Callable[[Column], Column]] = (),
    found: Iterable[Column] = (),
) -> Column:
    """All private values of a text: patterns, labelled fields and the caller's own detectors (each a function of the text
    column to an array of spans), over the threshold, not inside labels, overlaps resolved. found: columns of spans that are there
    already. Python functions need a stage of their own, which detect gives them; here detectors are expressions.

    patterns: a table of entries (entity type, name, Java expression, score, substring that must stand in the text or None
    if it needs a digit, validator ``jmbg``, ``iban``, ``luhn`` or None); entries whose type isn't in entities are left out."""
    wanted = [*entities, *(["MONEY_AMOUNT"] if detect_money else [])]
    entries = [e for e in (*patterns, *(P.MONEY if detect_money else ())) if e[0] in wanted]

    given = F.concat(no_spans(), *[F.coalesce(c, no_spans()) for c in (*[d(text) for d in extra], *found)])

    def all_of(x: Column) -> Column:
        f = x["fields"]
        return resolve(drop_labels(F.filter(F.concat(matched(text, entries, mask_malformed, threshold), field_spans(f), x["given"]), lambda s: (s["score"] >= threshold) & s["entity_type"].isin(wanted)), f))

    return F.when(F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S")), let(F.struct(fields(text).alias("fields"), given.alias("given")), all_of)).otherwise(no_spans())


#: What a model gives for each text: places in code points, end exclusive.
MODEL_SPANS = "array<struct<entity_type:string,start:int,end:int,score:double>>"


def model_detector(model: Callable, kind: str = "arrow") -> Callable[[Column], Column]:
    """A detector of the caller's own Python model, for detect's ``extra``.

    model takes a batch of texts and gives for each an array of (entity_type, start, end, score), or null: a pyarrow array to a
    pyarrow array (``arrow``), or a pandas series to a series of lists (``pandas``)."""
    wrap = {"arrow": F.arrow_udf, "pandas": F.pandas_udf}
    if kind not in wrap:
        raise ValueError(f"kind must be 'arrow' or 'pandas', got {kind!r}")
    return wrap[kind](model, MODEL_SPANS)


def checked(text: Column, given: Column) -> Column:
    """Spans with their values read from the text, of those given that have a type, a score and a place inside the text."""

    def good(n: Column) -> Column:
        fits = lambda s: F.coalesce(s["entity_type"].isNotNull() & s["score"].isNotNull() & ~F.isnan(s["score"]) & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= n), F.lit(False))
        return F.transform(F.filter(given, fits), lambda s: span(s["entity_type"], s["start"], s["end"], s["score"], F.substring(text, s["start"] + 1, s["end"] - s["start"])))

    return F.coalesce(let(F.length(text), good), no_spans())


def detect(df: DataFrame, text: str = "text", spans: str = "spans", *, known: DataFrame | None = None, extra: Iterable[Callable[[Column], Column]] = (), **options) -> DataFrame:
    """df with its array of spans. known: a table of values (entity_type, value) to be found as well, see ``known.find``.

    extra: the caller's own detectors, functions of the text column to spans: expressions, Arrow or pandas UDFs (see
    model_detector). All of them run in a stage of their own, a column each, before the expressions that
    resolve: a UDF sees a text once, in batches. Spans outside the text, without a type or without a score are dropped."""
    if known is not None:
        from .known import find

        return detect(find(df, known, text=text, into="_known"), text, spans, extra=(*extra, lambda _: F.col("_known")), **options).drop("_known")
    own = {f"_extra_{i}": d(F.col(text)) for i, d in enumerate(extra)}
    staged = df.withColumns(own) if own else df
    return staged.withColumn(spans, _built(text, tuple(own), options)).drop(*own)


_BUILT: dict = {}


def _built(text: str, extra: tuple[str, ...], options: dict) -> Column:
    """The expression of spans_of. It has thousands of parts, each a call to the JVM, and is the same for every table, so it is made
    once for the options that a program uses."""
    make = lambda: spans_of(F.col(text), found=[checked(F.col(text), F.col(name)) for name in extra], **options)
    plain = {k: v if isinstance(v, (bool, int, float, str)) else tuple(v) for k, v in options.items()}
    key = (id(SparkContext._gateway), text, extra, tuple(sorted(plain.items(), key=lambda x: x[0])))
    try:
        if key not in _BUILT:
            if len(_BUILT) >= 64:
                _BUILT.clear()
            _BUILT[key] = spans_of(F.col(text), found=[checked(F.col(text), F.col(name)) for name in extra], **plain)
        return _BUILT[key]
    except TypeError:  # options that can't be compared are not remembered
        return make()


def explode_spans(df: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """A row for each span, with the keys. (Spark puts a filter on the array's size below an inner explode, which would detect anew for
    each mention of the array there; an outer one has none.)"""
    return df.select(*keys, F.explode_outer(spans).alias("s")).where("s is not null").select(*keys, "s.*")
