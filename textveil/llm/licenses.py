"""License scans by ordered signature rules, in DataFrame operations only.

A text that holds none of a few root words is done at once. For the others, the rules whose keyword stands in
the text are run. Their detections are put in order of place and parted where none goes on; what overlaps is then taken by the rules'
order, the longest first: one that lies within another goes (of two equal ones the weaker), and of two that overlap in
part the one of the earlier, stronger rule stays. None goes unless one that stays overlaps it. Everything happens within the
row: no shuffle, and work in proportion to the detections but for their sort and the square of what overlaps in one chain.

Edge cases. Null and empty texts have no words and no detections; repeated rows are scanned row by row; ties in place and rule
order are one detection; an empty table gives an empty result; texts are scanned whole; extra columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import GATE, rules

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The base phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Items of an array that are folded together.
PART = 128
SPAN = "array<struct<p:int,label:string,weight:double,s:int,e:int>>"


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def pieces(text: Column) -> Column:
    """The words, with an empty piece before or after them where the text begins or ends with a separator. A-Z
    alone change case: texts with a letter that lower() would turn into an ASCII one take the slower way."""
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.split(F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text)), SEPARATORS)


def count_words(own: Column) -> Column:
    ends = (F.get(own, F.lit(0)) == "").cast("int") + F.when(F.size(own) > 1, (F.get(own, F.size(own) - 1) == "").cast("int")).otherwise(0)
    return (F.size(own) - ends).cast("long")


def normalized(own: Column) -> Column:
    """Blank, words apart by one blank, blank."""
    return F.concat(F.lit(" "), F.trim(F.array_join(own, " ")), F.lit(" "))


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def folded(items: Column, start: Column, kind: str, step, last=None) -> Column:
    """One pass over an array: step(state, item) -> (state, array of what it gives out). What is given out is gathered in
    parts, since adding to one growing array would copy it each time. last(state): what is given out at the end."""
    none = F.lit([]).cast(kind)

    def part(a, i):
        def one(b, x):
            state, out = step(b["state"], x)
            return F.struct(state.alias("state"), F.concat(b["out"], out).alias("out"))

        # put together in the fold's last step: what a transform gives out is copied in full
        whole = lambda d: F.struct(d["state"].alias("state"), F.concat(a["out"], F.array(d["out"])).alias("out"))
        return F.aggregate(F.slice(items, i * PART + 1, F.lit(PART)), F.struct(a["state"].alias("state"), none.alias("out")), one, whole)

    zero = F.struct(start.alias("state"), F.lit([]).cast(f"array<{kind}>").alias("out"))
    parts = F.sequence(F.lit(0), F.ceil(F.size(items) / PART).cast("int") - 1)
    done = F.aggregate(parts, zero, part, lambda a: F.concat(F.flatten(a["out"]), last(a["state"])) if last else F.flatten(a["out"]))
    return F.when(F.size(items) > 0, done).otherwise(none)


def spans(norm: Column, pattern: Column) -> Column:
    """array<struct<s, e>> of the pattern's places in characters of norm, by the lengths of gaps and hits."""

    def fold(gaps, hits):
        def step(at, x):
            s = (at + x["gap"]).cast("int")
            e = (s + x["hit"]).cast("int")
            return e, F.array(F.struct(s.alias("s"), e.alias("e")))

        sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
        return let(sizes, lambda x: folded(x, F.lit(0), "array<struct<s:int,e:int>>", step))

    return let(F.split(norm, pattern, -1), lambda gaps: let(F.regexp_extract_all(norm, pattern, F.lit(1)), lambda hits: fold(gaps, hits)))


def strongest(chain: Column) -> Column:
    """What stays of overlapping detections: the strongest is taken first; a later one has to lie apart from all that are taken, or to
    hold whole all that it meets, which it then replaces."""
    order = lambda d: F.struct(d["p"].alias("p"), (d["s"] - d["e"]).alias("less"), d["s"].alias("s"), d.alias("d"))

    def step(kept, x):
        d = x["d"]
        apart = lambda k: (k["e"] <= d["s"]) | (d["e"] <= k["s"])
        holds = lambda k: (d["s"] <= k["s"]) & (k["e"] <= d["e"]) & (d["e"] - d["s"] > k["e"] - k["s"])
        return F.when(F.exists(kept, lambda k: ~apart(k) & ~holds(k)), kept).otherwise(F.concat(F.filter(kept, apart), F.array(d)))

    found = F.aggregate(F.array_sort(F.transform(chain, order)), F.lit([]).cast(SPAN), step)
    return F.when(F.size(chain) == 1, chain).otherwise(F.array_sort(found, lambda a, b: (a["s"] - b["s"]).cast("int")))


def resolved(found: Column) -> Column:
    """Detections without those that another suppresses, by place."""
    key = lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("end"), d["p"].alias("p"), d.alias("d"))

    def chained(own: Column) -> Column:
        # the number of the chain: a detection that begins where all before it have ended begins another
        def step(at, x):
            no = F.when(x["s"] >= at["e"], at["no"] + 1).otherwise(at["no"]).cast("int")
            return F.struct(F.greatest(at["e"], -x["end"]).cast("int").alias("e"), no.alias("no")), F.array(no)

        def parted(no: Column) -> Column:
            firsts = F.filter(F.sequence(F.lit(0), F.size(no) - 1), lambda i: (i == 0) | (F.get(no, i) != F.get(no, i - 1)))
            chain = lambda f, k: F.transform(F.slice(own, F.get(f, k) + 1, F.coalesce(F.get(f, k + 1), F.size(no)) - F.get(f, k)), lambda x: x["d"])
            return let(firsts, lambda f: F.flatten(F.transform(F.sequence(F.lit(0), F.size(f) - 1), lambda k: let(chain(f, k), strongest))))

        return let(folded(own, F.struct(F.lit(0).alias("e"), F.lit(0).alias("no")), "array<int>", step), parted)

    return let(found, lambda all_: F.when(F.size(all_) < 2, all_).otherwise(let(F.array_sort(F.transform(all_, key)), chained)))


def detections(norm: Column, table: list[dict] | None = None) -> Column:
    """All rule matches that no other suppresses, by place: array<struct<p, label, weight, s, e>>."""
    known = F.from_json(F.lit(json.dumps(table or rules())), "array<struct<p:int,label:string,weight:double,keyword:string,pattern:string>>")

    def one(r):
        return F.transform(spans(norm, r["pattern"]), lambda x: F.struct(r["p"].alias("p"), r["label"].alias("label"), r["weight"].alias("weight"), x["s"].alias("s"), x["e"].alias("e")))

    return resolved(F.flatten(F.transform(F.filter(known, lambda r: F.contains(norm, r["keyword"])), one)))


def base(norm: Column, n_words: Column) -> list[Column]:
    """n_base, first_word, last_word and base_labels of the base phrases."""
    hits, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        here = F.contains(norm, F.lit(f" {phrase} "))
        hits.append(F.when(here, F.regexp_count(norm, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(here, blanks(F.substring_index(norm, f" {phrase} ", 1))))
        lasts.append(F.when(here, n_words - blanks(F.substring_index(norm, f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(here, F.lit(label)))
    found = F.array_sort(F.array_compact(F.array(*labels)))
    return [sum(hits[1:], hits[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), found.alias("base_labels")]


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels and detections, a
    row for each row of docs. Null texts count as empty. A detection's s and e are places in the text's words
    joined by single blanks (with one more blank in front)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    nothing = [F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.lit([]).cast("array<string>").alias("base_labels"), F.lit([]).cast(SPAN).alias("detections")]

    def judge(own: Column) -> Column:
        n = count_words(own)
        full = let(normalized(own), lambda norm: F.struct(n.alias("n_words"), *base(norm, n), detections(norm).alias("detections")))
        gate = F.exists(own, lambda w: w.isin(GATE))
        return F.when(gate, full).otherwise(F.struct(n.alias("n_words"), *nothing))

    return docs.select("doc_id", let(pieces(text), judge).alias("x")).select("doc_id", "x.*")


def report(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the
    greatest weight of a detection that stays; 0 if none)."""
    found = scan(docs)
    own = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(own, ",").alias("labels"), best.alias("score"))
