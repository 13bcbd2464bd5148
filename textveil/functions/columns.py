"""Expressions over one row: spans with offsets in code points, checksums, keys, literal patterns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<entity_type:string,start:int,end:int,score:double,value:string>"
SPANS = f"array<{SPAN}>"


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once a row however often it is used, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def no_spans() -> Column:
    return F.lit([]).cast(SPANS)


def span(entity_type, start: Column, end: Column, score, value: Column) -> Column:
    kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    rate = score.cast("double") if isinstance(score, Column) else F.lit(float(score))
    return F.struct(kind.alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), rate.alias("score"), value.alias("value"))


#: Items of an array that are folded together.
PART = 256


def running(items: Column, start: Column, kind: str, step) -> Column:
    """One pass over an array: step(state, item) -> (state, item given out), gathered as an array of ``kind``. What is given
    out is gathered in parts, since adding to one growing array would copy it each time."""
    none = F.lit([]).cast(f"array<{kind}>")

    def part(a, i):
        def one(b, x):
            state, out = step(b["state"], x)
            return F.struct(state.alias("state"), F.concat(b["out"], F.array(out)).alias("out"))

        # put together in the fold's last step: what a transform gives out is copied in full
        whole = lambda d: F.struct(d["state"].alias("state"), F.concat(a["out"], F.array(d["out"])).alias("out"))
        return F.aggregate(F.slice(items, i * PART + 1, F.lit(PART)), F.struct(a["state"].alias("state"), none.alias("out")), one, whole)

    zero = F.struct(start.alias("state"), F.lit([]).cast(f"array<array<{kind}>>").alias("out"))
    parts = F.sequence(F.lit(0), F.ceil(F.size(items) / PART).cast("int") - 1)
    return F.when(F.size(items) > 0, F.aggregate(parts, zero, part, lambda a: F.flatten(a["out"]))).otherwise(none)


PLACES = "struct<s:int,e:int,v:string>"


def hits_of(text: Column, pattern: str, then) -> Column:
    """then(gaps, hits) of a pattern that never matches the empty string, null where it matches nowhere."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return let(hits, lambda h: F.when(F.size(h) > 0, then(F.split(text, pattern, -1), h)))


def located(gaps: Column, hits: Column) -> Column:
    """array<struct<s, e, v>> of hits: lengths of the gaps and the hits give the offsets; both are counted in code points."""

    def step(at, x):
        s = (at + F.length(x["gap"])).cast("int")
        e = (s + F.length(x["hit"])).cast("int")
        return e, F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("v"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return let(pairs, lambda x: running(x, F.lit(0), PLACES, step))


def places(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>> of all matches of a pattern that never matches the empty string; none in a null text."""
    found = hits_of(text, pattern, lambda gaps, hits: let(gaps, lambda g: located(g, hits)))
    return F.coalesce(found, F.lit([]).cast(f"array<{PLACES}>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def jmbg_valid(value: Column) -> Column:
    """The check digit of a 13-digit national id: weights 7..2 twice over twelve digits, 11 less the sum's rest."""
    d = digits(value)
    weights = F.lit([7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])
    total = F.aggregate(F.zip_with(F.sequence(F.lit(1), F.lit(12)), weights, lambda i, w: F.try_to_number(F.substring(d, i, F.lit(1)), F.lit("9")).cast("int") * w), F.lit(0), lambda a, x: a + x)
    rest = 11 - total % 11
    check = F.when(rest < 10, rest).otherwise(0)
    return F.coalesce((F.length(d) == 13) & (F.substring(d, 13, 1) == check.cast("string")), F.lit(False))


def iban_valid(value: Column) -> Column:
    """Rest 1 modulo 97 of the rearranged value, letters as two digits."""
    turned = F.split(F.concat(F.substr(value, F.lit(5)), F.substring(value, 1, 4)), "")
    code = lambda c: F.ascii(c)
    rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: F.when(code(c) < 58, (a * 10 + code(c) - 48) % 97).otherwise((a * 100 + code(c) - 55) % 97).cast("int"))
    return F.coalesce((F.length(value) >= 15) & (rest == 1), F.lit(False))


def luhn_valid(value: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits(value)), F.lit(False))


def normalize(value: Column) -> Column:
    """Case and repeated blanks ignored. lower() stands for full case folding, with the sharp s folded."""
    return F.replace(F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def match_key(value: Column, match: str = "normalized") -> Column:
    if match not in ("normalized", "exact"):
        raise ValueError(f"match must be 'normalized' or 'exact', got {match!r}")
    return normalize(value) if match == "normalized" else value


def placeholder(entity_type: Column, idx: Column) -> Column:
    return F.format_string("<%s_%03d>", entity_type, idx)


def fingerprint(entity_type: Column, value: Column, secret: str, width: int = 12) -> Column:
    """Keyed hash (HMAC-SHA256) of type and normalized value. The two pads stand in the plan: see README on redaction."""
    key = secret.encode("utf-8")
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    message = F.concat(F.lit(bytearray(inner)), F.encode(F.concat(entity_type, F.lit(":"), normalize(value)), "UTF-8"))
    return F.substring(F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(message, 256))), 256), 1, width)


def literal_pattern(value: Column, ignore_case: bool = True) -> Column:
    """Matches the value literally, in any case unless told otherwise, not inside a longer word where it begins or ends with a letter or digit."""
    edge = lambda c: F.when(F.regexp_like(c, F.lit(r"^[\p{L}\p{N}]$")), r"\b").otherwise("")
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.lit("(?iU)" if ignore_case else "(?U)"), edge(F.substring(value, 1, 1)), quoted, edge(F.substring(value, -1, 1)))


def fold(value: Column) -> Column:
    """What literal_pattern matches alike has equal folds, so a pattern that matches stands in the text's fold too. Lowering,
    raising and lowering again brings all forms of a letter together; what lowering makes of a dotted capital I, and of a sigma
    at a word's end, depends on its surroundings and is levelled. (That also parts the three steps, which the optimizer would
    otherwise take for one.) Texts of plain ASCII are lowered alone, which gives the same."""
    level = lambda c: F.translate(c, "\u03c2\u0307", "\u03c3")
    whole = lambda v: level(F.lower(level(F.upper(level(F.lower(v))))))
    return let(value, lambda v: F.when(F.octet_length(v) == F.length(v), F.lower(v)).otherwise(whole(v)))


def bare(token: Column) -> Column:
    return F.regexp_replace(token, r"^[<>]+|[<>]+$", "")


def shorten(value: Column, width: int = 42) -> Column:
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width - 1), F.lit("…"))).otherwise(value)


def type_label(entity_type: Column) -> Column:
    out = entity_type
    for tail in ("_ADDRESS", "_CODE", "_NUMBER"):
        out = F.replace(out, F.lit(tail), F.lit(""))
    return out
