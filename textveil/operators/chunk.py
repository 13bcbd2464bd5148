"""Long documents in pieces that join back exactly: blank lines first, then sentence ends, then words or length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, running

MAX_CHARS = 8000
#: Marks a cut, followed by CUT_HERE. Where a text holds this character itself, OWN follows it until the text is cut.
CUT = ""
CUT_HERE, OWN = "b", "a"
PARAGRAPH, SENTENCE, WORD = r"(\n[ \t]*\n)", r"(?U)([.!?]\s+)", r"(?U)(\s)"


def pieces(text: Column, separator: str) -> Column:
    """Pieces with their separator on the left one."""
    marked = F.regexp_replace(F.replace(text, F.lit(CUT), F.lit(CUT + OWN)), separator, f"$1{CUT}{CUT_HERE}")
    parts = F.transform(F.split(marked, CUT + CUT_HERE, -1), lambda x: F.replace(x, F.lit(CUT + OWN), F.lit(CUT)))
    return F.filter(parts, lambda x: x != "")


def by_length(text: Column, size: int) -> Column:
    """Runs of ``size`` characters, from one pass over the text (a substring would be looked for from the text's start)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def atoms(text: Column, size: int, whole_words: bool = False) -> Column:
    """The smallest pieces that are cut between."""
    sentence = lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(pieces(s, WORD) if whole_words else by_length(s, size))
    paragraph = lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.flatten(F.transform(pieces(p, SENTENCE), sentence)))
    return F.flatten(F.transform(pieces(text, PARAGRAPH), paragraph))


def filled(lengths: Column, size: int) -> Column:
    """array<int>: the number of the chunk that each atom of these lengths goes into, as chunks are filled in turn."""
    zero = F.struct(F.lit(0).alias("open"), F.lit(0).alias("no"))

    def step(a, n):
        full = (a["open"] > 0) & (a["open"] + n > size)
        no = F.when(full, a["no"] + 1).otherwise(a["no"]).cast("int")
        return F.struct(F.when(full, n).otherwise(a["open"] + n).cast("int").alias("open"), no.alias("no")), no

    return let(lengths, lambda n: running(n, zero, "int", step))  # evaluated once, not for each part of the fold


def split(text: Column, max_chars: int = MAX_CHARS, whole_words: bool = False) -> Column:
    """array<string> of pieces of at most max_chars that join to the text; none for null and empty texts. The work is linear in
    the text: chunks are joined from slices of the array of atoms, never cut out by their place in the text.

    whole_words: a sentence longer than max_chars is cut between its words instead of every max_chars characters, so that no value
    without blanks is cut in two, which neither piece would show; a longer word is a piece of its own that exceeds max_chars."""
    if max_chars < 1:
        raise ValueError(f"max_chars must be positive, got {max_chars}")

    def packed(a: Column) -> Column:
        def joined(no: Column) -> Column:
            firsts = F.filter(F.sequence(F.lit(0), F.size(no) - 1), lambda i: (i == 0) | (F.get(no, i) != F.get(no, i - 1)))
            piece = lambda f, k: F.array_join(F.slice(a, F.get(f, k) + 1, F.coalesce(F.get(f, k + 1), F.size(no)) - F.get(f, k)), "")
            return let(firsts, lambda f: F.transform(F.sequence(F.lit(0), F.size(f) - 1), lambda k: piece(f, k)))

        return let(filled(F.transform(a, lambda x: F.length(x)), max_chars), joined)

    none = F.lit([]).cast("array<string>")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, none).when(F.length(text) <= max_chars, F.array(text)).otherwise(let(atoms(text, max_chars, whole_words), packed))


def placed(parts: Column) -> Column:
    """array<struct<chunk_no, chunk_start, text>> of chunks in their order."""
    step = lambda at, t: ((at + F.length(t)).cast("int"), F.struct(at.alias("chunk_start"), t.alias("text")))
    numbered = lambda x, i: F.struct(i.alias("chunk_no"), x["chunk_start"].alias("chunk_start"), x["text"].alias("text"))
    return F.transform(let(parts, lambda p: running(p, F.lit(0), "struct<chunk_start:int,text:string>", step)), numbered)


def chunks(df: DataFrame, *keys: str, text: str = "text", max_chars: int = MAX_CHARS, outer: bool = False, whole_words: bool = False) -> DataFrame:
    """(keys, chunk_no, chunk_start, text): a row for each chunk. outer: null and empty texts give a row of nulls."""
    return df.select(*keys, (F.explode_outer if outer else F.explode)(placed(split(F.col(text), max_chars, whole_words))).alias("c")).select(*keys, "c.*")


def rejoin(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, text) of chunks in their order."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk_no", F.col(text).alias("t")))).alias("c"))
    return rows.select(*keys, F.array_join(F.transform("c", lambda x: x["t"]), "").alias(text))
