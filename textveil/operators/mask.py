"""Masking: approved spans give way to placeholders, a sweep catches missed mentions, a guard holds back leaks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fold, let, literal_pattern, match_key
from ..functions.joins import HELD, meet
from ..functions.lineage import cut, wide
from . import chunk, detect, review, vault
from .search import corpus_leaks, words_of

#: Spellings that are tried one by one; where there are more, the text's words tell first which may stand in it.
FEW = 8
#: Spellings from which a scope's vault is met by word instead of standing in each of its rows.
RICH = 1000


def substitute(text: Column, spans: Column, placeholders: Column) -> Column:
    """The text with each span (sorted, not overlapping) replaced by its placeholder, in one pass."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, x):
        gap = F.substring(text, a["at"] + 1, x["s"]["start"] - a["at"])
        return F.struct(x["s"]["end"].alias("at"), F.concat(a["out"], gap, x["p"]).alias("out"))

    paired = F.zip_with(spans, placeholders, lambda s, p: F.struct(s.alias("s"), p.alias("p")))
    return F.aggregate(paired, zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def forms_of(entries: Column, seq: Column | None) -> Column:
    """array<struct<placeholder, variant, word, opens>> in minting order, then spelling order; only what was seen up to seq."""
    visible = F.filter(F.coalesce(entries, F.lit([]).cast("array<struct<first_seq:int,first_start:int,entity_type:string,idx:bigint,placeholder:string,forms:array<struct<variant:string,seen:int,word:string,opens:boolean>>>>")), lambda e: vault.is_visible(e, seq))

    def own(e):
        some = e["forms"] if seq is None else F.filter(e["forms"], lambda f: F.coalesce(f["seen"] <= seq, F.lit(True)))
        return F.transform(some, lambda f: F.struct(e["placeholder"].alias("placeholder"), f["variant"].alias("variant"), f["word"].alias("word"), f["opens"].alias("opens")))

    return F.flatten(F.transform(visible, own))


def near(text: Column, forms: Column, sweeping: bool = True) -> Column:
    """Of forms_of's array what may hit in the text, in the same order: one look-up in the text's words instead of a search for each
    spelling, so that a text costs the same whether its scope knows ten spellings or a thousand.

    A spelling's word stands in every text that the spelling stands in. While sweeping, the text changes: words that placeholders
    bring in are no spelling's ``word``, and where a likely spelling may part a word in two, all spellings stay."""

    def pick(words: Column) -> Column:
        some = F.filter(forms, lambda f: (f["word"] == "") | F.array_contains(words, f["word"]))
        return let(some, lambda s: F.when(F.exists(s, lambda f: f["opens"]), forms).otherwise(s)) if sweeping else some

    met = F.array_intersect(F.transform(forms, lambda f: f["word"]), F.coalesce(words_of(text), F.lit([]).cast("array<string>")))
    return F.when(F.size(forms) <= FEW, forms).otherwise(let(met, pick))


def sweep(text: Column, forms: Column) -> Column:
    """struct<text, sealed>: every known spelling replaced in turn, in any case; sealed names those that hit."""
    state = lambda t, sealed: F.struct(t.alias("text"), fold(t).alias("folded"), sealed.alias("sealed"))

    def step(a, f):
        pattern = literal_pattern(f["variant"])
        likely = F.contains(a["folded"], fold(f["variant"]))  # spares most rows the regular expression
        hit = likely & F.regexp_like(a["text"], pattern)
        swept = F.regexp_replace(a["text"], pattern, F.replace(F.replace(f["placeholder"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))
        return F.when(hit, state(swept, F.concat(a["sealed"], F.array(f["variant"])))).otherwise(a)

    return F.aggregate(forms, state(text, F.lit([]).cast("array<string>")), step, lambda a: F.struct(a["text"].alias("text"), a["sealed"].alias("sealed")))


def leaks(text: Column, forms: Column) -> Column:
    """array<string>: the known spellings that still stand in the text."""
    return let(fold(text), lambda t: F.transform(F.filter(forms, lambda f: F.contains(t, fold(f["variant"])) & F.regexp_like(text, literal_pattern(f["variant"]))), lambda f: f["variant"]))


def mentions_of(df: DataFrame, scope: list[str], spans: str = "approved") -> DataFrame:
    """(scope..., seq, start, entity_type, value) of all approved spans."""
    return df.select(*scope, "seq", F.explode(spans).alias("s")).select(*scope, "seq", F.col("s.start").alias("start"), F.col("s.entity_type").alias("entity_type"), F.col("s.value").alias("value"))


def mask(
    df: DataFrame,
    scope: list[str],
    *,
    spans: str = "spans",
    text: str = "text",
    match: str = "normalized",
    secret: str = vault.SECRET,
    decisions: DataFrame | None = None,
    confirm_below: float = review.CONFIRM_BELOW,
    sweep_scope: str = "causal",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(masked rows, vault, variants) of rows (scope..., seq INT, text, spans).

    Masked rows have all columns of df, and masked_text, approved, declined, sealed, leaks and entity_counts. sweep_scope:
    ``causal`` sweeps a row with values first seen in it or before; ``full`` with all of its scope. Rows without
    spans stay as they are. Scopes are documents or conversations: a scope's vault stands in its rows, but where it has more than
    RICH spellings, as one of all rows without an id may, it meets them by word.

    A null in a scope column is a scope like any other: its rows share a vault. A row whose seq is null is swept with all of its
    scope, and what is found in it counts as first seen before all else. masked_text is null where a text could not be masked, and
    leaks is null where nobody looked: guard holds both back."""
    if not scope:
        raise ValueError("a vault of the whole corpus doesn't fit a row: use mask_corpus")
    if sweep_scope not in ("causal", "full"):
        raise ValueError(f"sweep_scope must be 'causal' or 'full', got {sweep_scope!r}")
    keyed = df if scope == [HELD] else df.withColumn(HELD, F.struct(*scope))
    judged = cut(review.decide(keyed, decisions, spans=spans, confirm_below=confirm_below).withColumn("_line", F.monotonically_increasing_id()))  # detection runs once
    found = mentions_of(judged, [HELD])
    minted = cut(vault.mint(found, [HELD], match=match, secret=secret))
    spelled = cut(vault.variants(found, minted, [HELD], match))
    seq = F.col("seq") if sweep_scope == "causal" else None
    columns = [*df.columns, "masked_text", "approved", "declined", "sealed", "leaks", "entity_counts"]
    rich = cut(spelled.groupBy(HELD).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RICH).select(HELD))
    if rich.isEmpty():
        out = masked_by_scope(judged, minted, spelled, text, match, seq).select(*columns)
    else:
        part = lambda how: [x.join(F.broadcast(rich), HELD, how) for x in (judged, minted, spelled)]  # a row for each RICH spellings at most
        out = masked_by_scope(*part("left_anti"), text, match, seq).select(*columns).unionByName(masked_by_word(*part("left_semi"), text, match, seq).select(*columns))
    if scope == [HELD]:
        return out, minted, spelled
    plain = lambda t: t.select(f"{HELD}.*", *[c for c in t.columns if c != HELD])
    return out, plain(minted), plain(spelled)


def finished(rows: DataFrame, text: str, entries: Column, forms: Column) -> DataFrame:
    """rows (_swept) with masked_text, sealed, leaks of the spellings in forms, and entity_counts."""
    rows = rows.withColumn("masked_text", F.col("_swept.text")).withColumn("sealed", F.coalesce("_swept.sealed", F.lit([]).cast("array<string>")))
    return rows.withColumn("leaks", looked(F.col(text), F.col("approved"), entries, F.col("masked_text"), forms)).withColumn("entity_counts", counts(F.col("approved")))


def key_of(s: Column, match: str) -> Column:
    return F.concat_ws("\u0001", s["entity_type"], match_key(s["value"], match))


def masked_by_scope(judged: DataFrame, minted: DataFrame, spelled: DataFrame, text: str, match: str, seq: Column | None) -> DataFrame:
    """The masked rows of scopes with few spellings: each row gets its scope's vault as one array."""
    rows = judged.join(wide(vault.entries(minted, [HELD], spelled)), HELD, "left").join(wide(vault_names(minted, [HELD])), HELD, "left")
    rows = rows.withColumn("_names", F.transform("approved", lambda s: F.try_element_at("_by_key", key_of(s, match))))
    rows = rows.withColumn("_first", substitute(F.col(text), F.col("approved"), F.col("_names")))
    return swept_by_scope(rows, text, seq)


def swept_by_scope(rows: DataFrame, text: str, seq: Column | None) -> DataFrame:
    rows = rows.withColumn("_forms", forms_of(F.col("entries"), seq)).withColumn("_near", near(F.col("_first"), F.col("_forms")))
    rows = rows.withColumn("_swept", sweep(F.col("_first"), F.col("_near")))
    return finished(rows, text, F.col("entries"), near(F.col("masked_text"), F.col("_forms"), sweeping=False))


def masked_by_word(judged: DataFrame, minted: DataFrame, spelled: DataFrame, text: str, match: str, seq: Column | None) -> DataFrame:
    """The masked rows of scopes with many spellings: values meet the vault by their keys, and spellings meet the texts by word, as
    ``near`` would pick them, so no row carries its scope's vault. Only rows in which a spelling that may part a word is likely are
    swept with all of it."""
    value = lambda s: F.struct(s["entity_type"].alias("entity_type"), match_key(s["value"], match).alias("match_key"))
    said = judged.select("_line", HELD, F.explode(F.array_distinct(F.transform("approved", value))).alias("k")).select("_line", HELD, "k.*")
    pair = F.struct(F.concat_ws("\u0001", "entity_type", "match_key").alias("k"), F.col("placeholder").alias("v"))
    names = said.join(wide(minted.select(HELD, "entity_type", "match_key", "placeholder")), [HELD, "entity_type", "match_key"]).groupBy("_line").agg(F.map_from_entries(F.collect_list(pair)).alias("_by_key"))
    first = judged.join(wide(names), "_line", "left").withColumn("_first", substitute(F.col(text), F.col("approved"), F.transform("approved", lambda s: F.try_element_at("_by_key", key_of(s, match)))))
    flat = cut(vault.spellings(minted, spelled, [HELD]))
    loose = flat.where("f.word = ''").groupBy(HELD).agg(F.collect_list("f").alias("_loose"))
    known = lambda f: F.lit(True) if seq is None else F.coalesce(f["first_seq"] <= seq, F.lit(True)) & F.coalesce(f["seen"] <= seq, F.lit(True))

    def likely(rows: DataFrame, of: str, into: str) -> DataFrame:
        words = rows.select("_line", HELD, "seq", F.explode(F.array_distinct(words_of(F.col(of)))).alias("_word"))
        met = words.join(wide(flat.where("f.word <> ''").withColumn("_word", F.col("f.word"))), [HELD, "_word"]).where(known(F.col("f")))
        own = met.groupBy("_line").agg(F.collect_list("f").alias("_met"))
        held = rows.join(wide(own), "_line", "left").join(wide(loose), HELD, "left")
        some = F.flatten(F.array_compact(F.array("_met", F.filter("_loose", known))))
        return held.withColumn(into, F.array_sort(some)).drop("_met", "_loose")

    held = cut(likely(cut(first.drop("_by_key")), "_first", "_near"))
    parting = F.exists("_near", lambda f: f["opens"])
    swept = cut(held.where(~parting).withColumn("_swept", sweep(F.col("_first"), F.col("_near"))).withColumn("_masked", F.col("_swept.text")))
    out = finished(likely(swept, "_masked", "_forms"), text, F.lit(True), F.col("_forms")).drop("_near", "_masked", "_forms")
    rest = held.where(parting).drop("_near")
    if rest.isEmpty():
        return out
    rest = swept_by_scope(rest.join(wide(vault.entries(minted, [HELD], spelled)), HELD, "left"), text, seq)
    return out.unionByName(rest.select(*out.columns))


def looked(text: Column, approved: Column, entries: Column, masked: Column, forms: Column) -> Column:
    """The leaks of a masked text, or null where they can't be known: spans without a vault, or a text without a masked one."""
    blind = (entries.isNull() & (F.coalesce(F.size(approved), F.lit(1)) > 0)) | (masked.isNull() & text.isNotNull())
    return F.when(~blind, F.coalesce(leaks(masked, forms), F.lit([]).cast("array<string>")))


def vault_names(minted: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., _by_key): a map from type and match key to placeholder."""
    pair = F.struct(F.concat_ws("\u0001", "entity_type", "match_key").alias("k"), F.col("placeholder").alias("v"))
    return minted.groupBy(*scope).agg(F.map_from_entries(F.collect_list(pair)).alias("_by_key"))


def counts(spans: Column) -> Column:
    """map<type, spans of it>."""
    kinds = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity_type"])))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(spans, lambda s: s["entity_type"] == k)).cast("long")))


#: Columns that masking makes; carried ones may not be named so.
MADE = ("text", "masked_text", "spans", "sealed", "leaks", "n_declined")


def carried(keep: Iterable[str], *taken: str) -> list[Column]:
    """One struct of the caller's other columns, which go along as they are; none where none are asked for."""
    keep = list(keep)
    if clash := {*MADE, *taken} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made by masking: rename yours")
    return [F.struct(*keep).alias("_kept")] if keep else []


def mask_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_chars: int = chunk.MAX_CHARS, options: dict | None = None, keep: Iterable[str] = (), **more) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, vault, variants): each document masked chunk by chunk with a vault of its own.

    documents: doc_id, text, masked_text, spans (document offsets), sealed, leaks of the whole text, n_declined, and the
    columns named in ``keep``, as they are. Rows that share a doc_id share its vault, so placeholders stay unambiguous; a row with a null doc_id has its own.
    masked_text is null where a text that isn't empty could not be masked; guard holds such rows back."""
    out, minted, spelled = mask_rows(docs, doc_id=doc_id, text=text, max_chars=max_chars, options=options, keep=keep, **more)
    own = lambda df: df.select(F.col("_scope.id").alias(doc_id), *[c for c in df.columns if c not in ("_scope", doc_id)])
    return own(out), own(minted), own(spelled)


def mask_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_chars: int = chunk.MAX_CHARS, options: dict | None = None, keep: Iterable[str] = (), **more) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As mask_documents, with ``_scope`` (struct<id, row>) instead of doc_id in all three tables. row is set where the id is
    null; structs with equal fields are equal, null ones too, so no row is lost in a join on it."""
    # the row number is fixed by mask's checkpoint, which holds all chunks of all rows; texts without chunks are in _bare
    kept = carried(keep, doc_id)
    along = ["_kept"] * len(kept)
    keyed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"), *kept).withColumn("_doc_row", F.monotonically_increasing_id())
    keyed = keyed.select("_doc_row", *along, F.struct(F.col("_id").alias("id"), F.when(F.col("_id").isNull(), F.col("_doc_row")).alias("row")).alias("_scope"), "text", F.when(F.length("text") == 0, F.col("text")).alias("_bare"))
    parts = on_first(chunk.chunks(keyed, "_doc_row", "_scope", "_bare", *along, max_chars=max_chars, outer=True, whole_words=True).withColumnRenamed("chunk_no", "seq"))
    found = detect.detect(parts, **(options or {}))
    rows, minted, spelled = mask(found, ["_scope"], **more)
    moved = F.transform("approved", lambda s: F.struct(s["entity_type"].alias("entity_type"), (s["start"] + F.col("chunk_start")).alias("start"), (s["end"] + F.col("chunk_start")).alias("end"), s["score"].alias("score"), s["value"].alias("value")))
    piece = F.struct("seq", F.col("masked_text").alias("m"), moved.alias("s"), F.col("sealed").alias("x"), F.size("declined").alias("d"), F.col("text").alias("t"))
    # rows lie by scope already, so neither this nor the join with the entries moves them again
    whole = rows.groupBy("_scope", "_doc_row").agg(F.max("_bare").alias("_bare"), *[F.first(c, ignorenulls=True).alias(c) for c in along], F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), piece))).alias("c"))
    joined = lambda k: F.array_join(F.transform("c", lambda x: x[k]), "")
    bare = F.size("c") == 0
    whole = whole.withColumn("text", F.when(bare, F.col("_bare")).otherwise(joined("t"))).withColumn("masked_text", F.when(bare, F.col("_bare")).when(~F.exists("c", lambda x: x["m"].isNull()), joined("m")))
    whole = whole.select("_scope", *along, "text", "masked_text", F.flatten(F.transform("c", lambda x: x["s"])).alias("spans"), F.flatten(F.transform("c", lambda x: x["x"])).alias("sealed"), F.aggregate("c", F.lit(0), lambda a, x: a + x["d"]).alias("n_declined"))
    whole = whole.withColumn("spans", F.coalesce("spans", detect.no_spans()))
    out = whole.join(wide(vault.entries(minted, ["_scope"], spelled)), "_scope", "left")
    out = out.withColumn("_forms", forms_of(F.col("entries"), None))
    out = out.withColumn("leaks", looked(F.col("text"), F.col("spans"), F.col("entries"), F.col("masked_text"), near(F.col("masked_text"), F.col("_forms"), sweeping=False)))
    return out.select("_scope", "text", "masked_text", "spans", F.coalesce("sealed", F.lit([]).cast("array<string>")).alias("sealed"), "leaks", F.coalesce("n_declined", F.lit(0)).alias("n_declined"), *[f"{c}.*" for c in along]), minted, spelled


def guard(masked: DataFrame, on_leak: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(released, quarantine). Fails closed: a row with a known value in it, or with a text that isn't empty and no masked
    text, is never released; ``raise`` stops the job."""
    if on_leak not in ("quarantine", "raise"):
        raise ValueError(f"on_leak must be 'quarantine' or 'raise', got {on_leak!r}")
    unsafe = unsafe_in(masked)
    bad = masked.where(unsafe)
    if on_leak == "raise" and not bad.isEmpty():
        raise ValueError("private values survived masking; refusing to release")
    return masked.where(~unsafe), bad


def on_first(parts: DataFrame) -> DataFrame:
    """Carried columns stand on a document's first chunk alone."""
    return parts.withColumn("_kept", F.when(F.coalesce("seq", F.lit(0)) == 0, F.col("_kept"))) if "_kept" in parts.columns else parts


def unsafe_in(masked: DataFrame) -> Column:
    """Whether a row must be held back: a leak, nobody looked for leaks, or a text without a masked text."""
    unsafe = F.coalesce(F.size("leaks") != 0, F.lit(True))
    if {"text", "masked_text"} <= set(masked.columns):
        unsafe = unsafe | (F.col("masked_text").isNull() & (F.coalesce(F.length("text"), F.lit(0)) > 0))
    return unsafe


def redact(df: DataFrame, vault_entries: DataFrame, scope: list[str], text: str, seq: str | None = None) -> DataFrame:
    """df with every value that the scope's vault knows replaced in a third party's text. seq: a column with the row's place in
    its scope, up to which values are known.

    Spellings and texts of a scope meet by word, as ``near`` would pick them, so no row carries its scope's whole vault; only texts in
    which a spelling that may part a word is likely are swept with all of it."""
    side = vault_entries.select(*scope, F.col("entries").alias("_entries"))
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    at = F.col(seq) if seq else None
    form = lambda e, f: F.struct(e["first_seq"].alias("first_seq"), f["seen"].alias("seen"), e["placeholder"].alias("placeholder"), f["variant"].alias("variant"), f["word"].alias("word"), f["opens"].alias("opens"))
    flat = side.select(*scope, F.posexplode(F.flatten(F.transform("_entries", lambda e: F.transform(e["forms"], lambda f: form(e, f))))).alias("_at", "_f"))
    known = lambda f: vault.is_visible(f, at) & (F.lit(True) if at is None else F.coalesce(f["seen"] <= at, F.lit(True)))
    said = rows.select("_row", *dict.fromkeys([*scope, *([seq] if seq else [])]), F.explode(F.array_distinct(words_of(F.col(text)))).alias("_word"))
    met = meet(said, flat.where("_f.word <> ''").withColumn("_word", F.col("_f.word")), scope, ["_word"]).where(known(F.col("_f")))
    own = met.groupBy("_row").agg(F.collect_list(F.struct("_at", "_f")).alias("_met"))
    loose = flat.where("_f.word = ''").groupBy(*scope).agg(F.collect_list(F.struct("_at", "_f")).alias("_loose"))
    held = meet(rows.join(wide(own), "_row", "left"), loose, scope, how="left")
    some = F.flatten(F.array_compact(F.array("_met", F.filter("_loose", lambda x: known(x["_f"])))))
    held = cut(held.withColumn("_forms", F.transform(F.array_sort(some), lambda x: x["_f"])).drop("_met", "_loose"))
    parting = F.exists("_forms", lambda f: f["opens"])
    out = held.where(~parting).withColumn(text, sweep(F.col(text), F.col("_forms"))["text"]).select(*df.columns)
    rest = held.where(parting).drop("_forms")
    if rest.isEmpty():
        return out
    rest = meet(rest, side, scope, how="left").withColumn("_forms", forms_of(F.col("_entries"), at))
    return out.unionByName(rest.withColumn(text, sweep(F.col(text), near(F.col(text), F.col("_forms")))["text"]).select(*df.columns))


def mint_corpus(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    max_chars: int = chunk.MAX_CHARS,
    options: dict | None = None,
    match: str = "normalized",
    secret: str = vault.SECRET,
    decisions: DataFrame | None = None,
    confirm_below: float = review.CONFIRM_BELOW,
    known: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(vault, variants) that mask_corpus gives for these documents, for callers who want no masked texts of them: nothing is swept
    or searched for leaks."""
    return named_in_corpus(docs, doc_id, text, max_chars, options, match, secret, decisions, confirm_below, known, ())[1:]


def named_in_corpus(docs, doc_id, text, max_chars, options, match, secret, decisions, confirm_below, known, keep) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks with their spans, vault, variants): the part of mask_corpus that finds and numbers."""
    kept = carried(keep, doc_id)
    along = ["_kept"] * len(kept)
    keyed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"), *kept).withColumn("_doc", F.monotonically_increasing_id()).withColumn("_bare", F.when(F.length("text") == 0, F.col("text")))
    parts = on_first(chunk.chunks(keyed, "_doc", "_id", "_bare", *along, max_chars=max_chars, outer=True, whole_words=True).withColumnRenamed("chunk_no", "seq"))
    rows = cut(review.decide(detect.detect(parts, **(options or {})), decisions, confirm_below=confirm_below).withColumn("_row", F.struct("_id", "_doc", "seq")))
    found = rows.select(F.col("_row").alias("seq"), F.explode("approved").alias("s")).select("seq", F.col("s.start").alias("start"), F.col("s.entity_type").alias("entity_type"), F.col("s.value").alias("value"))
    old_vault, old_forms = known or (None, None)
    minted = cut(vault.mint(found, [], match=match, secret=secret, known=old_vault))
    spelled = cut(vault.variants(found, minted, [], match, old_forms))
    return rows, minted, spelled


def mask_corpus(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    max_chars: int = chunk.MAX_CHARS,
    options: dict | None = None,
    match: str = "normalized",
    secret: str = vault.SECRET,
    decisions: DataFrame | None = None,
    confirm_below: float = review.CONFIRM_BELOW,
    known: tuple[DataFrame, DataFrame] | None = None,
    sweep_scope: str = "full",
    keep: Iterable[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, vault, variants): as mask_documents, but with one vault for all documents: a value has the same
    placeholder wherever it stands, numbered by the order of doc_id. ``known`` is the (vault, variants) of earlier calls: its
    values keep their numbers, and its spellings are swept from these documents too.

    sweep_scope ``full``: every row is swept with all values. ``causal``: a row is swept with spellings first seen in it, in a row
    before it (by doc_id and chunk; null ids first) or in an earlier run, as one vault that grows from text to text would. No scope
    has to fit a row: spans meet the vault by a shuffle join on type and match key, and spellings meet texts by the
    search for candidates, where causal is one more condition on the pairs that met; all values, later ones too, are looked
    for in the whole masked texts at the end. Null and repeated ids, null and empty texts, ``keep`` are as in mask_documents."""
    if sweep_scope not in ("causal", "full"):
        raise ValueError(f"sweep_scope must be 'causal' or 'full', got {sweep_scope!r}")
    keep = list(keep)
    along = ["_kept"] if keep else []
    rows, minted, spelled = named_in_corpus(docs, doc_id, text, max_chars, options, match, secret, decisions, confirm_below, known, keep)
    old_forms = known[1] if known else None
    # a row's distinct values meet the vault, and their placeholders come back to it as a map
    value = lambda s: F.struct(s["entity_type"].alias("entity_type"), match_key(s["value"], match).alias("match_key"))
    said = rows.select("_row", F.explode(F.array_distinct(F.transform("approved", value))).alias("k")).select("_row", "k.*")
    pair = F.struct(F.concat_ws("\u0001", "entity_type", "match_key").alias("k"), F.col("placeholder").alias("v"))
    names = said.join(wide(minted.select("entity_type", "match_key", "placeholder")), ["entity_type", "match_key"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(pair)).alias("_by_key"))
    key = lambda s: F.concat_ws("\u0001", s["entity_type"], match_key(s["value"], match))
    first = rows.join(wide(names), "_row", "left").withColumn("_first", substitute(F.col("text"), F.col("approved"), F.transform("approved", lambda s: F.try_element_at("_by_key", key(s)))))
    first = cut(first.drop("_by_key"))
    order = F.struct("first_seq", "first_start", "entity_type", "idx").alias("o")
    forms = spelled.join(wide(minted.select("entity_type", "idx", "placeholder", order)), ["entity_type", "idx"])
    if old_forms is None:
        forms = forms.withColumn("_old", F.lit(False))
    else:
        ids = ["entity_type", "idx", "variant"]
        forms = forms.join(wide(old_forms.select(*ids).distinct().withColumn("_old", F.lit(True))), ids, "left")
    forms = forms.select("variant", "variant_no", "placeholder", "o", F.col("first_seq").alias("_seen"), F.coalesce("_old", F.lit(False)).alias("_old"))
    met = corpus_leaks(first.select("_row", "_first"), spelled.select("variant"), "_row", "_first").join(wide(forms), "variant")
    if sweep_scope == "causal":
        met = met.where(F.col("_old") | (F.col("_seen") <= F.col("_row")))
    own = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("o", "variant_no", "placeholder", "variant"))).alias("_f"))
    swept = sweep(F.col("_first"), F.coalesce(F.transform("_f", lambda f: F.struct(f["placeholder"].alias("placeholder"), f["variant"].alias("variant"))), F.lit([]).cast("array<struct<placeholder:string,variant:string>>")))
    moved = F.transform("approved", lambda s: F.struct(s["entity_type"].alias("entity_type"), (s["start"] + F.col("chunk_start")).alias("start"), (s["end"] + F.col("chunk_start")).alias("end"), s["score"].alias("score"), s["value"].alias("value")))
    done = first.join(wide(own), "_row", "left").withColumn("_swept", swept)
    piece = F.struct("seq", F.col("_swept.text").alias("m"), moved.alias("s"), F.col("_swept.sealed").alias("x"), F.size("declined").alias("d"), F.col("text").alias("t"))
    whole = done.groupBy("_doc").agg(F.first("_id").alias(doc_id), F.max("_bare").alias("_bare"), *[F.first(c, ignorenulls=True).alias(c) for c in along], F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), piece))).alias("c"))
    joined = lambda k: F.array_join(F.transform("c", lambda x: x[k]), "")
    bare = F.size("c") == 0
    whole = whole.withColumn("text", F.when(bare, F.col("_bare")).otherwise(joined("t"))).withColumn("masked_text", F.when(bare, F.col("_bare")).when(~F.exists("c", lambda x: x["m"].isNull()), joined("m")))
    whole = cut(whole.select("_doc", *along, doc_id, "text", "masked_text", F.flatten(F.transform("c", lambda x: x["s"])).alias("spans"), F.flatten(F.transform("c", lambda x: x["x"])).alias("sealed"), F.aggregate("c", F.lit(0), lambda a, x: a + x["d"]).alias("n_declined")))
    left = corpus_leaks(whole.select("_doc", "masked_text"), spelled.select("variant"), "_doc", "masked_text").groupBy("_doc").agg(F.array_sort(F.collect_list("variant")).alias("leaks"))
    out = whole.join(wide(left), "_doc", "left")
    return out.select(doc_id, "text", "masked_text", "spans", "sealed", F.coalesce("leaks", F.lit([]).cast("array<string>")).alias("leaks"), "n_declined", *[f"{c}.*" for c in along]), minted, spelled
