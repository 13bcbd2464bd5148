"""The library's whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import conversation, detect, mask, restore, vault
from ..operators.chunk import MAX_CHARS
from ..functions.joins import meet
from ..functions.lineage import cut, wide
from ..sources import publish, refuse_existing
from ..sources.files import write_files


def mask_corpus(
    docs: DataFrame,
    out: str,
    vault_out: str,
    *,
    one_vault: bool = False,
    known: tuple[DataFrame, DataFrame] | None = None,
    keep: tuple[str, ...] = (),
    files: bool = False,
    root: str = "",
    on_leak: str = "quarantine",
    overwrite: bool = False,
    max_chars: int = MAX_CHARS,
    **options,
) -> DataFrame:
    """Masks documents and writes what is safe; returns the quarantine (doc_id, number of leaks; null where nobody could look).

    one_vault: one vault for all documents (with ``known``, the vault and variants of earlier runs, it goes on) instead of one for
    each. keep: other columns of docs that are written along, as they are: name none that holds private values. files: a masked
    copy of each file (doc_id is its path, kept below ``root``) instead of a table.

    Destinations are looked at before any work is done, leaks before anything is written, and masked texts and vault, which
    goes to a place of its own, are written both or neither."""
    spark = docs.sparkSession
    if known and not one_vault:
        raise ValueError("earlier vaults can only be gone on with by one vault for all documents (one_vault=True)")
    if not overwrite:
        refuse_existing(spark, vault_out, *([] if files else [out]))
    work = (lambda **x: mask.mask_corpus(docs, known=known, **x)) if one_vault else (lambda **x: mask.mask_documents(docs, **x))
    masked, minted, spelled = work(max_chars=max_chars, keep=keep, **options)
    masked = cut(masked)  # read by the guard, by the writer and by whoever looks into the quarantine
    released, held = mask.guard(masked, on_leak)
    safe = released.select("doc_id", "masked_text", *keep)
    tables = {f"{vault_out}/vault": minted, f"{vault_out}/variants": spelled}
    if files:
        publish(spark, tables, overwrite=overwrite, before=lambda: write_files(spark, safe, out, root=root, overwrite=overwrite))
    else:
        publish(spark, {out: safe, **tables}, overwrite=overwrite)
    return held.select("doc_id", F.size("leaks").alias("n_leaks"))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, masked_text, restored, n_canonicalized, verdict) of masking and restoring every document."""
    masked, minted, spelled = mask.mask_rows(docs, **options)
    back = restore.restore(masked.select("_scope", "text", "masked_text"), minted, ["_scope"], text="masked_text")
    many = vault.canonicalized(spelled, minted, ["_scope"]).groupBy("_scope").agg(F.count(F.lit(1)).alias("n_canonicalized"))
    out = back.join(wide(many), "_scope", "left").withColumn("n_canonicalized", F.coalesce("n_canonicalized", F.lit(0)))
    return out.select(F.col("_scope.id").alias("doc_id"), "masked_text", "restored", "n_canonicalized", restore.verdict(F.col("text"), F.col("restored"), F.col("n_canonicalized")).alias("verdict"))


def mask_conversations(turns: DataFrame, *, roles: tuple[str, ...] | None = ("user",), **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(masked turns, vault, variants) of turns (conv_id, turn, role, text): one vault a conversation, each turn seeing the
    values of its own and earlier turns. roles: whose turns are masked (None: all).

    Turns with a null conv_id are one conversation. A null turn is swept with all that its conversation knows, and what stands in it
    is known to every turn. Repeated turns see each other. Turns of other roles, and of none where roles are given, don't come back."""
    own = turns.where(F.col("role").isin(*roles)) if roles else turns
    found = detect.detect(own.withColumn("seq", F.col("turn").cast("int")))
    return mask.mask(found, ["conv_id"], **options)


def requests_of(masked: DataFrame, replies: DataFrame, system_prompt: str, max_turns: int = conversation.MAX_TURNS, resets: DataFrame | None = None) -> DataFrame:
    """Outbound requests of masked turns: only released turns that got a reply (conv_id, turn, answer) enter later histories. What
    the guard would hold back is in no request. Null conv_ids and turns meet their replies like others.
    resets (conv_id, turn): turns before which the conversation's thread, not its vault, was forgotten."""
    asked = masked.select("conv_id", "turn", F.col("masked_text").alias("question"), (~mask.unsafe_in(masked)).alias("released"))
    rows = meet(asked, replies.select("conv_id", "turn", "answer"), ["conv_id", "turn"], how="left")
    rows = rows.withColumn("ok", F.col("released") & F.col("answer").isNotNull())
    keys = ["conv_id"]
    if resets is not None:
        rows, keys = conversation.with_threads(rows, resets), ["conv_id", "thread"]
    return conversation.requests(conversation.with_history(rows, keys, max_turns), system_prompt).where("released")


def restore_replies(replies: DataFrame, minted: DataFrame) -> DataFrame:
    """replies (conv_id, turn, answer) with ``restored``: each with its conversation's vault as of its turn."""
    return restore.restore(replies, minted, ["conv_id"], text="answer", seq="turn")


def describe_failures(failures: DataFrame, minted: DataFrame, spelled: DataFrame) -> DataFrame:
    """failures (conv_id, turn, error_class, error_message) with ``error``: a sentence that may be logged. The provider's own
    words can repeat what was sent, so every value that the conversation knows by that turn is replaced in them."""
    told = failures.withColumn("error", conversation.failure_reason(F.col("error_class"), F.col("error_message")))
    return mask.redact(told, vault.entries(minted, ["conv_id"], spelled), ["conv_id"], "error", "turn")
