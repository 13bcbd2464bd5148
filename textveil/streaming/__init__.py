"""Live conversations: one vault a conversation, kept as state, growing turn by turn.

``live`` has the whole job (requests, replies, resets, history), ``sinks`` where its rows go; mask_turns here masks turns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .live import named_events, judged, use_rocksdb


def mask_turns(turns: DataFrame, *, match: str = "normalized", idle_ms: int | None = None, **options) -> DataFrame:
    """turns (conv_id, turn, text), streaming -> conv_id, turn, masked_text, sealed, n_leaks, late, status.

    Fails closed: masked_text is null where the guard holds a turn back (status ``blocked``) and for turns without conv_id, turn or
    text (``malformed``), which touch no state. A turn whose number isn't above the last one seen is masked like any other (numbers
    go on) and marked late. A replayed batch gives the same numbers. After ``idle_ms`` milliseconds without a turn a
    conversation's vault is dropped, and a later turn starts a new one; without it vaults stay. The state store must be RocksDB
    (use_rocksdb), which writes the entries that a batch touches."""
    rows = judged(named_events(turns.select("conv_id", "turn", "text"), match, idle_ms, **options))
    return rows.select("conv_id", F.col("turn").cast("int").alias("turn"), F.when(F.col("status") == "released", F.col("masked_text")).alias("masked_text"), "sealed", F.size("leaks").alias("n_leaks"), "late", "status")


__all__ = ["mask_turns", "use_rocksdb"]
