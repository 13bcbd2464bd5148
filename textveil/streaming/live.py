"""Live conversations: one vault and one history a conversation, as keyed state that grows event by event.

Events (conv_id, turn, kind, text): a ``turn`` is masked and becomes a request, a ``reply`` (to the turn of its number) is restored
and enters the history, a ``reset`` makes the history start anew from its turn on, and the vault stays.

What needs state is small: numbers for new values, the values that a reply names, the last exchanges. All else, detection, sweep,
guard, restoring, is made of the batch jobs' expressions, between two keyed steps: the first holds the vault, the second the
history. State lies in map and list variables of RocksDB, so a batch writes the entries that it touches and no others. Events of a
batch are taken by turn (at one turn: reset, turn, reply); so a run over a whole table gives what the batch jobs give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import SPANS, fold, match_key
from ..operators import conversation, detect, mask, restore

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = ("reset", "turn", "reply")
FORMS = "array<struct<placeholder:string,variant:string>>"
NAMED = f"_key string, conv_id long, turn long, kind string, text string, spans {SPANS}, names array<string>, forms {FORMS}, originals array<struct<k:string,v:string>>, late boolean"
MESSAGES = "array<struct<role:string,content:string>>"
DONE = f"conv_id long, turn long, kind string, status string, text string, masked_text string, restored string, entity_counts map<string,bigint>, sealed array<string>, leaks array<string>, history {MESSAGES}, late boolean"
#: Malformed events are dealt to so many keys.
SPREAD = 64


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed steps need the RocksDB state store: to be set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _batches(rows: Iterator[pd.DataFrame]) -> list:
    frame = pd.concat(list(rows), ignore_index=True)
    return list(frame.sort_values(["turn", "place", "text"], kind="stable").itertuples(index=False))


class Naming(StatefulProcessor):
    """The vault: numbers new values, tells each turn which known spellings may stand in it, and each reply its values."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "kind string", "n long")
        self.names = handle.getMapState("names", "kind string, key string", "placeholder string, no long")
        self.forms = handle.getMapState("forms", "placeholder string, variant string", "no long, place long, folded string")
        self.values = handle.getMapState("values", "token string", "value string, no long")
        self.seen = handle.getValueState("seen", "last long, minted long, spelled long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = _batches(rows)
        if events[0].malformed:
            yield _named([(key[0], e.conv_id, e.turn, e.kind, e.text, [], [], [], [], False) for e in events])
            return
        last, minted, spelled = self.seen.get() if self.seen.exists() else (-1, 0, 0)
        known, tally = {}, {}  # a value and a kind are asked of the state once a batch, each question being a trip to the JVM
        forms = {k: v for k, v in self.forms.iterator()} if any(e.kind == "turn" for e in events) else {}
        out = []
        for e in events:
            own, likely, said = [], [], []
            if e.kind == "turn":
                for s, k, folded in zip(e.spans, e.keys, e.folds):
                    slot = (s["entity_type"], k)
                    if slot not in known and self.names.containsKey(slot):
                        known[slot] = self.names.getValue(slot)
                    if slot in known:
                        name, no = known[slot]
                    else:
                        kind = (s["entity_type"],)
                        if kind not in tally:
                            tally[kind] = self.counts.getValue(kind)[0] if self.counts.containsKey(kind) else 0
                        tally[kind] = n = tally[kind] + 1
                        name, no, minted = f"<{s['entity_type']}_{n:03d}>", minted, minted + 1
                        known[slot] = (name, no)
                        self.names.updateValue(slot, known[slot])
                        token = (f"{s['entity_type'].upper()} {n}",)  # of types that differ in case alone, the first answers
                        if not self.values.containsKey(token):
                            self.values.updateValue(token, (s["value"], no))
                    form = (name, s["value"])
                    if form not in forms:
                        forms[form] = (no, spelled, folded)
                        self.forms.updateValue(form, forms[form])
                        spelled += 1
                    own.append(name)
                # a spelling whose fold is not in the text's can't be swept, unless it may stand in a placeholder that is put in
                hits = sorted((v[0], v[1], k) for k, v in forms.items() if v[2] in (e.folded or "") or any(c in v[2] for c in "<>_"))
                likely = [{"placeholder": p, "variant": v} for _, _, (p, v) in hits]
            elif e.kind == "reply":
                tokens = {t for t in e.tokens if self.values.containsKey((t,))}
                said = [{"k": t, "v": self.values.getValue((t,))[0]} for t in sorted(tokens)]
            out.append((key[0], e.conv_id, e.turn, e.kind, e.text, list(e.spans), own, likely, said, bool(e.kind == "turn" and e.turn <= last)))
            last = max(last, int(e.turn)) if e.kind == "turn" else last
        for kind, n in tally.items():
            self.counts.updateValue(kind, (n,))
        self.seen.update((last, minted, spelled))
        _wake(self.handle, timerValues, self.idle_ms)
        yield _named(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.counts, self.names, self.forms, self.values, self.seen):
            state.clear()  # the session is over: its vault goes
        return iter([])

    def close(self) -> None:
        pass


class Remembering(StatefulProcessor):
    """The history: what was asked and answered, masked, the last ``max_turns`` exchanges of the thread."""

    def __init__(self, max_turns: int, idle_ms: int | None = None):
        self.max_turns, self.idle_ms = max_turns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getMapState("asked", "turn long", "question string")
        self.told = handle.getListState("told", "turn long, question string, answer string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = _batches(rows)
        if events[0].malformed:
            yield _done([(*_facts(e), []) for e in events])
            return
        told = [tuple(t) for t in self.told.get()]
        before, out = list(told), []
        for e in events:
            history = []
            if e.kind == "reset":
                told = []
                for turn in [k for (k,) in self.asked.keys() if k < e.turn]:
                    self.asked.removeKey((turn,))  # a reply to a forgotten question is restored, not remembered
            elif e.kind == "turn":
                history = [m for _, q, a in told for m in ({"role": "user", "content": q}, {"role": "assistant", "content": a})]
                if e.status == "released":
                    self.asked.updateValue((int(e.turn),), (e.masked_text,))
            elif self.asked.containsKey((int(e.turn),)):
                told = [*told, (int(e.turn), self.asked.getValue((int(e.turn),))[0], e.text)][-self.max_turns :]
                self.asked.removeKey((int(e.turn),))
            out.append((*_facts(e), history))
        if told != before:
            self.told.put(told) if told else self.told.clear()
        _wake(self.handle, timerValues, self.idle_ms)
        yield _done(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.asked.clear()
        self.told.clear()
        return iter([])

    def close(self) -> None:
        pass


def _wake(handle: StatefulProcessorHandle, timerValues, idle_ms: int | None) -> None:
    """One timer a conversation, moved on by each of its batches."""
    if idle_ms:
        for old in list(handle.listTimers()):
            handle.deleteTimer(old)
        handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)


def _named(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["_key", "conv_id", "turn", "kind", "text", "spans", "names", "forms", "originals", "late"])
    return frame.astype({"conv_id": "Int64", "turn": "Int64"})


def _facts(e) -> tuple:
    return (e.conv_id, e.turn, e.kind, e.status, e.text, e.masked_text, e.restored, e.entity_counts, e.sealed, e.leaks, bool(e.late))


def _done(rows: list) -> pd.DataFrame:
    columns = ["conv_id", "turn", "kind", "status", "text", "masked_text", "restored", "entity_counts", "sealed", "leaks", "late", "history"]
    frame = pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64", "turn": "Int64"})
    return frame[[c.split()[0] for c in DONE.replace("map<string,bigint>", "map").replace(MESSAGES, "list").split(", ")]]


def _place(kind: Column) -> Column:
    return F.coalesce(F.array_position(F.lit(list(KINDS)), kind), F.lit(0)).cast("int")


def live(events: DataFrame, *, match: str = "normalized", max_turns: int = conversation.MAX_TURNS, idle_ms: int | None = None, **options) -> DataFrame:
    """events (conv_id, turn, kind, text), streaming -> a row for each (DONE), in append mode.

    status: ``released`` and ``blocked`` (turns whose masked text may, and may not, go out), ``answered`` (replies, with ``restored``),
    ``reset``, and ``malformed``: an event without conv_id, turn or known kind, or a turn or reply without text, touches no state and
    fails nothing. history: the masked messages that go out before a turn. A turn whose number isn't above the last one
    is masked like any other (numbers go on) and marked late. After ``idle_ms`` milliseconds without an event a conversation's state is
    dropped. A batch that is done again after a failure starts from the same state and gives the same rows.
    Equal turns of one batch are taken in the order of their texts."""
    named = named_events(events, match, idle_ms, **options)
    return judged(named).groupBy("_key").transformWithStateInPandas(Remembering(max_turns, idle_ms), DONE, "Append", _mode(idle_ms))


def _mode(idle_ms: int | None) -> str:
    return "ProcessingTime" if idle_ms else "None"


def named_events(events: DataFrame, match: str, idle_ms: int | None, **options) -> DataFrame:
    """The events (NAMED) with what the vault has to say about each."""
    kind = F.col("kind") if "kind" in events.columns else F.lit("turn")
    own = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"), F.col("text").cast("string").alias("text"))
    bad = F.col("conv_id").isNull() | F.col("turn").isNull() | ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) | (F.col("text").isNull() & (F.col("kind") != "reset"))
    own = own.withColumn("malformed", F.coalesce(bad, F.lit(True)))
    # a malformed event's key is none that a conversation has; its text isn't looked at
    own = own.withColumn("_key", F.when(F.col("malformed"), F.concat(F.lit("malformed "), F.pmod(F.xxhash64("text", "turn"), F.lit(SPREAD)).cast("string"))).otherwise(F.col("conv_id").cast("string")))
    # events go to their key's task before detection: a small file comes in one task, and the shuffle serves the keyed step as well
    own = own.repartition("_key")
    asked = F.when(~F.col("malformed") & (F.col("kind") == "turn"), F.col("text"))
    found = detect.detect(own.withColumn("_asked", asked), "_asked", **options)
    found = found.withColumns({"keys": F.transform("spans", lambda s: match_key(s["value"], match)), "folds": F.transform("spans", lambda s: fold(s["value"])), "folded": fold(F.col("_asked"))})
    tokens = F.when(F.col("kind") == "reply", F.array_distinct(F.transform(restore.tokens(F.col("text")), token_key)))
    found = found.withColumns({"tokens": F.coalesce(tokens, F.lit([]).cast("array<string>")), "place": _place(F.col("kind"))}).drop("_asked")
    return found.groupBy("_key").transformWithStateInPandas(Naming(idle_ms), NAMED, "Append", _mode(idle_ms))


def token_key(t: Column) -> Column:
    return F.concat_ws(" ", t["entity_type"], t["idx"].cast("string"))


def judged(named: DataFrame) -> DataFrame:
    """What stands between the two steps: substitution, sweep, guard and restoring, as in the batch jobs."""
    text, turn, malformed = F.col("text"), F.col("kind") == "turn", F.startswith(F.col("_key"), F.lit("malformed"))
    swept = F.when(turn & ~malformed, mask.sweep(mask.substitute(text, F.col("spans"), F.col("names")), F.col("forms")))
    rows = named.withColumn("_swept", swept).withColumn("masked_text", F.col("_swept.text")).withColumn("sealed", F.coalesce("_swept.sealed", F.lit([]).cast("array<string>")))
    rows = rows.withColumn("leaks", F.when(turn & F.col("masked_text").isNotNull(), mask.leaks(F.col("masked_text"), F.col("forms"))))
    values = F.map_from_entries(F.transform("originals", lambda o: F.struct(o["k"].alias("k"), F.struct(o["v"].alias("v")).alias("v"))))
    back = restore.put_back(text, restore.tokens(text), values)
    status = F.when(malformed, "malformed").when(F.col("kind") == "reset", "reset").when(F.col("kind") == "reply", "answered").when(mask.unsafe_in(rows), "blocked").otherwise("released")
    rows = rows.withColumns({"restored": F.when(~malformed & (F.col("kind") == "reply"), back), "entity_counts": mask.counts(F.col("spans")), "status": status, "place": _place(F.col("kind")), "malformed": malformed})
    return rows.select("_key", "conv_id", "turn", "kind", "status", "text", "masked_text", "restored", "entity_counts", "sealed", F.coalesce("leaks", F.lit([]).cast("array<string>")).alias("leaks"), "late", "place", "malformed")


def answered(requests: DataFrame, replies: DataFrame, within: str = "10 minutes", late_by: str = "10 minutes") -> DataFrame:
    """Requests (conv_id, turn, asked_at) and replies (conv_id, turn, answered_at, answer), two streams, joined: status ``answered`` (a reply
    at most ``within`` after its request), ``missing`` (a request without one) or ``late`` (a reply without a request so near). The last two
    come out when the watermark, late_by behind the newest events, has passed them; state is held no longer. Other columns of
    both sides go along; null conv_ids and turns match nothing."""
    # two streams' keys are compared byte by byte, nulls too: a row without a key gets one that the other side has not
    mark = lambda df, name, own: df.withColumn(name, F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), own).otherwise(0))
    asked = mark(requests.withWatermark("asked_at", late_by), "_bare", 1).withColumnsRenamed({"conv_id": "_conv", "turn": "_turn"})
    told = mark(replies.withWatermark("answered_at", late_by), "_empty", 2)
    near = (F.col("_bare") == F.col("_empty")) & (F.col("_conv") == F.col("conv_id")) & (F.col("_turn") == F.col("turn")) & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {within}"))
    both = asked.join(told, near, "full_outer")
    status = F.when(F.col("asked_at").isNull(), "late").when(F.col("answered_at").isNull(), "missing").otherwise("answered")
    rows = both.withColumns({"status": status, "conv_id": F.coalesce("conv_id", "_conv"), "turn": F.coalesce("turn", "_turn")})
    return rows.drop("_conv", "_turn", "_bare", "_empty")
