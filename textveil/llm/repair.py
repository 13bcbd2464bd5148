"""Repair of damaged conversations by the cheapest edits of their turns.

Method. A conversation's rows and the places where roles may stand form a lattice: nodes are (rows read, state of the roles given
out), edges are edits. Keep costs 0, Rerole 1, Delete 2 (blank rows and duplicates can only be deleted), Insert of an
empty user or assistant row 5; a truncated row that stays adds 5. Two Dijkstra searches run over it, one from the start and one
back from the ends; when they have met, both go on until no crossing of the same cost can be missing, and of all cheapest
crossings the least concatenated audit (the edits' initials in order) is taken.

A node's label is cost and audit. Of two audits of the same cost that reach the same node, none is the beginning of the other
(the rest would be inserts alone, which cost), so the lesser audit stays the lesser one whatever follows, and one label a
node is enough. Edges that cost nothing read a row, so nodes of one cost are settled in the order of rows.

Long conversations are searched in segments of SEGMENT rows, from each state that the edits before can be in to each state, and
the segments' results are put together; so work grows with a conversation's length, not its square. A conversation's rows stream
through one task in their order, as the contract's hash runs over its text from the first row to the last: a row is held as
one small code, texts wait in a file of the task's own beyond SPOOL bytes, and 32 bytes for each different row tell duplicates.

Edge cases. Where a string is needed, a null conv_id, turn, role or text stands for one space; a null conv_id is a conversation
of its own. Rows of one turn come in the order of role and text, null turns first. An empty role has no initial and can't be
kept. Repeated rows are rows. A conversation whose rows are all dropped has zeros and an empty audit; an empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prices of the edits and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: Rows that are searched at once, bytes of a conversation's texts that are held in memory, results that a worker remembers.
SEGMENT, SPOOL, REMEMBERED = 64, 4_000_000, 20_000
#: States of the roles given out, for ``(s?(ua)+)?``: none yet, after the system row, after a user row, after an assistant row.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Which initial leads from a state to which.
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (NONE, ASSISTANT)
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
LEGAL = ("su", "ua", "au")
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def edits(code: str, state: int):
    """(audit letter, price, next state) of what may be done with a row. code: the row's role initial (if any) behind its fault,
    ``-`` (none), ``x`` (blank or duplicate) or ``t`` (truncated)."""
    yield "D", DELETE, state
    if code[0] != "x":
        short = CUT_SHORT if code[0] == "t" else 0
        for letter, to in ((c, NEXT[s, c]) for s, c in NEXT if s == state):
            if letter != "s":
                yield "R", REROLE + short, to
            if code[1:] == letter:
                yield "K", KEEP + short, to


def inserts(state: int):
    return ((INSERT, NEXT[s, c]) for s, c in NEXT if s == state and c != "s")


@lru_cache(REMEMBERED)
def between(codes: tuple[str, ...], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of these rows that lead from a state to one of ``ends``, the least audit of those; None if
    there is no way."""
    n = len(codes)
    onward, back = {(0, start): (0, "")}, {(n, s): (0, "") for s in ends}
    ahead, behind = [(0, 0, start)], [(0, -n, s) for s in ends]
    settled_on, settled_back = set(), set()
    reached: dict[int, list] = {}
    for s in range(4):
        for price, to in inserts(s):
            reached.setdefault(to, []).append((price, s))
    best = None

    def relax(table, heap, other, node, label, key):
        nonlocal best
        if node not in table or label < table[node]:
            if node not in table or label[0] < table[node][0]:
                heapq.heappush(heap, (label[0], key, node[1]))
            table[node] = label
        if node in other:
            cost = table[node][0] + other[node][0]
            best = cost if best is None or cost < best else best

    # all crossings of the least cost are there once the two nearest open nodes are together farther than it
    while ahead and behind and (best is None or ahead[0][0] + behind[0][0] <= best):
        if ahead[0][0] <= behind[0][0]:
            cost, i, s = heapq.heappop(ahead)
            if (i, s) in settled_on or cost > onward[i, s][0]:
                continue
            settled_on.add((i, s))
            audit = onward[i, s][1]
            for price, to in inserts(s):
                relax(onward, ahead, back, (i, to), (cost + price, audit + "I"), i)
            if i < n:
                for letter, price, to in edits(codes[i], s):
                    relax(onward, ahead, back, (i + 1, to), (cost + price, audit + letter), i + 1)
        else:
            cost, i, s = heapq.heappop(behind)
            i = -i
            if (i, s) in settled_back or cost > back[i, s][0]:
                continue
            settled_back.add((i, s))
            audit = back[i, s][1]
            for price, origin in reached.get(s, ()):
                relax(back, behind, onward, (i, origin), (cost + price, "I" + audit), -i)
            if i:
                for origin in range(4):
                    for letter, price, to in edits(codes[i - 1], origin):
                        if to == s:
                            relax(back, behind, onward, (i - 1, origin), (cost + price, letter + audit), 1 - i)
    crossings = [(onward[v][0] + back[v][0], onward[v][1] + back[v][1]) for v in onward.keys() & back.keys()]
    return min(crossings) if crossings else None


def cheapest(codes: list[str], segment: int = SEGMENT) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    if len(codes) <= segment:
        return between(tuple(codes), NONE, ENDS)
    labels = {NONE: (0, "")}
    for at in range(0, len(codes), segment):
        part, after = tuple(codes[at : at + segment]), {}
        for to in range(4):
            ways = [(cost + w[0], audit + w[1]) for s, (cost, audit) in labels.items() if (w := between(part, s, (to,)))]
            if ways:
                after[to] = min(ways)
        labels = after
    return min(labels[s] for s in ENDS if s in labels)


class Conversation:
    """What is held of one conversation while its rows stream by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.seen = conv_id, [], set()
        self.faults, self.illegal, self.least, self.most, self.n_turns, self.before = dict.fromkeys(FAULTS, 0), 0, None, None, 0, None
        self.file = tempfile.SpooledTemporaryFile(SPOOL)

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.n_turns += turn != self.most
            self.most = turn
        said = text.strip(BLANKS)
        whole = f"{role}\0{text}".encode("utf-8", "surrogatepass")
        digest = hashlib.sha256(len(role).to_bytes(8) + whole).digest()
        fault = "blank" if not said else "duplicate" if digest in self.seen else "truncated" if said[-1] not in ".!?" else None
        self.seen.add(digest)
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        self.codes.append(("t" if fault == "truncated" else "x" if fault else "-") + role[:1])
        for part in (role, text):
            raw = part.encode("utf-8", "surrogatepass")
            self.file.write(len(raw).to_bytes(8) + raw)

    def _rows(self):
        self.file.seek(0)
        for _ in self.codes:
            yield tuple(self.file.read(int.from_bytes(self.file.read(8))) for _ in range(2))

    def repaired(self, audit: str):
        """(role, text) as bytes, row by row."""
        rows, state = self._rows(), NONE
        for letter in audit:
            role, text = next(rows) if letter != "I" else (b"", b"")
            if letter == "D":
                continue
            initial = role[:1].decode("ascii", "replace") if letter == "K" else next(c for s, c in NEXT if s == state and c != "s")
            state = NEXT[state, initial]
            yield (role if letter == "K" else b"user" if initial == "u" else b"assistant"), text

    def result(self) -> tuple:
        cost, audit = cheapest(self.codes)
        out, first = hashlib.sha256(), True
        for role, text in self.repaired(audit):
            out.update((b"" if first else b"\n") + role + b":" + text)
            first = False
        self.file.close()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.n_turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, cost, audit, out.hexdigest())


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of conversations as the contract damages them. Rows that it drops stay, marked as gone, so
    that no conversation is lost with its last row."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("d"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("d").isin(0, 1), "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("d") == 0).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")


def _stream(batches):
    """Rows sorted by conversation and place -> a row for each conversation."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    current, out = None, []

    def batch_of(done):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, c in zip(names, zip(*done))], names)

    for batch in batches:
        for conv, turn, role, text, gone in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if current is None or current.conv_id != conv:
                if current:
                    out.append(current.result())
                current = Conversation(conv)
            if not gone:
                current.add(turn, role, text)
        if out:
            yield batch_of(out)
            out = []
    if current:
        yield batch_of([current.result()])


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) -> RESULT: for each conversation its faults, the cheapest repair and the repaired text's
    hash. ``gone`` marks rows that only name their conversation."""
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    return rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_stream, RESULT)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The contract's query: conversations are damaged by their keys' checksums, then repaired."""
    return repair(damaged(conversations))


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the repaired rows themselves, of conversations as they are (not damaged)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))

    def run(batches):
        names, current = ["conv_id", "pos", "role", "text"], None

        def out(conv):
            found = [(conv.conv_id, k, r.decode("utf-8", "surrogatepass"), t.decode("utf-8", "surrogatepass")) for k, (r, t) in enumerate(conv.repaired(cheapest(conv.codes)[1]))]
            conv.file.close()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names) if found else None

        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if current is None or current.conv_id != conv:
                    if current and (done := out(current)):
                        yield done
                    current = Conversation(conv)
                current.add(turn, role, text)
        if current and (done := out(current)):
            yield done

    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    return own.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, "conv_id long, pos long, role string, text string")
