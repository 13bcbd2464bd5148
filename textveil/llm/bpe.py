"""Byte-level BPE by corpus-level merge replay.

The distinct pieces ("words") of a large part of the corpus stand side by side in one symbol table. An inverted index
holds, for each merge rank, the positions where that pair stands. Ranks are replayed in order through a heap: the
positions of the lowest rank are merged over all words, and only the two neighbours of a merged position enter
the index anew. A worker remembers the ids of the stretches that it has met (up to a bound, after which it begins anew),
so each is split and encoded about once a worker, and texts are looked up rather than encoded.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import gather, remembered, slices, text_rows

#: Stretches (of about a word) that a worker remembers: some 150 bytes each.
MEMORY = 1_000_000
#: New stretches that are replayed together, and stretches of texts that may wait for that (4 bytes each).
TOGETHER, WAITING = 120_000, 6_000_000
#: A word of more bytes than this is replayed by itself.
LONG = 400
#: A blank between two characters that aren't white space.
BLANK, ODD = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s | \s")
NONE = np.int32(2**31 - 1)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from the lines of a rank file (base64 token, blank, rank)."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class Pairs:
    """Which two tokens make a third, as one sorted table of keys."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.width = ranks, max(ranks.values(), default=0) + 1
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        made = [(ranks[t[:i]] * self.width + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        made.sort()
        self.keys, self.made = np.array([k for k, _ in made] + [2**62], np.int64), np.array([r for _, r in made] + [NONE], np.int32)

    def find(self, a, b) -> np.ndarray:
        """The rank that each pair makes, or NONE."""
        key = np.asarray(a, np.int64) * self.width + b
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.made[at], NONE)


def replay(words: list[bytes], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """All merges in rank order over the whole list: (ids of the words in turn, where each word's begin, and the end).

    ``right`` and ``left`` link the live symbols of a word, ``rank`` is what a symbol makes with its right one. Of a
    word's positions of the rank in hand the first alone is merged at a time: if that makes a pair of a lower rank,
    the others wait for it, which keeps the order that a word by word encoder has.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    token = pairs.bytes[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    full = sizes > 0
    right[starts[1:][full] - 1] = left[starts[:-1][full]] = -1
    rank = np.full(n, NONE, np.int32)
    inner = np.flatnonzero(right >= 0)
    rank[inner] = pairs.find(token[inner], token[inner + 1])
    order = np.argsort(rank, kind="stable")[: int((rank != NONE).sum())].astype(np.int32)
    heads, first = np.unique(rank[order], return_index=True)
    index = {r: [part] for r, part in zip(heads.tolist(), np.split(order, first[1:]))}
    heap = heads.tolist()  # sorted, so a heap
    push, pop, find = heapq.heappush, heapq.heappop, pairs.find

    def enter(places: np.ndarray, ranks: np.ndarray) -> None:
        if len(places) > 1:
            by = np.argsort(ranks, kind="stable")
            places, ranks = places[by], ranks[by]
        edges = np.concatenate([[0], np.flatnonzero(ranks[1:] != ranks[:-1]) + 1, [len(ranks)]]).tolist()
        for a, b in zip(edges, edges[1:]):
            x = int(ranks[a])
            if x in index:
                index[x].append(places[a:b])
            elif x != NONE:
                index[x] = [places[a:b]]
                push(heap, x)

    while heap:
        now = pop(heap)
        parts = index.pop(now)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[rank[at] == now]  # else a neighbour has changed meanwhile
        if len(at) > 1:
            at = np.sort(at)
            own = word[at]
            later = own[1:] == own[:-1]
            if later.any():
                index[now] = [at[1:][later]]
                push(heap, now)
                at = at[np.concatenate([[True], ~later])]
        elif not len(at):
            continue
        gone = right[at]
        after, before = right[gone], left[at]
        token[at], token[gone], rank[gone], rank[at] = now, -1, NONE, NONE
        right[at] = after
        has = after >= 0
        a, after = at[has], after[has]
        left[after] = a
        rank[a] = r = find(now, token[after])
        b = before[before >= 0]
        rank[b] = s = find(token[b], now)
        if len(a) or len(b):
            enter(np.concatenate([a, b]), np.concatenate([r, s]))
    live = token >= 0
    return token[live], np.concatenate([[0], np.cumsum(live)])[starts]


def replay_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one word that may be as long as a text: its positions are merged one after another."""
    token = [word[i : i + 1] for i in range(len(word))]
    left, right = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
    heap = [(r, i) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = right[i]
        if not token[i] or j < 0 or ranks.get(token[i] + token[j]) != rank:
            continue  # a neighbour has changed meanwhile
        token[i], token[j] = token[i] + token[j], b""
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get(token[i] + token[k])) is not None:
                heapq.heappush(heap, (r, i))
        h = left[i]
        if h >= 0 and (r := ranks.get(token[h] + token[i])) is not None:
            heapq.heappush(heap, (r, h))
    return [ranks[t] for t in token if t]


def encode_words(words: list[bytes], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """As replay, with long words encoded by themselves."""
    long = [i for i, w in enumerate(words) if len(w) > LONG]
    if not long:
        return replay(words, pairs)
    alone = {i: np.array(replay_long(words[i], pairs.ranks), np.int32) for i in long}
    flat, starts = replay([b"" if i in alone else w for i, w in enumerate(words)], pairs)
    parts = [alone[i] if i in alone else flat[starts[i] : starts[i + 1]] for i in range(len(words))]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and where each begins."""
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)


class Encoder(dict):
    """Stretch of text -> its row; a row's ids are flat[starts[row] : starts[row + 1]] once ``settle`` was called.

    Texts are cut into stretches at blanks between two characters that aren't white space, with the blank in front. Where
    the pattern lets no match run over such a blank to the right (as patterns with ``" ?\\p{L}+"`` do), that changes
    nothing; for others, ``by_blank`` is switched off, and a text is one stretch."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, by_blank: bool = True):
        super().__init__()
        self.pairs, self.find, self.by_blank = Pairs(ranks), regex.compile(pattern).findall, by_blank
        by_rank = {r: t for t, r in ranks.items()}
        every = [by_rank.get(i, b"") for i in range(self.pairs.width)]
        self.token_bytes, self.token_digits = joined(every), joined([b"%d," % i for i in range(self.pairs.width)])
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list = []
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, key) -> int:
        self[key] = row = len(self)
        self.new.append(key)
        return row

    def rows(self, text: str | None) -> np.ndarray:
        """The rows of a text's stretches. The first has no blank in front: its key is a tuple."""
        if not text:
            return np.empty(0, np.int32)
        parts = [text] if not self.by_blank else BLANK.split(text) if ODD.search(text) else text.split(" ")
        parts[0] = (parts[0],)
        return np.fromiter(map(self.__getitem__, parts), np.int32, len(parts))

    def settle(self) -> None:
        """Splits and encodes the stretches met since the last time, all together."""
        if not self.new:
            return
        plain, odd = [], []
        for k in self.new:
            (plain if type(k) is str and k.split() == [k] else odd).append(k)
        pieces = self.find(" " + " ".join(plain)) if plain else []  # no white space in them: a blank begins each
        begin = [i for i, p in enumerate(pieces) if p[0] == " "]
        for k in odd:
            begin.append(len(pieces))
            pieces += self.find(k[0] if type(k) is tuple else f" {k}")
        row = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        flat, starts = encode_words([p.encode("utf-8", "surrogatepass") for p in row], self.pairs)
        own, ends = gather(flat, starts, np.fromiter(map(row.__getitem__, pieces), np.int64, len(pieces)))
        edges = np.concatenate([[0], ends])[[*begin, len(pieces)]]  # of the stretches, plain ones first
        place = {k: i for i, k in enumerate(plain + odd)}
        own, ends = gather(own, edges, np.fromiter(map(place.__getitem__, self.new), np.int64, len(self.new)))
        self.flat, self.starts = np.concatenate([self.flat, own]), np.concatenate([self.starts, self.starts[-1] + ends])
        self.new = []

    def ids(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given by their rows, and where each text begins (and the last ends)."""
        own, ends = gather(self.flat, self.starts, np.concatenate(rows)) if rows else (self.flat[:0], np.empty(0, np.int64))
        return own, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        rows = [self.rows(t) for t in texts]
        self.settle()
        ids, starts = self.ids(rows)
        return [ids[starts[i] : starts[i + 1]].tolist() for i in range(len(texts))]

    def written(self, table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, starts: np.ndarray) -> list[memoryview]:
        """The strings of the table at each text's ids, joined."""
        data, ends = gather(*table, ids)
        at, view = np.concatenate([[0], ends])[starts].tolist(), memoryview(data)
        return [view[a:b] for a, b in zip(at, at[1:])]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[memoryview]:
        return self.written(self.token_bytes, ids, starts)


def encoded(batches, encoder: Encoder):
    """(doc_id column, ids, starts) of parts of the batches. Texts wait until enough new stretches have come together."""
    held: list[tuple[pa.Array, list[np.ndarray]]] = []
    waiting = 0

    def out():
        encoder.settle()
        for names, rows in held:
            yield names, *encoder.ids(rows)

    for batch in batches:
        for at, texts in slices(batch.column(1)):
            rows = [encoder.rows(t) for t in texts]
            held.append((batch.column(0).slice(at, len(texts)), rows))
            waiting += sum(map(len, rows)) + len(rows)
            if len(encoder.new) >= TOGETHER or waiting >= WAITING:
                yield from out()
                held, waiting = [], 0
                if len(encoder) > MEMORY:
                    encoder.forget()
    yield from out()


def _encoder(data: bytes, pattern: str, by_blank: bool) -> Encoder:
    return remembered(("bpe", zlib.crc32(data), pattern, by_blank), lambda: Encoder(read_ranks(data), pattern, by_blank))


def encode(docs: DataFrame, rank_file: str, pattern: str, by_blank: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, ids array<int>). Null and empty texts have no ids; every row of
    docs gives one row, repeated ones too. rank_file is read on the driver and sent to the tasks; its size is
    the vocabulary's (under 1 MB for 50,000 tokens), whatever the corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(open(rank_file, "rb").read())

    def run(batches):
        for names, ids, starts in encoded(batches, _encoder(sent.value, pattern, by_blank)):
            yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return text_rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, data binary): the bytes that the ids stand for (null ids: none)."""
    sent = encoded.sparkSession.sparkContext.broadcast(open(rank_file, "rb").read())

    def run(batches):
        tokens = {r: t for t, r in read_ranks(sent.value).items()}
        for batch in batches:
            data = [b"".join(map(tokens.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, rank_file: str, pattern: str, by_blank: bool = True) -> DataFrame:
    """docs -> (doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, and keeps the digests
    only. A row for each row of docs, repeated ones too. A null text counts as empty, which has no ids (digests of the empty string); texts are
    encoded whole, whatever their length; an empty table gives an empty result; only doc_id and text are read."""
    sent = docs.sparkSession.sparkContext.broadcast(open(rank_file, "rb").read())

    def run(batches):
        encoder = _encoder(sent.value, pattern, by_blank)
        for names, ids, starts in encoded(batches, encoder):
            said = [hashlib.sha256(x[:-1]).hexdigest() for x in encoder.written(encoder.token_digits, ids, starts)]
            back = [hashlib.sha256(x).hexdigest() for x in encoder.decode(ids, starts)]
            yield pa.RecordBatch.from_arrays([names, pa.array(np.diff(starts), pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
