"""Secret scans: an Aho-Corasick keyword automaton over the whole text, anchored expressions only where a
keyword stands, then checks of what the secret itself carries (embedded checksums, entropy, structure).

The hexadecimal kind has no keyword; its anchors are found by probing every 24th byte (a run of 24 holds one
of them) and narrowing by the neighbours of those.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_rows

BASE = ("assign", "access", "hex")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN = 24


def _crc62(body: bytes) -> bool:
    """Tokens of this family end in six base-62 digits: the CRC-32 of the thirty characters before."""
    secret, n, said = body[-36:-6], zlib.crc32(body[-36:-6]), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        said = B62[r] + said
    return len(secret) == 30 and said.encode() == body[-6:]


def _jwt(body: bytes) -> bool:
    head = body.split(b".")[0]
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4))), dict)
    except (binascii.Error, ValueError):
        return False


def _varied(body: bytes) -> bool:
    return len(set(body)) >= 8


#: (kind, keyword in lower case, expression anchored at the keyword, length of the least match, check).
#: Order is the order of kinds at equal starts. The first three kinds are the base; no check drops them.
KINDS = (
    *(("assign", k, re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I), 6, None) for k in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")),
    ("access", b"akia", re.compile(rb"AKIA[A-Z0-9]+"), 20, None),
    *(("forge_token", k, re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), 40, _crc62) for k in (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
    ("registry_token", b"npm_", re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), 40, _crc62),
    ("jwt", b"eyj", re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 30, _jwt),
    ("chat_token", b"xox", re.compile(rb"xox[abprs]-[0-9A-Za-z-]{20,}"), 25, _varied),
    ("payment_key", b"sk_live_", re.compile(rb"sk_live_[0-9A-Za-z]{24,}"), 32, _varied),
    ("maps_key", b"aiza", re.compile(rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), 39, _varied),
    ("private_key", b"-----begin", re.compile(rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?"), 27, None),
)
ORDER = {k: i for i, k in enumerate(dict.fromkeys([*BASE, *(k[0] for k in KINDS)]))}
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for keyword in dict.fromkeys(k[1] for k in KINDS):
        found.add_word(keyword.decode(), (len(keyword), [k for k in KINDS if k[1] == keyword]))
    found.make_automaton()
    return found


def hex_runs(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of the runs of 24 and more of 0-9a-f."""
    a = np.frombuffer(data, np.uint8)
    at = np.arange(HEX_RUN - 1, len(a), HEX_RUN)
    at = at[HEX[a[at]]]
    for step in (1, 2, 3):  # a run of 24 reaches three bytes to one side at least
        near_left, near_right = HEX[a[at - step]], HEX[a[np.minimum(at + step, len(a) - 1)]]
        at = at[near_left | near_right]
    out, end = [], -1
    for p in at.tolist():
        if p < end:
            continue
        s = e = p
        while s > 0 and HEX[a[s - 1]]:
            s -= 1
        while e < len(a) and HEX[a[e]]:
            e += 1
        end = e
        if e - s >= HEX_RUN:
            out.append((s, e))
    return out


def scan(text: str, words) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind."""
    data = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, int, str]] = []
    ends: dict[str, int] = {}
    for last, (n, kinds) in words.iter(data.translate(LOWER).decode("latin-1")):
        start = last - n + 1
        for kind, _, pattern, least, check in kinds:
            if start < ends.get(kind, 0):
                continue  # leftmost, non-overlapping
            m = pattern.match(data, start)
            if m:
                ends[kind] = m.end()
                size = len(m[2]) if kind == "assign" else m.end() - start
                if size >= least and (check is None or check(m[0])):
                    found.append((start, ORDER[kind], m.end(), kind))
    found += [(s, ORDER["hex"], e, "hex") for s, e in hex_runs(data)]
    found.sort()
    if not found:
        return []
    if len(data) == len(text):
        return [(k, s, e) for s, _, e, k in found]
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))  # code points before each byte
    return [(k, int(chars[s]), int(chars[e])) for s, _, e, k in found]


SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, spans), spans by start, then kind; a row for each row of docs.
    Null and empty texts have none. Offsets count code points, the end is exclusive."""

    def run(batches):
        words = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t or "", words)] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(spans, kind)], names=["doc_id", "spans"])

    return text_rows(docs).mapInArrow(run, SPANS)


def said(spans, kinds=None):
    """A column of kind:start:end, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, the counts of base finds, base_sha256 and all spans; a row for each row of docs, repeated ones
    too. Null and empty texts hold no secret (the digest is that of the empty string); texts are read whole; of finds at one place the
    listed kinds' order decides; an empty table gives an empty result; only doc_id and text are read."""
    found = find_secrets(docs)
    n = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in BASE]
    return found.select("doc_id", *n, F.sha2(said(F.col("spans"), BASE), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def hidden(text: str | None, words) -> str | None:
    """The text with every secret's place taken by a mark."""
    parts, at = [], 0
    for kind, s, e in scan(text, words) if text else ():
        if s >= at:
            parts += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return text if at == 0 else "".join(parts) + text[at:]


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with each secret replaced by ``[kind]`` (overlapping spans by one mark, the first's) and n_chars
    counted anew where docs have it. All columns stay; null texts stay null."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        words = automaton()
        parts = [pa.array([hidden(t, words) for t in own], pa.string()) for _, own in slices(texts)]
        return pa.concat_arrays(parts or [pa.array([], pa.string())])

    out = docs.withColumn(text, clean(F.col(text).cast("string")))
    return out.withColumn(n_chars, F.length(text).cast(dict(docs.dtypes)[n_chars])) if n_chars in docs.columns else out


__all__ = ["BASE", "KINDS", "automaton", "find_secrets", "hex_runs", "redact", "report", "said", "scan"]
