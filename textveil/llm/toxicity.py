"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into symbols: insult, violence, speaker (first person or intent), target (someone spoken to or of),
negation, reported speech, or other. Five clause transducers are composed with each other, in one table: negation marks an insult
or violence within its reach, reported speech marks those after it in the clause, violence is a threat if a speaker stands before it and a
target next to it, and a target near an insult makes it an attack. Running the composed table over a clause gives the
weight of each kind of matched pattern; documents are scored by a logistic model over the sums for all clauses, in which
denied and reported patterns can't count against a document.

Edge cases. Null, empty and wordless texts match no pattern and get the score of such; repeated rows and ids are scored row by row; texts
are read whole; an empty table gives an empty result; extra columns are not read.

Insults (whole words and word stems), all weights and further reporting words are learned from the labels of a bounded
sample; threat, target, negation and first reporting words are given lists. What sampled documents teach is counted in
tasks: the driver gets counts of the words that may be insults, and a feature vector of each document.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remembered, slices, text_rows

#: Bounds of the training sample, and from which score on a document counts as toxic.
TOXIC_SAMPLE, CLEAN_SAMPLE, TOXIC = 1200, 2400, 0.7
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
STEMS = range(3, 9)
#: An insult stands in so many toxic texts at least, and is so many times likelier there.
LEAST_TEXTS, TIMES = 4, 20
#: Given words of the grammar (fixed values), in the corpus's four languages.
THREATS = "kill hurt beat destroy smash strangle murder töte töten umbringen verprügeln zerstöre tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself du dich dir dein deine ihr euch tu toi te ton vous votre tú ti tus usted ustedes he she they him her them".split()
SPEAKERS = "i we ich wir je nous yo nosotros will shall gonna going werde werden vais allons voy vamos".split()
#: Verbs that say who threatens by their form.
SPOKEN = "tuerai frapperai détruirai mataré golpearé destruiré".split()
NEGATIONS = "not never no nor neither nicht kein keine nie niemals ne pas jamais nunca jamás tampoco ni".split()
REPORTS = "said says wrote quoted quotes called claimed reported sagte sagt schrieb berichtete dit écrit affirme dijo dice escribió afirmó".split()
KINDS = ("attack", "insult", "denied", "reported", "threat")
#: Words that a worker remembers: some 110 bytes each.
MEMORY = 300_000
END = ".!?;\n"


class Transducer:
    """A deterministic weighted transducer: move(state, symbol) -> (state, symbol out, weight)."""

    def __init__(self, start, move):
        self.start, self.move = start, move

    def compose(self, other: "Transducer") -> "Transducer":
        """What this gives out goes into the other; weights add."""

        def move(state, symbol):
            a, mid, w1 = self.move(state[0], symbol)
            b, out, w2 = other.move(state[1], mid)
            return (a, b), out, w1 + w2

        return Transducer((self.start, other.start), move)

    def table(self, symbols: str) -> tuple[list[dict], int]:
        """All reachable states' moves: [symbol -> (state number, out, weight)]."""
        number, queue, rows = {self.start: 0}, [self.start], []
        for state in queue:
            row = {}
            for s in symbols:
                to, out, w = self.move(state, s)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                row[s] = (number[to], out, w)
            rows.append(row)
        return rows, 0


def _negation(state: int, s: str):
    if s == "N":
        return 3, "o", 0.0
    if s in "ITV" and state:
        return state - 1, "i" if s == "I" else "t", 0.0  # denied
    return max(0, state - 1), s, 0.0


#: How far a speaker reaches ahead to violence, violence to its target, and a target that stands before its verb.
SPEAKER_REACH, VERB_REACH, TARGET_REACH = 6, 3, 2


def _threat(state: tuple[int, int, int], s: str):
    """state: for how many more words a speaker, a threatening verb, and a target before it are near."""
    speaker, verb, target = (max(0, x - 1) for x in state)
    if s == "P":
        return (SPEAKER_REACH, verb, target), "o", 0.0
    if s in "TV":
        if not (speaker or s == "V"):
            return (speaker, verb, target), "o", 0.0
        return ((speaker, 0, 0), "H", 0.0) if target else ((speaker, VERB_REACH, 0), "o", 0.0)
    if s == "Y":
        return ((speaker, 0, 0), "H", 0.0) if verb else ((speaker, verb, TARGET_REACH), s, 0.0)
    return (speaker, verb, target), s, 0.0


def _reported(state: int, s: str):
    if s == "R":
        return 1, "o", 0.0
    return state, {"I": "q", "T": "q", "V": "q"}.get(s, s) if state else s, 0.0


def _target(state: int, s: str):
    if s in "YH":
        return 4, "o" if s == "Y" else s, 0.0
    return max(0, state - 1), "A" if s == "I" and state else s, 0.0


def _weigh(state: int, s: str):
    return 0, s, {"A": 1.5, "I": 1.0, "i": 1.0, "t": 1.0, "q": 1.0, "H": 1.0}.get(s, 0.0)


SYMBOLS = "ITVPYNRo"
GRAMMAR, START = Transducer(0, _negation).compose(Transducer(0, _reported)).compose(Transducer((0, 0, 0), _threat)).compose(Transducer(0, _target)).compose(Transducer(0, _weigh)).table(SYMBOLS)
KIND = {"A": 0, "I": 1, "i": 2, "t": 2, "q": 3, "H": 4}
#: Kinds whose share of the text counts, and those that may only excuse.
GUILTY, EXCUSING = [0, 1, 4], [2, 3]


class Lexicon(dict):
    """Word -> symbol, remembered up to a bound; ``weights`` has the insults' own weights. A colon parts no clauses, as what
    is reported may follow it."""

    def __init__(self, stems: dict[str, float], words: dict[str, float], reports: tuple[str, ...] = ()):
        super().__init__()
        self.stems, self.words, self.weights = stems, words, {}
        self.given = dict.fromkeys(END, ".") | {w: "Y" for w in TARGETS} | {w: "P" for w in SPEAKERS} | {w: "N" for w in NEGATIONS} | dict.fromkeys((*REPORTS, *reports), "R") | {w: "T" for w in THREATS} | {w: "V" for w in SPOKEN}

    def __missing__(self, token: str) -> str:
        if len(self) > MEMORY:
            self.clear()
        best = max([self.words.get(token, 0.0), *(self.stems.get(token[:n], 0.0) for n in STEMS if n <= len(token))])
        if best > 0:
            self.weights[token] = best
        self[token] = symbol = "I" if best > 0 else self.given.get(token, "o")
        return symbol


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Summed weights of each kind of matched pattern over all clauses, and their share of the text; in logarithms."""
    out = np.zeros(len(KINDS) + 1)
    tokens = TOKEN.findall((text or "").lower())
    symbols = "".join(map(lexicon.__getitem__, tokens))
    if not any(s in symbols for s in "ITV"):
        return out
    at = 0
    for clause in symbols.split("."):
        if any(s in clause for s in "ITV"):
            state = START
            for i, s in enumerate(clause):
                state, made, w = GRAMMAR[state][s]
                if made in KIND:
                    out[KIND[made]] += w * lexicon.weights.get(tokens[at + i], 1.0)
        at += len(clause) + 1
    out[-1] = 100 * out[GUILTY].sum() / len(tokens)
    return np.log1p(out)


def hash_of(word: str, k: int) -> int:
    return xxhash.xxh32_intdigest(word, seed=k)


def marks_of(words: list[str]) -> list[int]:
    """Eight minimum hashes of a text's 4-word shingles."""
    shingles = [hash_of(" ".join(words[i : i + 4]), 0) for i in range(max(1, len(words) - 3))]
    return [min((x * (2 * k + 1) * 0x9E3779B1 >> 7) & 0xFFFFFFFF for x in shingles) for k in range(8)]


def _distinct(rows: list[tuple[int, list[int]]]) -> list[int]:
    """Ids of texts (id, marks), near copies once: texts that agree in half of their marks are one."""
    seen: list[set] = [set() for _ in range(8)]
    out = []
    for i, marks in rows:
        if sum(m in s for m, s in zip(marks, seen)) < 4:
            out.append(i)
        for m, s in zip(marks, seen):
            s.add(m)
    return out


def certain(n: int, c: int, share: float) -> float:
    """The G statistic of n in one class and c in the other, of which the first has this share."""
    return 2 * sum(x * math.log(x / e) for x, e in ((n, (n + c) * share), (c, (n + c) * (1 - share))) if x)


def learn_lexicon(words: dict[str, tuple[int, int]], stems: dict[str, tuple[int, int]], toxic: int, clean: int, least: float = 20.0) -> tuple[dict[str, float], dict[str, float]]:
    """(stems, words) with their weights, of words and stems with the numbers of toxic and clean texts that hold them, among so
    many. The weight is the log of how much likelier they stand in toxic texts. Taken are those
    twenty times likelier there whose likelihood ratio (the G statistic) rules out chance among so many words."""
    share = toxic / max(1, toxic + clean)

    def chosen(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
        weigh = {k: math.log((n + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for k, (n, c) in counts.items() if n >= LEAST_TEXTS}
        return {k: w for k, w in weigh.items() if w >= math.log(TIMES) and certain(*counts[k], share) >= least}

    good, own = chosen(stems), chosen(words)
    # of a stem and a longer form that is as frequent, the longer one; else the shorter, if it is as sure
    longer = {k: max((t[q][0] for found, t in ((good, stems), (own, words)) for q in found if len(q) > len(k) and q.startswith(k)), default=0) for k in good}
    good = {k: w for k, w in good.items() if longer[k] < 0.9 * stems[k][0]}
    good = {k: w for k, w in good.items() if not any(good.get(k[:n], 0) >= w - 0.3 for n in STEMS if n < len(k))}
    own = {k: w for k, w in own.items() if not any(good.get(k[:n], 0) >= w - 0.3 for n in STEMS if n <= len(k))}
    return good, own


def said_before(text: str | None, lexicon: Lexicon) -> set[str]:
    """The plain words that stand before an insult in its clause."""
    tokens = TOKEN.findall((text or "").lower())
    out: set[str] = set()
    clause: list[str] = []
    for t in tokens:
        s = lexicon[t]
        if s == ".":
            clause = []
        elif s == "I":
            out.update(clause)
        elif s == "o" and t != ":":
            clause.append(t)
    return out


def learn_reports(toxic: list[set[str]], clean: list[set[str]], least: float = 20.0) -> tuple[str, ...]:
    """Words that make an insult after them harmless: of the texts with an insult, those where they stand before it are
    mostly clean, and more surely than chance."""
    t, c = Counter(w for s in toxic for w in s), Counter(w for s in clean for w in s)
    share = len(clean) / max(1, len(toxic) + len(clean))
    return tuple(sorted(w for w, n in c.items() if n >= 4 and n > 3 * t[w] and certain(n, t[w], share) >= least))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton-free gradient steps, both classes of equal weight; kinds that excuse never weigh above 0."""
    w, b = np.zeros(x.shape[1]), 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = (p - y) * weight
        w -= 2.0 * (x.T @ d + 1e-4 * w)
        w[EXCUSING] = np.minimum(w[EXCUSING], 0.0)
        b -= 2.0 * d.sum()
    return w, b


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def weighs(doc_id: int) -> bool:
    """A third of the sample weighs patterns that the other two thirds have taught."""
    return hash_of(str(doc_id), 9) % 3 == 0


def _study(sample: DataFrame) -> DataFrame:
    """(doc_id, toxic, marks, words) of each sampled text."""

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                rows = [[w for w in TOKEN.findall(t.lower()) if w not in ".!?;:\n"] for t in texts]
                out = [pa.array([marks_of(w) for w in rows], pa.list_(pa.int64())), pa.array([sorted(set(w)) for w in rows], pa.list_(pa.string()))]
                head = [batch.column(i).slice(at, len(texts)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*head, *out], names=["doc_id", "toxic", "marks", "words"])

    return cut(sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, marks array<long>, words array<string>"))


def _counts(studied: DataFrame, ids: dict[int, list[int]]) -> tuple[dict, dict]:
    """(words, stems) that may be insults -> the numbers of toxic and clean texts among these ids that hold them."""
    kept = studied.sparkSession.createDataFrame([(i,) for own in ids.values() for i in own], "doc_id long")  # bounded by the sample
    own = studied.join(F.broadcast(kept), "doc_id").where(F.size("words") > 0)
    stems = F.flatten(F.transform("words", lambda w: F.transform(F.sequence(F.lit(STEMS[0]), F.least(F.lit(STEMS[-1]), F.greatest(F.lit(STEMS[0]), F.length(w) - 1))), lambda n: F.when(n < F.length(w), F.substring(w, F.lit(1), n)))))
    out = []
    for tokens in (F.col("words"), F.array_distinct(F.array_compact(stems))):
        n = own.select("toxic", F.explode(tokens).alias("token")).groupBy("token").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        able = (F.col("t") >= LEAST_TEXTS) & ((F.col("t") + 0.5) / (len(ids[1]) + 1) >= TIMES * (F.col("c") + 0.5) / (len(ids[0]) + 1) * 0.99)
        out.append({r["token"]: (r["t"], r["c"]) for r in n.where(able).collect()})
    return out[0], out[1]


def _examine(sample: DataFrame, stems: dict, words: dict, reports: tuple[str, ...] = ()) -> list[tuple]:
    """(toxic, weighs, features, words before insults) of each sampled text."""

    def run(batches):
        lexicon = Lexicon(stems, words, reports)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                x = [features(t, lexicon).tolist() for t in texts]
                before = [sorted(said_before(t, lexicon)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(x, pa.list_(pa.float64())), pa.array(before, pa.list_(pa.string()))], names=["doc_id", "x", "before"])

    found = sample.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>, before array<string>")
    rows = found.join(sample.select("doc_id", "toxic"), "doc_id").select("doc_id", "toxic", "x", "before").collect()  # within the bounds
    return sorted((r["toxic"], weighs(r["doc_id"]), r["x"], r["before"]) for r in rows)


def fit(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE) -> dict:
    """The model from at most so many labelled documents of each kind, chosen by a hash of the id among those
    that are not held out. Repeated labels of a document count once (toxic wins), and of texts that share an id the one of
    least hash is read, whole. Without toxic examples nothing scores above 0."""
    able = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    able = able.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [able.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic_sample), (0, clean_sample))]
    chosen = some[0].union(some[1])  # at most both bounds together
    texts = text_rows(docs).join(F.broadcast(chosen), "doc_id").where("text is not null")
    one = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("t"))
    sample = cut(one.select("doc_id", F.col("t.text").alias("text"), "toxic"))
    studied = _study(sample)
    rows = sorted((r["marks"], r["doc_id"], r["toxic"]) for r in studied.select("doc_id", "toxic", "marks").collect())
    pick = lambda *parts: {k: _distinct([(i, m) for m, i, t in rows if t == k and weighs(i) in parts]) for k in (0, 1)}
    if not any(t for *_, t in rows) or all(t for *_, t in rows):
        return {"stems": {}, "words": {}, "reports": (), "w": np.zeros(len(KINDS) + 1), "b": -30.0}
    # two thirds teach a first lexicon, so that the other third weighs patterns that it has not taught
    teach = lambda ids: learn_lexicon(*_counts(studied, ids), len(ids[1]), len(ids[0]))
    first = teach(pick(False))
    seen = _examine(sample, *first)
    reports = learn_reports([set(b) for t, weigh, _, b in seen if t and not weigh and b], [set(b) for t, weigh, _, b in seen if not t and not weigh and b])
    seen = [r for r in (_examine(sample, *first, reports) if reports else seen) if r[1]]
    w, b = fit_logistic(np.array([x for _, _, x, _ in seen]).reshape(-1, len(KINDS) + 1), np.array([t for t, *_ in seen]))
    stems, words = teach(pick(False, True))
    return {"stems": stems, "words": words, "reports": reports, "w": w, "b": b}


def lexicon_of(model: dict) -> Lexicon:
    """The worker's lexicon for this model."""
    key = ("toxicity", hash_of(repr((sorted(model["stems"].items()), sorted(model["words"].items()), model["reports"])), 0))
    return remembered(key, lambda: Lexicon(model["stems"], model["words"], model["reports"]))


def rate(texts, model: dict, lexicon: Lexicon) -> np.ndarray:
    x = np.array([features(t, lexicon) for t in texts]).reshape(-1, len(KINDS) + 1)
    return 1 / (1 + np.exp(-np.clip(x @ model["w"] + model["b"], -30, 30)))


def score(docs: DataFrame, model: dict, threshold: float = TOXIC) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, score, predicted; a row for each row of docs. Null and
    empty texts match no pattern and get the score of such. Only the text is read."""

    def run(batches):
        lexicon = lexicon_of(model)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(rate(texts, model, lexicon), pa.float64())], names=["doc_id", "score"])

    found = text_rows(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: dict, threshold: float = TOXIC) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns. Null and empty texts stay."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def rated(texts: pa.Array) -> pa.Array:
        lexicon = lexicon_of(model)
        return pa.array(np.concatenate([rate(own, model, lexicon) for _, own in slices(texts)] or [np.empty(0)]), pa.float64())

    return docs.where(rated(F.col("text").cast("string")) < threshold)
