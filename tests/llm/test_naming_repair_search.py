"""Exact duplicates by block naming, conversation repair, reversed search: against plain counterparts, with odd inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textveil.llm import blocknames, lexical, repair

DOCS = "doc_id long, text string, lang string, name long, key string"
WORDS = ["tide", "moss", "Lamp", "ember", "Ýa", "cart.", "7up"]


# -- exact duplicates --------------------------------------------------------------------------------------------------
def same_texts(rows):
    groups = defaultdict(list)
    for k, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, k))
    out = []
    for key, members in groups.items():
        best = min(members)
        out += [(None if z else d, None if best[1] else best[2], len(members), (c, z, d, k) == best, hashlib.sha256(key.encode()).hexdigest()) for c, z, d, k in members]
    return sorted(map(str, out))


def named(spark, rows, size):
    docs = spark.createDataFrame([(d, t, "en", 1, "x") for d, t in rows], DOCS)
    return sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in blocknames.groups(docs.repartition(5), size).collect())


def test_block_naming_matches_plain_grouping(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab \n") for _ in range(rng.choice([0, 3, 4, 5, 8, 9, 31, 32, 33]))) for _ in range(60)]
    rows = [(k, rng.choice(base)) for k in range(200)] + [(1000 + k, "ab" * 700 + "é") for k in range(30)] + [(2000, "ab" * 700), (2001, " "), (2002, None), (2003, "ab" * 700 + "e")]
    # a third of all rows are copies; blocks of four bytes make up to ten levels of pairs, and cut letters of two bytes
    assert named(spark, rows, 4) == same_texts(rows)


def test_block_naming_odd_rows(spark):
    rows = [(None, "a b"), (None, "ab"), (7, "ab"), (7, "ab"), (8, "a  b"), (9, None), (10, ""), (11, "\t\x0b"), (12, "\xa0"), (13, "x" * 100_000), (14, "x" * 99_999), (15, "x" * 50_000 + "\n" + "x" * 50_000)]
    got = named(spark, rows, 4096)
    want = same_texts(rows)
    assert [g.split(", ")[1:] for g in got] == [w.split(", ")[1:] for w in want] and len(got) == len(rows)
    assert sum(", 2, True" in g or ", 3, True" in g or ", 5, True" in g for g in got) == 3
    assert blocknames.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_names_go_on_over_borders_of_tasks(spark):
    """One block in nine tenths of the rows, dealt over many tasks, still has one name."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        docs = spark.createDataFrame([(k, "same" if k % 10 else f"other{k % 70}") for k in range(3000)], "doc_id long, text string")
        found = blocknames.named(blocknames.blocks(docs)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    names = {r.digest: r.name for r in found}
    assert len(found) == 3000 and len(set(names.values())) == len(names) == 8 and max(names.values()) == 8
    assert all(names[r.digest] == r.name for r in found)


def test_blocks_that_agree_in_what_they_are_dealt_by(spark):
    """Blocks with one beginning and, here, one hash: the naming sees it and goes by whole blocks."""
    rng = random.Random(6)
    texts = ["x" * 20 + rng.choice("abcd") for _ in range(400)] + ["y"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = blocknames.named(blocknames.blocks(docs), hashed=lambda c: F.lit(1)).select("row", "digest", "name").collect()
    names = {r.digest: r.name for r in found}
    assert len(found) == 430 and sorted(names.values()) == [1, 2, 3, 4, 5] and all(names[r.digest] == r.name for r in found)


# -- conversation repair -----------------------------------------------------------------------------------------------
def all_audits(codes, limit=3):
    """Least (cost, audit) by trying every sequence of edits with at most ``limit`` inserts in a row."""
    legal = re.compile(r"(s?(ua)+)?")
    best = None

    def go(i, audit, roles, cost, run):
        nonlocal best
        if not legal.fullmatch(roles) and not any(legal.fullmatch(roles + x) for x in ("a", "ua", "uaua")):
            return
        if i == len(codes) and legal.fullmatch(roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if run < limit:
            for c in "ua":
                go(i, audit + "I", roles + c, cost + 5, run + 1)
        if i < len(codes):
            go(i + 1, audit + "D", roles, cost + 2, 0)
            if codes[i][0] != "x":
                more = 5 * (codes[i][0] == "t")
                for c in "ua":
                    go(i + 1, audit + "R", roles + c, cost + 1 + more, 0)
                if codes[i][1:]:
                    go(i + 1, audit + "K", roles + codes[i][1:], cost + more, 0)

    go(0, "", "", 0, 0)
    return best


KINDS = [f + r for f in "-xt" for r in ("s", "u", "a", "q", "")]


def test_audits_match_trying_all_edits():
    for n in range(3):
        for codes in itertools.product(KINDS, repeat=n):
            assert repair.cheapest(list(codes)) == all_audits(codes, 2), codes
    rng = random.Random(3)
    for _ in range(150):
        codes = [rng.choice(KINDS) for _ in range(rng.randint(3, 5))]
        assert repair.cheapest(codes) == all_audits(codes, 1), codes


def straight(codes):
    """The least (cost, audit) by one pass over all states."""
    labels = {repair.NONE: (0, "")}

    def closed(labels):
        for _ in range(3):
            for s, (cost, audit) in list(labels.items()):
                for price, to in repair.inserts(s):
                    labels[to] = min(labels.get(to, (1 << 60, "")), (cost + price, audit + "I"))
        return labels

    for code in codes:
        after = {}
        for s, (cost, audit) in closed(labels).items():
            for letter, price, to in repair.edits(code, s):
                after[to] = min(after.get(to, (1 << 60, "")), (cost + price, audit + letter))
        labels = after
    labels = closed(labels)
    return min(labels[s] for s in repair.ENDS if s in labels)


def test_segments_match_one_pass():
    rng = random.Random(11)
    for n in (5, 63, 64, 65, 130, 700):
        codes = [rng.choice(["-u", "-a", "-u", "-a", "tu", "ta", "xu", "-s", "-q"]) for _ in range(n)]
        want = straight(codes)
        assert repair.cheapest(codes) == want and repair.cheapest(codes, 7) == want and repair.between(tuple(codes[:60]), repair.NONE, repair.ENDS) == straight(codes[:60])


def damaged_plainly(rows):
    text_of = lambda x: " " if x is None else x
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = text_of(role), text_of(text)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        out[conv]
        if d == 0:
            continue
        text = "" if d == 1 else re.sub(r"[.!?]", "", text) if d == 2 else text
        out[conv] += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def repaired_plainly(rows):
    out = []
    for conv, own in damaged_plainly(rows).items():
        seen, codes, faults = set(), [], Counter()
        for _, role, text in own:
            said = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            codes.append({"blank": "x", "duplicate": "x", "truncated": "t", "": "-"}[fault] + role[:1])
        cost, audit = straight(codes)
        kept, rest, expect = [], list(own), ""
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else rest.pop(0)
            if letter == "D":
                continue
            role = role if letter == "K" else "assistant" if expect.endswith("u") else "user"
            expect += role[0]
            kept.append(f"{role}:{text}")
        assert re.fullmatch(r"(s?(ua)+)?", expect)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


def test_repair_matches_plain_version(spark):
    rng = random.Random(2)
    texts = ["Yes.", "No!", "so", " \t", "", None, "Ünd?", "a\nb.", "ends. \n"]
    rows = [(c, t + rng.choice([0, 0, 0, 2]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts)) for c in range(120) for t in range(rng.randint(1, 9))]
    rows += [(None, k, "user", "Hm.") for k in range(5)] + [(500, None, "user", "A."), (500, None, "assistant", "B."), (500, 3, "user", "C.")] + [(600, k, "user" if k % 2 else "assistant", f"Turn {k % 150}.") for k in range(400)]
    rows += rows[:20]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, gone int")
    got = sorted(str(tuple(r)) for r in repair.repair_damaged(df.repartition(3)).collect())
    assert got == repaired_plainly(rows)
    assert repair.repair_damaged(df.limit(0)).count() == 0


def test_conversation_of_dropped_rows_only(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    row = repair.repair_damaged(spark.createDataFrame([(9, turn, "user", "Gone.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_texts_wait_in_a_file(spark):
    """Texts beyond what a conversation may hold in memory: the hash is that of the whole text."""
    conv = repair.Conversation(1)
    long = "x" * 3_000_000 + "."
    for turn, role in enumerate(("user", "assistant", "user")):
        conv.add(turn, role, long + str(turn) + ".")
    assert conv.result()[6:] == (2, "KKD", hashlib.sha256(f"user:{long}0.\nassistant:{long}1.".encode()).hexdigest())


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", ""), (2, 0, "user", "A."), (2, 1, "assistant", "B.")], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, repair.repaired_turns(df).collect()))
    assert got == [(2, 0, "user", "A."), (2, 1, "assistant", "B.")]


# -- reversed search ---------------------------------------------------------------------------------------------------
def searched_plainly(docs, items, top=10):
    terms = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    counted = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        found = []
        for doc, c in counted:
            score = 0
            for t in terms(text):
                if t in c:
                    w, m = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))), 10 + 90 * c.total() * n_docs // n_terms
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k, None if z else d, -s) for k, (s, z, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("postings", [500_000, 40])
def test_search_matches_scoring_all(spark, postings, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 50)
    rng = random.Random(8)
    words = [f"{w}{k}" for k in range(12) for w in WORDS]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(300)]
    docs += docs[:15] + [(None, "tide0 moss1"), (None, "tide0 moss1"), (400, None), (401, ""), (402, "., !"), (403, "tide0,TIDE0;" * 3000)]
    items = [(k, " ".join(rng.choices(words, k=9))) for k in range(25)] + [(None, "tide0 ýA3"), (90, None), (91, "absent"), (3, "moss1"), (3, "moss1")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id long, term string").repartition(6)
    got = lexical.search(frame, spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id long"), postings=postings)
    assert sorted(str(tuple(r)) for r in got.collect()) == searched_plainly(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "tide")], "doc_id long, text string"), spark.createDataFrame([(1, "tide")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0 == lexical.search(docs, items.limit(0)).count()
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, lexical.weight(1, 1) * (1_000_000_000 // (1000 + 8 * 100)))]
