"""Registered queries of the library's own operators, and DuckDB SQL of the same results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import patterns as P
from ..functions.lineage import cut, shared_folder, spread, wide
from ..operators import chunk, conversation, detect, known, mask, report, restore, review, vault
from ..sources import read_table
from ..streaming import live, mask_turns, sinks, use_rocksdb
from . import jobs

QUERIES, ORACLES = {}, {}
EMAIL = next(e for e in P.PATTERNS if e[1] == "email")
EMAIL_RE = EMAIL[2].replace("(?U)", "")
IP_RE = next(e[2] for e in P.PATTERNS if e[1] == "ipv4").replace("(?U)", "")
SECRET = "query secret"

#: A record of one customer, as form lines and prose; the same expression in both engines.
RECORD = """'Full name: ' || c_name || chr(10) || 'ID number: ' || lpad(cast(c_custkey * 7654321 + 1234567 as string), 13, '0') || chr(10)
 || 'Email: cust' || cast(c_custkey as string) || '@mail' || cast(c_nationkey as string) || '.example.com' || chr(10)
 || 'Note: filed by EMP-' || lpad(cast(c_custkey as string), 6, '0') || ' for EUR ' || cast(c_custkey + 1 as string) || ',250.50 and ' || cast(c_nationkey + 1 as string) || ' dollars'"""
DIGITS = "lpad(cast(c_custkey * 7654321 + 1234567 as string), 13, '0')"


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, dealt out: their file is small for the texts that are made of its rows."""
    return spread(read_table(spark, sf_dir, "customer"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select(F.col("c_custkey").cast("long").alias("doc_id"), F.expr(RECORD).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, end, value) of the documents' e-mail addresses."""
    found = documents(spark, sf_dir).select("doc_id", F.explode(detect.pattern_spans(F.col("text"), EMAIL)).alias("s"))
    return found.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))


EMAILS_SQL = rf"""
e AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, g, h FROM (SELECT doc_id, string_split_regex(text, '{EMAIL_RE}') AS g, regexp_extract_all(text, '{EMAIL_RE}') AS h FROM documents) WHERE len(h) > 0),
emails AS (SELECT doc_id, CAST(s AS INTEGER) AS "start", CAST(s + length(v) AS INTEGER) AS "end", v AS value FROM (
  SELECT doc_id, h[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS s FROM e))"""


@query(rf"""
SELECT entity_type, count(*) AS n FROM (
  SELECT 'EMAIL_ADDRESS' AS entity_type, unnest(regexp_extract_all(text, '{EMAIL_RE}')) AS v FROM documents
  UNION ALL SELECT 'IP_ADDRESS', unnest(regexp_extract_all(text, '{IP_RE}')) FROM documents) GROUP BY 1""")
def entity_counts_by_type(spark, sf_dir):
    found = detect.detect(chunk.chunks(documents(spark, sf_dir), "doc_id", whole_words=True), entities=("EMAIL_ADDRESS", "IP_ADDRESS"))
    return report.entity_counts(detect.explode_spans(found, "doc_id"))


@query()
def private_values_by_type(spark, sf_dir):
    """All default types, overlaps resolved, chunk by chunk."""
    parts = chunk.chunks(documents(spark, sf_dir), "doc_id", whole_words=True)
    return report.entity_counts(detect.explode_spans(detect.detect(parts), "doc_id"))


@query(f'WITH {EMAILS_SQL} SELECT doc_id, "start", "end", value FROM emails')
def spans_email(spark, sf_dir):
    return emails(spark, sf_dir)


@query(f"""WITH r AS (SELECT c_custkey AS doc_id, {RECORD} AS text FROM customer)
SELECT doc_id, unnest(regexp_extract_all(text, '\\bEMP-[0-9]{{6}}\\b')) AS value FROM r""")
def employee_ids(spark, sf_dir):
    found = detect.detect(records(spark, sf_dir), entities=("EMPLOYEE_ID",))
    return detect.explode_spans(found, "doc_id").select("doc_id", "value")


@query("""SELECT c_custkey AS doc_id, 'sk-' || lpad(cast(c_custkey as varchar), 24, 'k') AS value, 0.95 :: DOUBLE AS score FROM customer
UNION ALL SELECT c_custkey, 'AKIA' || lpad(cast(c_custkey as varchar), 16, 'Z'), 0.95 FROM customer
UNION ALL SELECT c_custkey, 'Bearer ' || lpad(cast(c_custkey as varchar), 22, 't'), 0.85 FROM customer""")
def api_keys(spark, sf_dir):
    text = F.expr("'keys: sk-' || lpad(cast(c_custkey as string), 24, 'k') || ', AKIA' || lpad(cast(c_custkey as string), 16, 'Z') || ' and Bearer ' || lpad(cast(c_custkey as string), 22, 't')")
    rows = customers(spark, sf_dir).select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    return detect.explode_spans(detect.detect(rows, entities=("API_KEY",)), "doc_id").select("doc_id", "value", "score")


@query("""SELECT c_custkey AS doc_id, 'EUR ' || cast(c_custkey + 1 as varchar) || ',250.50' AS value FROM customer
UNION ALL SELECT c_custkey, cast(c_nationkey + 1 as varchar) || ' dollars' FROM customer""")
def money_amounts(spark, sf_dir):
    found = detect.detect(records(spark, sf_dir), entities=(), detect_money=True)
    return detect.explode_spans(found, "doc_id").select("doc_id", "value")


@query(f"""WITH d AS (SELECT c_custkey, {DIGITS} AS v FROM customer),
s AS (SELECT c_custkey, v, 11 - list_sum(list_transform(range(1, 13), lambda i: cast(v[i] as int) * ([7,6,5,4,3,2,7,6,5,4,3,2])[i])) % 11 AS r FROM d)
SELECT c_custkey, v, (CASE WHEN r < 10 THEN r ELSE 0 END) = cast(v[13] as int) AS valid FROM s""")
def national_ids_valid(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.expr(DIGITS).alias("v")).withColumn("valid", C.jmbg_valid(F.col("v")))


@query("""WITH d AS (SELECT c_custkey, lpad(cast(c_custkey % 97 as varchar), 2, '0') AS c, lpad(cast(c_custkey * 31 as varchar), 18, '0') AS b FROM customer)
SELECT c_custkey, 'DE' || c || b AS v, cast(b || '1314' || c as hugeint) % 97 = 1 AS valid FROM d""")
def iban_valid(spark, sf_dir):
    v = F.expr("'DE' || lpad(cast(c_custkey % 97 as string), 2, '0') || lpad(cast(c_custkey * 31 as string), 18, '0')")
    return read_table(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).withColumn("valid", C.iban_valid(F.col("v")))


@query("""WITH d AS (SELECT c_custkey, '4' || lpad(cast(c_custkey * 977 as varchar), 15, '0') AS v FROM customer)
SELECT c_custkey, v, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN cast(v[i] as int) WHEN cast(v[i] as int) > 4 THEN cast(v[i] as int) * 2 - 9 ELSE cast(v[i] as int) * 2 END)) % 10 = 0 AS valid FROM d""")
def cards_luhn(spark, sf_dir):
    v = F.expr("'4' || lpad(cast(c_custkey * 977 as string), 15, '0')")
    return read_table(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).withColumn("valid", C.luhn_valid(F.col("v")))


@query(f"""WITH r AS (SELECT c_custkey AS doc_id, {RECORD} AS text FROM customer),
f AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^[ \\t]*([A-Za-z][A-Za-z ./-]{{1,28}}?)[ \\t]*:[ \\t]*(\\S.*?)[ \\t]*$', 1)) AS label,
  unnest(regexp_extract_all(text, '(?m)^[ \\t]*([A-Za-z][A-Za-z ./-]{{1,28}}?)[ \\t]*:[ \\t]*(\\S.*?)[ \\t]*$', 2)) AS value FROM r)
SELECT doc_id, t AS entity_type, value FROM f JOIN (VALUES ('full name', 'PERSON'), ('id number', 'NATIONAL_ID'), ('email', 'EMAIL_ADDRESS')) l(k, t) ON lower(label) = k""")
def labelled_fields(spark, sf_dir):
    found = records(spark, sf_dir).select("doc_id", detect.field_spans(detect.fields(F.col("text"))).alias("spans"))
    return detect.explode_spans(found, "doc_id").select("doc_id", "entity_type", "value")


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS k, cast(l_linenumber * 7 as int) AS a, cast(l_linenumber * 7 + 2 + l_partkey % 12 as int) AS b, (l_suppkey % 7) / 10.0 AS score FROM lineitem),
RECURSIVE_ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, b - a DESC, a) AS r FROM s),
folded AS (SELECT doc_id, list_reduce(list(struct_pack(kept := [struct_pack(a := a, b := b)]) ORDER BY r), lambda x, y: CASE WHEN len(list_filter(x.kept, lambda q: y.kept[1].a < q.b AND q.a < y.kept[1].b)) > 0 THEN x ELSE struct_pack(kept := list_concat(x.kept, y.kept)) END) AS f FROM RECURSIVE_ranked GROUP BY doc_id)
SELECT doc_id, k.a AS "start", k.b AS "end" FROM (SELECT doc_id, unnest(f.kept) AS k FROM folded)""")
def overlap_resolved(spark, sf_dir):
    a = F.col("l_linenumber") * 7
    s = C.span("PERSON", a, a + 2 + F.col("l_partkey") % 12, (F.col("l_suppkey") % 7) / 10.0, F.lit(""))
    rows = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(detect.resolve(F.collect_list(s)).alias("spans"))
    return detect.explode_spans(rows, "doc_id").select("doc_id", "start", "end")


@query(r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) :: BIGINT AS n_atoms FROM documents""")
def sentence_atoms(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(chunk.pieces(F.col("text"), chunk.SENTENCE)).cast("long").alias("n_atoms"))


@query(r"""WITH a AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS t FROM documents WHERE length(text) > 800),
n AS (SELECT doc_id, list_transform(flatten(list_transform(t, lambda x: list_transform(range(0, cast(ceil(length(x) / 800.0) as bigint)), lambda i: least(800, length(x) - i * 800)))), lambda z: struct_pack(o := z, d := [] :: BIGINT[])) AS l FROM a),
p AS (SELECT doc_id, list_reduce(l, lambda x, y: CASE WHEN x.o + y.o > 800 THEN struct_pack(o := y.o, d := list_append(x.d, x.o)) ELSE struct_pack(o := x.o + y.o, d := x.d) END) AS r FROM n),
s AS (SELECT doc_id, list_append(r.d, r.o) AS sizes FROM p UNION ALL SELECT doc_id, [length(text)] FROM documents WHERE length(text) BETWEEN 1 AND 800)
SELECT doc_id, cast(i - 1 as int) AS chunk_no, cast(coalesce(list_sum(sizes[1:i - 1]), 0) as int) AS chunk_start, cast(sizes[i] as int) AS n_chars FROM (SELECT doc_id, sizes, unnest(range(1, len(sizes) + 1)) AS i FROM s)""")
def chunks(spark, sf_dir):
    return chunk.chunks(documents(spark, sf_dir), "doc_id", max_chars=800).select("doc_id", "chunk_no", "chunk_start", F.length("text").alias("n_chars"))


def email_mentions(spark, sf_dir):
    return emails(spark, sf_dir).select("doc_id", F.lit(0).alias("seq"), "start", F.lit("EMAIL_ADDRESS").alias("entity_type"), "value")


@query(f"""WITH {EMAILS_SQL}, k AS (SELECT doc_id, lower(value) AS match_key, min("start") AS s, min_by(value, "start") AS original FROM emails GROUP BY 1, 2)
SELECT doc_id, match_key, original, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS idx FROM k""")
def vault_by_doc(spark, sf_dir):
    return vault.mint(email_mentions(spark, sf_dir), ["doc_id"], secret=SECRET).select("doc_id", "match_key", "original", "idx")


@query(f"""WITH {EMAILS_SQL}, k AS (SELECT lower(value) AS match_key, min((doc_id, "start")) AS f FROM emails GROUP BY 1), r AS (SELECT match_key, row_number() OVER (ORDER BY f) AS idx FROM k)
SELECT match_key, idx, format('<EMAIL_ADDRESS_{{:03d}}>', idx) AS placeholder FROM r""")
def vault_by_corpus(spark, sf_dir):
    mentions = emails(spark, sf_dir).select(F.col("doc_id").alias("seq"), "start", F.lit("EMAIL_ADDRESS").alias("entity_type"), "value")
    return vault.mint(mentions, [], secret=SECRET).select("match_key", "idx", "placeholder")


def order_mentions(spark, sf_dir):
    """Each order mentions its customer's name in one of three spellings; the scope is the nation."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    value = F.expr("CASE o_orderkey % 3 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) ELSE lower(c_name) END")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", F.col("o_orderkey").alias("seq"), F.lit(0).alias("start"), F.lit("PERSON").alias("entity_type"), value.alias("value"))


ORDERS_SQL = "m AS (SELECT c_nationkey, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) ELSE lower(c_name) END AS value FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"""WITH {ORDERS_SQL}, k AS (SELECT c_nationkey, lower(value) AS match_key, min(seq) AS f FROM m GROUP BY 1, 2), v AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY f) AS idx FROM k),
s AS (SELECT c_nationkey, lower(value) AS match_key, value AS variant, min(seq) AS f FROM m GROUP BY 1, 2, 3)
SELECT c_nationkey, idx, variant, cast(row_number() OVER (PARTITION BY c_nationkey, match_key ORDER BY s.f) as int) AS variant_no FROM s JOIN v USING (c_nationkey, match_key)""")
def vault_variants(spark, sf_dir):
    found = order_mentions(spark, sf_dir)
    return vault.variants(found, vault.mint(found, ["c_nationkey"], secret=SECRET), ["c_nationkey"]).select("c_nationkey", "idx", "variant", "variant_no")


@query(f"""WITH {ORDERS_SQL}, s AS (SELECT c_nationkey, lower(value) AS match_key, value, min(seq) AS f FROM m GROUP BY 1, 2, 3)
SELECT c_nationkey, string_agg(value, '|' ORDER BY f) AS spellings, min_by(value, f) AS restored_as FROM s GROUP BY c_nationkey, match_key HAVING count(*) > 1""")
def canonicalized(spark, sf_dir):
    found = order_mentions(spark, sf_dir)
    minted = vault.mint(found, ["c_nationkey"], secret=SECRET)
    out = vault.canonicalized(vault.variants(found, minted, ["c_nationkey"]), minted, ["c_nationkey"])
    return out.select("c_nationkey", F.array_join("spellings", "|").alias("spellings"), "restored_as")


@query(f"""WITH {ORDERS_SQL}, k AS (SELECT c_nationkey, lower(value) AS match_key, min(seq) AS f, bool_or(seq % 2 = 0) AS early, min(CASE WHEN seq % 2 = 0 THEN seq END) AS fe FROM m GROUP BY 1, 2)
SELECT c_nationkey, match_key, CASE WHEN early THEN row_number() OVER (PARTITION BY c_nationkey, early ORDER BY fe) ELSE row_number() OVER (PARTITION BY c_nationkey, early ORDER BY f) + count(*) FILTER (early) OVER (PARTITION BY c_nationkey) END AS idx FROM k""")
def vault_extended(spark, sf_dir):
    """A vault of the even orders, then reused for all: known values keep their number, new ones go on."""
    found = order_mentions(spark, sf_dir)
    first = vault.mint(found.where("seq % 2 = 0"), ["c_nationkey"], secret=SECRET)
    return vault.mint(found, ["c_nationkey"], secret=SECRET, known=first).select("c_nationkey", "match_key", "idx")


HMAC_SQL = f"""left(sha256(unhex('{bytes(b ^ 0x5C for b in SECRET.encode().ljust(64, b"\0")).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in SECRET.encode().ljust(64, b"\0")).hex()}') || encode('PERSON:' || lower(c_name))))), 12)"""


@query(f"SELECT c_custkey, {HMAC_SQL} AS fingerprint FROM customer")
def fingerprints(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", C.fingerprint(F.lit("PERSON"), F.col("c_name"), SECRET).alias("fingerprint"))


@query(f"SELECT {HMAC_SQL} AS fingerprint FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def cross_run_link(spark, sf_dir):
    """Two runs, over the customers and over those that the orders name, agree by fingerprint alone."""
    mention = lambda seq, value: (seq.alias("seq"), F.lit(0).alias("start"), F.lit("PERSON").alias("entity_type"), value.alias("value"))
    named = read_table(spark, sf_dir, "customer").select(*mention(F.col("c_custkey"), F.col("c_name")))
    left, right = vault.mint(named, [], secret=SECRET), vault.mint(order_mentions(spark, sf_dir).drop("c_nationkey"), [], secret=SECRET)
    return vault.cross_run_links(left, right).select("fingerprint")


#: Whether a record's number is a card's: the strongest finding stays, and a card's check digit (0.95) is stronger than a label (0.8), though
#: not than a national id's (1). Numbers of 13 digits that don't begin with 0 come with customers from 130,645 on.
LUHN = f"list_sum(list_transform(range(1, 14), lambda i: CASE WHEN i % 2 = 1 THEN cast(({DIGITS})[i] as int) WHEN cast(({DIGITS})[i] as int) > 4 THEN cast(({DIGITS})[i] as int) * 2 - 9 ELSE cast(({DIGITS})[i] as int) * 2 END)) % 10"
JMBG = f"11 - list_sum(list_transform(range(1, 13), lambda i: cast(({DIGITS})[i] as int) * ([7,6,5,4,3,2,7,6,5,4,3,2])[i])) % 11"
IS_CARD = f"(({DIGITS})[1] BETWEEN '1' AND '6' AND {LUHN} = 0 AND (CASE WHEN {JMBG} < 10 THEN {JMBG} ELSE 0 END) <> cast(({DIGITS})[13] as int))"

TEMPLATE = f"'Full name: <PERSON_001>' || chr(10) || 'ID number: <' || CASE WHEN {IS_CARD} THEN 'CREDIT_CARD' ELSE 'NATIONAL_ID' END || '_001>' || chr(10) || 'Email: <EMAIL_ADDRESS_001>' || chr(10) || 'Note: filed by <EMPLOYEE_ID_001> for EUR ' || cast(c_custkey + 1 as varchar) || ',250.50 and ' || cast(c_nationkey + 1 as varchar) || ' dollars'"


@query(f"SELECT c_custkey AS doc_id, {TEMPLATE} AS masked_text, 0 AS n_leaks FROM customer")
def mask_records(spark, sf_dir):
    out, _, _ = mask.mask_documents(records(spark, sf_dir))
    return out.select("doc_id", "masked_text", F.size("leaks").alias("n_leaks"))


@query()
def mask_corpus_documents(spark, sf_dir):
    """Every document masked, swept over its whole text and guarded."""
    out, _, _ = mask.mask_documents(documents(spark, sf_dir), sweep_scope="full")
    released, _ = mask.guard(out)
    return released.select("doc_id", "masked_text", F.size("spans").alias("n_spans"), F.size("sealed").alias("n_sealed"))


#: The lengths of gaps and addresses in turn. Addresses begin and end at the edges of Unicode words, DuckDB's expressions know those of ASCII
#: alone: they are looked for in a copy of the text with small letters, in which Z stands for each word character beyond ASCII and Y is free
#: to mark them. (Split at the expression, a text loses what stands before the second of two addresses that touch.)
WORDS_BEYOND = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{Nd}]|[^_\P{Pc}]|\p{M}|\p{Nl}|[\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]"
ADDRESSES_SQL = rf"""
q AS (SELECT doc_id, text, list_transform(string_split(regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS_BEYOND}', 'Z', 'g'), '({EMAIL_RE.replace("A-Z", "")})', 'Y\1Y', 'g'), 'Y'), lambda x: length(x)) AS n FROM documents),
a AS (SELECT doc_id, i, s, substring(text, s - n[i - 1] + 1, n[i - 1]) AS gap, substring(text, s + 1, n[i]) AS v, substring(text, e + 1) AS tail
  FROM (SELECT *, CAST(list_sum(n[1:i - 1]) AS BIGINT) AS s, CAST(list_sum(n[1:len(n) - 1]) AS BIGINT) AS e FROM (SELECT *, unnest(range(2, len(n), 2)) AS i FROM q)))"""


@query(f"""WITH {ADDRESSES_SQL}, k AS (SELECT doc_id, lower(v) AS v, row_number() OVER (PARTITION BY doc_id ORDER BY min(s)) AS idx FROM a GROUP BY 1, 2),
 p AS (SELECT a.doc_id, string_agg(gap || '<EMAIL_ADDRESS_' || printf('%03d', idx) || '>', '' ORDER BY i) || any_value(tail) AS t, count(*) AS n FROM a JOIN k ON k.doc_id = a.doc_id AND k.v = lower(a.v) GROUP BY 1)
SELECT d.doc_id, sha256(coalesce(p.t, d.text)) AS masked_sha256, coalesce(p.n, 0) AS n_spans, true AS released FROM documents d LEFT JOIN p USING (doc_id)""")
def mask_document_emails(spark, sf_dir):
    """Every document masked for one type whose pattern both engines have, chunk by chunk, swept over its whole text and guarded."""
    out, _, _ = mask.mask_documents(documents(spark, sf_dir), sweep_scope="full", options={"entities": ("EMAIL_ADDRESS",)})
    released, held = mask.guard(out)
    row = lambda df, gone: df.select("doc_id", F.sha2("masked_text", 256).alias("masked_sha256"), F.size("spans").cast("long").alias("n_spans"), F.lit(gone).alias("released"))
    return row(released, True).union(row(held, False))


@query("SELECT c_custkey AS doc_id, c_custkey % 5 <> 0 AS released FROM customer")
def guard_split(spark, sf_dir):
    """Every fifth record gets its name back into the masked text, as a faulty step would; the guard holds it."""
    out, minted, spelled = mask.mask_documents(records(spark, sf_dir))
    names = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    rows = out.select("doc_id", "masked_text").join(wide(names), "doc_id").join(wide(vault.entries(minted, ["doc_id"], spelled)), "doc_id", "left")
    rows = rows.withColumn("masked_text", F.when(F.col("doc_id") % 5 == 0, F.concat("masked_text", F.lit(" "), F.lower("c_name"))).otherwise(F.col("masked_text")))
    rows = rows.withColumn("leaks", mask.leaks(F.col("masked_text"), mask.forms_of(F.col("entries"), None)))
    released, held = mask.guard(cut(rows.select("doc_id", "masked_text", "leaks")))  # both halves read it
    return released.select("doc_id", F.lit(True).alias("released")).union(held.select("doc_id", F.lit(False)))


@query(f"SELECT d.c_custkey AS doc_id, n.c_name AS variant FROM (SELECT c_custkey, {RECORD} AS text FROM customer) d JOIN customer n ON n.c_custkey = d.c_custkey")
def corpus_leaks(spark, sf_dir):
    """The names of all customers against all records."""
    values = read_table(spark, sf_dir, "customer").select(F.col("c_name").alias("variant"))
    return mask.corpus_leaks(records(spark, sf_dir), values, "doc_id")


@query("SELECT c_custkey AS doc_id, 'Dear ' || c_name || ', [' || c_name || '] wrote; see section 3 and PERSON_099' AS restored FROM customer")
def restore_replies(spark, sf_dir):
    _, minted, _ = mask.mask_documents(records(spark, sf_dir))
    replies = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Dear person 1, [PERSON-0001] wrote; see section 3 and PERSON_099").alias("text"))
    return restore.restore(replies, minted, ["doc_id"]).select("doc_id", "restored")


@query("SELECT c_custkey AS doc_id, unnest(['section 3', 'PERSON_099']) AS token FROM customer")
def unresolved_tokens(spark, sf_dir):
    _, minted, _ = mask.mask_documents(records(spark, sf_dir))
    replies = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Dear person 1, [PERSON-0001] wrote; see section 3 and PERSON_099").alias("text"))
    return restore.unresolved(replies, minted, ["doc_id"]).select("doc_id", "token")


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'canonical' ELSE 'identical' END AS verdict, count(*) AS n FROM customer GROUP BY 1")
def round_trip_verdict(spark, sf_dir):
    """Even records name their customer twice, once in capitals, so their way back is canonical."""
    extra = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("text"), F.lit("\nClient: "), F.upper(F.regexp_extract("text", "Full name: (.*)", 1)))).otherwise(F.col("text"))
    return jobs.round_trip(records(spark, sf_dir).withColumn("text", extra)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def uncertain(spark, sf_dir):
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), F.lit("PERSON").alias("entity_type"), (F.col("o_orderkey") % 10 / 10.0).alias("score"), F.col("c_name").alias("value"))


def decisions(spark, sf_dir):
    answer = F.expr("CASE c_custkey % 8 WHEN 0 THEN 'n' WHEN 2 THEN ' NO ' WHEN 4 THEN 'y' ELSE '' END")
    return read_table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lit("PERSON").alias("entity_type"), F.upper("c_name").alias("value_key"), answer.alias("answer"))


@query("""SELECT lower(c_name) AS value_key, count(*) AS n, max(o_orderkey % 10 / 10.0) :: DOUBLE AS max_score FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 10 / 10.0 < 0.5 AND c_custkey % 2 = 1 GROUP BY 1""")
def review_queue(spark, sf_dir):
    return review.queue(uncertain(spark, sf_dir), decisions(spark, sf_dir)).select("value_key", "n", "max_score")


@query("SELECT o_orderkey AS doc_id, o_orderkey % 10 < 5 AND o_custkey % 8 IN (0, 2) AS declined FROM orders JOIN customer ON o_custkey = c_custkey")
def declined(spark, sf_dir):
    s = C.span("PERSON", F.lit(0), F.length("value"), F.col("score"), F.col("value"))
    rows = uncertain(spark, sf_dir).select("doc_id", F.array(s).alias("spans"))
    return review.decide(rows, decisions(spark, sf_dir)).select("doc_id", (F.size("declined") > 0).alias("declined"))


def exchanges(spark, sf_dir):
    """Question and answer of each pair of turns; every fifth or so went wrong."""
    t = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    q, a = t.where("turn % 2 = 0"), t.where("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = q.join(a, ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", F.col("text").alias("question"), "answer", (F.col("answer").isNotNull() & ((F.col("conv_id") + F.col("turn")) % 5 != 0)).alias("ok"))


EXCHANGES_SQL = """x AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer, a.text IS NOT NULL AND (q.conv_id + q.turn) % 5 <> 0 AS ok
 FROM (SELECT * FROM conversations WHERE turn % 2 = 0) q LEFT JOIN (SELECT * FROM conversations WHERE turn % 2 = 1) a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1),
h AS (SELECT b.conv_id, b.turn, a.question, a.answer, a.turn AS t, row_number() OVER (PARTITION BY b.conv_id, b.turn ORDER BY a.turn DESC) AS k FROM x b JOIN x a ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.ok),
g AS (SELECT conv_id, turn, cast(2 * count(*) as int) AS n_messages, string_agg(question || '|' || answer, '|' ORDER BY t) AS said FROM h WHERE k <= 2 GROUP BY 1, 2)"""


@query(f"WITH {EXCHANGES_SQL} SELECT x.conv_id, x.turn, coalesce(n_messages, 0) AS n_messages, sha256(coalesce(said, '')) AS said FROM x LEFT JOIN g USING (conv_id, turn)")
def masked_history(spark, sf_dir):
    rows = conversation.with_history(exchanges(spark, sf_dir), ["conv_id"], max_turns=2)
    return rows.select("conv_id", "turn", F.size("history").alias("n_messages"), F.sha2(F.array_join(F.transform("history", lambda m: m["content"]), "|"), 256).alias("said"))


@query(f"WITH {EXCHANGES_SQL} SELECT x.conv_id, x.turn, coalesce(n_messages, 0) + 2 AS n_messages, question AS last_message FROM x LEFT JOIN g USING (conv_id, turn)")
def outbound_requests(spark, sf_dir):
    rows = conversation.requests(conversation.with_history(exchanges(spark, sf_dir), ["conv_id"], max_turns=2), "Keep placeholders as they are.")
    return rows.select("conv_id", "turn", F.size("messages").alias("n_messages"), F.element_at("messages", -1)["content"].alias("last_message"))


def audited(spark, sf_dir):
    rows = exchanges(spark, sf_dir).withColumn("n_leaks", F.when(F.col("conv_id") % 7 == 0, 1).otherwise(0))
    rows = rows.select("conv_id", "turn", F.col("question").alias("text"), F.col("question").alias("masked_text"), "answer", F.col("answer").alias("restored"), F.create_map(F.lit("PERSON"), F.col("turn").cast("long")).alias("entity_counts"), F.when(F.col("turn") > 0, 1).otherwise(0).alias("n_sealed"), "n_leaks", F.lit(0).alias("n_history"), F.lit("model-1").alias("model"), F.when(~F.col("ok"), "Timeout").alias("error"))
    return conversation.audit(rows, ["conv_id", "turn"], F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query(f"""WITH {EXCHANGES_SQL}, e AS (SELECT unnest(list_concat(['pii_detected'], CASE WHEN turn > 0 THEN ['sealed'] ELSE [] END,
 CASE WHEN conv_id % 7 = 0 THEN ['leak_blocked'] WHEN ok THEN ['leak_check', 'masked', 'llm_request', 'llm_response'] ELSE ['leak_check', 'masked', 'llm_request', 'llm_failed'] END)) AS step FROM x)
SELECT step, count(*) AS n FROM e GROUP BY 1""")
def audit_public(spark, sf_dir):
    return conversation.public_view(audited(spark, sf_dir)).groupBy("step").agg(F.count(F.lit(1)).alias("n"))


ERRORS = "CASE o_orderkey % 4 WHEN 0 THEN 'RateLimitError' WHEN 1 THEN 'APITimeoutError' WHEN 2 THEN 'OddError' ELSE 'PermissionDeniedError' END"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '{dict(P.FAILURES)["ratelimit"]}' WHEN 1 THEN '{dict(P.FAILURES)["timeout"]}' WHEN 2 THEN 'OddError: ' || o_orderpriority ELSE '{dict(P.FAILURES)["permissiondenied"]}' END AS reason FROM orders""")
def failure_classes(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", F.expr(ERRORS).alias("c"), F.concat("o_orderpriority", F.lit("\nmore")).alias("m"))
    return rows.select("o_orderkey", conversation.failure_reason(F.col("c"), F.col("m")).alias("reason"))


@query("SELECT c_custkey AS doc_id, 'MONEY_AMOUNT' AS entity_type FROM customer")
def left_in_clear(spark, sf_dir):
    rows = records(spark, sf_dir)
    with_money, plain = (detect.explode_spans(detect.detect(rows, detect_money=m), "doc_id") for m in (True, False))
    return report.left_in_clear(with_money, plain, "doc_id")


@query(f"WITH {EMAILS_SQL} SELECT doc_id, 'EMAIL_ADDRESS' AS entity_type, count(*) AS n FROM emails GROUP BY 1 UNION ALL SELECT doc_id, NULL, count(*) FROM emails GROUP BY 1 UNION ALL SELECT NULL, NULL, count(*) FROM emails")
def entity_totals(spark, sf_dir):
    return report.totals(emails(spark, sf_dir).withColumn("entity_type", F.lit("EMAIL_ADDRESS")), "doc_id")


@query("SELECT count(*) AS n_rows, sum(length(text)) :: BIGINT AS n_chars FROM documents")
def processed(spark, sf_dir):
    return report.processed(documents(spark, sf_dir))


@query("SELECT conv_id, cast(turn as int) AS turn, text || chr(10) || 'Email: <EMAIL_ADDRESS_001>' AS masked_text FROM conversations")
def masked_conversations(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").withColumn("text", F.expr("text || chr(10) || 'Email: conv' || cast(conv_id as string) || '@mail.example.com'"))
    out, _, _ = jobs.mask_conversations(turns, roles=None)
    return out.select("conv_id", F.col("turn").cast("int").alias("turn"), "masked_text")


@query("SELECT conv_id, cast(turn as int) AS turn, text || chr(10) || 'Email: <EMAIL_ADDRESS_001>' AS masked_text, 0 AS n_leaks FROM conversations")
def stream_vault(spark, sf_dir):
    """The live job over the conversations' files, run until all there is has been read."""
    use_rocksdb(spark)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = read_table(spark, sf_dir, "conversations").schema
    turns = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/conversations.parquet*")
    turns = turns.withColumn("text", F.expr("text || chr(10) || 'Email: conv' || cast(conv_id as string) || '@mail.example.com'"))
    job = mask_turns(turns).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema("conv_id long, turn int, masked_text string, sealed array<string>, n_leaks int, late boolean, status string").parquet(f"{folder}/out").select("conv_id", "turn", "masked_text", "n_leaks")


@query(f"""WITH {EXCHANGES_SQL} SELECT conv_id, cast(turn as int) AS turn, 'pii_detected' AS step, '{{"PERSON":"' || turn || '"}}' AS payload, 'Detection marked ' || turn || ' private places' AS message FROM x
UNION ALL SELECT conv_id, cast(turn as int), 'llm_request', '{{"text":' || to_json(question) || ',"model":"model-1","history_messages":"0"}}', 'The masked text goes out' FROM x WHERE conv_id % 7 <> 0""")
def audit_payloads(spark, sf_dir):
    rows = audited(spark, sf_dir).where(F.col("step").isin("pii_detected", "llm_request"))
    return rows.select("conv_id", F.col("turn").cast("int").alias("turn"), "step", F.to_json("payload").alias("payload"), "message")


#: Each customer's record: two names, one declined for every third customer; two addresses, one in two spellings; a wrong national id by
#: its label, another without; a card, an SSN; and beyond the first chunk mentions that no label introduces.
TWO_NAMES = """'Full name: ' || c_name || chr(10) || 'Client: Partner ' || c_name || chr(10) || 'Email: a' || cast(c_custkey as string) || '@x.example.com' || chr(10) || 'Mail: A' || cast(c_custkey as string) || '@X.example.com' || chr(10)
 || 'Mail: b' || cast(c_custkey as string) || '@x.example.com' || chr(10) || 'ID number: 44283740' || lpad(cast(c_custkey % 997 as string), 3, '0') || chr(10) || 'Note: her SSN is 432-56-' || lpad(cast(1000 + c_custkey % 9000 as string), 4, '0') || ' as filed' || chr(10)
 || 'Card number: 4000 0012 3456 ' || lpad(cast(c_custkey % 10000 as string), 4, '0') || chr(10) || repeat('Plain words follow here. ', 20) || 'Then ' || upper(c_name) || ' met partner ' || lower(c_name) || ' and wrote to B' || cast(c_custkey as string) || '@x.example.com.'"""
TWO_MASKED = """'Full name: <PERSON_001>' || chr(10) || 'Client: ' || CASE WHEN c_custkey % 3 = 0 THEN 'Partner <PERSON_001>' ELSE '<PERSON_002>' END || chr(10) || 'Email: <EMAIL_ADDRESS_001>' || chr(10) || 'Mail: <EMAIL_ADDRESS_001>' || chr(10)
 || 'Mail: <EMAIL_ADDRESS_002>' || chr(10) || 'ID number: <NATIONAL_ID_001>' || chr(10) || 'Note: her SSN is <US_SSN_001> as filed' || chr(10) || 'Card number: <CREDIT_CARD_001>' || chr(10) || repeat('Plain words follow here. ', 20)
 || 'Then <PERSON_001> met partner <PERSON_001> and wrote to <EMAIL_ADDRESS_002>.'"""


@query(f"SELECT c_custkey AS doc_id, {TWO_MASKED} AS masked_text, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS n_declined, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS n_sealed, 0 AS n_leaks FROM customer")
def mask_two_chunks(spark, sf_dir):
    """Several values a type, spellings, chunks, missed mentions, decisions, labels without checksums, context words. The sweep goes by minting
    order, so the partner's later mention loses the part that is the first name."""
    rows = customers(spark, sf_dir)
    said = rows.where("c_custkey % 3 = 0").select(F.lit("PERSON").alias("entity_type"), F.concat(F.lit("partner "), F.lower("c_name")).alias("value_key"), F.lit("n").alias("answer"))
    docs = rows.select(F.col("c_custkey").cast("long").alias("doc_id"), F.expr(TWO_NAMES).alias("text"))
    out, _, _ = mask.mask_documents(docs, max_chars=500, decisions=said, confirm_below=0.9)
    return out.select("doc_id", "masked_text", F.col("n_declined").cast("int").alias("n_declined"), F.size("sealed").alias("n_sealed"), F.size("leaks").alias("n_leaks"))


ORDERED = "c_custkey IN (SELECT o_custkey FROM orders)"
NUMBER = f"CASE WHEN {ORDERED} THEN count(*) FILTER ({ORDERED}) OVER (ORDER BY c_custkey) ELSE count(*) FILTER ({ORDERED}) OVER () + count(*) FILTER (NOT {ORDERED}) OVER (ORDER BY c_custkey) END"


@query(f"""WITH n AS (SELECT c_custkey AS doc_id, c_custkey, c_nationkey, {NUMBER} AS k FROM customer)
SELECT doc_id, 'Full name: <PERSON_' || format('{{:03d}}', k) || '>' || chr(10) || 'ID number: <NATIONAL_ID_' || format('{{:03d}}', k) || '>' || chr(10) || 'Email: <EMAIL_ADDRESS_' || format('{{:03d}}', k) || '>' || chr(10)
 || 'Note: filed by <EMPLOYEE_ID_' || format('{{:03d}}', k) || '> for EUR ' || cast(c_custkey + 1 as varchar) || ',250.50 and ' || cast(c_nationkey + 1 as varchar) || ' dollars' AS masked_text, 0 AS n_leaks FROM n""")
def mask_corpus_known(spark, sf_dir):
    """One vault for all records: first for customers with orders, then reused for all."""
    docs = records(spark, sf_dir)
    ordered = docs.join(read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")).distinct(), "doc_id", "left_semi")
    minted, spelled = mask.mint_corpus(ordered, secret=SECRET)
    out, _, _ = mask.mask_corpus(docs, secret=SECRET, known=(minted, spelled))
    return out.select("doc_id", "masked_text", F.size("leaks").alias("n_leaks"))


def owned_turns(spark, sf_dir):
    """The conversations' turns, each with the address of its conversation, and from turn 2 on another."""
    return read_table(spark, sf_dir, "conversations").withColumn("text", F.expr("text || chr(10) || 'Email: c' || cast(conv_id as string) || '@x.example.com' || CASE WHEN turn >= 2 THEN chr(10) || 'Mail: d' || cast(conv_id as string) || '@x.example.com' ELSE '' END"))


@query("""SELECT conv_id, cast(turn as int) AS turn, 'OddError: on <EMAIL_ADDRESS_001> and ' || CASE WHEN turn >= 2 THEN '<EMAIL_ADDRESS_002>' ELSE 'D' || conv_id || '@x.example.com' END AS error FROM conversations""")
def redacted_failures(spark, sf_dir):
    """A provider's message repeats addresses; what the conversation knows by that turn is replaced."""
    turns = owned_turns(spark, sf_dir)
    _, minted, spelled = jobs.mask_conversations(turns, roles=None)
    failed = turns.select("conv_id", F.col("turn").cast("int").alias("turn"), F.lit("OddError").alias("error_class"), F.expr("'on C' || cast(conv_id as string) || '@x.example.com and D' || cast(conv_id as string) || '@x.example.com' || chr(10) || 'more'").alias("error_message"))
    return jobs.describe_failures(failed, minted, spelled).select("conv_id", "turn", "error")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)
SELECT c_custkey AS doc_id, 'No answer to <PERSON_' || CASE WHEN k < 1000 THEN lpad(cast(k as varchar), 3, '0') ELSE cast(k as varchar) END || '>, sent by ' || c_name || '0' AS told FROM n""")
def redacted_by_nation(spark, sf_dir):
    """A third party's texts, each redacted with all names of its nation; a longer number is none of them."""
    rows = customers(spark, sf_dir)
    found = rows.select("c_nationkey", F.col("c_custkey").cast("int").alias("seq"), F.lit(0).alias("start"), F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("value"))
    minted = vault.mint(found, ["c_nationkey"], secret=SECRET)
    told = rows.select("c_nationkey", F.col("c_custkey").alias("doc_id"), F.concat(F.lit("No answer to "), F.upper("c_name"), F.lit(", sent by "), "c_name", F.lit("0")).alias("told"))
    return mask.redact(told, vault.entries(minted, ["c_nationkey"], vault.variants(found, minted, ["c_nationkey"])), ["c_nationkey"], "told").select("doc_id", "told")


@query("""SELECT conv_id, cast(turn as int) AS turn, 'c' || conv_id || '@x.example.com and ' || CASE WHEN turn >= 2 THEN 'd' || conv_id || '@x.example.com' ELSE '<EMAIL_ADDRESS_002>' END AS restored FROM conversations""")
def replies_as_of_turn(spark, sf_dir):
    turns = owned_turns(spark, sf_dir)
    _, minted, _ = jobs.mask_conversations(turns, roles=None)
    replies = turns.select("conv_id", F.col("turn").cast("int").alias("turn"), F.lit("<EMAIL_ADDRESS_001> and <EMAIL_ADDRESS_002>").alias("answer"))
    return jobs.restore_replies(replies, minted).select("conv_id", "turn", "restored")


@query(f"""WITH {EXCHANGES_SQL}, z AS (SELECT *, CASE WHEN turn >= 2 THEN 1 ELSE 0 END AS thread FROM x)
SELECT a.conv_id, a.turn, a.thread :: BIGINT AS thread, cast(2 * count(b.turn) as int) AS n_messages FROM z a LEFT JOIN z b ON b.conv_id = a.conv_id AND b.thread = a.thread AND b.turn < a.turn AND b.ok GROUP BY 1, 2, 3""")
def history_after_reset(spark, sf_dir):
    """Every conversation is reset at its second turn; histories don't reach back over it."""
    rows = exchanges(spark, sf_dir)
    resets = rows.select("conv_id").distinct().withColumn("turn", F.lit(2))
    out = conversation.with_history(conversation.with_threads(rows, resets), ["conv_id", "thread"], max_turns=100)
    return out.select("conv_id", "turn", "thread", F.size("history").alias("n_messages"))


@query("SELECT count(*) FILTER (c_custkey % 2 = 0) AS n_sealed, count(*) FILTER (c_custkey % 4 = 0) AS n_declined FROM customer")
def sealed_and_declined_totals(spark, sf_dir):
    """Even records mention their name again without a label, every fourth has an address that may stay."""
    extra = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\nsaid "), F.upper(F.regexp_extract("text", "Full name: (.*)", 1)))).otherwise(F.col("text"))
    docs = records(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(extra, F.lit("\nAddress: "), F.col("doc_id").cast("string"), F.lit(" Long Lane"))).otherwise(extra))
    said = docs.where("doc_id % 4 = 0").select(F.lit("LOCATION").alias("entity_type"), F.concat(F.col("doc_id").cast("string"), F.lit(" long lane")).alias("value_key"), F.lit("no").alias("answer"))
    out, _, _ = mask.mask(detect.detect(docs.withColumn("seq", F.lit(0))), ["doc_id"], decisions=said, confirm_below=0.9)
    return report.sealed_and_declined(out)


@query(f"WITH {ORDERS_SQL}, a AS (SELECT DISTINCT c_nationkey, lower(value) AS k FROM m WHERE seq % 2 = 0) SELECT m.c_nationkey, count(*) AS n FROM m JOIN a ON a.c_nationkey = m.c_nationkey AND a.k = lower(m.value) WHERE m.seq % 2 = 1 GROUP BY 1")
def values_seen_again(spark, sf_dir):
    """Mentions in odd orders of customers that the even orders' vault knows."""
    found = order_mentions(spark, sf_dir)
    first = vault.mint(found.where("seq % 2 = 0"), ["c_nationkey"], secret=SECRET)
    return report.seen_again(found.where("seq % 2 = 1"), first, ["c_nationkey"]).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ORDERS_SQL} SELECT c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS n_entries, k AS match_key FROM (SELECT DISTINCT c_nationkey, lower(value) AS k FROM m)")
def vault_entries_in_order(spark, sf_dir):
    minted = vault.mint(order_mentions(spark, sf_dir), ["c_nationkey"], secret=SECRET)
    return vault.in_order(minted, ["c_nationkey"]).select("c_nationkey", "n_entries", "match_key")


@query(f"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9a-f]{{40}}\\b')) AS value FROM documents), {EMAILS_SQL}
SELECT doc_id, 'EMAIL_ADDRESS' AS entity_type, value FROM emails UNION ALL SELECT doc_id, 'IP_ADDRESS', unnest(regexp_extract_all(text, '{IP_RE}')) FROM documents UNION ALL SELECT doc_id, 'API_KEY', value FROM h""")
def model_spans(spark, sf_dir):
    """A detector of the caller's own, in Python over Arrow batches, next to the patterns: it finds keys that no pattern knows, and mail
    hosts, which lie inside of addresses and lose to them."""
    return detect.explode_spans(detect.detect(documents(spark, sf_dir), entities=("EMAIL_ADDRESS", "IP_ADDRESS", "API_KEY", "HOST"), extra=[detect.model_detector(hex_keys)]), "doc_id").select("doc_id", "entity_type", "value")


def hex_keys(texts):
    """A model: forty hexadecimal digits are a key, and the part behind an @ is a host."""
    import re

    import pyarrow as pa

    kinds = (("API_KEY", 0.95, re.compile(r"(?a)\b[0-9a-f]{40}\b")), ("HOST", 0.9, re.compile(r"(?a)(?<=@)[a-z0-9.]+\b")))
    spans = [None if t is None else [{"entity_type": kind, "start": m.start(), "end": m.end(), "score": score} for kind, score, p in kinds for m in p.finditer(t)] for t in texts.to_pylist()]
    return pa.array(spans, pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))


@query(f"""WITH r AS (SELECT c_custkey AS doc_id, {TWO_NAMES} AS text, c_name, length(c_name) :: INTEGER AS n FROM customer),
s AS (SELECT doc_id, text, unnest([struct_pack(s := 11, n := n), struct_pack(s := 11 + n + 9, n := n + 8), struct_pack(s := strpos(text, 'Then ') + 4, n := n), struct_pack(s := strpos(text, ' met ') + 4, n := n + 8)]) AS p FROM r)
SELECT doc_id, p.s :: INTEGER AS "start", (p.s + p.n) :: INTEGER AS "end", substr(text, (p.s + 1) :: BIGINT, p.n :: BIGINT) AS value FROM s""")
def known_names(spark, sf_dir):
    """The names of all customers, and of their partners, from a table, over all records, in any case; the longer one stays."""
    rows = customers(spark, sf_dir)
    values = rows.select(F.lit("PERSON").alias("entity_type"), F.explode(F.array("c_name", F.concat(F.lit("Partner "), "c_name"))).alias("value"))
    docs = rows.select(F.col("c_custkey").alias("doc_id"), F.expr(TWO_NAMES).alias("text"))
    found = known.find(docs, values, ignore_case=True)
    return detect.explode_spans(found.select("doc_id", detect.resolve(F.col("known")).alias("spans")), "doc_id").select("doc_id", "start", "end", "value")


#: Turns of which each tenth conversation has lost its id; the first turn names a person by a label, later ones without.
LOST = """SELECT CASE WHEN conv_id % 10 <> 0 THEN conv_id END AS conv_id, conv_id AS was, turn, turn = min(turn) OVER (PARTITION BY conv_id) AS first, text FROM conversations"""


@query(f"""WITH t AS ({LOST}), f AS (SELECT conv_id, was, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text), 'quill' || was) AS k FROM t WHERE first)
SELECT t.conv_id, cast(turn as int) AS turn, text || chr(10) || CASE WHEN first THEN 'Name: ' ELSE 'ask ' END || '<PERSON_' || format('{{:03d}}', k) || '>' || CASE WHEN first THEN '' ELSE ' again' END AS masked_text, true AS released FROM t JOIN f USING (was)""")
def conversations_without_ids(spark, sf_dir):
    """Turns without a conversation's id share one vault and are masked, swept and guarded like others."""
    read_table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations_lost")
    turns = spark.sql(LOST.replace("FROM conversations", "FROM conversations_lost"))
    said = F.when(F.col("first"), F.concat("text", F.lit("\nName: Quill"), "was")).otherwise(F.concat("text", F.lit("\nask QUILL"), "was", F.lit(" again")))
    out, _, _ = jobs.mask_conversations(turns.select("conv_id", "turn", F.lit("user").alias("role"), said.alias("text")))
    return out.select("conv_id", F.col("turn").cast("int").alias("turn"), "masked_text", (~mask.unsafe_in(out)).alias("released"))


NEIGHBOURS = "lag(upper(c_name), 1, 'nobody') OVER (ORDER BY c_custkey) AS before, lead(upper(c_name), 1, 'nobody') OVER (ORDER BY c_custkey) AS after"


@query(f"""WITH n AS (SELECT c_custkey AS doc_id, row_number() OVER (ORDER BY c_custkey) AS k, {NEIGHBOURS} FROM customer)
SELECT doc_id, 'Full name: <PERSON_' || format('{{:03d}}', k) || '>' || chr(10) || 'met ' || CASE WHEN k > 1 THEN '<PERSON_' || format('{{:03d}}', k - 1) || '>' ELSE before END || ' and ' || after AS masked_text, CASE WHEN after <> 'nobody' THEN 1 ELSE 0 END AS n_leaks FROM n""")
def mask_corpus_causal(spark, sf_dir):
    """One vault that grows from record to record: a name that an earlier record introduced is swept, one that only a later one
    does stays, and the leak search over all texts reports it."""
    rows = customers(spark, sf_dir)
    # each neighbour is the next key up or down, as keys have no gaps
    name = lambda alias, step: rows.select((F.col("c_custkey") + step).alias("c_custkey"), F.upper("c_name").alias(alias))
    met = rows.join(wide(name("before", 1)), "c_custkey", "left").join(wide(name("after", -1)), "c_custkey", "left").fillna("nobody", ["before", "after"])
    docs = met.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Full name: "), "c_name", F.lit("\nmet "), "before", F.lit(" and "), "after").alias("text"))
    out, _, _ = mask.mask_corpus(docs, secret=SECRET, sweep_scope="causal")
    return out.select("doc_id", "masked_text", F.size("leaks").alias("n_leaks"))


def live_events(turns: DataFrame) -> DataFrame:
    """Even turns are questions, odd ones replies to them; each conversation is reset at turn 4, and its first turn comes along without an id."""
    event = lambda turn, kind, text: F.struct(turn.alias("turn"), F.lit(kind).alias("kind"), text.alias("text"))
    asked = event(F.col("turn"), "turn", F.expr("text || chr(10) || 'Email: c' || cast(conv_id as string) || '@x.example.com' || CASE WHEN turn >= 2 THEN chr(10) || 'Mail: d' || cast(conv_id as string) || '@x.example.com' ELSE '' END"))
    told = event(F.col("turn") - 1, "reply", F.lit("<EMAIL_ADDRESS_001> and email_address 2"))
    more = F.when(F.col("turn") == 0, event(F.lit(4).cast("long"), "reset", F.lit(None).cast("string")))
    odd = F.when(F.col("turn") == 0, event(F.lit(None).cast("long"), "turn", F.col("text")))
    one = F.when(F.col("turn") % 2 == 0, asked).otherwise(told)
    return turns.select("conv_id", F.explode(F.array_compact(F.array(one, more, odd))).alias("e")).select("conv_id", "e.*")


@query("""WITH q AS (SELECT *, turn >= 4 AS thread FROM conversations WHERE turn % 2 = 0), a AS (SELECT conv_id, turn - 1 AS turn, turn - 1 >= 4 AS thread FROM conversations WHERE turn % 2 = 1),
h AS (SELECT q.conv_id, q.turn, least(4, 2 * count(a.turn)) AS n FROM q LEFT JOIN (SELECT a.* FROM a JOIN q USING (conv_id, turn)) a ON a.conv_id = q.conv_id AND a.turn < q.turn AND a.thread = q.thread GROUP BY 1, 2)
SELECT conv_id, turn, 'released' AS status, text || chr(10) || 'Email: <EMAIL_ADDRESS_001>' || CASE WHEN turn >= 2 THEN chr(10) || 'Mail: <EMAIL_ADDRESS_002>' ELSE '' END AS said, n :: INTEGER AS n_history FROM q JOIN h USING (conv_id, turn)
UNION ALL SELECT conv_id, turn, 'answered', 'c' || conv_id || '@x.example.com and ' || CASE WHEN turn >= 2 THEN 'd' || conv_id || '@x.example.com' ELSE 'email_address 2' END, 0 FROM a
UNION ALL SELECT conv_id, NULL, 'malformed', text, 0 FROM conversations WHERE turn = 0""")
def live_conversations(spark, sf_dir):
    """The whole live job over the conversations' files: requests with history, replies, resets, malformed events, into its tables."""
    use_rocksdb(spark)
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    turns = spark.readStream.schema(read_table(spark, sf_dir, "conversations").schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/conversations.parquet*")
    sinks.deliver(live.live(live_events(turns), max_turns=2), f"{folder}/out", f"{folder}/state", trigger={"availableNow": True}).awaitTermination()
    table = lambda name: sinks.delivered(spark, f"{folder}/out", name)
    row = lambda df, status, said, n: df.select("conv_id", "turn", F.lit(status).alias("status"), F.col(said).alias("said"), n.cast("int").alias("n_history"))
    return row(table("released"), "released", "masked_text", F.size("messages") - 2).union(row(table("answers"), "answered", "restored", F.lit(0))).union(row(table("malformed"), "malformed", "text", F.lit(0)))


@query("""WITH q AS (SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0), a AS (SELECT conv_id, turn - 1 AS turn FROM conversations WHERE turn % 2 = 1)
SELECT conv_id, turn, CASE WHEN a.turn IS NULL OR conv_id % 3 = 1 THEN 'missing' ELSE 'answered' END AS status FROM q LEFT JOIN a USING (conv_id, turn)
UNION ALL SELECT conv_id, turn, 'late' FROM a WHERE conv_id % 3 = 1 OR (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM q)""")
def live_replies(spark, sf_dir):
    """Requests and replies as two streams, joined as they come; every third conversation's replies take twenty minutes."""
    use_rocksdb(spark)
    folder = f"{shared_folder(spark)}/replies-{uuid.uuid4().hex}"
    schema = read_table(spark, sf_dir, "conversations").schema

    def stream(rest: int, at: str, delay: str) -> DataFrame:
        turns = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/conversations.parquet*").select("conv_id", "turn")
        own = F.when(F.col("turn") % 2 == rest, F.struct("conv_id", (F.col("turn") - rest).alias("turn"), F.expr(f"timestamp'2024-01-01' + make_dt_interval(0, 0, int(turn - {rest}), {delay})").alias(at)))
        # a day later a row that meets nothing moves the watermark over all others
        end = F.when(F.col("turn") == rest, F.struct(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.expr("timestamp'2024-01-02'").alias(at)))
        return turns.select(F.explode(F.array_compact(F.array(own, end))).alias("e")).select("e.*")

    replies = stream(1, "answered_at", "CASE WHEN conv_id % 3 = 1 THEN 1200 ELSE 30 END").withColumn("answer", F.lit("yes"))
    joined = live.answered(stream(0, "asked_at", "0"), replies).select("conv_id", "turn", "status")
    joined.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("conv_id long, turn long, status string").parquet(f"{folder}/out")


@query("""SELECT 'PERSON' AS entity_type, 2 AS n_runs, true AS near FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)""")
def value_profile(spark, sf_dir):
    """How many values two runs have seen in all, from their sketches alone, against the exact count."""
    runs = [read_table(spark, sf_dir, "customer").select(F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("value")), order_mentions(spark, sf_dir).select("entity_type", "value")]
    sketches = report.value_sketches(runs[0]).withColumn("run", F.lit(1)).union(report.value_sketches(runs[1]).withColumn("run", F.lit(2)))
    exact = report.distinct_values(runs[0].union(runs[1]))
    out = report.sketched_values(sketches).join(exact.withColumnRenamed("n_values", "n"), "entity_type")
    return out.select("entity_type", F.col("n_runs").cast("int").alias("n_runs"), (F.abs(F.col("n_values") - F.col("n")) <= F.col("n") * 0.02).alias("near"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_values_by_type(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
