"""The registered queries of this subpackage: name -> f(spark, sf_dir), and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, blocknames, bpe, langid, lexical, licenses, minhash, packing, quality, repair, secrets, toxicity, urlfilter
from .common import documents


def op1_pruned_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op11_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.groups(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pruned_graph_ann,
        op2_minhash_dedup,
        op3_license_scan,
        op4_language_id,
        op5_secret_scan,
        op6_url_cascade,
        op7_byte_bpe,
        op8_toxicity,
        op9_best_fit_packing,
        op10_quality_rules,
        op11_block_naming,
        op12_conversation_repair,
        op13_reversed_search,
    )
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN list_filter([''], lambda x: x <> '') WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON a = doc_id"""

OP10_SQL = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, k, w[k:k + 2] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w WHERE len(w) > 2)),
d AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, v) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT k + o) AS n FROM d, (VALUES (0), (1), (2)) z(o) GROUP BY 1),
m AS (SELECT w.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed,
  100 * n_symbols > {quality.MAX_SYMBOLS} * n_words AS symbols, n_dup_lines >= {quality.MIN_DUP_LINES} AND 100 * n_dup_lines > {quality.MAX_DUP_LINES} * n_lines AS lines, 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS repeats,
  100 * n_symbols > {quality.STRICT_SYMBOLS} * n_words AS near_symbols, n_dup_lines >= {quality.MIN_DUP_LINES} AND 100 * n_dup_lines > {quality.STRICT_DUP_LINES} * n_lines AS near_lines, 100 * n_repeat_words > {quality.STRICT_REPEAT} * n_words AS near_repeats FROM m),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (hit) AS x FROM (SELECT source, unnest([struct_pack(rule := 'any', hit := base_failed OR symbols OR lines), struct_pack(rule := 'repeats', hit := repeats), struct_pack(rule := 'symbols', hit := symbols), struct_pack(rule := 'lines', hit := lines)], recursive := true) FROM f WHERE source IS NOT NULL) GROUP BY 1, 2),
o AS (SELECT rule, sum(x) / sum(n) AS p, greatest(0, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) ** 2 - sum(x) / sum(n) * (1 - sum(x) / sum(n)) * count(*) / sum(n)) AS v FROM h GROUP BY 1),
b AS (SELECT rule, p, CASE WHEN v > 0 THEN least(1000, greatest(1, p * (1 - p) / v - 1)) ELSE 1000 END AS k FROM o),
q AS (SELECT source, bool_or(rule = 'any' AND r > {quality.MAX_HOST_RATE}) AS gone, bool_or(rule = 'repeats' AND r > {quality.LIFT} * p) AS r, bool_or(rule = 'symbols' AND r > {quality.LIFT} * p) AS s, bool_or(rule = 'lines' AND r > {quality.LIFT} * p) AS l FROM (SELECT source, h.rule, p, (x + p * k) / (n + k) AS r FROM h JOIN b USING (rule)) GROUP BY 1),
k AS (SELECT f.*, base_failed OR symbols OR lines AS failed, coalesce(gone OR (r AND near_repeats) OR (s AND near_symbols) OR (l AND near_lines), false) AS host FROM f LEFT JOIN q USING (source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT host AS kept, NOT failed AND host AS host_failed FROM k"""

OP11_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(k) AS text_sha256
FROM t WINDOW w AS (PARTITION BY k ORDER BY n DESC, doc_id)"""



def _edited(label: str, price: str, letter: str) -> str:
    """A label of the edit lattice, six digits of cost and the audit behind them, after one more edit; ~ is no way."""
    return f"CASE WHEN {label} = '~' THEN '~' ELSE lpad(cast(cast(left({label}, 6) AS INTEGER) + {price} AS VARCHAR), 6, '0') || substr({label}, 7) || '{letter}' END"


def _kept(label: str, initial: str) -> str:
    """Keep, of a row of this initial; Rerole otherwise, which costs more."""
    return f"CASE WHEN y.f = 'x' THEN '~' WHEN y.c = '{initial}' THEN {_edited(label, 'y.t', 'K')} ELSE {_edited(label, '1 + y.t', 'R')} END"


_CRC = """xor(list_reduce(list_concat([4294967295 :: BIGINT], list_transform(string_split(coalesce(conv_id :: VARCHAR, ' ') || ':' || coalesce(turn :: VARCHAR, ' '), ''), lambda z: ascii(z) :: BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295 :: BIGINT)"""

#: One pass over the rows with a label for each state, inserts before each row and at the end, in place of two searches that meet.
OP12_SQL = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS d FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS c FROM r WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS i FROM x),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
s AS (SELECT conv_id, i, unnest([1, 2, 3]) AS k, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE '' END AS f, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS t, left(role, 1) AS c FROM f UNION ALL SELECT conv_id, max(i) + 1, unnest([1, 2]), '', 0, '' FROM f GROUP BY 1),
l AS (SELECT conv_id, list_prepend(struct_pack(n := '000000', s := '~', u := '~', a := '~', k := 0, f := '', t := 0, c := ''), list(struct_pack(n := '~', s := '~', u := '~', a := '~', k := k, f := f, t := t, c := c) ORDER BY i, k)) AS l FROM s GROUP BY 1),
b AS (SELECT conv_id, list_reduce(l, lambda x, y: struct_pack(
  n := CASE WHEN y.k < 3 THEN x.n ELSE {_edited("x.n", "2", "D")} END,
  s := CASE WHEN y.k < 3 THEN x.s ELSE least({_edited("x.s", "2", "D")}, CASE WHEN y.f = '' AND y.c = 's' THEN {_edited("x.n", "y.t", "K")} ELSE '~' END) END,
  u := CASE y.k WHEN 1 THEN least(x.u, {_edited("least(x.n, x.s, x.a)", "5", "I")}) WHEN 2 THEN x.u ELSE least({_edited("x.u", "2", "D")}, {_kept("least(x.n, x.s, x.a)", "u")}) END,
  a := CASE y.k WHEN 1 THEN x.a WHEN 2 THEN least(x.a, {_edited("x.u", "5", "I")}) ELSE least({_edited("x.a", "2", "D")}, {_kept("x.u", "a")}) END,
  k := y.k, f := y.f, t := y.t, c := y.c)) AS z FROM l),
v AS (SELECT conv_id, least(z.n, z.a) AS v FROM b),
e AS (SELECT conv_id, p, substr(substr(v, 7), p, 1) AS h FROM (SELECT conv_id, v, unnest(range(1, length(v) - 5)) AS p FROM v)),
w AS (SELECT *, count(*) FILTER (h <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, count(*) FILTER (h <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS q FROM e),
m AS (SELECT w.conv_id, p, h, q, f.role, CASE WHEN h = 'I' THEN '' ELSE f.text END AS text, bool_or(q = 1 AND h = 'K' AND left(f.role, 1) = 's') OVER (PARTITION BY w.conv_id) AS led FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i AND h <> 'I' WHERE h <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN h = 'K' THEN role WHEN (q + led :: INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS t FROM m GROUP BY 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(v, 6) :: BIGINT, 0) AS cost, coalesce(substr(v, 7), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = rf"""
WITH i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
a AS (SELECT doc_id, {_TERMS} AS l FROM documents),
s AS (SELECT count(*) FILTER (len(l) > 0) AS big_n, sum(len(l)) :: BIGINT AS big_l FROM a),
c AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(l) AS t FROM a) WHERE t IN (SELECT t FROM i) GROUP BY 1, 2),
w AS (SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) :: BIGINT AS w FROM c, s GROUP BY 1),
m AS (SELECT doc_id, 10 + (90 * len(l) * big_n) // big_l AS m FROM a, s WHERE len(l) > 0),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) :: BIGINT AS score FROM i JOIN c USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) :: INTEGER AS rank, doc_id, score FROM x WHERE score > 0) WHERE rank <= 10"""

ORACLES: dict[str, str] = {"op11_block_naming": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_reversed_search": OP13_SQL, "op2_minhash_dedup": OP2_SQL, "op6_url_cascade": urlfilter.oracle(), "op10_quality_rules": OP10_SQL}
