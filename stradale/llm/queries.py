"""Queries of the training-data operators and the SQL that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dedup, grade, html, language, pieces, pii, rules, secrets, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: expected grade and tail probabilities of a model fitted on the rated documents. Nulls as in grade.py."""
    docs = table(spark, sf_dir, "documents")
    return grade.rate(docs, grade.fit(docs, grade.graded(table(spark, sf_dir, "labels"))))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: its main text and the number of its characters; empty for null, empty or textless pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: benchmark items that it holds (aligned copies at the threshold), the best one and its score."""
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: host, path, the rule that fits, and the verdict, which is the rule's or that of trees fitted on the URLs that rules label."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.fit(urls.ruled(pages), "bad"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: base counts and digest, and all spans with those of named literals; a null text counts as empty."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: the language predicted from its bytes alone, learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    said = language.identify(docs, language.fit(docs))
    return said.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: size of its set of two-word shingles, its class and whether it is kept."""
    return dedup.classes(table(spark, sf_dir, "documents"), words=2)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: number and digest of its pieces' ids, digest of the decoded text; a null text counts as empty."""
    return pieces.piece_digests(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: base counts and digest, and all spans with those that the field adds; a null text counts as empty."""
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit(docs))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: base counts, base_failed, and kept by the rules as its host's verdict applies them."""
    return rules.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_grade": op1_quality_grade,
    "op2_main_text": op2_main_text,
    "op3_decontamination": op3_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_pieces": op8_pieces,
    "op9_quality_rules": op9_quality_rules,
    "op10_personal_data": op10_personal_data,
}

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = f"list_filter(regexp_split_to_array({{0}}, '{_SPACE}+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Exact classes by a self-join on shingles: for small tables.
_CLASSES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 80 * (a.k + b.k - m)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT x, y FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
c AS (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(k, 0) AS n_shingles, coalesce(least(low, w.doc_id), w.doc_id) AS component_id, coalesce(low >= w.doc_id, true) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.doc_id = w.doc_id
"""


def _rules_sql() -> str:
    r = {**rules.RULES, "words": ("n_words", rules.MIN_WORDS, rules.SOFT_MIN_WORDS)}
    soft = ", ".join(f"{v} {'<' if k == 'words' else '>'} {limit} AS soft_{k}" for k, (v, _, limit) in r.items())
    fails = ", ".join(f"sum(CAST(soft_{k} AS INTEGER)) AS f_{k}" for k in r)
    total = ", ".join(f"avg(f_{k} / n) AS m_{k}, coalesce(var_pop(f_{k} / n), 0) AS v_{k}" for k in r)
    strength = {k: f"least(1e4, greatest(1.0, coalesce(m_{k} * (1 - m_{k}) / nullif(v_{k}, 0) - 1, 1e4)))" for k in r}
    other = ", ".join(f"CASE WHEN n_hosts > 1 THEN greatest(0.0, (m_{k} * n_hosts - f_{k} / n) / (n_hosts - 1)) ELSE f_{k} / n END AS o_{k}, {strength[k]} AS s_{k}" for k in r)
    rate = ", ".join(f"(f_{k} + s_{k} * o_{k}) / (n + s_{k}) AS rate_{k}, o_{k}" for k in r)
    over = {k: f"coalesce((rate_{k} - o_{k}) / nullif(o_{k} * ({rules.HOST_FACTOR} - 1), 0), CASE WHEN rate_{k} > o_{k} THEN 1.0 ELSE 0.0 END)" for k in r}
    strict = ", ".join(f"round(greatest(0.0, least(1.0, {over[k]})), 9) AS strict_{k}" for k in r)
    plain = " OR ".join(f"{v} > {hard}" for v, hard, _ in rules.RULES.values())
    host = " OR ".join(f"({v} <= {hard} AND {v} > round({hard} - ({hard} - {low}) * strict_{k}, 9))" for k, (v, hard, low) in rules.RULES.items())
    host += f" OR (n_words >= {rules.MIN_WORDS} AND n_words < round({rules.MIN_WORDS} + ({rules.SOFT_MIN_WORDS} - {rules.MIN_WORDS}) * strict_words, 6))"
    base = f"(n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w))),
h AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM g, range(3) o(j) WHERE k > 1 GROUP BY rid),
c AS (SELECT rid, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN h USING (rid)),
q AS (SELECT *, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS r_repeat, coalesce(n_symbols / nullif(n_words, 0), 0) AS r_symbol, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS r_dup FROM c),
f AS (SELECT *, {soft} FROM q),
o AS (SELECT host, count(*) AS n, {fails} FROM f GROUP BY host),
m AS (SELECT count(*) AS n_hosts, {total} FROM o),
x AS (SELECT host, n, {", ".join(f"f_{k}" for k in r)}, {other} FROM o, m),
v AS (SELECT host, {rate} FROM x),
b AS (SELECT host, {strict} FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, ({host}) AS host_failed, NOT {base} AND NOT ({plain}) AND NOT ({host}) AS kept
FROM f JOIN b ON f.host IS NOT DISTINCT FROM b.host
"""


#: The others train models, align, lex or tokenize, which SQL cannot express.
ORACLE: dict[str, str] = {"op7_near_duplicates": _CLASSES, "op9_quality_rules": _rules_sql()}
