"""Queries that apply each operator to its whole table, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrace.llm import bpe, decontaminate, langid, lines, lm, merkle, quality, rules, search, secrets, setjoin, simhash, viterbi
from flowtrace.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return deco


@_query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path).drop("ids")


_WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LINES = r"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"


def _rules_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in rules.STOP_LIST)
    base = " OR ".join(r.fails() for r in rules.BASE_RULES)
    every = " OR ".join(r.fails() for r in rules.BASE_RULES + rules.RATIO_RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, {_WORDS} AS w, {_LINES} AS l FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(replace(text, '!', '')) AS n_bangs,
  len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis_lines,
  len(list_filter(l, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '•'))) AS n_bullet_lines,
  coalesce(cov.n, 0) AS n_repeat_words FROM s LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({base}) AS base_failed, NOT ({every}) AS kept FROM m"""


@_query("op5_quality_rules", _rules_sql())
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.dedup_rows(table(spark, sf_dir, "documents"))
    return made.select("row.doc_id", "row.text", F.size("dropped").cast("bigint").alias("n_dropped"))


@_query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@_query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(table(spark, sf_dir, "documents"))


@_query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    count = lambda kind: F.size(secrets.of_kinds(F.col("spans"), kind)).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.joined(secrets.of_kinds(F.col("spans"), "assign", "access", "hex")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"))


@_query("op8_language_model")
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 6) -> str:
    """Levels are written out: enough for 16 to the power of ``levels`` leaves a source, and as many sources."""
    digest = lambda text: "sha256(" + " || ".join(
        f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 of the id's digits, bit by bit
    crc = ("xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), "
           "lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], "
           "[0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))")
    parts = [f"""d AS (SELECT doc_id, source, {digest("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {digest(low)} END AS bad FROM documents),
r AS (SELECT doc_id, leaf, coalesce(bad, leaf) AS x, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
a0 AS (SELECT s, i, n, leaf AS h FROM r)"""]
    run = "string_agg(h, '' ORDER BY i)"
    side = lambda frame: f"coalesce(string_agg(h, '') OVER (PARTITION BY s, i // 16 ORDER BY i ROWS BETWEEN {frame}), '')"
    for tree in "ab":
        if tree == "b":
            parts.append(f"b0 AS (SELECT 0 AS s, s AS i, count(*) OVER () AS n, h FROM a{levels})")
        for k in range(levels):
            parts.append(f"{tree}{k + 1} AS (SELECT s, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256({run}) END AS h "
                         f"FROM {tree}{k} GROUP BY s, i // 16, n)")
            parts.append(f"{tree}p{k} AS (SELECT s, i, n, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, "
                         f"{side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS g FROM {tree}{k})")
    last = "r"
    for tree, top in (("a", "last.s"), ("b", "0")):
        for k in range(levels):
            place = "last.i" if tree == "a" else "last.s"
            seen = "''" if last == "r" else "last.proof"
            parts.append(f"{tree}w{k} AS (SELECT last.doc_id, last.leaf, last.s, last.i, {seen} || p.l || p.g AS proof, "
                         f"CASE WHEN p.n = 1 THEN last.x ELSE sha256(p.l || last.x || p.g) END AS x "
                         f"FROM {last} AS last JOIN {tree}p{k} AS p ON p.s = {top} AND p.i = {place} // {16 ** k})")
            last = f"{tree}w{k}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT w.doc_id, w.leaf, t.h AS subroot, u.h AS root, sha256(w.proof) AS proof_sha256, w.x AS folded_root, w.x = u.h AS verified
FROM {last} AS w JOIN a{levels} AS t ON t.s = w.s CROSS JOIN b{levels} AS u"""


@_query("op11_merkle_manifest", _merkle_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.audit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@_query("op12_lexical_search", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS t FROM d) GROUP BY r, doc_id, len(w), t),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, n_docs),
q AS (SELECT k, item_id, t, count(*) AS qtf FROM (SELECT row_number() OVER () AS k, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY k, item_id, t),
m AS (SELECT k, item_id, r, doc_id,
  sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN p USING (t), s GROUP BY k, item_id, r, doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score FROM m WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op13_jaccard_join", r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM d),
u AS (SELECT r, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.r AS x, b.r AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM u AS a JOIN u AS b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n),
l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (nx + ny - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y AS x, x AS y FROM l),
reach AS (SELECT x AS r, x AS v FROM e UNION SELECT reach.r, e.y AS v FROM reach JOIN e ON e.x = reach.v),
comp AS (SELECT reach.r, min(s.doc_id) AS least FROM reach JOIN s ON s.r = reach.v GROUP BY reach.r)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, CASE WHEN comp.r IS NULL THEN s.doc_id ELSE comp.least END AS component_id
FROM s LEFT JOIN comp ON comp.r = s.r""")
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join_components(table(spark, sf_dir, "documents"))
