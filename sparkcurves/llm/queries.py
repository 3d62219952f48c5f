"""The registered queries of this package, and their DuckDB twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurves.llm import (
    ann, audit, blocks, chat, forest_dedup, licenses, line_dedup, merkle, mixing, packing, quality, token_counts, toxicity)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces_digest(packing.pack(table(spark, sf_dir, "documents")))


@registered
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@registered
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@registered
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.conversation_digest(rows.unionByName(extra))


@registered
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2).drop("text_key")


@registered
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "passes", "source")


@registered
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


@registered
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@registered
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@registered
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_audit(table(spark, sf_dir, "documents"))


@registered
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.damage_report(table(spark, sf_dir, "conversations"))


@registered
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents")).drop("bitmap")


SQL["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


# crc32 of an ASCII string, byte by byte and bit by bit
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda ch: ord(ch)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


SQL["op11_manifest"] = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, lang, {_leaf("text")} AS leaf, {_leaf("seen")} AS other,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos
    FROM (SELECT *, CASE WHEN {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 0
                         THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS seen FROM documents)),
low AS (
    SELECT lang, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM docs
    UNION ALL
    SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8
    FROM low WHERE n > 1 GROUP BY lang, level, pos // 8),
langs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM low WHERE n = 1),
high AS (
    SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM langs
    UNION ALL
    SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM high WHERE n > 1 GROUP BY level, pos // 8),
steps AS (
    SELECT a.lang, 0 AS part, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
           coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM low a JOIN low b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
    UNION ALL
    SELECT NULL, 1, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''),
           coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
    FROM high a JOIN high b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
paths AS (
    SELECT d.lang, d.pos, list(s.l || '|' || s.r ORDER BY s.part, s.level) FILTER (s.level IS NOT NULL) AS path
    FROM docs d JOIN langs g ON d.lang IS NOT DISTINCT FROM g.lang
    LEFT JOIN steps s ON (s.part = 0 AND s.lang IS NOT DISTINCT FROM d.lang AND s.pos = d.pos >> (3 * s.level))
                      OR (s.part = 1 AND s.pos = g.pos >> (3 * s.level))
    GROUP BY d.lang, d.pos),
folded AS (
    SELECT d.doc_id, d.leaf, g.subroot, (SELECT h FROM high WHERE n = 1) AS root,
           sha256(coalesce(replace(array_to_string(p.path, ''), '|', ''), '')) AS proof_sha256,
           list_reduce(list_prepend(d.other, coalesce(p.path, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
    FROM docs d JOIN langs g ON d.lang IS NOT DISTINCT FROM g.lang JOIN paths p ON d.lang IS NOT DISTINCT FROM p.lang AND d.pos = p.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

SQL["op12_repair"] = f"""
WITH RECURSIVE kinds AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
    FROM conversations),
made AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS again
    FROM kinds WHERE kind <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i, role[1] AS c,
           right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM made),
faults AS (
    SELECT *, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                   WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
           lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM placed),
edits(letter, cost, c, a, b) AS (VALUES
    ('D', 4, '', 0, 0), ('D', 4, '', 1, 1), ('D', 4, '', 2, 2), ('D', 4, '', 3, 3), ('K', 0, 's', 0, 1), ('K', 0, 'u', 0, 2), ('K', 0, 'u', 1, 2),
    ('K', 0, 'u', 3, 2), ('K', 0, 'a', 2, 3), ('R', 3, '', 0, 2), ('R', 3, '', 1, 2), ('R', 3, '', 3, 2), ('R', 3, '', 2, 3)),
inserts(letters, cost, a, b) AS (VALUES
    ('', 0, 0, 0), ('', 0, 1, 1), ('', 0, 2, 2), ('', 0, 3, 3), ('I', 3, 0, 2), ('II', 6, 0, 3), ('I', 3, 1, 2), ('II', 6, 1, 3), ('I', 3, 2, 3), ('I', 3, 3, 2)),
dp AS (
    SELECT conv_id, 0::BIGINT AS i, s.b AS state, {{'cost': s.cost, 'audit': s.letters}} AS best
    FROM (SELECT DISTINCT conv_id FROM faults) JOIN inserts s ON s.a = 0
    UNION ALL
    SELECT dp.conv_id, dp.i + 1, s.b, min({{'cost': dp.best.cost + e.cost + s.cost + CASE WHEN f.fault = 't' AND e.letter <> 'D' THEN 3 ELSE 0 END,
                                           'audit': dp.best.audit || e.letter || s.letters}})
    FROM dp JOIN faults f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
    JOIN edits e ON e.a = dp.state AND (e.letter <> 'K' OR e.c = f.c) AND (e.letter = 'D' OR f.fault NOT IN ('b', 'd'))
    JOIN inserts s ON s.a = e.b GROUP BY dp.conv_id, dp.i, s.b),
best AS (
    SELECT dp.conv_id, min(best) AS best FROM dp JOIN (SELECT conv_id, max(i) AS n FROM faults GROUP BY conv_id) l
    ON dp.conv_id IS NOT DISTINCT FROM l.conv_id AND dp.i = l.n WHERE state IN (0, 3) GROUP BY dp.conv_id),
letters AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS nth FROM best WHERE best.audit <> ''),
used AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY nth) AS i FROM letters),
shown AS (
    SELECT u.conv_id, u.nth, u.letter, f.role, CASE WHEN u.letter = 'I' THEN '' ELSE f.text END AS text,
           row_number() OVER (PARTITION BY u.conv_id ORDER BY u.nth) AS k,
           first_value(CASE WHEN u.letter = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY u.conv_id ORDER BY u.nth) AS has_s
    FROM used u LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM u.conv_id AND f.i = u.i WHERE u.letter <> 'D'),
texts AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY nth) AS said
    FROM shown GROUP BY conv_id),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
           count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op13_line_dedup"] = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT row, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM docs),
keyed AS (SELECT *, {_KEY} AS key FROM each),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
kept AS (SELECT row, string_agg(line, chr(10) ORDER BY nth) AS text, count(*) AS n FROM keyed ANTI JOIN frequent USING (key) GROUP BY row)
SELECT doc_id, len(lines) AS n_lines, len(lines) - coalesce(n, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (row)
"""
