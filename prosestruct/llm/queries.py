"""The operators over their whole tables, with production parameters: opN_<name>, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard, licenses, mixing, packing, quality_classifier, quality_rules, secrets, token_counts, url_filter


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base_spans", lambda s: s.kind == i))  # noqa: E731  # a second parameter would be the span's place
    counts = [count(i).cast("long").alias(f"n_{kind}") for i, (kind, *_) in enumerate(secrets.BASE)]
    digest = F.sha2(secrets.joined(F.col("base_spans")), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secrets.joined(F.col("all_spans")).alias("spans"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_counts, op2_packing, op3_quality_rules, op4_secret_scan, op5_quality_classifier, op6_license_scan,
            op7_source_mix, op8_jaccard_join, op9_nearest_neighbours, op10_url_filter,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": RULES_SQL, "op8_jaccard_join": JACCARD_SQL, "op7_source_mix": MIX_SQL}


def _texts(values) -> str:
    return ", ".join("'" + (v.decode() if isinstance(v, bytes) else v) + "'" for v in values)


#: The same rules over flat tables of words and lines; a line is lost if any rule holds.
RULES_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM listed),
windows AS (
  SELECT r, i, x, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS five, lead(x, 4) OVER o IS NOT NULL AS whole
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
found AS (SELECT r, i, x, whole AND count(*) OVER (PARTITION BY r, whole, five) > 1 AS often FROM windows),
covered AS (SELECT r, x, bool_or(often) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS again FROM found),
base AS (SELECT r, count(*) AS n_words, sum(length(x)) AS word_chars, count(*) FILTER (WHERE again) AS n_repeat_words FROM covered GROUP BY r),
lines AS (
  SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
filled AS (SELECT *, len(w) AS n, count(*) OVER (PARTITION BY r, line) AS times FROM lines WHERE len(w) > 0),
counted AS (
  SELECT *, len(list_filter(w, lambda x: x IN ({_texts(quality_rules.SEPARATORS)}))) AS separators,
    len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]|[!?][!?]$'))) AS noisy FROM filled),
judged AS (
  SELECT r, line, n, (separators >= 3 AND separators * 10 >= n) OR (n >= 5 AND noisy > 0 AND 2 * noisy >= n)
    OR (n >= {quality_rules.LONG_LINE} AND (5 * len(list_distinct(w)) < n OR NOT regexp_matches(line, '[.!?,;:…。！？、，؟।–—-]')))
    OR (n < {quality_rules.LONG_LINE} AND len(list_filter([{_texts(quality_rules.BOILERPLATE)}], lambda b: contains(low, b))) > 0)
    OR times >= {quality_rules.REPEATED_LINE} AS lost FROM counted),
lost AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE lost), 0) AS lost_words FROM judged GROUP BY r),
whole AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_words, 0) AS lost_words
  FROM docs LEFT JOIN base USING (r) LEFT JOIN lost USING (r)),
failed AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM whole)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND lost_words <= CAST({quality_rules.MAX_LOST} AS DOUBLE) * n_words AS kept, CAST(lost_words AS BIGINT) AS lost_words
FROM failed
"""


#: The same mix by a full sort on the hash, and targets by sharing excess again and again.
MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, length(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]+', 'x', 'g')) AS l,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
docs AS (SELECT doc_id, source, CAST((l + 1) // 2 AS BIGINT) AS size, h FROM sized),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 2.0 * source_size AS cap FROM totals),
filled AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
settled AS (SELECT *, max(level) FILTER (WHERE w * level < cap) OVER () AS common FROM filled),
goals AS (
  SELECT source, source_size, CAST(CASE WHEN w * level >= cap OR common IS NULL THEN cap ELSE w * common END AS DOUBLE) AS target FROM settled),
ranked AS (
  SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS copies,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, copies + CASE WHEN upto <= target - copies * source_size
              OR (upto - own <= target - copies * source_size AND own - (target - copies * source_size - upto + own) < target - copies * source_size - upto + own)
            THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""


#: The same links by joining shingles, written out, and components by following links.
JACCARD_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sized AS MATERIALIZED (SELECT doc_id, s, n FROM shingles JOIN sizes USING (doc_id)),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 90 * (na + nb - shared)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT DISTINCT a, a FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
firsts AS (SELECT id, min(other) AS least FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(f.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN firsts f ON f.id = d.doc_id
"""
