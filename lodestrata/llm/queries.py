"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import host_reputation, licenses, lm_scoring, media, oracles, packing, pieces, quality, resampling, simhash, substrings, token_files, toxicity, vector_codes
from .common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.learn_and_score(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is the id of the document that it shows, whose label is the page's outcome."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = pages.select("page_id", F.regexp_extract("url", "^[^?#]*/([0-9]{1,18})", 1).try_cast("long").alias("doc_id"))
    bad = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return host_reputation.judge(pages, shown.join(bad, "doc_id").select("page_id", "bad")).drop("rate", "below")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("dup_line_share", "dup_line_char_share", "dup_ngram_shares")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), BYTE_BPE))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store(table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents")).drop("intervals")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings")).drop("label")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TWO = "|".join(s.replace(".", "\\.") for s in host_reputation.TWO_LABEL_SUFFIXES)
_STEPS = f"list_transform(range({host_reputation.POINTS}), lambda k: (k - {host_reputation.POINTS // 2}) * {host_reputation.STEP}::DOUBLE)"
_LT = "(least({u}, 0.0) - ln(1 + exp(-abs({u}))))"


def _mass(sign: int) -> str:
    """The mass of the posterior on one side of a share of one half, as in host_reputation."""
    v = "w * exp(s - exp(-s))"
    u = f"({sign} * {v})"
    return f"list_sum(list_transform({_STEPS}, lambda s: exp(a * {_LT.format(u=u)} + b * {_LT.format(u=f'(-1 * {u})')} - peak) * {v} * (1 + exp(-s))))"


#: The same prior chain and posterior, level by level.
OP2_SQL = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    try_cast(regexp_extract(url, '^[^?#]*/([0-9]{{1,18}})', 1) AS BIGINT) AS doc_id FROM cut),
placed AS (
  SELECT page_id, host, path, CASE WHEN address THEN bare ELSE regexp_extract(bare, '(?:[^.]+\\.)?(?:{_TWO}|[^.]*)$', 0) END AS domain,
    CASE WHEN address THEN 'address' ELSE regexp_extract(bare, '(?:^|\\.)({_TWO}|[^.]*)$', 1) END AS suffix, doc_id
  FROM (SELECT *, regexp_matches(bare, '^[0-9]+(\\.[0-9]+){{3}}$|^\\[') AS address FROM (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS bare FROM parts))),
outcome AS (
  SELECT p.host, p.domain, p.suffix, max(CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM placed p LEFT JOIN labels l ON p.doc_id = l.doc_id GROUP BY p.page_id, p.host, p.domain, p.suffix),
h AS (SELECT host, domain, suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM outcome GROUP BY 1, 2, 3),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
g AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 10.0::DOUBLE) AS prior FROM s),
sx AS (SELECT sum(power(bad - n * prior, 2) / (n * prior * (1 - prior))) AS x, count(*) AS u, sum(n - 1) AS m FROM s, g WHERE n > 0),
s1 AS (SELECT CASE WHEN m > 0 AND x > u THEN least(greatest(m / (x - u) - 1, 1.0), 10000.0) ELSE 10000.0 END AS w FROM sx),
sp AS (SELECT suffix, (bad + w * prior) / (n + w) AS prior FROM s, g, s1),
dj AS (SELECT d.*, sp.prior FROM d JOIN sp ON d.suffix = sp.suffix),
dx AS (SELECT sum(power(bad - n * prior, 2) / (n * prior * (1 - prior))) AS x, count(*) AS u, sum(n - 1) AS m FROM dj WHERE n > 0),
s2 AS (SELECT CASE WHEN m > 0 AND x > u THEN least(greatest(m / (x - u) - 1, 1.0), 10000.0) ELSE 10000.0 END AS w FROM dx),
dp AS (SELECT domain, suffix, (bad + w * prior) / (n + w) AS prior FROM dj, s2),
hj AS (SELECT h.*, dp.prior FROM h JOIN dp ON h.domain = dp.domain AND h.suffix = dp.suffix),
hx AS (SELECT sum(power(bad - n * prior, 2) / (n * prior * (1 - prior))) AS x, count(*) AS u, sum(n - 1) AS m FROM hj WHERE n > 0),
s3 AS (SELECT CASE WHEN m > 0 AND x > u THEN least(greatest(m / (x - u) - 1, 1.0), 10000.0) ELSE 10000.0 END AS w FROM hx),
hr AS (SELECT host, n + w AS total, (bad + w * prior) / (n + w) AS rate FROM hj, s3),
hp AS (SELECT *, rate * total AS a, (1 - rate) * total AS b, (rate - {host_reputation.LIMIT}) / sqrt(rate * (1 - rate) / (total + 1)) AS apart FROM hr),
hw AS (SELECT *, sqrt(1 / a + 1 / b) AS w, a * {_LT.format(u="ln(a / b)")} + b * {_LT.format(u="ln(b / a)")} AS peak FROM hp),
hb AS (SELECT host, CASE WHEN apart > 30 THEN 0.0 WHEN apart < -30 THEN 1.0 ELSE low / (low + high) END AS below FROM (SELECT *, {_mass(-1)} AS low, {_mass(1)} AS high FROM hw))
SELECT p.page_id, p.host, p.path,
  CASE WHEN (p.host = 'www.example.com' OR p.host LIKE '%.www.example.com') AND starts_with(p.path, '/en/') THEN 'www.example.com/en/'
       WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(p.path, '/en/') THEN 'example.com/en/'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(p.path, '/es/') THEN 'net/es/'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(p.path, '/fr/') THEN 'net/fr/'
       WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(p.path, '/') THEN 'com/' END AS rule,
  CASE WHEN (p.host = 'www.example.com' OR p.host LIKE '%.www.example.com') AND starts_with(p.path, '/en/') THEN 'allow'
       WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(p.path, '/en/') THEN 'block'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND (starts_with(p.path, '/es/') OR starts_with(p.path, '/fr/')) THEN 'block'
       WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(p.path, '/') THEN 'allow'
       WHEN hb.below < 1 - {host_reputation.CONFIDENCE} THEN 'block' ELSE 'allow' END AS verdict
FROM placed p LEFT JOIN hb ON p.host = hb.host
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_url_filters, op3_simhash, op4_sentencepiece, op5_quality_rules, op6_best_fit_packing, op7_token_files, op8_license_scan, op9_media_columns, op10_substring_dedup, op11_vector_codes, op12_toxicity, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op5_quality_rules": oracles.OP5_SQL, "op8_license_scan": oracles.OP8_SQL, "op10_substring_dedup": oracles.OP10_SQL, "op11_vector_codes": vector_codes.OP11_SQL}
