"""Links: from markup and headers, through the link policy, to fetch candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.ids import det_id
from ..functions.vocabulary import HTML_RELS

#: Candidates that a report keeps where the request names no number.
CANDIDATES = 20


def attribute(tag: Column, name: str) -> Column:
    """The last value of a quoted attribute, null where it is absent."""
    values = F.regexp_extract_all(tag, F.lit(f"(?i)\\b{name}=[\"']([^\"']+)[\"']"), 1)
    return F.try_element_at(values, F.lit(-1))


def html_tags(pages: DataFrame, tag: str = "link", body: str = "html") -> DataFrame:
    """The columns of pages but the body, with position, rel, href and type of each tag that has an href."""
    others = [c for c in pages.columns if c != body]
    found = pages.select(*others, F.posexplode(F.regexp_extract_all(F.col(body), F.lit(f"(?is)<{tag}\\s+[^>]*>"), 0)).alias("position", "_tag"))
    return found.select(*others, "position", attribute(F.col("_tag"), "rel").alias("rel"), attribute(F.col("_tag"), "href").alias("href"), attribute(F.col("_tag"), "type").alias("type")).where("href is not null")


def html_links(pages: DataFrame, body: str = "html") -> DataFrame:
    """One row for each followed relation of each link tag, with its pointer."""
    tags = html_tags(pages, "link", body).where("rel is not null")
    parts = tags.withColumn("rel", F.explode(F.split(F.trim("rel"), r"\s+"))).where(F.col("rel").isin(*HTML_RELS))
    return parts.withColumn("pointer", F.concat(F.lit("/html/link/"), F.col("position").cast("string")))


def header_links(fetched: DataFrame, headers: str = "headers") -> DataFrame:
    """One row for each entry of each Link header: url, rel and type."""
    others = [c for c in fetched.columns if c != headers]
    entry = fetched.select(*others, F.explode(headers).alias("_h")).where(F.lower("_h.name") == "link").select(*others, F.posexplode(F.split("_h.value", ",(?=\\s*<)")).alias("position", "_entry"))
    part = lambda name: F.nullif(F.regexp_extract("_entry", f'(?i);\\s*{name}="?([^";]*)"?', 1), F.lit(""))
    return entry.select(*others, "position", F.regexp_extract("_entry", "<([^>]*)>", 1).alias("href"), part("rel").alias("rel"), part("type").alias("type")).where("href <> ''")


def verdict(to_url: Column) -> Column:
    """accepted, or why a link is rejected: empty or unresolved, with secrets, or of another scheme than http and https."""
    return (
        F.when(to_url.isNull(), "unresolved")
        .when(urls.has_secret(to_url), "secret")
        .when(~urls.scheme(to_url).isin("http", "https"), "scheme")
        .otherwise("accepted")
    )


def judged(raw: DataFrame, base: str = "from_url", href: str = "href") -> DataFrame:
    """raw links (from_artifact_id, from_url, href, rel, predicate, role) with to_url, verdict, and whether they lead to metadata."""
    return (
        raw.withColumn("to_url", urls.resolve(F.col(base), F.col(href)))
        .withColumn("verdict", verdict(F.col("to_url")))
        .withColumn("fetchable", (F.col("verdict") == "accepted") & urls.is_fetchable(F.col("rel"), F.col("predicate"), F.col("role")))
    )


def links(judged_links: DataFrame) -> DataFrame:
    """Accepted links with their id; of equal ids the first by (ordinal, seq) stays."""
    named = judged_links.where("verdict = 'accepted'").withColumn("id", det_id("link", "from_url", "to_url", F.coalesce("rel", "predicate", F.lit(""))))
    return first_by(named, ["run_id", "id"], ["ordinal", "seq"])


def candidates(judged_links: DataFrame) -> DataFrame:
    """Fetch candidates: id, url, priority, reason; the first of equal ids stays."""
    named = judged_links.where("fetchable").select(
        "run_id", "ordinal", "seq", det_id("fetch", "from_artifact_id", "to_url").alias("id"), F.col("to_url").alias("url"), F.lit(1).alias("depth"),
        urls.candidate_priority(F.col("rel"), F.col("predicate")).alias("priority"), F.coalesce("rel", "predicate", "role").alias("reason"), F.col("from_artifact_id").alias("discovered_from"),
    )
    return first_by(named, ["run_id", "id"], ["ordinal", "seq"])


def top_candidates(found: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """Of each run the first candidates by (priority, url, id), with their number. This is a report's limit: 0 stands for the default."""
    by = Window.partitionBy("run_id").orderBy("priority", "url", "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= (most or CANDIDATES))


def first_by(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the first row by the order columns: a minimum of structs, which combines before the shuffle."""
    rest = [c for c in frame.columns if c not in keys]
    packed = frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return packed.select(*keys, "_row.*").select(*frame.columns)
