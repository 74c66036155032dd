"""Sources of artifacts: bundles, local files, pages, pluggable fetchers; and stored reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import det_id
from ..operators.classify import media_type_for_path
from ..plans.schemas import FETCHED

BODY_BUDGET = 16_777_216


def validate_entry(url: str) -> str:
    if not url.lower().startswith(("http://", "https://")) or len(url.split("://", 1)[1].split("/", 1)[0]) == 0:
        raise ValueError(f"not an entry URL: {url}")
    return url


def _filled(frame: DataFrame, **columns: F.Column) -> DataFrame:
    """The columns of fetched artifacts, null where the source has none."""
    out = []
    for part in FETCHED.replace("struct<name: string, value: string>", "struct<name:string,value:string>").split(", "):
        name, kind = part.split(" ", 1)
        column = columns.get(name, F.col(name) if name in frame.columns else F.lit(None))
        out.append(column.cast(kind).alias(name))
    return frame.select(*out)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """A bundle: JSON with entry_url and artifacts, whose bodies are arrays of byte values or text. Its run is named by its entry."""
    schema = "entry_url string, artifacts array<struct<url: string, final_url: string, status: int, media_type: string, request_accept: string, redirect_chain: array<string>, headers: array<struct<name: string, value: string>>, body: string, fetched_at: string, depth: int, discovered_from: string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    each = raw.select(det_id("run", "entry_url").alias("run_id"), F.posexplode("artifacts").alias("ordinal", "a")).select("run_id", "ordinal", "a.*")
    octets = F.from_json("body", "array<int>")
    hexed = F.array_join(F.transform(octets, lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), "")
    body = F.when(F.col("body").rlike(r"^\s*\[\s*(\d|\])") & octets.isNotNull(), F.unhex(hexed)).otherwise(F.col("body").cast("binary"))
    return _filled(each, body=body, status=F.coalesce("status", F.lit(200)), depth=F.coalesce("depth", F.lit(0)))


def read_files(spark: SparkSession, path: str, entry_url: str) -> DataFrame:
    """Files as artifacts of one run: status 200, named below the entry where that ends with a slash."""
    validate_entry(entry_url)
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    listed = files.select("path", name.alias("name"), F.col("content").alias("body"))
    ordinal = F.dense_rank().over(Window.partitionBy("run_id").orderBy("path"))
    own = listed.withColumn("run_id", det_id("run", F.lit(entry_url))).withColumn("ordinal", ordinal - 1)
    url = F.when(F.lit(entry_url.endswith("/")), F.concat(F.lit(entry_url), "name")).otherwise(F.lit(entry_url))
    return _filled(own, url=url, final_url=F.lit(None), status=F.lit(200), media_type=media_type_for_path(F.col("name")), depth=F.lit(0), headers=F.array(), redirect_chain=F.array())


def from_pages(pages: DataFrame, run_id: F.Column, url: str = "url", body: str = "html", ordinal: str = "page_id", media_type: str = "text/html") -> DataFrame:
    """A table of pages as artifacts."""
    return _filled(pages, run_id=run_id, ordinal=F.col(ordinal), url=F.col(url), final_url=F.lit(None), status=F.lit(200), media_type=F.lit(media_type), body=F.col(body).cast("binary"), depth=F.lit(0), headers=F.array(), redirect_chain=F.array())


def check_budget(fetched: DataFrame, most: int = BODY_BUDGET) -> None:
    """Raise where a run's bodies hold more bytes than the budget."""
    over = fetched.groupBy("run_id").agg(F.sum(F.octet_length("body")).alias("n")).where(F.col("n") > most).take(1)
    if over:
        raise ValueError(f"run {over[0].run_id} holds {over[0].n} bytes; the budget is {most}")


def fetch_with(fetcher: Callable[[str], dict]) -> Callable[[DataFrame], DataFrame]:
    """A fetch step for plans.crawl from a function of a URL that returns status, media_type and body; an exception is a failed fetch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    got = fetcher(r.url)
                except Exception:  # a fetcher may raise anything; the crawl goes on
                    got = {}
                rows.append((r.run_id, r.url, r.depth, r.discovered_from, got.get("status"), got.get("media_type"), got.get("body")))
            yield pd.DataFrame(rows, columns=["run_id", "url", "depth", "discovered_from", "status", "media_type", "body"]).astype({"status": "Int32", "depth": "int32"})

    return lambda due: due.mapInPandas(run, "run_id string, url string, depth int, discovered_from string, status int, media_type string, body binary")


def in_memory(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetch step that looks URLs up in a table (url, status, media_type, body): an equi join, for tests and for stored crawls."""
    return lambda due: due.join(table.select("url", "status", "media_type", "body"), "url", "left").select("run_id", "url", "depth", "discovered_from", "status", "media_type", "body")


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, report as a variant) of stored envelopes or bare reports: named by the file, or by their run."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.envelope)?\.json$", 1).alias("stem"), F.parse_json("value").alias("v"))
    report = F.coalesce(F.try_variant_get("v", "$.report", "variant"), F.col("v"))
    bare = F.try_variant_get("v", "$.report", "variant").isNull()
    return raw.select(F.when(bare, F.try_variant_get("v", "$.run_id", "string")).otherwise(F.col("stem")).alias("source_id"), report.alias("report"))


#: What a run changes although nothing else has changed (fixed values).
TIMES, DURATIONS, EPOCH = ("analyzed_at", "fetched_at"), ("total_elapsed_ms",), "1970-01-01T00:00:00Z"


def canonical_json(text: str) -> str:
    """A report or envelope for a fixture: keys in order, times at the epoch, durations zero. One document; raises ValueError for no JSON."""

    def plain(key: str, value):
        return EPOCH if key in TIMES else 0 if key in DURATIONS else value

    return json.dumps(json.loads(text, object_pairs_hook=lambda pairs: {k: plain(k, v) for k, v in pairs}), sort_keys=True, ensure_ascii=False, indent=2) + "\n"


def analyze_json(spark: SparkSession, text: str) -> str:
    """The whole engine behind one JSON string: a bundle in, a report (or an error) out. Small by its budget."""
    from ..plans.report import analyze

    try:
        bundle = json.loads(text)
        validate_entry(bundle["entry_url"])
        rows = [(k, a["url"], a.get("media_type"), bytes(a["body"]) if isinstance(a.get("body"), list) else (a.get("body") or "").encode(), a.get("status", 200)) for k, a in enumerate(bundle.get("artifacts", []))]
        if sum(len(r[3]) for r in rows) > BODY_BUDGET:
            raise ValueError("the bodies are over their budget")
        frame = spark.createDataFrame(rows, "ordinal int, url string, media_type string, body binary, status int")
        fetched = _filled(frame, run_id=det_id("run", F.lit(bundle["entry_url"])), depth=F.lit(0), headers=F.array(), redirect_chain=F.array())
        found = analyze(fetched).to_json().first()
        return json.dumps({"ok": True, "report": json.loads(found.report)}) if found else json.dumps({"ok": False, "error": "the bundle is empty"})
    except (ValueError, KeyError, TypeError) as e:
        return json.dumps({"ok": False, "error": str(e)})
