"""From fetched artifacts to the tables of a report, for any number of runs at once.

fetched -> classified (one projection) -> facts (one pass over the bodies) ->
one DataFrame for each table. Nothing is collected; classified artifacts, facts
and judged links are stored in the shared folder once, as several tables read
them. Arrow batches are small, as bodies may be of several megabytes.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import headers, urls
from ..functions.ids import body_hash, decoded, det_id
from ..functions.labels import known_or_unknown
from ..functions.vocabulary import ARTIFACT_KINDS
from ..operators import classify, json_rules, links
from ..operators.claims import claims, enabled_packs
from ..operators.graph import resolve_endpoints, unclaimed
from ..operators.trees import extract
from ..sources.batches import bounded, slices
from ..sources.store import exists, stored
from .schemas import EVIDENCE, EVIDENCE_FIELDS, FACTS

#: Versions that are read, whatever name stands before them; the last is written.
VERSIONS = ("report.v1", "report.v2")


@dataclass
class Options:
    profile_packs: list[str] | None = None
    max_next_fetches: int = 0
    allowed_schemes: list[str] = field(default_factory=lambda: ["http", "https"])
    analyzed_at: str = ""


@dataclass
class Report:
    run: DataFrame
    artifacts: DataFrame
    assets: DataFrame
    relations: DataFrame
    relation_claims: DataFrame
    links: DataFrame
    standards: DataFrame
    profiles: DataFrame
    findings: DataFrame
    next_fetches: DataFrame
    fields: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}

    def write(self, path: str) -> None:
        """One Parquet folder for each table. Rows are sorted by run, so that a filter on runs skips row groups; a folder for each of very many runs would not scale."""
        for name, table in self.tables().items():
            table.sortWithinPartitions("run_id").write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> Report:
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in dataclasses.fields(cls)})

    def write_json(self, path: str) -> None:
        """Each table as a folder of JSON lines, in the order of its rows over its files, and a manifest, written last: (table, schema, run_id, n).

        No row and no task holds a run: tables are dealt by ranges of their order. path must be new or empty.
        """
        spark = self.run.sparkSession
        counts = None
        for name, table in self.tables().items():
            table = stored(table, name)
            order = [c for c in ("run_id", "rank", "ordinal", "seq", "id") if c in table.columns]
            lines = table.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*table.columns)).alias("value"))
            lines.write.text(f"{path}/{name}")
            own = table.groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(None).cast("string").alias("schema"), "run_id", "n")
            head = spark.createDataFrame([(name, table.schema.json(), None, None)], "table string, schema string, run_id string, n long")
            counts = head.unionByName(own) if counts is None else counts.unionByName(head).unionByName(own)
        counts.write.json(f"{path}/manifest")

    @classmethod
    def read_json(cls, spark, path: str) -> Report:
        """What write_json() wrote. Raises ValueError where the manifest is missing or counts other rows than there are."""
        if not exists(spark, f"{path}/manifest/_SUCCESS"):
            raise ValueError("the report was not written to its end")
        manifest = spark.read.schema("table string, schema string, run_id string, n long").json(f"{path}/manifest")
        schemas = {r.table: StructType.fromJson(json.loads(r.schema)) for r in manifest.where("schema is not null").collect()}  # one row for each table
        tables = {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}
        found = None
        for name, table in tables.items():
            own = table.groupBy("run_id").agg(F.count("*").alias("found")).withColumn("table", F.lit(name))
            found = own if found is None else found.unionByName(own)
        other = manifest.where("schema is null").join(found, ["table", "run_id"], "full").where(~F.col("n").eqNullSafe(F.col("found")))
        if not other.isEmpty():
            raise ValueError("the report's tables do not have the rows that its manifest counts")
        return cls(**tables)

    def views(self, prefix: str = "") -> None:
        """Register all tables as views, so that spark.sql can query them."""
        for name, table in self.tables().items():
            table.createOrReplaceTempView(prefix + name)

    def to_json(self) -> DataFrame:
        """(run_id, report): each run as one JSON value; its lists keep their order."""
        out = self.run.select("run_id", F.struct(*[c for c in self.run.columns if c != "run_id"]).alias("run"))
        for name, table in self.tables().items():
            if name != "run":
                order = [c for c in ("rank", "ordinal", "seq", "id") if c in table.columns]
                row = F.struct(*order, F.struct(*[c for c in table.columns if c not in ("run_id", "ordinal", "seq", "rank")]).alias("row"))
                listed = table.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"]).alias(name))
                out = out.join(listed, "run_id", "left")
        names = [n for n in self.tables() if n != "run"]
        return out.select("run_id", F.to_json(F.struct("run.*", *[F.coalesce(n, F.array().cast(out.schema[n].dataType)).alias(n) for n in names])).alias("report"))

    def to_envelope(self, rejected: DataFrame, summary: DataFrame) -> DataFrame:
        """(run_id, envelope): the report with what a crawl rejected (run_id, url, reason_code, discovered_from) and its summary (run_id, counts), as one JSON value."""
        listed = rejected.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("url", "reason_code", "discovered_from"))).alias("rejected_fetches"))
        counts = summary.select("run_id", F.struct(*[c for c in summary.columns if c != "run_id"]).alias("fetched"))
        out = self.to_json().join(listed, "run_id", "left").join(counts, "run_id", "left")
        return out.select("run_id", F.to_json(F.struct(F.parse_json("report").alias("report"), "fetched", F.coalesce("rejected_fetches", F.array().cast("array<struct<url:string,reason_code:string,discovered_from:string>>")).alias("rejected_fetches"))).alias("envelope"))

    def validate(self) -> None:
        """Raise for a version that is not known or a relation without a claim."""
        if self.run.where(~F.col("schema_version").rlike("(^|[.])report[.]v[12]$")).take(1):
            raise ValueError("the report's version is not known")
        if unclaimed(self.relations.withColumnRenamed("id", "relation_id"), self.relation_claims).take(1):
            raise ValueError("a relation has no claim")


def classified(fetched: DataFrame) -> DataFrame:
    """fetched with artifact_id, text, kind by content and status by HTTP; sensitive headers are redacted."""
    at = F.coalesce("final_url", "url")
    text = decoded(F.col("body"))
    found = fetched.withColumns({"artifact_id": det_id("artifact", urls.normalize(at)), "text": text, "at": at, "headers": headers.redact(F.col("headers"))})
    kind = known_or_unknown(classify.artifact_kind(F.col("at"), F.col("media_type"), F.col("text")), ARTIFACT_KINDS)
    return found.withColumns({"kind": kind, "http_status": F.col("status"), "status": classify.http_status(F.col("status"))})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["run_id", "ordinal", "artifact_id", "from_url", "seq", "fact", "payload"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in slices(batches, "text"):
        rows = []
        for run, ordinal, artifact, url, at, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for seq, (fact, payload) in enumerate(extract(kind, at or url or "", text or ""), _LATER if kind in json_rules.KINDS else 0):
                rows.append((run, ordinal, artifact, url, seq, fact, json.dumps(payload, ensure_ascii=False)))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


#: What the JSON-LD of a metadata index says comes behind what the index says.
_LATER = 1 << 40
#: Kinds whose bodies no Python sees.
_RULED = set(json_rules.KINDS) - {"metadata_index"}


def facts(found: DataFrame) -> DataFrame:
    """What the bodies of fetched artifacts of a known kind say: one row for each fact, with a typed column of each kind of fact, null but for the row's own.

    Formats that are plain JSON are rules over walked documents (operators.json_rules); bodies of the others are read once in an Arrow pass.
    """
    readable = found.where((F.col("status") == "fetched") & (F.col("kind") != "unknown"))
    index = (F.col("kind") == "metadata_index") & (F.contains("text", F.lit('"@')) | F.contains("text", F.lit("odrl:"))) & F.try_parse_json("text").isNotNull()
    others = readable.where(~F.col("kind").isin(*json_rules.KINDS) | index)
    said = bounded(others).select("run_id", "ordinal", "artifact_id", "url", "at", "kind", "text").mapInArrow(_extract, "run_id string, ordinal int, artifact_id string, from_url string, seq long, fact string, payload string")
    typed = said.select("run_id", "ordinal", "artifact_id", "from_url", "seq", "fact", *(F.when(F.col("fact") == name, F.from_json("payload", schema)).alias(name) for name, schema in FACTS.items()))
    # at most as many rows as there are kinds
    present = {r.kind for r in readable.select("kind").distinct().collect()}
    if not present & set(json_rules.KINDS):
        return typed
    rules = json_rules.facts(readable, present)
    return rules.withColumns({n: F.lit(None).cast(typed.schema[n].dataType) for n in typed.columns if n not in rules.columns}) if present <= _RULED else typed.unionByName(rules, allowMissingColumns=True)


def _of(rows: DataFrame, fact: str) -> DataFrame:
    return rows.where(F.col("fact") == fact).select("run_id", "ordinal", "artifact_id", "from_url", "seq", f"{fact}.*")


def _evidence(**given: F.Column) -> F.Column:
    return F.struct(*(given.get(n, F.lit(None).cast("string")).cast("string").alias(n) for n in EVIDENCE_FIELDS)).cast(EVIDENCE)


def redacted(evidence: F.Column) -> F.Column:
    """Evidence whose URLs show no secrets."""
    for name in ("value", "href"):
        text = evidence[name]
        evidence = evidence.withField(name, F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), urls.redact(text)).otherwise(text))
    return evidence


def _raw_links(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Links of trees, of HTML tags and of headers, in one shape; headers come before the body."""
    tree = _of(rows, "link")
    live = found.where("status = 'fetched'")
    keys = ["run_id", "ordinal", "artifact_id", "url"]
    html = links.html_links(live.where("kind = 'html_landing_page'").select(*keys, "text"), "text")
    html = html.select("run_id", "ordinal", "artifact_id", F.col("url").alias("from_url"), F.col("position").cast("long").alias("seq"), "href", "rel", F.lit(None).cast("string").alias("predicate"), F.col("type").alias("role"), _evidence(source=F.lit("html_link"), rel=F.col("rel"), href=F.col("href"), pointer=F.col("pointer")).alias("evidence"))
    head = links.header_links(live.select(*keys, "headers"))
    head = head.select("run_id", "ordinal", "artifact_id", F.col("url").alias("from_url"), (F.col("position") - 1_000_000).cast("long").alias("seq"), "href", "rel", F.lit(None).cast("string").alias("predicate"), F.col("type").alias("role"), _evidence(source=F.lit("http_header"), header_name=F.lit("link"), rel=F.col("rel"), value=F.col("href")).alias("evidence"))
    return tree.unionByName(html).unionByName(head).withColumnRenamed("artifact_id", "from_artifact_id")


#: Tables of parts that are merged by id: of several rows the first by (ordinal, seq) stays. The others are added up.
MERGED = ("assets", "relations", "relation_claims", "links", "standards", "profiles", "findings", "candidates")


def parts(fetched: DataFrame, options: Options | None = None) -> dict[str, DataFrame]:
    """What the artifacts of fetched say by themselves: artifacts, fields, and the tables of MERGED, whose rows of one id may still
    meet with those of other artifacts. Relations hold their ends as the artifact names them."""
    options = options or Options()
    packs = enabled_packs(options.profile_packs)
    read = classified(fetched)
    found = stored(read.select("run_id", "ordinal", "artifact_id", "url", "final_url", "at", "kind", "status", "media_type", "http_status", "discovered_from", "headers", F.octet_length("body").cast("long").alias("byte_length"), body_hash("body").alias("hash"), F.when(F.col("status") == "fetched", F.col("text")).alias("text")), "artifacts")
    rows = stored(facts(found), "facts")
    # what later tables need of an artifact, without its text
    head = found.select("run_id", "ordinal", "artifact_id", "url", "final_url", "kind", "status", "media_type", "http_status", "discovered_from", "byte_length", "hash")

    key = lambda c: F.concat_ws("\0", c)
    raw = _of(rows, "asset").withColumn("id", det_id("asset", "artifact_id", key(F.col("key"))))
    uri = F.when(F.coalesce("relative", F.lit(False)), urls.resolve(F.col("from_url"), F.col("uri"))).otherwise(F.col("uri"))
    assets = raw.select(
        "run_id", "id", "ordinal", "seq", "artifact_id", "kind", uri.alias("uri"), "title", "description", "publisher", F.col("endpoint").alias("endpoint_url"),
        F.coalesce("conforms", F.array().cast("array<string>")).alias("conforms_to"), F.coalesce("hints", F.array().cast("array<struct<label: string, predicate: string, path: string>>")).alias("source_hints"), "pointer", "subject",
    )

    error = _of(rows, "error").select("run_id", "ordinal", F.col("message").alias("error"))
    kind = _of(rows, "kind").groupBy("run_id", "ordinal").agg(F.max_by("kind", "seq").alias("_kind"))
    artifacts = head.join(kind, ["run_id", "ordinal"], "left").join(error, ["run_id", "ordinal"], "left").withColumn("kind", F.coalesce("_kind", "kind"))
    artifacts = artifacts.select("run_id", F.col("artifact_id").alias("id"), "ordinal", "url", "final_url", "kind", classify.artifact_status(F.col("http_status"), F.col("kind"), F.col("error")).alias("status"), "media_type", "http_status", "discovered_from", "byte_length", "hash", "error")

    standards, profiles = claims(_of(rows, "claim").drop("from_url"), packs)

    judged = stored(links.judged(_raw_links(found, rows)), "links")
    link = links.links(judged).select("run_id", "id", "ordinal", "seq", "from_artifact_id", "from_url", "to_url", "rel", "predicate", "role", F.lit("declared").alias("confidence"), redacted(F.col("evidence")).alias("evidence"))

    rejected = judged.where("verdict <> 'accepted'").select("run_id", "ordinal", F.col("from_artifact_id").alias("artifact_id"), "seq", F.lit("link.rejected_by_core").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("A link was rejected: "), "verdict").alias("message"), F.lit(None).cast("string").alias("asset_id"), F.lit(None).cast("string").alias("standard_iri"), F.col("evidence").withField("value", urls.redact(F.coalesce("to_url", "href"))).withField("href", F.lit(None).cast("string")).alias("evidence"))
    said = _of(rows, "finding").select("run_id", "ordinal", "artifact_id", "seq", "code", "severity", "message", F.when(F.col("asset_key").isNotNull(), det_id("asset", "artifact_id", key(F.col("asset_key")))).alias("asset_id"), "standard_iri", redacted(F.col("evidence")).alias("evidence"))
    broken = _of(rows, "error").select("run_id", "ordinal", "artifact_id", "seq", F.lit("parse.failed").alias("code"), F.lit("warning").alias("severity"), "message", F.lit(None).cast("string").alias("asset_id"), F.lit(None).cast("string").alias("standard_iri"), _evidence(source=F.lit("content_sniff"), detector=F.lit("parser"), marker=F.col("message")).alias("evidence"))
    findings = said.unionByName(rejected).unionByName(broken).withColumn("id", det_id("finding", "code", "artifact_id", F.coalesce("asset_id", F.lit("")), F.to_json("evidence")))

    ends = _of(rows, "relation").withColumn("evidence", redacted(F.col("evidence")))
    ends = ends.withColumns({end: F.struct(F.col(f"{end}.asset_id"), F.col(f"{end}.uri"), F.when(F.col(f"{end}.node").isNotNull(), det_id("blank", "artifact_id", F.col(f"{end}.node"))).alias("node_id")) for end in ("subject", "object")})
    # an end with a URI is named by it, whatever asset it resolves to, so the id of a relation does not change when that asset arrives
    name = lambda end: F.coalesce(f"{end}.uri", f"{end}.asset_id", f"{end}.node_id")
    named = ends.withColumn("id", det_id("relation", F.concat_ws("|", name("subject"), "predicate", name("object"))))
    relations = named.select("run_id", "id", "ordinal", "seq", "predicate", "subject", "object")
    relation_claims = named.select("run_id", det_id("claim", "id", "artifact_id", F.to_json("evidence")).alias("id"), F.col("id").alias("relation_id"), "ordinal", "seq", F.col("artifact_id").alias("asserted_by_artifact_id"), "evidence")

    own = {"assets": assets, "relations": relations, "relation_claims": relation_claims, "findings": findings}
    own = {n: links.first_by(t, ["run_id", "id"], ["ordinal", "seq"]) for n, t in own.items()}
    return own | {"artifacts": artifacts, "links": link, "standards": standards, "profiles": profiles, "candidates": links.candidates(judged), "fields": _of(rows, "field").drop("from_url")}


def whole(found: dict[str, DataFrame], options: Options | None = None) -> Report:
    """The report of parts: ends of relations resolved against all assets, titles of artifacts, the next fetches, and the counts of each run."""
    options = options or Options()
    assets, at = found["assets"], F.lit(options.analyzed_at).alias("analyzed_at")
    first = assets.groupBy("run_id", F.col("artifact_id").alias("id")).agg(F.min_by(F.struct("title", "description"), F.struct("ordinal", "seq")).alias("_first"))
    artifacts = found["artifacts"].join(first, ["run_id", "id"], "left").select("run_id", "id", "ordinal", "url", "final_url", "kind", "status", "media_type", "http_status", "_first.title", "_first.description", "discovered_from", "byte_length", "hash", "error", at)
    relations = resolve_endpoints(found["relations"], assets).select("run_id", "id", "ordinal", "seq", "subject_id", "predicate", "object_id", "subject", "object")
    top = links.top_candidates(found["candidates"], options.max_next_fetches)
    run = summary(artifacts, assets, found["standards"], found["profiles"], found["candidates"], top, options)
    return Report(run, artifacts, assets, relations, found["relation_claims"], found["links"], found["standards"], found["profiles"], found["findings"], top, found["fields"])


def analyze(fetched: DataFrame, options: Options | None = None) -> Report:
    """The report of each run of fetched."""
    return whole(parts(fetched, options), options)


def summary(artifacts: DataFrame, assets: DataFrame, standards: DataFrame, profiles: DataFrame, every: DataFrame, top: DataFrame, options: Options) -> DataFrame:
    """The header of each run: its entry, and counts of its tables."""
    entry = artifacts.groupBy("run_id").agg(F.min_by("url", "ordinal").alias("entry_url"))
    status = lambda name: F.count_if(F.col("status") == name).alias(f"{name}_artifact_count" if name != "parse_error" else "parse_error_count")
    out = entry.join(artifacts.groupBy("run_id").agg(F.count("*").alias("artifact_count"), status("failed"), status("unsupported"), status("parse_error")), "run_id", "left")
    for table, name in ((assets, "asset_count"), (standards, "standard_count"), (profiles, "profile_count"), (top, "next_fetch_count"), (every, "_all")):
        out = out.join(table.groupBy("run_id").agg(F.count("*").alias(name)), "run_id", "left")
    counts = ["artifact_count", "asset_count", "standard_count", "profile_count", "failed_artifact_count", "unsupported_artifact_count", "parse_error_count", "next_fetch_count"]
    return out.select("run_id", F.lit(VERSIONS[1]).alias("schema_version"), "entry_url", F.lit(options.analyzed_at).alias("analyzed_at"), det_id("run", "entry_url", F.lit(options.analyzed_at)).alias("report_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), (F.coalesce("_all", F.lit(0)) > F.coalesce("next_fetch_count", F.lit(0))).alias("truncated"))
