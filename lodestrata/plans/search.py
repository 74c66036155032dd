"""Capability search over whole reports: all families of evidence in one index, and access by what was hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import capability as cap
from .report import Report


def _named(table: DataFrame) -> DataFrame:
    return table.withColumn("source_id", F.col("run_id"))


def records(report: Report, rejected: DataFrame | None = None, mappings: DataFrame | None = None) -> DataFrame:
    """The evidence records of all runs. rejected: run_id, id, url, reason_code; mappings: source_id, set_id, mapping_id, label, labels, iris, fields."""
    first = report.assets.groupBy("run_id", "artifact_id").agg(F.min_by("id", F.struct("ordinal", "seq")).alias("asset_id"))
    families = [
        cap.artifact_records(_named(report.artifacts)), cap.asset_records(_named(report.assets)), cap.hint_records(_named(report.assets)), cap.link_records(_named(report.links)),
        cap.claim_records(_named(report.standards), "standard"), cap.claim_records(_named(report.profiles), "profile"), cap.finding_records(_named(report.findings), first),
    ]
    if rejected is not None:
        families.append(cap.rejected_records(_named(rejected)))
    if mappings is not None:
        families.append(cap.mapping_records(mappings))
    whole = families[0]
    for family in families[1:]:
        whole = whole.unionByName(family)
    return whole


def index(report: Report, rejected: DataFrame | None = None, mappings: DataFrame | None = None) -> DataFrame:
    return cap.inverted(records(report, rejected, mappings))


def search(report: Report, terms: DataFrame, rejected: DataFrame | None = None, mappings: DataFrame | None = None, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Ranked matches of all needs over all runs. An operation or collection among an asset's required hits decides its access, the first by evidence id."""
    own = cap.postings(records(report, rejected, mappings))
    asked = cap.expanded_terms(terms, mappings, prefixes)
    hit = cap.hits(own, asked).where("role in ('any', 'all')")
    callable_ = report.findings.where(F.col("evidence.source").isin("open_api_operation", "ogc_collection")).select(F.concat_ws(":", F.lit("evidence:finding"), "run_id", "id").alias("evidence_id"), F.col("evidence.source").alias("_location"))
    located = hit.join(callable_, "evidence_id").groupBy("query_id", "need_id", "source_id", "asset_id").agg(F.min_by("_location", "evidence_id").alias("location"))
    return cap.search(own, _named(report.assets), terms, cap.standard_signals(report.findings), rejected, located, mappings, prefixes)
