"""The workbench model of reports: records, fields, artifact checks, checklist, readiness, graph and comparison, for all runs at once."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import kind_label
from ..functions.vocabulary import PREFIXES
from ..operators import workbench
from ..operators.classify import has_any, inferred_profile
from .report import Report

#: Standard fields of a record: id, label and term (fixed values).
FIELD_TERMS = (
    ("title", "Title", "dcterms:title"), ("description", "Description", "dcterms:description"), ("publisher", "Publisher", "dcterms:publisher"),
    ("contactPoint", "Contact point", "dcat:contactPoint"), ("accessRights", "Access rights", "dcterms:accessRights"),
    ("applicableLegislation", "Applicable legislation", "dcatap:applicableLegislation"), ("policy", "Usage policy", "odrl:hasPolicy"),
    ("conformsTo", "Conforms to", "dcterms:conformsTo"), ("theme", "Theme", "dcat:theme"), ("keyword", "Keyword", "dcat:keyword"),
    ("landingPage", "Landing page", "dcat:landingPage"), ("endpointURL", "Endpoint URL", "dcat:endpointURL"),
    ("endpointDescription", "Endpoint description", "dcat:endpointDescription"), ("mediaType", "Media type", "dcat:mediaType"),
    ("format", "Format", "dcterms:format"), ("license", "License", "dcterms:license"), ("status", "Lifecycle status", "adms:status"),
    ("issued", "Issued", "dcterms:issued"), ("modified", "Modified", "dcterms:modified"),
)
#: Artifact checks: id and standard (fixed values).
CHECKS = (
    ("dcat-ap-jsonld", "DCAT-AP"), ("breg-dcat-ap", "BRegDCAT-AP"), ("ogc-api-records", "OGC API Records"), ("openapi", "OpenAPI"),
    ("ogc-api-features", "OGC API Features"), ("shacl", "SHACL"), ("odrl", "ODRL"), ("access-rights", "Dublin Core / DCAT-AP"), ("dqv", "DQV"),
    ("adms", "ADMS"), ("dpv", "DPV"), ("trust", "DID/VCDM/PROV"), ("publisher-specific", "Publisher-specific pattern"),
)

#: Classes of records that the workbench shows by themselves (fixed values).
RECORD_CLASSES = {
    "catalog": ("catalog",), "dataset": ("dataset", "base-registry"),
    "access": ("service", "distribution", "ogc-feature-collection", "ogc-record-collection", "operation-group"),
}


@dataclass
class Board:
    records: DataFrame
    fields: DataFrame
    checks: DataFrame
    artifacts: DataFrame
    items: DataFrame
    readiness: DataFrame
    nodes: DataFrame
    edges: DataFrame
    comparison: DataFrame
    profiles: DataFrame


def merged(fields: DataFrame) -> DataFrame:
    """Nodes with the same id as one: of each key the values that were said last; nodes without an id stay apart."""
    named = fields.withColumn("node", F.when(F.col("node").startswith("_:"), F.concat_ws("#", "artifact_id", "node")).otherwise(F.col("node")))
    last = named.groupBy("run_id", "node", "key").agg(F.max(F.struct("ordinal", "occurrence")).alias("_last")).select("run_id", "node", "key", "_last.ordinal", "_last.occurrence")
    return named.join(last, ["run_id", "node", "key", "ordinal", "occurrence"])


def record_fields(nodes: DataFrame) -> DataFrame:
    """(run_id, record_id, field_id, label, value, term, publisher_specific): standard terms, and keys with a prefix that is none of the standards'."""
    terms = F.create_map(*(F.lit(x) for i, label, term in FIELD_TERMS for x in (term, f"{i}|{label}")))
    known = F.try_element_at(terms, F.col("key"))
    prefix = F.substring_index("key", ":", 1)
    own = F.contains("key", F.lit(":")) & ~prefix.isin(*PREFIXES) & ~F.col("key").startswith("@")
    out = nodes.withColumns({"_known": known, "publisher_specific": known.isNull() & own}).where(F.col("_known").isNotNull() | F.col("publisher_specific"))
    return out.select("run_id", F.col("node").alias("record_id"), F.coalesce(F.substring_index("_known", "|", 1), "key").alias("field_id"), F.coalesce(F.substring_index("_known", "|", -1), "key").alias("label"), "value", F.col("key").alias("term"), "publisher_specific")


def checks(nodes: DataFrame, artifacts: DataFrame, runs: DataFrame, publisher_keys: tuple[str, ...] = ()) -> DataFrame:
    """(run_id, ord, check_id, presence, standard): thirteen checks over all nodes of a run, as one aggregate. publisher_keys: keys by which a publisher's own integration is known."""
    key, value = F.col("key"), F.lower("value")
    typed = lambda *names: (key == "@type") & F.col("value").isin(*names)
    holds = lambda keys, words=None: key.isin(*keys) if words is None else key.isin(*keys) & has_any(value, words)
    seen: tuple[tuple[str, Column], ...] = (
        ("breg", holds(("dcterms:type",), ("base-registry",))),
        ("records", holds(("dcterms:conformsTo", "dcterms:type", "dcat:endpointURL", "dcat:landingPage"), ("ogcapi-records", "ogc api records"))),
        ("features", holds(("dcterms:conformsTo", "dcat:accessService"), ("ogcapi-features",))),
        ("shacl", typed("sh:NodeShape", "sh:PropertyShape") | holds(("sh:shapesGraph",))),
        ("odrl", typed("odrl:Policy", "odrl:Offer", "odrl:Set") | holds(("odrl:hasPolicy",))),
        ("rights", holds(("dcterms:accessRights", "dcterms:rights", "dcterms:license"))),
        ("dqv", typed("dqv:QualityMeasurement", "dqv:QualityAnnotation")),
        ("adms", holds(("adms:status",))),
        ("dpv", holds(("dpv:hasLegalBasis", "dpv:hasPersonalDataCategory", "dcatap:applicableLegislation"))),
        ("trust", typed("did:Service", "VerifiableCredential", "https://www.w3.org/2018/credentials#VerifiableCredential") | holds(("prov:wasGeneratedBy", "prov:wasAttributedTo", "schema:identifier"), ("did:", "credential", "provenance"))),
        ("own", holds(publisher_keys) if publisher_keys else F.lit(False)),
    )
    by_node = nodes.groupBy("run_id").agg(*(F.bool_or(c).alias(n) for n, c in seen))
    by_artifact = artifacts.groupBy("run_id").agg(F.bool_or((F.col("kind") == "dcat_catalog") & (F.col("status") == "fetched")).alias("dcat"), F.bool_or((F.col("kind") == "open_api") & (F.col("status") == "fetched")).alias("openapi"))
    row = runs.select("run_id").join(by_node, "run_id", "left").join(by_artifact, "run_id", "left")
    order = ("dcat", "breg", "records", "openapi", "features", "shacl", "odrl", "rights", "dqv", "adms", "dpv", "trust", "own")
    state = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "found").otherwise("missing")
    return row.select("run_id", F.inline(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(i).alias("check_id"), state(c).alias("presence"), F.lit(std).alias("standard")) for k, ((i, std), c) in enumerate(zip(CHECKS, order, strict=True))))))


def artifact_statuses(artifacts: DataFrame) -> DataFrame:
    """(run_id, artifact_id, name, presence, origin, assessment) of what was fetched."""
    s = F.col("status")
    presence = F.when(s == "fetched", "found").when(s == "auth_required", "auth-required").when(s.isin("parse_error", "failed"), "invalid").otherwise("missing")
    return artifacts.select("run_id", F.col("id").alias("artifact_id"), F.coalesce("title", kind_label(F.col("kind"))).alias("name"), presence.alias("presence"), F.when((F.col("kind") == "unknown") | (s == "unsupported"), "unsupported").otherwise("standard").alias("origin"), F.when(s == "fetched", "complete").when(s == "parse_error", "not-parsed").otherwise("partial").alias("assessment"), "url", "error")


def checklist(records: DataFrame, fields: DataFrame, found: DataFrame, validation: str = "not-run") -> DataFrame:
    """One row a run with the presence of each checklist item, as workbench.readiness_items() takes it."""
    r = records.groupBy("run_id").agg(F.bool_or(F.col("record_type") == "catalog").alias("catalog"), F.bool_or(F.col("record_type").isin("dataset", "base-registry")).alias("dataset"))
    term = lambda t: F.bool_or(F.col("term") == t)
    f = fields.groupBy("run_id").agg(term("dcterms:title").alias("title"), term("dcterms:publisher").alias("publisher"), term("dcat:endpointURL").alias("endpoint"), term("dcat:contactPoint").alias("contact"))
    c = found.groupBy("run_id").pivot("check_id", [i for i, _ in CHECKS]).agg(F.first("presence"))
    row = c.join(r, "run_id", "left").join(f, "run_id", "left")
    own = lambda n: F.when(F.coalesce(F.col(n), F.lit(False)), "found").otherwise("missing")
    check = lambda n: F.col(f"`{n}`")
    items = {
        "identity-catalog": own("catalog"), "identity-dataset": own("dataset"), "identity-title": own("title"), "identity-publisher": own("publisher"), "access-endpoint": own("endpoint"),
        "access-openapi": check("openapi"), "policy-usage": check("odrl"), "policy-access-rights": check("access-rights"), "policy-legal-basis": check("dpv"), "trust-evidence": check("trust"),
        "lifecycle-status": check("adms"), "lifecycle-contact": own("contact"), "validation-profile": F.lit({"valid": "found", "warnings": "found", "invalid": "invalid"}.get(validation, "missing")), "validation-timestamp": check("dqv"),
    }
    return row.select("run_id", *(v.alias(k) for k, v in items.items()))


def board(report: Report, validation: str = "not-run", budget: int | None = workbench.NODE_BUDGET, publisher_keys: tuple[str, ...] = (), publisher_profile: tuple[str, str] | None = None) -> Board:
    """The model of each run of a report. budget: of how many nodes a run's graph may be; None: of all."""
    nodes = merged(report.fields)
    fields = record_fields(nodes)
    found = checks(nodes, report.artifacts, report.run, publisher_keys)
    records = workbench.with_parents(report.assets)
    items = workbench.readiness_items(checklist(records, fields, found, validation))
    graph_nodes = records.select("run_id", F.col("record_id").alias("node_id"), F.col("record_type").alias("node_type"), F.col("record_id").alias("seq"))
    edges = records.where("parent_id is not null").select("run_id", F.col("parent_id").alias("source"), F.col("record_id").alias("target"), workbench.edge_label(F.col("record_type")).alias("label"))
    kept, inside = workbench.budgeted(graph_nodes, edges, budget)
    compared = fields.groupBy("run_id").agg(F.count_if(~F.col("publisher_specific")).alias("core_fields"), F.count_if("publisher_specific").alias("publisher_fields"), F.bool_or("publisher_specific").alias("impact"))
    profile = report.assets.where("kind = 'catalog'").groupBy("run_id").agg(inferred_profile(F.flatten(F.array_sort(F.collect_list("conforms_to"))), publisher_profile).alias("profile"))
    return Board(records, fields, found, artifact_statuses(report.artifacts), items, workbench.readiness_categories(items, validation != "not-run"), kept, inside, compared, profile)


def lens(whole: Board, record_class: str | None = None, publisher: bool = True) -> Board:
    """What of a model is seen: the records of a class with their fields, nodes and the edges between them, and, without publisher, nothing that is a publisher's own.

    Readiness, items, comparison and profiles are of the whole run and stay. An unknown class is an error.
    """
    if record_class is not None and record_class not in RECORD_CLASSES:
        raise ValueError(f"no class of records: {record_class}")
    records, fields, nodes, edges, found, artifacts = whole.records, whole.fields, whole.nodes, whole.edges, whole.checks, whole.artifacts
    if record_class is not None:
        kinds = RECORD_CLASSES[record_class]
        records, nodes = records.where(F.col("record_type").isin(*kinds)), nodes.where(F.col("node_type").isin(*kinds))
        fields = fields.join(records.select("run_id", F.col("uri").alias("record_id")), ["run_id", "record_id"], "left_semi")  # fields are named by their node
        for end in ("source", "target"):
            edges = edges.join(nodes.select("run_id", F.col("node_id").alias(end)), ["run_id", end], "left_semi")
    if not publisher:
        fields, found, artifacts = fields.where(~F.col("publisher_specific")), found.where("check_id <> 'publisher-specific'"), artifacts.where("origin <> 'publisher-specific'")
    return dataclasses.replace(whole, records=records, fields=fields, checks=found, artifacts=artifacts, nodes=nodes, edges=edges)
