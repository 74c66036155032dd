"""Registry, substrate, evidence and condition views over the tables of reports, for all runs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import first_text
from ..functions.vocabulary import CONDITIONS, REGISTERABLE, REGISTERABLE_IF_NAMED

#: Facets of a registry by name: the asset kinds that they show.
FACETS = {
    "catalogues": ("catalog",),
    "datasets": ("dataset", "record_collection", "feature_collection"),
    "services": ("data_service", "api_description"),
    "distributions": ("distribution",),
    "profiles": ("profile",),
    "semantic_models": ("semantic_model_package", "shape_graph", "concept_scheme", "vocabulary", "class", "property"),
    "constraints": ("shape_graph", "class", "property"),
    "classes": ("class",),
    "properties": ("property",),
    "vocabularies": ("vocabulary", "concept_scheme"),
    "policy_artifacts": ("policy",),
    "trust_artifacts": ("trust_artifact",),
    "openapi_specs": ("api_description",),
}
ACCESS_KINDS = ("data_service", "distribution", "api_description")
POLICY_WORDS, TRUST_WORDS = ("policy", "rights", "access"), ("trust", "issuer", "verifier", "did", "credential")


def facet(assets: DataFrame, name: str) -> DataFrame:
    return assets.where(F.col("kind").isin(*FACETS[name]))


def is_registerable(kind: Column, uri: Column, title: Column) -> Column:
    return kind.isin(*REGISTERABLE) | (kind.isin(*REGISTERABLE_IF_NAMED) & (uri.isNotNull() | title.isNotNull()))


def registerable_assets(assets: DataFrame) -> DataFrame:
    return assets.where(is_registerable(F.col("kind"), F.col("uri"), F.col("title")))


def has_stable_identity(uri: Column, id_: Column, artifact_id: Column) -> Column:
    return F.coalesce(uri.rlike("^(https?|urn|did):"), F.lit(False)) | ((F.coalesce(id_, F.lit("")) != "") & (F.coalesce(artifact_id, F.lit("")) != ""))


def registry(assets: DataFrame, artifacts: DataFrame) -> DataFrame:
    """What a registry shows of an asset, with the URL that it was read from."""
    source = artifacts.groupBy("run_id", F.col("id").alias("artifact_id")).agg(F.min_by(F.coalesce("final_url", "url"), "ordinal").alias("source_url"))
    return assets.join(source, ["run_id", "artifact_id"], "left").select("run_id", "id", "kind", "uri", "title", "description", "publisher", "source_url")


def access_methods(assets: DataFrame) -> DataFrame:
    """Assets that something can be reached by: three kinds, or any with an endpoint."""
    return assets.where(F.col("kind").isin(*ACCESS_KINDS) | F.col("endpoint_url").isNotNull())


def hints(assets: DataFrame) -> DataFrame:
    return assets.select("run_id", F.col("id").alias("asset_id"), F.explode("source_hints").alias("hint")).select("run_id", "asset_id", "hint.label", "hint.predicate", "hint.path", F.lower(F.coalesce("hint.predicate", "hint.label")).alias("term"))


def _with_words(found: DataFrame, words: tuple[str, ...]) -> DataFrame:
    return found.where(reduce(lambda a, b: a | b, (F.contains("term", F.lit(w)) for w in words)))


def policy_signals(assets: DataFrame) -> DataFrame:
    return _with_words(hints(assets), POLICY_WORDS)


def trust_signals(assets: DataFrame) -> DataFrame:
    return _with_words(hints(assets), TRUST_WORDS)


def claims_of(claims: DataFrame, assets: DataFrame) -> DataFrame:
    """Claims of the artifact that an asset was read from."""
    return claims.join(assets.select("run_id", F.col("artifact_id").alias("claimed_by"), F.col("id").alias("asset_id")), (claims.run_id == assets.run_id) & (claims.artifact_id == F.col("claimed_by"))).select(claims["*"], "asset_id")


def conforms_to(assets: DataFrame) -> DataFrame:
    return assets.select("run_id", F.col("id").alias("asset_id"), F.explode("conforms_to").alias("iri"))


def evidence_location(e: Column) -> Column:
    """Where a piece of evidence lies, by its source."""
    s = e["source"]
    return (
        F.when(s == "http_header", e["value"])
        .when(s == "json_ld_predicate", F.coalesce(e["pointer"], e["value"]))
        .when(s == "json_pointer", e["pointer"])
        .when(s == "html_link", F.coalesce(e["pointer"], e["href"]))
        .when(s == "url_pattern", e["value"])
        .when(s == "content_sniff", e["marker"])
        .when(s == "host_policy", F.coalesce(e["value"], e["policy"]))
        .when(s == "schema_property", e["schema_pointer"])
        .when(s.isin("shacl_property", "open_api_operation"), e["path"])
        .when(s == "ogc_collection", e["collection_id"])
    )


def evidence_item(e: Column) -> tuple[Column, Column]:
    """The term and the value that a piece of evidence shows."""
    s = e["source"]
    term = (
        F.when(s == "http_header", F.coalesce(e["rel"], e["header_name"]))
        .when(s.isin("json_ld_predicate", "shacl_property"), e["predicate"])
        .when(s == "json_pointer", e["pointer"])
        .when(s == "html_link", e["rel"])
        .when(s == "schema_property", e["property_name"])
        .when(s == "open_api_operation", F.concat_ws(" ", F.upper(e["method"]), e["path"]))
        .when(s == "ogc_collection", e["collection_id"])
        .otherwise(s)
    )
    return term, F.coalesce(e["value"], e["summary"], e["title"], e["href"], e["marker"])


def evidence_for_assets(assets: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, asset_id, term, value): source hints and findings of each asset."""
    term, value = evidence_item(F.col("evidence"))
    own = findings.where("asset_id is not null").select("run_id", "asset_id", term.alias("term"), value.alias("value"))
    return hints(assets).select("run_id", "asset_id", F.coalesce("predicate", "label").alias("term"), F.coalesce("path", "label").alias("value")).unionByName(own)


def conditions(artifacts: DataFrame, assets: DataFrame, profiles: DataFrame, rejected: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, ord, condition, status): ten conditions of each run; every table is read once and combined before its shuffle."""
    kind, named = F.col("kind"), is_registerable(F.col("kind"), F.col("uri"), F.col("title"))
    hint_words = lambda words: F.exists(F.coalesce("source_hints", F.array().cast("array<struct<label:string,predicate:string,path:string>>")), lambda h: reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(h["predicate"], h["label"])), F.lit(w)) for w in words)))
    labelled = F.col("title").isNotNull() | F.exists("source_hints", lambda h: F.trim(h["label"]) != "")
    a = assets.groupBy("run_id").agg(
        F.bool_or(named & (kind != "distribution")).alias("register"),
        F.bool_or(named).alias("any_named"),
        F.bool_and(F.when(named, has_stable_identity(F.col("uri"), F.col("id"), F.col("artifact_id")))).alias("stable"),
        F.bool_and(F.when(named, F.coalesce(labelled, F.lit(False)))).alias("labels"),
        F.bool_or(kind.isin(*ACCESS_KINDS) | F.col("endpoint_url").isNotNull()).alias("access"),
        F.bool_or(kind.isin("shape_graph", "semantic_model_package", "class", "property", "vocabulary", "concept_scheme")).alias("semantic"),
        F.bool_or(F.size("conforms_to") > 0).alias("conforms"),
        F.bool_or((kind == "policy") | F.coalesce(hint_words(POLICY_WORDS), F.lit(False))).alias("policy"),
        F.bool_or((kind == "trust_artifact") | F.coalesce(hint_words(TRUST_WORDS), F.lit(False))).alias("trust"),
    )
    b = artifacts.groupBy("run_id").agg(
        F.bool_or((F.col("status") == "fetched") & ~kind.isin("unknown", "html_landing_page")).alias("entry"),
        F.bool_or(kind.isin("shacl", "json_schema", "link_ml_schema", "owl_ontology")).alias("constraint"),
        F.bool_or(kind.isin("did_document", "verifiable_credential")).alias("did"),
    )
    c = profiles.groupBy("run_id").agg(F.lit(True).alias("profile"))
    d = rejected.groupBy("run_id").agg(F.bool_or(F.col("discovered_from").isNull()).alias("blocking"))
    row = runs.select("run_id").join(a, "run_id", "left").join(b, "run_id", "left").join(c, "run_id", "left").join(d, "run_id", "left")
    yes = lambda *cs: F.when(reduce(lambda x, y: x | y, (F.coalesce(F.col(x), F.lit(False)) for x in cs)), "True").otherwise("False")
    third = lambda x: F.when(~F.coalesce("any_named", F.lit(False)), "False").when(F.col(x), "True").otherwise("Warning")
    status = (yes("entry"), yes("register"), third("stable"), third("labels"), yes("access"), yes("semantic", "constraint"), yes("profile", "conforms"), yes("policy"), yes("trust", "did"), F.when(F.col("blocking").isNull(), "True").when(F.col("blocking"), "False").otherwise("Warning"))
    return row.select("run_id", F.inline(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(n).alias("condition"), s.alias("status")) for k, (n, s) in enumerate(zip(CONDITIONS, status, strict=True))))))


def asset_label(title: Column, uri: Column, id_: Column) -> Column:
    return first_text(title, uri, id_)
