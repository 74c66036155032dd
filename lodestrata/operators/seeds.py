"""The workbench's search: routes grow from seeds, which are assets with a wanted label and properties with a wanted field.

Assets: run_id, id, kind, uri, title, publisher, endpoint_url, artifact_id,
ordinal, seq. Properties: run_id, id, artifact_id, fields, label, location,
asset_label, ordinal, seq. Terms: need_id, role (any or all), ord, kind (label,
field or iri), value. All runs and needs are searched at once, by equi joins on
canonical labels and fields; "first" is a minimum of structs by (ordinal, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from . import capability

DISTRIBUTIONS = ("distribution", "record_collection", "feature_collection")
SERVICES = ("api_description", "data_service")
_ORDER = ("ordinal", "seq", "id")


def properties_of(findings: DataFrame) -> DataFrame:
    """Schema and shape properties from a report's findings (evidence as a struct)."""
    e = lambda name: F.col(f"evidence.{name}")
    shape = e("source") == "shacl_property"
    shown = F.when(shape, labels.label_from_iri(e("shape")))
    fields = F.array_compact(F.when(shape, F.array(e("path"), e("predicate"), e("shape"))).otherwise(F.array(e("property_name"), e("property_path"), e("schema_pointer"))))
    location = F.when(shape, e("path")).otherwise(e("property_path"))
    return findings.where(e("source").isin("schema_property", "shacl_property")).select(
        "run_id", "id", e("artifact_id").alias("artifact_id"), fields.alias("fields"), F.coalesce(shown, e("value"), location).alias("label"), location.alias("location"), shown.alias("asset_label"), "ordinal", "seq"
    )


def _first(frame: DataFrame, *keys: str) -> DataFrame:
    kept = F.min_by(F.struct("id", "kind", "title"), F.struct(*_ORDER)).alias("_f")
    return frame.groupBy("run_id", *keys).agg(kept)


def property_assets(assets: DataFrame, properties: DataFrame) -> DataFrame:
    """(run_id, id, asset_id) of each property: the first asset of its artifact; where that is a catalogue or there is none, the first asset with the label of the property's shape, if there is one."""
    direct = _first(assets, "artifact_id").select("run_id", "artifact_id", F.col("_f.id").alias("direct"), F.col("_f.kind").alias("direct_kind"))
    named = _first(assets.where("title is not null").withColumn("_label", labels.canonical_label(F.col("title"))), "_label").select("run_id", "_label", F.col("_f.id").alias("named"))
    own = properties.withColumn("_label", labels.canonical_label(F.col("asset_label")))
    found = own.join(direct, ["run_id", "artifact_id"], "left").join(named, ["run_id", "_label"], "left")
    keep = F.col("direct").isNotNull() & (F.col("direct_kind") != "catalog")
    return found.select("run_id", "id", F.when(keep, F.col("direct")).otherwise(F.coalesce("named", "direct")).alias("asset_id"))


def asset_properties(assets: DataFrame, properties: DataFrame) -> DataFrame:
    """(run_id, asset_id, id, label, location): the properties that bear an asset out, as the first asset of their artifact has its label."""
    canonical = labels.canonical_label(F.coalesce("title", F.lit("")))
    first = _first(assets, "artifact_id").select("run_id", "artifact_id", labels.canonical_label(F.coalesce("_f.title", F.lit(""))).alias("_label"))
    by_label = properties.join(first, ["run_id", "artifact_id"]).select("run_id", "_label", "id", "label", "location")
    return assets.select("run_id", F.col("id").alias("asset_id"), canonical.alias("_label")).join(by_label, ["run_id", "_label"]).drop("_label")


def _related(assets: DataFrame) -> DataFrame:
    """(run_id, id, distribution): the first distribution-like asset with the same access label or route key, for all others."""
    as_one = assets.withColumn("kind", F.when(F.col("kind").isin(*DISTRIBUTIONS), "distribution").otherwise(F.col("kind")))
    return capability.related_distribution(as_one)


def access(assets: DataFrame, rejected: DataFrame) -> DataFrame:
    """(run_id, id, access_kind, source_url): a rejected fetch, else the asset's endpoint, else the same of its distribution; else metadata only."""
    own = assets.join(capability.rejected_access(assets, rejected), ["run_id", "id"], "left")
    end = F.coalesce("endpoint_url", F.when(F.col("kind").isin(*DISTRIBUTIONS), F.col("uri")))
    kind = F.when(F.col("kind").isin(*SERVICES), "api_description_available").when(F.col("kind").isin(*DISTRIBUTIONS), "dataset_distribution").otherwise("metadata_only")
    direct = own.select("run_id", "id", F.when(F.col("rejected_url").isNotNull(), F.struct(F.lit("rejected_or_gated").alias("kind"), F.col("rejected_url").alias("url"))).when(end.isNotNull(), F.struct(kind.alias("kind"), end.alias("url"))).alias("own"))
    of = direct.select("run_id", F.col("id").alias("distribution"), F.col("own").alias("its"))
    found = direct.join(_related(assets), ["run_id", "id"], "left").join(of, ["run_id", "distribution"], "left").withColumn("a", F.coalesce("own", "its"))
    return found.select("run_id", "id", F.coalesce("a.kind", F.lit("metadata_only")).alias("access_kind"), F.col("a.url").alias("source_url"))


def signals(assets: DataFrame, findings: DataFrame | None, links: DataFrame | None) -> DataFrame:
    """(run_id, id, has_authority, has_legal_basis, has_freshness, has_source) from an asset's publisher, and from the signals and `produces` links of the asset, its distribution and its dataset."""
    dist, sets = _related(assets), capability.related_dataset(assets)
    of_dist = dist.join(sets.select("run_id", F.col("id").alias("distribution"), "dataset"), ["run_id", "distribution"]).select("run_id", "id", F.col("dataset").alias("other"))
    whole = assets.select("run_id", "id", F.col("id").alias("other")).unionByName(dist.select("run_id", "id", F.col("distribution").alias("other")))
    whole = whole.unionByName(sets.select("run_id", "id", F.col("dataset").alias("other"))).unionByName(of_dist.join(sets.select("run_id", "id"), ["run_id", "id"], "left_anti")).distinct()
    found = assets.where("publisher is not null").select("run_id", F.col("id").alias("other"), F.lit("dcterms:publisher").alias("standard_iri")).join(whole.where("id = other"), ["run_id", "other"]).select("run_id", "id", "standard_iri")
    if findings is not None:
        said = findings.where("code = 'semantic.standard_signal'").select("run_id", F.col("asset_id").alias("other"), "standard_iri")
        found = found.unionByName(whole.join(said, ["run_id", "other"]).select("run_id", "id", "standard_iri"))
    if links is not None:
        url = assets.select("run_id", F.col("id").alias("other"), F.explode(F.array_distinct(F.array_compact(F.array("endpoint_url", "uri")))).alias("url"))
        made = links.where("predicate = 'cpsv:produces'").select("run_id", F.explode(F.array_distinct(F.array_compact(F.array("to_url", F.nullif(F.regexp_extract("to_url", "(#[^#]*)$", 1), F.lit("")))))).alias("url")).distinct()
        found = found.unionByName(whole.join(url.join(made, ["run_id", "url"]).select("run_id", "other").distinct(), ["run_id", "other"]).select("run_id", "id", F.lit("cpsv:produces").alias("standard_iri")))
    return capability.standard_signals(found.select("run_id", F.col("id").alias("asset_id"), F.lit("semantic.standard_signal").alias("code"), "standard_iri")).withColumnRenamed("asset_id", "id")


def _canonical(kind: Column, value: Column) -> Column:
    return F.when(kind == "label", labels.canonical_label(value)).when(kind == "field", labels.loose_field(value)).otherwise(value)


def satisfied(facts: DataFrame, terms: DataFrame) -> DataFrame:
    """(run_id, need_id, route_id) of routes whose facts (run_id, need_id, route_id, kind, value) hold one of the need's `any` terms, if it has any, and all its `all` terms."""
    want = terms.groupBy("need_id").agg(F.bool_or(F.col("role") == "any").alias("some"), F.count_distinct(F.when(F.col("role") == "all", F.struct("kind", "value"))).alias("every"))
    asked = terms.select("need_id", "role", "kind", "value").distinct()
    keys = ["run_id", "need_id", "route_id"]
    held = facts.distinct().join(asked, ["need_id", "kind", "value"], "left").groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("role") == "any"), F.lit(False)).alias("has"), F.count_distinct(F.when(F.col("role") == "all", F.struct("kind", "value"))).alias("n"))
    return held.join(want, "need_id").where("(has or not some) and n = every").select(*keys)


def prefer_callable(routes: DataFrame) -> DataFrame:
    """Of each run and need only routes with access, where there is one."""
    callable_ = F.col("access_kind") != "metadata_only"
    best = routes.groupBy("run_id", "need_id").agg(F.bool_or(callable_).alias("_some"))
    return routes.join(best, ["run_id", "need_id"]).where(callable_ | ~F.col("_some")).drop("_some")


def one_each(routes: DataFrame) -> DataFrame:
    """Of routes of a need with the same source URL, or else id, the last in order, at the place of the first."""
    order = F.struct("order", F.col("kind_ord").alias("k"), "ordinal", "seq", "route_id")
    rest = [c for c in routes.columns if c not in ("run_id", "need_id", "order", "kind_ord", "ordinal", "seq")]
    packed = routes.groupBy("run_id", "need_id", F.coalesce("source_url", "route_id").alias("_key")).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.min(order).alias("position"))
    return packed.select("run_id", "need_id", "_r.*", "position")


def in_order(routes: DataFrame) -> DataFrame:
    """Routes by need in the order of the result: confidence falling, then label in binary order."""
    return routes.orderBy("run_id", "need_id", "position")


def search(assets: DataFrame, properties: DataFrame, needs: DataFrame, terms: DataFrame, rejected: DataFrame, findings: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """run_id, need_id, route_id, label, source_url, access_kind, confidence, role, gaps, review_flags and position of each route. needs: need_id, label; rejected: run_id, url."""
    asked = terms.withColumn("value", _canonical(F.col("kind"), F.col("value")))
    reach = access(assets, rejected)
    known = assets.join(reach, ["run_id", "id"])
    seed = asked.where("kind = 'label'").groupBy("need_id", F.col("value").alias("_label")).agg(F.min("ord").alias("ord"))
    by_asset = known.withColumn("_label", labels.canonical_label(F.coalesce("title", F.lit("")))).join(seed, "_label").select(
        "run_id", "need_id", F.concat_ws(":", "need_id", "id").alias("route_id"), F.col("id").alias("asset_id"), F.coalesce("title", "uri", "id").alias("label"), "source_url", "access_kind",
        F.when(F.col("access_kind") == "metadata_only", "medium").otherwise("high").alias("confidence"), F.lit(0).alias("kind_ord"), "ordinal", "seq", F.coalesce("uri", "endpoint_url").alias("location"), F.lit(None).cast("string").alias("own_label"), F.lit(None).cast("string").alias("property_id"),
    )
    field = properties.select("*", F.explode(F.array_distinct(F.transform("fields", labels.loose_field))).alias("value"))
    hit = field.join(asked.where("kind = 'field'").select("need_id", "value").distinct(), "value").dropDuplicates(["run_id", "need_id", "id"])
    placed = hit.select("run_id", "need_id", "id", F.col("label").alias("own_label"), "location", "ordinal", "seq").join(property_assets(assets, properties), ["run_id", "id"])
    a = known.select("run_id", F.col("id").alias("asset_id"), "title", "uri", "endpoint_url", "source_url", "access_kind")
    by_property = placed.join(a, ["run_id", "asset_id"], "left").select(
        "run_id", "need_id", F.concat_ws(":", "need_id", "id").alias("route_id"), "asset_id", F.coalesce("title", "location").alias("label"), F.coalesce("source_url", "uri", "endpoint_url").alias("source_url"), F.coalesce("access_kind", F.lit("metadata_only")).alias("access_kind"),
        F.when(F.col("asset_id").isNotNull(), "medium").otherwise("low").alias("confidence"), F.lit(1).alias("kind_ord"), "ordinal", "seq", "location", "own_label", F.col("id").alias("property_id"),
    )
    routes = by_asset.unionByName(by_property)

    key = ["run_id", "need_id", "route_id"]
    fact = lambda df, *values: df.select(*key, F.explode(F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), _canonical(F.lit(k), v).alias("value"))) for k, v in values)))).alias("f")).select(*key, "f.*")
    c = F.col
    facts = fact(routes, ("label", c("label")), ("iri", c("source_url")), ("label", c("own_label")), ("field", c("own_label")), ("field", c("location")), ("iri", c("location")))
    facts = facts.unionByName(fact(routes.where("kind_ord = 0 and source_url is not null"), ("label", F.lit("Access method")), ("field", F.lit("Access method")), ("field", c("source_url"))))
    own = asset_properties(assets, properties).withColumnsRenamed({"label": "p_label", "location": "p_location"}).drop("id")
    facts = facts.unionByName(fact(routes.where("kind_ord = 0").select(*key, "asset_id").join(own, ["run_id", "asset_id"]), ("label", c("p_label")), ("field", c("p_label")), ("field", c("p_location")), ("iri", c("p_location"))))
    # the wanted label itself is evidence of a route that grew from it
    facts = facts.unionByName(fact(routes.where("kind_ord = 0"), ("field", c("label"))))
    kept = routes.join(satisfied(facts, asked), key)
    text = needs.join(terms.groupBy("need_id").agg(F.array_join(F.array_sort(F.collect_set("value")), " ").alias("_v")), "need_id", "left").select("need_id", labels.needs_review(F.concat_ws(" ", "need_id", "label", "_v")).alias("_review"))
    kept = kept.join(signals(assets, findings, links).withColumnRenamed("id", "asset_id"), ["run_id", "asset_id"], "left").join(text, "need_id", "left")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    authority, legal, fresh, source = (flag(n) for n in ("has_authority", "has_legal_basis", "has_freshness", "has_source"))
    shown = kept.select(
        *key, "label", "source_url", "access_kind", "confidence", capability.role(source, authority, legal).alias("role"),
        capability.gaps(c("access_kind") == "metadata_only", authority, legal, fresh, source & authority & legal).alias("gaps"), F.when(flag("_review"), F.array(F.lit("sensitive data"), F.lit("policy review required"))).otherwise(F.array().cast("array<string>")).alias("review_flags"),
        F.struct(F.when(c("confidence") == "high", 0).when(c("confidence") == "medium", 1).otherwise(2).alias("c"), c("label").alias("l")).alias("order"), "kind_ord", "ordinal", "seq",
    )
    return prefer_callable(one_each(shown))
