"""Strict capability search: an inverted index of evidence records, joined with the accepted terms of all needs at once.

index rows: run_id, source_id, evidence_id, asset_id, strength, term_kind, value.
terms rows: query_id, need_id, role (any, all, about, purpose), group_ord, kind, value, set_id, mapping_id.
Term and record meet in one equi join on (kind, canonical value). Terms come from
a request, records from the corpus, so the join shuffles neither more than once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import iris, labels, urls
from ..functions.vocabulary import AUTHORITY_SIGNALS, FRESHNESS_SIGNALS, GAPS, LEGAL_SIGNALS, SOURCE_SIGNALS, STRUCTURED_KINDS
from ..sources.store import stored

STRUCTURED, METADATA, MAPPING, ACCESS = "structured", "metadata", "reviewed_mapping", "access"
TERM_SCHEMA = "query_id string, need_id string, role string, group_ord int, kind string, value string, set_id string, mapping_id string"


@dataclass
class Term:
    kind: str
    value: str | None = None
    set_id: str | None = None
    mapping_id: str | None = None

    @classmethod
    def iri(cls, value: str) -> Term:
        return cls("iri", value)

    @classmethod
    def label(cls, value: str) -> Term:
        return cls("label", value)

    @classmethod
    def named_field(cls, value: str) -> Term:
        return cls("field", value)

    @classmethod
    def reviewed_mapping(cls, set_id: str, mapping_id: str) -> Term:
        return cls("reviewed_mapping", None, set_id, mapping_id)


@dataclass
class InformationNeed:
    id: str
    question: str | None = None
    about: list[Term] = field(default_factory=list)
    any: list[Term] = field(default_factory=list)
    all: list[Term] = field(default_factory=list)

    def about_any(self, *terms: Term) -> InformationNeed:
        self.about += terms
        return self

    def requires_any(self, *terms: Term) -> InformationNeed:
        self.any += terms
        return self

    def requires_all(self, *terms: Term) -> InformationNeed:
        self.all += terms
        return self


@dataclass
class CapabilityQuery:
    id: str
    purpose: Term | None = None
    country: str | None = None
    prefixes: dict[str, str] = field(default_factory=dict)
    needs: list[InformationNeed] = field(default_factory=list)

    def need(self, need: InformationNeed) -> CapabilityQuery:
        self.needs.append(need)
        return self

    def terms(self, spark: SparkSession) -> DataFrame:
        if not self.needs:
            raise ValueError("a query has at least one need")
        rows = []
        for n in self.needs:
            groups = [("any", 0, n.any), ("about", 0, n.about), ("purpose", 0, [self.purpose] if self.purpose else [])] + [("all", k, [t]) for k, t in enumerate(n.all)]
            rows += [(self.id, n.id, role, k, t.kind, t.value, t.set_id, t.mapping_id) for role, k, own in groups for t in own]
        return spark.createDataFrame(rows, TERM_SCHEMA)


def strength_of(kind: Column) -> Column:
    return F.when(kind.isin(*STRUCTURED_KINDS), STRUCTURED).otherwise(METADATA)


def canonical_term(kind: Column, value: Column, prefixes: dict[str, str] | None = None) -> Column:
    return F.when(kind == "label", labels.canonical_label(value)).when(kind == "iri", iris.canonical(value, prefixes)).otherwise(labels.canonical_field(value))


def asset_records(assets: DataFrame) -> DataFrame:
    """Evidence records of assets: title, description and publisher are labels; URI, endpoint, conformance and subject IRIs are IRIs."""
    return assets.select(
        "run_id", "source_id", F.concat(F.lit("evidence:asset:"), "run_id", F.lit(":"), "id").alias("evidence_id"), F.col("id").alias("asset_id"), strength_of(F.col("kind")).alias("strength"),
        F.array_compact(F.array("title", "description", "publisher")).alias("labels"),
        F.array_compact(F.concat(F.array("uri", "endpoint_url"), F.coalesce("conforms_to", F.array().cast("array<string>")))).alias("iris"),
        F.array().cast("array<string>").alias("fields"),
    )


def hint_records(assets: DataFrame) -> DataFrame:
    """Evidence records of source hints: always structured; path and predicate are fields."""
    hint = assets.select("run_id", "source_id", "id", F.posexplode("source_hints").alias("k", "hint"))
    return hint.select(
        "run_id", "source_id", F.concat_ws(":", F.lit("evidence:asset-hint"), "run_id", "id", F.col("k").cast("string")).alias("evidence_id"), F.col("id").alias("asset_id"), F.lit(STRUCTURED).alias("strength"),
        F.array_compact(F.array("hint.label")).alias("labels"), F.array_compact(F.array("hint.predicate")).alias("iris"), F.array_compact(F.array("hint.path", "hint.predicate")).alias("fields"),
    )


def link_records(links: DataFrame) -> DataFrame:
    return links.select(
        "run_id", "source_id", F.concat_ws(":", F.lit("evidence:link"), "run_id", "id").alias("evidence_id"), F.lit(None).cast("string").alias("asset_id"), F.lit(ACCESS).alias("strength"),
        F.array_compact(F.array("rel", "role")).alias("labels"), F.array_compact(F.array("from_url", "to_url", "predicate")).alias("iris"), F.array().cast("array<string>").alias("fields"),
    )


def claim_records(claims: DataFrame, kind: str) -> DataFrame:
    return claims.select(
        "run_id", "source_id", F.concat_ws(":", F.lit(f"evidence:{kind}"), "run_id", "id").alias("evidence_id"), F.lit(None).cast("string").alias("asset_id"), F.lit(METADATA).alias("strength"),
        F.array_compact(F.array("label", "version")).alias("labels"), F.array_compact(F.array("iri")).alias("iris"), F.array().cast("array<string>").alias("fields"),
    )


def artifact_records(artifacts: DataFrame) -> DataFrame:
    return artifacts.select(
        "run_id", "source_id", F.concat_ws(":", F.lit("evidence:artifact"), "run_id", "id").alias("evidence_id"), F.lit(None).cast("string").alias("asset_id"), F.lit(METADATA).alias("strength"),
        F.array_compact(F.array("title", "description")).alias("labels"), F.array_compact(F.array("url", "final_url")).alias("iris"), F.array().cast("array<string>").alias("fields"),
    )


def finding_records(findings: DataFrame, first_assets: DataFrame) -> DataFrame:
    """Evidence records of findings. A finding without an asset belongs to the first asset of its artifact; what its evidence names depends on the evidence's source."""
    e = F.col("evidence")
    structured = e["source"].isin("schema_property", "shacl_property")
    access = e["source"].isin("open_api_operation", "ogc_collection")
    named = findings.join(first_assets.select("run_id", "artifact_id", F.col("asset_id").alias("_first")), ["run_id", "artifact_id"], "left")
    return named.select(
        "run_id", "source_id", F.concat_ws(":", F.lit("evidence:finding"), "run_id", "id").alias("evidence_id"), F.coalesce("asset_id", "_first").alias("asset_id"),
        F.when(structured, STRUCTURED).when(access, ACCESS).otherwise(METADATA).alias("strength"),
        F.array_compact(F.array("code", "message", e["value"], e["operation_id"], e["summary"], e["title"])).alias("labels"),
        F.array_compact(F.array("standard_iri", F.when(e["source"] == "shacl_property", e["shape"]), F.when(e["source"] == "shacl_property", e["path"]), F.when(e["source"].isin("json_ld_predicate", "http_header"), e["value"]), e["href"])).alias("iris"),
        F.array_compact(F.array(e["schema_pointer"], e["property_path"], e["property_name"], e["path"], e["predicate"], e["method"], e["operation_id"], e["collection_id"], e["pointer"], e["header_name"])).alias("fields"),
    )


def rejected_records(rejected: DataFrame) -> DataFrame:
    return rejected.select(
        "run_id", "source_id", F.concat_ws(":", F.lit("evidence:rejected-fetch"), "source_id", "id").alias("evidence_id"), F.lit(None).cast("string").alias("asset_id"), F.lit(ACCESS).alias("strength"),
        F.array_compact(F.array("reason_code")).alias("labels"), F.array_compact(F.array("url")).alias("iris"), F.array().cast("array<string>").alias("fields"),
    )


def mapping_records(mappings: DataFrame) -> DataFrame:
    return mappings.select(
        F.col("source_id").alias("run_id"), "source_id", F.concat_ws(":", F.lit("evidence:reviewed-mapping"), "set_id", "mapping_id").alias("evidence_id"), F.lit(None).cast("string").alias("asset_id"), F.lit(MAPPING).alias("strength"),
        F.array_compact(F.concat(F.array("label"), "labels")).alias("labels"), "iris", "fields",
    )


def inverted(records: DataFrame) -> DataFrame:
    """One row for each record, kind of term and distinct canonical value. Record IRIs know the default prefixes only."""
    by_kind = F.array(
        F.struct(F.lit("label").alias("kind"), F.transform("labels", labels.canonical_label).alias("values")),
        F.struct(F.lit("iri").alias("kind"), F.transform("iris", lambda x: iris.canonical(x)).alias("values")),
        F.struct(F.lit("field").alias("kind"), F.transform("fields", labels.canonical_field).alias("values")),
    )
    keys = ["run_id", "source_id", "evidence_id", "asset_id", "strength"]
    kinds = records.select(*keys, F.explode(by_kind).alias("_t"))
    return kinds.select(*keys, F.col("_t.kind").alias("term_kind"), F.explode(F.array_distinct("_t.values")).alias("value")).where("value <> ''")


def postings(records: DataFrame) -> DataFrame:
    """inverted() with a value as often as its record has it, blank ones too, for hits(), which makes them distinct and finds no blank: no function runs over arrays, and each value is made once."""
    by_kind = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("values")) for k, c in (("label", "labels"), ("iri", "iris"), ("field", "fields"))))
    keys = ["run_id", "source_id", "evidence_id", "asset_id", "strength"]
    kinds = records.select(*keys, F.explode(by_kind).alias("_t"))
    each = kinds.select(*keys, F.col("_t.kind").alias("term_kind"), F.explode("_t.values").alias("_value"))
    return each.select(*keys, "term_kind", F.coalesce(canonical_term(F.col("term_kind"), F.col("_value")), F.lit("")).alias("value"))  # never null: a filter of nulls would make it twice


def expanded_terms(terms: DataFrame, mappings: DataFrame | None = None, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Canonical terms; a reviewed mapping stands for all its labels, IRIs and fields. An unknown mapping is an error. A blank term has no value, and no hit. They are stored, so that a join knows how few they are."""
    keys = ["query_id", "need_id", "role", "group_ord"]
    plain = terms.where("kind <> 'reviewed_mapping'").select(*keys, "kind", "value", F.lit(False).alias("mapped"))
    asked = terms.where("kind = 'reviewed_mapping'")
    if mappings is not None:
        known = mappings.select("set_id", "mapping_id", F.concat(F.transform(F.array_compact(F.concat(F.array("label"), "labels")), lambda x: F.struct(F.lit("label").alias("kind"), x.alias("value"))), F.transform("iris", lambda x: F.struct(F.lit("iri").alias("kind"), x.alias("value"))), F.transform("fields", lambda x: F.struct(F.lit("field").alias("kind"), x.alias("value")))).alias("_terms"))
        missing = asked.join(known, ["set_id", "mapping_id"], "left_anti")
        plain = plain.unionByName(asked.join(known, ["set_id", "mapping_id"]).select(*keys, F.inline("_terms"), F.lit(True).alias("mapped")))
    else:
        missing = asked
    if missing.take(1):
        raise LookupError("a reviewed mapping is unknown")
    return stored(plain.withColumn("value", F.nullif(canonical_term(F.col("kind"), F.col("value"), prefixes), F.lit(""))).distinct(), "terms")


def hits(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Records that hold an accepted term, once for each need, role, group, evidence and term."""
    return index.join(terms.withColumnRenamed("kind", "term_kind"), ["term_kind", "value"]).dropDuplicates(["query_id", "need_id", "role", "group_ord", "source_id", "evidence_id", "term_kind", "value"])


def matched(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, need_id, source_id, asset_id, evidence counts): assets with a hit in `any`, where it is asked, and in every group of `all`.

    Where no hit of a need and source has an asset, the pseudo-asset `metadata` stands for them.
    """
    need = terms.where("role in ('any', 'all')").groupBy("query_id", "need_id").agg(F.max(F.when(F.col("role") == "any", 1).otherwise(0)).alias("want_any"), F.count_distinct(F.when(F.col("role") == "all", F.col("group_ord"))).alias("want_all"))
    required = found.where("role in ('any', 'all')")
    scope = ["query_id", "need_id", "source_id"]
    named = required.groupBy(*scope).agg(F.bool_or(F.col("asset_id").isNotNull()).alias("_named"))
    placed = required.join(named, scope).withColumn("asset_id", F.when(F.col("_named"), F.col("asset_id")).otherwise("metadata")).where("asset_id is not null")
    count = lambda *s: F.count_if(F.col("strength").isin(*s)).cast("int")
    by_asset = placed.groupBy(*scope, "asset_id").agg(
        F.max(F.when(F.col("role") == "any", 1).otherwise(0)).alias("has_any"), F.count_distinct(F.when(F.col("role") == "all", F.col("group_ord"))).alias("has_all"),
        count(STRUCTURED).alias("structured"), count(METADATA, ACCESS).alias("metadata"), count(MAPPING).alias("mapping"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"),
    )
    return by_asset.join(need, ["query_id", "need_id"]).where("has_any = want_any and has_all = want_all").drop("has_any", "has_all", "want_any", "want_all")


def context_signals(found: DataFrame) -> DataFrame:
    """Hits of the subject and the purpose: they accompany every match of their need and source, and never score."""
    return found.where("role in ('about', 'purpose')").groupBy("query_id", "need_id", "source_id").agg(F.array_sort(F.collect_set(F.struct("role", "evidence_id"))).alias("context"))


def standard_signals(findings: DataFrame) -> DataFrame:
    """(run_id, asset_id, has_authority, has_legal_basis, has_freshness, has_source) from standard-signal findings."""
    p = F.col("standard_iri")
    holds = lambda names, alias: F.bool_or(p.isin(*names)).alias(alias)
    return findings.where("code = 'semantic.standard_signal'").groupBy("run_id", "asset_id").agg(holds(AUTHORITY_SIGNALS, "has_authority"), holds(LEGAL_SIGNALS, "has_legal_basis"), holds(FRESHNESS_SIGNALS, "has_freshness"), holds(SOURCE_SIGNALS, "has_source"))


def access_of(kind: Column, uri: Column, endpoint: Column, hit_location: Column, rejected_url: Column) -> Column:
    """The access summary of an asset, by falling priority: an API or collection among its hits, a rejected fetch, its endpoint, its distribution; else metadata only."""
    summary = lambda access, end=None, dist=None, src=None, proto=None, how=None: F.struct(*(F.lit(v).alias(n) if v is None or isinstance(v, str) else v.alias(n) for n, v in (("kind", access), ("endpoint_url", end), ("distribution_url", dist), ("source_url", src), ("protocol_hint", proto), ("interaction_hint", how)))).cast("struct<kind:string,endpoint_url:string,distribution_url:string,source_url:string,protocol_hint:string,interaction_hint:string>")
    return (
        F.when(hit_location == "open_api_operation", summary("api_description_available", proto="openapi", how="request_response"))
        .when(hit_location == "ogc_collection", summary("dataset_distribution", proto="ogc-api", how="request_response"))
        .when(rejected_url.isNotNull(), summary("rejected_or_gated", rejected_url, None, rejected_url, "http"))
        .when(endpoint.isNotNull() & kind.isin("api_description", "data_service"), summary("api_description_available", endpoint, None, uri, urls.protocol_hint(endpoint), "request_response"))
        .when(endpoint.isNotNull(), summary("dataset_distribution", endpoint, None, uri, urls.protocol_hint(endpoint), "request_response"))
        .when(kind.isin("distribution", "dataset") & uri.isNotNull() & (kind == "distribution"), summary("dataset_distribution", uri, uri, uri, urls.protocol_hint(uri), "batch"))
        .otherwise(summary("metadata_only"))
    )


def access_urls(kind: Column, uri: Column, endpoint: Column) -> Column:
    """All URLs at which an asset can be reached: its endpoint, and its URI if it is a distribution, a collection or a service."""
    return F.array_distinct(F.array_compact(F.array(endpoint, F.when(kind.isin("distribution", "record_collection", "feature_collection", "api_description", "data_service"), uri))))


def rejected_access(assets: DataFrame, rejected: DataFrame) -> DataFrame:
    """(run_id, id, rejected_url): of each asset the first rejected fetch that is among its access URLs. rejected: run_id, url, and where it has one, seq."""
    order = F.struct("seq", "url") if "seq" in rejected.columns else F.struct("url")
    own = assets.select("run_id", "id", F.explode(access_urls(F.col("kind"), F.col("uri"), F.col("endpoint_url"))).alias("url"))
    gated = rejected.select("run_id", "url", *[c for c in ("seq",) if c in rejected.columns])
    return own.join(gated, ["run_id", "url"]).groupBy("run_id", "id").agg(F.min_by("url", order).alias("rejected_url"))


def inputs_summary(sources: DataFrame, mappings: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """One row: the ids of reports, of envelopes, of reviewed mapping sets with their version, and of review assertions, each in the order of its sources. sources: source_id, ordinal, run_id, is_envelope; mappings: source_id, set_id, version, set_ord; reviews: source_id, id, seq."""
    def listed(frame: DataFrame, value: Column, *order: str) -> DataFrame:
        return frame.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"]).alias("ids"))

    place = sources.select("source_id", "ordinal")
    parts = {"report_ids": listed(sources, F.col("run_id"), "ordinal"), "envelope_ids": listed(sources.where("is_envelope"), F.col("source_id"), "ordinal")}
    if mappings is not None:
        parts["reviewed_mapping_sets"] = listed(mappings.join(place, "source_id"), F.concat_ws("@", "set_id", "version"), "ordinal", "set_ord")
    if reviews is not None:
        parts["review_assertions"] = listed(reviews.join(place, "source_id"), F.col("id"), "ordinal", "seq")
    out = None
    for name, part in parts.items():  # one row each
        own = part.select(F.lit(1).alias("_one"), F.col("ids").alias(name))
        out = own if out is None else out.join(own, "_one")
    return out.drop("_one")


def related_distribution(assets: DataFrame) -> DataFrame:
    """(id, distribution): the first distribution with the same access label or the same route key, by (ordinal, seq)."""
    keyed = assets.select("run_id", "id", "kind", "ordinal", "seq", labels.canonical_access_label(F.col("title")).alias("_label"), urls.route_key(F.coalesce("endpoint_url", "uri")).alias("_route"))
    dist = keyed.where("kind = 'distribution'").withColumn("first", F.struct("ordinal", "seq", F.col("id").alias("distribution")))
    other = keyed.where("kind <> 'distribution'").select("run_id", "id", "_label", "_route")
    both = None
    for by in ("_label", "_route"):  # of each label and route the first, so that an asset meets one row and not all that share it
        some = F.col(by).isNotNull() if by == "_route" else F.col(by) != ""
        first = dist.where(some).groupBy("run_id", by).agg(F.min("first").alias("first"))
        met = other.where(some).join(first, ["run_id", by]).select("run_id", "id", "first")
        both = met if both is None else both.unionByName(met)
    return both.groupBy("run_id", "id").agg(F.min("first").alias("first")).select("run_id", "id", "first.distribution")


def related_dataset(assets: DataFrame) -> DataFrame:
    """(id, dataset): the first dataset whose URI is an asset's URL cut off behind `/datasets/{name}`."""
    sets = assets.where("kind = 'dataset'").select("run_id", F.col("uri").alias("_prefix"), F.col("id").alias("dataset"), "ordinal", "seq")
    other = assets.select("run_id", "id", urls.dataset_prefix(F.coalesce("endpoint_url", "uri")).alias("_prefix")).where("_prefix is not null")
    return other.join(sets, ["run_id", "_prefix"]).groupBy("run_id", "id").agg(F.min_by("dataset", F.struct("ordinal", "seq", "dataset")).alias("dataset"))


def ambiguous_runs(assets: DataFrame) -> DataFrame:
    """Runs with datasets of two keys at least."""
    return assets.where("kind = 'dataset'").groupBy("run_id").agg((F.count_distinct(F.coalesce("uri", "title", "id")) >= 2).alias("ambiguous"))


def gaps(metadata_only: Column, authority: Column, legal: Column, freshness: Column, source: Column) -> Column:
    """What a match leaves open, in the order of the list of gaps."""
    keep = {
        "NoCallableAccessMethod": metadata_only,
        "OperationDetailsUnavailable": metadata_only,
        "RequiredIdentifierUnknown": F.lit(True),
        "LegalBasisUnknown": ~legal,
        "AuthorityUnknown": ~authority,
        "SourceOfTruthUnknown": ~source,
        "FreshnessUnknown": ~freshness,
    }
    return F.array_compact(F.array(*(F.when(keep[g], F.lit(g)) for g in GAPS if g in keep)))


def role(source: Column, authority: Column, legal: Column) -> Column:
    return F.when(source & authority & legal, "candidate_source").otherwise("candidate_route")


def boundary(ambiguous: Column, asset: Column) -> Column:
    return F.when(ambiguous, "ambiguous").when(asset.isNotNull() & (asset != "metadata"), "gateway_or_intermediary").otherwise("unknown")


def confidence(structured: Column, metadata: Column, mapping: Column, access: Column) -> Column:
    """high: structured evidence and access; medium: structured evidence, or a reviewed mapping borne out by metadata; low: the rest."""
    return F.when((structured > 0) & (access > 0), "high").when((structured > 0) | ((mapping > 0) & (metadata > 0)), "medium").otherwise("low")


def ranked(matches: DataFrame) -> DataFrame:
    """matches with their rank in each need: structured, metadata, mapping, access counts falling; gaps, confidence, route id and evidence rising.

    Matches are dealt by ranges of that order and ranked within each range, to which
    the sizes of the ranges before are added: no task holds all matches of a need.
    """
    order = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    by = [F.desc("structured"), F.desc("metadata"), F.desc("mapping"), F.desc("access"), F.size("gaps"), order, "route_id", "evidence_ids"]
    need = ["query_id", "need_id"]
    dealt = stored(matches.repartitionByRange(*need, *by).withColumn("_part", F.spark_partition_id()), "matches")
    sizes = dealt.groupBy(*need, "_part").agg(F.count("*").alias("_n"))
    before = sizes.select(*need, "_part", (F.sum("_n").over(Window.partitionBy(*need).orderBy("_part")) - F.col("_n")).cast("int").alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*need, "_part").orderBy(*by)))
    return own.join(before, [*need, "_part"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def one_route_each(matches: DataFrame) -> DataFrame:
    """Of matches of a need with the same endpoint, distribution, source URL or else route, the first in rank."""
    key = F.coalesce("endpoint_url", "distribution_url", "source_url", "route_id")
    return matches.withColumn("_key", key).withColumn("_first", F.min("rank").over(Window.partitionBy("query_id", "need_id", "_key"))).where("rank = _first").drop("_key", "_first")


def search(index: DataFrame, assets: DataFrame, terms: DataFrame, signals: DataFrame | None = None, rejected: DataFrame | None = None, locations: DataFrame | None = None, mappings: DataFrame | None = None, prefixes: dict[str, str] | None = None) -> DataFrame:
    """All matches of all needs, scored, ranked and with one route each. assets: run_id, source_id, id, kind, uri, title, publisher, endpoint_url, ordinal, seq.

    The index is read once, for the hits; the assets once, for those that match. All that follows reads these.
    """
    asked = expanded_terms(terms, mappings, prefixes)
    match = stored(matched(stored(hits(index, asked), "hits"), asked), "matched")
    a = assets.select(F.col("source_id"), F.col("id").alias("asset_id"), "run_id", "kind", "uri", "title", "publisher", "endpoint_url")
    a = stored(a.join(match.select("source_id", "asset_id").distinct(), ["source_id", "asset_id"], "left_semi"), "met")
    joined = match.join(a, ["source_id", "asset_id"], "left")
    if locations is not None:
        keys = [c for c in ("query_id", "need_id", "source_id", "run_id", "asset_id") if c in locations.columns]
        joined = joined.join(locations.select(*keys, "location"), keys, "left")
    else:
        joined = joined.withColumn("location", F.lit(None).cast("string"))
    if rejected is not None:
        gated = rejected_access(assets, rejected).withColumnRenamed("id", "asset_id")
        joined = joined.join(gated, ["run_id", "asset_id"], "left")
    else:
        joined = joined.withColumn("rejected_url", F.lit(None).cast("string"))
    if signals is not None:
        joined = joined.join(signals, ["run_id", "asset_id"], "left")
    else:
        joined = joined.withColumns({c: F.lit(False) for c in ("has_authority", "has_legal_basis", "has_freshness", "has_source")})
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    joined = joined.join(ambiguous_runs(assets), "run_id", "left")
    joined = joined.withColumn("access_summary", access_of(F.col("kind"), F.col("uri"), F.col("endpoint_url"), F.col("location"), F.col("rejected_url")))
    only = F.col("access_summary.kind") == "metadata_only"
    source = flag("has_source") & flag("has_authority") & flag("has_legal_basis")
    out = joined.select(
        "query_id", "need_id", "source_id", "asset_id", F.concat_ws(":", "source_id", "need_id", "asset_id").alias("route_id"), "title",
        "structured", "metadata", "mapping", F.when(only, 0).otherwise(1).alias("access"), "evidence_ids", F.col("access_summary.kind").alias("access_kind"),
        "access_summary.endpoint_url", "access_summary.distribution_url", "access_summary.source_url",
        gaps(only, flag("has_authority"), flag("has_legal_basis"), flag("has_freshness"), source).alias("gaps"),
        role(flag("has_source"), flag("has_authority"), flag("has_legal_basis")).alias("role"), boundary(flag("ambiguous"), F.col("asset_id")).alias("boundary"),
        F.array_compact(F.array(F.when(labels.is_sensitive(F.coalesce("title", F.lit(""))), "SensitiveData"), F.when(flag("ambiguous"), "BoundaryAmbiguous"), F.when(labels.is_sensitive(F.coalesce("title", F.lit(""))), "PolicyReviewRequired"), F.when(F.col("mapping") > 0, "ReviewedMappingUsed"))).alias("review_flags"),
    )
    scored = out.withColumn("confidence", confidence(F.col("structured"), F.col("metadata"), F.col("mapping"), F.col("access")))
    return one_route_each(ranked(scored))
