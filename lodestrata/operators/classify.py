"""Row classifiers: what an artifact is, and what became of it. Ordered cascades as one expression each, with no join and no Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vocabulary import MEDIA_TYPES, PROFILE_WORDS, RECORD_TYPES, STANDARD_LABELS

#: Signals in lower-cased bodies (fixed values).
SHACL_WORDS = ("sh:nodeshape", "sh:propertyshape", "sh:targetclass", "sh:path", "www.w3.org/ns/shacl")
ODRL_WORDS = ("odrl:offer", "odrl:set", "odrl:agreement", "odrl:policy", "odrl:permission", "odrl:prohibition", "odrl:obligation", "www.w3.org/ns/odrl")
CATALOG_WORDS = (
    "dcat:catalog", "dcat:dataset", "dcat:dataservice", "dcat#catalog", "cpsv:publicservice", "cv:channel", "cv:requirement",
    "cccev:requirement", "cccev:evidencetype", "data.europa.eu/m8g",
)


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def media_type_for_path(c: Column) -> Column:
    """By the file extension; null for others."""
    extension = F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*(F.when(extension == k, F.lit(v)) for k, v in MEDIA_TYPES.items()))


def is_json(body: Column, media_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(media_type, F.lit(""))), F.lit("json")) | F.ltrim(body).rlike(r"^[\[{]")


def is_json_ld(body: Column) -> Column:
    return has_any(F.lower(body), ('"@context"', '"@graph"', '"@type"', *ODRL_WORDS, *SHACL_WORDS))


def ogc_kind(conforms_to: Column) -> Column:
    """records before features before landing, by parts of the conformance IRIs."""
    holds = lambda word: F.exists(conforms_to, lambda x: F.contains(F.lower(x), F.lit(word)))
    return F.when(holds("ogcapi-records"), "ogc_records").when(holds("ogcapi-features"), "ogc_features").when(holds("ogcapi"), "ogc_landing").otherwise("unknown")


def json_kind(body: Column) -> Column:
    """The kind of a JSON body; unknown for what is no JSON."""
    v = F.try_parse_json(body)
    kind = lambda key: F.schema_of_variant(F.try_variant_get(v, f"$['{key}']", "variant"))
    has = lambda key: kind(key).isNotNull()
    listed = lambda key: kind(key).startswith("ARRAY")
    conforms = F.coalesce(F.try_variant_get(v, "$['conformsTo']", "array<string>"), F.array(F.try_variant_get(v, "$['conformsTo']", "string")))
    keys = F.json_object_keys(body)
    low = F.lower(body)
    return (
        F.when(v.isNull(), "unknown")
        .when(has("openapi"), "open_api")
        .when(has("$schema") | has("$id"), "json_schema")
        .when(has("conformsTo") & has("links"), ogc_kind(conforms))
        .when(listed("links") | listed("datasets"), "metadata_index")
        .when(has("@context") & (F.size(F.array_except(keys, F.array(F.lit("@context"), F.lit("title"), F.lit("description"), F.lit("name"), F.lit("dcterms:title"), F.lit("dcterms:description")))) == 0), "json_ld_context")
        .when(has_any(low, SHACL_WORDS), "shacl")
        .when(has_any(low, ODRL_WORDS), "metadata_index")
        .when(has_any(low, CATALOG_WORDS), "dcat_catalog")
        .when(has_any(low, ("prof:profile", "prof/profile")), "prof_profile")
        .when(F.contains(low, F.lit("did:")) & F.contains(low, F.lit("verificationmethod")), "did_document")
        .otherwise("unknown")
    )


def turtle_kind(body: Column) -> Column:
    low = F.lower(body)
    return (
        F.when(has_any(low, ("sh:nodeshape", "sh:propertyshape", "sh:targetclass")), "shacl")
        .when(F.contains(low, F.lit("skos:conceptscheme")), "skos")
        .when(has_any(low, ("owl:ontology", "owl:class")), "owl_ontology")
        .otherwise("unknown")
    )


def is_linkml(body: Column) -> Column:
    """YAML with an id or name and classes, slots or enums at its top level."""
    return body.rlike(r"(?m)^(id|name):") & body.rlike(r"(?m)^(classes|slots|enums):")


def artifact_kind(url: Column, media_type: Column, body: Column) -> Column:
    """What an artifact is, by its URL, media type and body. url: the final one where there is one."""
    u, m, t = F.lower(url), F.lower(F.coalesce(media_type, F.lit(""))), F.ltrim(F.coalesce(body, F.lit("")))
    has = lambda word: F.contains(m, F.lit(word))
    return (
        F.when(u.endswith("semantic-asset-package.v1.toml") | (F.contains(t, F.lit("[package]")) & F.contains(t, F.lit("artifacts"))), "semantic_model_package")
        .when(u.endswith(".linkml.yaml") | u.endswith(".linkml.yml") | is_linkml(t), "link_ml_schema")
        .when(has("html") | t.startswith("<!doctype html") | t.startswith("<html"), "html_landing_page")
        .when(has("turtle") | u.endswith(".ttl"), turtle_kind(t))
        .when(has("schema+json") | u.endswith(".schema.json"), "json_schema")
        .when(has("openapi") | u.endswith("openapi.json"), "open_api")
        .when(is_json(t, media_type), json_kind(t))
        .otherwise("unknown")
    )


def http_status(status: Column) -> Column:
    return F.when(status.between(200, 299), "fetched").when(status.isin(401, 403), "auth_required").otherwise("failed")


def artifact_status(status: Column, kind: Column, error: Column) -> Column:
    """The status after extraction: an unknown kind is unsupported, an extractor's error a parse error."""
    by_http = http_status(status)
    return F.when((by_http == "fetched") & error.isNotNull(), "parse_error").when((by_http == "fetched") & (kind == "unknown"), "unsupported").otherwise(by_http)


def standard_label(iri: Column) -> Column:
    low = F.lower(iri)
    return F.coalesce(*(F.when(F.contains(low, F.lit(part)), F.lit(label)) for part, label in STANDARD_LABELS))


def looks_like_profile(iri: Column) -> Column:
    return has_any(F.lower(iri), PROFILE_WORDS)


def record_type(kind: Column) -> Column:
    """The workbench's record type of an asset kind; null for kinds that it does not show."""
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in RECORD_TYPES.items()))


def service_type(text: Column) -> Column:
    """The workbench's subtype of a service, by what its conformance and type values hold."""
    low = F.lower(text)
    return F.when(has_any(low, ("ogcapi-records", "ogc api records")), "ogc-record-collection").when(has_any(low, ("ogcapi-features", "ogc api features")), "ogc-feature-collection").otherwise("service")


def distribution_type(text: Column) -> Column:
    return F.when(has_any(F.lower(text), ("ogcapi-features", "geo+json")), "ogc-feature-collection").otherwise("distribution")


def is_base_registry(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("base-registry"))


def inferred_profile(iris: Column, own: tuple[str, str] | None = None) -> Column:
    """The profile that a catalogue's conformance IRIs stand for. own: a part of the IRIs of a publisher's own profile, and its id."""
    low = F.lower(F.array_join(iris, " "))
    known = F.when(has_any(low, ("bregdcat", "base-registry")), "breg-dcat-ap").when(F.contains(low, F.lit("2.1.1")), "dcat-ap-2").when(has_any(low, ("dcat-ap", "3.0.0")), "dcat-ap-3")
    if own:
        known = known.when(F.contains(low, F.lit(own[0].lower())), own[1])
    return known.otherwise("dcat-ap-3")
