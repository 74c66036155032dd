"""JSON Schema, OpenAPI, OGC API and metadata indexes as rules over walked documents: no Python sees a body.

The walk hands down with each value what place it has in its format (role), the
member of an object that it belongs to, and for schemas how the keywords above lead
to it. Which texts a member stands for, which fields an object has, and all
facts follow by equi joins and aggregates that combine before their shuffle.
A list is gathered only where it is the value of a fact (what an asset conforms to).

Results in edge cases: an empty or null body, or one that Spark's JSON parser refuses (also for nesting beyond its 1000
levels or a name that an object has twice), is one error; a document of another shape than its format
asks for gives the asset of its kind with what can be read; members of odd types are none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vocabulary as V
from ..plans.schemas import EVIDENCE, EVIDENCE_FIELDS, FACTS
from ..sources.store import stored
from .contexts import parent
from .jsonwalk import walk

KINDS = ("json_schema", "open_api", "ogc_landing", "ogc_features", "ogc_records", "metadata_index")
#: Members that stand for an object where a text is asked for, the first that has one.
TEXT_KEYS = ("@id", "id", "@value", "value", "foaf:name", "name", "dcterms:title", "dct:title")
CONFORMS = ("conforms_to", "conformsTo")
#: Members whose texts the rules read.
WANTED = ("id", "@id", "$id", "$schema", "openapi", "title", "name", "description", "publisher", "base_url", "url", "uri", "href", "rel", "type", "dataset_id", "operationId", "summary")
LISTS = ("servers", "links", "collections", "datasets")
ROLES = ("root", "info", "docs", *LISTS, "operation")
SEGMENT = 8  # digits of a position in a rank

_in = lambda names: ", ".join(f"'{n}'" for n in names)
_is = lambda kind: f"schema_of_variant(v) LIKE '{kind}%'"
_place = f"lpad(CAST(position AS STRING), {SEGMENT}, '0')"
_rank = " ".join(f"WHEN name = '{n}' THEN concat(_chain, '{k}{'0' * (SEGMENT - 1)}')" for k, n in enumerate(TEXT_KEYS))
_ONE, _SOME = ("items", "additionalProperties", "contains", "propertyNames"), ("allOf", "anyOf", "oneOf", "prefixItems")
_order = " ".join(f"WHEN name = '{n}' THEN '{k}'" for k, n in enumerate(("properties", *_ONE, *_SOME)))

CARRY = {
    # the place of a value in its format; 'x[]' holds the x
    "role": f"""CASE WHEN depth = 0 THEN 'root' WHEN _role = 'root' AND name = 'info' THEN 'info' WHEN _role = 'root' AND name = 'externalDocs' THEN 'docs'
        WHEN _role = 'root' AND name IN ({_in(LISTS)}) AND {_is("ARRAY")} THEN concat(name, '[]') WHEN _role = 'root' AND name = 'paths' AND {_is("OBJECT")} THEN 'paths[]'
        WHEN _role = 'paths[]' AND {_is("OBJECT")} THEN 'path' WHEN _role = 'path' AND lower(name) IN ({_in(V.HTTP_METHODS)}) THEN 'operation'
        WHEN _role IN ({_in(f"{x}[]" for x in LISTS)}) THEN replace(_role, '[]', '') ELSE 'none' END""",
    # the member of an object that a value is, or is listed in, and the place of that object
    "member": "CASE WHEN depth = 0 OR name IS NOT NULL THEN pointer END",
    "member_name": "name",
    "holder": "CASE WHEN name IS NOT NULL THEN coalesce(_role, 'none') END",
    "under": "CASE WHEN _role = 'paths[]' THEN name END",
    # the ranks of the steps through which values above may take this one's text
    "chain": f"CASE WHEN depth = 0 THEN '' WHEN name IS NULL THEN concat(_chain, {_place}) {_rank} ELSE '' END",
    # schemas: what a value is by the keywords above it, its property path and its place in the order of keywords
    "state": f"""CASE WHEN depth = 0 THEN 'schema' WHEN _state IN ('schema', 'property') AND name = 'properties' AND {_is("OBJECT")} THEN 'names' WHEN _state IN ('schema', 'property') AND name IN ({_in(_ONE)}) THEN 'schema'
        WHEN _state IN ('schema', 'property') AND name IN ({_in(_SOME)}) AND {_is("ARRAY")} THEN 'parts' WHEN _state = 'names' AND name IS NOT NULL THEN 'property' WHEN _state = 'parts' AND name IS NULL THEN 'schema' ELSE 'none' END""",
    "dotted": "CASE WHEN _state = 'names' THEN if(coalesce(_dotted, '') = '', name, concat(_dotted, '.', name)) END",
    "order": f"CASE WHEN depth = 0 THEN '' WHEN _state IN ('schema', 'property') THEN concat(_order, CASE {_order} ELSE '9' END, {_place}) ELSE concat(_order, '0', {_place}) END",
}

#: What is walked on: schemas whole; of other documents what has a place in its format or may stand for a text that is read.
INSIDE = f"key.kind = 'json_schema' OR _role <> 'none' OR (_holder IN ({_in(ROLES)}) AND _member_name IN ({_in((*WANTED, *CONFORMS))})) OR (_holder = 'none' AND _chain <> '')"


def shorten(value: Column, most: int = 512) -> Column:
    """Evidence text of at most so many bytes, cut between characters, of a VARIANT: a text as it is, else JSON with a blank behind each separator."""
    compact = F.to_json(value)
    # what lies beyond the first characters is cut anyway; blanks only make it longer
    near = F.regexp_replace(F.substring(compact, 1, most + 1), r'\G((?:[^":,]|"(?:[^"\\]|\\.)*+")*+[:,])', "$1 ")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(near)
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(head, "�+$", ""), F.lit("...")))


def texts(walked: DataFrame) -> DataFrame:
    """(key, pointer, text) of each object or array that stands for a text: that of the first of TEXT_KEYS, or entry, that has one, at any depth."""
    leaf = walked.where("text IS NOT NULL AND chain <> ''").select("key", F.split("pointer", "/").alias("steps"), "chain", "text")
    up = leaf.select("key", "steps", "chain", "text", F.explode(F.expr(f"sequence(1, CAST(length(chain) / {SEGMENT} AS INT))")).alias("n"))
    at = F.array_join(F.expr("slice(steps, 1, size(steps) - n)"), "/")
    return up.groupBy("key", at.alias("pointer")).agg(F.min_by("text", F.expr(f"right(chain, n * {SEGMENT})")).alias("text"))


def _row(frame: DataFrame, fact: str, seq: Column | int, **given: Column | str | None) -> DataFrame:
    """One typed fact for each row of frame, which has key."""
    seq = F.lit(seq) if isinstance(seq, int) else seq
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    given = {"severity": "info"} | given if fact == "finding" else given
    body = F.struct(*(value(given.get(f.name)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(FACTS[fact])))
    return frame.select("key.run_id", "key.ordinal", "key.artifact_id", F.col("key.url").alias("from_url"), seq.cast("long").alias("seq"), F.lit(fact).alias("fact"), body.alias(fact))


def _evidence(source: str, **given: Column | str) -> Column:
    given = {n: x if isinstance(x, Column) else F.lit(x) for n, x in ({"source": source} | given).items()}
    return F.struct(*(given.get(n, F.lit(None)).cast("string").alias(n) for n in EVIDENCE_FIELDS)).cast(EVIDENCE)


def _some(*texts: Column) -> Column:
    """The first text that is there and not empty."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts))


def _hints(label: str, predicate: str, path: str | None = None) -> Column:
    return F.array(F.struct(F.lit(label).alias("label"), F.lit(predicate).alias("predicate"), F.lit(path).alias("path")))


def facts(found: DataFrame, present: set[str]) -> DataFrame:
    """(run_id, ordinal, artifact_id, from_url, seq, fact, and a typed column of each kind of fact) of the artifacts of KINDS: run_id, ordinal, artifact_id, url, at, kind, text. Rules of kinds that are not present are left out of the plan."""
    own = found.where(F.col("kind").isin(*KINDS))
    documents = own.select(F.struct("run_id", "ordinal", "artifact_id", "url", F.coalesce("at", "url", F.lit("")).alias("at"), "kind").alias("key"), F.coalesce("text", F.lit("")).alias("body"))
    walked = _walked(documents)
    broken = documents.where(F.try_parse_json("body").isNull())
    parts = [_row(broken, "error", 0, message="The body is no JSON that can be read")]

    # texts of the members that the rules read, one way for strings and one for what stands for a string
    rows = walked.where(F.col("holder").isin(*ROLES) & F.col("member_name").isin(*WANTED, *CONFORMS)).select("key", "pointer", "member", "member_name", "path", "kind", "text")
    said = rows.where("text IS NOT NULL").unionByName(rows.where("kind IN ('OBJECT', 'ARRAY')").drop("text").join(texts(walked), ["key", "pointer"]))
    fields = said.where("pointer = member").groupBy("key", parent("member").alias("pointer")).agg(F.map_from_entries(F.collect_list(F.struct("member_name", "text"))).alias("m"))
    entry = F.struct((F.col("member_name") == CONFORMS[1]).alias("late"), "path", "text")
    conforms = said.where(F.col("member_name").isin(*CONFORMS) & (F.col("kind") != "ARRAY")).groupBy("key", parent("member").alias("pointer")).agg(F.array_sort(F.collect_list(entry)).alias("_c"))
    objects = walked.where(F.col("role").isin(*ROLES)).select("key", "pointer", "role", "position", "under", F.col("name").alias("own_name"), "kind")
    objects = objects.join(fields, ["key", "pointer"], "left").join(conforms, ["key", "pointer"], "left")
    # OGC documents know one of the two spellings
    read = F.when(F.col("key.kind").startswith("ogc_"), F.filter("_c", lambda x: x["late"])).otherwise(F.col("_c"))
    objects = objects.withColumn("conforms", F.coalesce(F.transform(read, lambda x: x["text"]), F.array().cast("array<string>"))).drop("_c")
    objects = stored(objects, "objects")
    of = lambda role, *kinds: objects.where((F.col("role") == role) & F.col("key.kind").isin(*kinds))
    ogc = [k for k in KINDS if k.startswith("ogc_")]
    if "json_schema" in present:
        parts += [*_schemas(walked), *_schema_roots(of("root", "json_schema"))]
    if "open_api" in present:
        parts += _open_api(of)
    if present & set(ogc):
        parts += _ogc(of, ogc)
    if "metadata_index" in present:
        parts += _index(of, walked)
    if not present & {*ogc, "metadata_index"}:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    href = _some(F.col("m")["href"])
    linked = of("links", *ogc, "metadata_index").where(href.isNotNull())
    parts.append(_row(linked, "link", F.col("position"), href=href, rel=F.col("m")["rel"], role=F.col("m")["type"], evidence=_evidence("json_pointer", pointer=F.concat("pointer", F.lit("/href")), value=href)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _walked(documents: DataFrame) -> DataFrame:
    """The values that the rules ask for, as one table without their trees: text is what a string says, short the evidence of a schema's property."""
    every = walk(documents, carry=CARRY, inside=INSIDE).withColumn("text", F.when(F.col("kind") == "STRING", F.try_variant_get("value", "$", "string")))
    asked = F.col("role").isin(*ROLES, "datasets[]") | F.col("holder").isin(*ROLES) | (F.col("text").isNotNull() & ((F.col("chain") != "") | (F.col("name") == "$ref"))) | ((F.col("state") == "property") & (F.col("key.kind") == "json_schema"))
    short = F.when((F.col("state") == "property") & (F.col("key.kind") == "json_schema"), shorten(F.col("value")))
    return stored(every.where(asked).select("key", "pointer", "name", "position", "path", F.regexp_extract("kind", "^[A-Z]+", 0).alias("kind"), "text", short.alias("short"), *CARRY), "walked")


def _numbered(frame: DataFrame, *order: str) -> DataFrame:
    """Rows of each document counted from 0 in an order; a document is one row of the input, so its facts fit in a task."""
    keys = [F.col("key.run_id"), F.col("key.ordinal"), F.col("key.artifact_id")]
    return frame.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def _schemas(walked: DataFrame) -> list[DataFrame]:
    """Properties through the keywords that hold schemas, and references."""
    own = walked.where("key.kind = 'json_schema'")
    listed = _numbered(own.where("state = 'property'").select("key", "pointer", "name", "dotted", "order", "short"), "order")
    refs = _numbered(own.where("name = '$ref' AND text IS NOT NULL").select("key", "pointer", "path", "text"), "path")
    return [
        _row(listed, "finding", F.col("n"), code="semantic.schema_property", message="A schema has a property", evidence=_evidence("schema_property", schema_pointer=F.col("pointer"), property_path=F.col("dotted"), property_name=F.col("name"), value=F.col("short"))),
        _row(refs, "link", F.col("n") + 2, href=F.col("text"), predicate="$ref", role="schema-reference", evidence=_evidence("json_pointer", pointer=F.col("pointer"), value=F.col("text"))),
    ]


def _schema_roots(root: DataFrame) -> list[DataFrame]:
    m = F.col("m")
    meta = _some(m["$schema"])
    uri = _some(m["$id"], F.col("key.at"))
    conforms = F.when(meta.isNotNull(), F.array(meta)).otherwise(F.array().cast("array<string>"))
    out = [
        _row(root, "claim", 0, iri=F.coalesce(meta, F.lit(V.JSON_SCHEMA_IRI)), predicate="$schema"),
        _row(root, "asset", 0, kind="class", key=F.array(F.lit("json-schema"), uri), uri=uri, title=m["title"], description=m["description"], conforms=conforms, hints=_hints("JSON Schema", "$schema", "/$schema"), pointer="/"),
    ]
    for k, (name, role) in enumerate((("$id", "schema-id"), ("$schema", "schema-meta"))):
        out.append(_row(root.where(_some(m[name]).isNotNull()), "link", k, href=m[name], predicate=name, role=role, evidence=_evidence("json_pointer", pointer=f"/{name}", value=m[name])))
    return out


def _open_api(of) -> list[DataFrame]:
    m, kind = F.col("m"), "open_api"
    info = of("info", kind).select("key", m["title"].alias("title"), m["description"].alias("description"))
    servers = of("servers", kind).where(_some(m["url"]).isNotNull())
    first = servers.groupBy("key").agg(F.min_by(m["url"], "position").alias("endpoint"))
    root = of("root", kind).join(info, "key", "left").join(first, "key", "left")
    operations = _numbered(of("operation", kind), "under", "own_name")
    docs = of("docs", kind).where(_some(m["url"]).isNotNull())
    return [
        _row(root, "claim", 0, iri=V.OPENAPI_IRI, predicate="openapi", version=m["openapi"]),
        _row(root, "asset", 0, kind="api_description", key=F.array(F.lit("openapi")), uri=F.col("key.at"), title=_some(F.col("title"), F.lit("OpenAPI description")), description=F.col("description"), endpoint=F.col("endpoint"), conforms=F.array(F.lit(V.OPENAPI_IRI)), hints=_hints("OpenAPI", "openapi", "/openapi"), pointer="/"),
        _row(docs, "link", 0, href=m["url"], rel="describedby", role="external-docs", evidence=_evidence("json_pointer", pointer="/externalDocs/url", value=m["url"])),
        _row(servers, "link", F.col("position") + 1, href=m["url"], predicate="servers", role="api-server", evidence=_evidence("json_pointer", pointer=F.concat("pointer", F.lit("/url")), value=m["url"])),
        _row(operations, "finding", F.col("n"), code="semantic.openapi_operation", message="An API has an operation", evidence=_evidence("open_api_operation", path=F.col("under"), method=F.lower("own_name"), operation_id=m["operationId"], summary=m["summary"])),
    ]


def _ogc(of, kinds: list[str]) -> list[DataFrame]:
    m, low = F.col("m"), F.lower(F.concat_ws(" ", "conforms"))
    has = lambda word: F.contains(low, F.lit(word))
    root = of("root", *kinds).withColumn("found", F.when(has("ogcapi-records"), "ogc_records").when(has("ogcapi-features"), "ogc_features").when(has("ogcapi"), "ogc_landing"))
    features = F.coalesce("found", "key.kind") == "ogc_features"
    collections = of("collections", *kinds).where(_some(m["id"]).isNotNull())
    return [
        _row(root.where("found IS NOT NULL"), "kind", 0, kind=F.col("found")),
        _row(root.select("key", F.posexplode("conforms").alias("k", "iri")), "claim", F.col("k"), iri=F.col("iri"), predicate="conformsTo"),
        _row(root, "asset", 0, kind=F.when(features, "feature_collection").otherwise("record_collection"), key=F.array(F.lit("ogc")), uri=F.col("key.at"), title=_some(m["title"], F.lit("OGC API landing page")), description=m["description"], conforms=F.col("conforms"), hints=_hints("OGC API", "conformsTo", "/conformsTo"), pointer="/"),
        _row(collections, "finding", F.col("position"), code="semantic.ogc_collection", message="An API has a collection", evidence=_evidence("ogc_collection", collection_id=m["id"], title=m["title"])),
    ]


def _index(of, walked: DataFrame) -> list[DataFrame]:
    m, kind = F.col("m"), "metadata_index"
    listing = walked.where(f"role = 'datasets[]' AND key.kind = '{kind}'").select("key")
    root = of("root", kind).join(listing, "key", "left_semi")
    uri = _some(m["id"], F.col("key.at"))
    above = root.select("key", m["base_url"].alias("base"), m["publisher"].alias("publisher"))
    items = of("datasets", kind).where("kind = 'OBJECT'").join(above, "key", "left")
    named = F.concat(F.rtrim("base", F.lit("/")), F.lit("/datasets/"), _some(m["dataset_id"], m["id"]))
    own = _some(m["@id"], m["uri"], m["url"], F.when(F.col("base") != "", named))
    label = "metadata index dataset"
    return [
        _row(root, "asset", 0, kind="catalog", key=F.array(uri, F.lit("metadata index catalog")), uri=uri, title=m["title"], description=m["description"], publisher=m["publisher"], conforms=F.col("conforms"), hints=_hints("metadata index catalog", "@type"), pointer=None),
        _row(items, "asset", F.col("position") + 1, kind="dataset", key=F.array(F.coalesce(own, F.lit(label)), F.lit(label)), uri=own, title=F.coalesce(m["title"], m["name"]), description=m["description"], publisher=_some(m["publisher"], F.col("publisher")), conforms=F.col("conforms"), hints=_hints(label, "@type")),
    ]
