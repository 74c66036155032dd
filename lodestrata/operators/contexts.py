"""JSON-LD contexts and SHACL property shapes over walked documents: what a name means, and which shape a property belongs to.

A term is defined by the nearest @context at or above the object that uses it; an inner
definition replaces an outer one for its object and all below. Each use of a name that
its document defines looks its definitions up at each pointer above it, an equi join on
(document, name, pointer), and keeps the deepest: an aggregate that combines before
its shuffle. Nothing holds a whole document, and no side of a join is broadcast: the
files' sizes, by which Spark would choose, say little of texts that compress well.

Results in edge cases: a definition that is neither a string with a colon nor an object with
@id is none, and null hides no outer one; of several contexts in an array the last counts; names that
begin with @ are never aliases; what lies inside a @context is not rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .jsonwalk import walk

_INSIDE = r"(^|/)@context(/|$)"
#: An id of an object, as `@id` or `id`.
OWN_ID = "coalesce(" + ", ".join(f"""CASE WHEN schema_of_variant(try_variant_get(v, '$["{n}"]', 'variant')) = 'STRING' THEN try_variant_get(v, '$["{n}"]', 'string') END""" for n in ("@id", "id")) + ")"


def parent(pointer: Column | str) -> Column:
    return F.regexp_replace(pointer, "/[^/]*$", "")


def above(pointer: Column) -> Column:
    """pointer and all pointers above it, the root's first."""
    steps = F.split(pointer, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))


def _text(value: str, at: str) -> Column:
    """What is at a path, if it is a string."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, at, "variant")) == "STRING", F.try_variant_get(value, at, "string"))


def definitions(walked: DataFrame) -> DataFrame:
    """(key, owner, path, alias, term, coercion): what the contexts of each document define. owner: the pointer of the object whose context it is."""
    rows = walked.where(F.col("name").isNotNull() & ~F.col("name").startswith("@"))
    inside = rows.withColumn("owner", F.regexp_extract("pointer", r"^(.*)/@context(?:/[0-9]+)*/[^/]*$", 1)).where(F.col("pointer").rlike(r"/@context(/[0-9]+)*/[^/]*$") & ~F.col("owner").rlike(_INSIDE))
    simple, of_object = _text("value", "$"), _text("value", '$["@id"]')
    term = F.coalesce(F.when(F.contains(simple, F.lit(":")), simple), F.when(F.col("kind").startswith("OBJECT"), of_object))
    return inside.select("key", "owner", "path", F.col("name").alias("alias"), term.alias("term"), F.when(F.col("kind").startswith("OBJECT"), _text("value", '$["@type"]')).alias("coercion")).where("term is not null")


def members(walked: DataFrame) -> DataFrame:
    """The members of objects outside of contexts, with the pointer of their object."""
    return walked.where(F.col("name").isNotNull() & ~F.col("pointer").rlike(_INSIDE)).withColumn("object", parent("pointer"))


def contextualized(walked: DataFrame) -> DataFrame:
    """members() with term, the name as the nearest context above has it (else the name itself), and coercion, the type that this gives to its values."""
    own, found = members(walked), definitions(walked)
    asked = own.select("key", "pointer", "object", "name").join(found.select("key", F.col("alias").alias("name")).distinct().hint("merge"), ["key", "name"], "left_semi")
    places = asked.select("key", "pointer", "name", F.explode(above(F.col("object"))).alias("owner"))
    known = places.join(found.withColumnRenamed("alias", "name").hint("merge"), ["key", "name", "owner"])
    # an inner owner's pointer is longer, and of one owner's contexts the last comes last in the path
    nearest = known.groupBy("key", "pointer").agg(F.max_by(F.struct("term", "coercion"), F.struct(F.length("owner"), "path")).alias("_n")).select("key", "pointer", "_n.*")
    return own.join(nearest.withColumnRenamed("term", "_term").hint("merge"), ["key", "pointer"], "left").withColumn("term", F.coalesce("_term", "name")).drop("_term")


def shape_properties(documents: DataFrame, key: str = "key", body: str = "body", contexts: bool = True) -> DataFrame:
    """(key, pointer, path, shape, property_path, label) of each property shape with a path, in the order of the documents: shape is the nearest object above with an id, at whatever depth, or null."""
    walked = walk(documents, key, body, {"nearest": OWN_ID})
    named = contextualized(walked) if contexts else members(walked).withColumn("term", F.col("name"))
    is_ = lambda local: F.col("term").isin(f"sh:{local}", f"http://www.w3.org/ns/shacl#{local}")
    # what is looked up several times is stored, so the levels of the walk are read once for members and once for objects
    texts = F.when(~is_("property"), F.coalesce(_text("value", "$"), _text("value", '$["@id"]')))
    some = stored(named.where(is_("property") | is_("path") | is_("name")).select("key", "pointer", "object", "term", texts.alias("text")), "shapes")
    objects = stored(walked.where("kind like 'OBJECT%'").select("key", "pointer", "nearest", "path"), "objects")
    # a property shape is the value of sh:property, or an entry of a list there
    holder = some.where(is_("property")).select("key", F.col("pointer").alias("at"), F.col("object").alias("above")).hint("merge")
    lists = holder.select("key", "at").hint("merge")
    paths = some.where(is_("path")).select("key", "object", F.col("text").alias("property_path")).where("property_path is not null")
    labels = some.where(is_("name")).groupBy("key", "object").agg(F.min("text").alias("label")).hint("merge")
    shaped = paths.withColumn("at", F.regexp_replace("object", "/[0-9]+$", "")).join(lists, ["key", "at"], "left_semi")
    direct = paths.withColumn("at", F.col("object")).join(lists, ["key", "at"], "left_semi")
    found = shaped.unionByName(direct).distinct()
    # the member that holds the property shapes hands down the id of its object, not of a shape in it
    ids = objects.select("key", F.col("pointer").alias("above"), F.col("nearest").alias("shape")).hint("merge")
    order = objects.select("key", F.col("pointer").alias("object"), "path").hint("merge")
    out = found.join(holder, ["key", "at"]).join(ids, ["key", "above"], "left").join(labels, ["key", "object"], "left").join(order, ["key", "object"])
    return out.select("key", F.col("object").alias("pointer"), "path", "shape", "property_path", "label")
