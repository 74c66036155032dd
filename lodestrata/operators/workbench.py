"""The catalogue workbench: records, fields, readiness, comparison, a graph within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import PREFIXES, READINESS
from .classify import record_type

NODE_BUDGET = 1500
EDGE_LABELS = {"dataset": "catalog contains dataset", "base-registry": "catalog contains dataset", "distribution": "dataset has distribution", "ogc-feature-collection": "dataset has distribution", "service": "catalog advertises service", "ogc-record-collection": "catalog advertises service", "operation-group": "service has API operation group"}
CATEGORIES = {"Identity": "discoverable", "Access": "discoverable", "Services": "discoverable", "Validation": "validatable", "Policy": "policy", "Trust": "trust", "Lifecycle": "lifecycle"}


def records(assets: DataFrame) -> DataFrame:
    """Assets that the workbench shows, with their record type. A run without a catalogue gets one."""
    shown = assets.withColumn("record_type", record_type(F.col("kind"))).where("record_type is not null").select("run_id", F.col("id").alias("record_id"), "record_type", "title", "uri", "ordinal", "seq")
    catalogs = shown.where("record_type = 'catalog'").select("run_id").distinct()
    bare = shown.select("run_id").distinct().join(catalogs, "run_id", "left_anti")
    made = bare.select("run_id", F.concat(F.lit("catalog:"), "run_id").alias("record_id"), F.lit("catalog").alias("record_type"), F.lit("Discovered catalogue").alias("title"), F.lit(None).cast("string").alias("uri"), F.lit(-1).alias("ordinal"), F.lit(-1).cast("long").alias("seq"))
    return shown.withColumns({"ordinal": F.col("ordinal").cast("int"), "seq": F.col("seq").cast("long")}).unionByName(made)


ACCESS_TYPES = ("service", "distribution", "ogc-feature-collection", "ogc-record-collection", "operation-group")


def with_parents(assets: DataFrame) -> DataFrame:
    """Records with the record that they belong to: datasets to the catalogue, ways of access to the dataset whose URI is the longest prefix of theirs, else to the catalogue; a catalogue counts its ways of access."""
    shown = assets.withColumn("record_type", record_type(F.col("kind"))).where("record_type is not null")
    rank = F.struct(F.when(F.col("kind") == "catalog", 0).otherwise(1), "ordinal", "seq")
    catalog = shown.where("kind in ('catalog', 'semantic_model_package')").groupBy("run_id").agg(F.min_by("id", rank).alias("_catalog"))
    key = F.concat_ws("\0", "run_id", "id")
    own = shown.where(F.col("record_type").isin(*ACCESS_TYPES)).select(key.alias("key"), F.col("run_id"), F.explode(F.array_compact(F.array("uri", "endpoint_url"))).alias("url"))
    sets = shown.where("kind in ('dataset', 'class') and uri is not null").select(F.concat_ws("\0", "run_id", "uri").alias("prefix"), F.col("id").alias("owner"))
    cuts = F.transform(F.filter(F.sequence(F.lit(1), F.length("url")), lambda i: F.substr(F.col("url"), i, F.lit(1)).isin("/", "#")), lambda i: F.substr(F.col("url"), F.lit(1), i - 1))
    near = own.select("key", F.explode(F.transform(F.array_distinct(F.concat(F.array("url"), cuts)), lambda p: F.concat_ws("\0", "run_id", p))).alias("prefix")).join(sets, "prefix")
    dataset = near.groupBy("key").agg(F.max_by("owner", F.struct(F.length("prefix"), F.col("owner"))).alias("_dataset"))
    placed = shown.withColumn("key", key).join(dataset, "key", "left").join(catalog, "run_id", "left")
    parent = F.when(F.col("record_type").isin("dataset", "base-registry"), F.col("_catalog")).when(F.col("record_type").isin(*ACCESS_TYPES), F.coalesce("_dataset", "_catalog"))
    counts = shown.groupBy("run_id").agg(F.count_if(F.col("record_type").isin(*ACCESS_TYPES)).alias("_n"))
    return placed.join(counts, "run_id").select(
        "run_id", F.col("id").alias("record_id"), "record_type", F.coalesce("title", "uri", "id").alias("name"), "publisher", F.nullif(parent, F.col("id")).alias("parent_id"),
        F.when(F.col("record_type") == "catalog", F.col("_n")).otherwise(0).alias("service_count"), F.try_element_at("conforms_to", F.lit(1)).alias("profile"), "uri",
    )


def nearest(urls: DataFrame, prefixes: DataFrame) -> DataFrame:
    """urls (key, url) with the longest of prefixes (prefix, owner) that the URL equals or that ends before a `/` or `#` of it.

    A URL's own prefixes are listed and joined, so this is an equi join and no
    comparison of all with all.
    """
    cuts = F.transform(F.filter(F.sequence(F.lit(1), F.length("url")), lambda i: F.substr(F.col("url"), i, F.lit(1)).isin("/", "#")), lambda i: F.substr(F.col("url"), F.lit(1), i - 1))
    own = urls.select("key", "url", F.explode(F.array_distinct(F.concat(F.array("url"), cuts))).alias("prefix")).where("prefix <> ''")
    best = own.join(prefixes, "prefix").groupBy("key").agg(F.max_by(F.struct("prefix", "owner"), F.struct(F.length("prefix"), F.col("prefix"))).alias("b"))
    return urls.join(best, "key", "left").select("key", "url", "b.prefix", "b.owner")


def eav(frame: DataFrame, key: Column, fields: dict[str, Column]) -> DataFrame:
    """(record_id, field_id, value) of every field that is not blank."""
    pairs = F.array(*(F.struct(F.lit(n).alias("field_id"), c.cast("string").alias("value")) for n, c in fields.items()))
    return frame.select(key.alias("record_id"), F.inline(pairs)).where("trim(value) <> ''")


def readiness_items(status: DataFrame) -> DataFrame:
    """status (run_id and one column for each item id with found, missing, invalid or auth-required): a row for each item."""
    rows = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(i).alias("item_id"), F.lit(g).alias("item_group"), F.lit(r).alias("item_rank"), F.col(f"`{i}`").alias("presence")) for k, (i, g, r) in enumerate(READINESS)))
    return status.select("run_id", F.inline(rows))


def readiness_categories(items: DataFrame, validated: bool = True) -> DataFrame:
    """(run_id, category, known, total, percent, status)."""
    category = F.coalesce(*(F.when(F.col("item_group") == g, F.lit(c)) for g, c in CATEGORIES.items()))
    known = F.col("presence") == "found"
    by = items.groupBy("run_id", category.alias("category")).agg(F.count_if(known).alias("known"), F.count("*").alias("total"), F.bool_or(~known & (F.col("item_rank") == "blocking")).alias("_blocked"), F.bool_or(F.col("presence").isin("invalid", "auth-required")).alias("_partial"))
    percent = F.floor(100 * F.col("known") / F.col("total") + 0.5).cast("int")
    status = F.when((F.col("category") == "validatable") & F.lit(not validated), "not-checked").when(F.col("_blocked"), "missing").when(F.col("known") == F.col("total"), "ready").when((F.col("known") > 0) | F.col("_partial"), "partial").otherwise("missing")
    return by.select("run_id", "category", "known", "total", percent.alias("percent"), status.alias("status"))


def top_missing(items: DataFrame, most: int = 3) -> DataFrame:
    """Of each run the first missing items by rank and order: a report of three."""
    weight = F.when(F.col("item_rank") == "blocking", 0).when(F.col("item_rank") == "recommended", 1).otherwise(2)
    missing = items.where("presence <> 'found'").withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy(weight, "ord")))
    return missing.where(F.col("position") <= most)


def grouped_items(items: DataFrame) -> DataFrame:
    """(run_id, group, items): the items of each run's checklist by group, sorted; a checklist has a fixed number of items."""
    return items.groupBy("run_id", "group").agg(F.array_sort(F.collect_list(F.struct("item", "status"))).alias("items"))


def is_publisher_specific(key: Column) -> Column:
    """Whether a key is of no standard vocabulary: it has a foreign prefix, or begins with `x-`."""
    standard = F.substring_index(key, ":", 1).isin(*PREFIXES) & F.contains(key, F.lit(":"))
    for iri in dict.fromkeys(PREFIXES.values()):
        standard = standard | key.startswith(iri)
    return ~key.startswith("@") & ~standard & (F.contains(key, F.lit(":")) | key.startswith("x-"))


def overview(records_: DataFrame, items: DataFrame) -> DataFrame:
    """(run_id, assets, access_methods, publisher_fields, blocking): what the overview counts. records_: run_id, type, publisher_fields; items: run_id, rank, status."""
    open_ = items.groupBy("run_id").agg(F.count_if((F.col("rank") == "blocking") & (F.col("status") != "known")).alias("blocking"))
    by = records_.groupBy("run_id").agg(F.count_if(F.col("type").isin("catalog", "dataset")).alias("assets"), F.count_if(F.col("type").isin("service", "distribution", "ogc-record-collection", "ogc-feature-collection")).alias("access_methods"), F.sum("publisher_fields").cast("long").alias("publisher_fields"))
    return by.join(open_, "run_id", "left").na.fill({"blocking": 0})


def comparison(fields: DataFrame, publisher: Column) -> DataFrame:
    """Core and publisher fields of all records, and whether publisher fields matter."""
    return fields.agg(F.count_if(~publisher).alias("core_fields"), F.count_if(publisher).alias("publisher_fields"), (F.count_if(publisher) > 0).alias("impact"))


def budgeted(nodes: DataFrame, edges: DataFrame, budget: int | None = NODE_BUDGET) -> tuple[DataFrame, DataFrame]:
    """The first nodes (node_id, node_type, seq) of each run up to the budget, and the edges between them. This is a display's limit; None keeps all."""
    if budget is None:
        return nodes, edges
    kept = nodes.withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy("seq", "node_id"))).where(F.col("_n") <= budget).drop("_n")
    ids = kept.select("run_id", "node_id")
    inside = edges.join(ids.withColumnRenamed("node_id", "source"), ["run_id", "source"], "left_semi").join(ids.withColumnRenamed("node_id", "target"), ["run_id", "target"], "left_semi")
    return kept, inside


def edge_label(node_type: Column) -> Column:
    return F.coalesce(*(F.when(node_type == k, F.lit(v)) for k, v in EDGE_LABELS.items()), F.lit("contains"))


def node_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("run_id", "node_type").agg(F.count("*").alias("n"))


def scope(records_: DataFrame, links: DataFrame) -> DataFrame:
    """(scope_id, record_id): what belongs to a record: its children, and what it is linked to."""
    return records_.select(F.col("parent_id").alias("scope_id"), "record_id").where("scope_id is not null").union(links.select("scope_id", "record_id")).distinct()


def presence(text: Column, words: dict[str, str]) -> dict[str, Column]:
    """For each check whether its pattern occurs in a text."""
    return {name: F.coalesce(F.lower(text).rlike(pattern), F.lit(False)) for name, pattern in words.items()}
