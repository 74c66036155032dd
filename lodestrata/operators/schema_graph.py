"""The graph of JSON Schema references: which definitions a schema reaches through $ref, across documents and through cycles.

A place is a URL with the pointer of a definition behind #, or nothing for the whole
schema. Each $ref is an edge from the definition that holds it to the place that it names.
The closure grows from all places at once: in a round, what was reached last is
joined with the edges, and what was known is taken away, so a cycle ends by itself
and the number of rounds is the longest of the shortest ways.

Places are numbered in the order of their texts, and what a source reaches is kept
as arrays of numbers: a row for each source and each SPAN numbers, with a list for
each round. So a round deals out a row and not its pairs, and no row outgrows SPAN.

Where no steps are asked for, a source takes over what its targets reach, once for
each edge, after all of its targets. Only what lies on cycles or between them, or
more than LEVELS edges from both a beginning and an end, needs rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.urls import resolve
from ..sources.store import delete, discard, exists, scratch, stored

DEFINITIONS = ("$defs", "definitions")
#: Bits of a place's number within its row of reached places: at most 8 MB of numbers a row.
SPAN = 20
#: Rounds in which sources without others before or behind them are set aside.
LEVELS = 100
#: Numbers of one source that are put together in one row; where its targets reach more in all, they are made distinct as pairs.
JOINED = 1 << 20


def references(walked: DataFrame) -> DataFrame:
    """(source, target, pointer) of each $ref of walked schemas, whose key is their URL. References that resolve to no URL have no row."""
    texts = walked.where((F.col("name") == "$ref") & (F.col("kind") == "STRING")).select("key", "pointer", F.try_variant_get("value", "$", "string").alias("ref"))
    holder = F.regexp_extract("pointer", f"^(/(?:{'|'.join(d.replace('$', '[$]') for d in DEFINITIONS)})/[^/]+)/", 1)
    base, fragment = F.substring_index("ref", "#", 1), F.when(F.contains("ref", F.lit("#")), F.substring_index("ref", "#", -1)).otherwise(F.lit(""))
    url = F.when(base == "", F.col("key")).otherwise(resolve(F.col("key"), base))
    place = lambda u, p: F.when(p == "", u).otherwise(F.concat(u, F.lit("#"), p))
    return texts.select(place(F.col("key"), holder).alias("source"), place(url, fragment).alias("target"), "pointer").where("target is not null")


def contained(walked: DataFrame) -> DataFrame:
    """(source, target) from each schema to the definitions in it that it can use: a schema reaches what its own definitions refer to only by referring to them."""
    at = F.regexp_extract("pointer", f"^(/(?:{'|'.join(d.replace('$', '[$]') for d in DEFINITIONS)})/[^/]+)$", 1)
    return walked.select(F.col("key").alias("source"), at.alias("_at")).where("_at <> ''").select("source", F.concat("source", F.lit("#"), "_at").alias("target"))


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(via, target) of the edges in numbers, and (place, id) of all places, from 0 on without a gap in the order of their texts."""
    edges = stored(edges.select("source", "target").distinct(), "edges")
    every = edges.select(F.col("source").alias("place")).unionByName(edges.select(F.col("target").alias("place"))).distinct()
    dealt = stored(every.sort("place").withColumn("id", F.monotonically_increasing_id()), "places")
    part, starts, before = F.shiftright("id", 33), [], 0
    for row in dealt.groupBy(part.alias("part")).count().sort("part").collect():  # a row for each partition
        starts += [before] * (row["part"] + 1 - len(starts))
        before += row["count"]
    start = F.get(F.array(*map(F.lit, starts)).cast("array<long>"), part.cast("int")) if starts else F.lit(0)
    places = dealt.select("place", (F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + start).alias("id"))
    of = lambda end: places.select(F.col("place").alias(end), F.col("id").alias(f"_{end}"))
    return stored(edges.join(of("source"), "source").join(of("target"), "target").select(F.col("_source").alias("via"), F.col("_target").alias("target")), "links"), places


def _listed(pairs: DataFrame) -> DataFrame:
    return pairs.distinct().groupBy("source", F.shiftright("target", SPAN).alias("part")).agg(F.collect_list("target").alias("fresh"))


def _rounds(start: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """(source, rounds) of what is reached from the links in start."""
    known = stored(_listed(start.withColumnRenamed("via", "source")).select("source", "part", F.array("fresh").alias("rounds")), "reached")
    for step in range(2, rounds + 2):
        last = known.where(F.size("rounds") == step - 1).select("source", F.explode(F.element_at("rounds", -1)).alias("via"))
        onward = _listed(last.join(links, "via").select("source", "target"))
        both = known.join(onward, ["source", "part"], "full")
        fresh = F.array_except("fresh", F.coalesce(F.flatten("rounds"), F.array().cast("array<long>")))
        # a row that gets nothing stays as it is; one that does has a list, empty or not, for each round
        none = F.array_repeat(F.array().cast("array<long>"), F.lit(step - 1) - F.coalesce(F.size("rounds"), F.lit(0)))
        grown = F.concat(F.coalesce("rounds", F.array().cast("array<array<long>>")), none, F.array("_fresh"))
        after = both.withColumn("_fresh", fresh).select("source", "part", F.when(F.size("_fresh") > 0, grown).otherwise(F.col("rounds")).alias("rounds"))
        before, known = known, stored(after, "reached")
        discard(before)
        if known.where(F.size("rounds") == step).isEmpty():
            return known.select("source", "rounds")
    raise RuntimeError(f"references go on after {rounds} rounds")


def numbered_closure(edges: DataFrame, rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(source, rounds: array<array<long>>) of what each source reaches, first in which round, several rows a source; and (place, id) of all places. Numbers have the order of the places' texts. Raises RuntimeError where rounds do not reach all."""
    links, places = _numbered(edges)
    return _rounds(links, links, rounds), places


def _peeled(links: DataFrame, end: str, most: int) -> tuple[DataFrame, int, DataFrame]:
    """(via, round) of the sources that go in a round, the number of rounds, and the links of those that are left. end target: those whose targets have all gone or are ends; end via: those that no source left refers to."""
    other, open_, seen, n = {"via": "target", "target": "via"}[end], links, [], links.count()
    while n and len(seen) < most:
        seen.append(open_.select("via", F.lit(len(seen) + 1).alias("round")))
        open_ = stored(open_.join(open_.select(F.col(other).alias(end)).distinct(), end, "left_semi").select("via", "target"), "open")
        after = open_.count()
        if after == n:
            break
        n = after
    left = open_.select("via").distinct()
    none = links.limit(0).select("via", F.lit(0).alias("round"))
    gone = reduce(DataFrame.unionByName, seen, none).groupBy("via").agg(F.max("round").alias("round")).join(left, "via", "left_anti")
    return gone, len(seen), links.join(left, "via", "left_semi")


def _taken_over(links: DataFrame, number: str, rounds: int) -> list[DataFrame]:
    """(source, n, lo, hi), several rows a source: how many numbers of what a source reaches lie in a row, the least and the greatest."""
    spark, most = links.sparkSession, min(rounds, LEVELS)
    first, n_first, left = _peeled(links, "via", most)
    last, n_last, left = _peeled(stored(left, "left"), "target", most)
    left = stored(left, "left")
    # ends are 0; a source comes after its targets, but for those on cycles and between them, which are done together
    middle, top = n_last + 1, n_first + n_last + 1
    turns = (last.select("via", F.col("round").alias("need")), left.select("via", F.lit(middle).alias("need")).distinct(), first.select("via", (top + 1 - F.col("round")).alias("need")))
    turn = stored(reduce(DataFrame.unionByName, turns), "turns")
    most_links = links.groupBy("via").count().agg(F.max("count")).first()[0] or 0
    own = links.join(turn, "via").join(turn.select(F.col("via").alias("target"), F.col("need").alias("at")), "target", "left").withColumn("at", F.coalesce("at", F.lit(0)))
    num = lambda c: F.col(c).cast(number).alias(c)
    steps, base = scratch(spark, "steps"), scratch(spark, "taken")
    own.where(F.col("need") != middle).select(num("via"), num("target"), "need", "at").write.partitionBy("at").parquet(steps)
    there = lambda path, schema: spark.read.schema(schema).parquet(path) if exists(spark, path) else None
    into = lambda at: there(f"{steps}/at={at}", f"via {number}, target {number}, need int")
    hand = lambda rows: rows.select("via", "need", F.size("reached").alias("n"), "reached").write.partitionBy("need").mode("append").option("compression", "zstd").parquet(base)
    if onward := into(0):
        hand(onward.select("via", "need", F.array("target").alias("reached")))
    found, largest = [], 0
    for k in range(1, top + 1):
        if k == middle:
            if left.isEmpty():
                continue
            rows, largest = _rounds(left, links, rounds).select(num("source"), F.flatten("rounds").cast(f"array<{number}>").alias("reached")), JOINED
        else:
            got = there(f"{base}/need={k}", f"via {number}, n int, reached array<{number}>")
            if got is None:  # a round in which only links to ends went
                continue
            few = got = got.withColumnRenamed("via", "source")
            # a source cannot get more than its links times the largest row, so most need no count of their own
            many = got.groupBy("source").agg(F.sum("n").alias("n")).where(F.col("n") > JOINED).select("source")
            split = most_links * (largest + 1) > JOINED and not many.isEmpty()
            if split:
                few, largest = got.join(many, "source", "left_anti"), JOINED
            rows = few.groupBy("source").agg(F.collect_list("reached").alias("lists")).select("source", F.array_distinct(F.flatten("lists")).alias("reached"))
            if split:
                pairs = got.join(many, "source", "left_semi").select("source", F.explode("reached").alias("target"))
                rows = rows.unionByName(_listed(pairs).select("source", F.col("fresh").alias("reached")))
        seen = Observation()
        sized = rows.select("source", F.size("reached").alias("n"), F.array_min("reached").alias("lo"), F.array_max("reached").alias("hi"), "reached")
        done = stored(sized.observe(seen, F.max("n").alias("n")), "done")
        largest = max(largest, seen.get["n"] or 0)
        found.append(done.select("source", "n", "lo", "hi"))
        delete(spark, f"{base}/need={k}")
        if onward := into(k):
            # sizes of files say little of the lists in them, so none of them is broadcast
            hand(onward.join(done.select(F.col("source").alias("target"), "reached").hint("merge"), "target").select("via", "need", F.array_append("reached", F.col("target")).alias("reached")))
    return found


def closure(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(source, target, steps): each place that a source reaches, itself if it lies on a cycle, with the least number of edges. Raises RuntimeError where rounds do not reach all."""
    found, places = numbered_closure(edges, rounds)
    pairs = found.select("source", F.posexplode("rounds").alias("step", "reached")).select("source", (F.col("step") + 1).alias("steps"), F.explode("reached").alias("target"))
    for end in ("source", "target"):
        pairs = pairs.join(places.select(F.col("id").alias(end), F.col("place").alias(f"_{end}")), end)
    return pairs.select(F.col("_source").alias("source"), F.col("_target").alias("target"), "steps")


def reach(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(source, reached, first_place, last_place): of each source the number of places that it reaches, and the first and the last by their texts. No pair is made but for sources on cycles or between them, and where one reaches very many. Raises RuntimeError where rounds do not reach all."""
    links, places = _numbered(edges)
    found = _taken_over(links, "int" if places.count() < 1 << 31 else "bigint", rounds)
    found.append(links.limit(0).select(F.col("via").alias("source"), F.lit(0).alias("n"), F.col("target").alias("lo"), F.col("target").alias("hi")))  # where there are no sources
    by = reduce(DataFrame.unionByName, found).groupBy(F.col("source").cast("long").alias("source")).agg(F.sum("n").alias("reached"), F.min("lo").cast("long").alias("_first"), F.max("hi").cast("long").alias("_last"))
    for end, name in (("source", "_place"), ("_first", "first_place"), ("_last", "last_place")):
        by = by.join(places.select(F.col("id").alias(end), F.col("place").alias(name)), end)
    return by.select(F.col("_place").alias("source"), "reached", "first_place", "last_place")


def property_paths(walked: DataFrame, reached: DataFrame) -> DataFrame:
    """(source, place, property) of the properties that a schema has by itself or through references; a place is where they are declared."""
    name = F.regexp_extract("pointer", r"^((?:/(?:[$]defs|definitions)/[^/]+)?)/properties/([^/]+)$", 2)
    holder = F.regexp_extract("pointer", r"^((?:/(?:[$]defs|definitions)/[^/]+)?)/properties/([^/]+)$", 1)
    own = walked.select("key", holder.alias("_h"), name.alias("property")).where("property <> ''")
    own = own.select(F.when(F.col("_h") == "", F.col("key")).otherwise(F.concat("key", F.lit("#"), "_h")).alias("place"), "property")
    through = reached.select("source", F.col("target").alias("place")).join(own, "place")
    return own.select(F.col("place").alias("source"), "place", "property").unionByName(through.select("source", "place", "property")).distinct()
