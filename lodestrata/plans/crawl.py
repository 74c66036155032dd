"""A crawl as a fixpoint over frontiers: only what is new in a round is fetched and analyzed, and budgets cut it off."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from time import monotonic

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import det_id
from ..functions.urls import fetch_policy, normalize
from ..sources.fetch import Policy
from ..sources.store import stored


@dataclass
class CrawlConfig:
    """Budgets of a crawl (fixed defaults). They are part of the request: a crawl ends where they do."""

    max_depth: int = 2
    max_fetches: int = 50
    max_body_bytes: int = 8_388_608
    max_total_bytes: int = 67_108_864
    max_redirects: int = 10
    fetch_timeout_ms: int = 10_000
    total_timeout_ms: int = 120_000
    schemes: tuple[str, ...] = ("http", "https")
    #: How many candidates of a run a round takes: the best, whatever their depth. None: a round takes all of the least depth.
    width: int | None = None

    def __post_init__(self) -> None:
        for name in ("max_fetches", "max_body_bytes", "max_total_bytes", "fetch_timeout_ms", "total_timeout_ms"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.width is not None and self.width <= 0:
            raise ValueError("width must be positive")
        if self.max_depth < 0 or not self.schemes:
            raise ValueError("a depth of zero or more and a scheme are needed")

    def policy(self, **more) -> Policy:
        """The limits of a single fetch, for sources.fetch.fetching()."""
        return Policy(schemes=self.schemes, max_redirects=self.max_redirects, max_body_bytes=self.max_body_bytes, timeout_ms=self.fetch_timeout_ms, **more)


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, level): the least number of edges (source, target) from a seed (node), up to max_depth."""
    frontier = stored(seeds.select("node").distinct().withColumn("level", F.lit(0)), "frontier")
    seen = frontier
    for depth in range(1, max_depth + 1):
        following = edges.join(frontier, edges.source == frontier.node).select(F.col("target").alias("node")).distinct()
        frontier = stored(following.join(seen, "node", "left_anti").withColumn("level", F.lit(depth)), "frontier")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], analyze: Callable[[DataFrame], DataFrame], config: CrawlConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(fetched, rejected) of a crawl from seeds (run_id, url).

    fetch takes (run_id, url, depth, discovered_from) and returns them with
    status, media_type, body (null where the fetch failed); analyze takes what a
    round has fetched and returns candidates (run_id, url, priority,
    discovered_from: the URL or the artifact id that named them). A URL of a run is fetched once.

    A round takes a run's candidates by (priority, url) while its budget of fetches lasts: all of the least depth, or,
    with config.width, that many of all that are open, so that a good candidate found late goes before a poor one found early.
    Bytes are counted in that order after each round: what goes beyond
    max_total_bytes is rejected, is not analyzed, and ends its run. No round
    begins after total_timeout_ms. What fetch itself rejects keeps its
    reason_code, if it returns one.

    Every candidate is in one of the results, once: what is left at the end is rejected by limit.max_depth (found too deep only),
    limit.total_bytes (its run ended so), limit.total_timeout or limit.max_fetches. A crawl of which nothing could be fetched is an error.
    """
    config = config or CrawlConfig()
    until = monotonic() + config.total_timeout_ms / 1000
    candidate = ["run_id", "url", "priority", "depth", "discovered_from"]
    best = ["priority", "url"] if config.width else ["depth", "priority", "url"]
    open_ = stored(seeds.select("run_id", "url", F.lit(0).alias("priority"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("discovered_from")).groupBy("run_id", "url").agg(*(F.min(c).alias(c) for c in candidate[2:])), "frontier")
    fetched = rejected = known = ended = None
    late = False

    def reject(rows: DataFrame) -> None:
        nonlocal rejected
        own = rows.select("run_id", "url", "reason_code", "discovered_from")
        rejected = own if rejected is None else rejected.unionByName(own)

    def beside(rows: DataFrame | None, more: DataFrame) -> DataFrame:
        return more if rows is None else rows.unionByName(more)

    while True:
        judged = open_.withColumn("reason_code", fetch_policy(F.col("url"), config.schemes))
        refused = stored(judged.where("reason_code is not null"), "refused")
        reject(refused)
        known = beside(known, refused.select("run_id", "url"))
        open_ = judged.where("reason_code is null").drop("reason_code")
        if ended is not None:
            going = open_.join(ended, "run_id", "left_anti")
        else:
            going = open_
        if monotonic() > until and fetched is not None:
            late = True
            break
        spent = known.groupBy("run_id").agg(F.lit(0).alias("_spent")).limit(0) if fetched is None else asked.groupBy("run_id").agg(F.count("*").alias("_spent"))
        fit = going.where(F.col("depth") <= config.max_depth)
        if not config.width:
            least = fit.groupBy("run_id").agg(F.min("depth").alias("_least"))
            fit = fit.join(least, "run_id").where("depth = _least").drop("_least")
        most = min(config.max_fetches, config.width or config.max_fetches)
        # a rank below a fixed number keeps that many rows of a run before its shuffle
        ranked = fit.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(*best))).where(F.col("place") <= most)
        due = stored(ranked.join(spent, "run_id", "left").where(F.col("place") <= F.lit(config.max_fetches) - F.coalesce("_spent", F.lit(0))).drop("_spent"), "due")
        if due.isEmpty():
            break
        own = due.select("run_id", "url")
        known = known.unionByName(own)
        asked = own if fetched is None else asked.unionByName(own)
        got = fetch(due.select("run_id", "url", "depth", "discovered_from"))
        given = F.col("reason_code") if "reason_code" in got.columns else F.lit(None).cast("string")
        got = stored(got.withColumn("reason_code", given), "fetched")
        large = F.length("body") > config.max_body_bytes
        failed = F.col("body").isNull() | ~F.col("status").between(200, 299)
        code = F.coalesce("reason_code", F.when(F.col("status").isin(401, 403), "auth.required").when(failed, "fetch.failed").when(large, "limit.body_too_large"))
        coded = got.withColumn("reason_code", code)
        # at most max_fetches rows a run, so a window over a run is small
        size = F.when(F.col("reason_code").isNull(), F.length("body")).otherwise(0)
        placed = coded.join(due.select("run_id", "url", "place"), ["run_id", "url"])
        if fetched is not None:
            placed = placed.join(fetched.groupBy("run_id").agg(F.sum(F.length("body")).alias("_before")), "run_id", "left")
        else:
            placed = placed.withColumn("_before", F.lit(0))
        running = F.sum(size).over(Window.partitionBy("run_id").orderBy("place")) + F.coalesce("_before", F.lit(0))
        coded = stored(placed.withColumn("reason_code", F.when(F.col("reason_code").isNull() & (running > config.max_total_bytes), "limit.total_bytes").otherwise(F.col("reason_code"))).drop("place", "_before"), "judged")
        reject(coded.where("reason_code is not null"))
        ended = beside(ended, coded.where("reason_code = 'limit.total_bytes'").select("run_id").distinct())
        good = coded.where("reason_code is null").drop("reason_code")
        fetched = beside(fetched, good)
        names = F.explode(F.array(F.col("url"), det_id("artifact", normalize(F.col("url")))))
        above = good.select("run_id", (F.col("depth") + 1).alias("depth"), names.alias("discovered_from"))
        found = analyze(good).select("run_id", "url", "priority", "discovered_from").join(above.distinct(), ["run_id", "discovered_from"])
        every = open_.unionByName(found.select(*candidate)).join(known, ["run_id", "url"], "left_anti")
        first = every.groupBy("run_id", "url").agg(F.min("depth").alias("depth"), F.min(F.struct("priority", "discovered_from")).alias("_c"))
        open_ = stored(first.select("run_id", "url", "_c.priority", "depth", "_c.discovered_from"), "frontier")
    if fetched is None:
        raise ValueError("nothing could be fetched")
    over = F.lit("limit.total_timeout" if late else "limit.max_fetches")
    left = open_.withColumn("reason_code", F.when(F.col("depth") > config.max_depth, F.lit("limit.max_depth")).otherwise(over))
    if ended is not None:
        left = left.join(ended.distinct().withColumn("_ended", F.lit(True)), "run_id", "left").withColumn("reason_code", F.when(F.col("_ended"), "limit.total_bytes").otherwise(F.col("reason_code"))).drop("_ended")
    reject(stored(left, "left"))
    return fetched, rejected


def fetch_summary(fetched: DataFrame, rejected: DataFrame) -> DataFrame:
    """Counts and sums of each run."""
    f = fetched.groupBy("run_id").agg(F.count("*").alias("fetched_count"), F.sum(F.coalesce(F.size("redirect_chain"), F.lit(0))).alias("redirect_count"), F.sum(F.coalesce(F.octet_length("body"), F.lit(0))).alias("total_bytes"))
    r = rejected.groupBy("run_id").agg(F.count("*").alias("rejected_count"))
    return f.join(r, "run_id", "full").select("run_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fetched_count", "rejected_count", "redirect_count", "total_bytes")))
