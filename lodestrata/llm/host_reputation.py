"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Outcomes of labelled pages (bad or not) are counted by host, with map-side
combination, so a host that holds a third of all pages costs one row per task.
Each host's share of bad pages is shrunk through beta-binomial priors: a
suffix's prior is the share of all pages, a domain's prior is its suffix's
posterior mean, a host's prior its domain's. How strong the prior of a level is
follows from the data, by the method of moments: the more the units of a level
differ, the weaker. A page is blocked where the lower CONFIDENCE bound of its host's
beta posterior is above LIMIT, that is, where the posterior gives a share of bad
pages of LIMIT or less at most 1 - CONFIDENCE, unless an explicit rule decides.

Counts by host are a stored table, from which the levels are read: pages are
parsed twice, for the counts and for the result.

Results in edge cases: a null url or one without `://` has an empty host and
path and no rule; the empty host has a reputation like any other; hosts without
outcomes get their domain's or suffix's prior; null outcomes do not count;
repeated pages count and are judged each time; without any outcome all that no
rule blocks is allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Explicit rules: host, path and verdict. The longest that fits wins.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Suffixes of two labels under which domains are registered (fixed values); any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: A page is blocked where the posterior says with this confidence that the share of bad pages is above the limit.
LIMIT, CONFIDENCE = 0.5, 0.95
#: Bounds of a prior's strength, in pages, and the prior of the share of all pages.
WEAKEST, STRONGEST, PRIOR_BAD, PRIOR_GOOD = 1.0, 10_000.0, 1.0, 9.0


def with_parts(pages: DataFrame, url: str = "url", suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """pages with host, path, domain and suffix. suffixes: those of two labels. The names must be free; judge() sees to that."""
    rest = F.expr("CASE WHEN instr(_url, '://') > 0 THEN substring(_url, instr(_url, '://') + 3) END")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    bare = F.regexp_replace(F.col("host"), "^.*@|:[0-9]*$", "")
    two = "|".join(s.replace(".", "\\.") for s in (*suffixes, "[^.]*"))
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    return (
        pages.withColumn("_url", F.col(url).cast("string"))
        .withColumns({"host": host, "path": path})
        .drop("_url")
        .withColumns(
            {
                "domain": F.when(address, bare).otherwise(F.regexp_extract(bare, rf"(?:[^.]+\.)?(?:{two})$", 0)),
                "suffix": F.when(address, F.lit("address")).otherwise(F.regexp_extract(bare, rf"(?:^|\.)({two})$", 1)),
            }
        )
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for h, p, _ in ordered]
    first = lambda k: F.coalesce(*(F.when(fit, F.lit((r[0] + r[1], r[2])[k])) for fit, r in zip(fits, ordered, strict=True)))
    return first(0), first(1)


def strength(units: DataFrame, prior: Column) -> float:
    """How many pages a level's prior counts for. units: n, bad; prior: the mean that a unit's prior has.

    Pearson's statistic of a beta-binomial is (1 + (n - 1) rho) on average, and
    the strength is 1 / rho - 1.
    """
    spread = prior * (1 - prior)
    row = units.where("n > 0").agg(F.sum((F.col("bad") - F.col("n") * prior) ** 2 / (F.col("n") * spread)).alias("x"), F.count("*").alias("u"), F.sum(F.col("n") - 1).alias("m")).first()
    rho = (row.x - row.u) / row.m if row.m else 0.0
    return min(max(1 / rho - 1, WEAKEST), STRONGEST) if rho > 0 else STRONGEST


#: Points of the integral below, and the distance between two.
POINTS, STEP = 221, 0.05


def _mass(a: Column, b: Column, edge: float, sign: int) -> Column:
    """The mass of beta(a, b) on one side of a share, up to a factor that depends on a and b alone.

    In u = log(t / (1 - t)) the density is t**a (1 - t)**b, which falls off
    exponentially on both sides. From the edge on, u runs by double-exponential
    steps, so the rule of trapezes is exact for practical purposes.
    """
    mode, wide = F.log(a / b), F.sqrt(1 / a + 1 / b)
    log_t = lambda u: -F.log1p(F.exp(-F.abs(u))) + F.least(u, F.lit(0.0))
    peak = a * log_t(mode) + b * log_t(-mode)

    def add(total: Column, k: Column) -> Column:
        s = (k - POINTS // 2) * F.lit(STEP)
        v = wide * F.exp(s - F.exp(-s))
        u = F.lit(edge) + sign * v
        return total + F.exp(a * log_t(u) + b * log_t(-u) - peak) * v * (1 + F.exp(-s))

    return F.aggregate(F.sequence(F.lit(0), F.lit(POINTS - 1)), F.lit(0.0), add)


def below(rate: Column, total: Column, limit: float) -> Column:
    """The probability that a beta posterior with this mean and so many pages gives a share of at most limit. Where mean and limit are thirty deviations apart, it is 0 or 1."""
    a, b, edge = rate * total, (1 - rate) * total, math.log(limit / (1 - limit))
    low, high = _mass(a, b, edge, -1), _mass(a, b, edge, 1)
    apart = (rate - limit) / F.sqrt(rate * (1 - rate) / (total + 1))
    return F.when(apart > 30, 0.0).when(apart < -30, 1.0).otherwise(low / (low + high))


def reputations(outcomes: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(host, rate, below) for each host of outcomes: rows with host, domain, suffix and bad (true, false or null for a page without a label). below: the posterior probability that the host's share of bad pages is at most limit."""
    count = [F.sum(F.when(F.col("bad").isNotNull(), 1).otherwise(0)).alias("n"), F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("bad")]
    add = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    hosts = stored(outcomes.groupBy("host", "domain", "suffix").agg(*count), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(*add), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(*add), "suffixes")
    whole = suffixes.agg(*add).first()
    mean = ((whole.bad or 0) + PRIOR_BAD) / ((whole.n or 0) + PRIOR_BAD + PRIOR_GOOD)

    posterior = lambda prior, s: (F.col("bad") + s * prior) / (F.col("n") + s)
    s1 = strength(suffixes, F.lit(mean))
    suffixes = suffixes.select("suffix", posterior(F.lit(mean), s1).alias("prior"))
    domains = stored(domains.join(suffixes, "suffix"), "domain-priors")
    s2 = strength(domains, F.col("prior"))
    domains = domains.select("domain", "suffix", posterior(F.col("prior"), s2).alias("prior"))
    hosts = stored(hosts.join(domains, ["domain", "suffix"]), "host-priors")
    s3 = strength(hosts, F.col("prior"))
    known = hosts.select("host", posterior(F.col("prior"), s3).alias("rate"), (F.col("n") + F.lit(s3)).alias("total"))
    return known.select("host", "rate", below(F.col("rate"), F.col("total"), limit).alias("below"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT, confidence: float = CONFIDENCE, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, rate and below for each row of pages (page_id, url). labels: (page_id, bad); of repeated ids the worst counts."""
    parts = with_parts(pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url")), "url", suffixes)
    known = labels.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    found = reputations(parts.join(known, "page_id", "left").select("host", "domain", "suffix", "bad"), limit)
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    return parts.join(found, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("below") < 1 - confidence, "block").otherwise("allow")).alias("verdict"), "rate", "below")
