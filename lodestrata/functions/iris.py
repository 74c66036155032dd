"""Compact and expanded IRIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import CAPABILITY_PREFIXES, CV_NAMES, PREFIXES


def prefix_map(prefixes: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))


def expand(c: Column, prefixes: Column | dict[str, str] = PREFIXES) -> Column:
    """The full IRI of `p:x`; null for what is none, such as a full IRI or an unknown prefix."""
    known = prefix_map(prefixes) if isinstance(prefixes, dict) else prefixes
    parts = F.instr(c, ":")
    base = F.try_element_at(known, F.substring_index(c, ":", 1))
    return F.when((parts > 0) & ~c.startswith("http://") & ~c.startswith("https://"), F.concat(base, F.regexp_extract(c, "^[^:]*:([\\s\\S]*)$", 1)))


def expanded(c: Column, prefixes: Column | dict[str, str] = PREFIXES) -> Column:
    return F.coalesce(expand(c, prefixes), c)


def matches(predicate: Column, wanted: str, prefixes: dict[str, str] = PREFIXES) -> Column:
    """Whether a predicate is the wanted compact one: as it is, expanded, or by its local name behind `#` or `/`."""
    prefix, _, local = wanted.partition(":")
    local = local.partition(":")[0]
    out = predicate == wanted
    if local:
        out = out | predicate.endswith(f"#{local}") | predicate.endswith(f"/{local}")
        if prefix in prefixes:
            out = out | (predicate == prefixes[prefix] + local)
    return out


def compact(c: Column) -> Column:
    """The canonical compact form of a full IRI in a known namespace, dcterms for dct; all else as it is."""
    out = c
    seen: dict[str, str] = {}
    for prefix in sorted(PREFIXES, key=lambda p: (p == "dct", p)):
        seen.setdefault(PREFIXES[prefix], prefix)
    case = None
    for namespace, prefix in seen.items():
        if namespace == PREFIXES["cv"]:
            continue
        name = F.concat(F.lit(f"{prefix}:"), F.substring(c, len(namespace) + 1, 1_000_000))
        case = F.when(c.startswith(namespace), name) if case is None else case.when(c.startswith(namespace), name)
    shared = PREFIXES["cv"]
    local = F.substring(c, len(shared) + 1, 1_000_000)
    case = case.when(c.startswith(shared), F.concat(F.when(local.isin(*CV_NAMES), "cv:").otherwise("cccev:"), local))
    case = case.when(c.startswith("dct:"), F.concat(F.lit("dcterms:"), F.substring(c, 5, 1_000_000)))
    return case.otherwise(out)


def canonical(c: Column, prefixes: dict[str, str] | None = None) -> Column:
    """For matching: `p:x` expanded unless it holds `://`; query prefixes come before the defaults."""
    known = CAPABILITY_PREFIXES | (prefixes or {})
    trimmed = F.trim(c)
    return F.when(F.contains(trimmed, F.lit("://")), trimmed).otherwise(F.coalesce(F.concat(F.try_element_at(prefix_map(known), F.substring_index(trimmed, ":", 1)), F.regexp_extract(trimmed, "^[^:]*:([\\s\\S]*)$", 1)), trimmed))
