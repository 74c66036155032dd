"""Scalar functions on labels, fields and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import REVIEW_WORDS, SENSITIVE_WORDS


def canonical_label(c: Column) -> Column:
    """White space collapsed and trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def canonical_access_label(c: Column) -> Column:
    """canonical_label without one trailing word for a kind of access."""
    return F.regexp_replace(canonical_label(c), " (api|service|distribution|endpoint)$", "")


def canonical_field(c: Column) -> Column:
    return F.trim(c)


def loose_field(c: Column) -> Column:
    """The workbench's rule: last segment, letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(c, "([^/:#]*)[/:#]*$", 1), "[^A-Za-z0-9]", ""))


def label_from_iri(c: Column) -> Column:
    """A label from the last segment: no `Shape` at the end, words apart."""
    last = F.regexp_replace(F.regexp_extract(c, "([^/#:]*)[/#:]*$", 1), "Shape$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(last, "[_-]+", " "), "([a-z0-9])([A-Z])", "$1 $2"))


def first_text(*columns: Column) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def kind_label(c: Column) -> Column:
    """An enumeration value as words; API stays in capitals."""
    return F.regexp_replace(F.initcap(F.replace(c, F.lit("_"), F.lit(" "))), r"\bApi\b", "API")


def is_sensitive(c: Column, words: tuple[str, ...] = SENSITIVE_WORDS) -> Column:
    return canonical_label(c).rlike("|".join(words))


def needs_review(c: Column) -> Column:
    """Whether a need's id, label and terms are of sensitive matters, by the workbench's words."""
    return F.lower(c).rlike("|".join(REVIEW_WORDS))


def short_id(c: Column) -> Column:
    """The last two segments of an id."""
    parts = F.filter(F.split(c, "[/#:]"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def schemes(c: Column) -> Column:
    """Trimmed, lower case, distinct in their order, without empty ones."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def known_or_unknown(c: Column, known: tuple[str, ...]) -> Column:
    return F.when(c.isin(*known), c).otherwise("unknown")
