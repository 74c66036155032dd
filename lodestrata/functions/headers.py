"""Header arrays: array<struct<name, value>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import KEPT_HEADERS, SENSITIVE_HEADERS


def redact(headers: Column) -> Column:
    """Sensitive values replaced; names stay."""
    return F.transform(headers, lambda h: F.struct(h["name"].alias("name"), F.when(F.lower(h["name"]).isin(*SENSITIVE_HEADERS), "[redacted]").otherwise(h["value"]).alias("value")))


def sanitize(headers: Column) -> Column:
    """Only the headers that discovery needs, with lower-case names."""
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]).isin(*KEPT_HEADERS)), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))


def strip_sensitive(headers: Column) -> Column:
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin(*SENSITIVE_HEADERS))


def value(headers: Column, name: str) -> Column:
    """The first value of a header, null where it is absent."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"]
