"""URLs: parts, normal form, reference resolution, secrets, redaction, keys and fetch policy. All but address classes are native."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .vocabulary import DOCUMENT_SUFFIXES, FACADE_SECRET_NAMES, FETCHABLE_PREDICATES, FETCHABLE_RELS, PREDICATE_ROLES, SECRET_NAMES, WORKBENCH_SECRET_NAMES, WORKBENCH_SECRET_WORDS


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(c: Column) -> Column:
    return F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def userinfo(c: Column) -> Column:
    return F.regexp_extract(authority(c), "^(.*)@", 1)


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(authority(c), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def port(c: Column) -> Column:
    """The port, by scheme where it is not given."""
    given = F.nullif(F.regexp_extract(authority(c), r":([0-9]+)$", 1), F.lit(""))
    return F.coalesce(given, F.when(scheme(c) == "https", "443").when(scheme(c) == "http", "80").otherwise(""))


def path(c: Column) -> Column:
    return F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)


def query(c: Column) -> Column:
    """The query string, null where there is none."""
    return F.when(c.rlike(r"^[^#?]*\?"), F.regexp_extract(c, r"^[^#?]*\?([^#]*)", 1))


def normalize(c: Column) -> Column:
    """Without fragment; scheme and host in lower case, no default port, a path of `/` at least. Paths and queries stay as they are."""
    bare = F.regexp_replace(c, "#[\\s\\S]*$", "")
    named = F.regexp_extract(authority(bare), "^(.*@)", 1)
    own_port = F.regexp_extract(authority(bare), r":([0-9]+)$", 1)
    default = ((scheme(bare) == "http") & (own_port == "80")) | ((scheme(bare) == "https") & (own_port == "443"))
    shown = F.when((own_port == "") | default, "").otherwise(F.concat(F.lit(":"), own_port))
    rest = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([\\s\\S]*)$", 1)
    full = F.concat(scheme(bare), F.lit("://"), named, host(bare), shown, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), full).otherwise(bare)


def _without_dots(path_: Column) -> Column:
    """A path that begins with a slash, without `.` and `..` segments; what would lead above the root stays there."""
    parts = F.slice(F.split(path_, "/"), 2, 1 << 30)
    last = F.element_at(parts, -1).isin(".", "..")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(F.when(last, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def resolve(base: Column, raw: Column) -> Column:
    """The reference resolved against the base (RFC 3986); null for an empty reference or without a base. Against a base without authority a relative reference stays as it is."""
    r = F.trim(raw)
    bare = F.regexp_replace(base, "#[\\s\\S]*$", "")
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    own, tail = F.regexp_extract(r, "^([^?#]*)", 1), F.regexp_extract(r, r"^[^?#]*([\s\S]*)$", 1)
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    return (
        F.when(base.isNull() | raw.isNull() | (r == ""), None)
        .when(r.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), r)
        .when(r.startswith("//"), F.concat(scheme(base), F.lit(":"), r))
        .when(origin == "", r)
        .when(r.startswith("?"), F.concat(F.regexp_replace(bare, r"\?[\s\S]*$", ""), r))
        .when(r.startswith("#"), F.concat(bare, r))
        .otherwise(F.concat(origin, _without_dots(merged), tail))
    )


def is_secret_name(c: Column, policy: str = "core") -> Column:
    """core: the name holds one of the words; facade: it is one of them; workbench: it is one of the workbench's names, holds one of its words or ends with `key`; proxy: one of the words stands in it between underscores or hyphens."""
    low = F.lower(c)
    if policy == "core":
        return low.rlike("|".join(SECRET_NAMES))
    if policy == "facade":
        return low.isin(*FACADE_SECRET_NAMES)
    if policy == "workbench":
        return low.isin(*WORKBENCH_SECRET_NAMES) | low.rlike("|".join(WORKBENCH_SECRET_WORDS)) | low.endswith("key")
    if policy == "proxy":
        return low.rlike(f"(^|[_-])({'|'.join(SECRET_NAMES)}|api-key)([_-]|$)")
    raise ValueError(f"unknown policy {policy}")


def has_secret(c: Column) -> Column:
    """User information or a secret's name in the query."""
    pairs = F.split(F.coalesce(query(c), F.lit("")), "&")
    return (userinfo(c) != "") | F.exists(pairs, lambda p: is_secret_name(F.substring_index(p, "=", 1)))


def redact(c: Column, policy: str = "core") -> Column:
    """Without user information, and with the values of secret names replaced. The proxy's policy keeps the place of user information, and replaces what is no URL at all."""
    pairs = F.transform(F.split(query(c), "&"), lambda p: F.when(is_secret_name(F.substring_index(p, "=", 1), policy), F.concat(F.substring_index(p, "=", 1), F.lit("=REDACTED"))).otherwise(p))
    bare = F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1")
    if policy == "proxy":
        shown = F.regexp_replace(F.regexp_replace(userinfo(c), "^[^:]+", "redacted"), ":.+$", ":redacted")
        bare = F.when(userinfo(c) == "", c).otherwise(F.concat(scheme(c), F.lit("://"), shown, F.lit("@"), F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@([\\s\\S]*)$", 1)))
        bare = F.when(scheme(c) == "", "[invalid-url]").otherwise(bare)
    head = F.regexp_extract(bare, r"^([^#?]*)", 1)
    tail = F.regexp_extract(bare, r"(#[\s\S]*)$", 1)
    return F.when(query(c).isNull() | (bare == "[invalid-url]"), bare).otherwise(F.concat(head, F.lit("?"), F.array_join(pairs, "&"), tail))


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (host(a) == host(b)) & (port(a) == port(b))


@F.pandas_udf(BooleanType())
def is_private_ip(values: pd.Series) -> pd.Series:
    """Addresses that must not be fetched: private, loopback, link-local, multicast, reserved or unspecified ones, mapped ones too. Null for what is no address."""

    def one(text: str | None) -> bool | None:
        try:
            a = ipaddress.ip_address((text or "").strip("[]"))
        except ValueError:
            return None
        a = getattr(a, "ipv4_mapped", None) or a
        shared = a.version == 4 and a in ipaddress.ip_network("100.64.0.0/10")
        return bool(a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified or shared)

    return pd.Series([one(v) for v in values], dtype=object)


def fetch_policy(c: Column, allowed: tuple[str, ...] = ("http", "https")) -> Column:
    """The code of the reason for which a URL may not be fetched, else null."""
    return (
        F.when(c.isNull() | ~c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "policy.invalid_url")
        .when(~scheme(c).isin(*allowed), "policy.unsupported_scheme")
        .when(userinfo(c) != "", "policy.embedded_credentials")
        .when(host(c) == "", "policy.missing_host")
    )


def route_key(c: Column) -> Column:
    """The first two path segments of a URL."""
    return F.nullif(F.regexp_extract(path(c), "^/+([^/]+/[^/]+)", 1), F.lit(""))


def dataset_prefix(c: Column) -> Column:
    """A URL up to and with `/datasets/{name}`; null without."""
    return F.nullif(F.regexp_extract(c, "^(.*?/datasets/[^/?#]+)", 1), F.lit(""))


def protocol_hint(c: Column) -> Column:
    return F.when(scheme(c).isin("http", "https"), "http").when(scheme(c) != "", scheme(c))


def predicate_role(c: Column) -> Column:
    return F.coalesce(*(F.when(c == p, F.lit(r)) for p, r in PREDICATE_ROLES.items()))


def is_fetchable(rel: Column, predicate: Column, role: Column) -> Column:
    """Whether a link leads to metadata that a crawl should read."""
    none = F.lit("")
    return F.coalesce(rel, none).isin(*FETCHABLE_RELS) | F.contains(F.coalesce(role, none), F.lit("linkml")) | F.coalesce(predicate, none).isin(*FETCHABLE_PREDICATES)


def candidate_priority(rel: Column, predicate: Column) -> Column:
    """10 for parts of a catalogue and imports, 20 for standards, 30 for alternates, else 50."""
    none = F.lit("")
    r, p = F.coalesce(rel, none), F.coalesce(predicate, none)
    parts, standards = ("dcat:dataset", "dcat:service", "dcat:catalog"), ("dcterms:conformsTo", "dct:conformsTo", "sh:shapesGraph")
    return F.when(p.isin(*parts) | (r == "import"), 10).when(p.isin(*standards) | r.isin("describedby", "profile"), 20).when(r == "alternate", 30).otherwise(50)


def is_document_like(c: Column) -> Column:
    """A string that is a URL or names a metadata file."""
    out = c.startswith("http://") | c.startswith("https://")
    for suffix in DOCUMENT_SUFFIXES:
        out = out | c.endswith(suffix)
    return out
