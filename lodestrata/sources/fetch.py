"""One fetch under a policy: address checks, redirects, authorization, size limits, header cleaning. Plain Python for workers; the transport is a parameter."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from time import monotonic
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.vocabulary import KEPT_HEADERS

REDIRECTS = (301, 302, 303, 307, 308)
RESULT = "run_id string, url string, depth int, discovered_from string, final_url string, status int, media_type string, headers array<struct<name: string, value: string>>, redirect_chain array<string>, body binary, reason_code string, credential_sent boolean"


@dataclass(frozen=True)
class Policy:
    schemes: tuple[str, ...] = ("https", "http")
    max_redirects: int = 10
    max_body_bytes: int = 8_388_608
    timeout_ms: int = 10_000
    allow_private: bool = False
    allow_downgrade: bool = False
    credential_origin: str | None = None


@dataclass(frozen=True)
class Request:
    """What a transport is asked for. It connects to `address`, which the policy has judged, and not to what the host's name means by then; it stops after so many seconds, and need not read more than so many bytes."""

    url: str
    credential: bool
    address: str
    seconds: float
    most_bytes: int


def origin(url: str) -> tuple[str, str, int | None]:
    parts = urlsplit(url)
    return parts.scheme.lower(), (parts.hostname or "").lower(), parts.port or {"http": 80, "https": 443}.get(parts.scheme.lower())


def is_private(address: str) -> bool:
    a = ipaddress.ip_address(address)
    a = getattr(a, "ipv4_mapped", None) or a
    if a.version == 4 and a in ipaddress.ip_network("100.64.0.0/10"):
        return True
    return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified


def refused(url: str, policy: Policy, resolve: Callable[[str], list[str]]) -> str | None:
    """Why a URL may not be fetched, by its text and by the addresses of its host."""
    return allowed(url, policy, resolve)[0]


def allowed(url: str, policy: Policy, resolve: Callable[[str], list[str]]) -> tuple[str | None, str]:
    """Why a URL may not be fetched, else null; and the address of its host that was judged."""
    reason = _by_text(url, policy)
    if reason:
        return reason, ""
    try:
        addresses = resolve(urlsplit(url).hostname or "")
    except OSError:
        addresses = []
    if not addresses:
        return "policy.dns_failed", ""
    if not policy.allow_private and any(is_private(a) for a in addresses):
        return "policy.private_network_blocked", ""
    return None, addresses[0]


def _by_text(url: str, policy: Policy) -> str | None:
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        return "policy.invalid_url"
    if not parts.scheme:
        return "policy.invalid_url"
    if parts.scheme.lower() not in policy.schemes:
        return "policy.unsupported_scheme"
    if parts.username or parts.password:
        return "policy.embedded_credentials"
    return None if host else "policy.missing_host"


def _body(got: dict, most: int) -> bytes | None:
    """The body, which may come in pieces; null where it is longer than `most`, of which no more is read."""
    body = got.get("body") or b""
    if isinstance(body, (bytes, bytearray, memoryview)):
        return None if len(body) > most else bytes(body)
    out = bytearray()
    for piece in body:
        out += piece
        if len(out) > most:
            return None
    return bytes(out)


def fetch_artifact(url: str, get: Callable[[Request], dict], resolve: Callable[[str], list[str]], policy: Policy = Policy()) -> dict:
    """get returns status, headers (pairs) and body (bytes, or pieces of them), and follows no redirect. The result has reason_code where the fetch was refused or failed. The time limit holds for all redirects together."""
    chain: list[str] = []
    at, sent, until = url, False, monotonic() + policy.timeout_ms / 1000

    def out(reason: str | None, **more) -> dict:
        return {"final_url": at, "redirect_chain": chain, "credential_sent": sent, "reason_code": reason} | more

    while True:
        reason, address = allowed(at, policy, resolve)
        if reason:
            return out(reason)
        left = until - monotonic()
        if left <= 0:
            return out("limit.timeout")
        credential = policy.credential_origin is not None and origin(at) == origin(policy.credential_origin)
        sent = sent or credential
        try:
            got = get(Request(at, credential, address, left, policy.max_body_bytes))
        except TimeoutError:
            return out("limit.timeout")
        except Exception:  # a transport may raise anything; the crawl goes on
            return out("fetch.failed")
        headers = {k.lower(): v for k, v in got.get("headers", [])}
        status = got["status"]
        if status in REDIRECTS:
            if len(chain) >= policy.max_redirects:
                return out("policy.too_many_redirects", status=status)
            if not headers.get("location"):
                return out("policy.redirect_missing_location", status=status)
            try:
                following = urljoin(at, headers["location"])
            except ValueError:
                return out("policy.invalid_redirect", status=status)
            if at.lower().startswith("https:") and following.lower().startswith("http:") and not policy.allow_downgrade:
                return out("policy.https_downgrade", status=status)
            chain.append(at)
            at = following
            continue
        if status in (401, 403):
            return out("auth.rejected" if sent else "auth.required", status=status)
        said = (headers.get("content-length") or "0").strip()
        if not (said.isascii() and said.isdigit()):
            return out("fetch.invalid_header", status=status)
        try:
            body = None if int(said[:20]) > policy.max_body_bytes else _body(got, policy.max_body_bytes)
        except TimeoutError:
            return out("limit.timeout", status=status)
        except Exception:
            return out("fetch.failed", status=status)
        if body is None:
            return out("limit.body_too_large", status=status)
        if monotonic() > until:
            return out("limit.timeout", status=status)
        if not 200 <= status < 300:
            return out("fetch.failed", status=status)
        kept = [{"name": k, "value": v} for k, v in headers.items() if k in KEPT_HEADERS]
        return out(None, status=status, headers=kept, media_type=(headers.get("content-type") or "").split(";")[0].strip() or None, body=body)


def fetching(get: Callable[[Request], dict], resolve: Callable[[str], list[str]], policy: Policy = Policy()) -> Callable[[DataFrame], DataFrame]:
    """A fetch step over rows run_id, url, depth, discovered_from: each executor fetches its own rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in RESULT.replace("struct<name: string, value: string>", "s").split(", ")]
        for batch in batches:
            rows = [dict.fromkeys(names) | {"run_id": r.run_id, "url": r.url, "depth": r.depth, "discovered_from": r.discovered_from} | fetch_artifact(r.url, get, resolve, policy) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=names).astype({"status": "Int32", "depth": "int32"})

    return lambda due: due.mapInPandas(run, RESULT)
