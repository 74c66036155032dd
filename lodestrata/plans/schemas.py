"""Schemas of the input and of what extractors say."""

from __future__ import annotations

EVIDENCE_FIELDS = (
    "source", "header_name", "rel", "value", "predicate", "pointer", "href", "pattern", "detector", "marker", "policy", "schema_pointer", "property_path",
    "property_name", "shape", "path", "method", "operation_id", "summary", "collection_id", "title",
)
EVIDENCE = "struct<" + ", ".join(f"{n}: string" for n in EVIDENCE_FIELDS) + ">"
FETCHED = (
    "run_id string, ordinal int, url string, final_url string, status int, media_type string, request_accept string, redirect_chain array<string>, "
    "headers array<struct<name: string, value: string>>, body binary, fetched_at string, depth int, discovered_from string"
)
ENDPOINT = "struct<asset_id: string, uri: string, node: string>"
HINT = "struct<label: string, predicate: string, path: string>"
FACTS = {
    "asset": f"kind string, key array<string>, uri string, title string, description string, publisher string, endpoint string, conforms array<string>, hints array<{HINT}>, pointer string, subject string, relative boolean",
    "claim": "iri string, predicate string, version string, base string, title string",
    "link": f"href string, rel string, predicate string, role string, evidence {EVIDENCE}",
    "finding": f"code string, message string, evidence {EVIDENCE}, asset_key array<string>, standard_iri string, severity string",
    "relation": f"subject {ENDPOINT}, predicate string, object {ENDPOINT}, evidence {EVIDENCE}",
    "field": "node string, occurrence int, key string, value string",
    "kind": "kind string",
    "error": "message string",
}
