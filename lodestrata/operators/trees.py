"""Extractors for tree formats: JSON-LD, Turtle, TOML packages and LinkML YAML. The formats that are plain JSON are rules over walked documents (json_rules).

Each artifact's body is parsed once, in one Arrow pass without a shuffle, and
gives facts: assets, claims, links, findings, relations, kinds and errors, as
rows (table, seq, payload as JSON). Identity, link policy, claims, deduplication
and endpoints are decided from the facts with DataFrame functions (plans.report).
JSON trees are walked with stacks of their own, however deep they are. What the
parsers themselves refuse, such as Turtle that is nested beyond LEVELS, is a parse
error of the artifact.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from ..functions import vocabulary as V

LEVELS = 200


@dataclass
class Facts:
    """What one artifact says, in the order in which it says it."""

    url: str
    rows: list[tuple[str, dict]] = field(default_factory=list)

    def add(self, table: str, **payload: Any) -> None:
        self.rows.append((table, payload))

    def asset(self, kind: str, key: list[str], uri: str | None = None, title: str | None = None, *, hints: list[tuple[str, str | None, str | None]] = (), **more: Any) -> None:
        self.add("asset", kind=kind, key=key, uri=uri, title=title, hints=[{"label": a, "predicate": b, "path": c} for a, b, c in hints], **more)

    def link(self, href: str, evidence: dict, rel: str | None = None, predicate: str | None = None, role: str | None = None) -> None:
        self.add("link", href=href, rel=rel, predicate=predicate, role=role, evidence=evidence)

    def finding(self, code: str, message: str, evidence: dict, asset_key: list[str] | None = None, standard_iri: str | None = None) -> None:
        self.add("finding", code=code, message=message, evidence=evidence, asset_key=asset_key, standard_iri=standard_iri, severity="info")

    def claim(self, iri: str, predicate: str, version: str | None = None, base: str | None = None, title: str | None = None) -> None:
        self.add("claim", iri=iri, predicate=predicate, version=version, base=base, title=title)


# ---- values

_TEXT_KEYS = ("@id", "id", "@value", "value", "foaf:name", "name", "dcterms:title", "dct:title")


def text_of(value: Any) -> str | None:
    """The string that a value stands for: itself, an object's id, value or name, or the first of an array that has one."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            return x
        if isinstance(x, dict):
            stack += [x[k] for k in reversed(_TEXT_KEYS) if k in x]
        elif isinstance(x, list):
            stack += reversed(x)
    return None


def texts_of(value: Any) -> list[str]:
    """All strings of a value, arrays flattened."""
    out, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
        elif (found := text_of(x)) is not None:
            out.append(found)
    return out


def first_of(node: Any, keys: tuple[str, ...]) -> str | None:
    if not isinstance(node, dict):
        return None
    return next((t for k in keys if k in node and (t := text_of(node[k])) is not None), None)


def all_of(node: dict, keys: tuple[str, ...]) -> list[str]:
    return [t for k in keys if k in node for t in texts_of(node[k])]


def objects(value: Any) -> Iterator[dict]:
    """All objects of a tree, outer ones first, members in the order of their names."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            yield x
            stack += [x[k] for k in sorted(x, reverse=True)]
        elif isinstance(x, list):
            stack += reversed(x)


def shorten(value: Any, most: int = 512) -> str:
    """Evidence text of at most so many bytes, cut between characters."""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "..."


# ---- names

class Names:
    """Compact and full names under the prefixes of a document."""

    def __init__(self, document: Any = None) -> None:
        self.prefixes = dict(V.PREFIXES)
        for node in objects(document):
            context = node.get("@context")
            for part in context if isinstance(context, list) else [context]:
                if isinstance(part, dict):
                    self.prefixes |= {k: t for k, v in part.items() if (t := text_of(v)) and t.endswith(("/", "#"))}
        self.by_namespace: dict[str, str] = {}
        for prefix in V.PREFIXES:
            if prefix != "dct":
                self.by_namespace.setdefault(V.PREFIXES[prefix], prefix)

    def full(self, name: str) -> str:
        prefix, colon, rest = name.partition(":")
        if not colon or rest.startswith("//") or prefix not in self.prefixes:
            return name
        return self.prefixes[prefix] + rest

    def short(self, name: str) -> str:
        full = self.full(name)
        for namespace, prefix in self.by_namespace.items():
            if full.startswith(namespace):
                local = full[len(namespace) :]
                if namespace == V.PREFIXES["cv"]:
                    prefix = "cv" if local in V.CV_NAMES else "cccev"
                return f"{prefix}:{local}"
        return name


# ---- JSON-LD

_SIGNAL_KEYS = {name: (name, name.replace("dcterms:", "dct:"), name.partition(":")[2]) for name in V.SIGNALS}
_ODRL_TYPES = ("Policy", "Set", "Offer", "Agreement")
_RESOURCE = re.compile(r"^(https?|urn|did|mailto):", re.I)


def _is_policy(types: list[str], node: dict, names: Names) -> bool:
    named = any(names.short(t) in [f"odrl:{x}" for x in _ODRL_TYPES] for t in types)
    return named or any(names.short(k) in ("odrl:permission", "odrl:prohibition", "odrl:obligation") for k in node)


def _endpoint(node: Any, names: Names) -> dict:
    if isinstance(node, dict):
        own = first_of(node, ("@id", "id"))
        if own and not own.startswith("_:"):
            return {"uri": names.full(own)}
        return {"node": own or "_:" + json.dumps(node, sort_keys=True, ensure_ascii=False)}
    return {"uri": names.full(node)}


def json_ld(facts: Facts, document: Any, kind: str) -> None:
    names = Names(document)
    if kind == "json_ld_context":
        facts.asset("vocabulary", ["jsonld-context"], facts.url, first_of(document, ("title", "dcterms:title", "name")), description=first_of(document, ("description", "dcterms:description")), pointer="/")
    for node in objects(document):
        _node(facts, node, names)
    for k, node in enumerate(objects(document)):
        _fields(facts, node, names, k)
        _relations(facts, node, names)
    for node in objects(document):
        for key in sorted(node):
            predicate = names.short(key)
            if predicate in V.LINK_PREDICATES:
                for value in texts_of(node[key]):
                    href = names.full(value)
                    facts.link(href, {"source": "json_ld_predicate", "predicate": predicate, "value": href}, predicate=predicate, role=V.PREDICATE_ROLES.get(predicate))
    _shapes(facts, document, names, None)


def _node(facts: Facts, node: dict, names: Names) -> None:
    types = all_of(node, ("@type", "type"))
    short = [names.short(t) for t in types]
    uri = first_of(node, ("@id", "id"))
    title, description = first_of(node, V.TITLE_KEYS), first_of(node, V.DESCRIPTION_KEYS)
    conforms = [names.full(i) for i in all_of(node, V.CONFORMS_KEYS)]

    def add(kind: str, label: str, publisher: tuple[str, ...] = (), endpoint: tuple[str, ...] = (), signalled: bool = True, own_title: str | None = None, hints: list = (), own_conforms: list[str] | None = None) -> None:
        key = [uri or label, label]
        facts.asset(kind, key, uri, title or own_title, description=description, publisher=first_of(node, publisher), endpoint=first_of(node, endpoint), conforms=conforms if own_conforms is None else own_conforms, hints=[(label, "@type", None), *hints], subject=uri)
        if signalled:
            _signals(facts, node, key)

    if "cpsv:PublicService" in short:
        produces = any(names.short(k) == "cpsv:produces" for k in node)
        add("public_registry_service" if produces else "public_service", "cpsv:PublicRegistryService" if produces else "cpsv:PublicService", ("cv:hasCompetentAuthority", V.PREFIXES["cv"] + "hasCompetentAuthority", *V.PUBLISHER_KEYS))
    for name in dict.fromkeys(V.TYPE_ALIASES.get(s, s) for s in short):
        if name in V.TYPE_KINDS:
            publisher = (*V.PUBLISHER_KEYS, "foaf:maker") if name == "dcat:Catalog" else () if name in ("dcat:Distribution", *V.UNSIGNALLED) else V.PUBLISHER_KEYS
            endpoint = {"dcat:DataService": ("dcat:endpointURL", "endpointURL"), "dcat:Distribution": ("dcat:accessURL", "dcat:downloadURL")}.get(name, ())
            add(V.TYPE_KINDS[name], name, publisher, endpoint, name not in V.UNSIGNALLED)
            if name == "dcat:Catalog":
                facts.add("kind", kind="dcat_catalog")
            if name == "prof:Profile":
                facts.add("kind", kind="prof_profile")
    if _is_policy(types, node, names):
        seen = sorted({s for o in objects(node) for k in o if (s := names.short(k)) in V.ODRL_HINTS})
        add("policy", "odrl:Policy", ("odrl:assigner", "assigner"), own_title="Access policy", hints=[(s, s, None) for s in seen], own_conforms=[names.full(i) for i in all_of(node, ("odrl:profile", "profile"))])
    for iri in conforms:
        facts.claim(iri, "dcterms:conformsTo")
    for base in all_of(node, ("prof:isProfileOf",)):
        if uri:
            facts.claim(uri, "prof:isProfileOf", base=names.full(base), title=title)


def _fields(facts: Facts, node: dict, names: Names, k: int) -> None:
    """Every value of a node by the canonical name of its key. Nodes without an id are named by their place."""
    own = first_of(node, ("@id", "id"))
    for key in sorted(node):
        if key not in ("@context", "@graph", "@id", "id"):
            short = "@type" if key == "type" else names.short(key)
            for value in texts_of(node[key]):
                facts.add("field", node=names.full(own) if own else f"_:{k}", occurrence=k, key=short, value=shorten(names.short(value) if short == "@type" else names.full(value)))


def _signals(facts: Facts, node: dict, key: list[str]) -> None:
    for predicate, aliases in _SIGNAL_KEYS.items():
        for value in all_of(node, tuple(dict.fromkeys(aliases))):
            facts.finding("semantic.standard_signal", f"{predicate} is declared", {"source": "json_ld_predicate", "predicate": predicate, "value": shorten(value)}, key, predicate)


def _relations(facts: Facts, node: dict, names: Names) -> None:
    subject = first_of(node, ("@id", "id"))
    if not subject:
        return
    for key in sorted(node):
        predicate = names.short(key)
        if predicate not in V.RELATION_PREDICATES and not predicate.startswith("registry_manifest:"):
            continue
        for value in node[key] if isinstance(node[key], list) else [node[key]]:
            if isinstance(value, str) and not (_RESOURCE.match(value) or names.full(value) != value):
                continue
            if isinstance(value, (dict, str)):
                facts.add("relation", subject={"uri": names.full(subject)}, predicate=predicate, object=_endpoint(value, names), evidence={"source": "json_ld_predicate", "predicate": predicate, "value": shorten(text_of(value) or value)})


def _shapes(facts: Facts, value: Any, names: Names, shape: str | None) -> None:
    """Property shapes with a path; the shape is the nearest object above with an id."""
    stack: list[tuple[str | None, Any, str | None]] = [(None, value, shape)]
    while stack:
        key, x, own = stack.pop()
        if key is not None and names.short(key) == "sh:property":
            for p in x if isinstance(x, list) else [x]:
                path = next((text_of(p[k]) for k in p if names.short(k) == "sh:path"), None) if isinstance(p, dict) else None
                if path:
                    label = next((text_of(p[k]) for k in p if names.short(k) == "sh:name"), None)
                    facts.finding("semantic.shacl_property", "A shape has a property path", {"source": "shacl_property", "shape": own or "", "path": names.full(path), "predicate": "sh:path", "value": label or names.full(path)})
        if isinstance(x, list):
            stack += [(None, y, own) for y in reversed(x)]
        elif isinstance(x, dict):
            inner = first_of(x, ("@id", "id")) or own
            stack += [(k, x[k], inner) for k in sorted(x, reverse=True)]


# ---- TOML and YAML

def _documents(value: Any) -> list[str]:
    """Distinct strings of a tree that are URLs or name metadata files, sorted."""
    found, stack = set(), [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str) and (x.startswith(("http://", "https://")) or x.endswith(V.DOCUMENT_SUFFIXES)):
            found.add(x)
        elif isinstance(x, dict):
            stack += x.values()
        elif isinstance(x, list):
            stack += x
    return sorted(found)


def package(facts: Facts, body: str) -> None:
    document = tomllib.loads(body)
    own = document.get("package") if isinstance(document.get("package"), dict) else {}
    get = lambda key: next((v for d in (own, document) if isinstance(v := d.get(key), str)), None)
    name = get("name") or "Semantic asset package"
    facts.asset("semantic_model_package", ["semantic-package", name], get("id") or facts.url, get("title") or name, description=get("description"), publisher=get("publisher"), endpoint=facts.url, conforms=[f"semantic-asset-package:{get('version')}"] if get("version") else [], hints=[("Semantic asset package manifest", "package", "/package")], pointer="/")
    parts = document.get("artifacts")
    for k, part in enumerate(parts if isinstance(parts, list) else ()):
        role = part.get("role") if isinstance(part, dict) else None
        if role in ("alignment", "crosswalk"):
            path = part.get("path") if isinstance(part.get("path"), str) else role
            conforms = part.get("conforms_to")
            facts.asset(role, [role, path], path, f"{name} {role}", relative=True, conforms=[conforms] if isinstance(conforms, str) else [], hints=[(f"Semantic package {role}", "artifacts.role", f"/artifacts/{k}/role")], pointer=f"/artifacts/{k}")
    for href in _documents(document):
        facts.link(href, {"source": "json_pointer", "pointer": "/", "value": href}, "describedby", None, "semantic-package-artifact")


def linkml(facts: Facts, body: str) -> None:
    import yaml

    document = yaml.safe_load(body)
    document = document if isinstance(document, dict) else {}
    get = lambda d, key: None if not isinstance(d, dict) or isinstance(d.get(key), (dict, list, type(None))) else str(d[key])
    name = get(document, "name") or "LinkML schema"
    version = get(document, "version")
    facts.asset("semantic_model_package", ["linkml", name], get(document, "id") or facts.url, name, description=get(document, "description"), conforms=[f"linkml:{version}"] if version else [V.LINKML_IRI], hints=[("LinkML schema", "name", "/name")], pointer="/")
    for key, kind in (("classes", "class"), ("slots", "property"), ("enums", "vocabulary")):
        own = document.get(key)
        for item in own if isinstance(own, dict) else ():
            if isinstance(item, str):
                facts.asset(kind, [key, item], None, item, description=get(own[item], "description"), hints=[(f"LinkML {key}", key, f"/{key}/{item}")], pointer=f"/{key}/{item}")
    prefixes = document.get("prefixes") if isinstance(document.get("prefixes"), dict) else {}
    known = {p: t for p, v in prefixes.items() if (t := v if isinstance(v, str) else get(v, "prefix_reference"))}
    imports = document.get("imports")
    for item in imports if isinstance(imports, list) else ():
        if isinstance(item, str):
            prefix, colon, rest = item.partition(":")
            facts.link(known[prefix] + rest if colon and prefix in known else item, {"source": "json_pointer", "pointer": "/imports", "value": item}, "import", None, "linkml-import")
    for href in _documents(document):
        facts.link(href, {"source": "json_pointer", "pointer": "/", "value": href}, "describedby", None, "linkml-reference")


# ---- Turtle

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<word>@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?=[\s;,.\])]|$)|(?:[\w][\w.-]*[\w-]|[\w])?:(?:(?:[\w:%~-]|\\.)(?:(?:[\w.:%~-]|\\.)*(?:[\w:%~-]|\\.))?)?|[A-Za-z_]\w*)|(?P<mark>[.;,\[\]()])""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\", "b": "\b", "f": "\f"}


def turtle_triples(body: str, base: str = "") -> list[tuple[str, str, str]]:
    """(subject, predicate, object) as strings: IRIs in full, literals without language and datatype, blank nodes as `_:name`. Raises ValueError for what is no Turtle."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            raise ValueError(f"unexpected text at {at}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group()))
        at = m.end()
    prefixes: dict[str, str] = {}
    out: list[tuple[str, str, str]] = []
    state = {"at": 0, "blank": 0, "base": base}
    rdf = V.PREFIXES["rdf"]

    def peek() -> tuple[str, str]:
        return tokens[state["at"]] if state["at"] < len(tokens) else ("end", "")

    def take(expected: str | None = None) -> tuple[str, str]:
        token = peek()
        if token[0] == "end" or (expected is not None and token[1] != expected):
            raise ValueError(f"expected {expected or 'more'}, found {token[1] or 'the end'}")
        state["at"] += 1
        return token

    def iri(token: tuple[str, str]) -> str:
        kind, text = token
        if kind == "iri":
            name = text[1:-1]
            if state["base"] and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", name):
                from urllib.parse import urljoin

                return urljoin(state["base"], name) if name else state["base"]
            return name
        if kind == "word" and ":" in text:
            prefix, _, rest = text.partition(":")
            if prefix == "_":
                return text
            if prefix not in prefixes:
                raise ValueError(f"unknown prefix {prefix}")
            return prefixes[prefix] + re.sub(r"\\(.)", r"\1", rest)
        raise ValueError(f"expected a name, found {text}")

    def unquote(text: str) -> str:
        inner = text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1]
        return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), inner, flags=re.S)

    def blank() -> str:
        state["blank"] += 1
        return f"_:b{state['blank']}"

    def term(depth: int) -> str:
        if depth > LEVELS:
            raise ValueError("nested too deeply")
        kind, text = peek()
        if text == "[":
            take()
            node = blank()
            if peek()[1] != "]":
                properties(node, depth + 1)
            take("]")
            return node
        if text == "(":
            take()
            items = []
            while peek()[1] != ")":
                items.append(term(depth + 1))
            take(")")
            nodes = [blank() for _ in items]
            for k, item in enumerate(items):
                out.append((nodes[k], rdf + "first", item))
                out.append((nodes[k], rdf + "rest", nodes[k + 1] if k + 1 < len(nodes) else rdf + "nil"))
            return nodes[0] if nodes else rdf + "nil"
        token = take()
        if kind == "text":
            if peek()[1].startswith("@"):
                take()
            elif peek()[1] == "^^":
                take()
                iri(take())
            return unquote(text)
        if kind == "word" and ":" not in text:
            return text
        return iri(token)

    def properties(subject: str, depth: int) -> None:
        while True:
            predicate = rdf + "type" if peek()[1] == "a" and take() else iri(take())
            while True:
                out.append((subject, predicate, term(depth)))
                if peek()[1] != ",":
                    break
                take()
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "]") or peek()[0] == "end" or tokens[state["at"] - 1][1] != ";":
                return

    while peek()[0] != "end":
        word = peek()[1].lower()
        if word in ("@prefix", "prefix") and peek()[0] == "word":
            take()
            name = take()[1]
            prefixes[name[:-1]] = iri(take())
            if word[0] == "@":
                take(".")
        elif word in ("@base", "base") and peek()[0] == "word":
            take()
            state["base"] = iri(take())
            if word[0] == "@":
                take(".")
        else:
            bare = peek()[1] == "["
            subject = term(0)
            if not (bare and peek()[1] == "."):
                properties(subject, 0)
            take(".")
    return out


_ALIGNMENTS = ("exactMatch", "closeMatch", "broadMatch", "narrowMatch", "equivalentClass", "equivalentProperty")
_TURTLE_LINKS = (
    "dcat:catalog", "dcat:dataset", "dcat:distribution", "dcat:downloadURL", "dcat:accessURL", "dcterms:hasPart", "dcterms:conformsTo", "prof:hasResource",
    "prof:hasArtifact", "prof:isProfileOf",
)


def turtle(facts: Facts, body: str) -> None:
    triples = turtle_triples(body, facts.url)
    by: dict[str, list[tuple[str, str]]] = {}
    owner: dict[str, str] = {}
    for s, p, o in triples:
        by.setdefault(s, []).append((p, o))
        if p == V.PREFIXES["sh"] + "property":
            owner[o] = min(owner.get(o, s), s)
    names = Names()
    for subject in sorted(by):
        own = by[subject]
        types = [o for p, o in own if p == V.PREFIXES["rdf"] + "type"]
        is_a = lambda name: any(t.endswith(name) for t in types)
        first = lambda *ps: next((o for q in ps for p, o in own if p == q), None)
        title = first(V.PREFIXES["rdfs"] + "label", V.PREFIXES["dcterms"] + "title", V.PREFIXES["skos"] + "prefLabel")
        description = first(V.PREFIXES["dcterms"] + "description", V.PREFIXES["skos"] + "definition")
        rules = (
            ("shape_graph", "sh:NodeShape", is_a("NodeShape") or any(p == V.PREFIXES["sh"] + "targetClass" for p, _ in own), "shacl"),
            ("concept_scheme", "skos:ConceptScheme", is_a("ConceptScheme"), "skos"),
            ("class", "owl/rdfs class", is_a("Class") or is_a("Ontology"), "owl_ontology" if is_a("Ontology") else None),
            ("alignment", "alignment mapping", any(p.endswith(_ALIGNMENTS) for p, _ in own), None),
        )
        for kind, label, holds, overrides in rules:
            if holds:
                facts.asset(kind, [subject, label], subject, title, description=description, hints=[(label, "rdf:type", None)], subject=subject)
                if overrides:
                    facts.add("kind", kind=overrides)
    for s, p, o in triples:
        short = names.short(p)
        if short == "sh:path":
            facts.finding("semantic.shacl_property", "A shape has a property path", {"source": "shacl_property", "shape": owner.get(s, s), "path": o, "predicate": "sh:path", "value": o})
        if short in _TURTLE_LINKS:
            facts.link(o, {"source": "json_ld_predicate", "predicate": short, "value": o}, None, short, V.PREDICATE_ROLES.get(short))
        if short == "dcterms:conformsTo":
            facts.claim(o, "dcterms:conformsTo")
        if short == "prof:isProfileOf":
            facts.claim(s, "prof:isProfileOf", base=o)


# ---- dispatch

JSON_LD_KINDS = ("dcat_catalog", "dcat_profile_catalog", "prof_profile", "prof_resource", "shacl", "json_ld_context", "did_document", "verifiable_credential", "metadata_index")


def extract(kind: str, url: str, body: str) -> list[tuple[str, dict]]:
    """The facts of one artifact. A body that its format cannot be is one error."""
    facts = Facts(url)
    try:
        if kind == "semantic_model_package":
            package(facts, body)
        elif kind == "link_ml_schema":
            linkml(facts, body)
        elif kind in ("shacl", "skos", "owl_ontology") and not body.lstrip().startswith(("{", "[")):
            turtle(facts, body)
        elif kind == "html_landing_page" or kind == "unknown":
            return []
        else:
            json_ld(facts, json.loads(body), kind)
    except (ValueError, RecursionError, ImportError) as e:
        return [("error", {"message": shorten(str(e))})]
    except Exception as e:  # YAML has errors of its own
        if type(e).__module__.startswith("yaml"):
            return [("error", {"message": shorten(str(e))})]
        raise
    return facts.rows
