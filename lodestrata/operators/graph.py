"""The service graph: bounded multi-hop joins over edges, for all services at once.

Assets: run_id, id, kind, uri, title. Relations: run_id, relation_id, subject_id,
predicate, object_id, seq. stored() puts both, and what several methods share,
into tables of the shared folder, each computed once. Every hop is an equi join; "first wins" is a minimum
of structs that combines before the shuffle; a path is the array of its
relation ids. A filter on one service reaches the first hop's scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored, tidied

PROVIDED = ("registry_manifest:evidenceProvider", "registry_manifest:providedBy", "registry_manifest:issuingAuthority")
OFFERS = ("registry_manifest:offersEvidenceType", "registry_manifest:acceptedEvidenceType", "registry_manifest:evidenceType")
ACCEPTS, LISTS, SPECIFIES = ("registry_manifest:acceptedEvidenceType",), ("cccev:hasEvidenceTypeList",), ("cccev:specifiesEvidenceType",)
REQUIRES = ("cv:holdsRequirement", "cccev:hasRequirement")
#: What service_types() goes by; the first two end in a type.
TYPED = (*SPECIFIES, *ACCEPTS, *LISTS, *REQUIRES)
#: Ends in one list of a join.
LISTED = 1_000
FORMS = ("registry_manifest:form", "registry_manifest:hasForm")


def resolve_endpoints(relations: DataFrame, assets: DataFrame) -> DataFrame:
    """relations with subject_id and object_id: the asset that an endpoint names by id, else the first with its URI, else its URI or node."""
    by_uri = assets.where("uri is not null").groupBy("run_id", "uri").agg(F.min_by("id", F.struct("ordinal", "seq")).alias("_asset"))
    out = relations
    for end in ("subject", "object"):
        named = by_uri.select(F.col("run_id").alias("_run"), F.col("uri").alias("_uri"), F.col("_asset").alias(f"_{end}"))
        out = out.join(named, (F.col("run_id") == F.col("_run")) & (F.col(f"{end}.uri") == F.col("_uri")), "left").drop("_run", "_uri")
        out = out.withColumn(f"{end}_id", F.coalesce(F.col(f"{end}.asset_id"), F.col(f"_{end}"), F.col(f"{end}.uri"), F.col(f"{end}.node_id"))).drop(f"_{end}")
    return out


def unclaimed(relations: DataFrame, claims: DataFrame) -> DataFrame:
    """Relations that no claim supports: a report is only whole if there are none."""
    return relations.join(claims.select("run_id", "relation_id"), ["run_id", "relation_id"], "left_anti")


def first_path(paths: DataFrame, *keys: str) -> DataFrame:
    """(run_id, keys, ord, path): of each key the first path, by its order and then by its relations."""
    return paths.groupBy("run_id", *keys).agg(F.min(F.struct("ord", "path")).alias("_p")).select("run_id", *keys, "_p.ord", "_p.path")


@dataclass
class ServiceGraph:
    assets: DataFrame
    relations: DataFrame
    claims: DataFrame | None = None
    keep: bool = False
    #: Without paths (no ord and path) only what leads where is found, with less to move and sort.
    paths: bool = True
    #: Partitions by which edges are dealt; None leaves their number to Spark, which reckons by bytes that compress well.
    parts: int | None = None
    _tables: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def stored(self) -> ServiceGraph:
        """The same graph over stored tables. Shared paths are stored when they are first asked for."""
        return ServiceGraph(stored(self.assets.select("run_id", "id", "kind", "uri", "title"), "assets"), stored(self.relations, "relations"), self.claims, True, self.paths, self.parts)

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if not self.keep:
            return build()
        if name not in self._tables:
            self._tables[name] = stored(build(), name)
        return self._tables[name]

    def check(self) -> None:
        """Raise where a relation has no claim."""
        if self.claims is not None and unclaimed(self.relations, self.claims).take(1):
            raise ValueError("a relation has no claim")

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.assets.where(F.col("kind").isin(*kinds)).select("run_id", F.col("id").alias("target"))

    def _dealt(self, frame: DataFrame, *keys: str) -> DataFrame:
        return frame.repartition(*([self.parts] if self.parts else []), "run_id", *keys)

    def _way(self) -> list[str]:
        return ["ord", "path"] if self.paths else []

    def _edges(self, predicates: tuple[str, ...], source: str, target: str) -> DataFrame:
        edges = self.relations.where(F.col("predicate").isin(*predicates)).select("run_id", F.col(source).alias("source"), F.col(target).alias("target"), F.col("seq").cast("long").alias("ord"), F.array("relation_id").alias("path"))
        return edges.select("run_id", "source", "target", *self._way())

    def _to(self, edges: DataFrame, *kinds: str) -> DataFrame:
        """Edges to assets of the kinds, once for each source and target. Dealt by target they are made distinct and joined without a second shuffle."""
        return self._first(self._dealt(edges, "target"), "source", "target").join(self.of_kind(*kinds), ["run_id", "target"], "left_semi").select("run_id", "source", "target", *self._way())

    def outgoing(self, predicates: tuple[str, ...], *kinds: str) -> DataFrame:
        """(run_id, source, target, ord, path): assets of the kinds that edges lead to, once for each source."""
        return self._to(self._edges(predicates, "subject_id", "object_id"), *kinds)

    def incoming(self, predicates: tuple[str, ...], *kinds: str) -> DataFrame:
        """The same against the edges' direction."""
        return self._to(self._edges(predicates, "object_id", "subject_id"), *kinds)

    def _first(self, paths: DataFrame, *keys: str) -> DataFrame:
        return first_path(paths, *keys) if self.paths else paths.select("run_id", *keys).distinct()

    def chain(self, left: DataFrame, right: DataFrame, wide: bool = True) -> DataFrame:
        """left's sources to right's targets through what left leads to, once for each source and target."""
        return self._first(self._ways(left, right, wide), "source", "target")

    def _ways(self, left: DataFrame, right: DataFrame, wide: bool = True) -> DataFrame:
        """All ways of chain(), a source's rows lying together.

        wide: what an asset leads to is joined as lists of at most LISTED, and these are taken apart there, so ways that meet again are never shuffled one by one. Where few meet, a plain join has less to sort.
        """
        if not wide:
            on = right.select("run_id", F.col("source").alias("target"), F.struct("target", *(["path"] if self.paths else [])).alias("_end"))
            each = self._dealt(left.join(on, ["run_id", "target"]).select("run_id", "source", *self._way(), "_end"), "source")
        else:
            part = F.floor((F.row_number().over(Window.partitionBy("run_id", "source").orderBy("target")) - 1) / LISTED)
            ends = F.struct("target", *(["path"] if self.paths else []))
            lists = right.withColumn("_part", part).groupBy("run_id", F.col("source").alias("target"), "_part").agg(F.collect_list(ends).alias("_ends")).drop("_part")
            joined = self._dealt(left.join(lists, ["run_id", "target"]).select("run_id", "source", *self._way(), "_ends"), "source")
            each = joined.select("run_id", "source", *self._way(), F.explode("_ends").alias("_end"))
        return each.select("run_id", "source", F.col("_end.target").alias("target"), *(["ord", F.concat("path", "_end.path").alias("path")] if self.paths else []))

    def either(self, *paths: DataFrame) -> DataFrame:
        """The union, in which the earlier kind of path wins; each kind may have several paths from a source to a target."""
        whole = None
        for k, p in enumerate(paths):
            ranked = p.withColumn("ord", F.lit(k).cast("long") * (1 << 40) + F.col("ord")) if self.paths else p.select("run_id", "source", "target")
            whole = ranked if whole is None else whole.unionByName(ranked)
        return self._first(whole, "source", "target")

    def services(self) -> DataFrame:
        return self.assets.where("kind = 'public_service'").select("run_id", F.col("id").alias("source"))

    def public_service(self, iri: str) -> DataFrame:
        """The service with that IRI; an error if there is none."""
        found = self.assets.where((F.col("kind") == "public_service") & (F.col("uri") == iri))
        if not found.take(1):
            raise LookupError(f"no public service {iri}")
        return found

    def evidence_type(self, iri: str) -> DataFrame:
        found = self.assets.where((F.col("kind") == "evidence_type") & (F.col("uri") == iri))
        if not found.take(1):
            raise LookupError(f"no evidence type {iri}")
        return found

    def channels(self) -> DataFrame:
        return self.outgoing(("cv:hasChannel",), "channel")

    def authorities(self) -> DataFrame:
        return self.outgoing(("cv:hasCompetentAuthority",), "public_organisation")

    def concepts(self) -> DataFrame:
        return self.outgoing(("cccev:hasConcept",), "information_concept")

    def requirements(self) -> DataFrame:
        return self.outgoing(REQUIRES, "requirement")

    def lists(self) -> DataFrame:
        return self.outgoing(LISTS, "evidence_type_list")

    def list_types(self) -> DataFrame:
        return self.outgoing(SPECIFIES, "evidence_type")

    def direct_types(self) -> DataFrame:
        return self.outgoing(ACCEPTS, "evidence_type")

    def requirement_types(self) -> DataFrame:
        """What a requirement accepts: named directly, or through a list."""
        return self._once("requirement-types", lambda: self.either(self.direct_types(), self._ways(self.lists(), self.list_types(), False)))

    def service_types(self) -> DataFrame:
        """What a service accepts: through its requirements, or named directly."""
        return self._once("service-types", self._service_types)

    def _service_types(self) -> DataFrame:
        return self.either(self._ways(self.requirements(), self.requirement_types(), False), self.direct_types().join(self.services(), ["run_id", "source"], "left_semi"))

    def offerings(self) -> DataFrame:
        """(evidence type, offering)"""
        return self._once("offerings", lambda: self.incoming(OFFERS, "evidence_offering"))

    def offering_providers(self) -> DataFrame:
        return self.outgoing(PROVIDED, "evidence_provider", "public_organisation")

    def access_services(self) -> DataFrame:
        return self.outgoing(("registry_manifest:evidenceService", "dcat:accessService"), "data_service")

    def type_providers(self) -> DataFrame:
        """(evidence type, provider): through offerings, named directly, or by an offering that specifies the type."""
        return self._once("type-providers", self._type_providers)

    def _type_providers(self) -> DataFrame:
        specified = self.incoming((*OFFERS, *SPECIFIES), "evidence_offering")
        return self.either(self.chain(self.offerings(), self.offering_providers()), self.outgoing(PROVIDED, "evidence_provider", "public_organisation").join(self.of_kind("evidence_type").withColumnRenamed("target", "source"), ["run_id", "source"], "left_semi"), self.chain(specified, self.offering_providers()))

    def service_providers(self) -> DataFrame:
        return self.chain(self.service_types(), self.type_providers())

    def data_services(self) -> DataFrame:
        return self.outgoing(("registry_manifest:usesDataService",), "data_service")

    def forms(self) -> DataFrame:
        """(service, form): the service's, its channels', and forms that name a channel or the service."""
        own = self.outgoing(FORMS, "form_definition")
        for_channel = self.incoming(("registry_manifest:forChannel",), "form_definition")
        for_service = self.incoming(("registry_manifest:forPublicService",), "form_definition")
        services = self.services()
        return self.either(own.join(services, ["run_id", "source"], "left_semi"), self.chain(self.channels(), own), self.chain(self.channels(), for_channel), for_service)

    def services_of_type(self) -> DataFrame:
        """(evidence type, service): all paths of service_types(), reversed."""
        return self.service_types().select("run_id", F.col("target").alias("source"), F.col("source").alias("target"), *self._way())

    def options(self) -> DataFrame:
        """(requirement, option, target): the evidence types of each option; a list is one option, all direct types together are one more."""
        listed = self.lists().select("run_id", F.col("source").alias("requirement"), F.col("target").alias("option"))
        types = self.list_types().select("run_id", F.col("source").alias("option"), "target")
        direct = self.direct_types().join(self.of_kind("requirement").withColumnRenamed("target", "source"), ["run_id", "source"], "left_semi")
        return listed.join(types, ["run_id", "option"], "left").unionByName(direct.select("run_id", F.col("source").alias("requirement"), F.col("source").alias("option"), "target"))

    def with_access(self) -> DataFrame:
        """Evidence types that some offering gives access to."""
        return self._given().select("run_id", F.col("source").alias("target")).distinct()

    def _given(self) -> DataFrame:
        """(evidence type, offering) where the offering gives access."""
        access = self.access_services().select("run_id", F.col("source").alias("target"))
        return self.offerings().join(access, ["run_id", "target"], "left_semi")

    def option_access(self) -> DataFrame:
        """(requirement, option, n_types, n_missing, satisfiable): an option needs access to each of at least one type."""
        reached = self.with_access().withColumn("reached", F.lit(True))
        by = self.options().join(reached, ["run_id", "target"], "left").groupBy("run_id", "requirement", "option")
        counted = by.agg(F.count("target").alias("n_types"), F.count_if(F.col("target").isNotNull() & F.col("reached").isNull()).alias("n_missing"))
        return counted.withColumn("satisfiable", (F.col("n_types") > 0) & (F.col("n_missing") == 0))

    def missing_types(self) -> DataFrame:
        """(requirement, option, target): types of an option that nothing gives access to."""
        return self.options().where("target is not null").join(self.with_access(), ["run_id", "target"], "left_anti")

    def requirement_access(self) -> DataFrame:
        return self.option_access().groupBy("run_id", "requirement").agg(F.bool_or("satisfiable").alias("satisfiable"))

    def _pairs(self, predicates: tuple[str, ...], source: str, target: str, *kinds: str) -> DataFrame:
        """(run_id, source, target) of edges to assets of the kinds, without paths: where only existence matters."""
        edges = self.relations.where(F.col("predicate").isin(*predicates)).select("run_id", F.col(source).alias("source"), F.col(target).alias("target"))
        return edges.join(self.of_kind(*kinds), ["run_id", "target"], "left_semi")

    def gaps(self) -> DataFrame:
        """(run_id, asset_id, predicate): what is missing, by six rules of which each is an anti join. No path is made, nor what a requirement accepts through its lists: that there is some suffices."""
        out_ = lambda p, *kinds: self._pairs(p, "subject_id", "object_id", *kinds)
        targets = lambda df: df.select("run_id", F.col("target").alias("source")).distinct()
        holds = self._once("holds", lambda: out_(REQUIRES, "requirement").distinct())
        need = targets(holds)
        direct = out_(ACCEPTS, "evidence_type")
        lists = self._once("lists", lambda: out_(LISTS, "evidence_type_list").distinct())
        specified = self._once("specified", lambda: out_(SPECIFIES, "evidence_type").distinct())
        accepting = direct.select("run_id", "source").unionByName(lists.join(specified.select("run_id", F.col("source").alias("target")), ["run_id", "target"], "left_semi").select("run_id", "source"))
        asked = targets(lists.join(need, ["run_id", "source"], "left_semi"))
        own = direct.join(need.unionByName(self.services()), ["run_id", "source"], "left_semi")
        types = self._once("types", lambda: targets(own.unionByName(specified.join(asked, ["run_id", "source"], "left_semi"))))
        offered = self._once("offered", lambda: self._pairs(OFFERS, "object_id", "subject_id", "evidence_offering").distinct())
        offering = targets(offered.join(types, ["run_id", "source"], "left_semi"))
        rules = (
            (self.services(), out_(("cv:hasChannel",), "channel"), "cv:hasChannel"),
            (self.services(), holds, "cv:holdsRequirement"),
            (need, accepting, "cccev:hasEvidenceTypeList"),
            (types, offered, "registry_manifest:evidenceType"),
            (offering, out_(PROVIDED, "evidence_provider", "public_organisation"), "registry_manifest:providedBy"),
            (offering, out_(("registry_manifest:evidenceService", "dcat:accessService"), "data_service"), "registry_manifest:evidenceService"),
        )
        out = None
        for have, want, predicate in rules:
            gap = have.join(want.select("run_id", "source"), ["run_id", "source"], "left_anti").select("run_id", F.col("source").alias("asset_id"), F.lit(predicate).alias("predicate"))
            out = gap if out is None else out.unionByName(gap)
        return out

    def endpoint_gaps(self) -> DataFrame:
        """(run_id, asset_id, predicate): data services that give access to offered evidence and have no endpoint URL."""
        used = self.chain(self.offerings(), self.access_services()).select("run_id", F.col("target").alias("asset_id")).distinct()
        return used.join(self.relations.where("predicate = 'dcat:endpointURL'").select("run_id", F.col("subject_id").alias("asset_id")), ["run_id", "asset_id"], "left_anti").withColumn("predicate", F.lit("dcat:endpointURL"))

    def bundles(self) -> DataFrame:
        """(run_id, source, requirement, option, types, missing, complete): for each service the options of each requirement as the bundle of evidence to hand in."""
        option = self.options().join(self.with_access().withColumn("reached", F.lit(True)), ["run_id", "target"], "left")
        by = option.groupBy("run_id", "requirement", "option").agg(F.array_sort(F.collect_set("target")).alias("types"), F.array_sort(F.collect_set(F.when(F.col("reached").isNull(), F.col("target")))).alias("missing"))
        held = self.requirements().join(self.services(), ["run_id", "source"], "left_semi").select("run_id", "source", F.col("target").alias("requirement"))
        return held.join(by, ["run_id", "requirement"]).withColumn("complete", (F.size("types") > 0) & (F.size("missing") == 0))

    def concept_services(self) -> DataFrame:
        """(concept, data service): data sources for a concept, over the offerings of the evidence types that have it."""
        of = self.concepts().join(self.of_kind("evidence_type").withColumnRenamed("target", "source"), ["run_id", "source"], "left_semi")
        turned = of.select("run_id", F.col("target").alias("source"), F.col("source").alias("target"), *self._way())
        return self.chain(turned, self.chain(self.offerings(), self.access_services()))

    def routes(self) -> DataFrame:
        """(run_id, kind_ord, kind, source, target, path) of everything that a service leads to."""
        access = self.chain(self.service_types(), self.chain(self.offerings(), self.access_services()))
        kinds = (("evidence_type", self.service_types()), ("evidence_provider", self.service_providers()), ("supporting_data_service", self.data_services().join(self.services(), ["run_id", "source"], "left_semi")), ("evidence_access_service", access), ("form", self.forms()))
        out = None
        for k, (kind, found) in enumerate(kinds):
            part = found.select("run_id", F.lit(k).alias("kind_ord"), F.lit(kind).alias("kind"), "source", "target", *(["path"] if self.paths else []))
            out = part if out is None else out.unionByName(part)
        return out

    def provenance(self, paths: DataFrame) -> DataFrame:
        """The claims behind each step of each path."""
        step = paths.select("run_id", "source", "target", F.posexplode("path").alias("step", "relation_id"))
        return step.join(self.claims, ["run_id", "relation_id"])

    def provenance_counts(self, paths: DataFrame) -> DataFrame:
        """(run_id, source, claims, routes, first): the claims behind all steps of a source's paths, its paths, and the first relation of any.

        Steps are counted by relation where the source's paths lie, so a relation that many of them share meets its claims once.
        """
        by = ["run_id", "source"]
        step = paths.select(*by, F.posexplode("path").alias("step", "relation_id")).groupBy(*by, "relation_id").agg(F.count("*").alias("n"), F.count_if(F.col("step") == 0).alias("starts"))
        of = self._dealt(self.claims.select("run_id", "relation_id"), "relation_id").groupBy("run_id", "relation_id").agg(F.count("*").alias("of"))
        met = self._dealt(step, "relation_id").join(of, ["run_id", "relation_id"], "left")
        return met.groupBy(*by).agg(F.sum(F.col("n") * F.coalesce("of", F.lit(0))).alias("claims"), F.sum("starts").alias("routes"), F.min("relation_id").alias("first"))

    def counted(self, slices: int = 1) -> ServiceGraph:
        """The graph of TYPED relations alone, stored, with the number of a relation's claims beside its id: paths carry the counts of their steps. Relations are counted slice by slice of their ids."""
        by, spark = ["run_id", "relation_id"], self.relations.sparkSession
        of_slice = lambda frame, k: self._dealt(frame.where(F.pmod(F.xxhash64("relation_id"), F.lit(slices)) == k), "relation_id")
        own, known = self.relations.where(F.col("predicate").isin(*TYPED)).select(*by, "subject_id", "predicate", "object_id", "seq"), []
        with tidied(spark):
            for k in range(slices):
                of = of_slice(self.claims.select(*by), k).groupBy(*by).agg(F.count("*").alias("of"))
                counted = F.struct("relation_id", F.coalesce("of", F.lit(0)).alias("of"))
                known.append(stored(of_slice(own, k).join(of, by, "left").withColumn("relation_id", counted).drop("of"), "counted"))
        return ServiceGraph(self.assets, reduce(DataFrame.unionByName, known), parts=self.parts)

    def claimed_types(self, slices: int = 1) -> DataFrame:
        """provenance_counts() of service_types(), of a counted() graph: no claim is looked up once paths are many.

        A type falls into one slice with all that leads to it, so what is found of each slice only has to be added, and no more of the paths is on disk at once.
        """
        found = []
        with tidied(self.relations.sparkSession):
            for k in range(slices):
                here = ~F.col("predicate").isin(*SPECIFIES, *ACCEPTS) | (F.pmod(F.xxhash64("object_id"), F.lit(slices)) == k)
                types = ServiceGraph(self.assets, self.relations.where(here), parts=self.parts).service_types()
                claims = F.aggregate("path", F.lit(0).cast("long"), lambda n, step: n + step["of"])
                found.append(stored(types.groupBy("run_id", "source").agg(F.sum(claims).alias("claims"), F.count("*").alias("routes"), F.min(F.array_min("path.relation_id")).alias("first")), "claimed"))
        return reduce(DataFrame.unionByName, found).groupBy("run_id", "source").agg(F.sum("claims").alias("claims"), F.sum("routes").alias("routes"), F.min("first").alias("first"))

    def endpoint_urls(self) -> DataFrame:
        """(source, url): where the first dcat:endpointURL edge of an asset leads."""
        edges = self.relations.where("predicate = 'dcat:endpointURL'")
        uris = self.assets.select("run_id", F.col("id").alias("object_id"), F.col("uri").alias("_uri"))
        named = edges.join(uris, ["run_id", "object_id"], "left").withColumn("url", F.coalesce("_uri", "object_id"))
        return named.groupBy("run_id", F.col("subject_id").alias("source")).agg(F.min_by("url", F.struct("seq", "relation_id")).alias("url"))

    def view(self, iri: str) -> DataFrame:
        """The nested view of one service as one JSON value."""
        one = self.public_service(iri).select("run_id", F.col("id").alias("source"), "uri", "title")
        keys = ["run_id", "source"]
        gather = lambda f, name: f.join(one.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("target", "path"))).alias(name))
        routes = self.routes().join(one.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind_ord", "kind", "target", "path"))).alias("routes"))
        out = one
        for name, f in (("channels", self.channels()), ("requirements", self.requirements()), ("accepted_evidence_types", self.service_types()), ("providers", self.service_providers()), ("forms", self.forms())):
            out = out.join(gather(f, name), keys, "left")
        return out.join(routes, keys, "left").select("run_id", F.to_json(F.struct(F.lit("service-view.v1").alias("schema_version"), *[c for c in (*one.columns[1:], "channels", "requirements", "accepted_evidence_types", "providers", "forms", "routes")])).alias("view"))
