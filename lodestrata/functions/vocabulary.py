"""Names, lists and lookup tables of the published vocabularies and of the report format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ARTIFACT_KINDS = (
    "metadata_index", "semantic_model_package", "link_ml_schema", "dcat_catalog", "dcat_profile_catalog", "prof_profile", "prof_resource",
    "shacl", "skos", "json_ld_context", "owl_ontology", "json_schema", "open_api", "ogc_records", "ogc_features", "ogc_landing",
    "did_document", "verifiable_credential", "html_landing_page", "unknown",
)
ARTIFACT_STATUSES = ("fetched", "failed", "unsupported", "skipped", "auth_required", "too_large", "parse_error", "disallowed_by_robots", "unknown")
ASSET_KINDS = (
    "public_service", "channel", "requirement", "information_requirement", "information_concept", "evidence_type", "evidence_type_list",
    "form_definition", "form_section", "form_field", "public_registry_service", "evidence_offering", "evidence_provider", "public_organisation",
    "semantic_model_package", "catalog", "dataset", "data_service", "distribution", "profile", "vocabulary", "vocabulary_term", "class",
    "property", "shape_graph", "concept_scheme", "alignment", "crosswalk", "api_description", "record_collection", "feature_collection",
    "policy", "quality_measurement", "lifecycle_status", "privacy_basis", "trust_artifact", "unknown",
)
SEVERITIES = ("info", "warning", "error", "unknown")
ROUTE_KINDS = ("evidence_type", "evidence_provider", "supporting_data_service", "evidence_access_service", "form")
GAPS = (
    "NoCallableAccessMethod", "OperationDetailsUnavailable", "RequiredIdentifierUnknown", "AuthSchemeUnknown", "PurposePolicyUnknown",
    "LegalBasisUnknown", "DataSharingAgreementUnknown", "PublisherUnknown", "AuthorityUnknown", "SourceOfTruthUnknown", "DomainSystemUnknown",
    "FreshnessUnknown", "ValidationEvidenceMissing", "TrustEvidenceMissing", "IncompleteProfileEvidence",
)
REVIEW_FLAGS = ("SensitiveData", "BoundaryAmbiguous", "PolicyConflict", "PolicyReviewRequired", "ReviewedMappingUsed", "AiAssisted")

#: Types whose assets carry the standard signals of their node, by canonical name.
TYPE_KINDS = {
    "cv:Channel": "channel",
    "cv:PublicOrganisation": "public_organisation",
    "cccev:Requirement": "requirement",
    "cccev:InformationRequirement": "information_requirement",
    "cccev:InformationConcept": "information_concept",
    "cccev:EvidenceType": "evidence_type",
    "cccev:EvidenceTypeList": "evidence_type_list",
    "registry_manifest:FormDefinition": "form_definition",
    "registry_manifest:FormSection": "form_section",
    "registry_manifest:FormField": "form_field",
    "registry_manifest:EvidenceOffering": "evidence_offering",
    "registry_manifest:EvidenceProvider": "evidence_provider",
    "dcat:Catalog": "catalog",
    "dcat:Dataset": "dataset",
    "dcat:DataService": "data_service",
    "dcat:Distribution": "distribution",
    "prof:Profile": "profile",
    "skos:ConceptScheme": "concept_scheme",
}
#: Other names of a type.
TYPE_ALIASES = {"cv:Requirement": "cccev:Requirement", "registry_manifest:Form": "registry_manifest:FormDefinition"}
#: Types without standard signals.
UNSIGNALLED = ("prof:Profile", "skos:ConceptScheme")

PREFIXES = {
    "adms": "http://www.w3.org/ns/adms#",
    "cccev": "http://data.europa.eu/m8g/",
    "cpsv": "http://purl.org/vocab/cpsv#",
    "cv": "http://data.europa.eu/m8g/",
    "dcat": "http://www.w3.org/ns/dcat#",
    "dcatap": "http://data.europa.eu/r5r/",
    "dct": "http://purl.org/dc/terms/",
    "dcterms": "http://purl.org/dc/terms/",
    "dpv": "https://w3id.org/dpv#",
    "dqv": "http://www.w3.org/ns/dqv#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "eli": "http://data.europa.eu/eli/ontology#",
    "odrl": "http://www.w3.org/ns/odrl/2/",
    "owl": "http://www.w3.org/2002/07/owl#",
    "prof": "http://www.w3.org/ns/dx/prof/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "registry_manifest": "https://registry-manifest.dev/ns/v1#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "sh": "http://www.w3.org/ns/shacl#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "vcard": "http://www.w3.org/2006/vcard/ns#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
#: Of the namespace that cv and cccev share, these local names belong to cv.
CV_NAMES = ("hasChannel", "hasCompetentAuthority", "holdsRequirement", "Channel", "PublicOrganisation")
CAPABILITY_PREFIXES = {
    "schema": "https://schema.org/",
    "dcterms": "http://purl.org/dc/terms/",
    "dcat": "http://www.w3.org/ns/dcat#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "sh": "http://www.w3.org/ns/shacl#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
}

RELATION_PREDICATES = (
    "cv:hasChannel", "cv:hasCompetentAuthority", "cv:holdsRequirement", "cpsv:hasInput", "cpsv:produces", "dcterms:type", "dcterms:conformsTo",
    "dcterms:hasPart", "cccev:hasRequirement", "cccev:hasConcept", "cccev:hasEvidenceTypeList", "cccev:specifiesEvidenceType",
    "cccev:isDerivedFrom", "dcat:dataset", "dcat:distribution", "dcat:service", "dcat:accessService", "dcat:servesDataset", "dcat:endpointURL",
    "dcat:endpointDescription", "dcat:landingPage", "dcat:accessURL", "dcat:downloadURL", "dcatap:applicableLegislation",
)
LINK_PREDICATES = (
    "dcat:catalog", "dcat:dataset", "dcat:service", "dcat:distribution", "dcat:landingPage", "dcat:endpointDescription", "dcat:endpointURL",
    "dcat:accessURL", "dcat:downloadURL", "dcat:accessService", "dcat:servesDataset", "dcat:hasPart", "dcterms:hasPart", "dct:hasPart",
    "dcterms:conformsTo", "dct:conformsTo", "dcatap:applicableLegislation", "cpsv:produces", "prof:hasResource", "prof:hasArtifact",
    "prof:isProfileOf", "odrl:hasPolicy", "sh:shapesGraph",
)
FETCHABLE_RELS = ("alternate", "describedby", "profile", "import")
FETCHABLE_PREDICATES = (
    "dcat:catalog", "dcat:hasPart", "dcterms:hasPart", "dct:hasPart", "dcat:endpointDescription", "prof:hasArtifact", "prof:hasResource",
    "prof:isProfileOf", "sh:shapesGraph",
)
HTML_RELS = ("alternate", "describedby", "canonical", "profile")

#: Standard signals; each is also known by dct: for dcterms: and without its prefix.
SIGNALS = (
    "dcterms:publisher", "dcterms:creator", "dcterms:source", "dcterms:provenance", "dcterms:modified", "dcterms:issued",
    "dcterms:accrualPeriodicity", "dcterms:accessRights", "dcterms:rights", "dcterms:license", "dcatap:applicableLegislation",
    "dcatap:availability", "adms:status", "odrl:hasPolicy", "odrl:profile", "cpsv:produces", "dcat:servesDataset", "dcat:accessService",
)
AUTHORITY_SIGNALS = ("dcterms:publisher", "dcterms:creator")
LEGAL_SIGNALS = ("dcatap:applicableLegislation",)
FRESHNESS_SIGNALS = ("dcterms:modified", "dcterms:issued", "dcterms:accrualPeriodicity", "adms:status", "dcatap:availability")
SOURCE_SIGNALS = ("cpsv:produces",)
ODRL_HINTS = (
    "odrl:uid", "odrl:assigner", "odrl:assignee", "odrl:profile", "odrl:permission", "odrl:prohibition", "odrl:obligation", "odrl:target",
    "odrl:action", "odrl:constraint", "odrl:duty", "odrl:leftOperand", "odrl:operator", "odrl:rightOperand", "odrl:unit",
)

TITLE_KEYS = ("dcterms:title", "dct:title", "title", "rdfs:label", "skos:prefLabel", "name")
DESCRIPTION_KEYS = ("dcterms:description", "dct:description", "description")
PUBLISHER_KEYS = ("dcterms:publisher", "dct:publisher", "publisher")
CONFORMS_KEYS = ("dcterms:conformsTo", "dct:conformsTo", "conformsTo")

#: Profile packs in their order: id, label, IRI, and whether a claim of it is a profile claim.
PROFILE_PACKS = (
    ("dcat-ap", "DCAT-AP", "https://semiceu.github.io/DCAT-AP/releases/3.0.0/", True),
    ("breg-dcat-ap", "BRegDCAT-AP", "https://semiceu.github.io/BRegDCAT-AP/", True),
    ("ogc-api-records", "OGC API Records", "http://www.opengis.net/spec/ogcapi-records-1/1.0/conf/core", False),
    ("prof", "Profiles Vocabulary", "https://www.w3.org/TR/dx-prof/", True),
    ("shacl", "SHACL", "https://www.w3.org/TR/shacl/", False),
    ("json-schema", "JSON Schema", "https://json-schema.org/draft/2020-12/schema", False),
    ("openapi", "OpenAPI", "https://spec.openapis.org/oas/v3.1.0", False),
)
JSON_SCHEMA_IRI, OPENAPI_IRI, LINKML_IRI = "https://json-schema.org/draft/2020-12/schema", "https://spec.openapis.org/oas/v3.1.0", "https://w3id.org/linkml"

MEDIA_TYPES = {
    "json": "application/json",
    "jsonld": "application/ld+json",
    "ttl": "text/turtle",
    "yaml": "application/yaml",
    "yml": "application/yaml",
    "toml": "application/toml",
    "html": "text/html",
    "htm": "text/html",
}
DOCUMENT_SUFFIXES = (".json", ".jsonld", ".yaml", ".yml", ".ttl", ".toml")
HTTP_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
SENSITIVE_HEADERS = ("authorization", "cookie", "proxy-authenticate", "proxy-authorization", "set-cookie", "www-authenticate", "x-api-key", "x-auth-token")
KEPT_HEADERS = ("content-type", "content-length", "etag", "last-modified", "link", "location")
SECRET_NAMES = ("token", "access_token", "id_token", "refresh_token", "api_key", "apikey", "key", "secret", "client_secret", "password", "signature", "sig")
FACADE_SECRET_NAMES = ("token", "access_token", "api_key", "apikey", "key", "secret", "password")
WORKBENCH_SECRET_NAMES = ("authorization", "access_token", "api_key", "apikey", "client_secret", "signature", "sig")
WORKBENCH_SECRET_WORDS = ("token", "secret", "password")
REVIEW_WORDS = ("disability", "attendance", "child", "school", "health", "income", "eligibility", "household", "identity")
SENSITIVE_WORDS = ("disability", "health", "income", "eligibility", "household", "identity", "migration", "child", "student", "attendance")

REGISTERABLE = (
    "catalog", "dataset", "record_collection", "feature_collection", "data_service", "api_description", "distribution", "profile",
    "semantic_model_package", "shape_graph", "concept_scheme", "vocabulary", "vocabulary_term", "class", "property", "alignment", "crosswalk",
)
REGISTERABLE_IF_NAMED = ("policy", "quality_measurement", "lifecycle_status", "privacy_basis", "trust_artifact")
STRUCTURED_KINDS = ("class", "property", "shape_graph", "api_description", "data_service", "record_collection", "feature_collection")
CONDITIONS = (
    "HasMachineReadableEntry", "HasRegisterableAsset", "HasStableIdentity", "HasHumanLabel", "HasAccessMethod", "HasSemanticConstraints",
    "HasDeclaredProfile", "HasPolicySignal", "HasTrustSignal", "HasNoBlockingFetchFailures",
)
RECORD_TYPES = {
    "catalog": "catalog",
    "semantic_model_package": "catalog",
    "dataset": "dataset",
    "class": "dataset",
    "data_service": "service",
    "distribution": "distribution",
    "record_collection": "ogc-record-collection",
    "feature_collection": "ogc-feature-collection",
    "api_description": "operation-group",
}
#: Link roles by predicate.
PREDICATE_ROLES = {
    "dcat:dataset": "dataset",
    "dcat:service": "service",
    "dcat:distribution": "distribution",
    "dcat:accessService": "access-service",
    "dcat:servesDataset": "serves-dataset",
    "dcat:endpointDescription": "endpoint-description",
    "dcatap:applicableLegislation": "applicable-legislation",
    "cpsv:produces": "produces",
    "odrl:hasPolicy": "policy",
    "sh:shapesGraph": "shacl",
    "prof:hasArtifact": "profile-resource",
    "prof:hasResource": "profile-resource",
}
#: Labels of standards by a part of their IRI; the first that fits.
STANDARD_LABELS = (
    ("dcat-ap", "DCAT-AP"),
    ("breg", "BRegDCAT-AP"),
    ("base-registry", "BRegDCAT-AP"),
    ("opengis.net/spec/ogcapi-records", "OGC API Records"),
    ("opengis.net/spec/ogcapi-features", "OGC API Features"),
    ("json-schema.org", "JSON Schema"),
    ("openapis.org", "OpenAPI"),
)
PROFILE_WORDS = ("profile", "dcat-ap", "breg")
#: Readiness checklist: id, group, rank.
READINESS = (
    ("identity-catalog", "Identity", "blocking"),
    ("identity-dataset", "Identity", "blocking"),
    ("identity-title", "Identity", "blocking"),
    ("identity-publisher", "Identity", "blocking"),
    ("access-endpoint", "Access", "blocking"),
    ("access-openapi", "Access", "recommended"),
    ("policy-usage", "Policy", "recommended"),
    ("policy-access-rights", "Policy", "recommended"),
    ("policy-legal-basis", "Policy", "recommended"),
    ("trust-evidence", "Trust", "blocking"),
    ("lifecycle-status", "Lifecycle", "recommended"),
    ("lifecycle-contact", "Lifecycle", "recommended"),
    ("validation-profile", "Validation", "blocking"),
    ("validation-timestamp", "Validation", "recommended"),
)


def profile_packs(spark: SparkSession) -> DataFrame:
    """Reference data of seven rows: small by definition, so it may be broadcast."""
    return spark.createDataFrame([(k, *row) for k, row in enumerate(PROFILE_PACKS)], "pack_ord int, pack_id string, label string, standard_iri string, is_profile boolean")
