"""Explicit types of all records, and the fixed tables."""

from __future__ import annotations

SOURCE = "struct<article_ref:string,chunk_id:string,eli_uri:string,source_quote:string>"
JUDGED = "struct<article_ref:string,chunk_id:string,eli_uri:string,source_quote:string,critic_verdict:string,critic_reason:string>"
PASSAGES = "chunk_id string, kind string, chunk_no string, title string, eli_uri string, ref string, parent_ref string, level string, label string, number int, section string, depth int, ord int, text string"
METADATA = "struct<source_url:string,celex:string,retrieved_at:string,sha256:string>"
_POINT0 = "struct<ref:string,label:string,text:string,section:string,points:array<string>>"
_POINT1 = f"struct<ref:string,label:string,text:string,section:string,points:array<{_POINT0}>>"
_POINT2 = f"struct<ref:string,label:string,text:string,section:string,points:array<{_POINT1}>>"
PARAGRAPH = f"struct<ref:string,number:int,text:string,subparagraphs:array<string>,points:array<{_POINT2}>>"
CHUNKS = f"id string, type string, article_number string, annex_number string, title string, eli_uri string, paragraphs array<{PARAGRAPH}>, text string, metadata {METADATA}"
EXTRACTED = "term string, entity_type string, label string, definition string, article_ref string, source_quote string, bearer string, applies_to string, confidence double, chunk_id string, chunk_file string, eli_uri string, model string, cache_key string"
VERIFIED = f"{EXTRACTED}, grounded boolean, grounding_method string, grounding_score double, grounding_reason string, critic_verdict string, critic_reason string, article_refs array<string>, sources array<{JUDGED}>, merged_count int"
DECISIONS = "seq long, id string, term string, entity_type string, critic_verdict string, reviewer string, action string, changes map<string,array<string>>, target string, reason string, timestamp string"
CURATED = f"id string, term string, entity_type string, label string, definition string, bearer string, applies_to string, article_refs array<string>, sources array<{SOURCE}>, confidence double, critic_verdict string, model string, curation_status string, reviewer string, decided_at string, merged_ids array<string>"
TRIPLES = "s string, p string, o string, o_kind string, o_lang string, o_dt string, g string"

# The fields that a reviewer may change, the kinds of entities, and the critic's verdicts.
EDITABLE = ("term", "entity_type", "label", "definition", "bearer", "applies_to")
ENTITY_TYPES = ("AISystemCategory", "ProhibitedPractice", "HighRiskArea", "Actor", "Authority", "Requirement", "Obligation")
VERDICTS = ("supported", "partially", "unsupported")

# How each entity type is built, and the core class that it hangs from.
TYPE_MAP = {
    "AISystemCategory": ("class", "AISystem"),
    "Actor": ("class", "OperatorRole"),
    "Authority": ("class", "Authority"),
    "ProhibitedPractice": ("individual", "ProhibitedPractice"),
    "HighRiskArea": ("individual", "HighRiskArea"),
    "Requirement": ("individual", "Requirement"),
    "Obligation": ("individual", "Obligation"),
}

# Names of bearers and of systems that core classes have too.
BEARER_ALIASES = {
    "provider": "ProviderRole",
    "providers": "ProviderRole",
    "deployer": "DeployerRole",
    "deployers": "DeployerRole",
    "importer": "ImporterRole",
    "distributor": "DistributorRole",
    "authorised representative": "AuthorisedRepresentativeRole",
    "authorized representative": "AuthorisedRepresentativeRole",
    "commission": "Commission",
    "european commission": "Commission",
    "member state": "MemberState",
    "member states": "MemberState",
    "ai office": "AIOffice",
    "national competent authority": "NationalCompetentAuthority",
    "national competent authorities": "NationalCompetentAuthority",
    "market surveillance authority": "MarketSurveillanceAuthority",
    "notifying authority": "NotifyingAuthority",
    "notified body": "NotifiedBody",
}
SYSTEM_ALIASES = {
    "ai system": "AISystem",
    "ai systems": "AISystem",
    "high-risk ai system": "HighRiskAISystem",
    "high-risk ai systems": "HighRiskAISystem",
    "high risk ai system": "HighRiskAISystem",
    "prohibited ai system": "ProhibitedAISystem",
    "limited-risk ai system": "LimitedRiskAISystem",
    "minimal-risk ai system": "MinimalRiskAISystem",
    "general-purpose ai model": "GeneralPurposeAIModel",
    "general purpose ai model": "GeneralPurposeAIModel",
    "gpai model": "GeneralPurposeAIModel",
    "general-purpose ai model with systemic risk": "GPAIModelWithSystemicRisk",
}

# Vocabularies of the Semantic Web.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
PROV = "http://www.w3.org/ns/prov#"
DCTERMS = "http://purl.org/dc/terms/"
#: Default namespace of the entities; every operator that mints or reads their IRIs takes another one.
BASE = "https://example.org/kg#"
