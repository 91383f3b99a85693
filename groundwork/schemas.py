"""Schemas and value domains of the records."""

from __future__ import annotations

PARSE = ENRICH = PROJECT = ("pending", "running", "complete", "failed")
CHUNK_TYPES = ("abstract", "paragraph", "table", "caption", "reference", "citation_context")
CHUNK_SOURCES = ("docling", "grobid", "derived")
VERDICTS = ("supported", "unsupported")

SPAN = "struct<page:int,bbox:array<double>,char_start:int,char_end:int>"
REFERENCE = "struct<ref_id:string,title:string,authors:array<string>,year:int,venue:string,doi:string,raw_text:string>"
SECTION = "struct<section_id:string,title:string,level:int,path:array<string>>"
TABLE = "struct<table_id:string,caption:string,page:int,bbox:array<double>,rows:array<array<string>>,source:string>"
FIGURE = "struct<figure_id:string,caption:string,page:int,bbox:array<double>>"
RESOLVED = (
    "struct<resolved_title:string,resolved_authors:array<string>,resolved_year:int,resolved_venue:string,"
    "resolution_policy_version:string,resolved_at:timestamp>"
)

EVIDENCE = "chunk_id string, doc_id string, text string, score double, section_path array<string>, page_start int"
SENTENCE = "text string, supporting_chunk_ids array<string>, confidence double"
EVAL_EXAMPLE = (
    "question_id string, doc_id string, question string, passages array<string>, expected_answer string, "
    "requires_abstention boolean"
)
DOCUMENT = (
    "doc_id string, version_id string, sha256 string, source_uri string, parse_status string, enrichment_status string, "
    "docling_title string, docling_authors array<string>, docling_year int, grobid_title string, "
    f"grobid_title_confidence double, grobid_authors array<string>, grobid_year int, grobid_venue string, resolved_fields {RESOLVED}, "
    f"sections array<{SECTION}>, tables array<{TABLE}>, figures array<{FIGURE}>, references array<{REFERENCE}>, "
    "parse_retry_count int, enrichment_retry_count int, is_body_searchable boolean, is_enriched_searchable boolean, "
    "has_reference_graph boolean, has_citation_contexts boolean, created_at timestamp, updated_at timestamp, metadata string"
)
CHUNK = (
    f"chunk_id string, doc_id string, version_id string, parent_chunk_id string, text string, chunk_type string, source string, span {SPAN}, "
    "section_path array<string>, title string, authors array<string>, year int, venue string, language string, "
    "citation_density double, docling_version string, grobid_version string, embedding_model_version string, metadata string"
)
PROJECTION = (
    "doc_id string, version_id string, lexical_version int, vector_version int, status string, "
    "enriched_projection_applied boolean, retry_count int, last_error string, updated_at timestamp"
)
RUN = (
    "run_id string, doc_id string, version_id string, triggered_by string, started_at timestamp, parsed_at timestamp, "
    "enriched_at timestamp, activated_at timestamp, chunks_created int, references_extracted int, status string, error string"
)

#: The pipeline's events in the order of a run without failures.
EVENT_TYPES = (
    "document_uploaded",
    "document_parsed",
    "body_chunks_indexed",
    "enrichment_requested",
    "enrichment_completed",
    "metadata_reindexed",
    "reference_chunks_indexed",
    "search_projection_activated",
)
EVENT = (
    "event_id string, event_type string, doc_id string, version_id string, occurred_at timestamp, source_uri string, "
    "sha256 string, docling_version string, chunks_created int, parse_duration_ms int, chunks_indexed int, "
    "embedding_model_version string, run_id string, grobid_version string, references_extracted int, authors_extracted int, "
    "enrich_duration_ms int, fields_updated array<string>, lexical_projection_version int, vector_projection_version int, "
    "enriched_projection_applied boolean, _corrupt_record string"
)
#: What a missing field stands for.
DEFAULTS = {
    "documents": {
        "parse_status": "pending", "enrichment_status": "pending", "parse_retry_count": 0, "enrichment_retry_count": 0,
        "is_body_searchable": False, "is_enriched_searchable": False, "has_reference_graph": False, "has_citation_contexts": False,
    },
    "chunks": {"language": "en", "citation_density": 0.0},
    "projections": {"lexical_version": 0, "vector_version": 0, "status": "pending", "enriched_projection_applied": False, "retry_count": 0},
    "runs": {"triggered_by": "api", "chunks_created": 0, "references_extracted": 0},
}
