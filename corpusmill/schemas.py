"""Schemas of the tables, as DDL strings. The names of the fields."""

DOCUMENT = (
    "source_id string, source_type string, document_id string, document_path string, document_sha256 string, title string, "
    "producer string, raw_text string, loader_verdict string, loader_version string, page_texts array<string>, error string"
)
CHUNK = (
    "source_id string, source_type string, document_id string, document_path string, document_sha256 string, ingest_generation int, "
    "title string, chunk_index int, chunk_start_word int, chunk_end_word int, heading_path string, pdf_page int, "
    "tags array<string>, producer string, ingested_at timestamp, loader_version string, chunker_version string, embedding_model string, "
    "text string, point_id string, dense array<float>, sparse struct<indices:array<int>,values:array<float>>"
)
#: One row for each step of a generation: pending, active, retired or failed, and the write that it speaks of.
#: The last by ``seq`` holds; chunks of any other write of the generation are no longer read.
GENERATION_STATE = "document_id string, ingest_generation int, state string, seq bigint, at timestamp, write_id string, document_sha256 string"
JOURNAL = (
    "ts timestamp, event string, run_id string, ask_id string, ingest_id string, attempt_id string, agent string, gate string, "
    "gate_score double, verdict string, model string, escalated int, tokens int, spend double, detail map<string,string>"
)
#: The fields of a search result, after its score.
CITATION = [
    "point_id", "source_id", "source_type", "document_id", "document_path", "document_sha256", "title", "chunk_index",
    "heading_path", "pdf_page", "tags", "text", "producer", "ingested_at", "ingest_generation",
]
