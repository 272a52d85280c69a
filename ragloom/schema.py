"""Column types of the relations, in one place."""

from __future__ import annotations

DOCUMENT = "id string, content string, metadata map<string,string>"
CHUNK = (
    "chunk_id string, text string, raw_text string, source_id string, procedure_slug string, procedure_title string, "
    "section_index int, chunk_index int, previous_chunk_id string, next_chunk_id string, content_hash string, token_count int"
)
SECTION = "procedure_slug string, procedure_title string, text string, section_index int, metadata map<string,string>"
RECORD = "id string, content string, metadata map<string,string>, embedding array<double>, seq long"
HIT = "query_id string, rank int, id string, content string, metadata map<string,string>, score double"
BOUNDARIES = (
    "source_document struct<source_id:string,source_title:string,source_url:string,institution:string,audience:string,"
    "document_type:string>, procedures array<struct<slug:string,title:string,anchor:string,detected_by:string,"
    "query_keywords:array<string>>>"
)
GOLD_QUERY = "id string, question string, expected_procedure string, gold_keywords array<string>"
DIAGNOSTIC_QUERY = (
    "id string, question string, expected_procedure string, in_corpus boolean, expected_behavior struct<"
    "retrieval_confidence:string,must_not_hallucinate:boolean,expected_answer_contains:string>, note string"
)
MANIFEST = ["doc_id", "file_path", "title", "source_url", "retrieved_at", "document_version", "license_or_permission"]
