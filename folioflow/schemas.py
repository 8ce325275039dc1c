"""Schemas of all tables and files; nothing is inferred."""

from __future__ import annotations

BOX = "struct<x0:double,top:double,x1:double,bottom:double>"
FIGURE_REF = "struct<element_id:string,description:string,decision:string>"

PAGES = "source_file string, page int, text string, total_pages int"
WORDS = "page int, ord int, text string, x0 double, top double, x1 double, bottom double, fontname string, size double"
ELEMENT = (
    f"struct<id:string,type:string,bbox:{BOX},text:string,font_size:double,is_bold:boolean,headers:array<string>,rows:array<array<string>>,"
    "confidence:double,width:double,height:double,image_ref:string>"
)
LAYOUT = f"page_number int, width double, height double, elements array<{ELEMENT}>"
SECTIONS = (
    "doc_id string, ord int, element_id string, type string, heading string, level int, parent_path array<string>, page_range struct<lo:int,hi:int>, "
    f"text string, figures array<{FIGURE_REF}>"
)
CHUNKS = (
    "chunk_id string, doc_id string, text_for_embedding string, chunk_type string, section_path string, section_heading string, section_level int, "
    "page_range struct<lo:int,hi:int>, token_count int, char_count int, chunk_index int, chunk_strategy string, "
    f"referenced_figures array<{FIGURE_REF}>, metadata map<string,string>"
)
EMBEDDED = CHUNKS + ", embedding array<float>, embedding_model string, embedding_model_version string, embedding_dimension int, embedded_at double, content_hash string"
CHECKPOINT = "chunk_id string, content_hash string, model_version string, embedded_at double, vector_path string"
DOCUMENTS_TABLE = (
    "doc_id string, doc_type string, title string, source_system string, source_path string, content_hash string, page_count int, author string, "
    "publication_date date, effective_date date, expiry_date date, access_classification string, access_groups array<string>, pipeline_version string, "
    "metadata map<string,string>, is_deleted boolean, last_ingested_at timestamp, created_at timestamp"
)
RUNS_TABLE = (
    "run_id string, started_at timestamp, completed_at timestamp, status string, pipeline_version string, embedding_model string, "
    "embedding_model_version string, source_file string, operator string, chunks_loaded int, chunks_failed int, error_summary string"
)
CHUNKS_TABLE = (
    "chunk_id string, doc_id string, run_id string, embedding array<float>, embedding_model string, embedding_model_version string, text_for_embedding string, "
    "content_hash string, section_path string, section_heading string, section_level int, page_range struct<lo:int,hi:int>, chunk_index int, chunk_type string, "
    f"chunk_strategy string, token_count int, access_classification string, access_groups array<string>, referenced_figures array<{FIGURE_REF}>, "
    "referenced_tables array<string>, metadata map<string,string>, created_at timestamp, updated_at timestamp"
)
DEAD_LETTERS = EMBEDDED + ", _failed_at double, _run_id string"
