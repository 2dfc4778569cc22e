"""Explicit schemas of the tables."""

from __future__ import annotations

RAW_PAGES = "title string, requested_title string, html string, fetched_at timestamp"
CHAPTERS = "book string, author string, title string, chapter string, chapter_no int, url string, text string"
CHUNKS = (
    "text string, book string, chapter string, chapter_no int, section string, source string, "
    "chunk_index int, chunks_in_chapter int, start_index int, chunk_id string"
)
INDEX_INFO = "num_chunks bigint, book string, embedding_model string, chunk_size int, chunk_overlap int, num_chapters int, chapters array<string>"
QUESTIONS = "id int, question string, expected_answer string, answerable boolean, evidence_keywords array<string>, expected_source array<string>"
RETRIEVED = "q_id bigint, rank int, chunk_pos bigint, score double, semantic_score double, lexical_score double, hint_score double"
SOURCE = "struct<citation:int, chapter:string, section:string, source:string, text:string>"
