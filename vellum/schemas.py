"""Explicit schemas of the tables the pipeline reads and writes. Order is data: every table carries its order columns."""

from __future__ import annotations

from pyspark.sql.types import StructType

SPAN = "array<struct<start:int,end:int>>"
CHUNK = "array<struct<start:int,end:int,text:string,section_break:boolean,pause:int>>"

CHAPTERS_RAW = "book_id string, chapter_index int, title string, href string, source string, text string, headings array<string>, heading_categories map<string,string>"
CHAPTERS_CLEAN = "book_id string, chapter_index int, source_index int, title string, text string, text_sha256 string, headings array<string>, heading_categories map<string,string>, kind string"
REPORT = "book_id string, chapter_index int, title string, dropped boolean, drop_reason string, cutoff_reason string, raw_chars int, clean_chars int, removed map<string,int>"
CHUNKS = "book_id string, chapter_index int, chapter_id string, chunk_idx int, start int, end int, text string, section_break boolean, pause_multiplier int, duration_ms bigint"
SEGMENTS = "chapter_id string, chunk_idx int, exists boolean, duration_ms bigint"
BOUNDARY_LOG = (
    "book_id string, from_index int, to_index int, trigger_kind string, preloaded boolean, delta_ms double, output_latency_ms double, "
    "base_latency_ms double, playback_rate double, pad_ms int, chapter_switch boolean, audio_context_state string, captured_unix bigint, logged_unix bigint"
)
PLAYBACK = "last_played int, furthest_played int, bookmarks array<struct<index:int,label:string,created_at:bigint>>"
VOICE = "name string, ref_audio string, ref_text string, language string, gender string"
EPUB_ITEMS = "spine_pos int, id string, href string, media_type string, properties string, content binary"
BOOK_META = "title string, authors array<string>, language string, dates array<string>, year string"


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
