"""Schemas, enumerations and thresholds of the document model, in one place."""

from __future__ import annotations

#: Enumerations of the model.
PROCESSING_STATUS = ("queued", "validating", "extracting_metadata", "extracting_text", "building_chapters", "completed", "failed")
NAVIGATION_KINDS = ("frontmatter", "part", "chapter", "section", "scene", "backmatter")
NAVIGATION_PRECEDENCE = {"frontmatter": 0, "part": 1, "chapter": 2, "section": 3, "scene": 4, "backmatter": 5}
NAVIGATION_LEVEL = {"frontmatter": 1, "part": 1, "chapter": 2, "section": 3, "scene": 4, "backmatter": 1}
BUCKETS = ("No / unusable text", "Weak / missing / nonsense chapters", "Images missing / blank / badly placed", "Cover missing", "Bad paragraph IDs", "Timeout / extreme slowness", "Crash / parse error", "Other")
SOFT_CODES = ("cover_missing", "cover_inline_payload", "images_invalid", "images_inline_payload", "images_undeclared", "weak_chapters", "garbled_text", "ornament_junk", "picture_heavy", "empty_paragraphs")
HARD_CODES = ("unusable_text", "collapsed_paragraphs", "bad_paragraph_ids", "scene_break_density", "too_many_paragraphs", "timeout", "totals_mismatch", "timing_invalid", "other_failure")

#: Thresholds.
MIN_USABLE_WORDS, MIN_USABLE_LETTERS = 50, 150
MAX_PARAGRAPHS = 50_000
MAX_INLINE_MEDIA = 700_000
MAX_FILE_BYTES = 150 * 1024 * 1024
CHUNK_PARAGRAPHS = 50
UTTERANCE_CHARS, TRANSFORMED_CHARS = 1800, 5000
RULE_PATTERN_CHARS, RULE_REPLACEMENT_CHARS, RULES_PER_SCOPE = 200, 120, 300

PARAGRAPH = "id INT, text STRING, sceneBreakBefore STRING"
CHUNK_JSON = f"ARRAY<STRUCT<{PARAGRAPH.replace(' INT', ': INT').replace(' STRING', ': STRING')}>>"
TABLES = {
    "books": "id STRING, title STRING, author STRING, source_uri STRING, cover_path STRING, language STRING, size_bytes BIGINT, total_chunks BIGINT, total_paragraphs BIGINT, total_words BIGINT, processing_status STRING, processing_error STRING, processing_warnings ARRAY<STRUCT<code: STRING, message: STRING>>, created_at BIGINT, updated_at BIGINT",
    "book_chunks": "book_id STRING, chunk_index INT, paragraphs_json STRING",
    "book_chapters": "book_id STRING, chapter_index INT, title STRING, start_paragraph_id INT, kind STRING, level INT",
    "book_images": "book_id STRING, image_index INT, after_paragraph_id INT, alt STRING, src STRING",
    "reading_progress": "book_id STRING, paragraph_id INT, word_index INT, mode STRING, updated_at BIGINT",
    "app_settings": "key STRING, value_json STRING",
    "import_jobs": "book_id STRING, attempt INT, status STRING, error STRING, started_at BIGINT, finished_at BIGINT",
}
