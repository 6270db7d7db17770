"""Schemas and the values that carry meaning in them."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

# Statuses, kinds and extension groups.
SUCCESSFUL = ["success", "metadata_only"]
TERMINAL_TASKS = ["complete", "failed", "superseded", "invalidated", "cancelled"]
EXCLUDABLE = ["failed", "failed_retryable", "unsupported", "skipped", "ocr_disabled", "ocr_failed", "converter_missing", "partial_success", "password_protected"]
PROBLEMS = ["pending", "processing", "cancelled", *EXCLUDABLE]
WITHOUT_CONTENT = ["metadata_only", "skipped", "ocr_disabled", "converter_missing"]
TEXT_EXTENSIONS = [".txt", ".log", ".csv", ".md", ".json", ".xml", ".ini"]
OFFICE_EXTENSIONS = [".docx", ".xlsx", ".xlsm", ".pptx"]
LEGACY_EXTENSIONS = [".doc", ".xls", ".ppt"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff"]
ARCHIVE_EXTENSIONS = [".zip"]
VIDEO_EXTENSIONS = [".mp4", ".avi", ".mov", ".mkv", ".wmv", ".m4v", ".webm"]
SUPPORTED_EXTENSIONS = [*TEXT_EXTENSIONS, ".pdf", *OFFICE_EXTENSIONS, *LEGACY_EXTENSIONS, *IMAGE_EXTENSIONS, *ARCHIVE_EXTENSIONS, *VIDEO_EXTENSIONS]
EXCLUDED_DIRECTORIES = [".git", ".svn", "node_modules", "__pycache__", "$RECYCLE.BIN", "System Volume Information"]
EXCLUDED_PATTERNS = ["~$*.docx", "~$*.xlsx", "~$*.pptx", "*.tmp", "*.temp", "*.part", "*.crdownload"]


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "string": T.StringType(), "map<string;string>": T.MapType(T.StringType(), T.StringType())}


def _struct(text: str) -> T.StructType:
    """Like DDL, but needs no session."""
    fields = [f.split(" ") for f in text.replace("map<string, string>", "map<string;string>").split(", ")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in fields])


BLOCK = _struct(
    "block_id long, file_id long, document_id long, block_index int, block_type string, location_text string, page_number int, slide_number int, "
    "sheet_name string, cell_start string, cell_end string, line_start int, line_end int, raw_text string, normalized_text string, source_type string, "
    "ocr_confidence double, extra map<string, string>"
)
FILE = _struct(
    "file_id long, root_id long, path string, filename string, extension string, size_bytes long, modified_time double, quick_fingerprint string, content_hash string, content_key string, "
    "document_id long, parse_status string, parse_error_code string, parse_error_message string, parser_name string, parser_version string, indexed_at timestamp, last_seen_at timestamp, "
    "is_deleted boolean, source_kind string, container_file_id long, internal_path string"
)
DOCUMENT = _struct("document_id long, content_key string, parser_name string, parser_version string, parse_status string, block_count long, text_chars long")
ROOT = _struct("root_id long, path string, enabled boolean, status string")
TASK = _struct("task_id long, file_id long, parent_task_id long, task_type string, unit_key string, status string, priority int, retry_count int, progress_phase string, progress_cursor string")
EXCLUSION = _struct("exclusion_id long, file_id long, reason string, created_at timestamp, revoked_at timestamp, invalidated_at timestamp")
RUN = _struct("run_id string, status string, started_at timestamp, finished_at timestamp, summary_json string")
VERSION = _struct("version_key string, root_id long, status string, document_count long, block_count long, content_digest string")
#: What a parser returns for a block, besides status and errors.
PARSED = _struct("path string, block_index int, block_type string, location_text string, page_number int, slide_number int, sheet_name string, cell_start string, cell_end string, line_start int, line_end int, raw_text string, source_type string, ocr_confidence double, extra map<string, string>, status string, error_code string, error_message string")
