"""Small scalar rules: cursors, keys, formats, classes, and derived settings."""

from __future__ import annotations

import errno
import zipfile
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import VIDEO_EXTENSIONS


def sheet_cursor(sheet: Column, row: Column) -> Column:
    """Sheet in the upper and row in the lower 32 bits of a resume cursor."""
    return F.shiftleft(sheet.cast("long"), 32).bitwiseOR(row.cast("long"))


def cursor_sheet(cursor: Column) -> Column:
    return F.shiftright(cursor, 32).cast("int")


def cursor_row(cursor: Column) -> Column:
    return cursor.bitwiseAND(F.lit(0xFFFFFFFF))


def natural_number(name: Column) -> Column:
    """Number in a part's name, to sort slide2 before slide10; null without one."""
    return F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("long")


def page_key(unit: Column, task_type: Column) -> list[Column]:
    """Sort keys of page units ("page:12"): number, native text before OCR."""
    return [F.substring(unit, 6, 20).try_cast("int"), F.when(task_type == "pdf_ocr_page", 1).otherwise(0)]


def page_identity(page: Column, width: Column, height: Column, images: Column, text: Column) -> Column:
    """Digest by which a page is known again: place, size, images and text."""
    return F.sha2(F.concat_ws("|", page.cast("string"), F.round(width, 3).cast("string"), F.round(height, 3).cast("string"), images.cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256)), 256)


def trimmed(message: Column, most: int = 1000) -> Column:
    """A stored message: up to `most` characters, null if empty."""
    return F.nullif(F.substring(message, 1, most), F.lit(""))


def message_digest(message: Column) -> Column:
    return F.sha2(F.coalesce(message, F.lit("")), 256)


def json_fields(text: Column, schema: str) -> Column:
    """Fields of a JSON text; broken or missing JSON has none."""
    return F.coalesce(F.from_json(F.coalesce(text, F.lit("{}")), schema, {"mode": "PERMISSIVE"}), F.from_json(F.lit("{}"), schema))


def format_elapsed(ms: Column) -> Column:
    """ms below a second, then seconds with two decimals, then minutes and seconds."""
    seconds = ms / 1000.0
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(seconds < 60, F.concat(F.call_function("format_number", seconds, F.lit("0.00")), F.lit(" s"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min "), F.floor(seconds % 60).cast("string"), F.lit(" s")))


# Disk classes by how much they hold back, and their order.
DISKS = {"ssd": 0, "unknown": 1, "hdd": 2, "removable": 3, "network": 4}


def slowest_disk(classes: Column) -> Column:
    """The most constraining class of an array; `unknown` if it is empty."""
    rank = lambda c: reduce(lambda w, kv: w.when(c == kv[0], kv[1]), DISKS.items(), F).otherwise(DISKS["unknown"])
    items = F.transform(classes, lambda c: F.struct(rank(F.lower(F.coalesce(c, F.lit("unknown")))).alias("rank"), F.lower(F.coalesce(c, F.lit("unknown"))).alias("name")))
    return F.coalesce(F.array_max(items)["name"], F.lit("unknown"))


# How a parse status counts.
OUTCOMES = {
    "indexed": ["success"],
    "failed": ["failed", "failed_retryable", "password_protected"],
    "unsupported": ["unsupported"],
    "skipped": ["skipped"],
    "metadata_only": ["metadata_only", "ocr_disabled", "converter_missing"],
    "partial_success": ["partial_success"],
}


def outcome(status: Column, extension: Column) -> Column:
    """Counter that a parsed file belongs to; videos count as excluded, unknown statuses as failed."""
    start = F.when(F.lower(extension).isin(VIDEO_EXTENSIONS), "excluded_video")
    return reduce(lambda w, kv: w.when(status.isin(kv[1]), kv[0]), OUTCOMES.items(), start).otherwise("failed")


def error_code(error: Exception) -> str:
    """Code of a parser's error, for its status row."""
    if isinstance(error, zipfile.BadZipFile):
        return "ZIP_CORRUPT"
    if isinstance(error, ImportError):
        return "PARSER_DEPENDENCY_MISSING"
    if isinstance(error, OSError):
        if getattr(error, "winerror", None) in (32, 33) or error.errno == errno.EBUSY:
            return "FILE_IN_USE"
        if error.errno == errno.EACCES or isinstance(error, PermissionError):
            return "PERMISSION_DENIED"
        return "FILE_NOT_FOUND" if isinstance(error, FileNotFoundError) else "IO_ERROR"
    return "PARSER_ERROR"


def retryable(code: Column) -> Column:
    return code.isin("FILE_IN_USE", "IO_ERROR", "OUT_OF_MEMORY", "PARSE_NO_PROGRESS", "PROCESS_WORKER_CRASH") | code.startswith("SOURCE_CHANGED")


def cluster_settings(executor_mb: int, cores: int, input_gb: float, partition_mb: int = 128) -> dict[str, str]:
    """Spark settings that keep a task's share of the input and of the memory in proportion."""
    share = max(16, executor_mb * 6 // 10 // max(1, cores) // 4)
    n = max(cores * 2, round(input_gb * 1024 / min(partition_mb, share)))
    return {"spark.sql.shuffle.partitions": str(n), "spark.sql.files.maxPartitionBytes": f"{min(partition_mb, share)}m", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
