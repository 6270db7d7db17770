"""Files as tables: scans, fingerprints, manifests, settings and query lists."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
import zipfile
from dataclasses import dataclass, fields
from dataclasses import field as _field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schemas import EXCLUDED_DIRECTORIES, EXCLUDED_PATTERNS, LEGACY_EXTENSIONS, SUPPORTED_EXTENSIONS, VIDEO_EXTENSIONS

WHOLE_HASH_BYTES = 64 << 20
SAMPLE_BYTES = 4 << 20


def glob_regex(pattern: str) -> str:
    return fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$").replace("(?s:", "(?:")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def hidden_or_excluded(name: Column, patterns: list[str] = EXCLUDED_PATTERNS) -> Column:
    test = name.startswith(".")
    for p in patterns:
        test = test | name.rlike(glob_regex(p))
    return test


def scan(spark: SparkSession, root: str, *, recursive: bool = True, supported_only: bool = True, patterns: list[str] = EXCLUDED_PATTERNS, directories: list[str] = EXCLUDED_DIRECTORIES, content: bool = True) -> DataFrame:
    """path, filename, extension, size_bytes, modified_time (seconds), content of the files below root.

    Unreadable or vanishing files fail the scan, so a partial one never looks
    like deletions. Without `content`, no file is opened.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "false").option("ignoreCorruptFiles", "false").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    parents = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    rows = raw.where(~hidden_or_excluded(name, patterns)).where(~F.arrays_overlap(parents, F.array(*map(F.lit, directories))))
    if supported_only:
        rows = rows.where(extension(F.col("path")).isin(SUPPORTED_EXTENSIONS))
    cols = [F.col("path"), name.alias("filename"), extension(F.col("path")).alias("extension"), F.col("length").alias("size_bytes"), (F.unix_millis("modificationTime") / 1000.0).alias("modified_time")]
    return rows.select(*cols, *(["content"] if content else []))


def quick_fingerprint(size: Column, modified_ms: Column) -> Column:
    return F.concat_ws(":", size.cast("string"), modified_ms.cast("string"))


def zip_directory_digest(data: bytes) -> str | None:
    """SHA-256 over an archive's sorted directory (name, CRC, sizes); None if it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            rows = sorted((i.filename, i.CRC, i.file_size, i.compress_size) for i in z.infolist())
    except zipfile.BadZipFile:
        return None
    return hashlib.sha256(json.dumps(rows, ensure_ascii=False).encode()).hexdigest()


def sampled_digest(data: bytes, piece: int = SAMPLE_BYTES) -> str:
    """SHA-256 over the size and head, middle and tail."""
    middle = max(0, len(data) // 2 - piece // 2)
    return hashlib.sha256(b"|".join([str(len(data)).encode(), data[:piece], data[middle : middle + piece], data[-piece:]])).hexdigest()


@F.pandas_udf(StringType())
def _directory_key(content: pd.Series) -> pd.Series:
    return content.map(lambda b: zip_directory_digest(bytes(b)))


@F.pandas_udf(StringType())
def _sample_key(content: pd.Series) -> pd.Series:
    return content.map(lambda b: sampled_digest(bytes(b)))


def with_content_key(files: DataFrame) -> DataFrame:
    """Adds content_key: sha256, zipdir, sample or metadata, by kind and size of the file.

    Rows are split by rule, so only archives and large files reach Python.
    """
    video = F.col("extension").isin(VIDEO_EXTENSIONS)
    packed = F.col("extension").isin(".docx", ".xlsx", ".xlsm", ".pptx", ".zip")
    large = (F.col("size_bytes") > WHOLE_HASH_BYTES) & ~F.col("extension").isin(LEGACY_EXTENSIONS)
    key = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    whole = key("sha256", F.sha2("content", 256))
    by_name = files.where(video).withColumn("content_key", key("metadata", F.sha2(F.concat_ws("|", "path", "size_bytes", "modified_time"), 256)))
    by_directory = files.where(~video & packed).withColumn("__d", _directory_key("content")).withColumn("content_key", F.coalesce(key("zipdir", F.col("__d")), whole)).drop("__d")
    by_sample = files.where(~video & ~packed & large).withColumn("content_key", key("sample", _sample_key("content")))
    return by_name.unionByName(by_directory).unionByName(by_sample).unionByName(files.where(~video & ~packed & ~large).withColumn("content_key", whole))


def source_changed(at_scan: DataFrame, at_commit: DataFrame) -> DataFrame:
    """Paths whose size or time differ between scan and commit, or that vanished."""
    late = at_commit.select(F.col("path").alias("__p"), F.col("size_bytes").alias("__s"), F.col("modified_time").alias("__m"))
    x = at_scan.join(late, at_scan.path == F.col("__p"), "left")
    return x.where(~(F.col("size_bytes").eqNullSafe(F.col("__s")) & F.col("modified_time").eqNullSafe(F.col("__m")))).select("path", F.lit("SOURCE_CHANGED").alias("error_code"))


# Columns that a failure manifest must have.
MANIFEST_COLUMNS = ["path", "filename", "extension", "parse_status", "parse_error_code", "parse_error_message", "parser_name"]


def failure_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an exported failure list; ValueError if a column is missing or there is no row."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    missing = [c for c in MANIFEST_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"manifest lacks {', '.join(missing)}")
    if not df.limit(1).count():
        raise ValueError("manifest is empty")
    return df


def query_list(text: str) -> list[str]:
    """Queries of a JSON array or {"queries": [...]}: trimmed, each once, in order."""
    data = json.loads(text)
    items = data.get("queries") if isinstance(data, dict) else data
    if not isinstance(items, list):
        raise ValueError("expected a list of queries")
    out = list(dict.fromkeys(str(q).strip() for q in items if str(q).strip()))
    if not out:
        raise ValueError("no queries")
    return out


@dataclass
class Settings:
    """Engine settings; unknown keys of stored ones are dropped and missing ones filled."""

    version: int = 1
    lines_per_block: int = 500
    coalesce_target_chars: int = 4096
    coalesce_max_chars: int = 16384
    max_zip_depth: int = 2
    max_zip_members: int = 10_000
    max_zip_member_bytes: int = 512 << 20
    ocr_min_confidence: float = 0.5
    enable_ocr: bool = False
    excluded_patterns: list[str] = _field(default_factory=lambda: list(EXCLUDED_PATTERNS))
    excluded_directories: list[str] = _field(default_factory=lambda: list(EXCLUDED_DIRECTORIES))

    @classmethod
    def from_dict(cls, data: dict) -> Settings:
        known = {f.name for f in fields(cls)}
        return cls(**({k: v for k, v in data.items() if k in known} | {"version": cls.version}))
