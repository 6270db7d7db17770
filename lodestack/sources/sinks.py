"""Sinks: batched block writes, CSV exports, checksummed rows, search history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_blocks(blocks: DataFrame, path: str, max_records: int = 200_000) -> None:
    """Blocks sorted by owner, in files of bounded length."""
    blocks.repartition("file_id").sortWithinPartitions("file_id", "block_index").write.option("maxRecordsPerFile", max_records).mode("overwrite").parquet(path)


def stream_blocks(blocks: DataFrame, path: str, checkpoint: str, interval: str = "500 milliseconds"):
    """Appends a stream of blocks; the query's checkpoint makes it exactly-once."""
    return blocks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def export_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file with header and byte order mark, as spreadsheet programs expect it."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    marked = rows.select(text[0].alias("﻿" + columns[0]), *text[1:])
    marked.coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)


def export_summary(rows: DataFrame, path: str) -> None:
    """Failures counted by extension, status and error code."""
    counted = rows.groupBy("extension", "parse_status", "parse_error_code").agg(F.count(F.lit(1)).alias("n_files"))
    export_csv(counted.orderBy(F.desc("n_files"), "extension", "parse_status", "parse_error_code"), path, ["extension", "parse_status", "parse_error_code", "n_files"])


def checked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds a checksum over columns; see `verified`."""
    return rows.withColumn("checksum", F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


def verified(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose checksum still fits."""
    return rows.where(F.col("checksum") == F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


def cache_key(columns: list[str]) -> Column:
    """Key over everything that a cached result depends on."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def pruned_cache(cache: DataFrame, references: DataFrame, keep: int, max_age_seconds: int, now: Column) -> DataFrame:
    """Cache rows to keep: referenced ones, and of the rest the newest `keep` that aren't too old."""
    used = cache.join(references.select("key"), "key", "left_semi")
    rest = cache.join(references.select("key"), "key", "left_anti").where(F.col("created_at") >= now - F.make_interval(secs=F.lit(max_age_seconds)))
    return used.unionByName(rest.orderBy(F.desc("created_at"), "key").limit(keep))
