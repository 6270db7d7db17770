"""The driver's tables seen as the engine's: files, blocks, exclusions, roots, tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lifecycle, postings
from .search import stored_blocks


#: Text tables up to this size are dealt out anew: a file of one row group is one task's.
SMALL_BYTES = 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "documents" and 1 << 20 < int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


#: Stored bytes of a task where each row is worth a file, and the most tasks.
TASK_BYTES, MOST_TASKS = 128 << 10, 4096


def spread(df: DataFrame) -> DataFrame:
    """df dealt out by its stored size, for work of a millisecond a row: a small file would be one task's, or a few ones'."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, size // TASK_BYTES)))


def seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))") / 1e6


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: one file per document, its source as root, its language as extension."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.lit(None).cast("long").alias("document_id"), F.substring("source", 4, 10).cast("long").alias("root_id"), F.concat(F.col("source"), F.lit("/"), name).alias("path"), name.alias("filename"),
        F.concat(F.lit("."), F.col("lang")).alias("extension"), F.col("n_chars").alias("size_bytes"), (F.col("doc_id") % 1000).cast("double").alias("modified_time"), F.lit("success").alias("parse_status"),
    )


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _stored(spark: SparkSession, sf_dir: str, table: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table published once a session, then read.

    It goes to the shared folder of spark.checkpoint.dir, else to the warehouse, until the session ends.
    """
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _STORED:
        path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')}/index-{uuid.uuid4().hex}"
        store = lifecycle.Store(spark, path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        store.publish(store.stage({table: make()}))
        _STORED[key] = store.read(table)
    return _STORED[key]


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as stored blocks."""
    return _stored(spark, sf_dir, "blocks", lambda: stored_blocks(document_blocks(spark, sf_dir)))


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored blocks' trigram index: each file holds its segments' grams in order, so a lookup reads the parts of its grams."""
    return _stored(spark, sf_dir, "postings", lambda: postings.segments(stored_documents(spark, sf_dir), "block_id", "normalized_text").sortWithinPartitions("gram"))


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as blocks: one native text block per document."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("block_id"), F.col("doc_id").alias("file_id"), F.lit(None).cast("long").alias("document_id"), F.lit("").alias("location_text"), F.col("text").alias("raw_text"),
        tx.normalized("text").alias("normalized_text"), F.lit("native_text").alias("source_type"), F.lit(None).cast("double").alias("ocr_confidence"),
    )


def toxic_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("timestamp")
    return read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("exclusion_id"), F.col("doc_id").alias("file_id"), null.alias("revoked_at"), null.alias("invalidated_at"))


def scanned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of which those labelled poor count as recognised text of known confidence."""
    poor = read(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("__poor")).distinct()
    x = document_blocks(spark, sf_dir).join(poor, F.col("block_id") == F.col("__poor"), "left")
    is_ocr = F.col("__poor").isNotNull()
    return x.withColumns({"source_type": F.when(is_ocr, "ocr").otherwise("native_text"), "ocr_confidence": F.when(is_ocr, (F.col("block_id") % 100) / 100.0)}).drop("__poor")


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".txt"))
    one = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return one.select(F.col("conv_id").alias("file_id"), F.lit(None).cast("long").alias("document_id"), F.lit(0).cast("long").alias("root_id"), name.alias("path"), name.alias("filename"), F.lit(".txt").alias("extension"), F.lit(0).cast("long").alias("size_bytes"), F.lit(0.0).alias("modified_time"), F.lit("success").alias("parse_status"))


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "ocr").otherwise("native_text")
    return read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("block_id"), F.col("conv_id").alias("file_id"), F.lit(None).cast("long").alias("document_id"), F.col("turn").cast("int").alias("block_index"), F.lit("text").alias("block_type"),
        F.concat(F.lit("turn "), F.lpad(F.col("turn").cast("string"), 3, "0")).alias("location_text"), F.lit(None).cast("string").alias("sheet_name"), F.col("text").alias("raw_text"), tx.normalized("text").alias("normalized_text"), kind.alias("source_type"), F.when(F.col("role") == "assistant", 0.9).alias("ocr_confidence"),
    )


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.lit(None).cast("long").alias("document_id"), F.col("p_size").cast("long").alias("root_id"), F.concat_ws("/", "p_brand", "p_name").alias("path"), F.col("p_name").alias("filename"), F.lit(".part").alias("extension"), F.col("p_size").cast("long").alias("size_bytes"), F.col("p_partkey").cast("double").alias("modified_time"), F.lit("metadata_only").alias("parse_status"))


# How market segments and customer keys stand for registry states.
EXTENSIONS = {"MACHINERY": ".pdf", "BUILDING": ".docx", "AUTOMOBILE": ".mp4", "HOUSEHOLD": ".txt", "FURNITURE": ".xlsx"}
STATUSES = ["success", "success", "success", "metadata_only", "failed", "pending", "password_protected", "ocr_failed", "unsupported", "success"]
CODES = ["", "", "", "", "PARSE_NO_PROGRESS", "", "", "", "LEGACY_OPEN", ""]


def registry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as the file registry: nation is the root, the key decides status and deletion."""
    k = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % 10 + 1).cast("int"))
    kinds = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return read(spark, sf_dir, "customer").select(
        k.alias("file_id"), F.col("c_nationkey").cast("long").alias("root_id"), F.col("c_name").alias("path"), F.col("c_name").alias("filename"), F.element_at(kinds, F.col("c_mktsegment")).alias("extension"), F.abs(F.col("c_acctbal")).cast("long").alias("size_bytes"),
        pick(STATUSES).alias("parse_status"), pick(CODES).alias("parse_error_code"), (k % 23 == 0).alias("is_deleted"), F.when(k % 4 > 0, F.floor(k / 4)).alias("document_id"), F.timestamp_seconds(k * 60).alias("indexed_at"),
        F.when(k % 50 == 7, k - 7).alias("container_file_id"), F.concat(F.lit("f"), (k % 7).cast("string")).alias("quick_fingerprint"), F.lit("1").alias("parser_version"), F.lit("h").alias("content_hash"),
    )


def registry_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, null = F.col("c_custkey"), F.lit(None).cast("timestamp")
    return read(spark, sf_dir, "customer").where(k % 17 == 0).select(k.alias("exclusion_id"), k.alias("file_id"), F.when(k % 34 == 0, F.timestamp_seconds(F.lit(0))).otherwise(null).alias("revoked_at"), null.alias("invalidated_at"))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(k.cast("long").alias("root_id"), F.col("n_name").alias("path"), (k % 5 != 4).alias("enabled"), F.when(k % 3 == 0, "incomplete").otherwise("ready").alias("status"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as parse tasks of files (customers)."""
    s = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("task_id"), F.col("o_custkey").cast("long").alias("file_id"), F.when(s == "F", "complete").when(s == "O", "running").otherwise("queued").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.floor("o_totalprice").cast("long").alias("cost"), F.col("o_orderpriority").alias("progress_phase"), F.col("o_orderstatus").alias("progress_cursor"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
    )


def page_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as page tasks of documents (orders)."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("parent"), F.col("l_linenumber").cast("int").alias("page_number"), F.when(F.col("l_linestatus") == "F", "confirmed").when(F.col("l_returnflag") == "R", "failed").otherwise("queued").alias("status"))


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as progress of tasks (users)."""
    v = F.floor("value").cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("task_id"), F.col("event_id").cast("long").alias("seq"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("phase"), v.alias("completed"),
        F.concat(F.lit("page "), (F.col("event_id") % 50).cast("string")).alias("cursor"), (v * 10).alias("bytes_read"), (v % 3).alias("output_blocks"), F.lit(0).cast("long").alias("checkpoint_version"), seconds().alias("at_seconds"),
    )
