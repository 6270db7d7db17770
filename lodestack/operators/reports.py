"""Relational reports on the registry: completion, readiness, failures, latest tasks, histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import PROBLEMS, SUCCESSFUL, TERMINAL_TASKS, VIDEO_EXTENSIONS, WITHOUT_CONTENT


def open_exclusions(exclusions: DataFrame) -> DataFrame:
    return exclusions.where("revoked_at is null and invalidated_at is null")


def _marked(files: DataFrame, exclusions: DataFrame) -> DataFrame:
    """files not deleted, with `excluded`. One exclusion per file is open at most."""
    now = open_exclusions(exclusions).select(F.col("file_id").alias("__file")).distinct().withColumn("__on", F.lit(True))
    live = files.where(~F.coalesce("is_deleted", F.lit(False)))
    return live.join(now, live.file_id == F.col("__file"), "left").withColumn("excluded", F.coalesce("__on", F.lit(False)))


def root_completion(files: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Per root: discovered, video_excluded, eligible, complete, blocking, manual_excluded, metadata_only_complete."""
    video = F.col("extension").isin(VIDEO_EXTENSIONS)
    counted = ~video & ~F.col("excluded")
    out = _marked(files, exclusions).groupBy("root_id").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(video).alias("video_excluded"),
        F.count_if(counted).alias("eligible"),
        F.count_if(counted & F.col("parse_status").isin(SUCCESSFUL)).alias("complete"),
        F.count_if(F.col("excluded")).alias("manual_excluded"),
        F.count_if(counted & (F.col("parse_status") == "metadata_only")).alias("metadata_only_complete"),
    )
    return out.withColumn("blocking", F.greatest(F.lit(0), F.col("eligible") - F.col("complete")))


def stats(files: DataFrame, exclusions: DataFrame, n_blocks: DataFrame, n_documents: DataFrame) -> DataFrame:
    """One row of corpus counts. n_blocks and n_documents are counted as given."""
    video, excluded, status = F.col("extension").isin(VIDEO_EXTENSIONS), F.col("excluded"), F.col("parse_status")
    counted = ~video & ~excluded
    one = _marked(files, exclusions).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(status.isin("failed", "failed_retryable") & ~excluded).alias("failed"),
        F.count_if(status == "unsupported").alias("unsupported"),
        F.count_if(status.isin(WITHOUT_CONTENT)).alias("metadata_only"),
        F.count_if(video).alias("video_excluded"),
        F.count_if(excluded).alias("manual_excluded_files"),
        F.count_if(counted & (status == "success")).alias("successful_files"),
        F.count_if(counted & (status == "metadata_only")).alias("metadata_only_complete_files"),
    )
    blocks = n_blocks.agg(F.count(F.lit(1)).alias("blocks"))
    documents = n_documents.agg(F.count(F.lit(1)).alias("documents"))
    out = one.join(F.broadcast(blocks)).join(F.broadcast(documents))  # one row each
    eligible = F.col("files") - F.col("video_excluded") - F.col("manual_excluded_files")
    complete = F.col("successful_files") + F.col("metadata_only_complete_files")
    return out.withColumns({"eligible_files": eligible, "complete_files": complete, "blocking_files": F.greatest(F.lit(0), eligible - complete)})


def unfinished_tasks(tasks: DataFrame, files: DataFrame, roots: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Tasks that aren't over, of visible files of enabled roots."""
    live = _marked(files, exclusions).where(~F.col("excluded") & ~F.col("extension").isin(VIDEO_EXTENSIONS)).select("file_id", "root_id")
    on = roots.where("enabled").select("root_id")
    return tasks.where(~F.col("status").isin(TERMINAL_TASKS)).join(live, "file_id").join(on, "root_id")


def readiness(one: DataFrame, roots: DataFrame, runs: DataFrame, unfinished: DataFrame, versions: DataFrame, state: DataFrame) -> DataFrame:
    """One row: the counts of `stats` (one), eight gates, ready and the ordered reasons it isn't."""
    count = lambda df, test, name: df.agg(F.count_if(test).alias(name))
    on = F.coalesce("enabled", F.lit(False))
    staged = versions.where("status = 'staging'").join(roots.select("root_id", "enabled"), "root_id", "left")
    flag = lambda key: (F.col("key") == key) & (F.col("value") == "1")
    rows = [
        roots.agg(F.count_if(on).alias("enabled_roots"), F.count_if(on & (F.coalesce("status", F.lit("")) != "ready")).alias("unready_roots")),
        count(runs, F.col("status") == "running", "active_runs"),
        count(unfinished, F.lit(True), "unfinished_tasks"),
        count(staged, F.col("root_id").isNull() | on, "unpublished_candidates"),
        state.agg(F.coalesce(F.bool_or(flag("content_fts_dirty")), F.lit(False)).alias("content_fts_dirty"), F.coalesce(F.bool_or(flag("full_batch_incomplete")), F.lit(False)).alias("full_batch_incomplete")),
    ]
    out = reduce(lambda a, b: a.join(F.broadcast(b)), rows, one)  # one row each
    gates = {
        "no_enabled_roots": F.col("enabled_roots") <= 0,
        "blocking_files": F.col("blocking_files") > 0,
        "unfinished_tasks": F.col("unfinished_tasks") > 0,
        "active_run": F.col("active_runs") > 0,
        "content_fts_dirty": F.col("content_fts_dirty"),
        "full_batch_incomplete": F.col("full_batch_incomplete"),
        "unready_root": F.col("unready_roots") > 0,
        "unpublished_candidate": F.col("unpublished_candidates") > 0,
    }
    out = out.withColumn("not_ready_reasons", F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in gates.items()))))
    ready = F.size("not_ready_reasons") == 0
    return out.withColumns({"ready": ready, "repairable": (F.col("enabled_roots") > 0) & (F.col("active_runs") == 0) & ~ready})


def latest(rows: DataFrame, by: str, order: str, values: list[str]) -> DataFrame:
    """The row of the largest `order` of each `by`."""
    return rows.groupBy(by).agg(F.max_by(F.struct(order, *values), order).alias("x")).select(by, "x.*")


# Advice for failed files, by error code or status.
ADVICE = {
    "PARSE_NO_PROGRESS": "检查文件是否损坏或位于不稳定存储；修复后重新尝试",
    "PROCESS_WORKER_CRASH": "关闭占用该文件的程序后重试；若重复发生请保留诊断日志",
    "converter": "确认旧版 Office 文件可正常打开且本机转换器可用，然后重新尝试",
    "password_protected": "移除文件密码或提供未加密副本后重新尝试",
    "ocr_failed": "确认图片可读取；可单独打开文件检查后重新尝试",
    "other": "根据错误原因修复源文件或依赖后重新尝试",
}


def advice() -> Column:
    code, status = F.col("parse_error_code"), F.col("parse_status")
    exact = reduce(lambda w, k: w.when(code == k, ADVICE[k]), ("PARSE_NO_PROGRESS", "PROCESS_WORKER_CRASH"), F)
    out = exact.when(code.startswith("LEGACY_") | code.contains("CONVERTER"), ADVICE["converter"])
    return reduce(lambda w, k: w.when(status == k, ADVICE[k]), ("password_protected", "ocr_failed"), out).otherwise(ADVICE["other"])


def failed_files(files: DataFrame, tasks: DataFrame, exclusions: DataFrame, limit: int | None = 500) -> DataFrame:
    """Files with a problem, their latest task's progress and advice, newest first."""
    now = latest(tasks, "file_id", "task_id", ["progress_phase", "progress_cursor"]).drop("task_id")
    bad = _marked(files, exclusions).where(F.col("parse_status").isin(PROBLEMS) & ~F.col("excluded"))
    out = bad.drop("__file", "__on", "excluded").join(now, "file_id", "left")
    out = out.withColumns({"progress_phase": F.coalesce("progress_phase", F.lit("")), "progress_cursor": F.coalesce("progress_cursor", F.lit("")), "scope_state": F.lit("included"), "recovery_advice": advice()})
    return out.orderBy(F.desc("indexed_at"), "file_id").limit(limit) if limit else out


# Columns of the problem list; missing ones are empty.
LISTED = ["path", "filename", "extension", "parse_status", "parse_error_code", "parse_error_message", "parser_name", "indexed_at", "progress_phase", "progress_cursor", "recovery_advice", "reason"]
EXCLUDED_ADVICE = "恢复纳入后重新解析"


def listed(**scopes: DataFrame) -> DataFrame:
    """failed, metadata_only and excluded files as one list of equal columns and a scope_category."""
    out = []
    for scope, df in scopes.items():
        if scope == "excluded":
            df = df.withColumn("recovery_advice", F.lit(EXCLUDED_ADVICE))
            if "created_at" in df.columns:
                df = df.withColumn("indexed_at", F.col("created_at"))
        cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in LISTED]
        out.append(df.select("file_id", *cols, F.lit(scope).alias("scope_category")))
    return reduce(DataFrame.unionByName, out)


def shown_matches(results: DataFrame, expanded: bool = False, few: int = 3) -> DataFrame:
    """matches cut to the first few unless expanded, and how many are hidden."""
    if expanded:
        return results.withColumn("n_hidden", F.lit(0))
    return results.withColumns({"matches": F.slice("matches", 1, few), "n_hidden": F.greatest(F.lit(0), F.size("matches") - few)})


def metadata_only_files(files: DataFrame, limit: int = 500) -> DataFrame:
    return files.where("parse_status = 'metadata_only'").where(~F.coalesce("is_deleted", F.lit(False))).orderBy(F.desc("indexed_at"), "file_id").limit(limit)


def excluded_files(files: DataFrame, exclusions: DataFrame, with_history: bool = False) -> DataFrame:
    """Excluded files with their exclusion; past ones too with history."""
    rows = exclusions if with_history else open_exclusions(exclusions)
    return rows.join(files.withColumnRenamed("indexed_at", "file_indexed_at"), "file_id")


def slowest(metrics: DataFrame, files: DataFrame, n: int = 20) -> DataFrame:
    return metrics.join(files.select("file_id", "path"), "file_id").orderBy(F.desc("parse_ms"), "file_id").limit(n)


def histogram(files: DataFrame, by: list[str], size: str | None = None) -> DataFrame:
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), *([F.sum(size).alias("bytes")] if size else []))


def merge_readiness(tasks: DataFrame, parent: str, ok: Column, failed: Column) -> DataFrame:
    """Per parent: children, confirmed, failed, pending, and whether all are confirmed."""
    out = tasks.groupBy(parent).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("confirmed"), F.count_if(failed).alias("failed"))
    return out.withColumns({"pending": F.col("total") - F.col("confirmed") - F.col("failed"), "ready": (F.col("confirmed") == F.col("total")) & (F.col("failed") == 0)})


def newest(rows: DataFrame, keep: int, *order: Column, by: list[str] | None = None) -> DataFrame:
    """The `keep` first rows; per group of `by` if given."""
    if not by:
        return rows.orderBy(*order).limit(keep)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= keep).drop("__r")


def history(searches: DataFrame, keep: int = 50) -> DataFrame:
    """Each text once, by its last use, the newest `keep`."""
    return searches.groupBy("query_text").agg(F.max("created_at").alias("created_at"), F.max("search_id").alias("search_id")).orderBy(F.desc("search_id")).limit(keep)


def run_totals(reports: DataFrame, sums: list[str]) -> DataFrame:
    """All runs in one row: sums, the highest memory, and whether any was cancelled."""
    return reports.agg(*(F.sum(c).alias(c) for c in sums), F.max("peak_rss_bytes").alias("peak_rss_bytes"), F.bool_or("cancelled").alias("cancelled"))
