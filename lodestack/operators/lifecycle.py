"""Incremental maintenance as new snapshots: changes, merges, deletions, exclusions, publishing.

Nothing is updated in place. Each operator takes tables and returns the next
state of one; `Store` writes such states as immutable versions and swaps a small
pointer file once every gate has passed.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXCLUDABLE, TERMINAL_TASKS, VIDEO_EXTENSIONS


def changed_files(scan: DataFrame, files: DataFrame, *, full_hash: bool = False, retry: bool = True) -> DataFrame:
    """scan (path, quick_fingerprint, parser_version, content_hash) with `changed` and the known file_id."""
    old = files.select(F.col("path").alias("__path"), "file_id", F.col("quick_fingerprint").alias("__f"), F.col("parser_version").alias("__v"), F.col("content_hash").alias("__h"), F.col("parse_status").alias("__s"), F.coalesce("is_deleted", F.lit(False)).alias("__deleted"), F.col("extension").alias("__e"))
    x = scan.join(old, scan.path == F.col("__path"), "left")
    video = F.col("__e").isin(VIDEO_EXTENSIONS) & (F.col("__s") == "metadata_only")
    open_status = F.col("__s").isin("pending", "processing", "cancelled", "deleted")
    differs = ~F.col("quick_fingerprint").eqNullSafe(F.col("__f")) | ~F.col("parser_version").eqNullSafe(F.col("__v"))
    if full_hash:
        differs = differs | ~F.col("content_hash").eqNullSafe(F.col("__h"))
    if retry:
        differs = differs | ((F.col("__s") != "success") & ~video)
    return x.withColumn("changed", F.coalesce(F.col("file_id").isNull() | F.col("__deleted") | open_status | differs, F.lit(True))).select("file_id", *scan.columns, "changed")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of new in the place of those with equal keys, and new ones added."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True).select(old.columns)


def replaced_blocks(blocks: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Blocks after documents were parsed again; documents without new blocks keep the old ones."""
    return upserted(blocks, new, [key])


def document_counts(blocks: DataFrame, key: str = "document_id") -> DataFrame:
    return blocks.groupBy(key).agg(F.count(F.lit(1)).alias("block_count"), F.sum(F.length(F.coalesce("raw_text", F.lit("")))).alias("text_chars"))


def deleted_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Live files that a complete scan (path) didn't see, and members of containers among them."""
    live = files.where(~F.coalesce("is_deleted", F.lit(False)))
    gone = live.where("container_file_id is null").join(seen.select("path"), "path", "left_anti")
    inside = live.join(gone.select(F.col("file_id").alias("container_file_id")), "container_file_id", "left_semi")
    return gone.select("file_id", "path").unionByName(inside.select("file_id", "path"))


def marked_deleted(files: DataFrame, gone: DataFrame) -> DataFrame:
    ids = gone.select(F.col("file_id").alias("__gone")).distinct()
    hit = F.col("__gone").isNotNull()
    x = files.join(ids, files.file_id == F.col("__gone"), "left")
    return x.withColumn("is_deleted", F.when(hit, True).otherwise(F.col("is_deleted"))).withColumn("parse_status", F.when(hit, "deleted").otherwise(F.col("parse_status"))).select(files.columns)


def canonical_files(files: DataFrame) -> DataFrame:
    """The smallest live file of each document."""
    return files.where("document_id is not null").where(~F.coalesce("is_deleted", F.lit(False))).groupBy("document_id").agg(F.min("file_id").alias("file_id"))


def reassigned(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Blocks of shared documents, owned by their canonical file from now on."""
    own = canonical_files(files).withColumnsRenamed({"document_id": "__d", "file_id": "__f"})
    return blocks.join(own, blocks.document_id == F.col("__d"), "left").withColumn("file_id", F.coalesce("__f", "file_id")).select(blocks.columns)


def referenced_documents(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents that a live file still has."""
    return documents.join(canonical_files(files).select("document_id"), "document_id", "left_semi")


def linked(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files whose content was parsed already get that document and its status."""
    keys = ["content_key", "parser_name", "parser_version"]
    ok = documents.where(F.col("parse_status").isin("success", "metadata_only")).select(*keys, F.col("document_id").alias("__d"), F.col("parse_status").alias("__s"))
    x = files.join(ok, keys, "left")
    return x.withColumns({"document_id": F.coalesce("__d", "document_id"), "parse_status": F.coalesce("__s", "parse_status")}).select(files.columns)


def synced_members(files: DataFrame, members: DataFrame) -> DataFrame:
    """Files after archives were listed again: members upserted, missing ones deleted, containers done."""
    archives = members.select("container_file_id").distinct()
    stale = files.join(archives, "container_file_id", "left_semi").join(members.select("path"), "path", "left_anti")
    out = marked_deleted(upserted(files, members, ["path"]), stale)
    done = archives.select(F.col("container_file_id").alias("__done"))
    x = out.join(done, out.file_id == F.col("__done"), "left")
    hit = F.col("__done").isNotNull()
    return x.withColumn("parse_status", F.when(hit, "success").otherwise(F.col("parse_status"))).withColumn("parser_name", F.when(hit, "zip_manifest").otherwise(F.col("parser_name"))).select(files.columns)


def invalidated(files: DataFrame, paths: list[str]) -> DataFrame:
    """Files to be parsed again; for an archive member, its container."""
    hit = files.where(F.col("path").isin(paths)).select(F.coalesce("container_file_id", "file_id").alias("__hit")).distinct()
    x = files.join(hit, files.file_id == F.col("__hit"), "left")
    return x.withColumn("quick_fingerprint", F.when(F.col("__hit").isNull(), F.col("quick_fingerprint"))).withColumn("parse_status", F.when(F.col("__hit").isNotNull(), "pending").otherwise(F.col("parse_status"))).select(files.columns)


def video_excluded(files: DataFrame) -> DataFrame:
    return files.withColumn("parse_status", F.when(F.col("extension").isin(VIDEO_EXTENSIONS), "metadata_only").otherwise(F.col("parse_status")))


def _open(exclusions: DataFrame) -> DataFrame:
    return exclusions.where("revoked_at is null and invalidated_at is null")


class ScopeError(ValueError):
    """Files that can't be excluded, with the reason of each."""


def exclusion_problems(files: DataFrame, tasks: DataFrame, exclusions: DataFrame, wanted: DataFrame) -> DataFrame:
    """file_id and problem of wanted files that may not be excluded; empty if all may."""
    known = files.select(F.col("file_id").alias("__f"), "parse_status", "is_deleted")
    busy = tasks.where(F.col("status").isin("running", "spooled")).select(F.col("file_id").alias("__busy")).distinct()
    on = _open(exclusions).select(F.col("file_id").alias("__on")).distinct()
    x = wanted.select("file_id").distinct().join(known, F.col("file_id") == F.col("__f"), "left").join(busy, F.col("file_id") == F.col("__busy"), "left").join(on, F.col("file_id") == F.col("__on"), "left")
    why = F.when(F.col("__f").isNull() | F.coalesce("is_deleted", F.lit(False)), "missing").when(F.col("__on").isNotNull(), "already_excluded").when(F.col("__busy").isNotNull(), "active_task").when(~F.col("parse_status").isin(EXCLUDABLE), "status")
    return x.select("file_id", why.alias("problem")).where("problem is not null")


def excluded(files: DataFrame, tasks: DataFrame, exclusions: DataFrame, wanted: DataFrame, reason: str, now: Column) -> DataFrame:
    """exclusions with one open row more for each wanted file. Raises ScopeError if any may not be."""
    bad = exclusion_problems(files, tasks, exclusions, wanted).limit(20).collect()
    if bad:
        raise ScopeError("; ".join(f"{r['file_id']}: {r['problem']}" for r in bad))
    rows = wanted.select("file_id").distinct().select(F.xxhash64("file_id", F.lit(uuid.uuid4().hex)).alias("exclusion_id"), "file_id", F.lit(reason).alias("reason"), now.alias("created_at"))
    return exclusions.unionByName(rows, allowMissingColumns=True)


def restored(exclusions: DataFrame, ids: list[int], now: Column) -> DataFrame:
    hit = F.col("file_id").isin(ids) & F.col("revoked_at").isNull() & F.col("invalidated_at").isNull()
    return exclusions.withColumn("revoked_at", F.when(hit, now).otherwise(F.col("revoked_at")))


def closed_by_change(exclusions: DataFrame, changed: DataFrame, now: Column) -> DataFrame:
    """Exclusions of files whose source changed end by themselves."""
    ids = changed.select(F.col("file_id").alias("__c")).distinct()
    hit = F.col("__c").isNotNull() & F.col("revoked_at").isNull() & F.col("invalidated_at").isNull()
    return exclusions.join(ids, exclusions.file_id == F.col("__c"), "left").withColumn("invalidated_at", F.when(hit, now).otherwise(F.col("invalidated_at"))).select(exclusions.columns)


def reconciled_tasks(tasks: DataFrame, files: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Open tasks of excluded files are cancelled, those of files that succeeded are invalidated."""
    off = _open(exclusions).select(F.col("file_id").alias("__x")).distinct()
    done = files.where("parse_status = 'success'").select(F.col("file_id").alias("__ok"))
    x = tasks.join(off, tasks.file_id == F.col("__x"), "left").join(done, tasks.file_id == F.col("__ok"), "left")
    is_open = ~F.col("status").isin(TERMINAL_TASKS)
    return x.withColumn("status", F.when(is_open & F.col("__x").isNotNull(), "cancelled").when(is_open & F.col("__ok").isNotNull(), "invalidated").otherwise(F.col("status"))).select(tasks.columns)


def blockers(files: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Files that keep the index from being complete; a forced completion excludes those it may."""
    live = files.where(~F.coalesce("is_deleted", F.lit(False))).where(~F.col("extension").isin(VIDEO_EXTENSIONS)).where(~F.col("parse_status").isin("success", "metadata_only"))
    return live.join(_open(exclusions).select("file_id"), "file_id", "left_anti")


def visible_blocks(blocks: DataFrame, files: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Blocks that at least one live, not excluded file shows: two semi-joins, split on the key."""
    live = files.where(~F.coalesce("is_deleted", F.lit(False))).join(_open(exclusions).select("file_id"), "file_id", "left_anti")
    shared = blocks.where("document_id is not null").join(live.select("document_id"), "document_id", "left_semi")
    single = blocks.where("document_id is null").join(live.select("file_id"), "file_id", "left_semi")
    return shared.select(blocks.columns).unionByName(single.select(blocks.columns))


def added_roots(roots: DataFrame, paths: list[str], enabled: bool = True) -> DataFrame:
    """Roots with paths added or, where known, set anew; status pending."""
    known = F.col("path").isin(paths)
    out = roots.withColumns({"enabled": F.when(known, enabled).otherwise(F.col("enabled")), "status": F.when(known, "pending").otherwise(F.col("status"))})
    new = roots.sparkSession.createDataFrame([(p,) for p in paths], "path string").join(roots.select("path"), "path", "left_anti")
    return out.unionByName(new.select(F.abs(F.xxhash64("path")).alias("root_id"), "path", F.lit(enabled).alias("enabled"), F.lit("pending").alias("status")), allowMissingColumns=True)


def without_root(files: DataFrame, documents: DataFrame, blocks: DataFrame, root_id: int) -> dict[str, DataFrame]:
    """files, documents and blocks after a root is gone: shared blocks move to a remaining file."""
    left = files.where(~F.col("root_id").eqNullSafe(F.lit(root_id)))
    kept = referenced_documents(documents, left)
    single = blocks.where("document_id is null").join(left.select("file_id"), "file_id", "left_semi").select(blocks.columns)
    shared = blocks.where("document_id is not null").join(kept.select("document_id"), "document_id", "left_semi").select(blocks.columns)
    return {"files": left, "documents": kept, "blocks": single.unionByName(reassigned(shared, left))}


def forced_complete(files: DataFrame, tasks: DataFrame, exclusions: DataFrame, reason: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """exclusions with every blocker excluded that may be, and the blockers that may not (file_id, problem)."""
    wanted = blockers(files, exclusions).select("file_id")
    bad = exclusion_problems(files, tasks, exclusions, wanted)
    return excluded(files, tasks, exclusions, wanted.join(bad.select("file_id"), "file_id", "left_anti"), reason, now), bad


def may_publish(files: DataFrame, tasks: DataFrame, exclusions: DataFrame) -> DataFrame:
    """One row: whether no file blocks and no task of a visible file is open."""
    open_tasks = reconciled_tasks(tasks, files, exclusions).where(~F.col("status").isin(TERMINAL_TASKS))
    a = blockers(files, exclusions).agg(F.count(F.lit(1)).alias("n_blockers"))
    b = open_tasks.agg(F.count(F.lit(1)).alias("n_open_tasks"))
    return a.join(F.broadcast(b)).withColumn("may_publish", (F.col("n_blockers") == 0) & (F.col("n_open_tasks") == 0))  # one row each


def planned_pages(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """Page tasks of documents (document_id, source_digest, n_pages, scanned array<int>).

    Native text for every page, OCR for scanned ones; tasks of an older digest are
    invalidated, those of the same one stay.
    """
    pages = documents.select("document_id", "source_digest", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page"), "scanned")
    native = pages.select("document_id", "source_digest", "page", F.lit("pdf_native_page").alias("task_type"))
    ocr = pages.where(F.array_contains("scanned", F.col("page"))).select("document_id", "source_digest", "page", F.lit("pdf_ocr_page").alias("task_type"))
    new = native.unionByName(ocr).withColumns({"unit_key": F.concat(F.lit("page:"), F.col("page").cast("string")), "status": F.lit("queued")})
    now = documents.select(F.col("document_id").alias("__d"), F.col("source_digest").alias("__s"))
    old = existing.join(now, existing.document_id == F.col("__d"), "left")
    stale = F.col("__s").isNotNull() & ~F.col("source_digest").eqNullSafe(F.col("__s")) & ~F.col("status").isin(TERMINAL_TASKS)
    old = old.withColumn("status", F.when(stale, "invalidated").otherwise(F.col("status"))).select(existing.columns)
    return old.unionByName(new.join(existing, ["document_id", "source_digest", "page", "task_type"], "left_anti").select(existing.columns))


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key and change (missing, new, changed) between two snapshots."""
    x = a.select(key, F.col(value).alias("__a"), F.lit(1).alias("__in_a"))
    y = b.select(F.col(key).alias("__key"), F.col(value).alias("__b"), F.lit(1).alias("__in_b"))
    both = x.join(y, F.col(key) == F.col("__key"), "full_outer")
    change = F.when(F.col("__in_b").isNull(), "missing").when(F.col("__in_a").isNull(), "new").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.select(F.coalesce(key, "__key").alias(key), change.alias("change")).where("change is not null")


def integrity(files: DataFrame, documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """check and n_bad: orphans on every foreign key, doubled block places, documents nobody has."""
    def orphans(rows: DataFrame, key: str, other: DataFrame, name: str) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).join(other.select(F.col(name).alias(key)), key, "left_anti")

    checks = {
        "blocks_without_file": orphans(blocks.where("document_id is null"), "file_id", files, "file_id"),
        "blocks_without_document": orphans(blocks, "document_id", documents, "document_id"),
        "files_without_document": orphans(files, "document_id", documents, "document_id"),
        "orphan_documents": documents.join(canonical_files(files), "document_id", "left_anti"),
        "duplicate_blocks": blocks.groupBy(F.coalesce("document_id", -F.col("file_id")).alias("k"), "block_index").count().where("count > 1"),
        "blocks_without_normal_text": blocks.where("normalized_text is null"),
    }
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad") for name, df in checks.items()))


class GateError(RuntimeError):
    """A publish gate is shut; nothing was published."""


class Store:
    """Immutable versions of tables under one folder of any Hadoop file system, and a pointer to the active one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def active(self) -> str | None:
        """Key of the active version; readers resolve it once per query."""
        pointers = self._path(f"{self.path}/active")
        if not self._fs.exists(pointers):
            return None
        done = [s.getPath() for s in self._fs.listStatus(pointers) if s.getLen()]
        return self._content(max(done, key=lambda p: p.getName())) if done else None

    def _content(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, table: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={version or self.active()}/{table}")

    def stage(self, tables: dict[str, DataFrame]) -> str:
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/v={version}/{name}")
        return version

    def discard(self, version: str) -> None:
        if version != self.active():
            self._fs.delete(self._path(f"{self.path}/v={version}"), True)

    def publish(self, version: str, gates: dict[str, DataFrame] | None = None, golden: dict[str, str] | None = None) -> None:
        """Makes version active if every gate's table is empty and golden texts are found in its blocks.

        The pointer is a new file whose name is the next number and whose content
        is the version; readers take the highest number that has content. A file
        system creates a name once, so of two writers that started from one
        state the second fails.
        """
        n = self._next()
        shut = [name for name, df in (gates or {}).items() if df.limit(1).count()]
        for name, text in (golden or {}).items():
            if not self.read("blocks", version).where(F.col("normalized_text").contains(text)).limit(1).count():
                shut.append(f"golden_query {name}")
        if shut:
            raise GateError(", ".join(shut))
        self._point(n, version)

    def _next(self) -> int:
        folder = self._path(f"{self.path}/active")
        if not self._fs.exists(folder):
            return 0
        return max((int(x) + 1 for s in self._fs.listStatus(folder) if (x := s.getPath().getName()).isdigit()), default=0)

    def _point(self, n: int, version: str) -> None:
        try:
            stream = self._fs.create(self._path(f"{self.path}/active/{n:012d}"), False)
        except Py4JJavaError as e:
            raise GateError("another writer published first") from e
        stream.write(bytearray(version.encode()))
        stream.close()


def compare(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """Differences of two indexes: files by content key, and statuses by path."""
    files = snapshot_diff(a["files"], b["files"], "path", "content_key").withColumn("aspect", F.lit("content"))
    status = snapshot_diff(a["files"], b["files"], "path", "parse_status").where("change = 'changed'").withColumn("aspect", F.lit("status"))
    return files.unionByName(status)


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
