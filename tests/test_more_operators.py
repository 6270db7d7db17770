"""Scalars, recognition, roots, forced completion, page plans, lists."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from lodestack.functions import scalars
from lodestack.operators import lifecycle, recognition, reports, tasks

from .test_operators import files, rows  # noqa: F401


def test_scalars(spark):
    one = spark.range(1)
    disk = lambda *c: one.select(scalars.slowest_disk(F.array(*map(F.lit, c)).cast("array<string>")).alias("d")).first().d
    assert (disk("ssd", "HDD"), disk("ssd", None), disk(), disk("network", "odd")) == ("hdd", "unknown", "unknown", "network")
    assert [scalars.error_code(e) for e in (zipfile.BadZipFile(), ImportError(), PermissionError(), FileNotFoundError(), OSError(5, "x"), ValueError())] == ["ZIP_CORRUPT", "PARSER_DEPENDENCY_MISSING", "PERMISSION_DENIED", "FILE_NOT_FOUND", "IO_ERROR", "PARSER_ERROR"]
    shown = one.select(*(scalars.format_elapsed(F.lit(ms)).alias(f"m{ms}") for ms in (12, 1500, 61_000))).first()
    assert tuple(shown) == ("12 ms", "1.50 s", "1 min 1 s")
    bad = spark.createDataFrame([("{broken",), (None,), ('{"k": 3}',)], "s string")
    assert [r.k for r in bad.select(scalars.json_fields(F.col("s"), "k int")["k"].alias("k")).collect()] == [None, None, 3]
    units = spark.createDataFrame([("page:10", "pdf_native_page"), ("page:2", "pdf_ocr_page"), ("page:2", "pdf_native_page")], "u string, t string")
    assert [tuple(r) for r in units.orderBy(*scalars.page_key(F.col("u"), F.col("t"))).collect()] == [("page:2", "pdf_native_page"), ("page:2", "pdf_ocr_page"), ("page:10", "pdf_native_page")]
    assert scalars.cluster_settings(3000, 2, 30)["spark.sql.adaptive.enabled"] == "true"


def test_recognition_runs_once_per_key(spark):
    crops = recognition.with_keys(spark.createDataFrame([(1, "a", "m1"), (2, "a", "m1"), (3, "b", "m1"), (4, "c", "m1")], "crop_id int, pixels string, model string"), ["pixels", "model"])
    cache = crops.where("crop_id = 4").select("key", F.lit("cached").alias("lines"))
    seen = []

    def recognise(new):
        seen.append(sorted(r.pixels for r in new.collect()))
        return new.select("key", F.upper("pixels").alias("lines"))

    assert rows(recognition.recognised(crops, cache, recognise), "crop_id", "lines") == [(1, "A"), (2, "A"), (3, "B"), (4, "cached")]
    assert seen == [["a", "b"]]


def test_region_tree(spark):
    images = spark.createDataFrame([("i", 100, 130, [[0, 0, 50, 65]])], "image string, width int, height int, anchors array<array<int>>")
    tree = recognition.region_tree(images, 64)
    leaves = tree.where("state = 'pending'").orderBy(*recognition.region_order()).collect()
    assert sum((r.x2 - r.x1) * (r.y2 - r.y1) for r in leaves) == 100 * 130
    assert leaves[0].heat == 1.0 and (leaves[0].x1, leaves[0].y1) == (0, 0)
    done = tree.withColumn("state", F.when(F.col("state") == "split", "split").when(F.col("heat") > 0, "resolved").otherwise("active"))
    r = recognition.coverage(done).first()
    assert 0.2 < r.coverage < 0.3 and r.n_open > 0
    assert recognition.reclaimed(done).where("state = 'active'").count() == 0


def test_roots(spark, files):  # noqa: F811
    roots = spark.createDataFrame([(1, "d", False, "ready"), (2, "z", True, "ready")], "root_id long, path string, enabled boolean, status string")
    assert rows(lifecycle.added_roots(roots, ["d", "new"]), "path", "enabled", "status") == [("d", True, "pending"), ("new", True, "pending"), ("z", True, "ready")]
    owned = files.withColumn("root_id", F.when(F.col("file_id") == 1, 1).otherwise(2))
    docs = spark.createDataFrame([(7,)], "document_id long")
    b = spark.createDataFrame([(10, 1, 7), (11, 1, None), (12, 2, None)], "block_id long, file_id long, document_id long")
    left = lifecycle.without_root(owned, docs, b, 1)
    assert rows(left["blocks"], "block_id", "file_id") == [(10, 4), (12, 2)] and left["documents"].count() == 1


def test_forced_completion(spark, files):  # noqa: F811
    none = spark.createDataFrame([], "exclusion_id long, file_id long, reason string, created_at timestamp, revoked_at timestamp, invalidated_at timestamp")
    jobs = spark.createDataFrame([(1, 2, "queued")], "task_id long, file_id long, status string")
    more = files.unionByName(files.where("file_id = 2").withColumns({"file_id": F.lit(8).cast("long"), "path": F.lit("p"), "parse_status": F.lit("pending")}))
    after, bad = lifecycle.forced_complete(more, jobs, none, "done", F.current_timestamp())
    assert rows(after, "file_id") == [(2,)] and rows(bad, "file_id", "problem") == [(8, "status")]
    assert not lifecycle.may_publish(more, jobs, none).first().may_publish
    assert lifecycle.may_publish(files, jobs, after).first().may_publish


def test_page_plan(spark):
    docs = spark.createDataFrame([(1, "new", 2, [2])], "document_id long, source_digest string, n_pages int, scanned array<int>")
    old = spark.createDataFrame([(1, "old", 1, "pdf_native_page", "page:1", "queued"), (1, "new", 1, "pdf_native_page", "page:1", "confirmed")], "document_id long, source_digest string, page int, task_type string, unit_key string, status string")
    got = rows(lifecycle.planned_pages(docs, old), "source_digest", "page", "task_type", "status")
    assert got == [("new", 1, "pdf_native_page", "confirmed"), ("new", 2, "pdf_native_page", "queued"), ("new", 2, "pdf_ocr_page", "queued"), ("old", 1, "pdf_native_page", "invalidated")]


def test_micro_batches(spark):
    data = [(1, 0, "a", 50), (2, 5, "b", 1), (3, 6, "a", 40), (4, 7, "a", 20), (5, 8, "a", 1)]
    df = spark.createDataFrame(data, "request_id int, submitted_ms long, compatibility_key string, pixel_count long").withColumn("memory_bytes", F.lit(1))
    batch = lambda now, **k: rows(tasks.micro_batch(df, F.lit(now), k.get("wait", 30), k.get("most", 8), k.get("pixels", 100), 99), "request_id")
    assert batch(10) == [] and batch(40) == [(1,), (3,)] and batch(10, most=2) == [(1,), (3,)] and batch(40, pixels=10) == [(1,)]


def test_shown_matches(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5])], "file_id int, matches array<int>")
    r = reports.shown_matches(df).first()
    assert (r.matches, r.n_hidden) == ([1, 2, 3], 2) and reports.shown_matches(df, True).first().n_hidden == 0
