"""Lifecycle, tasks, geometry, events and postings on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import blocks, geometry, lifecycle, postings, reports, tasks
from lodestack.sources import sinks
from lodestack.streaming import events


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_postings_agree_with_contains(spark, tmp_path):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame(texts, "id long, t string")
    needles = spark.createDataFrame([(k, "".join(rng.choice("abc ") for _ in range(5))) for k in range(30)], "n long, needle string")
    want = sorted(((k, i) for k, x in needles.collect() for i, t in texts if x in t), key=repr)
    assert rows(postings.contained(needles, "n", "needle", df, "id", "t"), "n", "id") == want
    postings.write(postings.build(df, "id", "t"), f"{tmp_path}/p", 4)
    stored = spark.read.parquet(f"{tmp_path}/p")
    found = {r.id for r in postings.lookup(stored, "id", "abca", 4).collect()}
    assert {i for i, t in texts if "abca" in t} <= found <= {i for i, t in texts if "abc" in t and "bca" in t}


def coalesce_plain(bs, target, most):
    out, group, chars = [], [], 0
    for kind, sheet, source, text in bs:
        text = text.strip()
        if not text:
            continue
        if kind not in blocks.MERGEABLE or source != "native_text":
            out += [group] if group else []
            out.append([text])
            group, chars, last = [], 0, None
            continue
        if group and (last != (kind, sheet) or chars + len(text) + 1 > most or kind == "xlsx_row" and len(group) >= 20):
            out.append(group)
            group, chars = [], 0
        chars += len(text) + (1 if group else 0)
        group, last = [*group, text], (kind, sheet)
        if chars >= target:
            out.append(group)
            group, chars = [], 0
    return ["\n".join(g) for g in [*out, *([group] if group else [])]]


def test_coalescing(spark):
    rng = random.Random(9)
    data, want = [], {}
    for f in range(12):
        bs = [(rng.choice(["text", "xlsx_row", "pdf_page", "docx_paragraph"]) if f else "docx_paragraph", rng.choice(["s1", "s2"]) if f > 6 else "", rng.choice(["native_text", "native_text", "native_text", "ocr"]) if f else "native_text", rng.choice([" ", "x" * rng.randint(1, 120), " y  "])) for _ in range(60)]
        data += [(f, i, k, f"loc {i}", t, s, sh) for i, (k, sh, s, t) in enumerate(bs)]
        want[f] = coalesce_plain(bs, 256, 300)
    df = spark.createDataFrame(data, "file_id long, block_index int, block_type string, location_text string, raw_text string, source_type string, sheet_name string")
    got = blocks.coalesced(df, target=256, most=300)
    for f, texts in want.items():
        assert [r.raw_text for r in got.where(F.col("file_id") == f).orderBy("block_index").collect()] == texts
    assert [r.block_index for r in got.where("file_id = 3").orderBy("block_index").collect()] == list(range(len(want[3])))


def test_line_blocks(spark):
    df = spark.createDataFrame([(1, "a\nb\r\nc\n"), (2, ""), (3, None), (4, "x")], "id long, t string")
    got = rows(blocks.line_blocks(df, "id", "t", 2), "id", "block_index", "line_start", "line_end", "location_text", "raw_text")
    assert got == [(1, 0, 1, 2, "第 1-2 行", "a\nb\r"), (1, 1, 3, 3, "第 3-3 行", "c"), (4, 0, 1, 1, "第 1-1 行", "x")]


FILES = "file_id long, path string, extension string, parse_status string, is_deleted boolean, document_id long, container_file_id long, quick_fingerprint string, content_key string, parser_name string, parser_version string, normalized_text string"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(
        [(1, "a.txt", ".txt", "success", False, 7, None, "f", "k1", "t", "1", None), (2, "b.txt", ".txt", "failed", False, None, None, "f", "k1", "t", "1", None), (3, "z.zip", ".zip", "success", False, None, None, "f", None, None, None, None), (4, "z.zip > m", ".txt", "success", False, 7, 3, "f", None, None, None, None), (5, "v.mp4", ".mp4", "metadata_only", False, None, None, "f", None, None, None, None)],
        FILES,
    )


def test_deletion_and_reassignment(spark, files):
    seen = spark.createDataFrame([("b.txt",), ("v.mp4",), ("a.txt",)], "path string")
    gone = lifecycle.deleted_files(files, seen)
    assert rows(gone, "file_id") == [(3,), (4,)]
    after = lifecycle.marked_deleted(files, gone)
    assert rows(after.where("is_deleted"), "file_id", "parse_status") == [(3, "deleted"), (4, "deleted")]
    without_first = lifecycle.marked_deleted(files, files.where("file_id = 1"))
    b = spark.createDataFrame([(10, 1, 7)], "block_id long, file_id long, document_id long")
    assert rows(lifecycle.reassigned(b, without_first), "block_id", "file_id") == [(10, 4)]
    docs = spark.createDataFrame([(7,), (8,)], "document_id long")
    assert rows(lifecycle.referenced_documents(docs, files), "document_id") == [(7,)]


def test_linking_syncing_invalidating(spark, files):
    docs = spark.createDataFrame([(7, "k1", "t", "1", "success")], "document_id long, content_key string, parser_name string, parser_version string, parse_status string")
    assert rows(lifecycle.linked(files, docs).where("file_id = 2"), "document_id", "parse_status") == [(7, "success")]
    members = files.where("file_id = 4").withColumn("path", F.lit("z.zip > new")).withColumn("file_id", F.lit(9).cast("long"))
    synced = lifecycle.synced_members(files, members)
    assert rows(synced.where("container_file_id = 3"), "path", "is_deleted") == [("z.zip > m", True), ("z.zip > new", False)]
    assert rows(synced.where("file_id = 3"), "parser_name") == [("zip_manifest",)]
    assert rows(lifecycle.invalidated(files, ["z.zip > m"]).where("parse_status = 'pending'"), "file_id") == [(3,)]
    assert rows(lifecycle.upserted(files, files.where("file_id = 1").withColumn("parse_status", F.lit("new")), ["path"]).where("file_id = 1"), "parse_status") == [("new",)]


def test_exclusions(spark, files):
    none = spark.createDataFrame([], "exclusion_id long, file_id long, reason string, created_at timestamp, revoked_at timestamp, invalidated_at timestamp")
    jobs = spark.createDataFrame([(1, 2, "queued"), (2, 1, "queued")], "task_id long, file_id long, status string")
    now = F.current_timestamp()
    want = files.where("file_id = 2").select("file_id")
    after = lifecycle.excluded(files, jobs, none, want, "broken", now)
    assert rows(after, "file_id", "reason") == [(2, "broken")]
    with pytest.raises(lifecycle.ScopeError, match="status"):
        lifecycle.excluded(files, jobs, none, files.where("file_id = 1").select("file_id"), "x", now)
    with pytest.raises(lifecycle.ScopeError, match="already"):
        lifecycle.excluded(files, jobs, after, want, "x", now)
    assert rows(lifecycle.reconciled_tasks(jobs, files, after), "task_id", "status") == [(1, "cancelled"), (2, "invalidated")]
    assert lifecycle.blockers(files, none).count() == 1 and lifecycle.blockers(files, after).count() == 0
    assert lifecycle.restored(after, [2], now).where("revoked_at is not null").count() == 1
    assert lifecycle.closed_by_change(after, want, now).where("invalidated_at is not null").count() == 1


def test_publishing(spark, files, tmp_path):
    store = lifecycle.Store(spark, str(tmp_path))
    assert store.active() is None
    b = spark.createDataFrame([(1, "some needle text")], "block_id long, normalized_text string")
    v1 = store.stage({"files": files, "blocks": b})
    with pytest.raises(lifecycle.GateError, match="unfinished"):
        store.publish(v1, {"unfinished": files.where("parse_status = 'failed'")})
    with pytest.raises(lifecycle.GateError, match="golden"):
        store.publish(v1, golden={"g": "absent"})
    assert store.active() is None
    store.publish(v1, {"none": files.limit(0)}, {"g": "needle"})
    v2 = store.stage({"files": files.limit(1), "blocks": b})
    assert store.active() == v1 and store.read("files").count() == 5
    store.publish(v2)
    assert store.active() == v2 and store.read("files").count() == 1
    store.discard(v1)
    store.discard(v2)
    assert store.read("files").count() == 1


def test_one_of_two_publishers_wins(spark, files, tmp_path, monkeypatch):
    a, b = (lifecycle.Store(spark, str(tmp_path / "race")) for _ in range(2))
    v1, v2 = (x.stage({"files": files}) for x in (a, b))
    seen = b._next()
    a.publish(v1)
    monkeypatch.setattr(b, "_next", lambda: seen)  # read before a published
    with pytest.raises(lifecycle.GateError, match="another writer"):
        b.publish(v2)
    assert a.active() == b.active() == v1
    monkeypatch.undo()
    b.publish(v2)
    assert a.active() == v2



def test_integrity_and_compare(spark, files):
    docs = spark.createDataFrame([(7,), (8,)], "document_id long")
    b = spark.createDataFrame([(1, 1, None, 0, "x"), (2, 99, None, 0, "x"), (3, None, 7, 0, "x"), (4, None, 7, 0, None)], "block_id long, file_id long, document_id long, block_index int, normalized_text string")
    assert dict(rows(lifecycle.integrity(files, docs, b), "check", "n_bad")) == {"blocks_without_file": 1, "blocks_without_document": 0, "files_without_document": 0, "orphan_documents": 1, "duplicate_blocks": 1, "blocks_without_normal_text": 1}
    other = files.withColumn("content_key", F.when(F.col("file_id") == 1, "changed").otherwise(F.col("content_key"))).where("file_id <> 5")
    assert rows(lifecycle.compare({"files": files}, {"files": other}), "path", "change", "aspect") == [("a.txt", "changed", "content"), ("v.mp4", "missing", "content")]


def test_batches(spark):
    costs = [5, 5, 5, 20, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(costs)], "g int, i int, px long")
    assert [r.batch for r in tasks.batches(df, "g", "i", {"px": 12}, 4).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 3, 3, 4]


def test_fair_order_and_leases(spark):
    jobs = spark.createDataFrame([("pdf", "s1", 1, False, 1.0, "b"), ("pdf", "s1", 2, False, 1.0, "b"), ("pdf", "s2", 1, True, 1.0, "a"), ("pdf", "s2", 1, False, 1.0, "a")], "lane string, source string, page int, is_ocr boolean, cost double, path string")
    assert [(r.source, r.page, r.is_ocr) for r in tasks.fair_order(jobs).orderBy("lane_order").collect()] == [("s2", 1, False), ("s1", 1, False), ("s2", 1, True), ("s1", 2, False)]
    now = F.timestamp_seconds(F.lit(100))
    held = spark.createDataFrame([(1, "running", "w", None), (2, "queued", None, None)], "task_id long, status string, lease_owner string, result_digest string").withColumn("lease_expires_at", F.timestamp_seconds(F.lit(50)))
    assert tasks.claimable(held, now).count() == 2
    assert tasks.claimable(tasks.leased(held, "me", now, 60), now).count() == 0
    c = spark.createDataFrame([(1, "w", "d1"), (2, "w", "d2")], "task_id long, lease_owner string, result_digest string")
    assert rows(tasks.confirm(held, c), "task_id", "status", "result_digest") == [(1, "confirmed", "d1"), (2, "queued", None)]
    assert rows(tasks.recovered(held), "task_id", "status", "lease_owner") == [(1, "queued", None), (2, "queued", None)]


def test_backend_choice(spark):
    base = [("a", 100.0, "t", 0.9)] * 3
    trial = lambda name, ms, digest="t", conf=0.9, n=3: [(name, ms, digest, conf)] * n
    data = [*base, *trial("fast", 70.0), *trial("faster", 60.0, "other"), *trial("near", 85.0), *trial("few", 10.0, n=2), *trial("unsure", 10.0, conf=0.8)]
    df = spark.createDataFrame(data, "backend string, elapsed_ms double, text_digest string, confidence_mean double").withColumns({"box_digest": F.lit("b"), "error": F.lit(""), "offline": F.lit(True), "confidence_min": F.col("confidence_mean"), "peak_rss_bytes": F.lit(10)})
    got = {r.backend: (r.rejection, r.chosen) for r in tasks.choose_backend(df, "a", 100).collect()}
    assert got == {"a": (None, False), "fast": (None, True), "faster": ("accuracy_digest_mismatch", False), "near": ("speedup_below_20_percent", False), "few": ("requires_three_runs", False), "unsure": ("confidence_regression", False)}


def test_search_estimates(spark):
    df = spark.createDataFrame([("k", i, 100.0, 200) for i in range(3)], "key string, seq int, baseline_ms double, elapsed_ms long")
    got = [(r.lower_ms, r.upper_ms, r.n_samples) for r in tasks.search_estimates(df, ["key"]).orderBy("seq").collect()]
    assert got[0] == (80, 200, 0)
    assert got[1][2] == 1 and got[1][0] == round((100 * 0.47 + 200 * 0.53) * (1 - 0.44))


def test_geometry(spark):
    one = spark.range(1)
    assert one.select(geometry.tile_positions(F.lit(2500), 1000, 200).alias("p")).first().p == [0, 800, 1500]
    assert one.select(geometry.tile_positions(F.lit(900), 1000, 200).alias("p")).first().p == [0]
    lines = spark.createDataFrame([(1, "Hello World", 0.9, 0.0, 0.0, 100.0, 10.0), (1, "hello world!", 0.95, 2.0, 0.0, 101.0, 10.0), (1, "other", 0.5, 0.0, 30.0, 50.0, 40.0)], "img int, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert [r.text for r in geometry.merged_lines(lines, "img").collect()] == ["hello world!", "other"]
    assert geometry.distinct_boxes(lines.withColumn("x2", F.lit(100.0)).withColumn("x1", F.lit(0.0)), "img").count() == 2
    weak = one.select(geometry.needs_tiles(F.lit(3), F.lit(0.9), F.lit(0.0), F.lit(5), F.lit(2), F.lit(False), F.lit(1.0)).alias("w"), geometry.scanned_page(F.lit(" "), F.lit(True)).alias("s")).first()
    assert weak.w and weak.s


def test_semantic_progress(spark):
    data = [(1, 0, "", 0, "", 0), (1, 1, "scan", 0, "", 0), (1, 2, "scan", 0, "page 9", 0), (1, 3, "scan", 0, "page 10", 0), (1, 4, "scan", 0, "page 10", 0), (1, 5, "scan", 0, "row 99", 0), (1, 6, "scan", 1, "row 99", 0), (1, 7, "scan", 0, "row 99", 0), (1, 8, "write", 0, "", 0)]
    df = spark.createDataFrame(data, "task_id int, seq int, phase string, completed long, cursor string, bytes_read long").withColumns({"output_blocks": F.lit(0), "checkpoint_version": F.lit(0)})
    assert [r.is_progress for r in events.progressed(df).orderBy("seq").collect()] == [False, True, True, True, False, False, True, False, True]


def test_hysteresis(spark):
    seq = ["cpu"] * 2 + ["stable"] + ["cpu"] * 4 + ["stable"] * 4
    df = spark.createDataFrame([(1, float(i * 20), c, i == 4) for i, c in enumerate(seq)], "k int, at double, candidate string, paused boolean")
    states = [r.state for r in events.controlled(df, "k", 3, 30.0).orderBy("at").collect()]
    assert states == ["stable"] * 6 + ["cpu"] * 3 + ["stable"] * 2


def test_eta(spark):
    df = spark.createDataFrame([("r", float(t), s, p, r) for t, s, p, r in [(0, 100.2, False, False), (5, 10.0, False, False), (10, 10.0, False, False), (25, 1000.0, True, False), (40, 1000.0, False, False), (41, 7.0, False, True)]], "run string, at double, seconds double, paused boolean, reset boolean")
    assert [r.shown for r in events.displayed(df, "run").orderBy("at").collect()] == [101, 101, 81, 81, 97, 7]
    points = spark.createDataFrame([("r", 0.0, 100, 120.0), ("r", 1.0, 150, 100.0), ("r", 2.0, 90, 90.0)], "run string, at double, shown long, actual double")
    r = events.eta_errors(points, "run").first()
    assert (r.jumps, r.largest_up, r.largest_down) == (2, 50, 60) and r.median_error == pytest.approx(1 / 6)


def test_streams(spark, tmp_path):
    schema = "path string, ts timestamp, root string"
    data = [("a", 0), ("b", 1), ("c", 60), ("d", 120)]
    spark.createDataFrame([(p, s) for p, s in data], "path string, s long").select("path", F.timestamp_seconds("s").alias("ts"), F.lit("r").alias("root")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = events.debounced_stream(stream, ["root"], "ts", "path").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("bursts"), "last_value", "n_events") == [("b", 2), ("c", 1)]
    q = events.deduplicated(stream, ["root"], "ts").writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 1


def test_stateful_controller_stream(spark, tmp_path):
    spark.createDataFrame([(1, float(i * 20), "cpu", False) for i in range(5)], "k int, at double, candidate string, paused boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, at double, candidate string, paused boolean").parquet(f"{tmp_path}/in")
    q = events.controlled_stream(stream, "k").writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.state for r in spark.table("states").orderBy("at").collect()] == ["stable", "stable", "cpu", "cpu", "cpu"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a,\"b\"", ".txt", "failed", "X")], "file_id long, block_index int, path string, extension string, parse_status string, parse_error_code string")
    sinks.export_csv(df, f"{tmp_path}/csv", ["path", "extension"])
    text = next((tmp_path / "csv").glob("part-*.csv")).read_bytes()
    assert text.startswith(b'"\xef\xbb\xbfpath"') or text.startswith(b"\xef\xbb\xbf")
    sinks.export_summary(df, f"{tmp_path}/sum")
    sinks.write_blocks(df, f"{tmp_path}/blocks")
    assert spark.read.parquet(f"{tmp_path}/blocks").count() == 1
    kept = sinks.checked(df, ["path", "extension"])
    assert sinks.verified(kept, ["path", "extension"]).count() == 1
    assert sinks.verified(kept.withColumn("path", F.lit("x")), ["path", "extension"]).count() == 0


def test_history_and_retention(spark):
    df = spark.createDataFrame([(i, q, i) for i, q in enumerate(["a", "b", "a", "c"])], "search_id long, query_text string, created_at long")
    assert [r.query_text for r in reports.history(df, 2).collect()] == ["c", "a"]
    assert reports.newest(df, 3, F.desc("search_id")).count() == 3
