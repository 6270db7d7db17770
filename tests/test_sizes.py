"""What keeps a query's seconds and memory in proportion to its input: tasks, batches and bounded rows."""

from __future__ import annotations

from unicodedata import normalize as unicodedata_normalize

import pyarrow as pa
import pytest

from lodestack.functions import text as tx
from lodestack.operators import geometry, postings, recognition
from lodestack.plans import catalog, samples, views
from lodestack.plans.search import SearchEngine
from lodestack.query import SearchQuery
from lodestack.sources import pdf

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("extension", sorted(samples.MAKERS))
def test_files_of_a_small_table_are_dealt_out(spark, extension):
    files = samples.part_files(spark, SF, extension)
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_an_object_is_read_once(monkeypatch):
    data = samples.pdf(samples.Row(1, "large (ring)", "Brand#7", "LARGE", 33))
    read = []
    value = pdf.value
    monkeypatch.setattr(pdf, "value", lambda data, at: read.append(at) or value(data, at))
    assert [p["text"] for p in pdf.read(data)] == ["large (ring)\nBrand#7", "LARGE"]
    assert len(read) == len(set(read))


def test_tokens_behind_comments_and_brackets():
    found = [x for x, _ in pdf.tokens(b"/A#42 12 -3.5 (a(b)\\)c) (plain) <41> [ 1 0 R ] % (no) 7")]
    assert found == ["AB", 12, -3.5, b"a(b))c", b"plain", b"A", b"[", 1, 0, b"R", b"]"]


def test_region_trees_are_dealt_out_and_leave_in_batches(spark):
    assert catalog.queries()["region_tree"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    one = spark.createDataFrame([("i", 64 << 7, 64 << 7, [[0, 0, 9, 9]]), ("none", 64, 64, None)], "image string, width int, height int, anchors array<array<int>>").coalesce(1)
    tree = recognition.region_tree(one, 64)
    assert tree.count() == sum(4**k for k in range(8)) + 1 and tree.dropDuplicates(["region_id"]).count() == tree.count()
    assert max(tree.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) == tree.count()


LINES = [("a", "Hello world", 0.5, 0.0, 0.0, 100.0, 10.0), ("a", "hello, world!", 0.9, 5.0, 0.0, 105.0, 10.0), ("b", "x", None, 0.0, 50.0, 9.0, 60.0), ("b", "x", 0.1, 0.0, 50.0, 9.0, 60.0), (None, "y", 0.2, 0.0, 0.0, 9.0, 9.0), (None, "z", 0.2, 50.0, 0.0, 59.0, 9.0)]


def test_lines_of_many_images_need_no_frame_each(spark):
    lines = spark.createDataFrame(LINES, "img string, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    merged = geometry.merged_lines(lines, "img")
    assert sorted((r.img or "", r.text, r.confidence) for r in merged.collect()) == [("", "y", 0.2), ("", "z", 0.2), ("a", "hello, world!", 0.9), ("b", "x", 0.1)]
    assert "InPandas" not in merged._jdf.queryExecution().toString()


def test_boxes_of_many_images_need_no_frame_each(spark):
    lines = spark.createDataFrame(LINES, "img string, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    boxes = geometry.distinct_boxes(lines, "img")
    assert sorted((r.img or "", r.x1) for r in boxes.collect()) == [("", 0.0), ("", 50.0), ("a", 0.0), ("a", 5.0), ("b", 0.0)]
    assert "InPandas" not in boxes._jdf.queryExecution().toString()


def test_runs_of_white_space_become_one_space(spark):
    blank = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and (c.isspace() or ord(c) < 32 or ord(c) == 127)]
    texts = [f"a{c}b {c}c{c} d{c}{c}e  f {mark}" for c in blank for mark in ("", "é", "​é﻿")]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for flags in ({}, {"ignore_spaces": True}, {"ignore_hyphens": True, "case_sensitive": True}):
        got = {r.i: r.n for r in df.select("i", tx.normalized("s", **flags).alias("n")).collect()}
        assert got == {i: tx.normalize(s, **flags) for i, s in enumerate(texts)}


def test_composing_passes_on_what_is_composed_and_works_in_slices(monkeypatch):
    seen = []
    monkeypatch.setattr(tx.unicodedata, "normalize", lambda form, s: seen.append(s) or unicodedata_normalize(form, s))
    texts = pa.array(["plain", None, "é", "é", "ﬁ"] * 100)
    assert tx._composed(texts).to_pylist() == ["plain", None, "é", "é", "fi"] * 100
    assert len(seen) == 300 and tx._composed(texts.slice(0, 0)).to_pylist() == []


def test_segments_hold_each_gram_once_for_each_row(spark):
    rows = spark.createDataFrame([(1, "abcabc"), (2, "xabc😀é"), (3, None), (4, "ab"), (5, "")], "id long, t string").coalesce(1)
    found = postings.segments(rows, "id", "t").collect()
    assert [r.gram for r in found] == sorted({r.gram for r in found})  # a row for a gram, not one for each gram and id
    assert {r.gram: r.ids for r in found} == {"abc": [1, 2], "bca": [1], "cab": [1], "xab": [2], "bc😀": [2], "c😀é": [2]}


def test_a_short_term_opens_no_index(spark):
    def index():
        raise AssertionError("a scan needs no index")

    engine = SearchEngine(views.document_files(spark, SF), views.document_blocks(spark, SF), index=index)
    assert engine.results(SearchQuery("ß")).count() >= 0
    with pytest.raises(AssertionError):
        engine.results(SearchQuery("inan"))


def test_needles_of_every_length(spark):
    texts = {1: "abcde", 2: "xbcdy", 3: None, 4: "", 5: "é😀z", 6: "ab"}
    needles = {1: "b", 2: "bc", 3: "bcd", 4: "abcde", 5: "", 6: "😀", 7: "é😀z", 8: "nowhere"}
    got = postings.contained(spark.createDataFrame(list(needles.items()), "n long, s string"), "n", "s", spark.createDataFrame(list(texts.items()), "id long, t string"), "id", "t")
    assert sorted((r.n, r.id) for r in got.collect()) == sorted((n, i) for n, s in needles.items() for i, t in texts.items() if t is not None and s in t)
    assert "regexp_extract_all" not in got._jdf.queryExecution().toString()
