"""Search end to end on small tables: what is easy to get wrong."""

from __future__ import annotations

import pytest

from lodestack.functions import text as tx
from lodestack.plans.search import IndexNotReadyError, SearchEngine, of_files
from lodestack.query import SearchQuery

FILES = "file_id long, document_id long, root_id long, path string, filename string, extension string, size_bytes long, modified_time double, parse_status string, is_deleted boolean"
BLOCKS = "block_id long, file_id long, document_id long, location_text string, raw_text string, source_type string, ocr_confidence double"


def engine(spark, files, blocks, exclusions=None, readiness=None):
    f = spark.createDataFrame([(i, doc, 1, p, p.split("/")[-1], "." + p.split(".")[-1], 10, float(i), "success", False) for i, doc, p in files], FILES)
    b = spark.createDataFrame([(k, fid, doc, loc, raw, kind, conf) for k, (fid, doc, loc, raw, kind, conf) in enumerate(blocks)], BLOCKS)
    e = spark.createDataFrame([(i, None, None) for i in exclusions or []], "file_id long, revoked_at timestamp, invalidated_at timestamp")
    return SearchEngine(f, b.withColumn("normalized_text", tx.normalized("raw_text")), e, readiness)


def ids(results):
    return sorted(r.file_id for r in results.collect())


@pytest.fixture(scope="module")
def small(spark):
    files = [(1, None, "d/sensor.txt"), (2, None, "d/alpha-report.txt"), (3, 7, "d/a.docx"), (4, 7, "d/copy.docx"), (5, None, "z/arc.zip > in/x.txt"), (6, None, "d/scan.png")]
    blocks = [
        (1, None, "第 1-1 行", "操作时请拔掉3 个传感器。", "native_text", None),
        (2, None, "第 1-1 行", "alpha appears again in the body alpha", "native_text", None),
        (2, None, "第 2-2 行", "Alpha Beta", "native_text", None),
        (3, 7, "段落 1", "needle abc123 X Y Z", "native_text", None),
        (3, None, "own", "own block needle", "native_text", None),
        (5, None, "第 1-1 行", "needle in archive", None, None),
        (6, None, "", "needle blurred", "ocr", 0.4),
        (6, None, "p2", "needle sharp", "ocr", 0.95),
    ]
    return engine(spark, files, blocks, exclusions=[])


def test_shared_documents_show_every_path(small):
    assert ids(small.results(SearchQuery("needle"))) == [3, 4, 5, 6]
    assert of_files(small.blocks, small.files.select("file_id", "document_id")).where("block_id = 4").count() == 1


def test_cjk_ignores_spaces(small):
    page = small.search(SearchQuery("拔掉 3 个传感器"))
    row = page.results.first()
    assert (row.file_id, row.hit_count) == (1, 1) and "拔掉3 个传感器" in row.context


def test_scores_add_bonus_per_row(small):
    row = small.results(SearchQuery("alpha")).first()
    assert row.score == (2 + 500) + (1 + 500) and row.hit_count == 3 and len(row.matches) == 2
    row = small.results(SearchQuery("alpha", search_filename=True)).first()
    assert row.score == 1003 + 1 + 500 + 50 and [m.source_type for m in row.matches] == ["metadata", "native_text", "native_text"]
    assert row.source_type == "native_text" and row.location_text == "文件名/路径、第 1-1 行、第 2-2 行"


def test_modes(small):
    assert ids(small.results(SearchQuery("again body", mode="all"))) == [2]
    assert ids(small.results(SearchQuery("beta 传感器", mode="any"))) == [1, 2]
    assert ids(small.results(SearchQuery(r"abc\d+", mode="regex"))) == [3, 4]
    assert ids(small.results(SearchQuery("XYZ", ignore_spaces=True))) == [3, 4]
    assert ids(small.results(SearchQuery("docx copy", mode="filename"))) == [4]
    assert ids(small.results(SearchQuery("d/sensor", search_content=False, search_path=True))) == [1]


def test_regex_on_stripped_text_may_have_no_hits(small):
    row = small.results(SearchQuery("XYZ", mode="regex", ignore_spaces=True)).first()
    assert row.hit_count == 1 and row.score == 0  # counted on raw text


def test_case(small):
    assert ids(small.results(SearchQuery("Alpha", case_sensitive=True))) == [2]
    assert ids(small.results(SearchQuery("Alpha", case_sensitive=True, compat=True))) == []


def test_ocr_confidence(small):
    row = [r for r in small.results(SearchQuery("needle")).collect() if r.file_id == 6][0]
    assert row.ocr_confidence == 0.95 and not row.has_fuzzy_match and row.score == 1 - 25
    fuzzy = [r for r in small.results(SearchQuery("needle", allow_ocr_fuzzy=True)).collect() if r.file_id == 6][0]
    assert fuzzy.has_fuzzy_match and fuzzy.location_text == "OCR、p2"
    assert 6 not in ids(small.results(SearchQuery("needle", include_ocr=False)))


def test_archive_location_and_null_source(small):
    row = [r for r in small.results(SearchQuery("archive")).collect()][0]
    assert row.location_text == "arc.zip > in/x.txt > 第 1-1 行" and row.source_type == "native_text"


def test_filters_and_exclusions(spark, small):
    assert ids(small.results(SearchQuery("needle", extensions=["docx"]))) == [3, 4]
    assert ids(small.results(SearchQuery("needle", root_ids=[9]))) == []
    hidden = SearchEngine(small.files, small.blocks, spark.createDataFrame([(3, None, None), (4, None, None)], "file_id long, revoked_at timestamp, invalidated_at timestamp"))
    assert ids(hidden.results(SearchQuery("needle"))) == [5, 6]


def test_many_queries_share_a_scan(small):
    queries = [SearchQuery("needle"), SearchQuery("again body", mode="all"), SearchQuery("alpha sharp", mode="any")]
    got = small.search_many(queries)
    for i, q in enumerate(queries):
        one = {(r.file_id, r.score, r.hit_count, r.location_text) for r in small.results(q).collect()}
        assert {(r.file_id, r.score, r.hit_count, r.location_text) for r in got.where(f"query_index = {i}").collect()} == one
    mixed = small.search_many([SearchQuery("needle"), SearchQuery(r"abc\d+", mode="regex")])
    assert sorted((r.query_index, r.file_id) for r in mixed.collect()) == [(0, 3), (0, 4), (0, 5), (0, 6), (1, 3), (1, 4)]


def test_empty_terms_and_readiness(spark, small):
    assert small.search(SearchQuery("  ")).results.count() == 0
    shut = spark.createDataFrame([(False, ["unfinished_tasks"])], "ready boolean, not_ready_reasons array<string>")
    with pytest.raises(IndexNotReadyError, match="unfinished_tasks"):
        SearchEngine(small.files, small.blocks, None, shut).search(SearchQuery("x"))


def test_many_results_are_capped_and_paged(spark):
    n = 5001
    many = engine(spark, [(i, None, f"d/f{i:05d}.txt") for i in range(n)], [(i, None, "", "needle", "native_text", None) for i in range(n)])
    page = many.search(SearchQuery("needle", page=10, page_size=100), with_context=False)
    assert (page.total_confirmed(), page.available(), page.truncated()) == (n, 1000, True)
    assert [r.file_id for r in page.results.collect()] == list(range(n - 901, n - 1001, -1))
    assert many.search(SearchQuery("needle", page=11), with_context=False).results.count() == 0
    assert many.search(SearchQuery("needle", max_results=None, page=50, page_size=100), with_context=False).results.count() == 100


def plan_text(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_plans(small):
    text = plan_text(small.results(SearchQuery("needle")))
    assert "NestedLoop" not in text and "CartesianProduct" not in text and "EvalPython" not in text
