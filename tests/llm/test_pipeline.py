"""run() against a plain version of its stages."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodestack.llm import span_dedup

from . import brute
from .conftest import sentence


def plain_run(rows, items):
    """Rows (doc_id, text) to (doc_id, n_tokens), stage by stage."""
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    rows = list(dict.fromkeys(rows))
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    rows = [r for k, (r, c) in enumerate(zip(rows, brute.alike([t for _, t in rows]))) if k == c]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    cut = lambda t: [x.decode() for x in span_dedup.sentences(t.encode())]
    out = []
    for (i, t), gone in zip(rows, brute.repeated_sentences(rows, cut)):
        left = "".join(p for k, p in enumerate(cut(t)) if k not in gone)
        if brute.words(left):
            out.append((i, left))
    out = [(i, t) for i, t in out if not any(x in t for x in items)]
    return sorted(((i, len(brute.words(t))) for i, t in out), key=repr)


def test_run_equals_plain_run(spark, docs, tmp_path):
    rng = random.Random(11)
    items = [sentence(rng, 20) + " " + sentence(rng, 20) for _ in range(3)]
    extra = spark.createDataFrame([(900 + k, sentence(rng, 12) + " " + x + " " + sentence(rng, 12), "en", "src1", 1) for k, x in enumerate(items)], "doc_id long, text string, lang string, source string, n_chars long")
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=repr) == plain_run(rows, items)


def test_stages_keep_columns(spark, docs, tmp_path):
    spark.createDataFrame([(1, "some benchmark text of seven words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit("x").alias("n_removed"), F.lit(1).alias("__cut"), F.lit(2).alias("is_first"), F.lit("y").alias("__k"), F.lit(0.5).alias("component_id"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, frame, str(tmp_path))
        assert got.dtypes == frame.dtypes, name
        assert got.select("n_removed", "__cut", "is_first", "__k", "component_id").distinct().collect() == [("x", 1, 2, "y", 0.5)]
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0, name
