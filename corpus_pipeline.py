"""A training corpus made from documents, stage by stage.

Each stage calls one operator of lodestack.llm, works on all rows that its
predecessor kept, and is written as Parquet before the next one reads it. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm import decontam, langid, packing, simhash, span_dedup
from lodestack.llm.common import cut_table, fresh, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty and any other texts without a letter.

    The language found isn't a filter. Whole texts are parsed, however long; rows
    that repeat are each kept or dropped; no labelled row means that all stay.
    """
    model = langid.train(langid.sample(docs.select("lang", "text")))
    found = langid.predict(docs, model, keep=docs.columns)
    return found.where("lang_pred <> 'und'").select(docs.columns) if model else found.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the smallest doc_id, ids before nulls.

    Groups are those of simhash.alike: five-word shingles, a similarity of 0.8.
    Rows of one doc_id (or of none) with other texts are documents of their own;
    of rows equal in both, the one with the smallest other columns stays.
    """
    keep = simhash.alike(docs).where("is_first").select("doc_id", "k").distinct()
    rows = docs.alias("d").join(keep.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (simhash.text_key(F.col("d.text")) == F.col("f.k")), "left_semi")
    ordered = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    one = rows.groupBy(F.col("doc_id").alias("__d"), simhash.text_key().alias("__k")).agg(F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("__row"))
    return one.select("__row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated sentence runs; drops documents of which nothing but white space is left.

    Of equal runs the one of the smallest doc_id stays (nulls first, then by text
    hash and place). Null texts stay; rows equal in doc_id and text lose the same.
    n_chars of what was cut is counted anew. Whole texts count.
    """
    count = fresh(docs, "cut")[0]
    found = span_dedup.deduplicate(docs, count=count)
    cut = F.col(count) > 0
    found = found.where(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return found.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark (see decontam.find).

    Null and empty texts contain none; repeated rows go together; texts of any
    length are read whole; an empty benchmark drops nothing.
    """
    return decontam.without(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every document into a batch of its length bucket.

    Null texts and those without words go to bucket 0 unbatched; a text longer
    than the budget has a batch of its own; repeated rows each get their place.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express these stages; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_table(docs)
    return docs
