"""Packing into length buckets that minimise padding.

One pass counts documents by length. Dynamic programming over this global
histogram chooses the boundaries of up to `buckets` buckets so that padding
every document to its bucket's boundary costs least. Batches form inside each
bucket: a bucket of boundary L takes `budget` // L documents a batch.

The histogram has one bin per length up to FINE; beyond, lengths share bins of
1/64 of their size (a bin's boundary is the longest length in it, so every
document fits). That bounds the programme's input for any corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_table

FINE = 4096  # lengths up to here have a bin each
SHARD = 4096  # documents that one task orders into batches, about


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (ascending) of at most `buckets` buckets with the least padding.

    lengths: distinct and ascending. Of equally good plans, the one with fewer
    buckets, then the smallest boundaries from the last bucket backwards.
    """
    n = len(lengths)
    if not n:
        return []
    docs = np.r_[0, np.cumsum(counts)].astype(np.float64)
    size = lengths.astype(np.float64)
    best = size * docs[1:]  # one bucket up to each length; tokens after padding
    back: list[np.ndarray] = []
    costs = [best[-1]]
    for _ in range(min(buckets, n) - 1):
        step = np.full(n, np.inf)
        came = np.zeros(n, np.int64)
        for j in range(1, n):
            x = best[:j] + size[j] * (docs[j + 1] - docs[1 : j + 1])
            came[j] = x.argmin()
            step[j] = x[came[j]]
        back.append(came)
        best = step
        costs.append(best[-1])
    k = int(np.argmin(costs))
    out, j = [n - 1], n - 1
    for came in reversed(back[:k]):
        j = int(came[j])
        out.append(j)
    return [int(lengths[i]) for i in reversed(out)]


def _bin(length: Column) -> Column:
    power = F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double"))) - 6)
    return F.when(length <= FINE, length).otherwise((F.ceil(length / power) * power).cast("long"))


def pack(docs: DataFrame, *, length: Column | None = None, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """doc_id, n_tokens, bucket_length, shard, batch, n_padding for every row of docs.

    length: tokens of a row, by default its words between ASCII white space; null
    text has none. A batch is named by (bucket_length, shard, batch): it holds up
    to max(1, budget // bucket_length) rows, so bucket_length times its rows stays
    within the budget unless a single row exceeds it. Shards split a bucket by a
    hash of doc_id and length into parts of about SHARD rows, so that no task
    orders a whole bucket; only the last batch of a shard may be short. Rows of
    equal doc_id and length stay in one shard side by side; rows without a doc_id
    are dealt out by their length. Rows without tokens go to
    bucket 0 unbatched (batch null). Nothing is cut or dropped; extra columns are
    ignored; an empty table gives no rows.
    """
    if length is None:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        length = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = cut_table(docs.select("doc_id", length.cast("long").alias("n_tokens")))  # texts are read once
    filled = rows.where("n_tokens > 0")
    bins = filled.groupBy(_bin(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("length"), F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    lengths, counts = np.array([r["length"] for r in bins], np.int64), np.array([r["n"] for r in bins], np.int64)
    bounds = optimal_boundaries(lengths, counts, buckets)
    if not bounds:
        return rows.select("doc_id", "n_tokens", F.lit(0).cast("long").alias("bucket_length"), F.lit(0).cast("long").alias("shard"), F.lit(None).cast("long").alias("batch"), F.lit(0).cast("long").alias("n_padding"))
    per = np.diff(np.r_[0, np.cumsum(counts)[np.searchsorted(lengths, bounds)]])
    shards = [max(1, round(int(n) / SHARD)) for n in per]
    of = lambda values: F.coalesce(*(F.when(F.col("n_tokens") <= b, F.lit(v)) for b, v in zip(bounds, values)))
    empty = F.col("n_tokens") == 0
    named = F.conv(F.substring(F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("n_tokens").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = rows.select("doc_id", "n_tokens", F.when(empty, 0).otherwise(of(bounds)).cast("long").alias("bucket_length"), F.when(empty, 0).otherwise(F.pmod(named, of(shards))).cast("long").alias("shard"))
    full = rows.where("n_tokens > 0")
    order = Window.partitionBy("bucket_length", "shard").orderBy("doc_id", "n_tokens")
    batch = F.floor((F.row_number().over(order) - 1) / F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length"))))
    full = full.withColumn("batch", batch.cast("long"))
    whole = full.unionByName(rows.where("n_tokens = 0").withColumn("batch", F.lit(None).cast("long")))
    return whole.select("doc_id", "n_tokens", "bucket_length", "shard", "batch", (F.col("bucket_length") - F.col("n_tokens")).alias("n_padding"))
