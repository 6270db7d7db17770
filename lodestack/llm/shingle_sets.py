"""Sets of word shingles: exact similarity of pairs, and components over it.

Sets meet under keys of minimum hashes (BANDS keys of DEPTH minima each); pairs
of Jaccard index J share one with probability 1 - (1 - J ** DEPTH) ** BANDS. What
meets is verified on the sets themselves, as 32-bit hashes of the shingles.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut

BANDS, DEPTH = 32, 4
LARGE = 4_000_000  # shingles of a bucket from which on it is dealt out in pairs of blocks

_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 31, (BANDS * DEPTH, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, (BANDS * DEPTH, 1), np.uint32)


def grams(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted; fewer words are one shingle, none are none."""
    n = min(shingle, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(n))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, len(words) - n + 1))


def short(hashes: np.ndarray) -> np.ndarray:
    """The upper 32 bits of sorted hashes, distinct: what sets are compared by."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def keys(of: np.ndarray) -> np.ndarray:
    """BANDS keys of a set that isn't empty."""
    low = np.full(BANDS * DEPTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(of), 2048):
        np.minimum(low, (of[i : i + 2048] * _TIMES + _PLUS).min(axis=1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in low.reshape(BANDS, DEPTH).T.astype(np.uint64):
        key = (key ^ x) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def likeness(both: np.ndarray, a: np.ndarray, b: np.ndarray, measure: str) -> np.ndarray:
    """Of sets of sizes a and b that share `both` members: cosine, which SimHash estimates, or Jaccard index."""
    return both / np.sqrt(a * b) if measure == "cosine" else both / (a + b - both)


def set_labels(sets: list[np.ndarray], similarity: float, measure: str, label: np.ndarray | None = None) -> np.ndarray:
    """Components of sets that aren't empty, over pairs of at least `similarity`.

    label: components known so far, named by any member's position. A pivot is
    compared with all sets; once all but one component's members have been
    pivots, no pair of different components is left.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.float64)
    at = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    label, waits = np.arange(n) if label is None else label.copy(), np.ones(n, bool)
    while True:
        left = np.flatnonzero(waits & (label != np.bincount(label).argmax()))
        if not len(left):
            return label
        p = left[0]
        waits[p] = False
        marked = np.zeros(len(kinds), bool)
        marked[flat[at[p] : at[p] + int(sizes[p])]] = True
        both = np.add.reduceat(marked[flat].astype(np.int64), at)
        found = np.unique(label[likeness(both, sizes, sizes[p], measure) >= similarity])
        label[np.isin(label, found)] = found[0]


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, measure: str) -> DataFrame:
    """Those pairs (a, b) of set names whose sets are at least `similarity` alike. sets: s (once each), grams."""

    def run(batches):
        for batch in batches:
            sizes, both = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                sizes.append((len(x), len(y)))
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
            if sizes:
                a, b = np.array(sizes, np.float64).T
                yield batch.select([0, 1]).filter(pa.array(likeness(np.array(both), a, b, measure) >= similarity))

    left = sets.select(F.col("s").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("s").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long")


def _bucket_links(rows: DataFrame, similarity: float, measure: str) -> DataFrame:
    """rows: key, label, grams. Links (labels a, b) that span what is linked inside each bucket."""

    def run(batches):
        def out(labels, sets):
            names, label = np.unique(np.array(labels, np.int64), return_inverse=True)
            if len(names) < 2:
                return
            first = np.zeros(len(names), np.int64)
            first[label[::-1]] = np.arange(len(label))[::-1]
            new = set_labels(sets, similarity, measure, first[label])
            at = first[new[first] != first]
            if len(at):
                ids = names[label]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[new[at]])], names=["a", "b"])

        key, labels, sets = None, [], []
        for batch in batches:
            for k, x, g in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    yield from out(labels, sets)
                    key, labels, sets = k, [], []
                labels.append(x)
                sets.append(np.frombuffer(g, np.uint32))
        yield from out(labels, sets)

    return rows.repartition("key").sortWithinPartitions("key").select("key", "label", "grams").mapInArrow(run, "a long, b long")


def filed(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """key, s of every set (s, keys) that shares a key with another one."""
    rows = scratch.table(sets.select(F.explode("keys").alias("key"), "s"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return scratch.table(rows.join(shared, "key"))


def pivots(rows: DataFrame) -> DataFrame:
    """rows: as `filed` gives. Pairs (a, b): each set, and the smallest first of its buckets; one row a set at most."""
    first = rows.groupBy("key").agg(F.min("s").alias("b"))
    return rows.join(first, "key").where("s <> b").groupBy(F.col("s").alias("a")).agg(F.min("b").alias("b"))


def remaining_links(rows: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float, measure: str, scratch: Scratch) -> DataFrame:
    """Links between labels that no link joined yet: all pairs of different labels in each bucket are covered.

    rows: key, s; labels: node, label (a set without a row is its own label);
    sets: s, grams. Buckets of one label are done, those of the same members
    count once. Larger ones fall into blocks: those of the bucket's commonest
    label needn't meet each other, all other pairs of blocks are buckets.
    """
    named = rows.join(labels, rows.s == labels.node, "left").select("key", "s", F.coalesce("label", "s").alias("label"))
    named = scratch.table(named)
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("s")).alias("x"), F.bit_xor(F.xxhash64("s", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.where("low < high").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    full = scratch.table(named.join(mixed, "key").join(sets, "s").select("key", "s", "label", "grams"))
    sizes = full.groupBy("key", "label").agg(F.sum(F.octet_length("grams") / 4).alias("n"))
    large = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")).where(F.col("n") > LARGE)
    half = F.lit(LARGE / 2)
    large = cut(large.select("key", F.col("most.label").alias("__most"), F.ceil(F.col("most.n") / half).cast("long").alias("__a"), F.ceil((F.col("n") - F.col("most.n")) / half).cast("long").alias("__b")))
    if not large.limit(1).count():
        return _bucket_links(full, similarity, measure)
    x = full.join(large, "key")
    common = F.col("label") == F.col("__most")
    x = x.withColumn("__i", F.when(common, F.pmod(F.xxhash64("s"), F.col("__a"))).otherwise(F.col("__a") + F.pmod(F.xxhash64("s"), F.col("__b"))))
    x = x.withColumn("__j", F.explode(F.sequence(F.when(common, F.col("__a")).otherwise(F.lit(0).cast("long")), F.col("__a") + F.col("__b") - 1)))
    x = x.withColumn("key", F.xxhash64("key", F.least("__i", "__j"), F.greatest("__i", "__j"))).select("key", "label", "grams")
    return _bucket_links(full.join(large.select("key"), "key", "left_anti"), similarity, measure).unionByName(_bucket_links(x, similarity, measure))
