"""Exact removal of repeated byte strings by sampled, deep-shallow sorted suffixes.

A byte goes if a string of `length` bytes that covers it starts anywhere else.
Sorting all suffixes of a corpus isn't needed for that: each such string (a
window) is represented by its anchor, the `anchor`-byte substring with the
smallest hash (the leftmost of equals). Equal windows have equal anchors at the
same place, so windows need comparing among those of one anchor hash only.

1. Each text yields its segments: runs of windows with the same anchor, as hashes.
2. Anchor hashes that occur once are dropped; equal segments collapse to a count
   before anything gathers, so copies never meet in one task.
3. Where one anchor has different segments, one of each sort by deep-shallow:
   what follows the anchor, and what precedes it backwards. Windows are equal if
   both their left and right parts lie in one run of common prefixes.
4. Anchors with more than `most` different segments are split: each window's own
   hash is counted instead.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_table, small_batches, text_bytes
from .suffixes import deep_shallow

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def substring_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of data[i:i + n] for every i where it fits; n >= 8."""
    x = data.astype(np.uint64)
    for s in (1, 2, 4):
        x = x[:-s] | (x[s:] << np.uint64(8 * s))
    x = _mixed(x, np.uint64(7))
    size = 8
    while size * 2 <= n:
        x = _mixed(x[:-size], x[size:])
        size *= 2
    return x if size == n else _mixed(x[: len(x) - (n - size)], x[n - size :])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == n else np.minimum(x[: len(x) - (n - size)], x[n - size :])


def segments(data: np.ndarray, at: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """text, first window, windows, anchor place and anchor hash of each segment (places in data)."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return none
    w = length - anchor + 1
    h = substring_hashes(data, anchor)
    low = sliding_min(h, w)
    ok = np.zeros(len(low) + 1, np.int8)
    for i, j in pairwise(at.tolist()):
        if j - i >= length:
            ok[i : j - length + 1] = 1
    new = np.flatnonzero(ok[: len(low)].astype(bool) & np.r_[True, (low[1:] != low[:-1]) | (ok[1 : len(low)] > ok[: len(low) - 1])])
    if not len(new):
        return none
    text = np.searchsorted(at, new, "right") - 1
    last_of_text = at[text + 1] - length
    end = np.minimum(np.r_[new[1:], len(low)], last_of_text + 1)
    place = np.empty(len(new), np.int64)
    span = np.arange(w)
    for i in range(0, len(new), 4096):
        place[i : i + 4096] = new[i : i + 4096] + h[new[i : i + 4096, None] + span].argmin(1)
    tied = np.flatnonzero(place < end - 1)  # equal anchors within a run: the next one takes over
    if len(tied):
        more: list[tuple] = []
        for i in tied.tolist():
            p, e = int(place[i]) + 1, int(end[i])
            end[i] = p
            while p < e:
                q = p + int(h[p : p + w].argmin())
                stop = min(e, q + 1)
                more.append((text[i], p, stop, q))
                p = stop
        t, s, e, q = (np.array(c, np.int64) for c in zip(*more))
        text, new, end, place = np.r_[text, t], np.r_[new, s], np.r_[end, e], np.r_[place, q]
    return text, new, end - new, place, h[place]


def _segments(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """doc_id, k, p (first window), n (windows), q (anchor's place from p), a (anchor hash), g (segment hash)."""
    names = ["doc_id", "k", "p", "n", "q", "a", "g"]

    def run(batches):
        for b in small_batches(batches, "text", 2 << 20):
            data, at = text_bytes(b.column(2))
            text, new, n, place, a = segments(data, at, length, anchor)
            raw = data.tobytes()
            g = np.fromiter((xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(new.tolist(), (new + n + length - 1).tolist())), np.uint64, len(new))
            take = pa.array(text)
            cols = [b.column(0).take(take), b.column(1).take(take), pa.array((new - at[text]).astype(np.int32)), pa.array(n.astype(np.int16)), pa.array((place - new).astype(np.int16)), pa.array(a.view(np.int64)), pa.array(g.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, k long, p int, n short, q short, a long, g long")


def repeated_windows(parts: list[tuple[bytes, int, int]], length: int, anchor: int) -> list[list[tuple[int, int]]]:
    """parts: different segments of one anchor (bytes, windows, anchor's place).

    For each, the ranges (first, last + 1) of windows that another one has too.
    """
    right = [s[q:] for s, _, q in parts]
    left = [s[:q][::-1] for s, _, q in parts]
    shared = anchor if len({r[:anchor] for r in right}) == 1 else 0
    n = len(parts)
    sides = []
    for strings, known in ((right, shared), (left, 0)):
        found = deep_shallow(strings, known)
        sides.append((np.array([i for i, _ in found]), np.array([x for _, x in found])))
    (order_r, lcp_r), (order_l, lcp_l) = sides
    # A window that starts j bytes before the anchor needs j common bytes to the left and length - j to the right.
    high = np.array([q for _, _, q in parts])
    low = high - np.array([w for _, w, _ in parts]) + 1
    steps = np.unique(np.r_[low, high + 1, length - lcp_r[1:], lcp_l[1:] + 1])
    steps = steps[(steps >= low.min()) & (steps <= high.max() + 1)]
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    group_r, group_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for j, after in pairwise(steps.tolist()):
        has = np.flatnonzero((low <= j) & (j <= high))
        if len(has) < 2:
            continue
        group_r[order_r] = np.cumsum(np.r_[0, lcp_r[1:] < length - j])
        group_l[order_l] = np.cumsum(np.r_[0, lcp_l[1:] < j])
        _, which, count = np.unique(group_r[has] * n + group_l[has], return_inverse=True, return_counts=True)
        for i in has[count[which] > 1].tolist():
            out[i].append((int(high[i]) - after + 1, int(high[i]) - j + 1))
    return out


def _resolved(pieces: DataFrame, length: int, anchor: int) -> DataFrame:
    """pieces: a, g, n, q, s (bytes) of different segments. Returns a, g, ranges of repeated windows."""
    names = ["a", "g", "ranges"]
    schema = "a long, g long, ranges array<struct<f: int, t: int>>"

    def run(batches):
        group, key = [], None

        def out():
            found = repeated_windows([(s, n, q) for _, n, q, s in group], length, anchor)
            return [(key, x[0], [{"f": f, "t": t} for f, t in r]) for x, r in zip(group, found) if r]

        done: list[tuple] = []
        for b in batches:
            for a, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if a != key:
                    if len(group) > 1:
                        done += out()
                    group, key = [], a
                group.append(rest)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.int64(), pa.int64(), pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())]))))], names=names)
                done = []
        if len(group) > 1:
            done = out()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.int64(), pa.int64(), pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())]))))], names=names)

    return pieces.select("a", "g", "n", "q", "s").repartition("a").sortWithinPartitions("a").mapInArrow(run, schema)


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """Like _resolved, for any number of segments: counts each window's hash."""

    def run(batches):
        for b in batches:
            for a, g, n, _, s in zip(*(c.to_pylist() for c in b.columns)):
                h = [xxhash.xxh3_128_intdigest(s[t : t + length]) for t in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.int64()), pa.array([g] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([x.to_bytes(16, "big") for x in h], pa.binary())], names=["a", "g", "f", "h"])

    rows = pieces.select("a", "g", "n", "q", "s").mapInArrow(run, "a long, g long, f int, h binary")
    often = rows.groupBy("h").count().where("count > 1").select("h")
    found = rows.join(often, "h").select("a", "g", F.struct("f", (F.col("f") + 1).alias("t")).alias("r"))
    return found.groupBy("a", "g").agg(F.collect_list("r").alias("ranges"))


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, k, z: the text compressed for the shuffle."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in small_batches(batches):
            data, at = text_bytes(b.column(2))
            data = data.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(data[i:j]) for i, j in zip(at[:-1], at[1:])], pa.binary())], names=["doc_id", "k", "z"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, k long, z binary")


def _cut_out(wanted: DataFrame, length: int) -> DataFrame:
    """wanted: z and w, an array of (a, g, p, n, q). Returns their bytes."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for z, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = unpack(z)
                rows += [(x["a"], x["g"], x["n"], x["q"], text[x["p"] : x["p"] + x["n"] + length - 1]) for x in w]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary()))], names=["a", "g", "n", "q", "s"])

    return wanted.select("z", "w").mapInArrow(run, "a long, g long, n short, q short, s binary")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for f, t in sorted(spans):
        if out and f <= out[-1][1]:
            out[-1][1] = max(out[-1][1], t)
        else:
            out.append([f, t])
    return [(f, t) for f, t in out]


def repeated_spans(docs: DataFrame, *, length: int = 400, anchor: int = 200, most: int = 30_000) -> DataFrame:
    """doc_id, k (hash of the text), spans: byte ranges covered by repeated strings, unmerged."""
    rows = cut_table(_segments(docs, length, anchor))
    # Written out, so that the joins below are plain ones whose hot keys adaptive execution splits.
    often = cut_table(rows.groupBy("a").agg(F.count(F.lit(1)).alias("c"), (F.min("g") < F.max("g")).alias("many")).where("c > 1").select("a", "many"))
    rows = cut_table(rows.join(often, "a"))
    one_of = F.min(F.struct("doc_id", "k", "p", "n", "q")).alias("x")
    kinds = cut_table(rows.where("many").groupBy("a", "g").agg(F.count(F.lit(1)).alias("c"), one_of))
    wanted = kinds.select(F.col("x.doc_id").alias("doc_id"), F.col("x.k").alias("k"), F.struct("a", "g", "x.p", "x.n", "x.q").alias("w"))
    wanted = wanted.groupBy("doc_id", "k").agg(F.collect_list("w").alias("w"))
    # One row for each text of a doc_id: rows repeated as a whole have the same bytes.
    texts = _packed(docs).withColumnRenamed("doc_id", "d").withColumnRenamed("k", "kk")
    found = texts.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("kk") == F.col("k")))
    pieces = _cut_out(found, length)
    hot = cut_table(kinds.groupBy("a").count().where(F.col("count") > most).select("a"))
    if hot.limit(1).count():
        pieces = cut_table(pieces.dropDuplicates(["a", "g"]))
        ranges = _resolved(pieces.join(hot, "a", "left_anti"), length, anchor).unionByName(_counted(pieces.join(hot, "a", "left_semi"), length))
    else:
        ranges = _resolved(pieces, length, anchor)
    ranges = ranges.groupBy("a", "g").agg(F.first("ranges").alias("ranges"))
    whole = F.array(F.struct(F.lit(0).alias("f"), F.col("n").cast("int").alias("t")))
    same = rows.where("not many").select("doc_id", "k", "p", whole.alias("ranges"))
    by = cut_table(kinds.select("a", "g", "c").join(ranges, ["a", "g"], "left").where("c > 1 or ranges is not null"))
    mixed = rows.where("many").join(by, ["a", "g"]).select("doc_id", "k", "p", F.when(F.col("c") > 1, whole).otherwise(F.col("ranges")).alias("ranges"))
    spans = F.transform("ranges", lambda r: F.struct((F.col("p") + r["f"]).alias("f"), (F.col("p") + r["t"] + length - 1).alias("t")))
    return same.unionByName(mixed).groupBy("doc_id", "k").agg(F.flatten(F.collect_set(spans)).alias("spans"))


def deduplicate(docs: DataFrame, *, length: int = 400, anchor: int = 200, most: int = 30_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept for every row of docs.

    Removes each UTF-8 byte covered by a string of `length` bytes that also
    starts anywhere else, in the same text or another one; strings are judged on
    the input. n_spans counts maximal removed runs, `removed` lists them, `kept`
    holds the remaining bytes. Null text counts as empty; texts shorter than
    `length` keep all. Repeated rows are texts of their own, so they remove each
    other. Extra columns are ignored, an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("k"), "text")
    spans = repeated_spans(docs, length=length, anchor=anchor, most=most).select(F.col("doc_id").alias("d"), F.col("k").alias("kk"), "spans")
    texts = _packed(docs)
    found = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("kk")), "left").select("z", "spans", "doc_id")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                cols: list[list] = [[] for _ in range(6)]
                for z, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = unpack(z)
                    gone = merged([(x["f"], x["t"]) for x in spans or ()])
                    kept, at = [], 0
                    for f, t in gone:
                        kept.append(text[at:f])
                        at = t
                    rest = b"".join([*kept, text[at:]])
                    for c, x in zip(cols, (len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), [{"f": f, "t": t} for f, t in gone], rest)):
                        c.append(x)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())])), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(2), *(pa.array(c, k) for c, k in zip(cols, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return found.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<f: int, t: int>>, kept binary")
