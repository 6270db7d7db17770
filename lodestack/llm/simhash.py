"""SimHash near-duplicates, found by generalised pigeonhole search.

Fingerprints of 64 bits link at `distance` or fewer differing bits. Bits are
grouped into parts so that correlated bits stand together; dynamic programming
gives each part its own threshold, the thresholds adding up to
distance - parts + 1, so that any two linked fingerprints agree within the
threshold in one part at least. Each fingerprint is filed under its value of a
part and probes all values within that part's threshold; what meets is verified
on all 64 bits.

Copies collapse first: the search runs on distinct fingerprints. Within a
bucket, only a spanning star of each group of linked fingerprints is passed on,
never all pairs. Buckets of more than `dense` fingerprints are dealt out again
by the values around each member (see `_ball_links`), so no task holds an
unbounded bucket.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingle_sets
from .common import Scratch, cut, cut_table, shared_labels, small_batches, text_bytes, words_of
from .components import components

ONE = np.uint64(1)
PAIRS_UP_TO = 64  # bucket rows up to which all rows are compared with shifts of themselves
SQUARE_UP_TO = 2048  # bucket rows up to which a bucket is compared with itself block by block


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    return _of_words(words_of(text), shingle, seed)


def _of_words(words: list[bytes], shingle: int, seed: int) -> int:
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return _majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, len(words) - shingle + 1))


def _majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    n = len(h)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 200):  # up to 200 ones fit a byte's sum
        ones += np.add.reduce(np.unpackbits(h[i : i + 200].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row. Null text: 0."""

    def run(batches):
        for b in small_batches(batches):
            data, at = text_bytes(b.column(1))
            data = data.tobytes()
            fp = np.array([fingerprint(data[i:j], shingle, seed) for i, j in zip(at[:-1], at[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 x 64)."""

    def run(batches):
        n, both = 0, np.zeros((64, 64), np.int64)
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            bits = ((fp[:, None] >> np.arange(64, dtype=np.uint64)) & ONE).astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([n] * 64, pa.int64()), pa.array(both.tolist(), pa.list_(pa.int64()))], names=["i", "n", "both"])

    sums = [F.sum(F.element_at("both", j + 1)).alias(f"c{j}") for j in range(64)]
    rows = nodes.select("fp").mapInArrow(run, "i int, n long, both array<long>").groupBy("i").agg(F.sum("n").alias("n"), *sums).collect()
    both, n = np.zeros((64, 64)), 0
    for r in rows:
        n = r["n"]
        both[r["i"]] = [r[f"c{j}"] for j in range(64)]
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64 / m bits; the most correlated bits are put together first."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    most = -(-64 // m)
    group = {i: [i] for i in range(64)}
    for i, j in sorted(combinations(range(64), 2), key=lambda x: -corr[x]):
        a, b = group[i], group[j]
        if a is not b and len(a) + len(b) <= most:
            a += b
            for x in b:
                group[x] = a
    whole = sorted({id(g): g for g in group.values()}.values(), key=len, reverse=True)
    bins: list[list[int]] = [[] for _ in range(m)]
    for g in whole:  # what didn't pair up fills the smallest groups, split where needed
        for x in g if min(map(len, bins)) + len(g) > most else [None]:
            min(bins, key=len).extend(g if x is None else [x])
    return [sorted(b) for b in bins]


def plan(n: int, both: np.ndarray, distance: int, at_least: int = 10**7, row_cost: float = 2.0) -> list[tuple[list[int], int]]:
    """Parts (bits, threshold) of the least estimated cost for n fingerprints.

    Cost: row_cost for each filed or probing row, 1 for each candidate pair. A
    part's candidates are estimated from how often its bits differ in two
    fingerprints. Plans are made for at_least rows or more, so small inputs get
    the plan that large ones need. Threshold -1 leaves a part out.
    """
    rows = max(n, at_least)
    p = np.diag(both) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 0.05, 0.5)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(2, distance + 2):
        groups = group_bits(n, both, m)
        costs = []
        for bits in groups:
            dist = np.array([1.0])
            for i in bits:
                dist = np.convolve(dist, [1 - differ[i], differ[i]])
            costs.append([0.0] + [row_cost * rows * (1 + sum(comb(len(bits), k) for k in range(t + 1))) + rows * rows / 2 * dist[: t + 1].sum() for t in range(distance + 1)])
        table = {0: (0.0, [])}  # by sum of thresholds + 1
        for c in costs:
            step: dict[int, tuple[float, list]] = {}
            for used, (cost, ts) in table.items():
                for t, x in enumerate(c):
                    if (k := used + t) not in step or cost + x < step[k][0]:
                        step[k] = (cost + x, [*ts, t - 1])
            table = step
        cost, ts = table[distance + 1]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


def keys_of(fp: np.ndarray, bits: list[int], threshold: int) -> np.ndarray:
    """(len(fp), probes) values: the part's own value first, then all within threshold."""
    mask = np.uint64(sum(1 << b for b in bits))
    flips = [sum(1 << b for b in c) for k in range(threshold + 1) for c in combinations(bits, k)]
    return (fp & mask)[:, None] ^ np.array(flips, np.uint64)


def _filed(nodes: DataFrame, scheme: list[tuple[list[int], int]]) -> DataFrame:
    """part, value, fp, own: own rows are filed under their value, others probe."""

    def run(batches):
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            for k, (bits, t) in enumerate(scheme):
                keys = keys_of(fp, bits, t)
                own = np.zeros(keys.shape, bool)
                own[:, 0] = True
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keys.size, k, np.int8)), pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]).view(np.int64)), pa.array(own.ravel())], names=["part", "value", "fp", "own"])

    return nodes.select("fp").mapInArrow(run, "part byte, value long, fp long, own boolean")


def dense_labels(fp: np.ndarray, distance: int) -> np.ndarray:
    """Components (smallest position) of distinct fingerprints, without all pairs.

    Up to SQUARE_UP_TO, and beyond a distance of 3, blocks are compared with all.
    Else, two fingerprints at 2 or fewer bits meet in a value one bit or less away from
    both. Members of what is then the largest component only wait; the others
    look two bits around themselves for values one bit around any other.
    """
    n = len(fp)
    if n <= SQUARE_UP_TO or distance > 3:
        label = np.arange(n)
        for i in range(0, n, 256):
            near = np.bitwise_count(fp[i : i + 256, None] ^ fp[None, :]) <= distance
            x, y = np.nonzero(near & (label[i : i + 256, None] != label[None, :]))
            if len(x):
                label = shared_labels(n, np.r_[np.arange(n), label[x + i]], np.r_[label, label[y]])
        return label
    varies = np.bitwise_or.reduce(fp) ^ np.bitwise_and.reduce(fp)
    ones = np.array([0] + [1 << i for i in range(64) if int(varies) >> i & 1], np.uint64)
    z = (fp[:, None] ^ ones).ravel()
    order = np.argsort(z, kind="stable")
    z, owner = z[order], order // len(ones)
    same = np.flatnonzero(z[1:] == z[:-1])
    label = shared_labels(n, owner[same], owner[same + 1]) if distance >= 2 else np.arange(n)
    if distance == 1:
        x, y = np.searchsorted(fp_sorted := np.sort(fp), z), np.argsort(fp)
        hit = (x < n) & (fp_sorted[np.minimum(x, n - 1)] == z)
        return shared_labels(n, owner[hit], y[x[hit]])
    if distance == 2:
        return label
    large = np.bincount(label, minlength=n).argmax()
    rest = np.flatnonzero(label != large)
    twos = np.array([x | y for x, y in combinations(ones[1:].tolist(), 2)], np.uint64)
    a, b = [np.arange(n)], [label]
    for i in range(0, len(rest), 512):
        probe = (fp[rest[i : i + 512], None] ^ twos).ravel()
        at = np.searchsorted(z, probe)
        hit = np.flatnonzero((at < len(z)) & (z[np.minimum(at, len(z) - 1)] == probe))
        a.append(rest[i + hit // len(twos)])
        b.append(owner[at[hit]])  # all that share this value are linked already
    return shared_labels(n, np.concatenate(a), np.concatenate(b))


def _star_links(value: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """value, fp: rows of whole buckets, sorted by value. Links that span what is linked."""
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    sizes = np.diff(np.r_[starts, len(value)])
    used = (sizes > 1) & (np.add.reduceat(own.astype(np.int64), starts) > 0)
    few = np.repeat(used & (sizes <= PAIRS_UP_TO), sizes)
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    v, x = value[few], fp[few]
    left, right = [], []
    for s in range(1, int(sizes[used & (sizes <= PAIRS_UP_TO)].max(initial=0))):
        hit = np.flatnonzero((v[s:] == v[:-s]) & (np.bitwise_count(x[s:] ^ x[:-s]) <= distance))
        left.append(hit)
        right.append(hit + s)
    if left:
        label = shared_labels(len(x), np.concatenate(left), np.concatenate(right))
        a.append(x)
        b.append(x[label])
    for s, n in zip(starts[used & (sizes > PAIRS_UP_TO)], sizes[used & (sizes > PAIRS_UP_TO)]):
        x = np.unique(fp[s : s + n])
        a.append(x)
        b.append(x[dense_labels(x, distance)])
    a, b = np.concatenate(a), np.concatenate(b)
    both = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    return both[:, 0], both[:, 1]


def _bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    def run(batches):
        held: list[tuple] = []

        def out():
            part, value, fp, own = (np.concatenate(c) for c in zip(*held))
            for k in np.unique(part):
                m = part == k
                a, b = _star_links(value[m], fp[m], own[m], distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part, value, fp = (np.asarray(batch.column(i)) for i in range(3))
            own = batch.column(3).to_numpy(zero_copy_only=False)
            fp = fp.view(np.uint64)
            # Rows up to the last change of key complete their buckets.
            change = np.flatnonzero((value[1:] != value[:-1]) | (part[1:] != part[:-1]))
            last = held[-1] if held else None
            whole = int(change[-1]) + 1 if len(change) else 0
            if not whole and last is not None and (last[0][-1], last[1][-1]) != (part[0], value[0]):
                yield from out()
                held, size = [], 0
            held.append((part[:whole], value[:whole], fp[:whole], own[:whole]) if whole else (part, value, fp, own))
            size += len(held[-1][0])
            if whole and size > 200_000:
                yield from out()
                held, size = [], 0
            if whole:
                held.append((part[whole:], value[whole:], fp[whole:], own[whole:]))
                size += len(part) - whole
        if held:
            yield from out()

    return rows.repartition("part", "value").sortWithinPartitions("part", "value", "fp").mapInArrow(run, "a long, b long")


def _ball_links(rows: DataFrame, distance: int) -> DataFrame:
    """Links in buckets too large for a task, as star edges over shared values.

    Each member is filed one bit around itself (near) and up to two bits around
    itself (far); a far row links to the smallest near row of the same value.
    Any two fingerprints at 3 or fewer bits share such a value.
    """
    if distance > 3:
        raise ValueError("buckets beyond `dense` rows are split for a distance of 3 or less")
    flips = {k: [sum(1 << b for b in c) for c in combinations(range(64), k)] for k in range(3)}
    # distance 1: a value itself meets one-bit neighbours; 2: one and one; 3: one and two
    near, far = [0] + (flips[1] if distance > 1 else []), [0] + flips[1] + (flips[2] if distance > 2 else [])

    def run(batches):
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            for is_near, masks in ((True, near), (False, far)):
                masks = np.array(masks, np.uint64)
                for i in range(0, len(fp), 200):
                    z = (fp[i : i + 200, None] ^ masks).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)), pa.array(np.repeat(fp[i : i + 200], len(masks)).view(np.int64)), pa.array(np.full(len(z), is_near))], names=["z", "fp", "near"])

    spread = rows.select("fp").distinct().mapInArrow(run, "z long, fp long, near boolean")
    low = spread.where("near").groupBy("z").agg(F.min("fp").alias("b"))
    return spread.where("not near").join(low, "z").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()


def link_fingerprints(nodes: DataFrame, distance: int = 3, dense: int = 200_000) -> DataFrame:
    """nodes: distinct fp. Returns node, label over fingerprints that have links."""
    n, both = bit_counts(nodes)
    rows = _filed(nodes, plan(n, both, distance))
    hot = rows.groupBy("part", "value").count().where(F.col("count") > dense).select("part", "value")
    if n > dense:  # a fingerprint has one row for a value at most
        hot = cut(hot)
        if hot.limit(1).count():
            cold = _bucket_links(rows.join(hot, ["part", "value"], "left_anti"), distance)
            return components(cold.unionByName(_ball_links(rows.join(hot, ["part", "value"], "left_semi"), distance)))
    return components(_bucket_links(rows, distance))


def near_duplicates(docs: DataFrame, *, distance: int = 3, shingle: int = 3, seed: int = 42, dense: int = 200_000) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, n_copies for every row of docs.

    component_id is the smallest doc_id reachable over links of `distance` or
    fewer differing bits. Null text counts as empty; empty texts have fingerprint
    zero, linked like any other. Rows with a null doc_id get a fingerprint and
    the component of those they are linked with, null if none of them has an id.
    Repeated rows each get their row. Extra columns are ignored. An empty table
    gives no rows.
    """
    sig = cut(fingerprints(docs, shingle, seed))
    nodes = cut(sig.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_copies")))
    found = link_fingerprints(nodes, distance, dense)
    label = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", "n_copies", F.coalesce("label", "fp").alias("label"))
    lowest = label.groupBy("label").agg(F.min("first").alias("component_id"))
    label = label.join(lowest, "label").select("fp", "component_id", "n_copies")
    return sig.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


def _signatures(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """doc_id, k, fp (of the distinct words), and of the shingles' set its name s, its keys and its grams."""

    def run(batches):
        for b in small_batches(batches):
            data, at = text_bytes(b.column(2))
            data = data.tobytes()
            fps, names, keys, sets = [], [], [], []
            for i, j in zip(at[:-1], at[1:]):
                words = words_of(data[i:j])
                kinds = set(words)
                fps.append(_majority(np.fromiter(map(xxhash.xxh64_intdigest, kinds, repeat(seed)), np.uint64, len(kinds))) if kinds else 0)
                grams = shingle_sets.grams(words, shingle, seed)
                short = shingle_sets.short(grams)
                names.append(xxhash.xxh64_intdigest(grams, seed))
                keys.append(shingle_sets.keys(short) if len(short) else [])
                sets.append(short.tobytes())
            hashes = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *hashes, pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=["doc_id", "k", "fp", "s", "keys", "grams"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("k"), text.alias("text")).mapInArrow(run, "doc_id long, k long, fp long, s long, keys array<long>, grams binary")


def text_key(text: Column | None = None) -> Column:
    """Names a text: what `alike` gives as k. A null text is an empty one."""
    return F.xxhash64(F.coalesce((F.col("text") if text is None else text).cast("string"), F.lit("")))


def _split_buckets(rows: DataFrame, hot: DataFrame, dense: int) -> DataFrame:
    """Rows of hot buckets (part, value, count), dealt out so that any two of a bucket meet in a smaller one.

    A bucket's rows fall into blocks of dense / 2; each pair of blocks is a bucket.
    """
    x = rows.join(hot, ["part", "value"])
    n = F.ceil(F.col("count") / (dense / 2)).cast("long")
    x = x.withColumn("__n", n).withColumn("__i", F.pmod(F.xxhash64("fp"), F.col("__n")))
    x = x.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return x.withColumn("value", F.xxhash64("value", F.least("__i", "__j"), F.greatest("__i", "__j"))).select(rows.columns)


def _candidates(nodes: DataFrame, distance: int, dense: int) -> DataFrame:
    """Pairs (a, b) of set names whose fingerprints are within `distance` bits: two rows a set at most.

    nodes: s, fp. The search runs on distinct fingerprints, each standing for the
    smallest name that has it. What meets in a bucket is paired with the
    bucket's smallest fingerprint of its component; of all buckets, the smallest counts.
    """
    fps = cut(nodes.groupBy("fp").agg(F.min("s").alias("first")))
    n, both = bit_counts(fps)
    # A row is shuffled and sorted, a pair is compared in place: hence the row's price.
    scheme = plan(n, both, distance, at_least=10**6, row_cost=100.0)
    rows = _filed(fps, scheme)
    found = _bucket_links(rows, distance)
    # A bucket gathers what is filed at the values its rows probe from: no such value holds many, nor does it.
    probes = max(sum(comb(len(bits), k) for k in range(t + 1)) for bits, t in scheme)
    if n > dense and _filed(fps, [(bits, 0) for bits, _ in scheme]).groupBy("part", "value").count().where(F.col("count") > dense / probes).limit(1).count():
        hot = cut(rows.groupBy("part", "value").count().where(F.col("count") > dense))
        if hot.limit(1).count():
            cold = _bucket_links(rows.join(hot.select("part", "value"), ["part", "value"], "left_anti"), distance)
            found = cold.unionByName(_bucket_links(_split_buckets(rows, hot, dense), distance))
    found = found.groupBy("a").agg(F.min("b").alias("b"))
    for x in "ab":
        found = found.join(fps.withColumnRenamed("fp", x), x).drop(x).withColumnRenamed("first", x)
    same = nodes.join(fps, "fp").where("s <> first").select(F.col("s").alias("a"), F.col("first").alias("b"))
    return found.select("a", "b").unionByName(same)


def alike(docs: DataFrame, *, similarity: float = 0.8, measure: str = "cosine", distance: int = 7, shingle: int = 5, seed: int = 42, dense: int = 20_000) -> DataFrame:
    """doc_id, k (`text_key`), component_id and is_first of documents that are near-duplicates by their word shingles.

    Two texts link if the sets of their `shingle`-word shingles are at least
    `similarity` alike, verified on the sets: by their cosine, the similarity
    that SimHash estimates, or by their Jaccard index. Candidates are texts whose
    SimHash fingerprints of the distinct words are within `distance` bits (edits
    of a few words hardly move them), found by generalised pigeonhole; those that
    are thereby linked count as one, and what is left is found by shared keys of
    minimum hashes, which miss a pair at the bound with a probability of 0.003.

    One row for each row of docs. component_id is the smallest doc_id reachable
    over links (null if none has one); is_first marks the rows of one (doc_id, k)
    a component, the smallest, ids before nulls. Texts of one doc_id that differ
    are documents of their own. Null texts and texts without words are copies of
    each other; texts of fewer words than a shingle are alike if equal in words.
    Rows that repeat doc_id and text each get their row; other columns are
    ignored; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        sig = scratch.table(_signatures(docs, shingle, seed))
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")
        nodes = scratch.table(sig.groupBy("s").agg(F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.min(place).alias("place")))
        rows = shingle_sets.filed(nodes, scratch)
        pairs = _candidates(nodes.where(F.size("keys") > 0).select("s", "fp"), distance, dense)
        pairs = scratch.table(pairs.unionByName(shingle_sets.pivots(rows)).distinct())
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("s")).unionByName(rows.select("s")).distinct()
        sets = scratch.table(sig.select("s", "grams").join(wanted, "s").dropDuplicates(["s"]))
        once = components(shingle_sets.verified(pairs, sets, similarity, measure))
        more = components(shingle_sets.remaining_links(rows, once, sets, similarity, measure, scratch))
        label = nodes.join(once, nodes.s == once.node, "left").select("s", "place", F.coalesce("label", "s").alias("low"))
        label = cut(label.join(more, label.low == more.node, "left").select("s", "place", F.coalesce("label", "low").alias("low")))
        label = label.join(label.groupBy("low").agg(F.min("place").alias("lowest")), "low").select("s", "lowest")
        is_first = F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("k") == F.col("lowest.k"))
        return cut_table(sig.select("doc_id", "k", "s").join(label, "s").select("doc_id", "k", F.col("lowest.doc_id").alias("component_id"), is_first.alias("is_first")))


__all__ = ["alike", "fingerprint", "fingerprints", "link_fingerprints", "near_duplicates", "text_key"]
