"""Language-model scores: context-tree weighting over bytes, beside a word base.

Each byte is coded as eight binary decisions. Every decision has a context tree
over the preceding bytes; the probability of a node mixes its
Krichevsky-Trofimov estimate with the product of its children, so all depths are
weighed by how well they coded the training text. With training over, the
mixture weights are fixed and each (context, byte) gets one code length.

The tree is counted over the whole training part and has every context of up to
DEPTH bytes that occurs there:

1. One pass counts grams (DEPTH bytes of context and the byte after them), those
   of rows that are only scored too, with no training count.
2. Contexts that end with the same three bytes are one subtree, weighted whole in
   one task. The driver mixes what they send up: contexts of up to two bytes, of
   which there are 65,536 at most.
3. The mixture's upper part goes back down the subtrees, which gives each gram its
   log10 probability.
4. Grams that make up GRAM_SHARE of all places or more (so 4,000,000 at most) are
   looked up in the scoring tasks; the others' places are joined to their
   probabilities. Likewise words for the base: those that make up HEAD_SHARE of
   all tokens or more are looked up, all others joined.

`learn` is for a tree that is bounded on purpose (`context_share`): it has the
contexts of 3 bytes and more that make up that share of the training bytes, and a
node's other contexts share one child.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice, pairwise, repeat
from math import log, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut_table, small_batches, text_bytes

HEAD_SHARE = 1 / 500_000  # so there are 500,000 such words at most
GRAM_SHARE = 1 / 4_000_000
DEPTH = 5
END = 255  # closes a text; UTF-8 has no such byte
_BEFORE, _AFTER = bytes(DEPTH), bytes([END])


def _sequence(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts, each after DEPTH zero bytes and before END; their starts; which places are coded."""
    raw = data.tobytes().translate(LOWER)
    seq = np.frombuffer(b"".join([_BEFORE + raw[i:j] + _AFTER for i, j in pairwise(at.tolist())]), np.uint8)
    starts = at[:-1] + (DEPTH + 1) * np.arange(len(at) - 1)
    coded = np.ones(len(seq), bool)
    for k in range(DEPTH):
        coded[starts + k] = False
    return seq, starts, coded


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (two context bytes, byte) and their counts."""
    seq, _, coded = _sequence(data, at)
    seen = np.flatnonzero(np.bincount(seq, minlength=256))
    k = len(seen)
    place = np.zeros(256, np.int32)
    place[seen] = np.arange(k)
    s = place[seq]
    code = (s[:-2] * k + s[1:-1]) * k + s[2:]
    found = np.bincount(code[coded[2:]], minlength=k**3)
    at = np.flatnonzero(found)
    return (seen[at // (k * k)] << 16) | (seen[at // k % k] << 8) | seen[at % k], found[at]


def grams(seq: np.ndarray, coded: np.ndarray, depth: int, window: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Coded places of a sequence and their grams: depth bytes of context and the byte, as one number. One window at a time."""
    for i in range(depth, len(seq), window):
        j = min(i + window, len(seq))
        out = seq[i - depth : j - depth].astype(np.int64)
        for k in range(1, depth + 1):
            out <<= 8
            out |= seq[i - depth + k : j - depth + k]
        places = np.flatnonzero(coded[i:j])
        yield places + i, out[places]


def summed(code: np.ndarray, *n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different codes in order, and the sums of what each has in n."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    return code[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in n)


class Contexts:
    """The frequent contexts of three bytes and more, and how to find them along a text.

    names[d]: the bytes of each context of d bytes. A context of three bytes is
    looked up by its bytes, a longer one by its first d - 1 bytes' number and its
    last byte.
    """

    def __init__(self, codes: np.ndarray):
        codes = np.sort(codes)
        self.names = {3: np.stack([codes >> 16, codes >> 8 & 255, codes & 255], 1).astype(np.uint8)}
        seen = np.unique(self.names[3])
        self.place = np.zeros(256, np.int32)
        self.place[seen] = np.arange(1, len(seen) + 1)
        self.k = len(seen) + 1
        self.first = np.full(self.k**3, -1, np.int32)
        self.first[self.code3(self.names[3])] = np.arange(len(codes))
        self.steps: list[np.ndarray] = []

    def code3(self, names: np.ndarray) -> np.ndarray:
        p = self.place[names]
        return (p[..., 0] * self.k + p[..., 1]) * self.k + p[..., 2]

    @property
    def depth(self) -> int:
        return 3 + len(self.steps)

    def deepen(self, codes: np.ndarray) -> None:
        """Adds contexts one byte longer: number of the first bytes * 256 + last byte."""
        names = self.names[self.depth]
        step = np.full((len(names) + 1, 256), -1, np.int32)  # the last row serves places without a context
        codes = np.sort(codes)
        step[codes >> 8, codes & 255] = np.arange(len(codes))
        self.steps.append(step)
        self.names[self.depth] = np.concatenate([names[codes >> 8], (codes & 255).astype(np.uint8)[:, None]], 1)

    def along(self, seq: np.ndarray) -> list[np.ndarray]:
        """For depths 3, 4, ...: number of the context that ends at each place, or -1."""
        s = self.place[seq]
        out = np.full(len(seq), -1, np.int32)
        out[2:] = self.first[(s[:-2] * self.k + s[1:-1]) * self.k + s[2:]]
        found = [out]
        for step in self.steps:
            deeper = np.full(len(seq), -1, np.int32)
            deeper[1:] = step.ravel()[found[-1][:-1] * 256 + seq[1:]]  # -1 finds the last row
            found.append(deeper)
        return found

    def parents(self, depth: int) -> np.ndarray:
        """Number of each context's last depth - 1 bytes; for three bytes, the two as a code."""
        names = self.names[depth]
        if depth == 3:
            return names[:, 1].astype(np.int64) << 8 | names[:, 2]
        number = self.first[self.code3(names[:, 1:4])]
        for k in range(4, depth):
            number = self.steps[k - 4][number, names[:, k]]
        return number


def gather_deeper(docs: DataFrame, contexts: Contexts) -> DataFrame:
    """code (number of a deepest context * 256 + byte) and n over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(contexts)

    def run(batches):
        contexts = shared.value
        total = np.zeros(len(contexts.names[contexts.depth]) * 256, np.int64)
        for b in small_batches(batches):
            seq, _, coded = _sequence(*text_bytes(b.column(0)))
            number = contexts.along(seq)[-1][:-1]
            use = (number >= 0) & coded[1:]
            total += np.bincount(number[use].astype(np.int64) * 256 + seq[1:][use], minlength=len(total))
        code = np.flatnonzero(total)
        for i in range(0, max(1, len(code)), 100_000):
            part = code[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["code", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def counted(batches, depth: int, held: int = 800_000) -> Iterator[pa.RecordBatch]:
    """What gather sums, of one task's batches of text and learnt.

    Holds that many different grams at most, and a fourth as many words (besides
    those of the latest megabytes): rarer grams, and all words, are sent on then.
    """
    names = ["word", "code", "n", "total"]

    def word_rows(words: Counter):
        each = iter(words.items())
        while part := list(islice(each, 50_000)):
            n = pa.array([k for _, k in part], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in part], pa.string()), pa.nulls(len(part), pa.int64()), n, n], names=names)

    def gram_rows(marked: np.ndarray, total: np.ndarray):
        for i in range(0, len(marked), 100_000):
            code, all_ = marked[i : i + 100_000], total[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(code), pa.string()), pa.array(code >> 1), pa.array(np.where(code & 1, all_, 0)), pa.array(all_)], names=names)

    words: Counter = Counter()
    marked, total = np.zeros(0, np.int64), np.zeros(0, np.int64)  # twice a gram, and one more if it is learnt from; how often
    new: list[np.ndarray] = []
    ends = 0

    def add():
        nonlocal marked, total
        code = np.concatenate(new)
        new.clear()
        code.sort()
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        n = np.diff(np.r_[first, len(code)])
        marked, total = summed(np.concatenate([marked, code[first]]), np.concatenate([total, n]))

    for b in small_batches(batches, limit=1 << 20):
        data, at = text_bytes(b.column(0))
        learnt = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        ends += int(learnt.sum())
        for i, j, use in zip(at[:-1], at[1:], learnt):
            if use:
                words.update(data[i:j].tobytes().translate(LOWER).split())
        seq, begin, coded = _sequence(data, at)
        learnt = np.repeat(learnt, np.diff(np.r_[begin, len(seq)]))
        for places, code in grams(seq, coded, depth, 1 << 18):
            code <<= 1
            code |= learnt[places]
            new.append(code)
            if sum(map(len, new)) > held:
                add()
                if len(total) > held:
                    rare = total <= np.partition(total, -(held // 2))[-(held // 2)]
                    yield from gram_rows(marked[rare], total[rare])
                    marked, total = marked[~rare], total[~rare]
        if len(words) > held // 4:
            yield from word_rows(words)
            words.clear()
    yield from word_rows(words)
    words.clear()
    if new:
        add()
    yield from gram_rows(marked, total)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([-1], pa.int64()), pa.array([ends], pa.int64()), pa.array([ends], pa.int64())], names=names)


def gather(docs: DataFrame, depth: int) -> DataFrame:
    """word, code, n, total: counts of words of rows with learnt true (their ends: word null and code -1) and of grams.

    docs: text, learnt. n counts rows with learnt true, total all rows; words of others aren't counted.
    """

    def run(batches):
        return counted(batches, depth)

    return docs.select(F.col("text").cast("string").alias("text"), "learnt").mapInArrow(run, "word string, code long, n long, total long").groupBy("word", "code").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def lgamma(x: np.ndarray) -> np.ndarray:
    z = x + 8.0
    return (z - 0.5) * np.log(z) - z + 0.5 * log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - sum(np.log(x + i) for i in range(8))


def _estimates(zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log KT probability and KT estimate of a one, of nodes with these counts."""
    log_kt = lgamma(zero + 0.5) + lgamma(one + 0.5) - log(np.pi) - lgamma(zero + one + 1)
    return log_kt, (one + 0.5) / (zero + one + 1)


def _nodes(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: log KT probability and KT estimate of a one, of 256 nodes (node 0 unused)."""
    tree = np.zeros((len(histogram), 512))
    tree[:, 256:] = histogram
    for i in range(255, 0, -1):
        tree[:, i] = tree[:, 2 * i] + tree[:, 2 * i + 1]
    zero, one = tree[:, 0::2].copy(), tree[:, 1::2].copy()
    zero[:, 0] = one[:, 0] = 0
    return _estimates(zero, one)


def _symbols(p: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from the probabilities of a one at 256 nodes."""
    out = np.zeros((len(p), 1))
    for level in range(8):
        q = p[:, 1 << level : 2 << level]
        out = np.stack([out + np.log10(1 - q), out + np.log10(q)], -1).reshape(len(p), 2 << level)
    return out


def code_lengths(codes: np.ndarray, n: np.ndarray, contexts: Contexts | None = None, counts: list[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Row of each two-byte context, log10 probabilities [row, byte], and the first row of each greater depth.

    counts: [context, byte] counts of depths 3, 4, ... of contexts.
    """
    seen, where = np.unique(codes >> 8, return_inverse=True)
    h2 = np.zeros((len(seen), 256))
    np.add.at(h2, (where, codes & 255), n)
    last = seen & 255
    h1 = np.zeros((256, 256))
    np.add.at(h1, last, h2)
    levels = [h1.sum(0, keepdims=True), h1, h2, *counts]
    up = [np.zeros(0, np.int64), np.zeros(256, np.int64), last]
    for depth in range(3, 3 + len(counts)):
        parents = contexts.parents(depth)
        up.append(np.searchsorted(seen, parents) if depth == 3 else parents)
    kt, weight, rest = [None] * len(levels), [None] * len(levels), [None] * len(levels)
    below = None  # of the level: what its children's weighted probabilities multiply to
    for d in reversed(range(len(levels))):
        own, kt[d] = _nodes(levels[d])
        other = levels[d].copy()  # counts under contexts that have no node
        if d + 1 < len(levels):
            np.subtract.at(other, up[d + 1], levels[d + 1])
        log_other, rest[d] = _nodes(np.maximum(other, 0))
        below = log_other if below is None else below + log_other
        both = np.logaddexp(own, below) - log(2)
        weight[d] = np.exp(own - log(2) - both)
        if d:
            below = np.zeros_like(levels[d - 1])
            np.add.at(below, up[d], both)

    def mixed(d: int) -> np.ndarray:
        """Probabilities of a one where a path stops at a node of depth d."""
        q, at = rest[d], np.arange(len(levels[d]))
        for k in reversed(range(d + 1)):
            q = weight[k][at] * kt[k][at] + (1 - weight[k][at]) * q
            at = up[k][at] if k else at
        return q

    table = np.concatenate([_symbols(mixed(d)).astype(np.float32) for d in range(1, len(levels))])
    row = np.tile(np.arange(256, dtype=np.int32), 256)
    row[seen] = 256 + np.arange(len(seen))
    starts = np.cumsum([256, *(len(x) for x in levels[2:-1])]).tolist()[1:] if counts else []
    return row, table, starts


def log_probability(data: np.ndarray, at: np.ndarray, row: np.ndarray, table: np.ndarray, contexts: Contexts | None = None, starts: list[int] = ()) -> np.ndarray:
    """log10 probability of each text, its end included."""
    if len(at) == 1:
        return np.zeros(0)
    seq, begin, coded = _sequence(data, at)
    wide = seq.astype(np.int32)
    rows = row[(wide[:-2] << 8) | wide[1:-1]]
    for first, number in zip(starts, contexts.along(seq) if contexts else ()):
        number = number[1:-1]
        rows = np.where(number >= 0, first + number, rows)
    found = np.zeros(len(seq))
    found[2:] = table.ravel()[rows.astype(np.int64) * 256 + wide[2:]]
    found[~coded] = 0
    return np.add.reduceat(found, begin)


class Subtrees:
    """The nodes of contexts of 3 to depth bytes over all grams of some last three context bytes.

    levels[i] has contexts of 3 + i bytes and their grams: `at` [bit of the byte,
    gram] gives a node, `into` the shorter gram of a gram, `up` the node with one
    context byte less. Grams without a training count are there to be given their
    probability; their nodes weigh nothing.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, depth: int):
        key = np.zeros(len(gram), np.int64)  # nearest byte first: a context's extensions are neighbours
        for k in range(1, depth + 1):
            key = key << 8 | gram >> 8 * k & 255
        key = key << 8 | gram & 255
        self.order = np.argsort(key)
        key, n, into = key[self.order], n[self.order].astype(np.float64), None
        self.levels: list[dict] = []
        for d in range(depth, 2, -1):
            at, first, zero, one, size = [], [], [], [], 0
            for bit in range(8):
                node = key >> (8 - bit)
                new = np.r_[True, node[1:] != node[:-1]]
                at.append(size + np.cumsum(new) - 1)
                first.append(np.flatnonzero(new))
                size += len(first[-1])
                one.append(np.add.reduceat(n * (key >> (7 - bit) & 1), first[-1]))
                zero.append(np.add.reduceat(n, first[-1]) - one[-1])
            own, kt = _estimates(np.concatenate(zero), np.concatenate(one))
            self.levels.insert(0, {"key": key, "n": n, "at": at, "first": first, "own": own, "kt": kt})
            if d > 3:
                key, into = np.unique(key >> 16 << 8 | key & 255, return_inverse=True)
                n = np.bincount(into, weights=n, minlength=len(key))
                self.levels[0]["into"] = into
        below = None
        for i in reversed(range(len(self.levels))):
            level = self.levels[i]
            own = both = level["own"]
            if below is not None:
                both = np.logaddexp(own, below) - log(2)
            level["weight"] = np.ones(len(own)) if below is None else np.exp(own - log(2) - both)
            if i:
                above = self.levels[i - 1]
                level["up"] = np.concatenate([above["at"][bit][level["into"][x]] for bit, x in enumerate(level["first"])])
                below = np.bincount(level["up"], weights=both, minlength=len(above["own"]))
        self.both = both
        key = self.levels[0]["key"]  # for each node of three bytes: two nearest bytes * 256 + node of the byte's bits
        self.names = np.concatenate([key[x] >> 16 << 8 | 1 << bit | (key[x] & 255) >> (8 - bit) for bit, x in enumerate(self.levels[0]["first"])])

    def log_probabilities(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log10 probability of each gram. A node of three bytes predicts q within the tree, a + b * q with what is above."""
        for level in self.levels:
            if "up" in level:
                a, b = a[level["up"]], b[level["up"]]
            a, b = a + b * level["weight"] * level["kt"], b * (1 - level["weight"])
        byte = level["key"] & 255
        out = np.empty(len(byte))
        out[self.order] = sum(np.log10(np.where(byte >> (7 - bit) & 1, a[at], 1 - a[at])) for bit, at in enumerate(level["at"]))
        return out


_BYTE = 1 << 24  # marks codes of byte counts among those of nodes


def _upper(code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of nodes of two bytes, sorted, and a and b for Subtrees.log_probabilities.

    code: names of nodes, with what the nodes of three bytes weigh together; _BYTE +
    two nearest bytes * 256 + byte, with counts.
    """
    order = np.argsort(code)
    code, value = code[order], value[order]
    k = int(np.searchsorted(code, _BYTE))
    names, grams = code[:k], code[k:] - _BYTE
    seen, row = np.unique(grams >> 8, return_inverse=True)
    h, below = np.zeros((len(seen), 256)), np.zeros((len(seen), 256))
    h[row, grams & 255] = value[k:]
    row = np.searchsorted(seen, names >> 8)
    below[row, names & 255] = value[:k]
    near = seen >> 8
    kts, weights = [], []
    for into, size in ((near, 256), (np.zeros(256, np.int64), 1), (None, 0)):
        own, kt = _nodes(h)
        both = np.logaddexp(own, below) - log(2)
        kts.insert(0, kt)
        weights.insert(0, np.exp(own - log(2) - both))
        if size:
            shorter, below = np.zeros((size, 256)), np.zeros((size, 256))
            np.add.at(shorter, into, h)
            np.add.at(below, into, both)
            h = shorter
    a, b = 0.0, 1.0
    for kt, weight, rows in zip(kts, weights, (None, np.zeros(256, np.int64), near)):
        if rows is not None:
            a, b = a[rows], b[rows]
        a, b = a + b * weight * kt, b * (1 - weight)
    return names, a[row, names & 255], b[row, names & 255]


def subtree_grams(batches, limit: int = 100_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns code, n and total of a task's batches: whole subtrees of three bytes, limit grams or one more subtree at a time."""
    columns = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if not columns:
        return
    code, n, total = (np.concatenate(c) for c in zip(*columns))
    columns.clear()
    subtree = code >> 8 & 0xFFFFFF
    order = np.argsort(subtree, kind="stable")
    subtree, start = subtree[order], 0
    while start < len(code):
        end = int(np.searchsorted(subtree, subtree[min(start + limit, len(code)) - 1], "right"))
        part = order[start:end]
        yield code[part], n[part], total[part]
        start = end


def whole_tree(places: DataFrame, depth: int) -> DataFrame:
    """places: code (a gram), n (in training), total. Returns code, total and logp, the gram's log10 probability."""
    dealt = places.select("code", "n", "total").repartition(F.shiftright("code", 8).bitwiseAND(F.lit((1 << 24) - 1)))

    def up(batches):
        for code, n, _ in subtree_grams(batches):
            trees = Subtrees(code, n, depth)
            last = code >> 8
            byte = _BYTE | (last & 255) << 16 | (last & 0xFF00) | code & 255
            code, value = summed(np.r_[trees.names, byte], np.r_[trees.both, n.astype(np.float64)])
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(value)], names=["code", "value"])

    got = dealt.mapInArrow(up, "code long, value double").groupBy("code").agg(F.sum("value").alias("value")).toArrow()
    shared = places.sparkSession.sparkContext.broadcast(_upper(got["code"].to_numpy(), got["value"].to_numpy()))

    def down(batches):
        names, a, b = shared.value
        for code, n, total in subtree_grams(batches):
            trees = Subtrees(code, n, depth)
            at = np.searchsorted(names, trees.names)
            logp = trees.log_probabilities(a[at], b[at])
            for i in range(0, len(code), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(code[part]), pa.array(total[part]), pa.array(logp[part])], names=["code", "total", "logp"])

    return cut_table(dealt.mapInArrow(down, "code long, total long, logp double"))


class Lookup:
    """Values by code, in a table of hashed places that is half full at most."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(codes)).bit_length())
        self.codes, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        slot, left = self._slot(codes), np.arange(len(codes))
        while len(left):
            free = left[self.codes[slot[left]] < 0]
            self.codes[slot[free]] = codes[free]  # of those that meet, the last one stays
            done = self.codes[slot[left]] == codes[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 if there is none), and the places of codes that aren't here."""
        slot = self._slot(codes)
        there = self.codes[slot]
        out = np.where(there == codes, self.values[slot], 0.0)
        left, missed = np.flatnonzero(there != codes), []
        while len(left):
            empty = self.codes[slot[left]] < 0
            missed.append(left[empty])
            left = left[~empty]
            now = slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            hit = self.codes[now] == codes[left]
            out[left[hit]] = self.values[now[hit]]
            left = left[~hit]
        return out, np.sort(np.concatenate(missed)) if missed else left


def log_probability_whole(data: np.ndarray, at: np.ndarray, near: Lookup, depth: int) -> tuple[np.ndarray, pa.Array]:
    """log10 probability of each text as far as near has its grams, and lists of its other grams."""
    seq, begin, coded = _sequence(data, at)
    found, far = np.zeros(len(seq)), []
    for places, code in grams(seq, coded, depth):
        found[places], missed = near.find(code)
        far.append((places[missed], code[missed]))
    places, code = map(np.concatenate, zip(*far))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(places, np.r_[begin, len(seq)]).astype(np.int32)), pa.array(code))
    return np.add.reduceat(found, begin), lists


def _scored(docs: DataFrame, head: dict[bytes, int], model: tuple) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(({w: log10(c + 1) for w, c in head.items()}, model))

    def run(batches):
        known, model = shared.value
        get = known.get
        for b in small_batches(batches, limit=2 << 20):
            data, at = text_bytes(b.column(0))
            if isinstance(model[0], Lookup):
                score, far = log_probability_whole(data, at, *model)
            else:
                score, far = log_probability(data, at, *model), pa.array([[]] * b.num_rows, pa.list_(pa.int64()))
            n, logs, rest = [], [], []
            for i, j in zip(at[:-1], at[1:]):
                words = data[i:j].tobytes().translate(LOWER).split()
                other = [w.decode() for w in words if w not in known]
                n.append(len(words))
                logs.append(sum(map(get, words, repeat(0.0))))
                rest.append(other)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n, pa.int64()), pa.array(logs, pa.float64()), pa.array(rest, pa.list_(pa.string())), pa.array(score, pa.float64()), far, pa.array(np.diff(at), pa.int64())], names=["doc_id", "n", "logs", "rest", "score", "far", "size"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(F.col("text").cast("string").alias("text"), "doc_id").mapInArrow(run, f"doc_id {kind}, n long, logs double, rest array<string>, score double, far array<long>, size long")


def learn(docs: DataFrame, codes: np.ndarray, n: np.ndarray, texts: int, depth: int = DEPTH, share: float = 0.0) -> tuple:
    """The model for log_probability, of a bounded tree: codes and n are the trigrams of docs, texts their number.

    Contexts of 3 bytes and more need that share of the training bytes, and two places.
    """
    least = max(2.0, share * n.sum())
    # Each text starts with zero bytes: that context occurs once a text.
    frequent = np.r_[codes[(n >= least) & (codes & 255 != END)], [0] if texts >= least else []].astype(np.int64)
    contexts, counts = Contexts(np.unique(frequent)), []
    while len(contexts.names[contexts.depth]) and contexts.depth <= depth:
        got = gather_deeper(docs, contexts).toPandas()
        h = np.zeros(len(contexts.names[contexts.depth]) * 256)
        h[got.code.to_numpy(np.int64)] = got.n.to_numpy(np.float64)
        counts.append(h.reshape(-1, 256))
        more = np.flatnonzero(h >= least)
        more = more[more & 255 != END]
        if contexts.depth == depth or not len(more):
            break
        zero = np.flatnonzero((contexts.names[contexts.depth] == 0).all(1))
        contexts.deepen(np.unique(np.r_[more, zero * 256]))
    if not counts:
        return code_lengths(codes, n.astype(np.float64))[:2]
    row, table, starts = code_lengths(codes, n.astype(np.float64), contexts, counts)
    return row, table, contexts, starts


def score(docs: DataFrame, *, folds: int = 7, held_out: int = 2, head_share: float = HEAD_SHARE, depth: int = DEPTH, context_share: float | None = None, gram_share: float = GRAM_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row.

    Learns from the rows whose crc32(doc_id as text) mod folds isn't held_out (a
    null doc_id is never held out). Texts are lower-cased (A-Z); tokens are words
    between ASCII white space, then one end. base_score adds
    log10((c + 1) / (N + V + 1)) over tokens, c being a token's count among the N
    training tokens of V kinds. score is the log10 probability of the text's
    bytes and its end under the mixture over all contexts of up to depth (at most
    5) training bytes, or over those that context_share bounds; bits_per_byte is
    its code length over its bytes, the end counted as one. head_share and
    gram_share say what tasks look up and what is joined, which doesn't alter
    results. Null text counts as empty: it has its end only. Repeated rows each
    count and each get their row; extra columns are ignored; an empty table gives
    no rows. With no training row, N and V are 0 and every bit costs one bit.
    """
    if depth > DEPTH:
        raise ValueError(f"contexts have {DEPTH} bytes at most")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out, F.lit(False))
    whole = context_share is None and depth > 2
    counts = cut_table(gather(docs.select("text", (~out).alias("learnt")), depth if whole else 2))
    words, places = counts.where("word is not null"), counts.where("code >= 0")
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = counts.where("code = -1").agg(F.sum("n")).first()[0] or 0
    if whole:
        known = whole_tree(places, depth)
        least = max(1.0, gram_share * (known.agg(F.sum("total")).first()[0] or 0))
        near = known.where(F.col("total") >= least).select("code", "logp").toArrow()
        model = Lookup(near["code"].to_numpy(), near["logp"].to_numpy()), depth
    else:
        codes = places.where("n > 0").select("code", "n").toPandas()
        model = learn(docs.where(~out), codes.code.to_numpy(np.int64), codes.n.to_numpy(np.int64), ends, depth, context_share or 0.0)
    train = (total["n"] or 0) + ends
    kinds = total["v"] + (ends > 0)
    head = {r[0].encode(): r[1] for r in words.where(F.col("n") >= max(1.0, head_share * train)).select("word", "n").collect()}

    base = cut_table(_scored(docs.select("doc_id", "text"), head, model).withColumn("row", F.monotonically_increasing_id()))
    rest = base.select("row", F.explode("rest").alias("word"))
    found = rest.join(words.select("word", F.col("n").alias("c")), "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more"), F.count("c").alias("known"))
    if whole:
        far = base.select("row", F.explode("far").alias("code")).join(known.where(F.col("total") < least), "code").groupBy("row").agg(F.sum("logp").alias("beyond"))
    else:
        far = found.select("row", F.lit(0.0).alias("beyond"))
    base = base.select("row", "doc_id", "n", "logs", "score", "size", F.size("rest").alias("n_rest")).join(found, "row", "left").join(far, "row", "left")
    base = base.withColumn("score", F.col("score") + F.coalesce("beyond", F.lit(0.0)))
    n_tokens = F.col("n") + 1
    return base.select(
        "doc_id",
        out.alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("n") - F.col("n_rest") + F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) + log10(ends + 1) - n_tokens * log10(train + kinds + 1)).alias("base_score"),
        "score",
        (-F.col("score") * log2(10) / (F.col("size") + 1)).alias("bits_per_byte"),
    )
