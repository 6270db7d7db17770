"""Benchmark decontamination on canonical templates.

Texts become tokens in which numbers, units after numbers and names (capitalised
words inside a sentence) are typed placeholders, so a question with other
numbers or names has the same template. Windows of `window` tokens are joined by
hash with those of the benchmark; aligned matches are verified token by token,
and the values in equal slots must map one to one.

Items too short for that (fewer than `least` words besides placeholders, or no
window of which half is words) are contained by texts that equal them word for word.

A benchmark is joined in blocks of BLOCK_CHARS characters of items, each small
enough to hand to every task; documents are read once a block.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes

BLOCK_CHARS = 16 << 20
CACHE = 1 << 19

# Units of measurement, as words after a number.
UNITS = {
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "oz", "lb", "lbs", "pound", "pounds",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "hz", "khz", "mhz", "ghz", "w", "kw", "v", "kb", "mb", "gb", "tb", "c", "f", "k",
    "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur",
}

WORD, NUMBER, UNIT, NAME, STOP = range(5)
_STOP = b"."
#: White space and punctuation inside sentences separate tokens; sentence ends stand alone.
_SPACES = bytes(b if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b == 46 else 32 for b in range(256))
_HASH_OF = [0, 0x1F3D5B79, 0x2E4C6A88, 0x3D5B7997, 0]  # placeholders hash by type


class Tokens(dict):
    """Hash of each word, its type in the lowest three bits: NAME stands for capitalised."""

    def __missing__(self, word: bytes) -> int:
        if word == _STOP:
            x = STOP
        elif word[:1].isdigit() and word.isdigit():
            x = _HASH_OF[NUMBER] << 3 | NUMBER
        else:
            text = word.decode()
            low = text.lower()
            x = xxhash.xxh3_64_intdigest(low.encode()) & ~7
            x |= UNIT if low in UNITS else NAME if text[0] != low[0] and text[1:] == low[1:] and len(text) > 1 else WORD
        if len(self) >= CACHE:
            self.clear()
        self[word] = x
        return x


def _split(text: bytes) -> list[bytes]:
    text = _DECIMAL.sub(rb"\1\2", text)
    for mark in (b"!", b"?", b"\n"):
        text = text.replace(mark, b".")
    return text.replace(b".", b" . ").translate(_SPACES).split()


_DECIMAL = re.compile(rb"(\d)[.,](\d)")


def canonical(words: list[bytes], cache: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and type of each token, and the word it starts at; runs of numbers or names are one token."""
    x = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if not len(x):
        return x, np.zeros(0, np.int8), np.zeros(0, np.int64)
    kind = (x & np.uint64(7)).astype(np.int8)
    before = np.r_[np.int8(STOP), kind[:-1]]
    name = (kind == NAME) & (before != STOP)
    unit = (kind == UNIT) & (before == NUMBER)
    h = x & ~np.uint64(7)
    h[name], h[unit] = np.uint64(_HASH_OF[NAME] << 3), np.uint64(_HASH_OF[UNIT] << 3)
    kind = np.where(kind == NUMBER, NUMBER, np.where(kind == STOP, STOP, np.where(name, NAME, np.where(unit, UNIT, WORD)))).astype(np.int8)
    again = np.r_[False, (kind[1:] == kind[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME))]
    keep = np.flatnonzero(~again & (kind != STOP))
    return h[keep], kind[keep], keep


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive tokens."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return out ^ (out >> np.uint64(29))


class Benchmark:
    """Windows of a block of items, with a bit table in front."""

    def __init__(self, items: list[tuple[int, str]], window: int, least: int):
        self.window = window
        cache = Tokens()
        self.items, h, where = [], [], []
        self.whole: dict[bytes, list] = {}  # short items by their words
        for key, text in items:
            words = _split(text.encode())
            tokens, kinds, at = canonical(words, cache)
            n = min(window, len(tokens))
            w = windows(tokens, n)
            solid = np.convolve(kinds == WORD, np.ones(n, int), "valid") * 2 >= n if n else np.zeros(0, bool)  # half of a window is words
            if (kinds == WORD).sum() < least or not solid.any():
                if len(tokens):
                    self.whole.setdefault(_named(words), []).append((key, len(tokens)))
                continue
            where += [(len(self.items), int(i), n) for i in np.flatnonzero(solid)]
            h.append(w[solid])
            self.items.append((key, tokens, kinds, slots(words, kinds, at)))
        h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h, self.where = h[order], np.array(where, np.int32).reshape(-1, 3)[order]
        self.sizes = sorted({n for _, _, n in where})
        self.bits = np.zeros(1 << 22, bool)
        self.bits[h & np.uint64((1 << 22) - 1)] = True


def slots(words: list[bytes], kinds: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Value of each placeholder (the words up to the next token or sentence end); empty for words."""
    out = []
    for i, k in enumerate(kinds):
        if k == WORD:
            out.append(b"")
            continue
        end = at[i + 1] if i + 1 < len(at) else len(words)
        run = words[at[i] : end]
        out.append(b" ".join(run[: run.index(_STOP)] if _STOP in run else run))
    return out


def consistent(pairs: list[tuple[int, bytes, bytes]]) -> bool:
    """Whether (type, item value, text value) map one to one."""
    there: dict = {}
    back: dict = {}
    return all(there.setdefault((k, a), b) == b and back.setdefault((k, b), a) == a for k, a, b in pairs if a and b)


def matches(texts: list[bytes], bench: Benchmark, cache: Tokens, share: float) -> list[tuple]:
    """(text, item, matched tokens, share, consistent, changed slots, first token) of each contaminating item."""
    split = [_split(t) for t in texts]
    words = [w for s in split for w in (*s, _STOP)]
    h, kind, at = canonical(words, cache)
    ends = np.cumsum([len(s) + 1 for s in split])
    text_of = np.searchsorted(ends, at, "right")
    votes: dict[tuple[int, int, int], int] = {}
    for n in bench.sizes:
        w = windows(h, n)
        hit = np.flatnonzero(bench.bits[w & np.uint64((1 << 22) - 1)])
        hit = hit[text_of[hit] == text_of[np.minimum(hit + n - 1, len(h) - 1)]]
        lo, hi = np.searchsorted(bench.h, w[hit], "left"), np.searchsorted(bench.h, w[hit], "right")
        for p, i, j in zip(hit[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
            for item, place, size in bench.where[i:j].tolist():
                if size == n:
                    votes[int(text_of[p]), item, p - place] = votes.get((int(text_of[p]), item, p - place), 0) + 1
    best: dict[tuple[int, int], tuple] = {}
    first = np.searchsorted(text_of, np.arange(len(texts) + 1))
    for t, item, start in votes:
        key, tokens, kinds, values = bench.items[item]
        lo, hi = max(start, int(first[t])), min(start + len(tokens), int(first[t + 1]))
        same = h[lo:hi] == tokens[lo - start : hi - start]
        n = int(same.sum())
        if n < share * len(tokens) or n < min(bench.window, len(tokens)):
            continue
        lo_hi = [i for i in range(lo, hi) if same[i - lo] and kind[i] != WORD]
        own = {i: _value(words, at, i) for i in lo_hi}
        pairs = [(int(kind[i]), values[i - start], own[i]) for i in lo_hi]
        found = (t, key, n, n / len(tokens), consistent(pairs), sum(a != b for _, a, b in pairs), lo - int(first[t]))
        if (t, item) not in best or (found[4], n, -found[6]) > (best[t, item][4], best[t, item][2], -best[t, item][6]):
            best[t, item] = found
    out = list(best.values())
    if bench.whole:
        for t, s in enumerate(split):
            out += [(t, key, n, 1.0, True, 0, 0) for key, n in bench.whole.get(_named(s), ())] if s else []
    return out


def _named(words: list[bytes]) -> bytes:
    """Names a text by its words, whatever their case and the sentence ends between them."""
    return xxhash.xxh3_128_digest(b" ".join(words).decode().lower().encode().replace(b" . ", b" ").strip(b" ."))


def _value(words: list[bytes], at: np.ndarray, i: int) -> bytes:
    run = words[at[i] : at[i + 1] if i + 1 < len(at) else len(words)]
    return b" ".join(run[: run.index(_STOP)] if _STOP in run else run)


def _blocks(benchmark: DataFrame):
    """Broadcast (item_id, text) lists of about BLOCK_CHARS characters each."""
    items = benchmark.where("text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in block.collect()])


def without(docs: DataFrame, benchmark: DataFrame, *, window: int = 8, share: float = 0.5, least: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item (see `find`)."""
    place = docs.columns.index("text")
    for shared in _blocks(benchmark):

        def run(batches, shared=shared):
            bench, cache = Benchmark(shared.value, window, least), Tokens()
            for b in small_batches(batches, limit=2 << 20):
                data, at = text_bytes(b.column(place))
                data = data.tobytes()
                bad = {m[0] for m in matches([data[i:j] for i, j in pairwise(at.tolist())], bench, cache, share) if m[4]}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = 8, share: float = 0.5, least: int = 5) -> DataFrame:
    """doc_id, item_id, matched, share, slots_changed, first_token: one row for each row of docs and item it contains.

    An item is contained where at least `share` of its tokens, and a whole window
    of them, stand aligned in the text with slot values that map one to one.
    Shorter items (see above) are contained by texts of the same words, whatever
    their case. Null items and items without a word are left out; null and empty texts contain nothing. Items and rows that repeat
    each give their rows (an item with a repeated item_id and text once); extra
    columns are ignored; empty tables give no rows.
    """
    kinds = dict(docs.dtypes), dict(benchmark.dtypes)
    schema = f"doc_id {kinds[0]['doc_id']}, item_id {kinds[1]['item_id']}, matched long, share double, slots_changed long, first_token long"
    rows = docs.select(F.col("text").cast("string").alias("text"), "doc_id")
    out = None
    for shared in _blocks(benchmark):

        def run(batches, shared=shared):
            bench, cache = Benchmark(shared.value, window, least), Tokens()
            for b in small_batches(batches, limit=2 << 20):
                data, at = text_bytes(b.column(0))
                data = data.tobytes()
                found = [m for m in matches([data[i:j] for i, j in pairwise(at.tolist())], bench, cache, share) if m[4]]
                if found:
                    t, item, n, part, _, changed, start = zip(*found)
                    cols = [b.column(1).take(pa.array(t)), pa.array(item), *(pa.array(c, pa.int64()) for c in (n,)), pa.array(part, pa.float64()), pa.array(changed, pa.int64()), pa.array(start, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "matched", "share", "slots_changed", "first_token"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
