"""Removal of repeated sentence runs.

A run is any number of consecutive sentences, `run` or more of them with
`min_words` words or more. Every place of a run that occurs elsewhere too, but
the first, loses the sentences that it covers. A repeated run is made up of
repeated shortest runs: of those from each sentence on, and of those that end at
a sentence where none of the former ends. So these alone are hashed; the second
kind, which begins with one of the first kind, only where that one repeats. A
join over all texts finds what repeats.

Sentences end at a line's end or at . ! ? and their like in other scripts. Of
every `gaps` neighbouring gaps between words in a sentence, that of the smallest
hash of the words beside it is a cut too, so no piece has more than `gaps` words
and a passage is cut alike wherever it stands, but for gaps - 1 gaps at its ends.
A passage of 4 * gaps + min_words - 1 words thus holds a run: at 7 and 24, 51.
Whole batches of texts are cut and hashed by array operations.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Scratch, cut_table, fresh, small_batches, text_bytes

# Sentence ends beyond ASCII, in the Arabic, Urdu, Indic, Ethiopic, Burmese, Khmer and East Asian scripts.
ENDS = "؟۔।॥።፧፨၊။។៕。！．？｡"

_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_END = np.isin(np.arange(256), list(b".!?"))
_CLOSING = np.isin(np.arange(256), list(b"\"')]}"))
_MARKS = [np.frombuffer(c.encode(), np.uint8) for c in ENDS]
_LEADS = np.isin(np.arange(256), [m[0] for m in _MARKS])
#: First bytes of characters of scripts that put no white space between words (Thai to Khmer partly, East Asian ones).
_DENSE = np.isin(np.arange(256), range(0xE3, 0xEA))

_RNG = np.random.default_rng(42)
_PLACES = 4096
_BYTES = [np.where(_WHITE, 0, _RNG.integers(1, 1 << 63, 256, np.uint64))[np.frombuffer(LOWER, np.uint8)] for _ in range(2)]
_PLACE = [_RNG.integers(0, 1 << 63, _PLACES, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASE = [int(x) << 3 | 5 for x in _RNG.integers(1 << 59, 1 << 60, 2)]
_HALF, _LOWER_HALF = np.uint64(32), np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Cut(NamedTuple):
    """Texts of a batch, cut into words and pieces."""

    word: np.ndarray  # where each word starts
    hashes: list[np.ndarray]  # two of each word
    size: np.ndarray  # words that it counts as
    piece: np.ndarray  # the first word of each piece
    text: np.ndarray  # the text of each piece


def cut_up(data: np.ndarray, at: np.ndarray, gaps: int) -> Cut:
    """data: bytes of all texts; at: their offsets, one more than texts."""
    n = len(data)
    nowhere = np.zeros(0, np.int64)
    white = _WHITE[data]
    if white.all():
        return Cut(nowhere, [nowhere.astype(np.uint64)] * 2, nowhere, nowhere, nowhere)
    begins = np.ones(n, bool)
    begins[1:] = white[:-1]
    begins[at[:-1][at[:-1] < n]] = True
    ends = _END[data]
    if _LEADS[data].any():
        first = np.zeros(n + 1, bool)
        last = np.zeros(n, bool)
        for mark in _MARKS:
            k = len(mark)
            hit = data[: n - k + 1] == mark[0]
            for i in range(1, k):
                hit &= data[i : n - k + 1 + i] == mark[i]
            first[:-1][: len(hit)] |= hit
            last[k - 1 :][: len(hit)] |= hit
        ends = ends | last
        begins[1:] |= last[:-1] & ~first[1:-1]
    word = np.flatnonzero(begins & ~white)
    text = np.searchsorted(at, word, "right") - 1
    after = np.append(word[1:], n)
    close = np.minimum(after, at[text + 1])
    nonwhite = np.maximum.accumulate(np.where(white, 0, np.arange(n)))
    close = nonwhite[close - 1]  # each word's last byte
    lines = np.cumsum(data == 10)
    over = ends[close] | (_CLOSING[data[close]] & ends[np.maximum(close - 1, word)])
    over |= lines[np.minimum(after, at[text + 1]) - 1] > lines[close]
    new = np.ones(len(word), bool)
    new[1:] = over[:-1] | (text[1:] != text[:-1])

    length = np.diff(word, append=n)
    place = np.arange(word[0], n) - np.repeat(word, length)
    place &= _PLACES - 1
    hashes = [_mixed(np.add.reduceat(b[data[word[0] :]] * p[place], word - word[0])) for b, p in zip(_BYTES, _PLACE)]
    dense = _DENSE[data]
    size = np.ones(len(word), np.int64)
    if dense.any():
        size += np.add.reduceat(dense[word[0] :].astype(np.int64), word - word[0]) // 2

    inside = np.flatnonzero(~new)  # words with a gap before them in their sentence
    if len(inside) >= gaps:
        sentence = np.cumsum(new)[inside]
        gap = _mixed(hashes[0][inside - 1] * _PLACE[0][0] + hashes[0][inside])
        # The hash's upper half and the place: of equal hashes, the first counts.
        low, width = gap >> _HALF << _HALF | np.arange(len(gap), dtype=np.uint64), 1
        while width < gaps:
            step = min(width, gaps - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        new[inside[low[sentence[: len(low)] == sentence[gaps - 1 :]] & _LOWER_HALF]] = True
    piece = np.flatnonzero(new)
    return Cut(word, hashes, size, piece, text[piece])


def sentences(text: bytes, gaps: int = 7) -> list[bytes]:
    """Pieces that make up the text, each with the white space behind it, the first with that before it."""
    if not text:
        return []
    cut = cut_up(np.frombuffer(text, np.uint8), np.array([0, len(text)]), gaps)
    at = [0, *cut.word[cut.piece[1:]].tolist(), len(text)]
    return [text[i:j] for i, j in zip(at, at[1:])]


class Runs(NamedTuple):
    """The shortest run from each piece on, if there is one."""

    text: np.ndarray
    first: np.ndarray  # pieces, counted in their text
    last: np.ndarray
    h: np.ndarray
    g: np.ndarray
    more: np.ndarray  # offsets into longer: runs from the same piece on that end where no shortest run does
    longer: np.ndarray  # their hashes; each has one piece more than the one before


def runs(cut: Cut, run: int, min_words: int) -> Runs:
    n, words = len(cut.piece), len(cut.word)
    if not n:
        z = np.zeros(0, np.int64)
        return Runs(z, z, z, z, z, np.zeros(1, np.int64), z)
    edge = np.append(cut.piece, words)
    total = np.append(0, np.cumsum(cut.size))[edge]
    change = np.flatnonzero(np.append(True, cut.text[1:] != cut.text[:-1]))
    count = np.diff(change, append=n)
    start, stop = np.repeat(change, count), np.repeat(change + count, count)
    here = np.arange(n)
    end = np.maximum(here + run, np.searchsorted(total, total[:-1] + min_words))
    keep = np.flatnonzero(end <= stop)
    here, end = here[keep], end[keep]
    # Ends of the next shortest run of this text, or of the text: in between, longer runs from here on.
    until = np.minimum(np.append(end[1:], n + 1), stop[keep] + 1)
    more = np.maximum(0, until - end - 1)

    def hashed(i: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mod = 1 << 64
        power = np.cumprod(np.append(np.uint64(1), np.full(words, _BASE[i], np.uint64)))
        back = np.cumprod(np.append(np.uint64(1), np.full(words, pow(_BASE[i], -1, mod), np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(cut.hashes[i] * power[:-1]))
        return _mixed((sums[edge[b]] - sums[edge[a]]) * back[edge[a]] + (edge[b] - edge[a]).astype(np.uint64))

    h, g = hashed(0, here, end), hashed(1, here, end)
    at = np.append(0, np.cumsum(more))
    longer_from = np.repeat(here, more)
    longer_to = np.repeat(end + 1, more) + np.arange(at[-1]) - np.repeat(at[:-1], more)
    longer = hashed(0, longer_from, longer_to)
    return Runs(cut.text[here], here - start[keep], end - start[keep], h.view(np.int64), (g >> _HALF).astype(np.uint32).view(np.int32), at, longer.view(np.int64))


def _hashed(docs: DataFrame, run: int, min_words: int, gaps: int) -> DataFrame:
    """h, g (96 bits), doc_id, k, f, t of the shortest runs (sentences f to t - 1); more: hashes of longer ones."""
    kind = dict(docs.dtypes)["doc_id"]

    def go(batches):
        for b in small_batches(batches, limit=2 << 20):
            data, at = text_bytes(b.column(2))
            x = runs(cut_up(data, at, gaps), run, min_words)
            row = pa.array(x.text)
            more = pa.ListArray.from_arrays(pa.array(x.more, pa.int32()), pa.array(x.longer))
            yield pa.RecordBatch.from_arrays([pa.array(x.h), pa.array(x.g), b.column(0).take(row), b.column(1).take(row), pa.array(x.first, pa.int32()), pa.array(x.last, pa.int32()), more], names=["h", "g", "doc_id", "k", "f", "t", "more"])

    return docs.mapInArrow(go, f"h long, g int, doc_id {kind}, k long, f int, t int, more array<long>")


def deduplicate(docs: DataFrame, *, run: int = 2, min_words: int = 24, gaps: int = 7, count: str = "n_removed") -> DataFrame:
    """docs with repeated sentence runs cut out of text, and the column `count`, the
    number of sentences (pieces) cut.

    The first occurrence of a run is the one of the smallest doc_id, then of the
    smallest text hash and place; a null doc_id comes first. All others lose the
    sentences they cover, inside one text too. Rows equal in doc_id and text are
    one document: each loses the same. Null text stays null; texts with too few
    sentences or words lose nothing; other columns stay as they are, but one of the
    name `count` is replaced. A word counts once, and in scripts without
    white space between words, every two characters count as one more. An empty
    table gives no rows.
    """
    docs = docs.drop(count)
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Texts are told apart by a hash only where ids don't do that: a column less to shuffle.
    unclear = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    key = F.xxhash64(text) if unclear else F.lit(0).cast("long")
    rows = docs.select("doc_id", key.alias("k"), text.alias("text"))
    with Scratch(spark) as scratch:
        found = _hashed(rows, run, min_words, gaps)
        # Written out, so that the joins are plain ones whose hot keys adaptive execution splits.
        often = scratch.table(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
        found = scratch.table(found.join(often, "h"))
        longer = found.where("size(more) > 0").select(F.posexplode("more").alias("i", "h"), "g", "doc_id", "k", "f", (F.col("t") + 1 + F.col("i")).alias("t"))
        found = found.drop("more").unionByName(longer.drop("i"))
        place = F.struct("doc_id", "k", "f")
        first = scratch.table(found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last"))
        gone = found.join(first, ["h", "g"]).where(~place.eqNullSafe(F.col("first")))
        gone = cut_table(gone.groupBy("doc_id", "k").agg(F.collect_set(F.struct("f", "t")).alias("gone")))
    k, d, runs_of = fresh(docs, "key", "id", "gone")
    keyed = docs.withColumn(k, key)
    gone = gone.select(F.col("doc_id").alias(d), F.col("k").alias(f"{k}_"), F.col("gone").alias(runs_of))
    both = keyed.join(gone, keyed.doc_id.eqNullSafe(F.col(d)) & (F.col(k) == F.col(f"{k}_")), "left").select(*docs.columns, runs_of)
    schema = T.StructType([*docs.schema.fields, T.StructField(count, T.LongType())])
    column = docs.columns.index("text")

    def cut(batches):
        for b in small_batches(batches):
            texts, lost = b.column(column).to_pylist(), [0] * b.num_rows
            for i, out in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if out:
                    dropped = {s for x in out for s in range(x["f"], x["t"])}
                    texts[i] = b"".join(p for s, p in enumerate(sentences(texts[i].encode(), gaps)) if s not in dropped).decode()
                    lost[i] = len(dropped)
            cols = [pa.array(texts, pa.string()) if c == column else b.column(c) for c in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lost, pa.int64())], names=schema.names)

    return both.mapInArrow(cut, schema)
