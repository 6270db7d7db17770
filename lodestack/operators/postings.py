"""A trigram index: postings (gram, id) and lookups that confirm on the text.

A lookup reads the postings of a term's grams only (bucketed or partitioned by
gram hash when stored), keeps ids that have all of them, and confirms with
`contains` on those rows. For one query on an unindexed table a scan with
`contains` is the better plan; the index pays for stored corpora and for many
queries at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..query import Planned

GRAM = 3


#: Bytes of text of a segment.
SEGMENT = 2 << 20


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text begins and ends in them. Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if not len(data) or data.max() < 128:
        return data, at
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    try:
        return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), starts[at]
    except UnicodeDecodeError:  # broken bytes, each of which becomes U+FFFD
        return _codes(pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()], pa.large_string()))


def _segment(texts: pa.Array, n: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Grams of n characters in order, how many texts have each, and the numbers of these texts, gram by gram."""
    codes, at = _codes(texts)
    if len(codes) < n:
        return
    used = np.bincount(codes) > 0
    letters = np.flatnonzero(used)
    size, many = len(letters), len(texts)
    if size**n * many >= 1 << 63:  # scripts of many characters: fewer texts at a time
        for start, half in ((0, texts.slice(0, many // 2)), (many // 2, texts.slice(many // 2))):
            yield from ((names, counts, ids + start) for names, counts, ids in _segment(half, n))
        return
    small = (np.cumsum(used) - 1)[codes]
    gram = small[: len(small) - n + 1].copy()
    for k in range(1, n):
        gram *= size
        gram += small[k : len(small) - n + 1 + k]
    text = np.repeat(np.arange(many), np.diff(at))
    inside = text[: len(gram)] == text[n - 1 :]
    both = np.sort((gram * many + text[: len(gram)])[inside])
    if not len(both):
        return
    both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    gram, ids = np.divmod(both, many)
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    gram = gram[first]
    chars = np.stack([letters[gram // size ** (n - 1 - k) % size] for k in range(n)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    yield [chars[i : i + n] for i in range(0, len(chars), n)], np.diff(np.append(first, len(ids))), ids


def segments(rows: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (GRAM,)) -> DataFrame:
    """gram and ids: for each segment of rows, its distinct substrings of so many characters, in order, and the keys of the rows that have them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, texts = part.columns
            ends = np.cumsum(np.asarray(pc.binary_length(texts.fill_null("")), np.int64))
            at = 0
            while at < part.num_rows:
                most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SEGMENT, "right"))
                n = max(1, most - at)
                for size in sizes:
                    for names, counts, ids in _segment(texts.slice(at, n), size):
                        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                        yield pa.record_batch([pa.array(names, pa.string()), pa.ListArray.from_arrays(offsets, keys.take(pa.array(ids + at)))], ["gram", "ids"])
                at += n

    kind = rows.schema[key].dataType
    return rows.select(key, text).mapInArrow(run, T.StructType([T.StructField("gram", T.StringType()), T.StructField("ids", T.ArrayType(kind))]))


def build(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and gram of every distinct trigram of a row."""
    return segments(rows, key, text).select(F.explode("ids").alias(key), "gram")


def write(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Stores postings sorted by gram inside folders of gram hashes, so a lookup prunes both."""
    part = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")
    postings.withColumn("bucket", part).repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").mode("overwrite").parquet(path)


def lookup(postings: DataFrame, key: str, term: str, buckets: int | None = None) -> DataFrame:
    """Ids that have every trigram of term (three characters or more). Postings are rows of gram and key, or of gram and ids."""
    wanted = sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})
    rows = postings.where(F.col("gram").isin(wanted))
    if buckets:
        parts = [F.pmod(F.xxhash64(F.lit(g)), F.lit(buckets)).cast("int") for g in wanted]
        rows = rows.where(reduce(lambda a, b: a | b, (F.col("bucket") == p for p in parts)))
    if "ids" in postings.columns:
        rows = rows.select("gram", F.explode("ids").alias(key))
    return rows.groupBy(key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select(key)


def candidates(p: Planned, postings: DataFrame, key: str) -> DataFrame:
    """Ids that can match: terms combined by AND, or OR for mode any; by the first term where that alone confirms.

    The index holds lower-cased text, so terms of a case-sensitive query are lowered.
    """
    terms = p.terms if p.query.mode in ("all", "any") else p.terms[:1]
    found = [lookup(postings, key, t.lower()) for t in terms]
    if p.query.mode == "any":
        return reduce(DataFrame.unionByName, found).distinct()
    return reduce(lambda a, b: a.join(b, key, "left_semi"), found)


def contained(needles: DataFrame, needle_key: str, needle: str, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(needle_key, key) of every needle that occurs in a row's text.

    An equi-join on the needle's rarest trigram finds candidates, `contains`
    confirms them; so there is no nested loop and one row per gram is enough to
    shuffle on the needle's side. Needles shorter than that are joined on their
    whole length; empty ones are in every row that isn't null.
    """
    n = F.length(needle)
    rows = rows.select(key, text)
    few = needles.where((n > 0) & (n < GRAM)).select(needle_key, F.col(needle).alias("gram"))
    short = segments(rows, key, text, tuple(range(1, GRAM))).join(few, "gram").select(needle_key, F.explode("ids").alias(key))
    empty = needles.where(n == 0).select(needle_key, F.lit(1).alias("__one")).join(rows.where(F.col(text).isNotNull()).select(key, F.lit(1).alias("__one")), "__one").select(needle_key, key)
    needles = needles.where(n >= GRAM)
    at = F.explode(F.sequence(F.lit(1), n - (GRAM - 1)))
    own = needles.select(needle_key, needle, at.alias("__at")).select(needle_key, needle, F.substring(needle, F.col("__at"), F.lit(GRAM)).alias("gram")).distinct()
    # Only grams of needles are kept before anything is shuffled, and only the chosen ones' ids become rows.
    postings = segments(rows, key, text)
    df = postings.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum(F.size("ids")).alias("df"))
    rare = own.join(df, "gram", "left").groupBy(needle_key, needle).agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
    pairs = postings.join(rare, "gram").select(needle_key, needle, F.explode("ids").alias(key))
    long = pairs.join(rows, key).where(F.col(text).contains(F.col(needle))).select(needle_key, key)
    return long.unionByName(short).unionByName(empty)
