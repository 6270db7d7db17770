"""Language identification by cross-parsing.

A suffix automaton of labelled text per language gives, from any place of a
text, the longest string that occurs in that language's text. A text is parsed
into such phrases. A phrase is named by a place in the training text and a
length, so with n bytes of training text it counts as log2(n) + LENGTH_BITS bits;
the language that needs the fewest bits wins. A language of less training text
has shorter phrases at a lower price, and takes nothing from the others.

The automata become dense transition tables in which a failed step starts a new
phrase, so a whole batch is parsed in lockstep with array operations: texts are
laid out in blocks of `block` bytes, and a phrase ends with its block.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, text_bytes

SAMPLE_BYTES = 40_000  # training text of a language, at most
TOTAL_BYTES = 800_000  # of all languages together, which then get equal parts of it at most
SAMPLE_ROWS = 100
EXCERPT = 20_000  # characters of a longer training text that are used, from a place that its hash names
LENGTH_BITS = 4


def prepared(text: str) -> bytes:
    """Lower case; runs of ASCII characters that aren't letters become one space."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text) if text.isascii() else any(unicodedata.category(c)[0] == "L" for c in text)


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of each state; every path from state 0 spells a substring of data."""
    to: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in data:
        cur = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(to)
                to.append(to[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return to


def parse_table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte, and table[state * classes + class] = next state * 2 + 1 if a phrase begins.

    State 0 stands before any phrase; a byte that data lacks is a phrase by itself.
    """
    to = suffix_automaton(data)
    seen = sorted(set(data))
    k = len(seen) + 1  # class 0: bytes that data lacks
    classes = np.zeros(256, np.int32)
    classes[seen] = np.arange(1, k)
    root = np.ones(k, np.int32)
    for c, s in to[0].items():
        root[classes[c]] = s * 2 + 1
    table = np.tile(root, (len(to), 1))
    for s, step in enumerate(to):
        if s:
            for c, t in step.items():
                table[s, classes[c]] = t * 2
    return classes, table.ravel()


def phrases(data: np.ndarray, at: np.ndarray, classes: np.ndarray, table: np.ndarray, block: int) -> np.ndarray:
    """Phrases of each text of a batch (at: offsets)."""
    k = int(classes.max()) + 1
    n = np.diff(at)
    blocks = -(-n // block)
    owner = np.repeat(np.arange(len(n)), blocks)
    first = np.cumsum(blocks) - blocks
    start = at[:-1][owner] + (np.arange(len(owner)) - first[owner]) * block
    size = np.minimum(block, at[1:][owner] - start)
    order = np.argsort(-size, kind="stable")
    start, size, owner = start[order], size[order], owner[order]
    alive = len(size) - np.searchsorted(size[::-1], np.arange(block), "right")
    symbols = classes[data]
    state = np.zeros(len(size), np.int32)
    count = np.zeros(len(size), np.int32)
    for i in range(block):
        m = alive[i]
        if not m:
            break
        got = table[state[:m] * k + symbols[start[:m] + i]]
        count[:m] += got & 1
        state[:m] = got >> 1
    return np.bincount(owner, weights=count, minlength=len(n)).astype(np.int64)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """Up to `rows` labelled texts of each language, in hash order: the bounded training sample.

    Texts of any length count; of longer ones an excerpt of EXCERPT characters is
    used. Hashes alone are ranked, first within 64 classes of them, so no task ranks a
    whole language and no text is shuffled; then the chosen texts are fetched.
    """
    text = F.col("text").cast("string")
    place = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.length(text) - EXCERPT + 1)) + 1
    known = docs.where("lang is not null and text is not null").select("lang", F.substring(text, place.cast("int"), F.lit(EXCERPT)).alias("text"), F.xxhash64(text).alias("__h"))
    hashes = known.select("lang", "__h").distinct()
    for by in (["lang", F.pmod("__h", F.lit(64))], ["lang"]):
        hashes = hashes.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).where(F.col("__r") <= rows).drop("__r")
    chosen = [r["__h"] for r in hashes.select("__h").distinct().collect()]
    texts = {(r[0], r[1], r[2]) for r in known.where(F.col("__h").isin(chosen)).collect()} if chosen else set()
    out: dict[str, list[tuple[int, str]]] = {}
    for lang, text, h in texts:
        out.setdefault(lang, []).append((h, text))
    return [(lang, text) for lang in sorted(out) for _, text in sorted(out[lang])[:rows]]


def train(rows: list[tuple[str, str]], sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> list[tuple[str, bytes]]:
    """Text of each language, sample_bytes at most, and total_bytes for all. Texts without a letter teach nothing."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in rows:
        if has_letter(text) and len(t := prepared(text)):
            texts.setdefault(lang, []).append(t)
    most = min(sample_bytes, total_bytes // max(1, len(texts)))
    return [(lang, b" ".join(t)[: max(1, most)]) for lang, t in sorted(texts.items())]


def predict(docs: DataFrame, model: list[tuple[str, bytes]], block: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score and n_phrases beside the columns `keep` of docs."""
    keep = keep or ["doc_id"]
    others = [c for c in keep if c != "text"]
    langs = [lang for lang, _ in model]
    price = np.array([[np.log2(len(t)) + LENGTH_BITS] for _, t in model])

    def run(batches):
        tables = [parse_table(t) for _, t in model]
        for b in small_batches(batches, "__text", 2 << 20):
            texts = b.column(0).to_pylist()
            ready = [prepared(t) if t is not None and has_letter(t) else b"" for t in texts]
            data = np.frombuffer(b"".join(ready), np.uint8)
            at = np.r_[0, np.cumsum([len(t) for t in ready])].astype(np.int64)
            counts = np.array([phrases(data, at, c, t, block) for c, t in tables]).reshape(len(tables), len(texts))
            bits = counts * price if len(tables) else counts
            known = (np.diff(at) > 0) & bool(len(tables))
            pred, score, n = [], [], []
            for i in range(len(texts)):
                if not known[i]:
                    pred.append("und")
                    score.append(0.0)
                    n.append(None)
                    continue
                order = np.argsort(bits[:, i], kind="stable")
                best, second = bits[order[0], i], bits[order[1], i] if len(langs) > 1 else (at[i + 1] - at[i]) * price[0, 0] + 1
                pred.append(langs[order[0]])
                score.append(float(second / (best + second)))
                n.append(int(counts[order[0], i]))
            yield pa.RecordBatch.from_arrays([*(b.column(0) if c == "text" else b.column(1 + others.index(c)) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())], names=[*(f"c{i}" for i in range(len(keep))), "lang_pred", "score", "n_phrases"])

    kinds = dict(docs.dtypes)
    out = docs.select(F.col("text").cast("string").alias("__text"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(others)))
    schema = ", ".join(f"c{i} {'string' if c == 'text' else kinds[c]}" for i, c in enumerate(keep))
    out = out.mapInArrow(run, f"{schema}, lang_pred string, score double, n_phrases long")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "n_phrases")


def identify(docs: DataFrame, *, folds: int = 4, held_out: int = 2, block: int = 1024, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_phrases for every row of docs.

    Learns from text and non-null lang of rows whose crc32(doc_id as text) mod
    folds isn't held_out: a bounded sample of up to sample_rows texts a language
    (those of smallest hash), sample_bytes of each language at most and
    total_bytes together. Predictions read whole texts only.

    lang_pred is `und` (score 0) if text is null or has no letter, or if nothing
    could be learned; a null doc_id is never held out. score is
    second / (best + second) of the bits, 0.5 for a tie, which the
    alphabetically first language wins. Repeated rows each get their row; other
    columns are ignored; an empty table gives no rows.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out, F.lit(False))
    model = train(sample(docs.where(~out).select("lang", "text"), sample_rows), sample_bytes, total_bytes)
    found = predict(docs.select("doc_id", "text"), model, block)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "n_phrases")


__all__ = ["identify", "phrases", "predict", "sample", "train"]
