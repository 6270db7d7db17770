"""Edit-aware token counts.

A document's pre-tokens (the pieces that the tokenizer's pattern cuts) are the
leaves of a segment tree whose nodes hold token counts. An edit re-splits and
re-encodes only the pre-tokens it touches and the boundary context in which the
pattern may decide otherwise, until a piece ends where an old one ended; the
tree's sums along the way up follow. Unchanged pre-tokens are never read again.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_right

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Where public vocabulary files are looked for by default.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits text before merges in this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BLOCK = 64  # pre-tokens in a leaf block of the tree
CACHE = 1 << 18


class Counter(dict):
    """Token counts of pre-tokens, kept for up to CACHE of them."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding._encode_single_piece(piece))
        if len(self) >= CACHE:
            self.clear()
        self[piece] = n
        return n


class Tree:
    """Pre-tokens of a text in blocks, under a segment tree of (characters, tokens)."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.recounted = 0
        pieces = counter.pieces.findall(text)
        counts = list(map(counter.__getitem__, pieces))
        self.blocks = [(pieces[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(pieces), BLOCK)] or [([], [])]
        self._build()

    def _build(self) -> None:
        self.width = 1
        while self.width < len(self.blocks):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (pieces, counts) in enumerate(self.blocks, self.width):
            self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(counts)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join("".join(p) for p, _ in self.blocks)

    def _find(self, at: int) -> tuple[int, int]:
        """Block that holds character `at`, and its first character."""
        i, first = 1, 0
        while i < self.width:
            i *= 2
            if at >= first + self.chars[i] and self.chars[i + 1]:
                first += self.chars[i]
                i += 1
        return i - self.width, first

    def _set(self, i: int, pieces: list[str], counts: list[int]) -> None:
        self.blocks[i] = (pieces, counts)
        i += self.width
        self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(counts)
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts `new` in the place of characters start to end - 1."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        # Left context: whole pre-tokens up to one that the pattern could not have seen the edit from.
        b, first = self._find(max(0, start - 1))
        pieces, counts = list(self.blocks[b][0]), list(self.blocks[b][1])
        left = b

        def ends_at(pieces: list[str], first: int) -> list[int]:
            out = []
            for p in pieces:
                first += len(p)
                out.append(first)
            return out

        while True:
            ends = ends_at(pieces, first)
            keep = bisect_right(ends, start - 1) if start else 0  # pieces that end before the edit
            keep -= 1  # the last of them reads one character on
            while keep > 0 and pieces[keep - 1].isspace():  # white space reads on to its end
                keep -= 1
            if keep > 0 or left == 0:
                keep = max(keep, 0)
                break
            left -= 1
            more = self.blocks[left]
            pieces, counts = list(more[0]) + pieces, list(more[1]) + counts
            first -= sum(map(len, more[0]))
        begin = ends[keep - 1] if keep else first
        # Right context: further blocks until a new piece ends where an old one ended.
        right, old, olds = b, pieces[keep:], ends[keep:]
        while right + 1 < len(self.blocks) and (not olds or olds[-1] < end):
            right += 1
            old += self.blocks[right][0]
            olds = ends_at(old, begin)
        shift = len(new) - (end - start)
        while True:
            text = "".join(old)
            text = text[: start - begin] + new + text[end - begin :]
            whole = right + 1 == len(self.blocks)
            known = {e + shift: i for i, e in enumerate(olds) if e >= end}
            made, at, stop = [], begin, None
            for m in self.counter.pieces.finditer(text):
                at = begin + m.end()
                if not whole and m.end() == len(text):
                    break  # the pattern has not seen what follows
                made.append(m[0])
                if at in known and at >= start + len(new):
                    stop = known[at]  # the pattern never looks back, so old pieces follow
                    break
            if stop is not None or whole:
                break
            right += 1
            old = old + self.blocks[right][0]
            olds = ends_at(old, begin)
        rest = old[stop + 1 :] if stop is not None else []
        self.recounted += len(made)
        done = pieces[:keep] + made + rest
        number = list(map(self.counter.__getitem__, made))
        tail = [c for i in range(b + 1, right + 1) for c in self.blocks[i][1]]
        kept = (counts + tail)[len(counts) + len(tail) - len(rest) :] if rest else []
        total = counts[:keep] + number + kept
        span = right - left + 1
        if len(done) > 2 * BLOCK * span:  # grown too far: new blocks
            cutup = [(done[i : i + BLOCK], total[i : i + BLOCK]) for i in range(0, len(done), BLOCK)]
            self.blocks[left : right + 1] = cutup
            self._build()
            return
        for i in range(span):
            lo, hi = i * len(done) // span, (i + 1) * len(done) // span
            self._set(left + i, done[lo:hi], total[lo:hi])


# What a scrubbing pass masks.
MASKS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"),
    (r"\+\d{1,2} \(\d{3}\) \d{3}-\d{4}", "<phone>"),
    (r"\b\d{13,19}\b", "<number>"),
    (r"\b(?:AKIA[A-Z0-9]{16}|[0-9a-f]{18,40})\b", "<secret>"),
]


def mask_edits(text: str, masks=MASKS) -> list[tuple[int, int, str]]:
    """Edits (start, end, new) that mask each match, from the end of the text to its start."""
    if masks is MASKS and not _NEEDED.search(text):
        return []
    found = sorted((m.start(), m.end(), new) for pattern, new in masks for m in re.finditer(pattern, text))
    out, at = [], 0
    for start, end, new in found:
        if start >= at:
            out.append((start, end, new))
            at = end
    return out[::-1]


_NEEDED = re.compile(r"[\d@]|AKIA|[0-9a-f]{18}")  # no mask matches a text without one of these


def count(docs: DataFrame, *, edits: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_pretokens, n_recounted for every row of docs.

    edits: name of a column array<struct<start: int, end: int, new: string>>,
    applied in order, each to the text as the ones before left it (places in
    characters; those beyond the text are clipped; null is no edit). Without it,
    the edits are those of a scrubbing pass (MASKS). n_tokens counts the text,
    n_tokens_edited the edited text; n_recounted tells how many pre-tokens the
    edits re-encoded. vocabulary is a path that the driver can read; executors are
    sent the file. Null
    text counts as empty; repeated rows each get their row; other columns are
    ignored; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches):
        counter = Counter(SparkFiles.get(name))
        for b in small_batches(batches):
            cols: list[list] = [[] for _ in range(5)]
            given = b.column(2).to_pylist() if edits else [None] * b.num_rows
            for text, todo in zip(b.column(0).to_pylist(), given):
                text = text or ""
                todo = [(e["start"] or 0, e["end"] or 0, e["new"] or "") for e in todo or ()] if edits else mask_edits(text)
                tree = Tree(text, counter)
                before = tree.total
                for e in todo:
                    tree.edit(*e)
                row = (before, len(todo), tree.total, sum(len(p) for p, _ in tree.blocks), tree.recounted)
                for c, x in zip(cols, row):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_recounted"])

    more = [F.col(edits).cast("array<struct<start: int, end: int, new: string>>").alias("edits")] if edits else []
    return docs.select(F.col("text").cast("string").alias("text"), "doc_id", *more).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_edited long, n_pretokens long, n_recounted long")
