"""Shared passages hold a common run wherever they stand."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodestack.llm import span_dedup


def words(rng: random.Random, n: int, end: float, letters: str = "abcdefghijklmnop") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) + ("." if rng.random() < end else "") for _ in range(n))


@pytest.mark.parametrize("letters", ["abcdefghijklmnop", "कखगघङचछजझ", "абвгдежзик"])
@pytest.mark.parametrize("end", [0, 0.08, 0.3])
def test_every_passage_of_51_words_is_found(end, letters):
    rng = random.Random(4)
    for _ in range(300):
        passage = words(rng, 51, end, letters)
        found = []
        for _ in range(2):
            text = " ".join((words(rng, rng.randint(0, 60), end, letters), passage, words(rng, rng.randint(0, 60), end, letters)))
            data = np.frombuffer(text.encode(), np.uint8)
            found.append({*span_dedup.runs(span_dedup.cut_up(data, np.array([0, len(data)]), 7), 2, 24).h.tolist()})
        assert found[0] & found[1]


def test_pieces_are_short_and_end_with_sentences():
    rng = random.Random(6)
    assert max(len(p.split()) for p in span_dedup.sentences(words(rng, 5000, 0).encode())) == 7
    for end in "।॥。！？｡؟۔።။។!?":
        assert span_dedup.sentences(f"ab cd{end} ef".encode()) == [f"ab cd{end} ".encode(), b"ef"]
    assert span_dedup.sentences(b" \n ") == [b" \n "]


def test_passage_inside_sentences_is_cut(spark):
    rng = random.Random(8)
    passage = words(rng, 60, 0, "कखगघङचछजझ")
    docs = spark.createDataFrame([(i, " ".join((words(rng, 20, 0), passage, words(rng, 20, 0)))) for i in range(2)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in span_dedup.deduplicate(docs).collect()}
    assert passage in left[0]
    assert len(left[1].split()) <= 100 - 24


def test_batches_are_cut_like_single_texts():
    rng = random.Random(9)
    texts = [words(rng, rng.randint(0, 300), 0.1).encode() for _ in range(40)] + [b"", b" ", b"\n a", "。中文。".encode(), b"x" * 10_000, b"end"]
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    whole = span_dedup.cut_up(np.frombuffer(b"".join(texts), np.uint8), at, 7)
    for i, t in enumerate(texts):
        one = span_dedup.cut_up(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 7)
        m = whole.text == i
        assert (whole.word[whole.piece[m]] - at[i]).tolist() == one.word[one.piece].tolist()
    every = span_dedup.runs(whole, 2, 24)
    for i, t in enumerate(texts):
        one = span_dedup.runs(span_dedup.cut_up(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 7), 2, 24)
        m = np.flatnonzero(every.text == i)
        assert [every.h[m].tolist(), every.first[m].tolist(), every.last[m].tolist()] == [one.h.tolist(), one.first.tolist(), one.last.tolist()]
        assert every.longer[every.more[m[0]] : every.more[m[-1] + 1]].tolist() == one.longer.tolist() if len(m) else not len(one.longer)


def test_words_beside_each_other_never_collide():
    """Runs of other words have other hashes, whatever their order."""
    rng = random.Random(10)
    pool = ["a", "b", "ab", "ba", "x" * 5000, "x" * 4999 + "y"]
    seen: dict = {}
    for _ in range(400):
        text = " ".join(rng.choice(pool) for _ in range(30)).encode()
        one = span_dedup.runs(span_dedup.cut_up(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 7), 2, 24)
        cut = span_dedup.cut_up(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 7)
        edge = [*cut.piece.tolist(), 30]
        for f, t, h in zip(one.first.tolist(), one.last.tolist(), one.h.tolist()):
            content = tuple(text.split()[edge[f] : edge[t]])
            assert seen.setdefault(h, content) == content
