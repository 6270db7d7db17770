"""Near-duplicates by the exact similarity of their word shingles."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import shingle_sets, simhash
from lodestack.llm.common import Scratch
from lodestack.llm.components import components

from . import brute
from .conftest import sentence


def edited(rng: random.Random, text: str, edits: int) -> str:
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = sentence(rng, 1)
    return " ".join(w)


def test_appended_block_is_linked(spark):
    """Fingerprints alone miss these; keys of minimum hashes find them."""
    rng = random.Random(3)
    rows = []
    for k in range(0, 80, 2):
        text = " ".join(sentence(rng, 12) for _ in range(25))
        rows += [(k, text), (k + 1, text + " " + " ".join(sentence(rng, 12) for _ in range(5)))]  # 300 of 360 words
    words = [brute.majority(set(brute.words(brute.lower(t)))) for _, t in rows]
    assert sum((a ^ b).bit_count() > 7 for a, b in zip(words[::2], words[1::2])) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.alike(docs).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(k, k // 2 * 2) for k in range(80)]


def test_repeated_shingles_are_one_set(spark):
    rng = random.Random(5)
    once = sentence(rng, 40).rstrip(".")
    text = f"{once} {once} "
    docs = spark.createDataFrame([(1, text * 2), (2, text * 9), (3, sentence(rng, 40)), (4, "a b"), (5, "A  B"), (6, "a"), (7, ""), (8, None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.alike(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7}


@pytest.mark.parametrize("measure", ["cosine", "jaccard"])
def test_set_labels_equal_all_pairs(measure):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 32, (5, 60), np.uint32)
    sets = [np.unique(np.where(rng.random(60) < rng.random() / 4, rng.integers(0, 1 << 32, 60, np.uint32), base[k % 5])) for k in range(120)]
    label = list(range(120))
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both / (np.sqrt(len(sets[i]) * len(sets[j])) if measure == "cosine" else len(np.union1d(sets[i], sets[j]))) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    same = lambda a, b: len(set(zip(a, b))) == len(set(a)) == len(set(b))
    assert 5 < len(set(label)) < 120
    assert same(shingle_sets.set_labels(sets, 0.8, measure).tolist(), label)
    known = np.array([label.index(x) if i % 3 else i for i, x in enumerate(label)])  # some links known before
    assert same(shingle_sets.set_labels(sets, 0.8, measure, known).tolist(), label)


def test_keys_meet_at_the_bound():
    """A cosine of 0.8 of equal sets is a Jaccard index of 2/3: 0.997 of them share a key."""
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(2000):
        x = rng.integers(0, 1 << 32, 240, np.uint32)
        met += bool((shingle_sets.keys(np.unique(x[:200])) == shingle_sets.keys(np.unique(x[40:]))).any())
    assert met >= 1980


@pytest.mark.parametrize(("n_words", "edits"), [(40, 3), (120, 8), (300, 3)])
@pytest.mark.parametrize("n", [300, 1200])
def test_links_grow_with_a_group_of_near_copies(spark, n, n_words, edits):
    """Pairs that are verified, and links between what remains, stay linear in the group's size."""
    rng = random.Random(n)
    base = sentence(rng, n_words)
    docs = spark.createDataFrame([(k, edited(rng, base, edits)) for k in range(n)], "doc_id long, text string")
    sig = simhash._signatures(docs, 5, 42).cache()
    nodes = sig.select("s", "fp", "keys", "grams").dropDuplicates(["s"]).cache()
    scratch = Scratch(spark)
    rows = shingle_sets.filed(nodes, scratch)
    pairs = simhash._candidates(nodes.select("s", "fp"), 7, 20_000).unionByName(shingle_sets.pivots(rows)).distinct()
    assert pairs.count() <= 3 * nodes.count()
    once = components(shingle_sets.verified(pairs, nodes.select("s", "grams"), 0.8, "cosine"))
    assert shingle_sets.remaining_links(rows, once, nodes.select("s", "grams"), 0.8, "cosine", scratch).distinct().count() <= nodes.count()


def test_components_of_links_that_differ_each_time(spark):
    """A group's hub may be another one whenever its links are made again."""

    def stars(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            hubs = {g: random.SystemRandom().choice([i for i in ids if i % 40 == g]) for g in range(40)}
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([hubs[i % 40] for i in ids])], names=["a", "b"])

    links = spark.range(0, 400, 1, 1).mapInArrow(stars, "a long, b long")
    assert {r.node: r.label for r in components(links).collect()} == {i: i % 40 for i in range(400)}


def test_recall_and_precision_of_near_copies(spark):
    """Against all pairs: every linked group is one of exact similarity; hardly a pair is missed."""
    rng = random.Random(12)
    rows = []
    for k in range(0, 600, 3):
        base = " ".join(sentence(rng, rng.randint(6, 14)) for _ in range(rng.randint(3, 20)))
        n = len(base.split(" "))
        rows += [(k, base), (k + 1, edited(rng, base, rng.randint(0, n // 12))), (k + 2, edited(rng, base, rng.randint(0, n // 12)))]
    label = brute.alike([t for _, t in rows])
    got = {r.doc_id: r.component_id for r in simhash.alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [(i, c) for i, c in enumerate(label) if i != c]
    assert len(linked) > 150
    assert sum(got[i] == got[c] for i, c in linked) >= 0.98 * len(linked)
    assert all(label[i] == label[c] for i, c in got.items())
