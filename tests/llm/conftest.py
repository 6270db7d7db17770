from __future__ import annotations

import random

import pytest

ODD = [None, "", " \n\t ", "a", "The MIT License", "ß É 中文 words here", "x" * 5000, "w " * 3000, "...!?", "0 1 2", "\x00 nul", "same text twice " * 60, "same text twice " * 60, "fluff of a leaf " * 9 + "of"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ba", "do", "ri", "mu", "len", "tas"]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    """Texts with exact and near copies, shared passages, and every odd case."""
    rng = random.Random(7)
    out: list[str | None] = [" ".join(sentence(rng, rng.randint(4, 14)) for _ in range(rng.randint(3, 40))) for _ in range(60)]
    passage = " ".join(sentence(rng, 11) for _ in range(8))
    for i in range(0, 30, 3):
        out.append(out[i])
        w = out[i].split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
        out.append(f"{out[i + 1]} {passage} {out[i + 2][:200]}")
    return out + ODD


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with null ids and languages, ids repeated as rows, and extra columns of clashing names."""
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "A row without an id.", None, None, None), rows[0], rows[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k long, fp string, word string, row int, score double, spans string, h string"
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 0.5, None, "z") for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
