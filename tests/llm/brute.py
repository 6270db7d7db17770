"""Plain re-derivations of the operators' results."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def majority(features) -> int:
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in features]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def fingerprint(text: str | None, n: int = 3) -> int:
    w = words(lower(text or ""))
    return majority([" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else [])


def components(ids: list, fps: list[int], distance: int = 3) -> list:
    """Smallest id reachable over links of `distance` bits, for each row."""
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                label[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words(lower(text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def alike(texts: list, similarity: float = 0.8, measure: str = "cosine") -> list[int]:
    """Smallest position reachable over pairs of texts whose sets of five-word shingles are alike."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both / (math.sqrt(len(a) * len(b)) if measure == "cosine" else len(a | b)) >= similarity:
                low, high = sorted((find(i), find(j)))
                label[high] = low
    return [find(i) for i in range(len(sets))]


def sentences(text: str | None) -> list[str]:
    """Pieces between sentence ends that white space follows, without cuts inside sentences."""
    return [x for x in re.split(r"(?<=[.!?])[\x20\x09-\x0D]+|(?<=[.!?][\"')\]}])[\x20\x09-\x0D]+|[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*", text or "") if words(x)]


def repeated_sentences(rows: list[tuple], cut=sentences, run: int = 2, least: int = 24) -> list[set[int]]:
    """For each (doc_id, text), in the order that tells which comes first: the pieces that a run covers which isn't the first of its kind.

    All runs of `run` or more pieces and `least` or more words are compared, of any length.
    """
    found = []
    for r, (_, text) in enumerate(rows):
        pieces = [words(lower(x)) for x in cut(text)]
        for i in range(len(pieces)):
            content, n = hashlib.blake2b(digest_size=16), 0
            for j in range(i, len(pieces)):
                content.update("".join(f"{w} " for w in pieces[j]).encode())
                n += len(pieces[j])
                if j + 1 - i >= run and n >= least:
                    found.append((content.digest(), r, i, j + 1))
    first: dict = {}
    for content, r, i, _ in found:
        first.setdefault(content, (r, i))
    longest: dict = {}
    for content, r, i, j in found:
        if first[content] != (r, i):
            longest[r, i] = max(j, longest.get((r, i), 0))
    gone: list[set[int]] = [set() for _ in rows]
    for (r, i), j in longest.items():
        gone[r].update(range(i, j))
    return gone


def repeated_bytes(texts: list[bytes], length: int = 400) -> list[tuple[int, int, int, str]]:
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def held_out(doc_id, folds: int, part: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == part


def word_scores(rows: list[tuple]) -> list[tuple]:
    tokens = [[*words(lower(t or "")), None] for _, t in rows]
    train = Counter(x for (i, _), ts in zip(rows, tokens) if not held_out(i, 7, 2) for x in ts)
    n, v = sum(train.values()), len(train)
    return [(held_out(i, 7, 2), len(ts), sum(train[x] > 0 for x in ts), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in ts)) for (i, _), ts in zip(rows, tokens)]


UNITS = {"km", "miles", "m"}


def template(text: str) -> list[tuple[str, str]]:
    """(token, value): words as they are, placeholders for numbers, names inside sentences, and units after numbers."""
    out: list[tuple[str, str]] = []
    for sentence in re.split(r"[.!?\n](?!\d)", re.sub(r"(?<=\d)[.,](?=\d)", "", text)):
        before = None
        for k, w in enumerate(re.findall(r"[A-Za-z0-9]+", sentence)):
            kind = "<n>" if w.isdigit() else "<u>" if w.lower() in UNITS and before == "<n>" else "<p>" if k and len(w) > 1 and w[0].isupper() and w[1:].islower() else w.lower()
            if kind == before and kind in ("<n>", "<p>"):
                out[-1] = (kind, f"{out[-1][1]} {w}")
            else:
                out.append((kind, w))
            before = kind
    return out


def contaminated(text: str, item: str, window: int = 8, share: float = 0.5) -> bool:
    """Whether half of the item stands aligned in the text, a window of it in one piece, with slots that map one to one."""
    a, b = template(text), template(item)
    for start in range(-len(b) + 1, len(a)):
        pairs = [(x, y) if 0 <= start + i < len(a) and (x := a[start + i])[0] == y[0] else None for i, y in enumerate(b)]
        if not any(all(pairs[i : i + window]) and sum(p[1][0][0] != "<" for p in pairs[i : i + window]) * 2 >= window for i in range(len(b) - window + 1)):
            continue
        slots = {(y[0], y[1], x[1]) for p in pairs if p for x, y in [p] if y[0][0] == "<"}
        once = len({(k, v) for k, v, _ in slots}) == len({(k, w) for k, _, w in slots}) == len(slots)
        if sum(map(bool, pairs)) >= share * len(b) and once:
            return True
    return False
