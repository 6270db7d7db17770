"""Sorting byte strings by deep-shallow: multikey quicksort, then blind tries.

Both give, for every string but the first, the length of the longest common
prefix with its predecessor.
"""

from __future__ import annotations

SHALLOW = 16  # bytes that multikey quicksort looks at before blind tries take over


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, which share `known` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


class BlindTrie:
    """A trie that keeps branching depths and bytes only; strings are read once per insertion."""

    def __init__(self, strings: list[bytes], shared: int):
        self.strings, self.shared = strings, shared
        self.root = None  # a leaf: position of a string; else [depth, {byte: child}, leaf below]
        self.same: dict[int, list[int]] = {}  # equal strings, by their first position

    def insert(self, i: int) -> None:
        strings, node = self.strings, self.root
        if node is None:
            self.root = i
            return
        s = strings[i]
        while type(node) is list:  # blind: bytes between branches aren't compared
            node = node[1].get(_at(s, node[0]), node[2])
        other = strings[node]
        depth = common_prefix(s, other, self.shared)
        if depth == len(s) == len(other):
            self.same.setdefault(node, []).append(i)
            return
        above, key, node = None, 0, self.root
        while type(node) is list and node[0] < depth:
            above, key = node, _at(s, node[0])
            node = node[1][key]
        if type(node) is list and node[0] == depth:
            node[1][_at(s, depth)] = i
            return
        branch = [depth, {_at(s, depth): i, _at(other, depth): node}, i]
        if above is None:
            self.root = branch
        else:
            above[1][key] = branch

    def walk(self, out: list[tuple[int, int]], first: int) -> None:
        stack = [(self.root, first)]
        while stack:
            node, lcp = stack.pop()
            if type(node) is list:
                depth, below, _ = node
                order = sorted(below)
                stack.extend((below[c], depth) for c in reversed(order[1:]))
                stack.append((below[order[0]], lcp))
            else:
                out.append((node, lcp))
                out.extend((i, len(self.strings[i])) for i in self.same.get(node, ()))


def deep_shallow(strings: list[bytes], shared: int = 0, shallow: int = SHALLOW) -> list[tuple[int, int]]:
    """(position, common prefix with the predecessor) in sorted order; all share `shared` bytes.

    The first entry's prefix is 0. Empty input gives an empty list; equal strings
    stand in any order.
    """
    out: list[tuple[int, int]] = []
    stack = [(list(range(len(strings))), shared, 0)] if strings else []
    while stack:
        items, depth, lcp = stack.pop()
        if len(items) == 1:
            out.append((items[0], lcp))
        elif depth >= shared + shallow:
            trie = BlindTrie(strings, depth)
            for i in items:
                trie.insert(i)
            trie.walk(out, lcp)
        else:
            keys = [_at(strings[i], depth) for i in items]
            pivot = keys[len(keys) // 2]
            less = [i for i, k in zip(items, keys) if k < pivot]
            same = [i for i, k in zip(items, keys) if k == pivot]
            more = [i for i, k in zip(items, keys) if k > pivot]
            if more:
                stack.append((more, depth, depth))
            first = depth if less else lcp
            if pivot < 0:  # ended: all equal
                tail = [(i, len(strings[i])) for i in same[1:]]
                if less:
                    raise AssertionError("nothing sorts before an end")
                out.append((same[0], first))
                out.extend(tail)
            else:
                stack.append((same, depth + 1, first))
            if less:
                stack.append((less, depth, lcp))
    return out
