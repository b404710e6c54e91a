"""Binary tries over sorted 64-bit words, and the join of two of them within a Hamming distance.

A trie is path-compressed: an inner node stands where two neighbours in sorted order first differ, leaves are the words.
Nodes are numbers: 1 to n - 1 are the inner nodes (node s parts word s - 1 from word s), n + i is word i.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 64
#: Node pairs that are taken on at a time.
CHUNK = 1 << 17


def leading(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """x with all but its first `bits` bits cleared."""
    shift = (BITS - bits).astype(np.uint64)
    return np.where(bits > 0, (x >> (shift & np.uint64(63))) << (shift & np.uint64(63)), np.uint64(0))


def first_difference(x: np.ndarray) -> np.ndarray:
    """How many leading bits of each word are 0."""
    x, n = x.copy(), np.zeros(len(x), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        low = x < (np.uint64(1) << np.uint64(64 - step))
        n[low] += step
        x[low] <<= np.uint64(step)
    return n


class Trie:
    """words: sorted and distinct. depths: how many bits of each word count (its prefix), 64 where not given; no word may
    begin with another's prefix."""

    def __init__(self, words: np.ndarray, depths: np.ndarray | None = None):
        n = len(words)
        self.n, self.words = n, words
        self.depth = np.full(2 * n, BITS, np.int64)
        self.word = np.concatenate([words, words])
        self.left, self.right = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        if depths is not None:
            self.depth[n:] = depths
        self.root = n  # of one word
        self.levels: list[np.ndarray] = []  # inner nodes, the deepest first
        if n > 1:
            self._join(first_difference(words[1:] ^ words[:-1]))

    def _join(self, depth: np.ndarray) -> None:
        """A node hangs below the deeper of the nearest less deep ones on its left and on its right."""
        n = self.n
        at = np.concatenate([[-1], depth, [-1]])  # of node s; the ends are above all
        self.depth[1:n] = depth
        for d in np.unique(depth):
            s, above = np.flatnonzero(at == d), np.flatnonzero(at < d)
            k = np.searchsorted(above, s)
            self._hang(s, above[k - 1], above[k], at)
            self.levels.insert(0, s)
        s = np.arange(n)
        self._hang(s + n, s, s + 1, at)

    def _hang(self, nodes: np.ndarray, on_left: np.ndarray, on_right: np.ndarray, at: np.ndarray) -> None:
        is_right = at[on_left] > at[on_right]
        self.right[on_left[is_right]] = nodes[is_right]
        under = ~is_right & (at[on_right] >= 0)
        self.left[on_right[under]] = nodes[under]
        for root in nodes[(at[on_left] < 0) & (at[on_right] < 0)]:
            self.root = int(root)

    def uniform(self, labels: np.ndarray) -> np.ndarray:
        """For each node the label that all words below it have, or -1. labels: of each word."""
        out = np.full(2 * self.n, -1, np.int64)
        out[self.n :] = labels
        for s in self.levels:
            a, b = out[self.left[s]], out[self.right[s]]
            out[s] = np.where(a == b, a, -1)
        return out


def grouped(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each a label of itself, and no greater than its index), with the groups of a[i] and b[i] made one."""
    labels = labels.copy()
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        high, low = np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart])
        np.minimum.at(labels, high, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def _steps(a: Trie, b: Trie, u: np.ndarray, v: np.ndarray, budget: int, settled) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words i of a and k of b whose prefixes differ in at most budget bits, from the node pairs (u, v) downwards.

    Of a pair, the node that parts earlier makes way for its two children. Bits that both sides of a pair share with all
    below them have been compared by then: a pair beyond the budget goes, and with it all pairs below.
    """
    stack = [(u, v)]
    while stack:
        u, v = stack.pop()
        if len(u) > CHUNK:
            stack += [(u[k : k + CHUNK], v[k : k + CHUNK]) for k in range(0, len(u), CHUNK)]
            continue
        while len(u):
            known = np.minimum(a.depth[u], b.depth[v])
            keep = np.bitwise_count(leading(a.word[u] ^ b.word[v], known)) <= budget
            if settled is not None:
                keep &= ~settled(u, v)
            u, v = u[keep], v[keep]
            inner_u, inner_v = u < a.n, v < b.n
            leaf = ~inner_u & ~inner_v
            if leaf.any():
                yield u[leaf] - a.n, v[leaf] - b.n
            first = inner_u & (~inner_v | (a.depth[u] <= b.depth[v]))
            second = ~leaf & ~first
            x, y, w, z = u[first], v[first], u[second], v[second]
            u = np.concatenate([a.left[x], a.right[x], w, w])
            v = np.concatenate([y, y, b.left[z], b.right[z]])
            if len(u) > CHUNK:
                stack.append((u[CHUNK:], v[CHUNK:]))
                u, v = u[:CHUNK], v[:CHUNK]


def pairs(a: Trie, b: Trie, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, k) with words i of a and k of b within budget."""
    if not a.n or not b.n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = list(_steps(a, b, np.array([a.root]), np.array([b.root]), budget, None))
    return tuple(np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in (0, 1))


def classes(own: np.ndarray, guests: np.ndarray, within: bool, budget: int) -> np.ndarray:
    """A label for each of own, then guests: equal for words that a chain of links (own with guests; with `within`, own
    with own) leads to one another; each label is the index of a word of its class.

    The budget grows from one bit, and a pair of nodes below which all words are of one class already is passed over, so a
    crowd of words close to one another is linked along few of its pairs.
    """
    a, b = Trie(own), Trie(guests)
    labels = np.arange(a.n + b.n)
    state: list[np.ndarray] = []

    def look() -> None:
        state[:] = [a.uniform(labels[: a.n]), b.uniform(labels[a.n :])]

    def joined(other: Trie, shift: int, u: np.ndarray, v: np.ndarray, allowed: int) -> None:
        nonlocal labels
        side = 1 if other is b else 0
        look()
        found, n_found = [], 0
        for i, k in _steps(a, other, u, v, allowed, lambda x, y: (state[0][x] >= 0) & (state[0][x] == state[side][y])):
            found.append((i, k + shift))
            n_found += len(i)
            if n_found > max(CHUNK, len(labels)):
                labels = grouped(labels, *(np.concatenate(x) for x in zip(*found, strict=True)))
                found, n_found = [], 0
                look()
        if found:
            labels = grouped(labels, *(np.concatenate(x) for x in zip(*found, strict=True)))

    for allowed in range(1, budget + 1):
        if within and a.n > 1:
            inner = np.arange(1, a.n)
            joined(a, 0, a.left[inner], a.right[inner], allowed)
        if a.n and b.n:
            joined(b, a.n, np.array([a.root]), np.array([b.root]), allowed)
    return labels
