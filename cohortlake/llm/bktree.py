"""BK-trees of fingerprints of one or more 64-bit words, searched level by level for many queries at once."""

from __future__ import annotations

import numpy as np


class Forest:
    """BK-trees of many shards at once; items sorted by shard, distinct within one; ``value`` a word or a row of words each."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        self.value, n = np.asfortranarray(value.reshape(len(value), -1 if len(value) else 1)), len(value)
        self.most = 64 * self.value.shape[1]
        root_at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        self.root = np.repeat(root_at, np.diff(np.append(root_at, n)))
        self.parent = np.full(n, -1, np.int64)
        here = self.root.copy()
        todo = np.flatnonzero(here != np.arange(n))
        edges, depth = [], []
        while len(todo):
            key = here[todo] * (self.most + 1) + self.apart(todo, here[todo])
            order = np.argsort(key, kind="stable")
            todo, key = todo[order], key[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            child = todo[new]
            self.parent[child] = here[child]
            edges.append((key[new], child))
            depth.append(child)
            here[todo] = child[np.cumsum(new) - 1]
            todo = todo[~new]
        code = np.concatenate([k for k, _ in edges]) if edges else np.zeros(0, np.int64)
        order = np.argsort(code)
        self.code, self.child = code[order], (np.concatenate([c for _, c in edges])[order] if edges else np.zeros(0, np.int64))
        self.below = np.ones(n, np.int64)  # items of the subtree still to be found
        for level in depth[::-1]:
            np.add.at(self.below, self.parent[level], self.below[level])
        self.live = np.ones(n, bool)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of differing bits of each pair of items."""
        out = np.zeros(len(a), np.int64)
        for word in self.value.T:
            out += np.bitwise_count(word[a] ^ word[b])
        return out

    def search(self, query: np.ndarray, radius: int, itself: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs of the items still to be found within the radius; with ``itself`` the query too, if it is."""
        found, node = [], self.root[query]
        while len(query):
            far = self.apart(query, node)
            hit = (far <= radius) & self.live[node] & ((query != node) | itself)
            found.append((query[hit], node[hit]))
            low = np.searchsorted(self.code, node * (self.most + 1) + np.maximum(far - radius, 1))
            size = np.searchsorted(self.code, node * (self.most + 1) + np.minimum(far + radius, self.most), side="right") - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
            query, node = np.repeat(query, size), self.child[at]
            more = self.below[node] > 0
            query, node = query[more], node[more]
        return (np.concatenate([x[i] for x in found]) for i in (0, 1)) if found else (query, query)

    def remove(self, items: np.ndarray) -> None:
        self.live[items] = False
        while len(items):
            np.subtract.at(self.below, items, 1)
            items = self.parent[items]
            items = items[items >= 0]
