"""Prediction by partial matching over bytes: a context trie with counts, escapes and symbol exclusion.

Training text is read as windows of ``order`` context bytes and the byte that follows; START bytes stand in front
of a text and END closes it (neither occurs in UTF-8). The counts of the shorter contexts are sums over the longer
ones, so the symbols seen in a context are also seen in its suffix. That makes exclusion exact with sums alone:

* a context with n symbols of d kinds gives a seen symbol c/(n+d) and the escape d/(n+d);
* after an escape the suffix leaves out what the longer context has seen: with T the remaining symbols and e their
  kinds it gives c/(T+e), or escapes on with e/(T+e) (with certainty if nothing remains);
* after the empty context the symbols never seen share the rest evenly.

``Model`` holds log10 probabilities for every known context of every order by symbol: what is left of a walk down
the trie when all its escapes are worked out beforehand.
"""

from __future__ import annotations

import numpy as np

START, END = 0xFF, 0xFE
SYMBOLS = 256


def windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one run of bytes, each behind ``order`` STARTs and before an END, and where each begins."""
    joined = b"".join(b"%b%b%b" % (bytes([START]) * order, t, bytes([END])) for t in texts)
    sizes = np.fromiter((len(t) + order + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(joined, np.uint8), np.cumsum(sizes) - sizes


def codes(run: np.ndarray, order: int) -> np.ndarray:
    """For each byte from the ``order``-th on, its window as a number, the context in the higher bytes."""
    n = len(run) - order
    out = run[:n].astype(np.int64)
    for j in range(1, order + 1):
        out <<= 8
        out |= run[j : n + j]
    return out


def add_up(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts (of one each if None)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        at = np.argsort(keys, kind="stable")
        keys, counts = keys[at], counts[at]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[first], np.diff(np.r_[first, len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def count_windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    run, _ = windows(texts, order)
    return add_up(codes(run, order)[run[order:] != START])


def suffixes(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Window counts at a lower order."""
    return add_up(keys & ((1 << 8 * (order + 1)) - 1), counts)


class Model:
    """Log10 probabilities from window counts. Size: cells() numbers of 4 bytes, and 4 bytes a trie edge slot."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int) -> None:
        self.order = order
        seen = {START, *(int(x) for j in range(order + 1) for x in np.unique((keys >> 8 * j) & 0xFF))}
        self.symbol = np.full(SYMBOLS, len(seen), np.int32)
        self.symbol[sorted(seen)] = np.arange(len(seen))
        self.width = len(seen) + 1  # the last: any byte not seen in training
        grams = [(keys, counts)]
        for k in range(order - 1, -1, -1):
            grams.insert(0, suffixes(*grams[0], k))
        self.contexts = [np.unique(g >> 8) if len(g) else np.zeros(1, np.int64) for g, _ in grams]
        self.logs: list[np.ndarray] = []
        before = None
        for k, (g, c) in enumerate(grams):
            before = self._level(k, g, c, before)
        self._edges()

    def _level(self, k: int, grams: np.ndarray, counts: np.ndarray, before: tuple | None) -> tuple:
        contexts, step = self.contexts[k], 16384
        logs = np.empty((len(contexts), self.width), np.float32)
        kept = None if k == self.order else (np.empty(logs.shape), np.empty(logs.shape))
        edges = np.searchsorted(grams >> 8, contexts[::step])
        for i, at in enumerate(range(0, len(contexts), step)):
            rows = contexts[at : at + step]
            g = grams[edges[i] : edges[i + 1] if i + 1 < len(edges) else None]
            c = counts[edges[i] : edges[i + 1] if i + 1 < len(edges) else None]
            n = np.zeros((len(rows), self.width))
            n[np.searchsorted(rows, g >> 8), self.symbol[g & 0xFF]] = c
            total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
            if before is None:
                after = np.full(n.shape, 1 / max(1, SYMBOLS - int(kinds[0, 0])))
            else:
                shorter = np.searchsorted(self.contexts[k - 1], rows & ((1 << 8 * (k - 1)) - 1))
                rest = np.where(n > 0, 0, before[0][shorter])
                left, few = rest.sum(1, keepdims=True), (rest > 0).sum(1, keepdims=True)
                on = np.where(few > 0, few / np.maximum(left + few, 1), 1.0)
                after = np.where(rest > 0, rest / np.maximum(left + few, 1), on * before[1][shorter])
            escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
            logs[at : at + step] = np.log10(np.where(n > 0, n / np.maximum(total + kinds, 1), escape * after))
            if kept:
                kept[0][at : at + step], kept[1][at : at + step] = n, after
        self.logs.append(logs)
        return kept

    def _edges(self) -> None:
        """Child tables of the trie of full contexts: (node, symbol) -> node, 0 for none."""
        self.child: list[np.ndarray] = []
        full, parents = self.contexts[self.order], np.zeros(1, np.int64)
        for depth in range(1, self.order + 1):
            nodes = np.unique(full >> 8 * (self.order - depth))
            table = np.zeros((len(parents) + (depth > 1), self.width), np.int32)
            up = np.searchsorted(parents, nodes >> 8) + (depth > 1)
            table[up, self.symbol[nodes & 0xFF]] = np.arange(1, len(nodes) + 1)
            self.child.append(table.ravel())
            parents = nodes

    def cells(self) -> int:
        return sum(x.size for x in [*self.logs, *self.child])

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The log10 probability of each text."""
        if not texts:
            return np.zeros(0)
        run, starts = windows(texts, self.order)
        symbols = self.symbol[run]
        n = len(run) - self.order
        node = np.zeros(n, np.int32)
        for j, table in enumerate(self.child):
            node *= self.width
            node += symbols[j : n + j]
            node = table[node]
        symbols = symbols[self.order :]
        if self.order:
            logs = self.logs[self.order].ravel()[np.maximum(node - 1, 0).astype(np.int64) * self.width + symbols].astype(np.float64)
            lost = np.flatnonzero(node == 0)
        else:
            logs, lost = self.logs[0][0][symbols].astype(np.float64), np.zeros(0, np.int64)
        if len(lost):
            context = np.zeros(len(lost), np.int64)
            for j in range(self.order, 0, -1):
                context = context << 8 | run[lost + self.order - j]
            todo = np.arange(len(lost))
            for k in range(self.order - 1, -1, -1):
                short = context[todo] & ((1 << 8 * k) - 1)
                at = np.minimum(np.searchsorted(self.contexts[k], short), len(self.contexts[k]) - 1)
                hit = self.contexts[k][at] == short
                done = todo[hit]
                logs[lost[done]] = self.logs[k][at[hit], symbols[lost[done]]]
                todo = todo[~hit]
        logs[run[self.order :] == START] = 0
        return np.add.reduceat(np.r_[np.zeros(self.order), logs], starts)
