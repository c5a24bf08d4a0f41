"""An M-tree over vectors in memory: one bounded subtree of the distributed index.

Pages are kept as arrays. Each entry of an inner page holds a routing vector, the radius that covers everything below
it and the distance to its page's own routing vector; each entry of a leaf holds a vector and that distance. A search
takes pages in the order of the least distance they can contain, for a block of queries at once: a page comes with the
queries that may find something there, and its distances to them are one product. Before a distance is worked out, the
triangle inequality on the stored distances decides whether the entry can matter to any of them.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAF, FANOUT = 256, 16
#: Share of a distance allowed for rounding before an entry is passed over.
SLACK = 1e-9


class Points:
    """Vectors with their squared norms (``square`` if all have that one); distances to a query by one product."""

    def __init__(self, x: np.ndarray, square: float | None = None) -> None:
        self.x, self.squares = x, np.einsum("ij,ij->i", x, x) if square is None else np.full(len(x), square)

    def distances(self, to: np.ndarray, square: float | np.ndarray, keep: slice | np.ndarray = slice(None)) -> np.ndarray:
        """To one vector, or with rows of vectors and their squares (rows of ``to``, kept points)."""
        if to.ndim == 1:
            return np.sqrt(np.maximum(0, self.squares[keep] + square - 2 * (self.x[keep] @ to)))
        return np.sqrt(np.maximum(0, self.squares[keep] + np.asarray(square)[:, None] - 2 * (to @ self.x[keep].T)))


class Tree:
    """Vectors (rows of x) with ids. pages[i] is (routing vectors, radii, distances to parent, child pages) for an inner
    page and (None, None, distances to parent, first row) for a leaf, whose rows are next to one another; page 0 is the
    root and ``pivot`` its routing vector. With ``square``, the squared norm of all, equal products are equal distances."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivot: np.ndarray, square: float | None = None) -> None:
        self.pivot, self.pages = pivot, []
        self._order: list[np.ndarray] = []
        self._placed = 0
        own = Points(x)
        self.radius = self._load(own, np.arange(len(ids)), pivot)
        order = np.concatenate(self._order)
        del self._order
        self.ids, self.points = ids[order], Points(x[order], square)

    def _load(self, own: Points, rows: np.ndarray, pivot: np.ndarray) -> float:
        """Build the page for ``rows`` around ``pivot``; the radius it covers."""
        at = len(self.pages)
        self.pages.append(())
        part = Points(own.x[rows])
        to = lambda v: part.distances(v, float(v @ v))
        parent = to(pivot)
        if len(rows) <= LEAF:
            self.pages[at] = (None, None, parent, self._placed)
            self._placed += len(rows)
            self._order.append(rows)
            return float(parent.max(initial=0.0))
        k = min(FANOUT, -(-len(rows) // LEAF))
        # routing vectors far from one another: each next one is the row farthest from those taken
        taken = [int(np.argmax(parent))]
        near, side = to(part.x[taken[0]]), np.zeros(len(rows), np.int64)
        while len(taken) < k and near.max() > 1e-6 * (1 + parent.max()):
            taken.append(int(np.argmax(near)))
            d = to(part.x[taken[-1]])
            side[d < near] = len(taken) - 1
            near = np.minimum(near, d)
        if len(taken) == 1:  # all rows are equal: cut by number
            side = np.arange(len(rows)) * k // len(rows)
            taken = [int(np.argmax(side == i)) for i in range(k)]
        routes, radii, children = [], [], []
        for i, t in enumerate(taken):
            below = rows[side == i]
            if len(below):
                routes.append(part.x[t])
                children.append(len(self.pages))
                radii.append(self._load(own, below, part.x[t]))
        routes = Points(np.array(routes))
        self.pages[at] = (routes, np.array(radii), routes.distances(pivot, float(pivot @ pivot)), np.array(children))
        return float(parent.max())

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k nearest rows but those of its own id, no farther than its limit: (distances, rows), nearest
        first, ties by id, rows -1 where there are fewer."""
        n = len(queries)
        squares = np.einsum("ij,ij->i", queries, queries)
        # what a rounded distance may be off by: squares of this size cancel in it
        slack = 1e-6 * (1 + np.sqrt(squares))
        limit = np.array(limit, float)
        best, at = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        start = np.sqrt(((queries - self.pivot) ** 2).sum(1))
        todo = [(0.0, 0, np.arange(n), np.zeros(n), start)]
        while todo:
            _, page, who, least, to_pivot = heapq.heappop(todo)
            reach = limit[who] * (1 + SLACK) + slack[who]
            still = least <= reach
            who, least, to_pivot, reach = who[still], least[still], to_pivot[still], reach[still]
            if not len(who):
                continue
            routes, radii, parent, below = self.pages[page]
            gap = np.abs(to_pivot[:, None] - parent)
            if routes is not None:
                may = gap - radii <= reach[:, None]
                asked = np.flatnonzero(may.any(0))
                if len(asked):
                    d = routes.distances(queries[who], squares[who], asked)
                    low = np.maximum(least[:, None], d - radii[asked])
                    into = may[:, asked] & (low <= reach[:, None])
                    for c in np.flatnonzero(into.any(0)):
                        q = np.flatnonzero(into[:, c])
                        heapq.heappush(todo, (float(low[q, c].min()), int(below[asked[c]]), who[q], low[q, c], d[q, c]))
                continue
            may = gap <= reach[:, None]
            asked = np.flatnonzero(may.any(0))
            if len(asked):
                d = self.points.distances(queries[who], squares[who], below + asked)
                fits = may[:, asked] & (d <= reach[:, None]) & (self.ids[below + asked] != own[who][:, None])
                self._keep(best, at, limit, who, np.where(fits, d, np.inf), below + asked, k)
        return best, at

    def _keep(self, best: np.ndarray, at: np.ndarray, limit: np.ndarray, who: np.ndarray, d: np.ndarray, rows: np.ndarray, k: int) -> None:
        """Take the distances ``d`` of queries ``who`` to ``rows`` into their best k, and lower their limits."""
        new = (d <= best[who, -1][:, None]) & (d < np.inf)  # an equal one may have the smaller id
        some = np.flatnonzero(new.any(1))
        if not len(some):
            return
        who = who[some]
        both = np.hstack([best[who], np.where(new[some], d[some], np.inf)])
        place = np.hstack([at[who], np.broadcast_to(rows, (len(who), len(rows)))])
        edge = np.partition(both, k - 1, axis=1)[:, k - 1]
        q, c = np.nonzero((both <= edge[:, None]) & (both < np.inf))  # all that reach the k-th, ties too
        order = np.lexsort((self.ids[place[q, c]], both[q, c], q))
        q, c = q[order], c[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, c, rank = q[rank < k], c[rank < k], rank[rank < k]
        best[who], at[who] = np.inf, -1
        best[who[q], rank], at[who[q], rank] = both[q, c], place[q, c]
        limit[who] = np.minimum(limit[who], best[who, -1])
