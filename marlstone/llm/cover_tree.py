"""Cover trees for inner products: vectors get one more component that gives all of them the same norm.

After that, the largest inner product with a query (scaled to that norm too) is
the smallest distance. A node is a point; the nodes below it lie within its
covering radius, and the radius a level further down is smaller by BASE. The
centres of a node's children are farther from each other than that radius.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

BASE = 1.5
LEAF = 32
NODE = np.dtype([("low", "i4"), ("high", "i4"), ("first", "i4"), ("last", "i4"), ("centre", "i4"), ("radius", "f8")])


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(order, nodes, norm) of integer vectors, one row a vector; a node's children are the nodes from ``first`` to before ``last``, its points a range of the order, its centre a place in it."""
    x = points.astype(float)
    square = (x * x).sum(1)
    norm = float(np.sqrt(square.max()))
    x = np.column_stack([x, np.sqrt(np.maximum(0, norm**2 - square))])

    def distances(centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 * norm**2 - 2 * (x[rows] @ x[centre])))

    rows = np.arange(len(x))
    far = distances(0, rows)
    order, nodes = rows.copy(), [(0, len(x), -1, -1, 0, float(far.max()))]
    todo = [(0, far, float(far.max()))]
    while todo:
        number, far, radius = todo.pop()
        low, high, _, _, centre, most = nodes[number]
        if high - low <= LEAF or most <= 1e-6 * norm:
            continue
        while radius >= most:
            radius /= BASE
        rows, open_ = order[low:high], np.arange(high - low)
        own = x[rows]
        parts, near = [], far <= radius
        parts.append((centre, open_[near], far[near]))
        open_ = open_[~near]
        while len(open_):
            new = int(open_[far[open_].argmax()])
            d = np.sqrt(np.maximum(0, 2 * norm**2 - 2 * (own[open_] @ own[new])))
            near = d <= radius
            near[open_ == new] = True
            parts.append((int(rows[new]), open_[near], d[near]))
            open_ = open_[~near]
        order[low:high] = rows[np.concatenate([p[1] for p in parts])]
        first, at = len(nodes), low
        for c, held, d in parts:
            nodes.append((at, at + len(held), -1, -1, c, float(d.max())))
            todo.append((len(nodes) - 1, d, radius))
            at += len(held)
        nodes[number] = (low, high, first, len(nodes), centre, most)
    out, place = np.array(nodes, NODE), np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    out["centre"] = place[out["centre"]]
    return order, out, norm


#: What is still open for a query: from bounds of inner products (low, high; one row a node, one column a query) to whether the node can hold a result.
Open = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Takes exact inner products (rows in the tree's order, from the first row on) for some queries.
Offer = Callable[[np.ndarray, np.ndarray, np.ndarray], None]


def descend(points: np.ndarray, nodes: np.ndarray, norm: float, queries: np.ndarray, is_open: Open, offer: Offer) -> None:
    """Best-first search for a block of queries at once.

    The node with the best bound comes next. Of its children those that no
    query needs any more are left out; leaves, and children that are single
    points, are verified with exact products.
    ``points`` are integers in the order of the tree, ``queries`` integers.
    """
    exact = np.float64 if points.shape[1] * int(np.abs(points).max(initial=0)) * int(np.abs(queries).max(initial=0)) < 1 << 53 else np.int64
    x, q = points.astype(exact), queries.astype(exact)
    size = np.sqrt((queries.astype(float) ** 2).sum(1))
    slack = 1e-6 * norm * size + 1e-6

    def bounds(some: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        products = (x[nodes["centre"][some]] @ q[active].T).astype(float)
        if not norm:
            return products, products
        scale = size[active] / norm
        d = np.sqrt(np.maximum(0, 2 * norm**2 - 2 * np.divide(products, scale, out=np.zeros_like(products), where=scale > 0)))
        r = nodes["radius"][some][:, None]
        high = (norm**2 - np.maximum(0, d - r) ** 2 / 2) * scale + slack[active]
        low = (norm**2 - np.minimum(2 * norm, d + r) ** 2 / 2) * scale - slack[active]
        return low, high

    def verify(rows: np.ndarray, active: np.ndarray) -> None:
        for k in range(0, len(rows), 1024):
            part = rows[k : k + 1024]
            offer(part, (x[part] @ q[active].T).astype(np.int64), active)

    everyone = np.arange(len(queries))
    low, high = bounds(np.zeros(1, np.int64), everyone)
    heap = [(-float(high.max(initial=0)), 0, everyone, low[0], high[0])] if len(queries) else []
    while heap:
        _, number, active, low, high = heapq.heappop(heap)
        good = is_open(low[None, :], high[None, :], active)[0]
        active = active[good]
        if not len(active):
            continue
        node = nodes[number]
        if node["first"] < 0:
            verify(np.arange(node["low"], node["high"]), active)
            continue
        children = np.arange(node["first"], node["last"])
        low, high = bounds(children, active)
        needed = is_open(low, high, active)
        leaf = (nodes["first"][children] < 0) & (nodes["high"][children] - nodes["low"][children] <= LEAF)
        if (leaf & needed.any(1)).any():
            # small leaves go together, the best first
            own = np.flatnonzero(leaf & needed.any(1))
            own = own[np.argsort(-high[own].max(1), kind="stable")]
            verify(np.concatenate([np.arange(nodes["low"][c], nodes["high"][c]) for c in children[own]]), active[needed[own].any(0)])
        for k in np.flatnonzero(~leaf & needed.any(1)):
            some = needed[k]
            heapq.heappush(heap, (-float(high[k, some].max()), int(children[k]), active[some], low[k, some], high[k, some]))
