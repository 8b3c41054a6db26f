"""Metric trees over integer points, built middle-out by an anchors hierarchy.

About the square root of n anchors are picked, each the point farthest from the
anchor that owns it; a new anchor takes the points that are nearer to it, and
looks only at balls that may hold such points. Each anchor's points become a
tree of their own, and the balls that make the smallest common ball are merged,
two at a time, until one is left. A node keeps the sum and (by its range) the
count of its points.
"""

from __future__ import annotations

import numpy as np

#: Most points of a leaf, unless all of them are equal.
LEAF = 32


def node_type(m: int) -> np.dtype:
    return np.dtype([("low", "i4"), ("high", "i4"), ("left", "i4"), ("right", "i4"), ("radius", "f8"), ("centre", "f8", (m,)), ("sum", "i8", (m,))])


def _anchors(x: np.ndarray, k: int) -> np.ndarray:
    """For each point, the number of the anchor (of ``k`` at most) that owns it."""
    owner, chosen = np.zeros(len(x), np.int64), [0]
    far = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(chosen) < k:
        new = int(far.argmax())
        if far[new] == 0:
            break
        half = np.sqrt(((x[chosen] - x[new]) ** 2).sum(1)) / 2
        # a point nearer to its anchor than half the way to the new one stays
        near = np.flatnonzero(far > half[owner])
        d = np.sqrt(((x[near] - x[new]) ** 2).sum(1))
        taken = near[d < far[near]]
        owner[taken], far[taken] = len(chosen), d[d < far[near]]
        owner[new], far[new] = len(chosen), 0.0
        chosen.append(new)
    return owner


def _merge(balls: list[tuple]) -> tuple:
    """One tree of several: (points, left, right), the two that make the smallest ball first."""
    n = len(balls)
    centre = np.stack([b[3] for b in balls])
    radius, size = np.array([b[4] for b in balls]), np.array([len(b[0]) for b in balls], float)

    def common(k: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt(((centre[others] - centre[k]) ** 2).sum(1))
        both = size[others] + size[k]
        return np.maximum(d * size[k] / both + radius[others], d * size[others] / both + radius[k]), both

    cost, alive = np.full((n, n), np.inf), np.ones(n, bool)
    for k in range(1, n):
        cost[k, :k] = common(k, np.arange(k))[0]
    for _ in range(n - 1):
        a, b = divmod(int(cost.argmin()), n)
        both = size[a] + size[b]
        radius[b] = cost[a, b]
        centre[b] = (centre[a] * size[a] + centre[b] * size[b]) / both
        size[b] = both
        balls[b] = (np.concatenate([balls[a][0], balls[b][0]]), balls[a], balls[b], centre[b].copy(), radius[b])
        alive[a] = False
        cost[a, :] = cost[:, a] = np.inf
        others = np.flatnonzero(alive & (np.arange(n) != b))
        if len(others):
            fresh = common(b, others)[0]
            low = others < b
            cost[b, others[low]], cost[others[~low], b] = fresh[low], fresh[~low]
    return balls[int(np.flatnonzero(alive)[0])]


def _grow(x: np.ndarray, rows: np.ndarray) -> tuple:
    own = x[rows]
    if len(rows) > LEAF:
        owner = _anchors(own, int(np.ceil(np.sqrt(len(rows)))))
        if owner.any():
            return _merge([_grow(x, rows[owner == k]) for k in range(owner.max() + 1)])
    centre = own.mean(0)
    return rows, None, None, centre, float(np.sqrt(((own - centre) ** 2).sum(1).max()))


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of integer points, one row a point; nodes are ranges of the order, the first is the root."""
    x = points.astype(float)
    root = _grow(x, np.arange(len(points)))
    order, nodes, stack = np.empty(len(points), np.int32), [], [(root, -1, 0)]
    filled = 0
    while stack:
        (rows, left, right, _, _), parent, side = stack.pop()
        number, own = len(nodes), x[rows]
        centre = own.mean(0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(1).max()))
        nodes.append([filled, filled + len(rows), -1, -1, radius, centre, points[rows].sum(0)])
        if parent >= 0:
            nodes[parent][2 + side] = number
        if left is None:
            order[filled : filled + len(rows)] = rows
            filled += len(rows)
        else:
            stack += [(right, number, 1), (left, number, 0)]
    return order, np.array([tuple(n) for n in nodes], node_type(points.shape[1]))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of all rows of ``a`` to all rows of ``b`` (int64)."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if 4 * a.shape[1] * int(most) ** 2 < 1 << 53:  # every product and sum is a whole number that a double holds
        a, b = a.astype(float), b.astype(float)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def nearest(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, sums, counts): the nearest entry of each point (ties to the lower number), and per entry the sum and number of its points.

    ``points`` are in the order of the tree. Each ball inherits the entries that
    its parent could not rule out; an entry goes when the whole ball lies on
    the other side of the plane half-way to the entry nearest to the centre. A
    ball with one entry left is owned by it, and gives its cached sum; the
    points of a leaf with several are compared exactly.
    """
    k = len(entries)
    codes, sums, counts = np.empty(len(points), np.int64), np.zeros(entries.shape, np.int64), np.zeros(k, np.int64)
    e = entries.astype(float)
    apart = np.sqrt(np.maximum(0, squared(entries, entries)).astype(float))
    # of equal entries only the first can win
    lists = np.array([not (apart[j, :j] == 0).any() for j in range(k)])[None, :]
    slack = 1e-9 * (1 + float((e * e).sum(1).max()) + float((points.astype(float) ** 2).sum(1).max()))
    level, open_leaves = np.zeros(1, np.int64), []
    while len(level):
        c = nodes["centre"][level]
        d2 = (c * c).sum(1)[:, None] - 2 * (c @ e.T) + (e * e).sum(1)[None, :]
        best = np.where(lists, d2, np.inf).argmin(1)
        far = d2 - d2[np.arange(len(level)), best][:, None] - 2 * nodes["radius"][level][:, None] * apart[best]
        lists = lists & (far <= slack)
        left = lists.sum(1)
        for at in np.flatnonzero(left == 1):
            node, entry = nodes[level[at]], int(best[at])
            codes[node["low"] : node["high"]] = entry
            sums[entry] += node["sum"]
            counts[entry] += node["high"] - node["low"]
        leaf = nodes["left"][level] < 0
        open_leaves += [(int(level[at]), np.flatnonzero(lists[at])) for at in np.flatnonzero((left > 1) & leaf)]
        inner = np.flatnonzero((left > 1) & ~leaf)
        level, lists = np.concatenate([nodes["left"][level[inner]], nodes["right"][level[inner]]]), np.concatenate([lists[inner]] * 2)
    for node, candidates in open_leaves:
        low, high = int(nodes["low"][node]), int(nodes["high"][node])
        won = candidates[squared(points[low:high], entries[candidates]).argmin(1)]
        codes[low:high] = won
        np.add.at(sums, won, points[low:high])
        counts += np.bincount(won, minlength=k)
    return codes, sums, counts
