"""Plane geometry on numpy arrays: ear clipping, triangle tests and a bounding-volume hierarchy."""

from __future__ import annotations

import numpy as np


def clean_ring(xs, ys) -> np.ndarray:
    """Vertices (x, y) of a ring without nulls, consecutive repeats and the closing vertex."""
    pts = np.stack([np.array(xs, dtype=np.float64), np.array(ys, dtype=np.float64)], 1).reshape(-1, 2)
    pts = pts[np.isfinite(pts).all(1)]
    if len(pts):
        pts = pts[np.r_[True, (pts[1:] != pts[:-1]).any(1)]]
    while len(pts) > 1 and (pts[0] == pts[-1]).all():
        pts = pts[:-1]
    return pts


def _cross(a, b, c):
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


class _Reflex:
    """The corners that turn inwards, in a grid: only they can lie in an ear."""

    def __init__(self, pts: list[tuple[float, float]], reflex: list[int]):
        self.pts, self.lo = pts, (min(p[0] for p in pts), min(p[1] for p in pts))
        hi = (max(p[0] for p in pts), max(p[1] for p in pts))
        self.g = max(1, int(len(reflex) ** 0.5))
        self.size = tuple(max((h - o) / self.g, 1e-300) for h, o in zip(hi, self.lo))
        self.cells: dict[tuple[int, int], set[int]] = {}
        for v in reflex:
            self.cells.setdefault(self._cell(pts[v]), set()).add(v)

    def _cell(self, p) -> tuple[int, int]:
        return tuple(min(self.g - 1, max(0, int((x - o) / s))) for x, o, s in zip(p, self.lo, self.size))

    def drop(self, v: int) -> None:
        self.cells.get(self._cell(self.pts[v]), set()).discard(v)

    def within(self, a, b, c) -> bool:
        """Whether a corner other than the triangle's own lies in it."""
        (x0, y0), (x1, y1) = self._cell((min(a[0], b[0], c[0]), min(a[1], b[1], c[1]))), self._cell((max(a[0], b[0], c[0]), max(a[1], b[1], c[1])))
        if (x1 - x0 + 1) * (y1 - y0 + 1) > len(self.cells):
            near = (v for (x, y), vs in self.cells.items() if x0 <= x <= x1 and y0 <= y <= y1 for v in vs)
        else:
            near = (v for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) for v in self.cells.get((x, y), ()))
        for v in near:
            p = self.pts[v]
            if p not in (a, b, c) and _turn(a, b, p) >= 0 and _turn(b, c, p) >= 0 and _turn(c, a, p) >= 0:
                return True
        return False


def ear_clip(ring: np.ndarray, forced: list[int] | None = None) -> np.ndarray:
    """Triangles (n - 2, 3, 2) of a simple polygon, by clipping ears off a linked list of its corners.

    A corner is tested against the inward corners near it alone. A polygon of fewer than three vertices has none. Where a ring touches or crosses
    itself and no clean ear is left, the vertex with the smallest area is clipped, so the loop always ends; ``forced`` gets these vertices.
    """
    n = len(ring)
    if n < 3:
        return np.empty((0, 3, 2))
    x, y = ring[:, 0], ring[:, 1]
    if np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) < 0:
        ring = ring[::-1]
    pts = [tuple(p) for p in ring.tolist()]
    before, after = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)]
    area = lambda v: _turn(pts[before[v]], pts[v], pts[after[v]])
    reflex = [area(v) < 0 for v in range(n)]
    grid = _Reflex(pts, [v for v in range(n) if reflex[v]])
    out, at, left, since = [], 0, n, 0

    def cut(v: int) -> int:
        i, k = before[v], after[v]
        after[i], before[k] = k, i
        if reflex[v]:
            grid.drop(v)
        for u in (i, k):  # a corner that turns outwards stays so as ears go
            if reflex[u] and area(u) >= 0:
                reflex[u] = False
                grid.drop(u)
        return i

    while left > 3:
        a, b, c = pts[before[at]], pts[at], pts[after[at]]
        size = _turn(a, b, c)
        if size == 0:  # a straight corner bounds no area
            at, left, since = cut(at), left - 1, 0
            continue
        ear = size > 0 and not grid.within(a, b, c)
        if not ear and since <= left:
            at, since = after[at], since + 1
            continue
        if not ear:
            v, best = at, at
            for _ in range(left):
                v = after[v]
                best = v if abs(area(v)) < abs(area(best)) else best
            at = best
            a, b, c = pts[before[at]], pts[at], pts[after[at]]
            if forced is not None:
                forced.append(at)
        out.append((a, b, c))
        at, left, since = after[cut(at)], left - 1, 0
    out.append((pts[before[at]], pts[at], pts[after[at]]))
    return np.array(out, dtype=np.float64)


def _side(px, py, ax, ay, bx, by):
    """Sign of the point against an edge; an edge gives the same figure whichever way it is walked."""
    swap = (ax > bx) | ((ax == bx) & (ay > by))
    x0, y0 = np.where(swap, bx, ax), np.where(swap, by, ay)
    x1, y1 = np.where(swap, ax, bx), np.where(swap, ay, by)
    s = (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)
    return np.where(swap, -s, s)


def in_triangle(px, py, t: np.ndarray) -> np.ndarray:
    """Whether points lie in triangles (k, 6), edges included; all arrays of one length."""
    ax, ay, bx, by, cx, cy = t.T
    s1, s2, s3 = _side(px, py, ax, ay, bx, by), _side(px, py, bx, by, cx, cy), _side(px, py, cx, cy, ax, ay)
    return ((s1 >= 0) & (s2 >= 0) & (s3 >= 0)) | ((s1 <= 0) & (s2 <= 0) & (s3 <= 0))


def boxes_of(t: np.ndarray) -> np.ndarray:
    """Bounding boxes (k, 4: min x, min y, max x, max y) of triangles (k, 6)."""
    xs, ys = t[:, 0::2], t[:, 1::2]
    return np.stack([xs.min(1), ys.min(1), xs.max(1), ys.max(1)], 1)


class SplitTree:
    """Complete binary tree of median planes over centres; it names the leaf of any centre."""

    def __init__(self, centres: np.ndarray, depth: int):
        self.depth = depth
        self.dim = np.zeros(2**depth - 1, dtype=np.int8)
        self.at = np.zeros(2**depth - 1)
        stack = [(0, np.arange(len(centres)), 0)]
        while stack:
            node, idx, d = stack.pop()
            if d == depth:
                continue
            c = centres[idx]
            if len(idx):
                dim = int(np.argmax(c.max(0) - c.min(0)))
                self.dim[node], self.at[node] = dim, float(np.median(c[:, dim]))
            side = centres[idx, self.dim[node]] > self.at[node]
            stack += [(2 * node + 1, idx[~side], d + 1), (2 * node + 2, idx[side], d + 1)]

    def leaf(self, centres: np.ndarray) -> np.ndarray:
        node = np.zeros(len(centres), dtype=np.int64)
        for _ in range(self.depth):
            side = centres[np.arange(len(centres)), self.dim[node]] > self.at[node]
            node = 2 * node + 1 + side
        return node - (2**self.depth - 1)


class BoxTree:
    """Boxes of a complete binary tree, from the boxes of its leaves; empty leaves have inverted boxes."""

    def __init__(self, leaf_boxes: np.ndarray):
        self.depth = int(len(leaf_boxes)).bit_length() - 1
        levels = [leaf_boxes]
        while len(levels[0]) > 1:
            a, b = levels[0][0::2], levels[0][1::2]
            levels.insert(0, np.concatenate([np.minimum(a[:, :2], b[:, :2]), np.maximum(a[:, 2:], b[:, 2:])], 1))
        self.levels = levels

    def route(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for each leaf whose box holds the point."""
        point, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for d, boxes in enumerate(self.levels):
            b = boxes[node]
            keep = (x[point] >= b[:, 0]) & (x[point] <= b[:, 2]) & (y[point] >= b[:, 1]) & (y[point] <= b[:, 3])
            point, node = point[keep], node[keep]
            if d < self.depth:
                point, node = np.repeat(point, 2), (2 * node[:, None] + np.array([0, 1])).ravel()
        return point, node


def locate(x: np.ndarray, y: np.ndarray, tris: np.ndarray, leaf_size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(point, triangle) for each triangle that holds the point, through a hierarchy of boxes."""
    if not len(tris) or not len(x):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    depth = max(0, int(np.ceil(np.log2(max(1, len(tris) / leaf_size)))))
    centres = tris.reshape(-1, 3, 2).mean(1)
    leaf = SplitTree(centres, depth).leaf(centres)
    order = np.argsort(leaf, kind="stable")
    start = np.searchsorted(leaf[order], np.arange(2**depth + 1))
    boxes = boxes_of(tris)
    lb = np.full((2**depth, 4), np.inf)
    lb[:, 2:] = -np.inf
    np.minimum.at(lb[:, :2], leaf, boxes[:, :2])
    np.maximum.at(lb[:, 2:], leaf, boxes[:, 2:])
    point, node = BoxTree(lb).route(x, y)
    n = start[node + 1] - start[node]
    point = np.repeat(point, n)
    first = np.repeat(start[node] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n)
    tri = order[first + np.arange(len(point))]
    b = boxes[tri]
    keep = (x[point] >= b[:, 0]) & (x[point] <= b[:, 2]) & (y[point] >= b[:, 1]) & (y[point] <= b[:, 3])
    point, tri = point[keep], tri[keep]
    hit = in_triangle(x[point], y[point], tris[tri])
    return point[hit], tri[hit]
