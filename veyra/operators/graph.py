"""Graphs and paths: connected components by joins, shortest paths and timetable searches on broadcast arrays."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.session import stage


def components(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node of each connected part.

    Alternating large-star and small-star steps on edge tables: every step is a grouped minimum and a join, labels halve
    their distance to the root each round, and nothing but a count reaches the driver. Each round's table cuts lineage.
    """
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = e.select("u").unionByName(e.select(F.col("v").alias("u"))).distinct()
    cur = stage(e.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for k in range(rounds + 1):
        if k == rounds:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
        # large star: each node points its larger neighbours to its smallest one
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("mv")).select("u", F.least("u", "mv").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node points its smaller neighbours, and itself, to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        out = large.join(small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = stage(out.filter("u != v").distinct(), "edges")
        moved = new.join(cur, ["u", "v"], "left_anti").limit(1).count() + cur.join(new, ["u", "v"], "left_anti").limit(1).count()
        cur = new
        if not moved:
            break
    roots = cur.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))


def shortest_paths(sources: DataFrame, edges: DataFrame, source: str, src: str, dst: str, cost: str, limit: float | None = None, max_edges: int = 5_000_000) -> DataFrame:
    """(source, node, cost) for every node each source reaches within ``limit``, by Dijkstra's algorithm.

    A road map of a town is small and many sources search it, so the graph goes to all executors as arrays and the sources
    are what is spread. Above ``max_edges`` edges the same result comes from joins, a frontier of all sources a round.
    """
    n = edges.count()
    if n > max_edges:
        return _relaxed(sources, edges, source, src, dst, cost, limit)
    rows = edges.select(src, dst, cost).toPandas()
    ids = np.unique(np.concatenate([rows[src], rows[dst]])) if n else np.empty(0, dtype=np.int64)
    u, v = np.searchsorted(ids, rows[src]), np.searchsorted(ids, rows[dst])
    order = np.argsort(u, kind="stable")
    v, w = v[order], rows[cost].to_numpy(dtype=float)[order]
    first = np.searchsorted(u[order], np.arange(len(ids) + 1))

    def search(batches):
        for pdf in batches:
            out = []
            for s in pdf[source]:
                i = int(np.searchsorted(ids, s))
                if i == len(ids) or ids[i] != s:
                    out.append((s, s, 0.0))
                    continue
                dist, heap = {}, [(0.0, i)]
                while heap:
                    d, x = heapq.heappop(heap)
                    if x in dist:
                        continue
                    dist[x] = d
                    for k in range(first[x], first[x + 1]):
                        nd = d + w[k]
                        if v[k] not in dist and (limit is None or nd <= limit):
                            heapq.heappush(heap, (nd, int(v[k])))
                out += [(s, int(ids[x]), d) for x, d in dist.items()]
            yield pd.DataFrame(out, columns=["source", "node", "cost"])

    return sources.select(source).filter(F.col(source).isNotNull()).distinct().mapInPandas(search, "source long, node long, cost double")


def _relaxed(sources: DataFrame, edges: DataFrame, source: str, src: str, dst: str, cost: str, limit: float | None) -> DataFrame:
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("_to"), F.col(cost).cast("double").alias("_w"))
    best = stage(sources.select(F.col(source).cast("long").alias("source")).filter("source is not null").distinct().select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")), "paths")
    front = best
    while True:
        step = front.join(e, "node").select("source", F.col("_to").alias("node"), (F.col("cost") + F.col("_w")).alias("cost"))
        step = step if limit is None else step.filter(F.col("cost") <= limit)
        new = best.unionByName(step).groupBy("source", "node").agg(F.min("cost").alias("cost"))
        new = stage(new, "paths")
        front = stage(new.join(best, ["source", "node", "cost"], "left_anti"), "front")
        best = new
        if not front.limit(1).count():
            return best


def earliest_arrivals(sources: DataFrame, stop_times: DataFrame, start: int, rides: int = 4, slack: int = 0) -> DataFrame:
    """(source, stop, arrival, rides) of public transport: the earliest arrival at each stop with the fewest rides that reach it.

    ``sources`` has (source); ``stop_times`` has (trip, seq, stop, arrival, departure) in whole seconds. Round k extends by one
    ride what round k - 1 improved: the first call of each trip that can be boarded, then the calls after it. Both are equi-joins
    with grouped minima, so neither timetable nor results meet in one place.
    """
    calls = stop_times.select("trip", "seq", F.col("stop").cast("long").alias("stop"), F.col("arrival").cast("long").alias("arrival"), F.col("departure").cast("long").alias("departure"))
    best = stage(sources.select(F.col("source").cast("long").alias("source")).filter("source is not null").distinct().select("source", F.col("source").alias("stop"), F.lit(start).cast("long").alias("arrival"), F.lit(0).alias("rides")), "reached")
    marked = best
    for k in range(1, rides + 1):
        ready = marked.select("source", "stop", (F.col("arrival") + (0 if k == 1 else slack)).alias("ready"))
        board = ready.join(calls, "stop").filter("departure >= ready").groupBy("source", "trip").agg(F.min("seq").alias("at"))
        got = board.join(calls.select("trip", "seq", "stop", "arrival"), "trip").filter("seq > at").groupBy("source", "stop").agg(F.min("arrival").alias("arrival"))
        both = best.unionByName(got.select("source", "stop", "arrival", F.lit(k).alias("rides")))
        best = stage(both.groupBy("source", "stop").agg(F.min(F.struct("arrival", "rides")).alias("b")).select("source", "stop", "b.*"), "reached")
        marked = best.filter(F.col("rides") == k)
        if not marked.limit(1).count():
            break
    return best.select("source", "stop", "arrival", F.col("rides").cast("int").alias("rides"))


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices kept of a line when points nearer than ``tolerance`` to the chords are left out (Douglas-Peucker)."""
    keep = np.zeros(len(points), dtype=bool)
    if len(points):
        keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, b = points[i], points[j]
        d = b - a
        n = float(np.hypot(*d))
        rest = points[i + 1 : j] - a
        off = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / n if n else np.hypot(rest[:, 0], rest[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return np.flatnonzero(keep)


def hilbert(x: np.ndarray, y: np.ndarray, order: int = 16) -> np.ndarray:
    """Positions of cells (x, y) along a Hilbert curve of 4 ** order cells."""
    x, y = x.astype(np.int64).copy(), y.astype(np.int64).copy()
    out = np.zeros(len(x), dtype=np.int64)
    s = 1 << (order - 1)
    while s:
        rx, ry = ((x & s) > 0).astype(np.int64), ((y & s) > 0).astype(np.int64)
        out += s * s * ((3 * rx) ^ ry)
        flip = (ry == 0) & (rx == 1)
        x, y = np.where(flip, s - 1 - (x & (s - 1)), x & (s - 1)), np.where(flip, s - 1 - (y & (s - 1)), y & (s - 1))
        swap = ry == 0
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        s >>= 1
    return out
