"""Documents packed into containers of fixed capacity.

Only sizes matter to a plan, and sizes are whole numbers up to the capacity, so the plan is made on counts by size, which
are few however many documents there are. Items above a third of the capacity are matched greedily, at most two
to a container; smaller ones go to the container with the least room that still holds them (best fit). The plan is
a list of runs: items of one size, by rank, go to consecutive containers. Ranks within a size are made in salted
parts, so a size that a third of all documents share is many tasks.

Defined results: a document above the capacity is cut, and fills whole containers but for its last piece; a document without
tokens needs no container and comes out with container 0 and no tokens; repeated ids are documents of their own only
if their sizes differ; an empty table gives an empty result; null or non-positive capacities pack nothing.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.session import parallelism, stage


class Plan:
    """Containers for ``counts`` (size -> items) of one capacity.

    runs[size] is a list of (first rank, items, first container, items a container).
    """

    def __init__(self, counts: dict[int, int], capacity: int, first: int = 1):
        self.capacity, self.next = capacity, first
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self.used: dict[int, int] = {}
        self.rooms: dict[int, list[tuple[int, int]]] = {}  # room -> [(first container, containers)]
        self.keys: list[int] = []
        self.left = {s: n for s, n in counts.items() if n > 0}
        self._large()
        for s in sorted((s for s in self.left if 3 * s <= capacity), reverse=True):
            self._small(s, self.left[s])
        self.containers = self.next - first

    def _put(self, size: int, items: int, container: int, each: int = 1) -> None:
        at = self.used.get(size, 0)
        self.runs.setdefault(size, []).append((at, items, container, each))
        self.used[size] = at + items

    def _open(self, containers: int) -> int:
        at = self.next
        self.next += containers
        return at

    def _room(self, room: int, container: int, n: int) -> None:
        if n and room > 0:
            if room not in self.rooms:
                self.rooms[room] = []
                insort(self.keys, room)
            self.rooms[room].append((container, n))

    def _large(self) -> None:
        """The largest item with the largest that still fits beside it, until none is left."""
        c = self.capacity
        sizes = sorted(s for s in self.left if 3 * s > c)
        n = {s: self.left[s] for s in sizes}
        while sizes:
            a = sizes[-1]
            i = bisect_left(sizes, c - a + 1) - 1
            if i < 0:
                at = self._open(n[a])
                self._put(a, n[a], at)
                self._room(c - a, at, n[a])
                sizes.pop()
                continue
            b = sizes[i]
            k = n[a] // 2 if a == b else min(n[a], n[b])
            if a == b and k == 0:  # one item left of this size; the next smaller goes with it
                if i == 0:
                    at = self._open(1)
                    self._put(a, 1, at)
                    self._room(c - a, at, 1)
                    sizes.pop()
                    continue
                b, k = sizes[i - 1], 1
            at = self._open(k)
            if a == b:
                self._put(a, 2 * k, at, 2)
            else:
                self._put(a, k, at)
                self._put(b, k, at)
            self._room(c - a - b, at, k)
            n[a] -= k
            n[b] -= k
            for s in {a, b}:
                if n[s] == 0:
                    sizes.remove(s)

    def _small(self, size: int, items: int) -> None:
        while items:
            i = bisect_left(self.keys, size)
            if i == len(self.keys):
                each = self.capacity // size
                whole = items // each
                if whole:
                    at = self._open(whole)
                    self._put(size, whole * each, at, each)
                    self._room(self.capacity - each * size, at, whole)
                    items -= whole * each
                if items:
                    at = self._open(1)
                    self._put(size, items, at, items)
                    self._room(self.capacity - items * size, at, 1)
                return
            room = self.keys[i]
            at, n = self.rooms[room].pop()
            each = room // size
            # containers of one room take as many as fit, so that each is visited once
            full = min(n, items // each)
            if full:
                self._put(size, full * each, at, each)
                self._room(room - each * size, at, full)
                items -= full * each
            rest, where = n - full, at + full
            if rest and items and items < each:
                self._put(size, items, where, items)
                self._room(room - items * size, where, 1)
                items, rest, where = 0, rest - 1, where + 1
            if rest:
                self.rooms[room].append((where, rest))
            if not self.rooms[room]:
                del self.rooms[room]
                self.keys.remove(room)

    def arrays(self) -> dict[int, np.ndarray]:
        return {s: np.array(r, dtype=np.int64) for s, r in self.runs.items()}


def pack(sizes: DataFrame, capacities: DataFrame, part_docs: int = 200_000) -> DataFrame:
    """(pack_code, container_no, doc_id, piece_no, first_token, tokens) for ``sizes`` (doc_id, tokens) and
    ``capacities`` (pack_code, capacity_tokens); containers are numbered from 1 in each pack, pieces from 1.

    A size is ranked in parts of about ``part_docs`` documents, so the driver holds a row for each size and for each such part."""
    spark = sizes.sparkSession
    packs = [(r[0], int(r[1])) for r in capacities.filter("pack_code is not null and capacity_tokens > 0").select("pack_code", "capacity_tokens").distinct().orderBy("pack_code").collect()]
    base = stage(sizes.filter("doc_id is not null").select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).distinct(), "sizes")
    out = base.filter("tokens <= 0").withColumn("pack_code", F.explode(F.array(*[F.lit(p) for p, _ in packs]))) if packs else None
    if out is None:
        return spark.createDataFrame([], "pack_code string, container_no long, doc_id long, piece_no int, first_token long, tokens long")
    out = out.select("pack_code", F.lit(0).cast("long").alias("container_no"), "doc_id", F.lit(1).alias("piece_no"), F.lit(1).cast("long").alias("first_token"), F.lit(0).cast("long").alias("tokens"))
    for code, cap in packs:
        part = base.filter("tokens > 0").select("doc_id", "tokens", (F.col("tokens") % cap).alias("rest"), F.expr(f"tokens div {cap}").alias("whole"))
        # a size of many documents gets many parts
        many = {r[0]: math.ceil(r[1] / part_docs) for r in part.groupBy("rest").count().collect()}  # at most capacity rows
        hot = spark.createDataFrame([(k, n) for k, n in many.items() if n > 1], "rest long, salts int")
        salted = part.join(F.broadcast(hot), "rest", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "tokens"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        counts = [tuple(r) for r in salted.groupBy("rest", "salt").agg(F.count("*"), F.sum("whole")).collect()]
        by_rest: dict[int, int] = {}
        for rest, _, n, _ in counts:
            by_rest[rest] = by_rest.get(rest, 0) + n
        plan = Plan({s: n for s, n in by_rest.items() if s > 0}, cap)
        # before each (rest, salt): items of its size, and whole containers that cut documents fill
        offset, seen, wholes, at = {}, {}, {}, plan.next
        for rest, salt, n, w in sorted(counts):
            offset[rest, salt] = seen.get(rest, 0)
            seen[rest] = seen.get(rest, 0) + n
            wholes[rest, salt] = at
            at += int(w or 0)
        runs = plan.arrays()

        def place(batches, code=code, cap=cap, runs=runs, offset=offset, wholes=wholes):
            for pdf in batches:
                if not len(pdf):
                    continue
                rest, salt = pdf["rest"].to_numpy(), pdf["salt"].to_numpy()
                rank = pdf["rank"].to_numpy() + np.array([offset[k] for k in zip(rest, salt)])
                box = np.zeros(len(pdf), dtype=np.int64)
                for s in np.unique(rest[rest > 0]):
                    m = rest == s
                    r = runs[int(s)]
                    i = np.searchsorted(r[:, 0], rank[m], side="right") - 1
                    box[m] = r[i, 2] + (rank[m] - r[i, 0]) // r[i, 3]
                doc, whole, done = pdf["doc_id"].to_numpy(), pdf["whole"].to_numpy(), pdf["before"].to_numpy()
                first = np.array([wholes[k] for k in zip(rest, salt)]) + done
                has = rest > 0
                yield pd.DataFrame({"pack_code": code, "container_no": box[has], "doc_id": doc[has], "piece_no": (whole[has] + 1).astype(np.int32), "first_token": whole[has] * cap + 1, "tokens": rest[has]})
                cut = np.flatnonzero(whole > 0)
                if len(cut):
                    k = np.repeat(cut, whole[cut])
                    piece = np.concatenate([np.arange(w) for w in whole[cut]])
                    yield pd.DataFrame({"pack_code": code, "container_no": first[k] + piece, "doc_id": doc[k], "piece_no": (piece + 1).astype(np.int32), "first_token": piece * cap + 1, "tokens": np.full(len(k), cap)})

        w = "partition by rest, salt order by doc_id, tokens"
        ranked = salted.repartition(parallelism(spark), "rest", "salt").selectExpr("doc_id", "rest", "whole", "salt", f"row_number() over ({w}) - 1 as rank", f"coalesce(sum(whole) over ({w} rows between unbounded preceding and 1 preceding), 0) as before")
        out = out.unionByName(ranked.mapInPandas(place, "pack_code string, container_no long, doc_id long, piece_no int, first_token long, tokens long"))
    return out


def packing_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_code, capacity_tokens, containers, tokens, filled): filled is the share of all room that is used."""
    per = packed.filter("container_no > 0").groupBy("pack_code").agg(F.max("container_no").alias("containers"), F.sum("tokens").alias("tokens"))
    return per.join(capacities.select("pack_code", "capacity_tokens").distinct(), "pack_code").select("pack_code", "capacity_tokens", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))
