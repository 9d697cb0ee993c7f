"""Rings put together from pieces, and nearest edges through a grid."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEGREE_M = 111320.0


def _join(pieces: list[list[tuple[float, float]]]) -> list[tuple[list[tuple[float, float]], bool]]:
    """Lines grown from pieces that share an end, each with whether it closes; a piece may be turned round."""
    ends: dict[tuple[float, float], set[int]] = {}
    for i, p in enumerate(pieces):
        ends.setdefault(p[0], set()).add(i)
        ends.setdefault(p[-1], set()).add(i)
    used, out = set(), []
    for i, p in enumerate(pieces):
        if i in used:
            continue
        used.add(i)
        line = list(p)
        for _ in range(2):
            while line[0] != line[-1] and (free := ends.get(line[-1], set()) - used):
                k = min(free)
                used.add(k)
                q = pieces[k] if pieces[k][0] == line[-1] else pieces[k][::-1]
                line += q[1:]
            if line[0] == line[-1]:
                break
            line.reverse()  # the other end may go on
        out.append((line, len(line) > 3 and line[0] == line[-1]))
    return out


def joined_rings(pieces: DataFrame, id_col: str, piece: str) -> DataFrame:
    """(id, ring, closed) from rows (id, piece: array of lng, lat); one outline's pieces, which are few, meet in one task.

    Null and empty pieces and points without a position are left out; pieces that meet no other come out as they are, not closed.
    """
    kind = dict(pieces.dtypes)[id_col]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = _join([[(p["lng"], p["lat"]) for p in x] for x in pdf["piece"]])
        return pd.DataFrame({id_col: [pdf[id_col].iloc[0]] * len(rings), "ring": [[{"lng": x, "lat": y} for x, y in line] for line, _ in rings], "closed": [c for _, c in rings]})

    placed = F.filter(piece, lambda p: p["lng"].isNotNull() & p["lat"].isNotNull())
    src = pieces.filter(F.col(id_col).isNotNull()).select(id_col, placed.alias("piece")).filter("size(piece) > 1")
    return src.groupBy(id_col).applyInPandas(build, f"{id_col} {kind}, ring array<struct<lng double, lat double>>, closed boolean")


def nearest_edges(points: DataFrame, edges: DataFrame, metres: float) -> DataFrame:
    """Rows of ``points`` (lat, lng, ...) with the ``metres`` to each edge (x1, y1, x2, y2 in degrees) within reach.

    Edges stand in all cells of a grid that they come near to, a point in its own; distances are plane ones about the point.
    """
    step = metres / DEGREE_M
    wide = step / math.cos(math.radians(70))  # enough up to 70 degrees of latitude; cells are only a first filter
    cell = lambda c, s: F.floor(c / s)
    e = edges.select("x1", "y1", "x2", "y2")
    e = e.withColumn("cy", F.explode(F.sequence(cell(F.least("y1", "y2") - step, step), cell(F.greatest("y1", "y2") + step, step))))
    e = e.withColumn("cx", F.explode(F.sequence(cell(F.least("x1", "x2") - wide, wide), cell(F.greatest("x1", "x2") + wide, wide))))
    p = points.withColumn("cy", cell(F.col("lat"), step)).withColumn("cx", cell(F.col("lng"), wide))
    k = F.cos(F.radians("lat")) * DEGREE_M
    ax, ay, bx, by = (F.col("x1") - F.col("lng")) * k, (F.col("y1") - F.col("lat")) * DEGREE_M, (F.col("x2") - F.col("lng")) * k, (F.col("y2") - F.col("lat")) * DEGREE_M
    both = p.join(e, ["cy", "cx"]).withColumns({"ax": ax, "ay": ay, "dx": bx - ax, "dy": by - ay})
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy")) / F.nullif(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), F.lit(0.0))))
    both = both.withColumn("f", F.coalesce(f, F.lit(0.0)))
    d = F.sqrt(F.pow(F.col("ax") + F.col("f") * F.col("dx"), 2) + F.pow(F.col("ay") + F.col("f") * F.col("dy"), 2))
    return both.select(*points.columns, d.alias("metres"))
