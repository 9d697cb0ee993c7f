"""Points near other points, and the regions that contain points.

``near_pairs`` is an equi-join on the cells of a latitude-banded grid with an exact great-circle test.
``regions_of_points`` clips polygons into triangles by ears, spreads the triangles over the leaves of a
bounding-volume hierarchy, tests candidate triangles exactly and joins the hits of a region into one row.

Defined results: a row without a position (null or NaN, both zero, out of range) or without an id
takes no part; repeated rows count once; an id with several positions is near whatever any of them is
near; points on a region's border belong to it, points on a hole's border don't; a ring of fewer than
three different vertices bounds nothing; empty inputs give empty results. Only the named columns are
read, so further columns of any name do no harm.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veyra.functions.geometry import BoxTree, SplitTree, boxes_of, clean_ring, ear_clip, locate
from veyra.session import parallelism, stage

EARTH_M = 6_371_000.0


def positioned(df: DataFrame, id_col: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """(id, lat, lng) of the rows that have a position, each once."""
    la, ln = F.col(lat).cast("double"), F.col(lng).cast("double")
    ok = F.col(id_col).isNotNull() & la.between(-90, 90) & ln.between(-180, 180) & ~((la == 0) & (ln == 0))
    return df.filter(ok).select(F.col(id_col).cast("long").alias("id"), la.alias("lat"), ln.alias("lng")).distinct()


def great_circle_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_M)


def _band(lat: Column, step: float) -> Column:
    return F.floor((lat + 90.0) / step)


def _cells_in(band: Column, step: float) -> Column:
    """Cells of a band: each at least as wide as the distance, at the band's edge nearer to a pole."""
    edge = F.greatest(F.abs(band * step - 90.0), F.abs((band + 1) * step - 90.0))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0 / step) * F.cos(F.radians(F.least(edge, F.lit(90.0))))))


def near_pairs(probe: DataFrame, build: DataFrame, metres: float, hot_cell: int = 2000) -> DataFrame:
    """All (a, b) with a of ``probe`` and b of ``build`` at most ``metres`` apart.

    Both have (id, lat, lng) and any further columns, which come out with prefix a_ and b_. A build row
    lies in one cell; a probe row looks into the cells its circle touches. Build rows of a cell with more
    than ``hot_cell`` rows are spread over salts, so one spot with any share of the rows is many tasks.
    """
    step = math.degrees(metres / EARTH_M) * (1 + 1e-9)
    b = build.select(*[F.col(c).alias(f"b_{c}") for c in build.columns])
    band = _band(F.col("b_lat"), step)
    b = b.withColumn("band", band).withColumn("cell", F.floor((F.col("b_lng") + 180.0) / (360.0 / _cells_in(F.col("band"), step))) % _cells_in(F.col("band"), step))
    hot = b.groupBy("band", "cell").count().filter(F.col("count") > hot_cell).select("band", "cell", F.ceil(F.col("count") / hot_cell).cast("int").alias("salts"))
    b = b.join(hot, ["band", "cell"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b_id", "b_lat", "b_lng"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")

    a = probe.select(*[F.col(c).alias(f"a_{c}") for c in probe.columns])
    last = F.floor(F.lit(180.0 / step))
    a = a.withColumn("band", F.explode(F.sequence(F.greatest(F.lit(0), _band(F.col("a_lat"), step) - 1), F.least(last, _band(F.col("a_lat"), step) + 1))))
    reach = math.sin(math.radians(step)) / F.cos(F.radians(F.col("a_lat")))
    half = F.when(reach < 1, F.degrees(F.asin(reach)) * (1 + 1e-9)).otherwise(180.0)
    a = a.withColumn("n", _cells_in(F.col("band"), step)).withColumn("half", half)
    lo, hi = F.floor((F.col("a_lng") + 180.0 - F.col("half")) / (360.0 / F.col("n"))), F.floor((F.col("a_lng") + 180.0 + F.col("half")) / (360.0 / F.col("n")))
    a = a.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(lo, F.least(hi, lo + F.col("n"))), lambda c: F.pmod(c, F.col("n")))))).drop("n", "half")
    a = a.join(hot, ["band", "cell"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")

    near = great_circle_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")) <= metres
    return a.join(b, ["band", "cell", "salt"]).filter(near).drop("band", "cell", "salt")


def triangles(regions: DataFrame, id_col: str, rings: str = "rings") -> DataFrame:
    """(region, hole, t): the triangles of every ring, t being six coordinates; the first ring is the outline."""

    def clip(batches):
        for pdf in batches:
            rows = []
            for region, k, xs, ys in zip(pdf["region"], pdf["k"], pdf["xs"], pdf["ys"]):
                rows += [(region, k > 0, t) for t in ear_clip(clean_ring(xs, ys)).reshape(-1, 6).tolist()]
            yield pd.DataFrame(rows, columns=["region", "hole", "t"])

    src = regions.filter(F.col(id_col).isNotNull() & F.col(rings).isNotNull()).select(F.col(id_col).cast("long").alias("region"), F.posexplode(rings).alias("k", "ring"))
    src = src.filter("ring is not null").select("region", "k", F.transform("ring", lambda v: v["lng"]).alias("xs"), F.transform("ring", lambda v: v["lat"]).alias("ys"))
    return src.mapInPandas(clip, "region long, hole boolean, t array<double>")


def ring_faults(regions: DataFrame, id_col: str, rings: str = "rings") -> DataFrame:
    """(region, ring_no, vertices, fault): rings that bound no plain area and whose triangles therefore can't be trusted.

    ``few`` has under three corners, ``crossed`` meets itself: clipping found no ear, or the triangles' areas don't add up to the ring's.
    Fault is null for a sound ring.
    """

    def check(batches):
        for pdf in batches:
            rows = []
            for region, k, xs, ys in zip(pdf["region"], pdf["k"], pdf["xs"], pdf["ys"]):
                ring, forced = clean_ring(xs, ys), []
                t = ear_clip(ring, forced)
                own = abs(float(np.sum(ring[:, 0] * np.roll(ring[:, 1], -1) - np.roll(ring[:, 0], -1) * ring[:, 1]))) if len(ring) else 0.0
                parts = float(np.abs((t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 1, 1] - t[:, 0, 1]) * (t[:, 2, 0] - t[:, 0, 0])).sum())
                rows.append((region, k + 1, len(ring), "few" if len(ring) < 3 else "crossed" if forced or abs(parts - own) > 1e-9 * max(parts, 1e-300) + 1e-15 * float(np.abs(ring).max()) ** 2 * len(ring) else None))
            yield pd.DataFrame(rows, columns=["region", "ring_no", "vertices", "fault"])

    src = regions.filter(F.col(id_col).isNotNull() & F.col(rings).isNotNull()).select(F.col(id_col).cast("long").alias("region"), F.posexplode(rings).alias("k", "ring"))
    src = src.filter("ring is not null").select("region", "k", F.transform("ring", lambda v: v["lng"]).alias("xs"), F.transform("ring", lambda v: v["lat"]).alias("ys"))
    return src.mapInPandas(check, "region long, ring_no int, vertices int, fault string")


def regions_of_points(points: DataFrame, regions: DataFrame, id_col: str, rings: str = "rings", per_leaf: int = 256, max_leaves: int = 4096, fit_sample: int = 50_000, points_a_task: int = 50_000) -> DataFrame:
    """(region, id) for each point (id, lat, lng) inside a region's outline and in none of its holes.

    The planes of the hierarchy are fitted to the centres of at most ``fit_sample`` triangles; every
    triangle is placed by them. Only the planes and the boxes of at most ``max_leaves`` leaves reach the
    driver and the executors. A leaf with many points is spread over salts that each get its triangles.
    Borders belong to their region: a point on an edge that triangles of one region share comes out once, one on the
    border of two regions comes out with each of them, and one on the edge of a hole lies in the hole.
    """
    spark = points.sparkSession
    tris = stage(triangles(regions, id_col, rings), "triangles")
    n = tris.count()
    if n == 0:
        return points.select(F.col("id").alias("region"), "id").limit(0)
    share = min(1.0, fit_sample / n)
    sample = [r[0] for r in (tris if share == 1.0 else tris.sample(share, 7)).select("t").limit(2 * fit_sample).collect()]
    depth = max(0, min(math.ceil(math.log2(max(1, n / per_leaf))), int(math.log2(max_leaves))))
    planes = SplitTree(np.array(sample).reshape(-1, 3, 2).mean(1), depth)

    @F.pandas_udf("int")
    def leaf_of(t: pd.Series) -> pd.Series:
        return pd.Series(planes.leaf(np.stack(t.to_numpy()).reshape(-1, 3, 2).mean(1)).astype(np.int32))

    placed = tris.withColumn("leaf", leaf_of("t"))
    xs, ys = F.array("t0", "t2", "t4"), F.array("t1", "t3", "t5")
    flat = placed.select("leaf", *[F.col("t")[i].alias(f"t{i}") for i in range(6)])
    boxes = np.full((2**depth, 4), np.inf)
    boxes[:, 2:] = -np.inf
    for leaf, *box in flat.groupBy("leaf").agg(F.min(F.array_min(xs)), F.min(F.array_min(ys)), F.max(F.array_max(xs)), F.max(F.array_max(ys))).collect():
        boxes[leaf] = box
    tree = BoxTree(boxes)

    def route(batches):
        for pdf in batches:
            p, leaf = tree.route(pdf["lng"].to_numpy(), pdf["lat"].to_numpy())
            yield pd.DataFrame({"leaf": leaf.astype(np.int32), "id": pdf["id"].to_numpy()[p], "lat": pdf["lat"].to_numpy()[p], "lng": pdf["lng"].to_numpy()[p]})

    routed = stage(points.select("id", "lat", "lng").mapInPandas(route, "leaf int, id long, lat double, lng double"), "routed")
    busy = {r[0]: math.ceil(r[1] / points_a_task) for r in routed.groupBy("leaf").count().filter(F.col("count") > points_a_task).collect()}
    salts = F.coalesce(F.create_map(*[F.lit(x) for kv in busy.items() for x in kv])[F.col("leaf")], F.lit(1)) if busy else F.lit(1)
    left = routed.withColumn("salt", F.pmod(F.xxhash64("id", "lat", "lng"), salts).cast("int"))
    right = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))

    def test(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(t):
            return pd.DataFrame({"region": np.empty(0, np.int64), "id": np.empty(0, np.int64), "lat": np.empty(0), "lng": np.empty(0), "hole": np.empty(0, bool)})
        i, j = locate(p["lng"].to_numpy(), p["lat"].to_numpy(), np.stack(t["t"].to_numpy()))
        hits = pd.DataFrame({"region": t["region"].to_numpy()[j], "id": p["id"].to_numpy()[i], "lat": p["lat"].to_numpy()[i], "lng": p["lng"].to_numpy()[i], "hole": t["hole"].to_numpy()[j]})
        return hits.drop_duplicates()

    parts = parallelism(spark)
    hits = left.repartition(parts, "leaf", "salt").groupBy("leaf", "salt").cogroup(right.repartition(parts, "leaf", "salt").groupBy("leaf", "salt")).applyInPandas(test, "region long, id long, lat double, lng double, hole boolean")
    inside = hits.groupBy("region", "id", "lat", "lng").agg(F.max("hole").alias("in_hole")).filter(~F.col("in_hole"))
    return inside.select("region", "id").distinct()


def near_and_inside(pins: DataFrame, points: DataFrame, regions: DataFrame, metres: float = 150.0) -> DataFrame:
    """(relation, a_key, b_key): pins near pins, pins near points, and the regions of both."""
    p = positioned(pins, "location_id").withColumn("kind", F.lit("near_pin"))
    q = positioned(points, "point_id").withColumn("kind", F.lit("near_point"))
    both = stage(p.unionByName(q), "positions")
    near = near_pairs(both.filter("kind = 'near_pin'").drop("kind"), both, metres)
    near = near.filter((F.col("b_kind") == "near_point") & (F.col("a_id") != F.col("b_id")) | (F.col("a_id") < F.col("b_id")))
    near = near.select(F.col("b_kind").alias("relation"), F.least("a_id", "b_id").alias("a_key"), F.greatest("a_id", "b_id").alias("b_key"))
    inside = regions_of_points(both.drop("kind"), regions, "district_id")
    inside = inside.filter("region != id").select(F.lit("in_district").alias("relation"), F.least("region", "id").alias("a_key"), F.greatest("region", "id").alias("b_key"))
    return near.unionByName(inside).distinct()
