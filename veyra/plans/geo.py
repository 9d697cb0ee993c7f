"""Spatial and graph queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.operators.graph import components, earliest_arrivals, hilbert, shortest_paths, simplify
from veyra.operators.proximity import great_circle_m, near_pairs, positioned
from veyra.plans.registry import query
from veyra.sources.tables import Tables

GOOD = "lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (lat = 0 AND lng = 0)"
HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2))))"


@query(f"""WITH q AS (SELECT DISTINCT location_id AS id, lat, lng FROM place_pins WHERE {GOOD}), p AS (SELECT DISTINCT point_id AS id, lat, lng FROM municipal_points WHERE {GOOD}),
d AS (SELECT q.id AS location_id, p.id AS point_id, {HAV.format(a='q', b='p')} AS m FROM q JOIN p ON abs(q.lat - p.lat) < 0.0046), r AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY m, point_id) AS k, count(*) OVER (PARTITION BY location_id) AS n FROM d WHERE m <= 500)
SELECT location_id, point_id, round(m, 3) AS metres, n AS within FROM r WHERE k = 1""")
def nearest_within(t: Tables) -> DataFrame:
    """The nearest point within 500 m of each pin and how many there are: cells, exact distances, one aggregate."""
    near = near_pairs(positioned(t.place_pins, "location_id"), positioned(t.municipal_points, "point_id"), 500.0)
    d = near.select("a_id", "b_id", great_circle_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")).alias("m"))
    g = d.groupBy("a_id").agg(F.min(F.struct("m", "b_id")).alias("b"), F.count("*").alias("within"))
    return g.select(F.col("a_id").alias("location_id"), F.col("b.b_id").alias("point_id"), F.round("b.m", 3).alias("metres"), "within")


@query(f"""WITH RECURSIVE q AS (SELECT DISTINCT location_id AS id, lat, lng FROM place_pins WHERE {GOOD}), e AS (SELECT a.id AS a, b.id AS b FROM q a JOIN q b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.0006 AND {HAV.format(a='a', b='b')} <= 60),
c AS (SELECT id AS node, id AS label FROM q UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.node) SELECT node, min(label) AS component FROM c WHERE node IN (SELECT a FROM e) GROUP BY 1""")
def clusters_of_pins(t: Tables) -> DataFrame:
    """Connected parts of pins that lie within 60 m of each other."""
    p = positioned(t.place_pins, "location_id")
    e = near_pairs(p, p, 60.0).filter("a_id < b_id").select("a_id", "b_id")
    return components(e, "a_id", "b_id")


@query("""WITH s AS (SELECT DISTINCT location_id, lat, lng, city FROM place_pins WHERE lat BETWEEN -90 AND 90 AND lng IS NOT NULL AND NOT (lat = 0 AND lng = 0)), m AS (SELECT city, median(lat) AS mlat, median(lng) AS mlng, count(*) AS n FROM s GROUP BY 1)
SELECT city, n AS pins, round(mlat, 6) AS mid_lat, round(mlng, 6) AS mid_lng, count(*) FILTER (WHERE sqrt(pow((lat - mlat) * 111320, 2) + pow((lng - mlng) * 111320 * cos(radians(mlat)), 2)) > 5000) AS far FROM s JOIN m USING (city) GROUP BY ALL""")
def medians_and_outliers(t: Tables) -> DataFrame:
    """Points far from their town's coordinate-wise median."""
    s = t.place_pins.filter("lat between -90 and 90 and lng is not null and not (lat = 0 and lng = 0)").select("location_id", "lat", "lng", "city").distinct()
    m = s.groupBy("city").agg(F.median("lat").alias("mlat"), F.median("lng").alias("mlng"), F.count("*").alias("pins"))
    d = F.sqrt(F.pow((F.col("lat") - F.col("mlat")) * 111320, 2) + F.pow((F.col("lng") - F.col("mlng")) * 111320 * F.cos(F.radians("mlat")), 2))
    return s.join(m, "city").groupBy("city", "pins", "mlat", "mlng").agg(F.count_if(d > 5000).alias("far")).select("city", "pins", F.round("mlat", 6).alias("mid_lat"), F.round("mlng", 6).alias("mid_lng"), "far")


@query("""WITH r AS (SELECT district_id, unnest(range(1, len(rings) + 1)) AS k, rings FROM districts), v AS (SELECT district_id, k, rings[k] AS g, unnest(range(1, len(rings[k]))) AS i FROM r)
SELECT district_id, count(*) AS corners, round(sum((g[i].lng * g[i + 1].lat - g[i + 1].lng * g[i].lat) * 1e6) / 2, 3) AS signed_area FROM v GROUP BY 1""")
def ring_measures(t: Tables) -> DataFrame:
    """Corners and signed areas of rings by the shoelace sum, inside array functions."""
    r = t.districts.select("district_id", F.explode("rings").alias("g"))
    terms = F.zip_with(F.slice("g", 1, F.size("g") - 1), F.slice("g", 2, F.size("g") - 1), lambda a, b: (a["lng"] * b["lat"] - b["lng"] * a["lat"]) * 1e6)
    s = r.select("district_id", (F.size("g") - 1).alias("n"), F.aggregate(terms, F.lit(0.0), lambda x, y: x + y).alias("s"))
    return s.groupBy("district_id").agg(F.sum("n").cast("long").alias("corners"), F.round(F.sum("s") / 2, 3).alias("signed_area"))


@query()
def simplified_outlines(t: Tables) -> DataFrame:
    """Corners of each outline that remain at a tolerance of a thousandth of a degree."""

    def run(batches):
        for pdf in batches:
            out = []
            for d, xs, ys in zip(pdf["district_id"], pdf["xs"], pdf["ys"]):
                p = np.stack([np.array(xs, dtype=float), np.array(ys, dtype=float)], 1)
                out += [(d, int(i), float(p[i, 1]), float(p[i, 0])) for i in simplify(p, 0.001)]
            yield pd.DataFrame(out, columns=["district_id", "corner", "lat", "lng"]).astype({"corner": "int32"})

    r = t.districts.filter("size(rings) > 0").select("district_id", F.transform(F.col("rings")[0], lambda v: v["lng"]).alias("xs"), F.transform(F.col("rings")[0], lambda v: v["lat"]).alias("ys"))
    return r.mapInPandas(run, "district_id long, corner int, lat double, lng double")


@query()
def hilbert_order(t: Tables) -> DataFrame:
    """Pins along a space-filling curve, so that rows near each other on the ground are near in files."""

    @F.pandas_udf("long")
    def at(lat: pd.Series, lng: pd.Series) -> pd.Series:
        x = np.clip((lng.to_numpy() + 180) / 360 * 65536, 0, 65535)
        y = np.clip((lat.to_numpy() + 90) / 180 * 65536, 0, 65535)
        return pd.Series(hilbert(x.astype(np.int64), y.astype(np.int64)))

    return positioned(t.place_pins, "location_id").select(F.col("id").alias("location_id"), at("lat", "lng").alias("curve"))


def _roads(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A road map derived from keys: nations as places, suppliers as one-way roads."""
    n = t.nation.count()
    e = t.supplier.select(F.col("s_nationkey").cast("long").alias("src"), ((F.col("s_nationkey") * 7 + F.col("s_suppkey") * 3 + 1) % n).cast("long").alias("dst"), (F.abs("s_acctbal") + 1).alias("cost"))
    return t.nation.select(F.col("n_nationkey").cast("long").alias("source")), e


@query("""WITH RECURSIVE e AS (SELECT s_nationkey AS src, (s_nationkey * 7 + s_suppkey * 3 + 1) % (SELECT count(*) FROM nation) AS dst, min(abs(s_acctbal) + 1) AS cost FROM supplier GROUP BY 1, 2),
p AS (SELECT CAST(n_nationkey AS BIGINT) AS source, CAST(n_nationkey AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost, 0 AS hops FROM nation UNION ALL (SELECT source, node, min(cost), hops FROM (SELECT p.source, CAST(e.dst AS BIGINT) AS node, p.cost + e.cost AS cost, p.hops + 1 AS hops FROM p JOIN e ON e.src = p.node WHERE p.hops < 26) GROUP BY 1, 2, 4))
SELECT source, node, round(min(cost), 4) AS cost FROM p GROUP BY 1, 2""")
def road_costs(t: Tables) -> DataFrame:
    sources, e = _roads(t)
    return shortest_paths(sources, e, "source", "src", "dst", "cost").select("source", "node", F.round("cost", 4).alias("cost"))


@query()
def arrivals(t: Tables) -> DataFrame:
    """Earliest arrivals with at most four rides on a timetable derived from keys: each customer's orders are a trip's calls."""
    n = t.nation.count()
    seq = F.expr("row_number() over (partition by o_custkey order by o_orderkey)")
    st = t.orders.select(F.col("o_custkey").alias("trip"), seq.alias("seq"), (F.col("o_orderkey") % n).alias("stop"))
    at = 21600 + (F.col("trip") % 600) * 60 + F.col("seq") * 240
    st = st.select("trip", "seq", "stop", at.alias("arrival"), (at + 30).alias("departure"))
    return earliest_arrivals(t.nation.select(F.col("n_nationkey").cast("long").alias("source")), st, 21600, 4, 120)
