import math

import numpy as np
from pyspark.sql import Row
from pyspark.sql import types as T

from veyra.operators.proximity import EARTH_M, near_and_inside, near_pairs, positioned

RING = T.ArrayType(T.ArrayType(T.StructType([T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType())])))
PIN = "location_id long, lat double, lng double, name string, band string, salt int"
POINT = "point_id long, lat double, lng double, cell string"
DISTRICT = T.StructType([T.StructField("district_id", T.LongType()), T.StructField("rings", RING), T.StructField("hole", T.StringType())])


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1, math.sqrt(h)))


def square(x, y, d):
    return [Row(lng=x, lat=y), Row(lng=x + d, lat=y), Row(lng=x + d, lat=y + d), Row(lng=x, lat=y + d), Row(lng=x, lat=y)]


def test_pairs_equal_brute_force_also_at_the_date_line_and_poles(spark):
    rng = np.random.default_rng(2)
    spots = [(42.0, 23.0), (0.001, 179.9995), (0.001, -179.9995), (89.9995, 10.0), (-60.0, -180.0)]
    rows = [(i, float(np.clip(spots[i % 5][0] + rng.normal() * 1e-3, -90, 90)), float((spots[i % 5][1] + rng.normal() * 2e-3 + 180) % 360 - 180)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double")
    got = {(r.a_id, r.b_id) for r in near_pairs(df, df, 150.0, hot_cell=3).filter("a_id < b_id").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and metres(a[1:], b[1:]) <= 150}
    assert got == want and want


def test_positions(spark):
    rows = [(1, None, 1.0), (2, 0.0, 0.0), (3, 91.0, 1.0), (4, float("nan"), 1.0), (5, 0.0, 1.0), (5, 0.0, 1.0), (None, 1.0, 1.0), (6, 1.0, 181.0)]
    assert [tuple(r) for r in positioned(spark.createDataFrame(rows, "k long, lat double, lng double"), "k").collect()] == [(5, 0.0, 1.0)]


def test_regions_holes_ties_and_clashing_names(spark):
    pins = spark.createDataFrame([(10, 42.5, 23.5, "a", "x", 1), (10, 42.5, 23.5, "a", "x", 1), (11, 42.5001, 23.5, None, None, None), (12, 42.1, 23.1, "b", "y", 2), (13, 50.0, 50.0, "c", "z", 3), (14, None, None, None, None, None)], PIN)
    points = spark.createDataFrame([(90, 42.5, 23.5, "c"), (91, 42.9, 23.9, "d")], POINT)
    districts = spark.createDataFrame([(1, [square(23.0, 42.0, 1.0), square(23.4, 42.4, 0.2)], "h"), (2, [square(23.4, 42.4, 0.2)], "h"), (2, [square(23.4, 42.4, 0.2)], "h"), (3, None, None), (4, [[Row(lng=1.0, lat=1.0)]], None), (None, [square(0.0, 0.0, 90.0)], None)], DISTRICT)
    got = sorted(map(tuple, near_and_inside(pins, points, districts).collect()))
    assert got == sorted([("near_pin", 10, 11), ("near_point", 10, 90), ("near_point", 11, 90), ("in_district", 2, 10), ("in_district", 2, 11), ("in_district", 2, 90), ("in_district", 1, 12), ("in_district", 1, 91)])


def test_empty_tables(spark):
    out = near_and_inside(spark.createDataFrame([], PIN), spark.createDataFrame([], POINT), spark.createDataFrame([], DISTRICT))
    assert out.columns == ["relation", "a_key", "b_key"] and out.count() == 0
