import random

from pyspark.sql import functions as F

from veyra.functions.columns import school_year_start, sound_key
from veyra.operators.relational import as_of, band_join, interval_join, round_robin, snapshot_diff, unique_matches, upsert


def test_band_join_equals_brute_force(spark):
    rng = random.Random(1)
    a = [(i, rng.choice("xy"), rng.choice([0.0, -3.0, 10 * rng.random(), 1000 * rng.random()])) for i in range(150)]
    b = [(i, rng.choice("xy"), rng.choice([0.0, 10 * rng.random(), 1000 * rng.random()])) for i in range(150)]
    got = {(r.i, r.j) for r in band_join(spark.createDataFrame(a, "i int, k string, x double"), spark.createDataFrame(b, "j int, k string, y double"), ["k"], "x", "y", 0.05).collect()}
    assert got == {(i, j) for i, k, x in a for j, m, y in b if k == m and x > 0 and y > 0 and abs(x - y) <= x * 0.05}


def test_interval_join_and_as_of(spark):
    rng = random.Random(2)
    pts = [(i, rng.randrange(1000)) for i in range(100)]
    spans = [(j, s, s + rng.randrange(-5, 200)) for j in range(60) for s in [rng.randrange(1000)]]
    got = {(r.i, r.j) for r in interval_join(spark.createDataFrame(pts, "i int, t long"), spark.createDataFrame(spans, "j int, s long, e long"), "t", "s", "e", 64).collect()}
    assert got == {(i, j) for i, t in pts for j, s, e in spans if s <= t < e}
    left = [(i, i % 3, rng.randrange(100)) for i in range(50)]
    right = [(100 + j, j % 3, t) for j, t in enumerate(rng.sample(range(100), 30))]
    out = {r.i: r.v for r in as_of(spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "v int, k int, u int"), ["k"], "t", "u", ["v"]).collect()}
    for i, k, t in left:
        ok = [(u, v) for v, m, u in right if m == k and u <= t]
        assert out[i] == (max(ok)[1] if ok else None)


def test_upsert_diff_and_unique(spark):
    s = "k int, a string, n int"
    old, new = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (3, "z", None)], s), spark.createDataFrame([(2, None, 7), (3, "z", None), (4, "w", 1)], s)
    got = {r.k: (r.a, r.n, r.action) for r in upsert(old, new, ["k"], ["a"]).collect()}
    assert got == {1: ("x", 5, "kept"), 2: ("y", 7, "updated"), 3: ("z", None, "unchanged"), 4: ("w", 1, "created")}
    assert {(r.k, r.change) for r in snapshot_diff(old, new, ["k"]).collect()} == {(1, "removed"), (2, "changed"), (4, "added")}
    assert upsert(old, old.limit(0), ["k"]).filter("action != 'kept'").count() == 0
    right = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), ("y", 3)], "a string, id int")
    assert [(r.k, r.id) for r in unique_matches(old, right, ["a"], "id").collect()] == [(1, 1)]


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([(g, i, 10) for g, n in (("a", 5), ("b", 2), ("c", 1)) for i in range(n)], "g string, i int, w int")
    got = sorted((r.turn, r.g) for r in round_robin(df, "g", [F.asc("i")], "w", 55).collect())
    assert got == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b")]


def test_sound_and_years(spark):
    df = spark.createDataFrame([("Звънлива",), ("Zvunlivа",), ("дъжд",), ("",), (None,)], "s string")
    a, b, c, d, e = [r[0] for r in df.select(sound_key(F.col("s"))).collect()]
    assert a == "sfnlf" and c == "tst" and d == "" and e is None and b.startswith("sfnl")
    y = spark.createDataFrame([("2025/2026",), ("2025-26",), ("2025/2027",), ("2099/00",), ("x",), (None,)], "s string")
    assert [r[0] for r in y.select(school_year_start(F.col("s"))).collect()] == [2025, 2025, None, None, None, None]


def test_sliced_running_sum_equals_one_pass(spark):
    from veyra.operators.relational import sliced_running_sum

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(10)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r.i: r.run for r in sliced_running_sum(df, ["k"], F.floor(F.col("i") / 17), [F.col("i")], F.col("v"), "run").collect()}
    total = {}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + v
        assert got[i] == total[k]
    whole = sliced_running_sum(df, [], F.floor(F.col("i") / 50), [F.col("i")], F.col("v"), "run").agg(F.max("run")).first()[0]
    assert whole == sum(v for _, _, v in rows)
