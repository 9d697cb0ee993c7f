import datetime

from pyspark.sql import functions as F

from veyra.streaming.drain import drain, open_files
from veyra.streaming.state import attributed, capped_counts, changes, daily_counts, liveness, once, transitions


def parts(spark, tmp_path, name, batches, schema):
    """One file a batch, in order of time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return open_files(spark, str(tmp_path / name), files_a_batch=1)


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def test_counts_over_several_batches(spark, tmp_path):
    s = parts(spark, tmp_path, "e", [[("a", at(1)), ("a", at(1, 5)), ("b", at(2))], [("a", at(1, 9)), ("b", at(2, 1))]], "k string, ts timestamp")
    got = {(r.day.day, r.k): r.n for r in drain(daily_counts(s, "ts", "k"), "update", ["day", "k"]).collect()}
    assert got == {(1, "a"): 3, (2, "b"): 2}


def test_changes_keep_state_between_batches(spark, tmp_path):
    s = parts(spark, tmp_path, "c", [[(1, 1, "x"), (1, 2, "x"), (2, 1, None)], [(1, 3, "y")], [(1, 4, "x"), (2, 2, "q")]], "k long, n int, v string")
    got = {r.k: (r.fetches, r.changes) for r in drain(changes(s, "k", ["n"], "v"), "update", ["k"]).collect()}
    assert got == {1: (4, 2), 2: (2, 0)}


def test_once(spark, tmp_path):
    s = parts(spark, tmp_path, "o", [[(1, at(1)), (1, at(1, 2))], [(1, at(1, 3)), (2, at(1, 4))]], "k long, ts timestamp")
    assert sorted(r.k for r in drain(once(s, ["k"], "ts").select("k")).collect()) == [1, 2]


def test_liveness_times_out(spark, tmp_path):
    s = parts(spark, tmp_path, "l", [[("a", at(1)), ("b", at(1))], [("b", at(4))], [("b", at(5))], [("b", at(6))]], "k string, ts timestamp")
    got = {r.k: r.status for r in drain(liveness(s, "k", "ts"), "update", ["k"]).select("k", "status").collect()}
    assert got == {"a": "stale", "b": "alive"}


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    s = parts(spark, tmp_path, "w", [[("a", at(1))], [("a", at(8))], [("a", at(9))], [("a", at(8, 1)), ("a", at(1, 3))]], "k string, ts timestamp")
    got = {r.day.day: r.n for r in drain(daily_counts(s, "ts", "k"), "update", ["day", "k"]).collect()}
    assert got == {1: 1, 8: 2, 9: 1}  # the second of day 1 comes eight days late, that of day 8 in time


def test_caps_transitions_and_conflicts_over_several_batches(spark, tmp_path):
    s = parts(spark, tmp_path, "k", [[(1, 1, at(1)), (2, 2, at(1, 1))], [(3, 3, at(1, 2)), (1, 4, at(1, 3)), (9, 5, at(2))]], "k long, e long, ts timestamp")
    got = {(r.day.day, r.k): r.n for r in drain(capped_counts(s, "ts", "k", "e", 2), "update", ["day", "k"]).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (2, 9): 1}
    s = parts(spark, tmp_path, "t", [[("u", "click", 1)], [("u", "error", 2), ("u", "error", 3)], [("u", "click", 4), ("u", "purchase", 5), ("v", "error", 1)]], "k string, what string, n int")
    assert {r.k: (r.uncertain, r.settled) for r in drain(transitions(s, "k", "what", ["n"]), "update", ["k"]).collect()} == {"u": (1, 1), "v": (0, 0)}
    s = parts(spark, tmp_path, "a", [[(1, 1, "x"), (1, 1, "x")], [(1, 2, "x"), (1, 3, "y")], [(2, 1, None)]], "k long, n int, v string")
    assert {r.k: (r.deliveries, r.conflicts) for r in drain(attributed(s, "k", ["n"], "v"), "update", ["k"]).collect()} == {1: (3, 1), 2: (1, 0)}
