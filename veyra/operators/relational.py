"""Set, window and matching operators over any DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; the order's last term must tell equal rows apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def unique_matches(left: DataFrame, right: DataFrame, keys: list[str], right_id: str) -> DataFrame:
    """An inner join that keeps only keys for which ``right`` has exactly one ``right_id``."""
    one = right.groupBy(*keys).agg(F.count_distinct(right_id).alias("_n"), F.min(right_id).alias(right_id)).filter("_n = 1").drop("_n")
    return left.join(one, keys)


def tiered_match(left: DataFrame, tiers: list[tuple[DataFrame, list[str]]], right_id: str) -> DataFrame:
    """``left`` with the ``right_id`` of its first tier that matches uniquely, and the tier's number; null without any."""
    out, hits = left, []
    for i, (right, keys) in enumerate(tiers, 1):
        one = right.groupBy(*keys).agg(F.count_distinct(right_id).alias("_n"), F.min(right_id).alias(f"_id{i}")).filter("_n = 1").drop("_n")
        out = out.join(one, keys, "left")
        hits.append(f"_id{i}")
    tier = F.coalesce(*[F.when(F.col(h).isNotNull(), F.lit(i)) for i, h in enumerate(hits, 1)])
    return out.withColumn(right_id, F.coalesce(*hits)).withColumn("tier", tier).drop(*hits)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str, share: float) -> DataFrame:
    """Pairs of equal keys whose values differ by at most ``share`` of the left one.

    Values are put into bands that grow with them, and a left row looks into the bands its interval touches, so hot keys are
    spread over bands and the join stays an equi-join.
    """
    step = F.log(F.lit(1 + 2 * share))
    band = lambda c: F.floor(F.log(c) / step)
    a = left.filter(F.col(left_value) > 0).withColumn("_b", F.explode(F.sequence(band(F.col(left_value) * (1 - share)), band(F.col(left_value) * (1 + share)))))
    b = right.filter(F.col(right_value) > 0).withColumn("_b", band(F.col(right_value)))
    return a.join(b, [*keys, "_b"]).filter(F.abs(F.col(left_value) - F.col(right_value)) <= F.col(left_value) * share).drop("_b")


def interval_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """Rows of ``points`` with each span that holds them (start <= point < end), by cells of ``width`` on the axis."""
    a = points.withColumn("_c", F.floor(F.col(point) / width))
    b = spans.filter(F.col(end) > F.col(start)).withColumn("_c", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return a.join(b, "_c").filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_c")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, carry: list[str]) -> DataFrame:
    """``left`` with the ``carry`` columns of its keys' latest ``right`` row not after it: one union, one window, no range join."""
    cols = [c for c in left.columns]
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(right.select(F.struct(*carry)).schema[0].dataType).alias("_carry"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*carry).alias("_carry"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_last", F.last("_carry", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in carry])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_if_null: list[str] = ()) -> DataFrame:
    """``old`` with ``new`` merged in by key: new rows inserted, others updated; named columns never lose a value to a null.

    Both have the same columns and unique keys; ``action`` tells created, updated, unchanged and kept rows apart.
    """
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_o"))
    b = new.select(*keys, F.struct(*values).alias("_n"))
    j = a.join(b, keys, "full")
    merged = [(F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}")) if c in keep_old_if_null else F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))).alias(c) for c in values]
    action = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNull(), "kept").when(F.struct(*[m for m in merged]).eqNullSafe(F.col("_o")), "unchanged").otherwise("updated")
    return j.select(*keys, *merged, action.alias("action"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) with change one of added, removed, changed; equal rows are left out."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_o"), F.lit(1).alias("_in_o"))
    b = new.select(*keys, F.struct(*values).alias("_n"), F.lit(1).alias("_in_n"))
    j = a.join(b, keys, "full")
    change = F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return j.select(*keys, change.alias("change")).filter("change is not null")


def sliced_running_sum(df: DataFrame, keys: list[str], slice_of: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the running sum of ``value`` in each key's order, made in slices of that order.

    Slices must follow the order. Each is summed by a task of its own and starts from the sum of those before it, so a key of any
    share of the rows is many tasks. Null keys are one key.
    """
    d = df.withColumn("_k", F.to_json(F.struct(*[F.col(k).alias(k) for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("")).withColumn("_s", slice_of).withColumn("_v", value)
    per = d.groupBy("_k", "_s").agg(F.sum("_v").alias("_t"))
    before = per.select("_k", "_s", (F.sum("_t").over(Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_t")).alias("_b"))
    w = Window.partitionBy("_k", "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.join(before, ["_k", "_s"]).withColumn(name, F.col("_b") + F.sum("_v").over(w)).drop("_k", "_s", "_v", "_b")


def round_robin(df: DataFrame, group: str, order: list[Column], budget: str, most: float) -> DataFrame:
    """Rows taken one from each group in turn while the running sum of ``budget`` stays within ``most``.

    The turn is a row's rank in its group. Turns are summed first, in slices; only the turns that begin within the budget are
    then summed row by row.
    """
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    per_turn = sliced_running_sum(ranked.groupBy("turn").agg(F.sum(budget).alias("_sum")), [], F.floor(F.col("turn") / 4096), [F.col("turn")], F.col("_sum"), "_upto")
    before = per_turn.select("turn", (F.col("_upto") - F.col("_sum")).alias("_before")).filter(F.col("_before") <= most)
    w = Window.partitionBy("turn").orderBy(group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.join(before, "turn").withColumn("_run", F.col("_before") + F.sum(budget).over(w)).filter(F.col("_run") <= most).drop("_before", "_run")


def carried(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the last value that isn't null at or before each row of a key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def multiset_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lost, gained): how many times a row occurs less or more often than before."""
    a = old.groupBy(*keys).agg(F.count("*").alias("_o"))
    b = new.groupBy(*keys).agg(F.count("*").alias("_n"))
    d = F.coalesce("_n", F.lit(0)) - F.coalesce("_o", F.lit(0))
    return a.join(b, keys, "full").select(*keys, F.greatest(-d, F.lit(0)).alias("lost"), F.greatest(d, F.lit(0)).alias("gained")).filter("lost + gained > 0")
