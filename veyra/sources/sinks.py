"""Writers: merges into partitioned files, staged replacement, calendars and allowlisted JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veyra.session import stage


def merge_partitions(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partitions: list[str]) -> None:
    """Rows of ``new`` replace those of equal ``keys``; only the partitions that ``new`` touches are read and written again."""
    try:
        old = spark.read.schema(new.schema).parquet(path).join(new.select(*partitions).distinct(), partitions, "left_semi")
        kept = old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns)
        both = kept.unionByName(new)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        both = new
    stage(both, "merge").repartition(*partitions).sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the table, moves the old one aside and the new one into place, then removes the old one.

    Whatever fails, the old or the new table is whole, in place or under ``.old-``; a failed move is undone and raised.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    jvm = spark.sparkContext._jvm
    at, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new-{mark}", f"{path}.old-{mark}"))
    df.write.parquet(new.toString())
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"the new table can't be moved to {path}")
    if had:
        fs.delete(old, True)


def allowlisted_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value): rows as JSON of the named columns alone; null fields are left out."""
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def calendar_lines(df: DataFrame, uid: str, day: str, title: str) -> DataFrame:
    """(value): all-day events as iCalendar text; long lines are folded at 75 bytes."""
    esc = F.regexp_replace(F.col(title), r"([\\,;])", r"\\$1")

    @F.pandas_udf("string")
    def fold(s):
        def one(line):
            raw, out, width = line.encode(), [], 75
            while len(raw) > width:
                cut = width
                while raw[cut] & 0xC0 == 0x80:
                    cut -= 1
                out.append(raw[:cut].decode())
                raw, width = raw[cut:], 74
            return "\r\n ".join([*out, raw.decode()])

        return s.map(lambda t: "\r\n".join(one(x) for x in t.split("\r\n")) if t is not None else None)

    body = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col(uid).cast("string")), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd")), F.concat(F.lit("SUMMARY:"), esc), F.lit("END:VEVENT"))
    return df.filter(F.col(day).isNotNull()).select(fold(body).alias("value"))
