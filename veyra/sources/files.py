"""Readers of files as they come: odd CSV tables, registers, feature collections, dumps, timetables, packed numbers, spreadsheets."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def decimal_comma(c):
    """A number written with a comma or a point; null where it is none."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def flat_header(rows: list[list[str]], marks: set[str]) -> tuple[int, list[str]] | None:
    """(first data row, column names) of a table whose header may follow a preamble and span two rows.

    The header is the first row that holds one of ``marks``. If the row after it has no number, it is a second header row:
    a top cell goes on to the right over blank ones, and both cells of a column join into its name.
    """
    clean = [[c.replace("﻿", "").strip() for c in r] for r in rows]
    for i, r in enumerate(clean):
        if marks & {c.lower() for c in r}:
            below = clean[i + 1] if i + 1 < len(clean) else []
            two = bool(below) and any(below) and not any(re.search(r"\d", c) for c in below) and not marks & {c.lower() for c in below}
            if not two:
                return i + 1, r
            top, out = "", []
            for k in range(max(len(r), len(below))):
                top = (r[k] if k < len(r) else "") or top
                sub = below[k] if k < len(below) else ""
                out.append(f"{top} {sub}".strip() if sub else (r[k] if k < len(r) else ""))
            return i + 2, out
    return None


def wide_scores(spark: SparkSession, path: str, id_names: dict[str, list[str]], value_marks: tuple[str, ...], count_marks: tuple[str, ...]) -> DataFrame:
    """(file, <ids>, subject, value, count): a wide CSV of scores, a row for each subject that has a value.

    ``id_names`` has the spellings of each id column. A column whose name ends in a value mark is a subject's value, one
    that ends in a count mark its count. Commas are decimal, and a value of 0 or nothing is missing. Each file is small and read
    whole by one task; many files are many tasks.
    """
    marks = {n.lower() for names in id_names.values() for n in names}
    ids = list(id_names)

    def read(batches):
        for pdf in batches:
            out = []
            for name, raw in zip(pdf["path"], pdf["content"]):
                text = bytes(raw).decode("utf-8-sig", "replace")
                rows = list(csv.reader(io.StringIO(text), delimiter=";" if text.count(";") > text.count(",") else ","))
                found = flat_header(rows, marks)
                if not found:
                    continue
                at, cols = found
                low = [c.lower() for c in cols]
                where = {k: next((low.index(n.lower()) for n in names if n.lower() in low), None) for k, names in id_names.items()}
                subjects: dict[str, dict[str, int]] = {}
                for k, c in enumerate(low):
                    for kind, ends in (("value", value_marks), ("count", count_marks)):
                        end = next((m for m in ends if c.endswith(m.lower())), None)
                        if end and k not in where.values():
                            subjects.setdefault(c[: -len(end)].strip(), {})[kind] = k
                num = lambda r, k: float(r[k].strip().replace(",", ".")) if k is not None and k < len(r) and re.fullmatch(r"-?\d+(?:[.,]\d+)?", r[k].strip()) else None
                for r in rows[at:]:
                    own = [r[where[k]].strip() if where[k] is not None and where[k] < len(r) else None for k in ids]
                    if not any(own):
                        continue
                    for s, cs in subjects.items():
                        v = num(r, cs.get("value"))
                        if v:
                            n = num(r, cs.get("count"))
                            out.append((name.rsplit("/", 1)[-1], *own, s, v, None if n is None else int(n)))
            yield pd.DataFrame(out, columns=["file", *ids, "subject", "value", "count"]).astype({"count": "Int64"})

    schema = "file string, " + ", ".join(f"{k} string" for k in ids) + ", subject string, value double, count long"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)


def address_register(spark: SparkSession, path: str, lat: str = "n", lng: str = "e") -> DataFrame:
    """A ``;``-separated register; rows whose coordinates are no numbers or off the globe are left out."""
    df = spark.read.option("sep", ";").option("header", True).csv(path)
    la, ln = decimal_comma(F.col(lat)), decimal_comma(F.col(lng))
    return df.withColumn(lat, la).withColumn(lng, ln).filter(F.col(lat).between(-90, 90) & F.col(lng).between(-180, 180))


def feature_collection(spark: SparkSession, path: str, key: str, prefer: str) -> DataFrame:
    """(key, properties, type, coordinates) of GeoJSON features; of several with one key that with the larger ``prefer``."""
    schema = "features array<struct<properties map<string,string>, geometry struct<type string, coordinates string>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    rows = raw.select(F.col("f.properties")[key].alias("key"), F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates")).filter("key is not null")
    rank = F.struct(F.col("properties")[prefer].try_cast("double").alias("p"), F.to_json("properties").alias("j"))
    return rows.groupBy("key").agg(F.max_by(F.struct("properties", "type", "coordinates"), rank).alias("v")).select("key", "v.*")


def partitioned_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tree of JSON files whose folders are named key=value; partitions are pruned by filters on these keys."""
    return spark.read.schema(schema).json(path)


def copy_dump(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated dump with \\N for null and backslash escapes, all columns as text."""
    raw = spark.read.text(path).filter(r"value not in ('\\.', '')")
    parts = F.split("value", "\t")
    # a backslash and what follows it are one mark: marks are taken from the left, so an escaped backslash never opens another
    marks = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}
    table = F.create_map(*[F.lit(x) for kv in marks.items() for x in kv])
    text = lambda c: F.when(~c.contains("\\"), c).otherwise(F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(\\.|[^\\]+)"), F.lit(1)), lambda x: F.when(x.startswith("\\"), F.coalesce(table[F.substring(x, 2, 1)], F.substring(x, 2, 1))).otherwise(x)), ""))
    return raw.select(*[F.when(F.get(parts, F.lit(i)) != "\\N", text(F.get(parts, F.lit(i)))).alias(c) for i, c in enumerate(columns)])


def timetable(spark: SparkSession, folder: str) -> DataFrame:
    """(trip, seq, stop, arrival, departure) of a stop_times file, times of day past midnight included, in seconds."""
    df = spark.read.option("header", True).csv(f"{folder}/stop_times.txt")
    secs = lambda c: F.aggregate(F.split(c, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long"))
    return df.select(F.col("trip_id").alias("trip"), F.col("stop_sequence").cast("int").alias("seq"), F.col("stop_id").alias("stop"), secs("arrival_time").alias("arrival"), secs("departure_time").alias("departure"))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, lat, lon, tags) of a JSON export of map elements."""
    schema = "elements array<struct<type string, id bigint, lat double, lon double, center struct<lat double, lon double>, tags map<string,string>>>"
    e = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("elements").alias("e"))
    return e.select("e.type", "e.id", F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), "e.tags")


def unpack_deltas(raw: bytes, scale: float = 1e5) -> np.ndarray:
    """Coordinates packed as little-endian 32-bit differences."""
    return np.cumsum(np.frombuffer(raw, dtype="<i4").astype(np.int64)) / scale


def pack_deltas(values: np.ndarray, scale: float = 1e5) -> bytes:
    whole = np.round(np.asarray(values) * scale).astype(np.int64)
    return np.diff(whole, prepend=0).astype("<i4").tobytes()


class SheetSource(DataSource):
    """``spark.read.format("sheet").option("path", ...)``: cells of spreadsheets, read with the standard library alone."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return "file string, sheet string, row int, cells array<string>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SheetReader(self.options)


class SheetReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        for sheet, number, cells in read_sheets(partition.value):
            yield partition.value.rsplit("/", 1)[-1], sheet, number, cells


def read_sheets(path: str):
    """(sheet, row number, cells) of each row of an .xlsx file."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(x.text or "" for x in si.iter(f"{ns}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in ET.fromstring(z.read(name)).iter(f"{ns}row"):
                cells: dict[int, str | None] = {}
                for c in row.iter(f"{ns}c"):
                    col = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", "")).group():
                        col = col * 26 + ord(ch) - 64
                    v = c.find(f"{ns}v")
                    text = "".join(x.text or "" for x in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                    cells[(col or len(cells) + 1) - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                yield name[14:-4], int(row.get("r", 0)), [cells.get(i) for i in range(max(cells, default=-1) + 1)]
