"""Sources that replay recorded answers of paged services, map extracts in XML, and snapshots kept while they don't change."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RecordedSource(DataSource):
    """``spark.read.format("recorded").option("path", folder).option("items", "a.b")``: answers of a paged service, replayed.

    A folder of a shared file system holds one ``*.json`` file for each answer; each branch (a subfolder) is a partition and its answers are
    read in the order of their names until one says ``"next": null``. Rows: (branch, page, item, hash); the hash is that of the item's canonical JSON.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "branch string, page int, item string, hash string"

    def reader(self, schema) -> DataSourceReader:
        return RecordedReader(self.options)


class RecordedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.items = options["path"], options.get("items", "items")

    def partitions(self):
        return [InputPartition(b) for b in sorted(os.listdir(self.path)) if os.path.isdir(os.path.join(self.path, b))] or [InputPartition("")]

    def read(self, partition):
        folder = os.path.join(self.path, partition.value)

        def fetch(page: int):
            names = sorted(n for n in os.listdir(folder) if n.endswith(".json"))
            if page > len(names):
                return None
            with open(os.path.join(folder, names[page - 1]), encoding="utf-8") as f:
                return json.load(f)

        for page, item in paged(fetch, self.items):
            yield partition.value, page, canonical(item), digest(item)


def paged(fetch: Callable[[int], dict | None], items: str) -> Iterator[tuple[int, object]]:
    """(page, item) of a service whose pages ``fetch`` gives, until a page is missing or names no next one.

    The function that fetches is handed in, so a client with a pause between calls and a replay serve alike.
    """
    page = 1
    while (answer := fetch(page)) is not None:
        found = answer
        for k in items.split("."):
            found = (found or {}).get(k)
        for item in found or []:
            yield page, item
        if "next" in answer and answer["next"] is None:
            return
        page += 1


def canonical(item: object) -> str:
    """JSON with sorted keys at every depth and no spaces."""
    return json.dumps(item, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def digest(item: object) -> str:
    return hashlib.sha256(canonical(item).encode()).hexdigest()


def changed_items(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state) of two reads with a ``hash``: ``new``, ``changed``, ``same`` or ``gone``; equal rows count once."""
    a, b = old.select(*keys, F.col("hash").alias("_a")).distinct(), new.select(*keys, F.col("hash").alias("_b")).distinct()
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def reused_snapshot(fetch: Callable[[str | None], tuple[int, str | None, str | None]], held: tuple[str, str] | None) -> tuple[str, str]:
    """(tag, body) of a remote snapshot: ``fetch(tag)`` gives (status, tag, body); status 304 keeps what is held."""
    status, tag, body = fetch(held[0] if held else None)
    if status == 304 and held:
        return held
    if status != 200 or body is None:
        raise OSError(f"the snapshot answered {status}")
    return tag or "", body


def map_extract(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """(type, id, lat, lon, nodes, members, tags) of map extracts in XML; with ``tags``, elements that bear one of them, and all nodes.

    A file is a task and is parsed as it streams by, so an element at a time is in memory; extracts of a large map come as many files.
    """
    want = set(tags or [])

    def read(batches):
        import pandas as pd

        cols = ["type", "id", "lat", "lon", "nodes", "members", "tags"]
        for pdf in batches:
            for name in pdf["path"]:
                rows = []
                for _, el in ET.iterparse(name.removeprefix("file:"), events=("end",)):
                    if el.tag not in ("node", "way", "relation"):
                        continue
                    own = {t.get("k"): t.get("v") for t in el.iter("tag")}
                    if not want or el.tag == "node" or want & set(own):
                        members = [{"type": m.get("type"), "ref": int(m.get("ref")), "role": m.get("role")} for m in el.iter("member")]
                        num = lambda c: float(el.get(c)) if el.get(c) else None  # noqa: B023, E731
                        rows.append((el.tag, int(el.get("id")), num("lat"), num("lon"), [int(n.get("ref")) for n in el.iter("nd")], members, own))
                    el.clear()
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=cols)
                        rows = []
                yield pd.DataFrame(rows, columns=cols)

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(read, "type string, id long, lat double, lon double, nodes array<long>, members array<struct<type string, ref bigint, role string>>, tags map<string, string>")


def road_rules(tags) -> tuple:
    """(km/h, open to cars) columns of a road's tags: what it says, else what its class allows; miles are converted."""
    said = F.lower(F.coalesce(tags["maxspeed"], F.lit("")))
    number = F.regexp_extract(said, r"^([0-9]+)", 1).try_cast("double")
    classes = {"motorway": 120, "trunk": 90, "primary": 70, "secondary": 60, "tertiary": 50, "residential": 40, "living_street": 20, "service": 20}
    table = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    usual = table[F.regexp_replace(F.coalesce(tags["highway"], F.lit("")), "_link$", "")].cast("double")
    speed = F.coalesce(F.when(said.contains("mph"), number * 1.609344).otherwise(number), usual)
    barred = F.coalesce(tags["access"].isin("no", "private"), F.lit(False)) & ~F.coalesce(tags["motor_vehicle"].isin("yes", "permissive"), F.lit(False))
    return F.round(speed, 1), usual.isNotNull() & ~barred & ~F.coalesce(tags["motor_vehicle"].isin("no", "private"), F.lit(False))
