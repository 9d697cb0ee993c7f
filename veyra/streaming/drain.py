"""Running a streaming query over all that is there, into a table that survives retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veyra.session import scratch


def open_files(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """A folder or file of Parquet as a stream, with its own schema."""
    schema = spark.read.parquet(path).schema
    # as a pattern the path may be a single file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """All results of a stream as a table; in update mode the newest row of each key.

    Each batch overwrites its own folder, so a batch that is run again after a failure leaves one copy.
    """
    spark = stream.sparkSession
    base = scratch(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/out")
    if keys:
        values = [c for c in stream.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")
        return out.select(*stream.columns)
    if mode == "complete":
        return out.filter(F.col("batch") == out.agg(F.max("batch")).scalar()).drop("batch")
    return out.drop("batch")
