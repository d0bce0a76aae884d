"""Incremental ingest (STM-3, STM-6) and, as an extension, a windowed pass-rate monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 200) -> DataFrame:
    """New Parquet files of a folder as a stream; a single file is the one file of its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(folder)


def keep_newest(stream: DataFrame, key: str, version: str, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Upserts every micro-batch by key into ``path/generation=<batch>/bucket=<hash of the key>``.

    A batch rewrites only the buckets that it touches, from their newest state before it, so one that is repeated after a
    failure overwrites its own generation: exactly once. States that no repetition can need are removed."""
    from swaplens.operators.migration import upsert

    own = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = {r[0] for r in batch.select(own).distinct().collect()}
        if not touched:
            return
        before = states(spark, path, number)
        known = [before[b][-1] for b in touched if b in before]
        old = spark.read.schema(batch.schema).parquet(*known) if known else batch.limit(0)
        upsert(old, batch, key, version).withColumn("bucket", own).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/generation={number}")
        fs, jvm = _files(spark, path)
        for bucket in touched & before.keys():
            for folder in before[bucket][:-1]:
                fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def states(spark: SparkSession, path: str, below: int | None = None) -> dict[int, list[str]]:
    """The folders of every bucket in complete generations (before ``below``), oldest first."""
    fs, jvm = _files(spark, path)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path)):
        return {}
    found: dict[int, list[str]] = {}
    names = sorted(((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if s.getPath().getName().startswith("generation=")), key=lambda x: x[0])
    for number, folder in names:
        if (below is None or number < below) and fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            for s in fs.listStatus(folder):
                if (name := s.getPath().getName()).startswith("bucket="):
                    found.setdefault(int(name.split("=")[1]), []).append(s.getPath().toString())
    return found


def newest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(*[folders[-1] for folders in states(spark, path).values()])


def record_once(stream: DataFrame, key: str, stamp: str, late: str = "1 day") -> DataFrame:
    """STM-3: the first arrival of each key; state older than ``late`` is forgotten."""
    return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark([key])


def pass_rate_windows(stream: DataFrame, stamp: str, passed: str, category: str, width: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """Extension: passes and rows per category in tumbling event-time windows. ``late`` is null if the stream
    has its watermark already."""
    marked = stream if late is None else stream.withWatermark(stamp, late)
    return (
        marked.groupBy(F.window(stamp, width).alias("w"), F.coalesce(F.col(category), F.lit("(uncategorized)")).alias("category"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(passed)).alias("passed"))
        .select(F.col("w.start").alias("window_start"), "category", "rows", "passed")
    )
