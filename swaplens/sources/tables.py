"""Reading tables, shipping the package to executors, and cutting lineage safely."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of files) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="ship")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*")):
            if path.is_file() and path.suffix in (".py", ".json"):
                out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of its own only in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="swaplens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _prepare_checkpoints(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of spark.checkpoint.dir; survives lost executors."""
    _prepare_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, by: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, in one folder per value of ``by``; compressed, and read by columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, factor: int = 1) -> DataFrame:
    """Row-wise work spread over the cluster when the input has fewer splits than cores.

    A scan of a single small file is one task; the repartition is skipped as soon as the files
    alone give enough splits, so that at scale no shuffle is added.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * factor
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= want else df.repartition(want)
