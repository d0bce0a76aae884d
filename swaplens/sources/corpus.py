"""The corpus of stored interactions (SRC-1..6, SINK-1..3): JSON documents in, a Parquet table kept by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swaplens.functions import identity
from swaplens.operators.migration import discard, upsert

_S = T.StringType()
#: An interaction document; open fields stay JSON text, headers keep order and doubles.
DOCUMENT = T.StructType([
    T.StructField("metadata", _S),
    T.StructField("request", T.StructType([T.StructField("method", _S), T.StructField("url", _S), T.StructField("headers", T.ArrayType(T.ArrayType(_S))), T.StructField("content", _S)])),
    T.StructField("response_status", T.IntegerType()),
    T.StructField("response_headers", T.ArrayType(T.ArrayType(_S))),
    T.StructField("response_extensions", _S),
    T.StructField("chunks", T.ArrayType(T.StructType([T.StructField("data", _S), T.StructField("timestamp_offset", T.DoubleType())]))),
])
META = ("provider", "model", "semantic_key", "recorded_at", "category", "migrated_from", "baseline_model", "judge_model", "judge_key")


def _pairs(column: str):
    return F.transform(F.col(column), lambda h: F.struct(h[0].alias("name"), h[1].alias("value")))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``*.json`` document of a folder; the id is the file's stem."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    kind = F.when(F.col("id").startswith(identity.MIGRATION), "target").when(F.col("id").startswith(identity.JUDGE), "verdict").when(F.col("id").startswith(identity.IMPORTED), "imported").otherwise("recorded")
    meta = [F.get_json_object("metadata", f"$.{m}").alias(m) for m in META]
    version = F.get_json_object("metadata", "$.semantic_key_version").try_cast("int").alias("semantic_key_version")
    latency = [F.get_json_object("metadata", f"$.{m}").try_cast("double").alias(m) for m in ("latency_s", "latency_first_chunk_s")]
    flat = raw.select(name.alias("id"), *meta, version, *latency, "metadata", F.col("request.method").alias("method"), F.col("request.url").alias("url"), _pairs("request.headers").alias("request_headers"), F.col("request.content").alias("request_content"), "response_status", _pairs("response_headers").alias("response_headers"), "response_extensions", F.to_json("chunks").alias("chunks"))
    return flat.withColumn("kind", kind)


def write_documents(df: DataFrame, folder: str, document: str = "document") -> DataFrame:
    """Writes ``id, document`` rows as one JSON file each, whole or not at all (a temporary file is renamed); ``folder`` is one that all
    executors share. Gives the ids written; nothing is written until it is read."""

    def per_task(batches):
        import os
        import uuid
        from pathlib import Path

        import pyarrow as pa

        root = Path(folder)
        root.mkdir(parents=True, exist_ok=True)
        for batch in batches:
            for stem, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                draft = root / f".{uuid.uuid4().hex}.tmp"
                draft.write_text(text, encoding="utf-8")
                os.replace(draft, root / f"{stem}.json")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["id"])

    return df.select("id", identity.file_stem(F.col("id")).alias("stem"), document).mapInArrow(per_task, "id string")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The Parquet copy, partitioned by kind so that scans of baselines prune the rest."""
    df.write.mode(mode).partitionBy("kind").parquet(path)


def merge_into(spark: SparkSession, path: str, incoming: DataFrame, version: str = "recorded_at") -> DataFrame:
    """Existing rows of a table with ``incoming`` upserted by id (the caller writes the result to a new path)."""
    return upsert(spark.read.parquet(path), incoming, "id", version)


def without(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    return discard(spark.read.parquet(path), ids, "id")


def annotate(df: DataFrame, computed_key: str = "computed_key", computed_provider: str = "computed_provider") -> DataFrame:
    """MNT-1: fill what is missing; stamp the key's version only where the pinned key is absent or equal."""
    sure = F.col("semantic_key").isNull() | (F.col("semantic_key") == F.col(computed_key))
    return df.withColumn("semantic_key_version", F.when(sure, F.lit(identity.KEY_VERSION)).otherwise(F.col("semantic_key_version"))).withColumn("semantic_key", F.coalesce("semantic_key", computed_key)).withColumn("provider", F.coalesce("provider", computed_provider))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5/6: the records of export files as JSON text: ``path, pos, record``.

    A ``.jsonl`` file, or one that does not begin with a bracket, has a record a line; other files hold one document, whose
    container (a list, ``resourceSpans``, ``data`` and the like) is unwrapped."""
    from swaplens.sources.importers import records_of

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def unwrap(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(p, k, r) for p, t in zip(*[c.to_pylist() for c in batch.columns], strict=True) for k, r in enumerate(records_of(p, t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["path", "pos", "record"])

    return files.mapInArrow(unwrap, "path string, pos int, record string")
