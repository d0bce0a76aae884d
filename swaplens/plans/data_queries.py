"""Registered queries of the core operators for pipeline problems (timestamps, nesting, drift)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swaplens.operators import nested, schema_drift, timestamps
from swaplens.sources.tables import cut_lineage, read_table, spread

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_table(spark, sf_dir, "imported_records").select("import_id", "exporter", "recorded_at", "loaded_at")
    sources = read_table(spark, sf_dir, "export_sources").select("exporter", "zone", "date_order")
    found = timestamps.normalise_timestamps(records, "recorded_at", sources, "exporter", "loaded_at", out="recorded_us")
    return found.where("recorded_us is not null").select("import_id", "recorded_us")


def p3_zone_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per exporter, the zone of all that its own records suggest when none is declared, beside the declared one."""
    records = read_table(spark, sf_dir, "imported_records").select("exporter", "recorded_at", "loaded_at")
    sources = read_table(spark, sf_dir, "export_sources").select("exporter", "zone", "date_order")
    parsed = timestamps.parse_instants(records.join(sources, "exporter", "left"), "recorded_at", "date_order")
    local = parsed.where("ts_offset_min is null and ts_named_zone is null")
    got = timestamps.estimate_zones(local, "exporter", "ts_wall_us", "loaded_at")
    return got.join(sources, "exporter", "left").select("exporter", "zone", "est_zone", "violations", "zone_less_rows")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = spread(read_table(spark, sf_dir, "captured_interactions").select("capture_id", "chunks", "metadata"))
    imports = read_table(spark, sf_dir, "imported_records").select("import_id", F.to_json("messages").alias("messages"), "response_tool_calls")
    a = nested.children(captures, "capture_id", {"chunks": {"chunk": "$"}, "metadata": {"retry": "retries", "link": "trace.links"}})
    b = nested.children(spread(imports), "import_id", {"messages": {"message": "$", "message_tool_call": "tool_calls"}, "response_tool_calls": {"response_tool_call": "$"}})
    return a.unionByName(b)


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flat tables of the four nested columns with inlined columns, keys and foreign keys, stacked."""
    captures = spread(read_table(spark, sf_dir, "captured_interactions").select("capture_id", "chunks", "metadata"))
    imports = spread(read_table(spark, sf_dir, "imported_records").select("import_id", F.to_json("messages").alias("messages"), "response_tool_calls"))
    parts = []
    for df, key, columns in ((captures, "capture_id", ["chunks", "metadata"]), (imports, "import_id", ["messages", "response_tool_calls"])):
        graphs = nested.schema_graphs(df, {c: [] for c in columns})
        parts.append(nested.shred(df, key, {c: nested.compile_tables(graphs[c]) for c in columns}))
    return parts[0].unionByName(parts[1]).withColumn("columns", F.to_json("columns"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = spread(read_table(spark, sf_dir, "captured_interactions").select("writer", "file_no", "metadata"))
    prints = spread(read_table(spark, sf_dir, "fingerprints").select("writer", "file_no", "as_metadata"))
    a = schema_drift.field_profiles(captures, "metadata", "metadata")
    return cut_lineage(a.unionByName(schema_drift.field_profiles(prints, "as_metadata", "as_metadata")))  # of schema size, and used thrice


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.drift_report(_profiles(spark, sf_dir))


def p7_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of captured_interactions.metadata and of fingerprints.as_metadata under one canonical schema each."""
    names = cut_lineage(schema_drift.canonical_names(cut_lineage(schema_drift.drift_report(_profiles(spark, sf_dir)))))
    captures = spread(read_table(spark, sf_dir, "captured_interactions").select("capture_id", "metadata"))
    prints = spread(read_table(spark, sf_dir, "fingerprints").select("fingerprint_id", "as_metadata"))
    a = schema_drift.consistent_table(captures, "metadata", "capture_id", "metadata", names).withColumn("record", F.lit("metadata"))
    b = schema_drift.consistent_table(prints, "as_metadata", "fingerprint_id", "as_metadata", names).withColumn("record", F.lit("as_metadata"))
    return a.unionByName(b).withColumn("fields", F.to_json("fields"))


QUERIES: dict[str, Query] = {
    "p3_found": p3_found,
    "p3_zone_estimates": p3_zone_estimates,
    "p5_found": p5_found,
    "p5_tables": p5_tables,
    "p7_found": p7_found,
    "p7_consistent": p7_consistent,
}

ORACLES: dict[str, str] = {
    "p5_found": """
    WITH doc AS (
        SELECT 'chunk' AS child, capture_id AS parent_id, CASE WHEN json_valid(chunks) THEN chunks END AS j FROM captured_interactions
        UNION ALL SELECT 'response_tool_call', import_id, CASE WHEN json_valid(response_tool_calls) THEN response_tool_calls END FROM imported_records
        UNION ALL SELECT unnest(['retry', 'link']), capture_id, unnest([json_extract(m, '$.retries'), json_extract(m, '$.trace.links')])
            FROM (SELECT capture_id, CASE WHEN json_valid(metadata) THEN CASE WHEN json_type(metadata) = 'VARCHAR' AND json_valid(json_extract_string(metadata, '$')) THEN json_extract_string(metadata, '$') ELSE metadata END END AS m FROM captured_interactions)),
    plain AS (SELECT child, parent_id, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(json_extract_string(j, '$')) THEN CAST(json_extract_string(j, '$') AS JSON) ELSE CAST(j AS JSON) END AS j FROM doc),
    items AS (SELECT child, parent_id, CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'OBJECT' THEN [j] ELSE [] END AS e FROM plain WHERE j IS NOT NULL),
    kids AS (SELECT child, parent_id, -1 AS parent_pos, unnest(e) AS x, unnest(range(len(e))) AS pos FROM items),
    msg AS (SELECT import_id, unnest(messages) AS m, unnest(range(len(messages))) AS k FROM imported_records),
    calls AS (SELECT import_id, k, unnest(m.tool_calls) AS c, unnest(range(len(m.tool_calls))) AS pos FROM msg WHERE m IS NOT NULL)
    SELECT child, parent_id, CAST(parent_pos AS INT) AS parent_pos, CAST(pos AS INT) AS pos FROM kids WHERE json_type(x) = 'OBJECT'
    UNION ALL SELECT 'message', import_id, -1, CAST(k AS INT) FROM msg WHERE m IS NOT NULL
    UNION ALL SELECT 'message_tool_call', import_id, CAST(k AS INT), CAST(pos AS INT) FROM calls WHERE c IS NOT NULL""",
}
