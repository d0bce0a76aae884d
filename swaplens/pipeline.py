"""From a corpus to a report: newest baseline per prompt, its recorded (or asked) target, one result row each.

``results`` is a plan over decoded interactions; ``ask_missing`` sends the rows without a recorded answer through an injected
client; ``priced`` adds both sides' costs from dated rates. Everything but the client's calls is declarative; rows are
never gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swaplens.functions import dialects, identity, text
from swaplens.operators import decode, live, migration, rates

OFFLINE = "no recorded target answer; run migrate first"
MESSAGES = "struct<system:string,messages:array<struct<role:string,content:string>>,temperature:double,parallel_tool_calls:boolean,tools:array<struct<strict:boolean>>>"


def provider_for(model: str, given: str | None = None) -> str:
    """The dialect of a model, given or by its name."""
    name = given or identity.provider_of_name(model)
    if name not in dialects.DIALECTS:
        raise ValueError(f"no provider for {model}; there are {', '.join(sorted(dialects.DIALECTS))}")
    return name


def _side(decoded: DataFrame, prefix: str) -> DataFrame:
    """The columns of one side of a result row, under their names."""
    usage = decode.normalize_usage(F.col("provider"), F.col("decoded.usage"))
    return decoded.withColumn("u", usage).select(
        F.col("id").alias(f"{prefix}_key"),
        F.col("decoded.text").alias(f"{prefix}_text"),
        F.col("decoded.tool_calls").alias(f"{prefix}_tool_calls"),
        F.coalesce("decoded.model", "model").alias(f"{prefix}_model"),
        F.col("u.prompt_total").alias(f"{prefix}_in_tokens"),
        F.col("u.output").alias(f"{prefix}_out_tokens"),
        *[F.col(f"u.{b}").alias(f"{prefix}_{b}") for b in rates.BUCKETS],
        F.col("recorded_at").alias(f"{prefix}_recorded_at"),
        F.col("latency_s").alias(f"{prefix}_latency_s"),
        F.col("latency_first_chunk_s").alias(f"{prefix}_latency_first_chunk_s"),
        F.col("decode_error").alias(f"{prefix}_error"),
    )


def _prompt(conversation: Column) -> tuple[Column, Column]:
    """(whole prompt with roles, preview of the last user turn)."""
    c = F.from_json(conversation, MESSAGES)
    turns = F.concat(F.when(c["system"].isNotNull(), F.array(F.concat(F.lit("[system] "), c["system"]))).otherwise(F.array().cast("array<string>")), F.transform(c["messages"], lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), F.coalesce(m["content"], F.lit("")))))
    said = F.filter(c["messages"], lambda m: (m["role"] == "user") & (m["content"] != ""))
    return F.array_join(turns, "\n\n"), text.preview(F.try_element_at(said, F.lit(-1))["content"])


def results(corpus: DataFrame, model: str, provider: str | None = None, contains: str | None = None) -> DataFrame:
    """One row per logical prompt, by the key that this release computes (a pinned key is only provenance): the newest recording with the
    recorded answer of ``model``. ``corpus`` is what ``sources.corpus.read_corpus`` gives.

    Status: ``skipped`` where the baseline cannot be read or no target is recorded, ``error`` where the target cannot be read, else ``ok``."""
    name = provider_for(model, provider)
    decoded = decode.decode_captures(corpus)
    base = migration.baselines(decoded, "id", contains).withColumn("key", F.col("asked.semantic_key"))
    newest = migration.newest_per_key(base.select("id", "key", "recorded_at"), "key", "recorded_at", "id").select("id", "recordings")
    chosen = base.join(newest, "id")
    prompt, preview = _prompt(F.col("asked.conversation"))
    left = _side(chosen, "baseline").join(chosen.select(F.col("id").alias("baseline_id"), F.col("key").alias("semantic_key"), F.nullif("category", F.lit("")).alias("category"), "recordings", F.col("provider").alias("baseline_provider"), F.col("asked.error").alias("request_error"), F.col("asked.conversation").alias("conversation"), prompt.alias("prompt_text"), preview.alias("prompt_preview")), F.col("baseline_key") == F.col("baseline_id")).drop("baseline_key")
    targets = _side(decoded.where(F.col("id").startswith(identity.MIGRATION)), "target").withColumn("cached", F.lit(True))
    rows = left.withColumn("migration_id", identity.migration_id(F.col("baseline_id"), F.lit(model))).join(targets, F.col("migration_id") == F.col("target_key"), "left").drop("target_key")
    unread = F.when(F.col("baseline_error").isNotNull(), F.concat(F.lit("baseline undecodable: "), "baseline_error")).when(F.col("request_error").isNotNull(), F.concat(F.lit("unsupported request: "), "request_error"))
    status = F.when(unread.isNotNull() | F.col("cached").isNull(), "skipped").when(F.col("target_error").isNotNull(), "error").otherwise("ok")
    reason = F.coalesce(unread, F.when(F.col("cached").isNull(), OFFLINE), F.when(F.col("target_error").isNotNull(), F.concat(F.lit("recorded target undecodable: "), "target_error", F.lit("; delete "), "migration_id", F.lit(" to record it anew"))))
    c = F.from_json("conversation", MESSAGES)
    gaps = migration.gap_notes(F.col("baseline_provider"), F.lit(name), c["temperature"], c["parallel_tool_calls"], F.coalesce(F.exists(c["tools"], lambda t: t["strict"]), F.lit(False)))
    older = F.when(F.col("recordings") > 1, F.array(F.format_string("%d older recordings of this prompt ignored", F.col("recordings") - 1))).otherwise(F.array().cast("array<string>"))
    out = rows.withColumns({"status": status, "reason": reason, "notes": F.concat(older, F.coalesce(gaps, F.array().cast("array<string>"))), "cached": F.coalesce("cached", F.lit(False)), "target_model": F.coalesce("target_model", F.lit(model))})
    return out.withColumn("row_id", F.xxhash64("baseline_id")).drop("baseline_error", "target_error", "request_error", "recordings")


def warnings(corpus: DataFrame) -> list[str]:
    """AGG-14: versions of the key algorithm other than this release's; at most some."""
    found = migration.baselines(corpus, "id").where(F.col("semantic_key_version") != identity.KEY_VERSION).select("semantic_key_version").distinct().orderBy("semantic_key_version").limit(20).collect()
    return [f"recorded under key version {r[0]}, grouped under version {identity.KEY_VERSION}; annotate the corpus to silence this" for r in found]


def ask_missing(rows: DataFrame, model: str, client: live.Client, provider: str | None = None, max_tokens: int = 4096, retries: int = 3) -> DataFrame:
    """The answers of ``live.ask`` for rows that only lack a target, with ``migration_id``, ``baseline_id`` and the request."""
    name = provider_for(model, provider)
    missing = rows.where((F.col("status") == "skipped") & (F.col("reason") == OFFLINE))
    built = missing.select("row_id", "migration_id", "baseline_id", "baseline_model", "semantic_key", decode.translate(F.col("conversation"), name, model, max_tokens).alias("r")).select("*", F.col("r.url").alias("url"), F.col("r.body").alias("body"), F.col("r.error").alias("untranslatable")).drop("r")
    asked = live.ask(built.where("untranslatable is null"), client, name, retries).withColumnRenamed("text", "answer")
    return built.join(asked, "row_id", "left").withColumn("target_model", F.lit(model)).withColumn("target_provider", F.lit(name))


def target_documents(answers: DataFrame, recorded_at: Column | None = None) -> DataFrame:
    """``id, document``: the answered rows as stored interactions."""
    at = recorded_at if recorded_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    meta = F.struct(F.col("target_provider").alias("provider"), F.col("target_model").alias("model"), "semantic_key", F.lit(identity.KEY_VERSION).alias("semantic_key_version"), at.alias("recorded_at"), F.col("baseline_id").alias("migrated_from"), "baseline_model", "latency_s")
    request = F.struct(F.lit("POST").alias("method"), "url", F.array().cast("array<array<string>>").alias("headers"), F.col("body").alias("content"))
    chunk = F.array(F.struct(F.col("payload").alias("data"), F.col("latency_s").alias("timestamp_offset")))
    document = F.to_json(F.struct(meta.alias("metadata"), request.alias("request"), F.lit(200).alias("response_status"), F.array(F.array(F.lit("content-type"), F.lit("application/json"))).alias("response_headers"), chunk.alias("chunks")))
    return answers.where("status = 'ok'").select(F.col("migration_id").alias("id"), document.alias("document"))


def failed(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """``rows`` with the reasons of calls that failed and of requests that the target cannot represent."""
    bad = answers.where("coalesce(status, 'error') <> 'ok'").select(F.col("row_id").alias("__row"), F.when(F.col("untranslatable").isNotNull(), "skipped").otherwise("error").alias("__status"), F.coalesce(F.concat(F.lit("target cannot represent request: "), F.col("untranslatable")), F.concat(F.lit("target call failed: "), F.col("reason"))).alias("__reason"))
    out = rows.join(bad, F.col("row_id") == F.col("__row"), "left")
    return out.withColumn("status", F.coalesce("__status", "status")).withColumn("reason", F.coalesce("__reason", "reason")).drop("__row", "__status", "__reason")


def priced(rows: DataFrame, table: DataFrame, policy: str = "latest") -> DataFrame:
    """JOIN-6, JOIN-7, PRC-3: ``row_id, side, profile, snapshot, cost, unpriced``. The first profile that knows a side's model counts;
    ``policy`` is ``latest``, ``recorded`` or a date.

    Rates are resolved for the distinct days and models only, whose number is that of a calendar, and met in one join."""
    sides = [rows.where("status = 'ok'").select("row_id", F.lit(s).alias("side"), F.col(f"{s}_model").alias("model"), F.col(f"{s}_recorded_at").alias("at"), *[F.col(f"{s}_{b}").alias(b) for b in rates.BUCKETS]) for s in ("baseline", "target")]
    both = sides[0].unionByName(sides[1])
    day = {"latest": F.lit(None).cast("date"), "recorded": F.to_date(F.substring("at", 1, 10))}.get(policy)
    dated = both.withColumn("day", day if day is not None else F.lit(policy).cast("date"))
    known = rates.as_of(dated.select("model", "day").distinct(), "day", rates.intervals(table))
    found = known.join(rates.resolve(known, table), ["model", "profile", "snapshot"])
    first = found.groupBy("model", "day").agg(F.min_by(F.struct("profile", "snapshot", *[f"r_{b}" for b in rates.BUCKETS]), "profile_ord").alias("x")).select(F.col("model").alias("__model"), F.col("day").alias("__day"), "x.*")
    joined = dated.join(first, (F.col("model") == F.col("__model")) & F.col("day").eqNullSafe(F.col("__day")), "left")
    amount, missing = rates.cost()
    return joined.select("row_id", "side", "profile", "snapshot", F.when(F.col("profile").isNotNull(), amount).alias("cost"), F.when(F.col("profile").isNull(), "no rate").otherwise(F.nullif(F.array_join(missing, ","), F.lit(""))).alias("unpriced"))


def cost_totals(costs: DataFrame) -> DataFrame:
    """AGG-8, FLT-8: sums over rows whose two sides are fully priced, with their ratio, and how many rows are not."""
    per_row = costs.groupBy("row_id").agg(*[F.max(F.when((F.col("side") == s) & F.col("unpriced").isNull(), F.col("cost"))).alias(s) for s in ("baseline", "target")])
    whole = F.col("baseline").isNotNull() & F.col("target").isNotNull()
    out = per_row.agg(F.count_if(whole).alias("rows"), F.count_if(~whole).alias("incomplete"), *[F.sum(F.when(whole, F.col(s))).cast("decimal(38,12)").alias(f"{s}_cost") for s in ("baseline", "target")])
    return out.withColumn("ratio", (F.col("target_cost").cast("double") / F.nullif(F.col("baseline_cost").cast("double"), F.lit(0.0))))


def snapshots_used(costs: DataFrame) -> DataFrame:
    """AGG-9: which snapshots priced how many sides."""
    return costs.where("profile is not null").groupBy("profile", "snapshot").agg(F.count(F.lit(1)).alias("sides"))
