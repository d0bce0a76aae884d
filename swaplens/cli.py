"""Command line (CLI-1..10): ``migrate``, ``report``, ``import``, ``annotate``, ``profiles``. Exit codes: 0 well, 1 a strict gate failed, 2 wrong use."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swaplens import pipeline, report
from swaplens.operators import compare, decode, live, migration
from swaplens.sources import corpus, importers, snapshots
from swaplens.sources.tables import cut_lineage, ship_package


def session() -> SparkSession:
    return SparkSession.builder.appName("swaplens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def threshold(spec: str) -> tuple[str, float]:
    """``NAME=RATE``, split at the last equals sign."""
    name, _, rate = spec.rpartition("=")
    value = float(rate)
    if not name or not 0 <= value <= 1:
        raise ValueError(f"{spec}: a comparator and a rate from 0 to 1 are needed")
    return name, value


def _report_options(one: argparse.ArgumentParser) -> None:
    given = one.add_mutually_exclusive_group()
    given.add_argument("--corpus", default="corpus", help="folder of stored interactions")
    given.add_argument("--results", help="Parquet table of result rows, instead of a corpus")
    one.add_argument("--target", help="the candidate model")
    one.add_argument("--target-provider")
    one.add_argument("--compare", default="exact,fuzzy", help="comparators by commas, or all")
    one.add_argument("--judge-model", default=os.environ.get("SWAPLENS_JUDGE_MODEL"), help="whose recorded verdicts count as the judge comparator")
    one.add_argument("--judge-model-2", default=os.environ.get("SWAPLENS_JUDGE_MODEL_2"))
    one.add_argument("--fuzzy-threshold", type=float, default=0.8)
    one.add_argument("--max-tokens", type=int, default=4096)
    one.add_argument("--filter", help="part of the baseline id")
    one.add_argument("--concurrency", type=int, default=8, help="rows in flight")
    one.add_argument("--format", default="both", choices=("md", "html", "both"))
    one.add_argument("--out-dir", default="reports")
    one.add_argument("--out", help="base name of the files")
    one.add_argument("--max-detail-rows", type=int, default=25, help="0: all")
    one.add_argument("--min-pass", action="append", default=[], metavar="NAME=RATE")
    one.add_argument("--strict", action="store_true")
    one.add_argument("--pricing", action="append", default=[], metavar="PROFILE", help="profiles by commas or a+b, in order of preference")
    one.add_argument("--pricing-dir", action="append", default=[], metavar="DIR")
    one.add_argument("--pricing-as-of", default="latest", metavar="WHEN", help="latest, recorded or a date")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="swaplens")
    sub = top.add_subparsers(dest="command", required=True)
    for name, what in (("migrate", "ask the target what is not recorded, then report"), ("report", "report from recorded answers")):
        _report_options(sub.add_parser(name, help=what))
    two = sub.add_parser("import", help="add an export to a corpus; records that are there are replaced")
    two.add_argument("--input", required=True)
    two.add_argument("--corpus", default="corpus")
    two.add_argument("--source", default="auto", choices=("auto", *sorted(importers.PARSERS)))
    two.add_argument("--category")
    three = sub.add_parser("annotate")
    three.add_argument("--corpus", required=True)
    three.add_argument("--output", required=True)
    four = sub.add_parser("profiles", help="list the rate profiles of folders")
    four.add_argument("--pricing-dir", action="append", default=[], metavar="DIR")
    return top


def _judged(results: DataFrame, documents: DataFrame, models: list[str]) -> DataFrame:
    """The judge comparator over recorded verdicts: a missing one is an error (CMP-7..9)."""
    from swaplens.functions import identity, leaves

    @F.udf("struct<equivalent:boolean,score:double>", useArrow=True)
    def verdict(text: str | None):
        got = leaves.verdict_of(text or "")
        score = got.get("score") if got else None
        return None if got is None else (bool(got.get("equivalent")), float(score) if isinstance(score, (int, float)) and not isinstance(score, bool) else None)

    kept = decode.decode_captures(documents.where(F.col("id").startswith(identity.JUDGE))).select("id", verdict("decoded.text").alias("v")).where("v is not null").select("id", "v.*")
    rows = results.where("status = 'ok'")
    for k, model in enumerate(models):
        rows = migration.with_verdict(rows, kept, model, f"v{k}")
    return rows.select("row_id", "category", F.inline(F.array(migration.judge_result(F.array(*[f"v{k}" for k in range(len(models))])))))


def _rates(spark: SparkSession, args) -> DataFrame | None:
    wanted = [p for spec in args.pricing for p in spec.replace("+", ",").split(",") if p]
    if not wanted:
        return None
    if not args.pricing_dir:
        raise ValueError("--pricing needs --pricing-dir: no rates are built in")
    return snapshots.read_catalog(spark, args.pricing_dir, list(dict.fromkeys(wanted)))


def run_report(args, spark: SparkSession, client: live.Client | None = None) -> int:
    wanted = dict(threshold(t) for t in args.min_pass)
    labels = {e.label for e in compare.parse_spec(args.compare)} | ({"judge"} if args.judge_model else set())
    if unknown := wanted.keys() - labels:
        raise LookupError(f"not run: {', '.join(sorted(unknown))}")
    table, documents, notes = _rates(spark, args), None, []
    if args.results:
        results = spark.read.parquet(args.results)
        if args.filter:
            results = results.where(F.col("baseline_id").contains(args.filter))
    else:
        if not args.target:
            raise ValueError("--target is needed")
        pipeline.provider_for(args.target, args.target_provider)
        if not Path(args.corpus).is_dir():
            raise ValueError(f"no corpus {args.corpus}")
        documents = corpus.read_corpus(spark, args.corpus)
        notes = pipeline.warnings(documents)
        results = cut_lineage(pipeline.results(documents, args.target, args.target_provider, args.filter))
        if args.command == "migrate":
            results = _migrated(args, spark, results, client)
            documents = corpus.read_corpus(spark, args.corpus)
    compared = compare.run(results, args.compare, fuzzy_threshold=args.fuzzy_threshold)
    if args.judge_model and documents is not None:
        compared = compared.unionByName(_judged(results, documents, list(dict.fromkeys(filter(None, (args.judge_model, args.judge_model_2))))))
    compared = cut_lineage(compared)
    costs = pipeline.priced(results, table, args.pricing_as_of) if table is not None else None
    parts = report.tables(results, wanted, args.max_detail_rows, compared, costs)
    if notes:
        parts.insert(0, report.Table("Warnings", ["warning"], [(n,) for n in notes]))
    formats = ("md", "html") if args.format == "both" else (args.format,)
    name = args.out or report.default_name(args.target or "results")
    for path in report.write(args.out_dir, name, "Model swap report", parts, formats, report.entries(results, compared, args.max_detail_rows)):
        print(path)
    print(report.console("Model swap report", [t for t in parts if t.title not in ("Details", "Left over")]))
    gates = migration.gates(spark.createDataFrame(list(wanted.items()), "comparator string, least double"), migration.comparator_aggregate(compared)) if wanted else None
    held = migration.verdict(results, compared, gates).first().strict_passed
    return 1 if args.strict and not held else 0


def _migrated(args, spark: SparkSession, results: DataFrame, client: live.Client | None) -> DataFrame:
    """Asks for what is not recorded, keeps the answers in the corpus, and reads it again; says what came of each row (STM-7)."""
    name = pipeline.provider_for(args.target, args.target_provider)
    missing = results.repartition(max(1, args.concurrency))
    answers = cut_lineage(pipeline.ask_missing(missing, args.target, client or live.http_client(name), name, args.max_tokens))
    for r in answers.groupBy(F.coalesce("status", F.lit("skipped")).alias("status")).count().orderBy("status").collect():
        print(f"asked: {r['count']} {r.status}", file=sys.stderr)
    corpus.write_documents(pipeline.target_documents(answers), args.corpus).count()
    again = pipeline.results(corpus.read_corpus(spark, args.corpus), args.target, args.target_provider, args.filter)
    return cut_lineage(pipeline.failed(again, answers))


def run_import(args, spark: SparkSession) -> int:
    records = corpus.read_export(spark, args.input)
    imported, skipped = importers.import_records(records, "record", None if args.source == "auto" else args.source, args.category)
    kept = corpus.write_documents(importers.documents(imported), args.corpus).count()
    reasons = skipped.groupBy("skip_reason").count().orderBy(F.desc("count"), "skip_reason").limit(10).collect()
    print(f"imported {kept} into {args.corpus} ({skipped.count()} skipped)")
    for r in reasons:
        print(f"skipped {r['count']}: {r.skip_reason}", file=sys.stderr)
    return 0


def run_annotate(args, spark: SparkSession) -> int:
    table = decode.decode_captures(corpus.read_corpus(spark, args.corpus))
    stamped = corpus.annotate(table.withColumn("computed_key", F.col("asked.semantic_key")).withColumn("computed_provider", F.col("provider")))
    stamped.drop("payload", "decoded", "asked", "computed_key", "computed_provider").write.mode("overwrite").partitionBy("kind").parquet(args.output)
    return 0


def run_profiles(args, spark: SparkSession) -> int:
    listed = snapshots.profiles(args.pricing_dir)
    for name, currency, dates in listed:
        print(f"{name} ({currency}): {', '.join(dates)}")
    if not listed:
        print("no rate profiles")
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        spark = session()
        ship_package(spark)
        return {"migrate": run_report, "report": run_report, "import": run_import, "annotate": run_annotate, "profiles": run_profiles}[args.command](args, spark)
    except (ValueError, LookupError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
