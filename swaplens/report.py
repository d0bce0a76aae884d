"""The report (RND-1..5, AGG-9, SINK-4): a few bounded tables, collected once and rendered as Markdown, HTML or plain text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaplens.functions import text
from swaplens.operators import migration

#: Most rows of a summary table; its size is that of the comparators and categories, not of the data.
TABLE_ROWS = 2_000


@dataclass
class Table:
    title: str
    columns: list[str]
    rows: list[tuple] = field(default_factory=list)

    @classmethod
    def of(cls, title: str, df: DataFrame, order: list[str] | None = None) -> Table:
        kept = df.orderBy(*order) if order else df
        rows = [tuple(r) for r in kept.limit(TABLE_ROWS + 1).collect()]
        if len(rows) > TABLE_ROWS:
            raise ValueError(f"{title}: more than {TABLE_ROWS} rows are no summary")
        return cls(title, df.columns, rows)


def cell(value) -> str:
    if value is None:
        return "–"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    return f"{value:.4g}" if isinstance(value, float) else str(value)


def money(amount, currency: str = "USD") -> str:
    """Exact amounts with six places, trailing zeros cut to two."""
    from decimal import ROUND_HALF_EVEN, Decimal

    if amount is None:
        return "?"
    whole, _, places = f"{Decimal(amount).quantize(Decimal('0.000001'), ROUND_HALF_EVEN):,f}".partition(".")
    places = places.rstrip("0").ljust(2, "0")
    return f"${whole}.{places}" if currency == "USD" else f"{whole}.{places} {currency}"


def comparisons(results: DataFrame) -> DataFrame:
    """Long form of the exact and fuzzy comparisons of the ok rows of a result table; a row without a text is an errored comparison."""
    a, b = F.col("baseline_text"), F.col("target_text")
    whole = a.isNotNull() & b.isNotNull()
    empty = lambda name: migration.result(name, F.lit(0.0), F.lit(None), error=F.lit("no text to compare"))
    both = F.array(F.when(whole, migration.exact(a, b)).otherwise(empty("exact")), F.when(whole, migration.fuzzy(a, b)).otherwise(empty("fuzzy")))
    return results.where("status = 'ok'").select("row_id", "category", F.inline(both))


@dataclass
class Entry:
    """A row of the details, with its texts."""

    number: int
    heading: str
    texts: list[tuple[str, str]]
    notes: list[str] = field(default_factory=list)


def tables(results: DataFrame, thresholds: dict[str, float] | None = None, details: int = 25, compared: DataFrame | None = None, costs: DataFrame | None = None) -> list[Table]:
    """All tables of the report over a result table; ``compared`` is the long form of ``compare.run`` (default: exact and fuzzy),
    ``costs`` that of ``pipeline.priced``."""
    spark = results.sparkSession
    compared = comparisons(results) if compared is None else compared
    totals = migration.comparator_aggregate(compared)
    out = [
        Table.of("Rows", results.groupBy("status", "cached").agg(F.count(F.lit(1)).alias("rows")), ["status", "cached"]),
        Table.of("Comparators", totals, ["comparator"]),
        Table.of("Categories", migration.comparator_aggregate(migration.categories(compared), ["category"]), ["category", "comparator"]),
        Table.of("Tokens", migration.token_totals(results.where("status = 'ok'"), "baseline_out_tokens", "target_out_tokens")),
        Table.of("Latency", migration.latency_stats(results.where("status = 'ok'"), "baseline_latency_s", "target_latency_s", "baseline_latency_first_chunk_s", "target_latency_first_chunk_s")),
    ]
    if costs is not None:
        from swaplens import pipeline

        total = Table.of("Estimated cost", pipeline.cost_totals(costs))
        total.rows = [(n, open_, money(a), money(b), r) for n, open_, a, b, r in total.rows]
        out += [total, Table.of("Rates used", pipeline.snapshots_used(costs), ["profile", "snapshot"])]
    if thresholds:
        wanted = spark.createDataFrame(list(thresholds.items()), "comparator string, least double")
        out.append(Table.of("Gates", migration.gates(wanted, totals), ["comparator"]))
    worst = worst_rows(compared, details).select("row_id", "failing", "mean_score")
    shown = worst.join(results.select("row_id", text.preview(F.col("prompt_text")).alias("prompt")), "row_id").orderBy(F.desc("failing"), "mean_score", "row_id")
    left = results.where("status <> 'ok'").groupBy("status", "reason").agg(F.count(F.lit(1)).alias("rows"))
    return [*out, Table.of("Details", shown), Table.of("Left over", left, ["status", "reason"])]


def worst_rows(compared: DataFrame, details: int) -> DataFrame:
    per_row = compared.groupBy("row_id").agg(F.collect_list(F.struct("comparator", "score", "passed", "detail", "error")).alias("all"))
    return migration.detail_rows(per_row, "all", "row_id", details)


def entries(results: DataFrame, compared: DataFrame, details: int = 25) -> list[Entry]:
    """The rows of the details with their texts, numbered by baseline id over all results (WIN-3); ``details`` of 0 is all rows, which
    a report of many rows should not ask for."""
    worst = worst_rows(compared, details)
    shown = [r.row_id for r in worst.select("row_id").collect()]
    mine = results.where(F.col("row_id").isin(shown)).select("row_id", "baseline_id", "prompt_text", "baseline_text", "target_text", F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))
    before = mine.select(F.col("row_id").alias("r"), F.col("baseline_id").alias("b")).join(results.select(F.col("baseline_id").alias("o")), F.col("o") < F.col("b")).groupBy("r").agg((F.count(F.lit(1)) + 1).alias("number"))
    rows = {r.row_id: r for r in mine.join(F.broadcast(before), F.col("row_id") == F.col("r"), "left").join(worst.select("row_id", "all"), "row_id").collect()}
    out = []
    for key in shown:
        if (r := rows.get(key)) is None:
            continue
        notes = [f"{c.comparator}: {c.error or c.detail}" for c in sorted(r["all"], key=lambda c: c.comparator) if c.error or c.detail]
        out.append(Entry(r.number or 1, r.baseline_id or "", [("Prompt", r.prompt_text or ""), ("Baseline", r.baseline_text or ""), ("Target", r.target_text or "")], [*r.notes, *notes]))
    return out


def fence(body: str) -> str:
    """A code block whose fence is longer than any run of backticks inside."""
    marks = "`" * max(3, 1 + max(map(len, re.findall("`+", body)), default=0))
    return f"{marks}\n{body}\n{marks}"


def default_name(target: str, now: datetime | None = None) -> str:
    """DT-4: the base name of a report's files."""
    return f"migration-report__{re.sub('[^A-Za-z0-9._-]', '_', target)}__{(now or datetime.now(UTC)):%Y%m%d-%H%M%S}"


def markdown(title: str, parts: list[Table], rows: list[Entry] = ()) -> str:
    escape = lambda v: cell(v).replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}"]
    for t in parts:
        out += ["", f"## {t.title}", "", "| " + " | ".join(t.columns) + " |", "|" + " --- |" * len(t.columns)]
        out += ["| " + " | ".join(map(escape, r)) + " |" for r in t.rows]
    for e in rows:
        out += ["", f"### Row {e.number}: {escape(e.heading)}", *[f"- {escape(n)}" for n in e.notes]]
        for name, body in e.texts:
            out += ["", f"**{name}**", "", fence(body)]
    return "\n".join(out) + "\n"


def page(title: str, parts: list[Table], rows: list[Entry] = ()) -> str:
    """One HTML page without scripts; every value is escaped."""
    body = []
    for t in parts:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in t.columns)
        lines = "".join("<tr>" + "".join(f"<td>{html.escape(cell(v))}</td>" for v in r) + "</tr>" for r in t.rows)
        body.append(f"<h2>{html.escape(t.title)}</h2><table><tr>{head}</tr>{lines}</table>")
    for e in rows:
        notes = "".join(f"<li>{html.escape(n)}</li>" for n in e.notes)
        texts = "".join(f"<h4>{html.escape(n)}</h4><pre>{html.escape(b)}</pre>" for n, b in e.texts)
        body.append(f"<details><summary>Row {e.number}: {html.escape(e.heading)}</summary><ul>{notes}</ul>{texts}</details>")
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:3px 8px;text-align:left}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{''.join(body)}</body></html>"


def console(title: str, parts: list[Table]) -> str:
    """Plain ASCII."""
    out = [title]
    for t in parts:
        widths = [max(len(c), *(len(cell(r[i])) for r in t.rows), 0) if t.rows else len(c) for i, c in enumerate(t.columns)]
        line = lambda cells, w=widths: "  ".join(str(x).ljust(n) for x, n in zip(cells, w, strict=True)).rstrip()
        out += ["", t.title, line(t.columns), *[line([cell(v) for v in r]) for r in t.rows]]
    return "\n".join(out).encode("ascii", "replace").decode() + "\n"


def write(folder: str, name: str, title: str, parts: list[Table], formats: tuple[str, ...] = ("md", "html"), rows: list[Entry] = ()) -> list[str]:
    """Report files ``<name>.md`` and ``<name>.html``; the name may contain dots."""
    render = {"md": lambda t, p: markdown(t, p, rows), "html": lambda t, p: page(t, p, rows), "txt": console}
    Path(folder).mkdir(parents=True, exist_ok=True)
    paths = []
    for kind in formats:
        path = Path(folder) / f"{name}.{kind}"
        path.write_text(render[kind](title, parts), encoding="utf-8")
        paths.append(str(path))
    return paths
