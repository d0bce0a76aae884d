"""Comparators by name (CMP-10..13, UDF-1): a specification is parsed, built and run over pairs.

A comparator is a function from the columns of a pair to a result struct (comparator, score, passed, detail, error). Own ones are
registered as such a function, or as plain Python over one pair, which is run in Arrow batches and whose
exceptions become errored results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from swaplens.functions import leaves, text
from swaplens.operators import migration

Build = Callable[["Pair", list[str], dict], Column]
OFFLINE = ("exact", "fuzzy", "json", "toolcalls")


@dataclass(frozen=True)
class Pair:
    """The columns of a pair of answers."""

    prompt: Column
    base: Column
    target: Column
    base_calls: Column
    target_calls: Column


@dataclass(frozen=True)
class Entry:
    name: str
    fields: tuple[str, ...] = ()

    @property
    def label(self) -> str:
        return self.name + (":" + ",".join(self.fields) if self.fields else "")


def _rendered(p: Pair) -> tuple[Column, Column]:
    return text.render_response(p.base, p.base_calls), text.render_response(p.target, p.target_calls)


def _exact(p: Pair, fields: list[str], options: dict) -> Column:
    return migration.exact(*_rendered(p))


def _fuzzy(p: Pair, fields: list[str], options: dict) -> Column:
    return migration.fuzzy(*_rendered(p), options.get("fuzzy_threshold", 0.8))


def _named(name: str, r: Column) -> Column:
    return F.struct(F.lit(name).alias("comparator"), r["score"].alias("score"), r["passed"].alias("passed"), r["detail"].alias("detail"), r["error"].alias("error"))


def _json(p: Pair, fields: list[str], options: dict) -> Column:
    return _named(Entry("json", tuple(fields)).label, leaves.json_comparison(fields or None)(p.base, p.target))


def _toolcalls(p: Pair, fields: list[str], options: dict) -> Column:
    return _named("toolcalls", leaves.calls_comparison(F.to_json(p.base_calls), F.to_json(p.target_calls)))


COMPARATORS: dict[str, Build] = {"exact": _exact, "fuzzy": _fuzzy, "json": _json, "toolcalls": _toolcalls}


def register(name: str, build: Build) -> None:
    COMPARATORS[name] = build


def register_python(name: str, compare: Callable[[str | None, str | None, str | None], tuple[float, bool | None, str]]) -> None:
    """A comparator as plain Python: (prompt, baseline, target) to (score, passed, detail)."""

    @pandas_udf(leaves.RESULT)
    def run(prompt: pd.Series, base: pd.Series, target: pd.Series) -> pd.DataFrame:
        rows = []
        for x in zip(prompt, base, target, strict=True):
            try:
                rows.append((*compare(*x), None))
            except Exception as e:
                rows.append((0.0, None, "", str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=leaves.RESULT.names).astype({"passed": "object"})

    register(name, lambda p, fields, options: _named(name, run(p.prompt, p.base, p.target)))


def parse_spec(spec: str) -> list[Entry]:
    """``exact,json:a,b,fuzzy``: names by commas; a word after ``json:`` that is no name goes on with its fields;
    ``all`` is every offline comparator. Names are read without case and empty ones skipped; of entries alike the first counts."""
    entries: list[Entry] = []
    for token in filter(None, (t.strip() for t in spec.split(","))):
        name, colon, argument = token.partition(":")
        name, argument = name.strip().lower(), argument.strip()
        if name == "all" and not colon:
            entries += [Entry(n) for n in OFFLINE]
        elif name in COMPARATORS:
            if colon and (name != "json" or not argument):
                raise ValueError(f"{token}: only json takes fields")
            entries.append(Entry(name, (argument,) if argument else ()))
        elif entries and entries[-1].name == "json" and entries[-1].fields and not colon:
            entries[-1] = Entry("json", (*entries[-1].fields, token))
        else:
            raise ValueError(f"no comparator {token}; there are {', '.join(sorted(COMPARATORS))}")
    if not entries:
        raise ValueError("no comparator is named")
    return list({e.label: e for e in entries}.values())


def run(results: DataFrame, spec: str, **options) -> DataFrame:
    """The ok rows' comparisons in long form: ``row_id, category`` and the result's fields."""
    pair = Pair(F.col("prompt_text"), F.col("baseline_text"), F.col("target_text"), F.col("baseline_tool_calls"), F.col("target_tool_calls"))
    built = [COMPARATORS[e.name](pair, list(e.fields), options).cast(migration.EMPTY_RESULT) for e in parse_spec(spec)]
    return results.where("status = 'ok'").select("row_id", "category", F.inline(F.array(*built)))
