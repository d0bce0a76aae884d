"""Rate snapshot documents (SRC-7, PRC-1, PRC-5): checked on the driver, then one small rate table."""

from __future__ import annotations

import json
from datetime import date
from decimal import Decimal, InvalidOperation
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swaplens.operators.rates import BUCKETS, glob_regex


class SnapshotError(ValueError):
    """A snapshot that does not keep to its schema."""


def check(doc: dict, name: str) -> list[tuple]:
    """The rate rows of one document, in the order of its entries."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise SnapshotError(f"{name}: {what}")

    need(doc.get("schema_version") == 1, "schema_version must be 1")
    need(bool(doc.get("profile")) and bool(doc.get("currency")), "profile and currency are needed")
    try:
        effective = date.fromisoformat(doc.get("effective") or "")
    except ValueError as e:
        raise SnapshotError(f"{name}: effective is no date") from e
    need(isinstance(doc.get("models"), list) and bool(doc["models"]), "models are needed")
    rows, exact = [], set()
    for entry, model in enumerate(doc["models"]):
        need("tiers" not in model, "tiers are not supported")
        need(model.get("unit") == "per_mtok", "the unit must be per_mtok")
        patterns = model.get("match")
        need(isinstance(patterns, list) and bool(patterns), "match must be a list")
        given = model.get("rates") or {}
        need(set(given) <= set(BUCKETS), f"unknown rates {sorted(set(given) - set(BUCKETS))}")
        values = []
        for b in BUCKETS:
            try:
                value = None if given.get(b) is None else Decimal(str(given[b]))
            except InvalidOperation as e:
                raise SnapshotError(f"{name}: {b} is no number") from e
            need(value is None or (value.is_finite() and value >= 0 and -value.as_tuple().exponent <= 6), f"{b} must be a number from 0 with at most six places")
            values.append(value)
        for k, pattern in enumerate(patterns):
            if not set("*?[") & set(pattern):
                need(pattern not in exact, f"{pattern} twice")
                exact.add(pattern)
            rows.append((doc["profile"], name, effective, doc["currency"], entry, k, pattern, glob_regex(pattern), *values))
    return rows


SCHEMA = "profile string, snapshot string, effective date, currency string, entry_ord int, pattern_ord int, pattern string, pattern_regex string, " + ", ".join(f"r_{b} decimal(18,6)" for b in BUCKETS)


def read_snapshots(spark: SparkSession, folder: str, profiles: list[str]) -> DataFrame:
    """The rate table of the ``*.json`` documents below ``folder`` for ``profiles``, in order of preference.

    One currency per profile and for all; documents are few and small."""
    rows: list[tuple] = []
    for path in sorted(Path(folder).rglob("*.json")):
        rows += check(json.loads(path.read_text(encoding="utf-8")), path.stem)
    missing = set(profiles) - {r[0] for r in rows}
    if missing:
        raise LookupError(f"no profile {', '.join(sorted(missing))}")
    kept = [r for r in rows if r[0] in profiles]
    if len({r[3] for r in kept}) > 1:
        raise SnapshotError(f"more than one currency: {sorted({r[3] for r in kept})}")
    table = spark.createDataFrame(kept, SCHEMA)
    order = spark.createDataFrame(list(enumerate(profiles)), "profile_ord int, profile string")
    return table.join(order, "profile").drop("currency")


def digest(folder: str, profile: str) -> str:
    """ID-12: the identity of a profile's documents: a hash over their canonical texts in order of date and name."""
    from swaplens.functions.identity import canonical, digest_text

    docs = [(d["effective"], p.stem, canonical(d)) for p in sorted(Path(folder).rglob("*.json")) if (d := json.loads(p.read_text(encoding="utf-8"))).get("profile") == profile]
    return digest_text(*[text for _, _, text in sorted(docs)])


def profiles(folders: list[str]) -> list[tuple[str, str, list[str]]]:
    """(profile, currency, dates) of all folders; a profile of a later folder replaces that of an earlier one as a whole (SET-1)."""
    found: dict[str, tuple[str, str, list[str]]] = {}
    for folder in folders:
        rows = [r for path in sorted(Path(folder).rglob("*.json")) for r in check(json.loads(path.read_text(encoding="utf-8")), path.stem)]
        for name in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == name]
            found[name] = (name, mine[0][3], sorted({r[2].isoformat() for r in mine}))
    return [found[k] for k in sorted(found)]


def read_catalog(spark: SparkSession, folders: list[str], wanted: list[str]) -> DataFrame:
    """As ``read_snapshots`` over several folders, of which a later one's profile replaces an earlier one's as a whole."""
    home = {name: folder for folder in folders for name, _, _ in profiles([folder])}
    if missing := [p for p in wanted if p not in home]:
        raise LookupError(f"no profile {', '.join(missing)}; there are {', '.join(sorted(home)) or 'none'}")
    currencies = {c for folder in folders for name, c, _ in profiles([folder]) if name in wanted and home[name] == folder}
    if len(currencies) > 1:
        raise SnapshotError(f"more than one currency: {sorted(currencies)}")
    out = None
    for k, name in enumerate(wanted):
        part = read_snapshots(spark, home[name], [name]).drop("profile_ord").withColumn("profile_ord", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out
