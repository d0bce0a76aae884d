"""Normalising timestamps of mixed formats, precisions and zones to one UTC instant.

``parse_instants`` splits each text into wall-clock parts and, if it has one, its own offset;
``estimate_zones`` finds the zone of a source that declares none, or that no table of sources knows, by aligning its
zone-less wall times with ingestion times: of all offset histories (IANA zones) it takes the one with
the fewest violations, where a violation is an instant after its ingestion or further before it
than an ordinary load takes; ``normalise_timestamps`` converts.

Everything is Column expressions, so a scan of any size is map-only; only the estimate shuffles, and that counts per source,
wall hour and distance in quarters of an hour, of which there are as many as a calendar has, not as rows.

Defined results: null, placeholders, impossible dates or times, a date or a time alone, numbers up
to zero and unknown abbreviations give no instant. A wall time that occurs twice is its earlier
instant; one that is skipped takes the offset before the change.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed offsets in minutes of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "BRST": -120, "ART": -180,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([ap])\.?m\.?)?"
_ZONE = r"(?:\s*([a-z]{1,5}|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?))?"
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
#: Patterns over lower-cased text, with the group numbers of year, month, day, hour, minute, second, fraction, am/pm, zone.
_FAMILIES = {
    "iso": (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:t|\s+|,\s*){_TIME}{_ZONE}$", (1, 3, 4, 5, 6, 7, 8, 9, 10)),
    "basic": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[t ](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    "parts": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:t|,?\s+){_TIME}{_ZONE}$", (4, 3, 1, 5, 6, 7, 8, 9, 10)),
    "dmy_name": (rf"^{_DAY}(\d{{1,2}})(?:\s+|-){_MONTH}(?:,?\s+|-)(\d{{4}}|\d{{2}})(?:,?\s+|t){_TIME}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "mdy_name": (rf"^{_DAY}{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_TIME}{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    "ctime": (rf"^{_DAY}{_MONTH}\s+(\d{{1,2}})\s+{_TIME}{_ZONE}\s+(\d{{4}})$", (9, 1, 2, 3, 4, 5, 6, 7, 8)),
}
_NUMBER = r"^\+?(\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d{1,2})?$"
_US = 1_000_000


def _clean(text: Column) -> Column:
    """Lower case, typographic minus signs as ASCII, Unicode white space as one space, no outer space."""
    plain = F.regexp_replace(F.lower(text), "[−‐-–﹣－]", "-")
    return F.trim(F.regexp_replace(plain, r"(?U)[\s​﻿]+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over one evaluation of ``value``. A lambda variable is not inlined when a plan is rewritten, so
    expressions that use their input many times stay small."""
    return F.transform(F.array(value), body)[0]


def _int(text: Column) -> Column:
    return F.when(text != "", text).try_cast("int")


def _micros(ntz: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz)


def _epoch_micros(clean: Column) -> Column:
    """Microseconds of a number of seconds, milli-, micro- or nanoseconds, by its size; null up to zero."""

    def scaled(value: Column) -> Column:
        floor = lambda factor: F.floor(value.cast("decimal(27,9)") * F.lit(factor).cast("decimal(8,0)")).cast("long")
        nanos = F.call_function("div", value.try_cast("long"), F.lit(1000).cast("long"))
        return F.when(value >= F.lit(9 * 10**18), None).when(value >= F.lit(10**17), nanos).when(value >= F.lit(10**14), floor(1)).when(value >= F.lit(10**11), floor(1000)).when(value > 0, floor(_US))

    return let(F.when(clean.rlike(_NUMBER), clean).try_cast("decimal(38,9)"), scaled)


def _fields(clean: Column, date_order: Column) -> Column:
    """Year, month, day, hour, minute, second, fraction, am/pm and zone of the first family that matches, as texts."""
    found = []
    for family, (pattern, places) in _FAMILIES.items():
        flat = F.split(F.regexp_replace(clean, pattern, "|".join(f"${g}" if g else "" for g in places) + ("|$2" if family == "parts" else "")), r"\|")
        if family == "parts":

            def ordered(p: Column) -> Column:
                last, second, first, slashed = p[0], p[1], p[2], p[9] == "/"
                year_first, month_first = slashed & (date_order == "ymd"), slashed & (date_order == "mdy")
                year = F.when(year_first, first).otherwise(last)
                month = F.when(month_first, first).otherwise(second)
                day = F.when(month_first, second).when(year_first, last).otherwise(first)
                return F.concat(F.array(year, month, day), F.slice(p, 4, 6))

            flat = let(flat, ordered)
        found.append(F.when(clean.rlike(pattern), flat))
    return F.coalesce(*found)


def _offset_minutes(zone: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in (pair[0].lower(), pair[1])])
    flat = F.split(F.regexp_replace(zone, r"^(?:utc|gmt)?([+-])(\d{1,2})(?::?(\d{2}))?$", "$1|$2|$3"), r"\|")

    def numeric(p: Column) -> Column:
        hours, minutes = _int(p[1]), F.coalesce(_int(p[2]), F.lit(0))
        return F.when((hours <= 18) & (minutes < 60), F.when(p[0] == "-", -1).otherwise(1) * (hours * 60 + minutes))

    return F.when(zone == "", None).when(zone.rlike(r"[+-]\d"), let(flat, numeric)).otherwise(F.try_element_at(table, zone))


def _wall_and_offset(p: Column) -> Column:
    year = F.when(F.length(p[0]) <= 2, _int(p[0]) + 2000).otherwise(_int(p[0]))
    months = F.create_map(*[F.lit(x) for number, month in enumerate(MONTHS, 1) for x in (month, number)])
    month = F.coalesce(F.try_element_at(months, F.substring(p[1], 1, 3)), _int(p[1]))
    hour = let(_int(p[3]), lambda h: F.when(p[7] == "", h).when(h.between(1, 12), h % 12 + F.when(p[7] == "p", 12).otherwise(0)))
    second = F.coalesce(_int(p[5]), F.lit(0))
    micro = F.rpad(F.substring(p[6], 1, 6), 6, "0").cast("int")
    wall = let(hour, lambda h: F.when(h.between(0, 23) & _int(p[4]).between(0, 59) & second.between(0, 59), F.try_make_timestamp_ntz(year, month, _int(p[2]), h, _int(p[4]), second.cast("decimal(16,6)"))))
    return let(_offset_minutes(p[8]), lambda o: F.struct(F.when((p[8] == "") | o.isNotNull(), _micros(wall) + micro).alias("wall_us"), o.alias("offset_min")))


def parse_instants(df: DataFrame, text: str, date_order: str, prefix: str = "ts") -> DataFrame:
    """Adds ``<prefix>_wall_us`` (wall time as microseconds of a zone-less clock), ``<prefix>_offset_min``
    (its own offset, null if it has none), ``<prefix>_named_zone`` (an IANA name in brackets) and
    ``<prefix>_epoch_us`` (a number counted since 1970). All null: the text names no instant."""
    parsed = f"__{prefix}_parsed"

    def body(clean: Column) -> Column:
        named = let(_fields(clean, F.col(date_order)), lambda p: F.when(p.isNotNull(), _wall_and_offset(p)))
        return let(named, lambda w: F.struct(w["wall_us"].alias("wall_us"), w["offset_min"].alias("offset_min"), _epoch_micros(clean).alias("epoch_us")))

    clean = F.trim(F.regexp_replace(_clean(F.col(text)), r"\[[a-z]+(?:/[a-z0-9_+-]+)*\]$", ""))
    zone_name = F.nullif(F.regexp_extract(F.col(text), r"\[([A-Za-z]+(?:/[A-Za-z0-9_+-]+)*)\]\s*$", 1), F.lit(""))
    out = df.withColumn(f"{prefix}_named_zone", zone_name).withColumn(parsed, let(clean, body))
    for name in ("wall_us", "offset_min", "epoch_us"):
        out = out.withColumn(f"{prefix}_{name}", F.col(parsed)[name])
    return out.drop(parsed)


def wall_to_utc_us(wall_us: Column, zone: Column) -> Column:
    """Microseconds since 1970 UTC of a wall time in an IANA zone (overlap: earlier, gap: offset before)."""
    wall = F.timestamp_add("MICROSECOND", wall_us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return _micros(F.convert_timezone(zone, F.lit("UTC"), wall))


AREAS = ("Africa/", "America/", "Antarctica/", "Asia/", "Atlantic/", "Australia/", "Europe/", "Indian/", "Pacific/")


def all_zones() -> list[str]:
    """The names of all regional zones, and UTC."""
    return sorted({"UTC"} | {z for z in zoneinfo.available_timezones() if z.startswith(AREAS)})


def quarter_offsets(zone: str, hours: np.ndarray) -> np.ndarray:
    """The offset of a zone in quarters of an hour at each wall hour since 1970; weeks without a change are looked up once."""
    tz = zoneinfo.ZoneInfo(zone)
    at = lambda h: round((datetime(1970, 1, 1) + timedelta(hours=int(h))).replace(tzinfo=tz).utcoffset().total_seconds() / 900)
    weeks, which = np.unique(hours // 168, return_inverse=True)
    first, last = np.array([at(168 * w) for w in weeks]), np.array([at(168 * w + 168) for w in weeks])
    out = first[which]
    for k in np.flatnonzero((first != last)[which]):
        out[k] = at(hours[k])
    return out


def estimate_zones(df: DataFrame, source: str, wall_us: str, ingested: str, candidates: list[str] | None = None, usual_lag_s: int = 3 * 3600) -> DataFrame:
    """One row per source: ``source, est_zone, violations, zone_less_rows``.

    Rows are counted by source, wall hour and the least offset (in quarters of an hour) with which their instant does not lie after
    ingestion. For every candidate (default: ``all_zones``) the counts whose offset is less, or so much more that the instant
    lies more than ``usual_lag_s`` before ingestion, are violations; the fewest win, then the smallest mean
    distance, then the name. Sources without a zone-less row, and rows without a source, are absent.
    """
    zones = sorted(candidates) if candidates is not None else all_zones()
    quarter = 900 * _US
    least = F.ceil((F.col(wall_us) - F.unix_micros(F.col(ingested).cast("timestamp"))) / F.lit(quarter)).cast("long")
    local = df.where(F.col(wall_us).isNotNull() & F.col(ingested).isNotNull() & F.col(source).isNotNull())
    counts = local.groupBy(F.col(source).cast("string").alias("src"), F.floor(F.col(wall_us) / F.lit(3600 * _US)).alias("hour"), F.least(F.greatest(least, F.lit(-200)), F.lit(200)).alias("least")).agg(F.count(F.lit(1)).alias("n"))
    most = usual_lag_s // 900

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        hours, need, n = frame["hour"].to_numpy(), frame["least"].to_numpy(), frame["n"].to_numpy()
        ranked = []
        for zone in zones:
            late = quarter_offsets(zone, hours) - need
            bad = (late < 0) | (late >= most)
            ranked.append((int(n[bad].sum()), float((late * n)[~bad].sum()) / max(1, int(n[~bad].sum())), zone))
        violations, _, zone = min(ranked)
        return pd.DataFrame({source: [frame["src"].iloc[0]], "est_zone": [zone], "violations": [violations], "zone_less_rows": [int(n.sum())]})

    counts = counts.repartition(df.sparkSession.sparkContext.defaultParallelism, "src")  # few rows, but much to compute for each source
    return counts.groupBy("src").applyInPandas(best, f"`{source}` string, est_zone string, violations long, zone_less_rows long")


def normalise_timestamps(df: DataFrame, text: str, sources: DataFrame, source: str, ingested: str, candidates: list[str] | None = None, out: str = "instant_us") -> DataFrame:
    """``df`` with ``out``: microseconds since 1970 UTC, or null.

    ``sources`` has ``source, zone, date_order`` (unique by source). A declared zone holds; a source without one, or
    that ``sources`` does not know, gets the estimate of ``estimate_zones`` over ``candidates`` (default: all zones).
    """
    known = sources.select(F.col(source).alias("__src"), F.col("zone").alias("__zone"), F.col("date_order").alias("__order"))
    parsed = parse_instants(df.join(known, F.col(source) == F.col("__src"), "left"), text, "__order", "__t")
    declared = known.where("__zone is not null")
    undeclared = df.select(source).where(F.col(source).isNotNull()).distinct().join(declared, F.col(source) == F.col("__src"), "left_anti")
    if undeclared.limit(1).count():  # reads one column
        missing = parsed.where(F.col("__zone").isNull() & F.col("__t_offset_min").isNull() & F.col("__t_named_zone").isNull())
        estimates = estimate_zones(missing, source, "__t_wall_us", ingested, candidates).select(F.col(source).alias("__e_src"), F.col("est_zone").alias("__t_est_zone"))
        parsed = parsed.join(estimates, F.col(source) == F.col("__e_src"), "left").drop("__e_src")
    else:
        parsed = parsed.withColumn("__t_est_zone", F.lit(None).cast("string"))
    zone = F.coalesce("__t_named_zone", "__zone", "__t_est_zone")
    cells = F.struct(F.col("__t_epoch_us").alias("epoch"), F.col("__t_wall_us").alias("wall"), F.col("__t_offset_min").alias("offset"), zone.alias("zone"))

    def instant(t: Column) -> Column:
        own = F.when(t["offset"].isNotNull(), t["wall"] - t["offset"].cast("long") * F.lit(60 * _US))
        return F.coalesce(t["epoch"], own, F.when(t["wall"].isNotNull() & t["zone"].isNotNull(), wall_to_utc_us(t["wall"], t["zone"])))

    instant = let(cells, instant)
    return parsed.withColumn(out, instant).drop("__src", "__zone", "__order", "__t_wall_us", "__t_offset_min", "__t_named_zone", "__t_epoch_us", "__t_est_zone")
