"""Texts cut by field limits or in transfer: which records, and how often per source.

1. ``endings`` reads each text once: whether its structure (JSON, code fence, bracket at the end) is whole, whether it ends as a
   sentence does, and else the context of its end, that is its last two words without any cut mark.
2. ``length_hazards`` computes per source and length the discrete hazard (texts that end at this length among
   those that reach it) with window functions, tests it against the hazards of the neighbouring lengths and keeps the
   lengths that pass false-discovery control: the field limits.
3. ``ending_contexts`` counts over the whole corpus how often a context ends a line, and how often it, or a longer word that
   begins as its last word does, goes on. The share of ends is the chance that an open ending is complete.
4. ``cut_records`` flags broken structures, and open endings whose chance is low; at a limit the bar is higher, and a
   cut mark there is believed even after a whole sentence.

Every table that is joined is aggregated by context or by length first, so no key is larger than its number of
distinct contexts. The chance of an ending is that of the other texts: its own end does not count.

Defined results: null, empty and blank texts are no cases; a text that ends as a sentence does is complete unless its structure is open;
a repeated row is judged as its first one; words of more than ``WORD`` characters have no context of their own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swaplens.functions.json_text import MISSING, parse

WORD = 64
#: Marks put after a cut.
_MARK = re.compile(r"\s*(?:…|\.\.\.+|[\[(<]\s*(?:\.\.\.|…|cut|cut off|more|truncated|continued|read more|snip)\s*[\])>])\s*$", re.I)
_STOP = regex.compile(r"""[.!?。！？।؟][\p{Pf}\p{Pi}\p{Pe}"'*_`~]*$""")
#: What may stand after a complete text: references, hashtags, rules, links, a signature line, pictographs.
_AFTER = regex.compile(r"""(?:\s*(?:\[\d+\]|(?:^|(?<=\s))\(\d+\)|(?:^|(?<=\s))\#\w+|\*\s?\*\s?\*|-{3,}|_{3,}|(?:^|(?<=\s))https?://\S+|\n+\s*[—–-]{1,2}\s?\p{Lu}[\p{L}. ]{1,30}|[\p{So}\p{Sk}\uFE0F\u200D]+))+\s*$""")
_LIST_MARK = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s+")
FACTS = "response_id long, source string, state string, marked boolean, before string, last string, chars int, bytes int"


def _structure(text: str) -> str:
    """``whole``, ``open`` or ``none``."""
    body = text.strip()
    if text.count("```") % 2 or re.search(r"(?:^|\n)`{1,2}$", body):
        return "open"
    if body.endswith("```"):
        inner = body[: -len("```")].rsplit("```", 1)[-1]
        first, _, rest = inner.partition("\n")
        if first.strip().lower() == "json" or rest.lstrip()[:1] in ("{", "["):
            return "whole" if parse(rest.strip()) is not MISSING else "open"
        return "whole"
    if body[:1] in ("{", "[") and re.match(r'[\[{]\s*(?:["{\[\]}]|-?\d|true|false|null|$)', body):
        return "whole" if parse(body) is not MISSING else "open"
    tail = re.search(r'(?:^|\n)([\[{]\s*["{\[][\s\S]*)$', body)
    if tail and ('":' in tail[1] or '"' in tail[1][:3]):
        return "whole" if parse(tail[1].strip()) is not MISSING else "open"
    if body.endswith("}") and (at := re.search(r'(?<=\s)\{\s*"', body)):
        return "whole" if parse(body[at.start() :]) is not MISSING else "none"
    return "none"


def context_words(line: str) -> list[str]:
    """The words of a line with the marker of its start; list marks are part of the start."""
    mark = _LIST_MARK.match(line)
    return ["<li>" if mark else "<p>", *(line[mark.end() :] if mark else line).split()]


def ending(text: str) -> tuple[str, bool, str, str]:
    """(state, marked, word before the last, last word); state: complete, broken or open."""
    bare = text.rstrip()
    cut = _MARK.search(bare)
    rest = bare[: cut.start()].rstrip() if cut else bare
    if bare.endswith("�"):
        return "broken", False, "", ""
    structure = _structure(rest)
    if structure != "none":
        return ("broken" if structure == "open" else "complete"), bool(cut), "", ""
    if not rest or _STOP.search(rest):
        return "complete", bool(cut), "", ""
    before_after = _AFTER.sub("", rest)
    if before_after != rest and (not before_after or _STOP.search(before_after)):
        return "complete", bool(cut), "", ""
    words = context_words(rest.rsplit("\n", 1)[-1])
    if "\n" not in rest and words[0] == "<p>":
        words[0] = "<s>"
    last = words[-1] if len(words) > 1 else ""
    return "open", bool(cut), words[-2] if len(words) > 1 else words[0], last[: WORD + 1]


def endings(df: DataFrame, row_id: str, source: str, text: str) -> DataFrame:
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            got = [ending(t) for t in texts]
            columns = [pa.array([g[i] for g in got], pa.bool_() if i == 1 else pa.string()) for i in range(4)]
            sizes = [pa.array([len(t) for t in texts], pa.int32()), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *sizes], [c.split()[0] for c in FACTS.split(", ")])

    given = df.select(F.col(row_id).cast("long").alias("i"), F.col(source).cast("string").alias("s"), F.col(text).alias("t")).where("t is not null and t rlike '\\\\S'")
    return given.mapInArrow(per_task, FACTS)


def ending_contexts(df: DataFrame, text: str, facts: DataFrame) -> DataFrame:
    """``before, last, ends, goes_on`` of the contexts of open endings: over all lines of all texts, how often the context ends a line and
    how often it goes on, with another word or as a longer word. Copies of a text count once, as they tell nothing new, but for texts
    short enough to be labels.

    Words are counted by context before anything is shuffled; of the counts, those that share the first word and letter with some
    open ending then stand for themselves and all their beginnings."""
    wanted = facts.where("state = 'open' and last <> ''").select("before", "last").distinct()
    texts = df.select(F.col(text).alias("t")).where("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.withColumn("copies", F.when(F.length("t") <= 40, F.col("copies")).otherwise(1))
    texts = texts.withColumn("t", F.regexp_replace("t", r"(?i)\s*(?:…|\.\.\.+|[\[(<]\s*(?:\.\.\.|…|cut|cut off|more|truncated|continued|read more|snip)\s*[\])>])\s*$", ""))
    texts = texts.withColumn("t", F.rtrim("t"))
    lines = texts.select("copies", F.posexplode(F.split("t", "\n")).alias("k", "line"), F.size(F.split("t", "\n")).alias("n"))
    mark = r"^\s*(?:[-*•+]|\d+[.)])\s+"
    start = F.when(F.col("line").rlike(mark), "<li>").when(F.col("n") == 1, "<s>").otherwise("<p>")
    words = F.filter(F.split(F.regexp_replace("line", mark, ""), r"(?U)\s+"), lambda w: w != "")
    spans = lines.select("copies", F.concat(F.array(start), words).alias("w")).where(F.size("w") > 1)
    pairs = spans.select("copies", F.posexplode(F.slice("w", 2, 1 << 30)).alias("k", "last"), "w").select("copies", F.element_at("w", F.col("k") + 1).alias("before"), "last", (F.col("k") + 2 == F.size("w")).alias("end"))
    begins = wanted.select("before", F.left("last", F.lit(1)).alias("first")).distinct()
    counted = pairs.where(F.length("last") <= WORD).groupBy("before", "last").agg(F.sum(F.when(F.col("end"), F.col("copies")).otherwise(0)).alias("e"), F.sum("copies").alias("all"))
    counted = counted.withColumn("first", F.left("last", F.lit(1))).join(begins, ["before", "first"], "left_semi")
    sizes = F.sequence(F.lit(1), F.length("last"))
    begun = counted.select("before", F.explode(F.transform(sizes, lambda k: F.struct(F.substring(F.col("last"), F.lit(1), k).alias("last"), (k == F.length("last")).alias("whole")))).alias("x"), "e", "all").select("before", "x.*", "e", "all")
    ends = F.when(F.col("whole"), F.col("e")).otherwise(0)
    return begun.join(wanted, ["before", "last"], "left_semi").groupBy("before", "last").agg(F.sum(ends).alias("ends"), F.sum(F.col("all") - ends).alias("goes_on"))


def _poisson_tail(k: int, mean: float) -> float:
    """P(X >= k) for a Poisson variable."""
    if k <= 0:
        return 1.0
    term = math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) if mean > 0 else 0.0
    if k > mean:
        total, j = term, k
        while term > total * 1e-12:
            j += 1
            term *= mean / j
            total += term
        return min(1.0, total)
    return 1.0


def length_hazards(facts: DataFrame, reach: int = 12, rate: float = 0.001) -> DataFrame:
    """``source, unit, length, ended, at_risk, hazard, usual, p_value, significant`` for lengths in both units (chars, bytes).

    ``usual`` is the hazard of the lengths up to ``reach`` before and after without the length itself and those next to it that
    hold more than it expects; significance by Benjamini-Hochberg within each source and unit at ``rate``."""
    sizes = facts.select("source", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])).alias("x")).select("source", "x.*")
    counts = sizes.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("ended"))
    within = Window.partitionBy("source", "unit")
    down = within.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    risk = counts.withColumn("at_risk", F.sum("ended").over(down)).withColumn("hazard", F.col("ended") / F.col("at_risk"))
    near = within.orderBy("length").rangeBetween(-reach, reach)
    sums = risk.withColumn("near_ended", F.sum("ended").over(near) - F.col("ended")).withColumn("near_most", F.max("ended").over(near)).withColumn("near_risk", F.sum("at_risk").over(near) - F.col("at_risk"))
    below = F.col("near_ended") - F.when(F.col("near_most") > F.col("ended"), F.col("near_most")).otherwise(0)
    usual = sums.withColumn("usual", (F.greatest(below, F.lit(0)) + 0.5) / (F.greatest(F.col("near_risk"), F.col("at_risk")) + 1.0))
    columns = ["source", "unit", "length", "ended", "at_risk", "hazard", "usual"]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [_poisson_tail(d, n * q) for d, n, q in zip(*[batch.column(i).to_pylist() for i in (3, 4, 6)], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*columns, "p_value"])

    tested = usual.select(*columns).mapInArrow(per_task, "source string, unit string, length int, ended long, at_risk long, hazard double, usual double, p_value double")
    ranked = tested.withColumn("rank", F.row_number().over(within.orderBy("p_value", "length"))).withColumn("tests", F.count(F.lit(1)).over(within))
    passing = ranked.withColumn("last_passing", F.max(F.when(F.col("p_value") <= F.col("rank") * rate / F.col("tests"), F.col("rank"))).over(within))
    return passing.withColumn("significant", (F.col("rank") <= F.coalesce("last_passing", F.lit(0))) & (F.col("ended") >= 5)).drop("rank", "tests", "last_passing")


def cut_records(facts: DataFrame, contexts: DataFrame, least: float = 0.35, least_at_limit: float = 0.7) -> DataFrame:
    """``facts`` with ``at_limit``, ``chance`` (that an open ending is complete) and ``cut``.

    All limits of a source are one row of at most some lengths, so that facts meet them in one join."""
    found = length_hazards(facts).where("significant")
    limits = found.groupBy(F.col("source").alias("s")).agg(*[F.collect_set(F.when(F.col("unit") == u, F.col("length"))).alias(f"l_{u}") for u in ("chars", "bytes")])
    out = facts.join(limits, F.col("source").eqNullSafe(F.col("s")), "left")
    at = F.array_contains("l_chars", F.col("chars")) | F.array_contains("l_bytes", F.col("bytes"))
    out = with_chance(out.withColumn("at_limit", F.coalesce(at, F.lit(False))).drop("s", "l_chars", "l_bytes"), contexts)
    open_cut = (F.col("state") == "open") & (F.col("chance") < F.when(F.col("at_limit"), least_at_limit).otherwise(least))
    cut = (F.col("state") == "broken") | open_cut | (F.col("marked") & F.col("at_limit"))
    return out.withColumn("cut", F.coalesce(cut, F.lit(False)))


def with_chance(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """``facts`` (with state, marked, at_limit, before, last) and the ``chance`` that an open ending is complete.

    Only open endings are joined: the others, most of all, have no context."""
    is_open = F.coalesce(F.col("state") == "open", F.lit(False))
    known = contexts.select(F.col("before").alias("b"), F.col("last").alias("l"), "ends", "goes_on")
    out = facts.where(is_open).join(known, (F.col("before") == F.col("b")) & (F.col("last") == F.col("l")), "left")
    ends, goes_on = F.coalesce("ends", F.lit(0)), F.coalesce("goes_on", F.lit(0))
    short = (F.col("before") == "<s>") & (F.col("last") != "")
    others = F.greatest(ends - 1, F.lit(0))
    unseen = F.when(short & ~F.col("marked") & ~F.col("at_limit"), 0.9).otherwise(0.1)
    chance = F.when(others + goes_on == 0, unseen).otherwise(others / (others + goes_on))
    judged = out.withColumn("chance", F.when(F.col("last") == "", 0.0).otherwise(chance)).drop("b", "l", "ends", "goes_on")
    return judged.unionByName(facts.where(~is_open).withColumn("chance", F.lit(None).cast("double")))


def source_report(df: DataFrame, source: str, cuts: DataFrame) -> DataFrame:
    """``source, records, cut, share``: of all records of each source, empty texts included."""
    found = cuts.where("cut").groupBy("source").agg(F.count(F.lit(1)).alias("cut")).withColumnRenamed("source", "__s")
    totals = df.groupBy(F.col(source).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("records"))
    joined = totals.join(found, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    cut = F.coalesce("cut", F.lit(0))
    return joined.select("source", "records", cut.alias("cut"), (cut / F.col("records")).alias("share"))
