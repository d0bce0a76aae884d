"""Text functions (STR-1..9, STR-13, LIM-1..2, PRJ-5): Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

FENCE = r"(?s)^\s*```[\w+-]*[ \t]*\r?\n(.*?)\r?\n?[ \t]*```\s*$"
CLIP, CLIPPED = 6000, "\n[... truncated]"
#: Header names whose values are never kept.
SECRET_HEADERS = ("authorization", "proxy-authorization", "api-key", "x-api-key", "cookie", "set-cookie", "x-goog-api-key")
REDACTED = "[REDACTED]"
#: Secret shapes in the order they are applied, with what replaces them.
SECRETS = (
    (r"sk-ant-[A-Za-z0-9_-]{16,}", REDACTED),
    (r"sk-[A-Za-z0-9_-]{16,}", REDACTED),
    (r"AKIA[0-9A-Z]{16}", REDACTED),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", REDACTED),
    (r"AIza[0-9A-Za-z_-]{30,}", REDACTED),
    (r"ya29\.[0-9A-Za-z_-]{20,}", REDACTED),
    (r"xox[baprs]-[0-9A-Za-z-]{10,}", REDACTED),
    (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", REDACTED),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", REDACTED),
    (r"([A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+):[^\s/@]+@", rf"$1:{REDACTED}@"),
    (r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", f"Bearer {REDACTED}"),
    (r"(?i)(\\?\"(?:api_key|api-key|password|secret|token|access_token)\\?\"\s*:\s*\\?\")[^\"\\]+", rf"$1{REDACTED}"),
)


#: Lower-case letters of the Latin and Greek scripts that case folding replaces.
FOLDED = (("ß", "ss"), ("ſ", "s"), ("ς", "σ"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ŉ", "ʼn"))


def strip_fence(text: Column) -> Column:
    """The inside of a Markdown fence that wraps the whole text; other texts as they are."""
    return F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)


def normalize(text: Column) -> Column:
    """White space runs as one space, no outer space, folded case: lower case, but for the letters that fold to others."""
    low = F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    for letter, folded in FOLDED:
        low = F.replace(low, F.lit(letter), F.lit(folded))
    return low


@pandas_udf(T.StringType())
def normalize_exact(text: pd.Series) -> pd.Series:
    """As ``normalize``, folded by Python."""
    return text.map(lambda x: None if x is None else " ".join(x.split()).casefold())


def clip(text: Column, most: int = CLIP) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(CLIPPED))).otherwise(text)


def preview(text: Column, most: int = 80) -> Column:
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)


def render_response(text: Column, calls: Column) -> Column:
    """A text with one ``[tool_call] name(arguments)`` line for each call (name, arguments_json)."""
    lines = F.transform(F.filter(F.coalesce(calls, F.array().cast("array<struct<name:string,arguments_json:string,id:string>>")), lambda c: c.isNotNull()), lambda c: F.concat(F.lit("[tool_call] "), F.coalesce(c["name"], F.lit("")), F.lit("("), F.coalesce(c["arguments_json"], F.lit("")), F.lit(")")))
    head = F.when(F.coalesce(text, F.lit("")) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, lines), "\n")


def scrub(text: Column, patterns=SECRETS) -> Column:
    """Secrets replaced, shape by shape; an empty list of own patterns means the built-in ones."""
    for pattern, replacement in patterns or SECRETS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def redact_headers(headers: Column) -> Column:
    """(name, value) pairs with the values of secret headers, and secrets in other values, replaced."""
    secret = lambda h: F.lower(h["name"]).isin(*SECRET_HEADERS)
    return F.transform(headers, lambda h: F.struct(h["name"].alias("name"), F.when(secret(h), F.lit(REDACTED)).otherwise(scrub(h["value"])).alias("value")))


def last_header(headers: Column, name: str) -> Column:
    """The value of the last header of that name, without regard to case."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(-1))["value"]


def is_event_stream(headers: Column) -> Column:
    return F.coalesce(F.lower(last_header(headers, "content-type")).contains("text/event-stream"), F.lit(False))


def sse_data(body: Column) -> Column:
    """The data of each server-sent event: events end at a blank line, data lines are joined by line feeds."""
    frames = F.split(body, r"\r?\n\r?\n")
    lines = lambda f: F.filter(F.split(f, r"\r?\n"), lambda x: x.startswith("data:") | (x == "data"))
    value = lambda x: F.regexp_replace(x, r"^data(?:: ?)?", "")
    return F.transform(F.filter(frames, lambda f: F.size(lines(f)) > 0), lambda f: F.array_join(F.transform(lines(f), value), "\n"))


def cap_list(items: Column, most: int = 6) -> Column:
    """The first items joined, and how many more there are."""
    head = F.array_join(F.slice(items, 1, most), "; ")
    return F.when(F.size(items) > most, F.concat(head, F.lit("; … (+"), (F.size(items) - most).cast("string"), F.lit(" more)"))).otherwise(head)
