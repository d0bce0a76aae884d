"""Blobs and bodies (FMT-1, FMT-3): text or base64 objects, content codings."""

from __future__ import annotations

import base64
import gzip
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from swaplens.functions.json_text import MISSING, parse, unwrap

CODED = "__b64__"


def blob_bytes(text: Column) -> Column:
    """Bytes of a stored blob: JSON text ``{"__b64__": …}`` is base64, any other text is UTF-8."""
    coded = F.get_json_object(text, f"$.{CODED}")
    return F.when(F.ltrim(text).startswith("{") & coded.isNotNull(), F.unbase64(coded)).otherwise(F.encode(text, "UTF-8"))


def blob_text(data: Column) -> Column:
    """Stored form of bytes: valid UTF-8 as it is, other bytes as an object of base64."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.concat(F.lit(f'{{"{CODED}": "'), F.base64(data), F.lit('"}')))


class DecodeError(ValueError):
    """A body that cannot be decoded."""


def undo(data: bytes, codings: str | None) -> bytes:
    """Content codings undone from the last to the first."""
    for name in reversed([c.strip().lower() for c in (codings or "").split(",") if c.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                data = gzip.decompress(data)
            elif name == "deflate":
                try:
                    data = zlib.decompress(data)
                except zlib.error:
                    data = zlib.decompress(data, -zlib.MAX_WBITS)
            elif name == "zstd":
                import zstandard

                data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
            elif name == "br":
                import brotli

                data = brotli.decompress(data)
            elif name != "identity":
                raise DecodeError(f"unknown content coding {name}")
        except DecodeError:
            raise
        except Exception as e:
            raise DecodeError(f"{name}: {e}") from e
    return data


def body_of(chunks: list | None, codings: str | None) -> bytes:
    """The decoded body of stored chunks (each text or a base64 object), joined before decoding."""
    parts = []
    for chunk in chunks or []:
        data = (chunk or {}).get("data")
        if isinstance(data, str) and data.lstrip().startswith("{") and CODED in data:
            inner = parse(data)  # a table keeps the object as text
            data = inner if isinstance(inner, dict) and inner.keys() == {CODED} else data
        if isinstance(data, dict):
            parts.append(base64.b64decode(data.get(CODED) or ""))
        elif isinstance(data, str):
            parts.append(data.encode())
    joined = b"".join(parts)
    if codings is None and joined[:2] == b"\x1f\x8b":
        codings = "gzip"
    return undo(joined, codings)


@pandas_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("error", T.StringType())]))
def decoded_body(chunks: pd.Series, codings: pd.Series) -> pd.DataFrame:
    """Body text of a JSON list of chunks, or why there is none."""
    out = []
    for text, names in zip(chunks, codings, strict=True):
        value = unwrap(parse(text))
        if value is MISSING or value is None:
            out.append((None, "no chunks"))
            continue
        try:
            out.append((body_of(value if isinstance(value, list) else [value], names).decode("utf-8", "replace"), None))
        except ValueError as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["body", "error"])
