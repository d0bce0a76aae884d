"""Strict JSON text as Python values, shared by the operators on semi-structured columns."""

from __future__ import annotations

import json
import sys


def allow_deep_nesting(levels: int = 100_000) -> None:
    """Lets plain Python walkers follow whatever depth the parser accepts."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), levels))


class NotJson(ValueError):
    """The text is not valid JSON."""


def _refuse(name: str):
    raise NotJson(name)


_decoder = json.JSONDecoder(parse_constant=_refuse)


class MISSING:
    """Stands for no value; a class, so that it is the same object in every process it is sent to."""


def parse(text: str | None):
    """The value of a JSON text; MISSING for null and for text that is not valid JSON (NaN and the
    like included, and nesting deeper than the parser follows)."""
    if text is None:
        return MISSING
    try:
        return _decoder.decode(text)
    except (ValueError, RecursionError):
        return MISSING


def unwrap(value, layers: int = 8):
    """A JSON string that holds the text of an object, array or null stands for that text."""
    while isinstance(value, str) and layers:
        inner = value.strip()
        if not inner or inner[0] not in '[{"n':
            return value
        got = parse(inner)
        if got is MISSING or not (got is None or isinstance(got, (list, dict, str))):
            return value
        value, layers = got, layers - 1
    return value
