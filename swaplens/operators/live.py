"""Live answers for rows without a recorded one (SRC-8, DT-3): an injected client, called in Arrow batches.

Nothing here opens a connection: ``client`` is any callable from (url, body) to (status, headers, body). Rows go out by
partition, so the number of partitions is the number of rows in flight."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame

from swaplens.functions import dialects

Client = Callable[[str, str], tuple[int, dict[str, str], str]]
ANSWER = "row_id long, status string, reason string, text string, finish_reason string, attempts int, payload string, latency_s double"
#: Statuses that a later attempt may not meet.
PASSING = frozenset({429, 431, 500, 502, 503, 529})


def _wait_of(value: str, now: datetime) -> float | None:
    """Seconds that a Retry-After header asks for, as a number or a date (without a zone: UTC); null if it says neither."""
    try:
        return float(value)
    except ValueError:
        pass
    try:
        at = parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return None
    return ((at if at.tzinfo else at.replace(tzinfo=UTC)) - now).total_seconds()


def retry_delay(attempt: int, headers: dict[str, str], now: datetime | None = None) -> float:
    """Seconds to wait before the next attempt: what the answer asks for, else doubling; never negative."""
    asked = {k.lower(): v for k, v in headers.items()}.get("retry-after")
    wait = _wait_of(asked, now or datetime.now(UTC)) if asked else None
    return float(2**attempt) if wait is None else max(0.0, wait)


#: The variable that holds a provider's key, and the headers that carry it.
CREDENTIALS = {
    "openai": ("OPENAI_API_KEY", lambda k: {"authorization": f"Bearer {k}"}),
    "anthropic": ("ANTHROPIC_API_KEY", lambda k: {"x-api-key": k, "anthropic-version": "2023-06-01"}),
    "mistral": ("MISTRAL_API_KEY", lambda k: {"authorization": f"Bearer {k}"}),
    "gemini": ("GEMINI_API_KEY", lambda k: {"x-goog-api-key": k}),
}


def http_client(provider: str, timeout: float = 120.0) -> Client:
    """A client over the standard library with the provider's key from the environment; the key never enters a row."""
    from urllib import error, request

    variable, headers_of = CREDENTIALS[provider]
    key = os.environ.get(variable)
    if not key:
        raise ValueError(f"set {variable}")

    def send(url: str, body: str) -> tuple[int, dict[str, str], str]:
        sent = request.Request(url, body.encode(), {"content-type": "application/json", **headers_of(key)}, method="POST")
        try:
            with request.urlopen(sent, timeout=timeout) as got:
                return got.status, dict(got.headers), got.read().decode()
        except error.HTTPError as e:
            return e.code, dict(e.headers), e.read().decode(errors="replace")

    return send


def ask(rows: DataFrame, client: Client, provider: str, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` has row_id, url and body (a request built by ``decode.translate``); every row gives one answer row."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ANSWER.split(", ")]
        for batch in batches:
            out = []
            for i, url, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                attempt, row = 0, (i, "error", "not sent", None, None, 0, None, None)
                while attempt <= retries:
                    attempt += 1
                    try:
                        begun = time.monotonic()
                        status, headers, payload = client(url, body)
                        if status == 200:
                            got = dialects.decode(provider, payload, False)
                            row = (i, "ok", None, got["text"], got["finish_reason"], attempt, payload, round(time.monotonic() - begun, 4))
                            break
                        row = (i, "error", f"HTTP {status} from upstream", None, None, attempt, None, None)
                        if status not in PASSING:
                            break
                        if attempt <= retries:
                            sleep(retry_delay(attempt - 1, headers))
                    except Exception as e:
                        row = (i, "error", str(e) or type(e).__name__, None, None, attempt, None, None)
                out.append(row)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return rows.select("row_id", "url", "body").mapInArrow(per_task, ANSWER)
