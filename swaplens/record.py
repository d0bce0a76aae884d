"""Record and replay around any callable (SRC-9, MNT-3, MNT-4, STM-1..3): no HTTP library is needed.

A transport is ``Callable[[dict], Iterator[bytes]]`` from a request (method, url, headers, content) to response chunks. What it returns
may have ``status`` and ``headers``; without them the answer counts as 200. Failures (400 and up) are passed on, never kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

Transport = Callable[[dict], Iterator[bytes]]


class MemoryStore(dict):
    """Interactions by id; true even when empty."""

    def __bool__(self) -> bool:
        return True


def recordable(status: int) -> bool:
    """Answers from 400 on are failures, which a replay would repeat for ever."""
    return status < 400


def recording(inner: Transport, store: dict, key: Callable[[dict], str], metadata: dict | Callable[[dict], dict] | None = None, clock: Callable[[], float] = time.monotonic) -> Transport:
    """Passes chunks on and stores them with their offsets once, whether the reader ends, stops or fails."""

    def send(request: dict) -> Iterator[bytes]:
        begun, chunks = clock(), []
        at = datetime.now(UTC).isoformat(timespec="seconds")
        answer = inner(request)
        try:
            for data in answer:
                chunks.append({"data": data, "timestamp_offset": round(clock() - begun, 4)})
                yield data
        finally:
            status = getattr(answer, "status", 200)
            if recordable(status):
                extra = metadata(request) if callable(metadata) else metadata or {}
                times = {"latency_s": round(clock() - begun, 4), "latency_first_chunk_s": chunks[0]["timestamp_offset"] if chunks else None}
                store[key(request)] = {"request": request, "response_status": status, "response_headers": list(getattr(answer, "headers", [])), "chunks": chunks, "metadata": {"recorded_at": at, **times, **extra}}

    return send


def replaying(store: dict, key: Callable[[dict], str], pace: Callable[[float], None] | None = None) -> Transport:
    """Stored chunks in order; a request that was not recorded is a KeyError. ``pace`` is told the pauses."""

    def send(request: dict) -> Iterator[bytes]:
        name = key(request)
        if name not in store:
            raise KeyError(f"{name} is not recorded")
        before = 0.0
        for chunk in store[name]["chunks"]:
            if pace and chunk["timestamp_offset"] > before:
                pace(chunk["timestamp_offset"] - before)
            before = chunk["timestamp_offset"]
            yield chunk["data"]

    return send


@contextmanager
def cassette(store: dict, key: Callable[[dict], str], inner: Transport | None = None, metadata=None):
    """A transport that replays what is recorded and records the rest through ``inner``."""

    def send(request: dict) -> Iterator[bytes]:
        if key(request) in store or inner is None:
            return replaying(store, key)(request)
        return recording(inner, store, key, metadata)(request)

    yield send
