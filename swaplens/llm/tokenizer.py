"""Encoding a corpus with a byte-level BPE vocabulary, exactly and in linear time.

A backtracking encoder: an Aho-Corasick automaton over the vocabulary gives, for every position of a piece, the
longest token that starts there; the encoder takes it if the pair with the token before is compatible, that is if BPE
itself would keep this border, and else tries the next shorter token or takes the last one back. Every end position is
refused at most once, so a piece of n bytes takes O(n) steps however long it is. Compatibility of a pair is decided from
the table that says which two tokens each token was merged from, and kept. Decoding copies from one
byte string by an offset table.

The vocabulary file (base64 token and rank a line, as for tiktoken) is a parameter; executors read it from that path.

Defined results: an empty or null text has the empty list of ids; strings of special tokens are ordinary text;
very long pieces (runs of one letter or of white space) cost no more a byte than others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """One vocabulary: ``encode`` a text, ``decode`` ids."""

    def __init__(self, path: str, pattern: str = PATTERN, cache: int = 400_000):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError(f"{path}: ranks are not 0..n-1")
        self.tokens = sorted(ranks, key=ranks.get)
        self._split_pieces = regex.compile(pattern).findall
        self._cache: dict[str, tuple[int, ...]] = {}
        self._cache_limit = cache
        self._pairs: dict[int, bool] = {}
        self._offsets = np.zeros(len(self.tokens) + 1, np.int64)
        np.cumsum([len(t) for t in self.tokens], out=self._offsets[1:])
        self._bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._ranks = ranks
        self._automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self._automaton.make_automaton()
        self._merge: dict[tuple[int, int], int] = {}
        self._halves: list[tuple[int, int]] = []
        self._learn_merges()
        self._shorter = [self._prefix_of(t) for t in self.tokens]

    def _learn_merges(self) -> None:
        """The two tokens each token is merged from: the one border that BPE with lower ranks keeps."""
        for rank, token in enumerate(self.tokens):
            halves = (rank, rank)
            for cut in range(1, len(token)):
                a, b = self._ranks.get(token[:cut]), self._ranks.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank and self.compatible(a, b):
                    halves = (a, b)
                    break
            self._halves.append(halves)
            if halves[0] != rank:
                self._merge[halves] = rank
        self._pairs.clear()

    def _prefix_of(self, token: bytes) -> int:
        for cut in range(len(token) - 1, 0, -1):
            if (rank := self._ranks.get(token[:cut])) is not None:
                return rank
        return -1

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE would leave a border between these neighbours.

        Both are taken apart in the reverse order of merging; if the tokens that meet at the border could have
        been merged with each other before either grew on, the border does not hold."""
        key = left << 32 | right
        if (known := self._pairs.get(key)) is not None:
            return known
        halves, merge, a, b, bound, ok = self._halves, self._merge, left, right, 1 << 62, True
        while True:
            if merge.get((a, b), bound) < bound:
                ok = False
                break
            if a > b:
                bound, inner = a, halves[a][1]
                if inner != a:
                    a = inner
                    continue
                bound, inner = b + 1, halves[b][0]
                if inner == b:
                    break
                b = inner
            else:
                bound, inner = b + 1, halves[b][0]
                if inner != b:
                    b = inner
                    continue
                bound, inner = a, halves[a][1]
                if inner == a:
                    break
                a = inner
        if len(self._pairs) > 2_000_000:
            self._pairs.clear()
        self._pairs[key] = ok
        return ok

    def _encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if (rank := self._ranks.get(piece)) is not None:
            return (rank,)
        n = len(piece)
        longest = [-1] * n
        for end, (back, rank) in self._automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank
        out: list[int] = []
        open_end = bytearray(b"\1") * (n + 1)
        tokens, shorter, at, token = self.tokens, self._shorter, 0, longest[0]
        while at < n:
            end = at + len(tokens[token])
            if open_end[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_end[at] = 0
                token = out.pop()
                at -= len(tokens[token])
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, ids = self._cache, []
        for piece in self._split_pieces(text):
            got = cache.get(piece)
            if got is None:
                got = self._encode_piece(piece.encode("utf-8"))
                if len(piece) <= 48:
                    if len(cache) >= self._cache_limit:
                        cache.clear()
                    cache[piece] = got
            ids += got
        return ids

    def decode_bytes(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        start = self._offsets[ids]
        size = self._offsets[ids + 1] - start
        out_at = np.cumsum(size) - size
        index = np.arange(int(size.sum())) + np.repeat(start - out_at, size)
        return self._bytes[index].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str = PATTERN) -> ByteBpe:
    """The vocabulary at ``path``, loaded once per worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def encode_column(df: DataFrame, doc_id: str, text: str, path: str, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, ids``: map-only, a row in and a row out."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or tokenizer(path, pattern)
            values, offsets = [], [0]
            for t in batch.column(1).to_pylist():
                values += bpe.encode(t)
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(values, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(per_task, "doc_id long, ids array<int>")


def decode_column(df: DataFrame, doc_id: str, ids: str, path: str) -> DataFrame:
    """``doc_id, text``: the texts that the ids stand for."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or tokenizer(path)
            texts = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(per_task, "doc_id long, text string")
