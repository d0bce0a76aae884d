"""Pages of repeated keywords, links, menus or tags instead of sentences.

A page is cut into units (lines; sentences of a line that holds several). Each unit gives one symbol from what
it is made of: sentence ends, function words, repetition on the page, separators, links, digits, code. A hidden
Markov model over the page labels the units prose, data, link list, tag list, menu or keywords; a page is flagged if
more than half of it, by words and by characters together, is not prose or data.

The model starts from hand-set tables and is re-estimated over all pages (Viterbi training): every round labels all
pages, and the counts of labels with symbols and of neighbouring labels, a small table whatever the corpus, are added
to the tables as pseudo-counts.

Defined results: null, empty and blank texts are never flagged; a page is read whole, however long; repeated
rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("prose", "data", "links", "tags", "menu", "keywords")
SYMBOLS = ("sentence", "phrase", "data", "code", "bare_link", "titled_link", "items_bar", "items_list", "repeated", "repeated_short", "short", "short_stop", "heading")
#: Starting emissions: rows STATES, columns SYMBOLS.
START = np.array([
    [60, 20, 1, 1, 1, 1, .2, .5, .3, .3, 6, 3, 5],
    [5, 5, 50, 30, .5, .5, .5, 2, 1, 1, 6, 1, 2],
    [1, 1, .5, .5, 45, 45, .5, 1, 1, 1, 3, .5, .5],
    [.5, 2, .5, .2, 1, 1, 4, 75, 5, 3, 6, 3, .5],
    [.3, 1, .3, .2, 1, 1, 80, 4, 4, 2, 8, .5, .5],
    [.5, 2, .3, .2, 1, .5, 2, 6, 55, 40, 5, 3, .3],
])
#: Pages stay what they are: the chance to keep the label from unit to unit.
STAY = 0.75

FUNCTION_WORDS = frozenset(
    "a an the of to and or in is are was were be been with for that this it as by not at on from which when who has have had will would can could but if than then so its their our we you he she they i "
    "der die das und ist ein eine einer einem den dem des zu mit für auf von nicht sich bei im am war wurde werden wird dass als auch nach aus wir sie es er ich "
    "le la les un une et est pour dans du au aux que qui ne pas par sur avec sans ce cette se ont a été nous vous il elle on d l s n "
    "el los las y es por para con del al que se no lo su un una fue son nos más en de sin como ha han".split()
)
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.I)
_TITLED = re.compile(r"\[[^\]]*\]\((?:https?://|www\.)[^)]*\)|<a\s[^>]*href[^>]*>.*?</a>|^.{1,60}?\s[-–—:|]\s(?:https?://|www\.)\S+$", re.I)
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*")
_LATIN = regex.compile(r"\p{Latin}")
_END = re.compile(r"[.!?。！？।؟…:]['\"”’»)\]*_`]*$")
_SENTENCES = re.compile(r"(?<=[.!?।؟])['\"”’)]*\s+(?=\S)|(?<=[。！？])")
_NO_SPACE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_BARS = re.compile(r"\s[|•·»›>/]\s|\s[|•·»›]|[|•·»›]\s|\t")
_LIST = re.compile(r"\s*[,;、،]\s*")


def units(text: str) -> Iterator[tuple[str, bool]]:
    """(unit, whether inside a code fence)."""
    fenced = False
    for line in text.splitlines():
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
            continue
        if not bare:
            continue
        if fenced or len(bare) < 60:
            yield bare, fenced
            continue
        for part in _SENTENCES.split(bare):
            if part.strip():
                yield part.strip(), False


_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")


def _words(unit: str) -> list[str]:
    """The words of a unit in lower case, without links; scripts without spaces give their characters."""
    if "://" in unit or "www." in unit.lower():
        unit = _URL.sub(" ", unit)
    if unit.isascii():
        return _ASCII_WORD.findall(unit.lower())
    words = _WORD.findall(unit.replace("_", " ").lower())
    if _NO_SPACE.search(unit):
        words = [x for w in words for x in (w if _HAN.search(w) else (w,))]
    return words


def _page(text: str) -> tuple[list[tuple[str, bool]], list[list[str]], Counter, set]:
    """The units of a page, their words, and its word pairs: with counts, and those that are there four times or more."""
    parts = list(units(text))
    words = [_words(u) for u, _ in parts]
    pairs: Counter = Counter()
    for w in words:
        pairs.update(zip(w, w[1:], strict=False))
    return parts, words, pairs, {p for p, n in pairs.items() if n >= 4}


_INDEX = {name: i for i, name in enumerate(SYMBOLS)}
_TAG = re.compile(r"(?:^|\s)#[^\W_]\w*")
_SETS = re.compile(r"\b\w+=\S")


def _holds(unit: str, characters: str) -> int:
    return sum(map(unit.count, characters))


def symbol(unit: str, fenced: bool, words: list[str], pairs: Counter, often: set) -> int:
    """What a unit is made of; ``pairs`` counts the word pairs of its page, ``often`` are the frequent ones."""
    name = _INDEX.__getitem__
    if fenced:
        return name("code")
    if unit.startswith("#") and re.match(r"#{1,6}\s", unit):
        return name("heading")
    links = _URL.findall(unit) if "://" in unit or "www." in unit.lower() else ()
    if links:
        rest = len(words) - 3 * len(links)
        if _TITLED.search(unit) and rest <= 4:
            return name("titled_link")
        if sum(map(len, links)) >= 0.6 * len(unit) or rest <= 0:
            return name("bare_link")
    plain = unit.isascii()
    dense = "".join(unit.split())
    digits = (_holds(dense, "0123456789") if plain else sum(map(str.isdigit, dense))) / max(1, len(dense))
    tags = len(_TAG.findall(unit)) if "#" in unit else 0
    if tags >= 3 and tags * 4 >= len(words) / 2:
        return name("items_list")
    if digits >= 0.22 or unit.startswith("|") or ("=" in unit and len(_SETS.findall(unit)) >= 2):
        return name("data")
    if _holds(unit, "{}();=<>[]\\$") >= 0.08 * len(unit):
        return name("code")
    n = len(words)
    own = list(zip(words, words[1:], strict=False))
    again = sum(map(often.__contains__, own)) / max(1, len(own)) if often else 0.0
    stop = bool(_END.search(unit))
    joined = not plain and _NO_SPACE.search(unit) is not None
    few = len(set(own)) < 0.5 * len(own)  # function words are judged in Latin script only
    if stop and joined or stop and not plain and n >= 3 and 3 * len(_LATIN.findall(unit)) < 2 * sum(map(len, words)):
        items = [x for x in _LIST.split(unit) if x.strip()] if joined else ()
        return name("repeated") if n >= 8 and few else name("items_list") if len(items) >= 5 and n / len(items) <= 6 else name("sentence")
    function = sum(map(FUNCTION_WORDS.__contains__, words)) / max(1, n)
    bars = [x for x in _BARS.split(unit) if x.strip()] if "\t" in unit or any(c in unit for c in "|•·»›>/") else ()
    items = [x for x in _LIST.split(unit) if x.strip()] if any(c in unit for c in ",;、،") else ()
    size = n if not joined else n / 2
    if len(bars) >= 4 and size / len(bars) <= 3.5:
        return name("items_bar")
    if len(items) >= 3 and size / len(items) <= 4 and function < 0.12 and not (stop and n >= 8 and len(items) < 4):
        return name("repeated") if n >= 8 and again > 0.8 and len(set(words)) < 0.25 * n else name("items_list")
    if n >= 8 and function < 0.15 and (len(set(words)) < 0.5 * n and not joined or few and joined or again > 0.6):
        return name("repeated")
    if n <= 7 and not stop and own and function < 0.3 and max(map(pairs.__getitem__, own)) >= 5:
        return name("repeated_short")
    if n <= 3:
        return name("short_stop") if stop else name("short")
    if stop:
        return name("sentence")
    return name("phrase") if function >= 0.12 or n >= 9 else name("short")


UNITS = "doc_id long, symbols binary, words array<int>, chars array<int>"


def page_units(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per page with text: the symbols of its units, and their words and characters."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, counts, sizes = [], [], []
            for t in batch.column(1).to_pylist():
                parts, words, pairs, often = _page(t)
                marks.append(bytes(symbol(u, f, w, pairs, often) for (u, f), w in zip(parts, words, strict=True)))
                counts.append([max(1, len(u.split()), len(w) if u.isascii() or not _NO_SPACE.search(u) else len(u) // 2) for (u, _), w in zip(parts, words, strict=True)])
                sizes.append([len(u) for u, _ in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), pa.array(counts, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], ["doc_id", "symbols", "words", "chars"])

    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null and text rlike '\\\\S'")
    return given.mapInArrow(per_task, UNITS)


def start_model() -> tuple[np.ndarray, np.ndarray]:
    n = len(STATES)
    moves = np.full((n, n), (1 - STAY) / (n - 1)) + np.eye(n) * (STAY - (1 - STAY) / (n - 1))
    return START / START.sum(1, keepdims=True), moves


def viterbi(symbols: bytes, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The likeliest labels; ``emit`` and ``move`` are log tables."""
    seen = np.frombuffer(symbols, np.uint8)
    if not len(seen):
        return np.empty(0, np.int64)
    score = emit[:, seen[0]].copy()
    back = np.empty((len(seen), len(score)), np.int8)
    for t in range(1, len(seen)):
        via = score[:, None] + move
        back[t] = via.argmax(0)
        score = via.max(0) + emit[:, seen[t]]
    path = np.empty(len(seen), np.int64)
    path[-1] = score.argmax()
    for t in range(len(seen) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def train(pages: DataFrame, rounds: int = 1, weight: float = 1000.0) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi training over all pages. The starting tables count as ``weight`` units a label and the corpus as at most four times
    as many, however large: each row of the model is a mixture with at most 0.8 of the corpus, so that a corpus refines the model,
    a small one leaves it as it is, and the most frequent label does not drown what the tables say of rare symbols."""
    emit, move = start_model()
    n, m = len(STATES), len(SYMBOLS)
    for _ in range(rounds):
        log_emit, log_move = np.log(emit), np.log(move)

        def per_task(batches, log_emit=log_emit, log_move=log_move):
            total = np.zeros((n, m + n), np.int64)
            for batch in batches:
                for data in batch.column(1).to_pylist():
                    path = viterbi(data, log_emit, log_move)
                    np.add.at(total, (path, np.frombuffer(data, np.uint8)), 1)
                    np.add.at(total, (path[:-1], m + path[1:]), 1)
            cells = [(i, j, int(total[i, j])) for i in range(n) for j in range(m + n) if total[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array([c[2] for c in cells], pa.int64())], ["i", "j", "c"])

        counts = np.zeros((n, m + n))
        for r in pages.mapInArrow(per_task, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect():
            counts[r.i, r.j] = r.c
        counts *= np.minimum(1.0, 4 * weight / np.maximum(1, counts[:, :m].sum(1, keepdims=True)))
        start_emit, start_move = start_model()
        emit = start_emit * weight + counts[:, :m]
        move = start_move * weight + counts[:, m:]
        emit, move = emit / emit.sum(1, keepdims=True), move / move.sum(1, keepdims=True)
    return emit, move


def page_shares(pages: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, spam_share`` and the share of words of every label."""
    log_emit, log_move = np.log(model[0]), np.log(model[1])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spam, shares = [], []
            for data, words, chars in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                path = viterbi(data, log_emit, log_move)
                by = np.bincount(path, weights=words, minlength=len(STATES)) / max(1, sum(words))
                by_chars = np.bincount(path, weights=chars, minlength=len(STATES)) / max(1, sum(chars))
                spam.append(float((by[2:].sum() + by_chars[2:].sum()) / 2))
                shares.append([float(x) for x in by])
            cells = [pa.array([s[i] for s in shares], pa.float64()) for i in range(len(STATES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spam, pa.float64()), *cells], ["doc_id", "spam_share", *STATES])

    return pages.mapInArrow(per_task, "doc_id long, spam_share double, " + ", ".join(f"{s} double" for s in STATES))
