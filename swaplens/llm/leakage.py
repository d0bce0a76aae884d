"""Evaluation passages that leaked into a training corpus, whole or in part.

Latent semantic retrieval over passages (windows of words), with exact checks after it:

1. ``gather`` reads and tokenises every document once: in how many documents each word of the items occurs, and the
   documents with a window of which at least ``KNOWN`` are words of the items, as word codes, in a written table.
2. ``latent_basis`` is a randomised SVD of the TF-IDF matrix of those windows and of all item windows over the items' words:
   each task sends one small words x rank block, and a Nystroem step turns the sum into singular values and vectors.
3. ``build_index`` sorts the item windows, as vectors of the latent space, into the cells of an inverted file.
4. ``search`` projects every window and takes the item windows with a cosine of at least ``cosine`` in its ``PROBES`` nearest
   cells. Each candidate is then checked by aligning the words of the document and of the item (longest common subsequence of
   a connected passage, with single replaced, dropped or misspelt words), and the item's answer is looked for beside it.

A candidate is left out before alignment only if too few of the window's words are, exactly or misspelt, the item's: a count that
follows from what ``leaked`` accepts and depends neither on the number of documents nor on that of items. Words that no item
has carry no weight, so replaced words that are new don't lower a cosine, however large the corpus.

The items are the stated query set. They are broadcast in blocks of at most ``BLOCK`` words, so what a task holds is bounded by
``BLOCK`` alone (about 0.1 GB); more items mean more passes. What many items share is counted over all items, not
in a block. No document is compared with another; nothing is sampled or capped.

Defined results: null and empty texts hold nothing; an item with fewer than ``WORDS`` words must be there
as a whole (and has at least 8); items alike are reported each; repeated documents are reported each; a sentence that many
items share is not a passage of any.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaplens.sources.tables import written

WORDS = 20
STEP = 5
RANK = 128
#: A window is looked at if this share of its words are words of the items.
KNOWN = 0.6
#: It is aligned with an item if this share of them are, exactly or misspelt, the item's: of 21 words with 16 in the item, the
#: nearest window, at most two words off, holds 13.
OVERLAP = 0.65
#: Words of the items in one block: about 20,000 items.
BLOCK = 1_600_000
#: Cells of the inverted file that a window is compared with.
PROBES = 12
#: A word in more than this share of documents has no weight.
COMMON = 0.15
#: Characters that are tokenised at once.
CHUNK = 4_000_000

_MARKUP = re.compile(r"<[^<>\x01]{0,300}>|&(?:nbsp|amp|lt|gt|quot|#\d+);|\x1b\[[0-9;]*m")
_HYPHEN = re.compile(r"-[^\S\n\x01]*\n[^\S\x01]*")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_TOKEN = re.compile(r"[^\W_]+|\x01")
_MARKS = regex.compile(r"\p{Mn}+")
_PLAIN = str.maketrans({chr(i): chr(i).lower() if chr(i).isalnum() or i == 1 else " " for i in range(128)})
END = "\x01"


def flat_words(texts: list[str]) -> list[str]:
    """The words of all texts without case, accents, markup, punctuation and invisible characters; ``END`` closes each text."""
    whole = END.join(t.replace(END, " ") for t in texts) + END
    if "<" in whole or "&" in whole or "\x1b" in whole:
        whole = _MARKUP.sub(" ", whole)
    if whole.isascii():
        return _HYPHEN.sub("", whole).translate(_PLAIN).replace(END, f" {END} ").split()
    whole = unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFKD", _HIDDEN.sub("", whole))))
    return _TOKEN.findall(_HYPHEN.sub("", whole).casefold())


def words_of(text: str) -> list[str]:
    return flat_words([text])[:-1]


def _chunks(ids: list, texts: list) -> Iterator[tuple[list, list[str]]]:
    """Texts that are not empty, ASCII ones apart, some million characters at a time: (ids, texts)."""
    for ascii_only in (True, False):
        some_ids, some, size = [], [], 0
        for i, t in zip(ids, texts, strict=True):
            if t and t.isascii() == ascii_only:
                some_ids.append(i)
                some.append(t)
                size += len(t)
                if size > CHUNK:
                    yield some_ids, some
                    some_ids, some, size = [], [], 0
        if some:
            yield some_ids, some


@dataclass
class Items:
    """A block of evaluation items ready for search."""

    ids: list[int]
    words: list[list[str]]
    answers: list[list[str]]
    counted: list[np.ndarray]
    codes: dict[str, int]  # of the counted words; END is -2
    coded: list[np.ndarray]  # codes of the items' words, -1 for those not counted
    pairs: np.ndarray  # item x words + code of every counted word, sorted
    near: dict[tuple[str, int], tuple[list[str], np.ndarray]]  # words by first or last letter and length, with their letters
    weights: np.ndarray | None = None
    scaled: np.ndarray | None = None  # weight x latent vector of each code; the last row, of code -1, is zero
    centres: np.ndarray | None = None
    cells: np.ndarray | None = None  # where the windows of a cell start
    windows: np.ndarray | None = None
    owner: np.ndarray | None = None

    @property
    def size(self) -> int:
        return len(self.codes) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.array([int(own.sum()) for own in self.counted], np.int64)

    def least(self, share: float) -> np.ndarray:
        """How many words a window has in each item at least, if it has ``share`` of its words there or is the whole item."""
        return np.minimum(share * WORDS, 0.85 * self.sizes)

    def shared(self, windows: np.ndarray, items: np.ndarray) -> np.ndarray:
        """How many words of each window (a row of codes) are the item's."""
        if not len(self.pairs) or not len(items):
            return np.zeros(len(items), np.int64)
        keys = items[:, None] * self.size + windows
        found = self.pairs[np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)] == keys
        return (found & (windows >= 0)).sum(1)


def _letters(word: str) -> int:
    """The set of a word's letters, as bits."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) % 61)
    return bits


def shared_grams(evals: DataFrame, text: str, share: float = 0.03, least: int = 5) -> frozenset[str]:
    """The runs of five words in at least ``share`` of all items (and ``least``). There are at most 1/share times as many as an
    item has on average."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = []
            for t in batch.column(0).to_pylist():
                w = words_of(t or "")
                grams += {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 8 else ()
                grams += [""] * (len(w) >= 8)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string())], ["gram"])

    counts = evals.select(text).mapInArrow(per_task, "gram string").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    total = counts.where("gram = ''").select(F.max("n").alias("m"))
    many = F.greatest(F.lit(least), F.round(share * F.col("m")))
    return frozenset(r.gram for r in counts.where("gram <> ''").join(F.broadcast(total)).where(F.col("n") >= many).select("gram").collect())


def prepare_items(rows: list[tuple], common: frozenset[str] = frozenset()) -> Items:
    """``rows``: (item_id, text, answer); ``common``: the runs of words that many items share."""
    known = [(i, words_of(t), words_of(a or "")) for i, t, a in rows if t]
    known = [(i, w, a) for i, w, a in known if len(w) >= 8]
    counted = []
    for _, w, _ in known:
        own = np.ones(len(w), bool)
        for k in range(len(w) - 4) if common else ():
            if " ".join(w[k : k + 5]) in common:
                own[k : k + 5] = False
        counted.append(own)
    codes: dict[str, int] = {}
    coded = []
    for (_, w, _), own in zip(known, counted, strict=True):
        coded.append(np.array([codes.setdefault(x, len(codes)) if ok else -1 for x, ok in zip(w, own.tolist(), strict=True)], np.int64))
    size = len(codes)
    owners = np.repeat(np.arange(len(known)), [len(c) for c in coded]) if known else np.zeros(0, np.int64)
    flat = np.concatenate(coded) if known else np.zeros(0, np.int64)
    pairs = np.unique((owners * size + flat)[flat >= 0])
    near: dict[tuple[str, int], list[str]] = {}
    for x in codes:
        if len(x) >= 4 and not x.isdigit():
            near.setdefault((x[0], len(x)), []).append(x)
            near.setdefault((x[-1] + "$", len(x)), []).append(x)
    codes[END] = -2
    return Items([k[0] for k in known], [k[1] for k in known], [k[2] for k in known], counted, codes, coded, pairs, {k: (v, np.array([_letters(x) for x in v])) for k, v in near.items()})


def gather(docs: DataFrame, doc_id: str, text: str, items: Items) -> DataFrame:
    """A written table of one pass over all texts, in two kinds of rows: ``code, n`` (documents with a word, per task; code -1: all
    documents), and ``doc_id, words, codes`` of the documents that may hold a passage."""
    held = docs.sparkSession.sparkContext.broadcast((items.codes, float(items.least(KNOWN).min(initial=WORDS)), items.size))
    names = ["kind", "code", "n", "doc_id", "words", "codes"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, least, size = held.value
        counts, total = np.zeros(size, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for ids, texts in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = flat_words(texts)
                codes = np.fromiter(map(table.get, words, repeat(-1)), np.int64, len(words))
                ends = np.flatnonzero(codes == -2)
                doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[-1, ends]))
                known = codes >= 0
                counts += np.bincount(np.unique(doc[known] * size + codes[known]) % max(1, size), minlength=size)
                run = np.r_[0, np.cumsum(known)]
                first = np.r_[0, ends[:-1] + 1]
                start = np.arange(len(codes))
                stop = np.minimum(start + WORDS, ends[doc])
                inside = (run[stop] - run[start] >= max(1, least)) & ((stop == start + WORDS) | (start == first[doc]))
                chosen = np.unique(doc[inside]).tolist()
                rows = [(" ".join(words[first[d] : ends[d]]), codes[first[d] : ends[d]]) for d in chosen]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(["doc"] * n, kinds[0]), pa.nulls(n, kinds[1]), pa.nulls(n, kinds[2]), pa.array([ids[d] for d in chosen], kinds[3]), pa.array([r[0] for r in rows], kinds[4]), pa.array([r[1] for r in rows], kinds[5])], names)
        seen = np.flatnonzero(counts)
        n = len(seen) + 1
        yield pa.RecordBatch.from_arrays([pa.array(["count"] * n, kinds[0]), pa.array(np.r_[-1, seen], kinds[1]), pa.array(np.r_[total, counts[seen]], kinds[2]), pa.nulls(n, kinds[3]), pa.nulls(n, kinds[4]), pa.nulls(n, kinds[5])], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(per_task, "kind string, code int, n long, doc_id long, words string, codes array<int>")
    return written(rows, "kind")


def with_weights(items: Items, gathered: DataFrame) -> Items:
    """Inverse document frequencies of the items' words, over all documents."""
    found = gathered.where("kind = 'count'").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(items.size + 1)
    counts[found["code"].to_numpy(np.int64)] = found["n"].to_numpy()
    return weighted(items, counts[:-1], counts[-1])


def weighted(items: Items, counts: np.ndarray, total: float) -> Items:
    weights = np.maximum(np.log((total + 1) / (counts + 1.0)), 0.0)
    weights[counts > COMMON * max(total, 1)] = 0.0
    items.weights = weights
    return items


def _places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts of these lengths that lie one after another: (first word, end, text)."""
    ends = np.cumsum(lengths)
    many = np.maximum(1, -(-(lengths - WORDS + STEP) // STEP)) * (lengths > 0)
    text = np.repeat(np.arange(len(lengths)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = (ends - lengths)[text] + nth * STEP
    return start, np.minimum(start + WORDS, ends[text]), text


def _rows(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The windows as rows of WORDS codes, filled up with -1."""
    at = start[:, None] + np.arange(WORDS)
    return np.where(at < stop[:, None], codes[np.minimum(at, len(codes) - 1)], -1)


def _spread(rows: np.ndarray, scaled: np.ndarray, weights: np.ndarray, total: np.ndarray) -> None:
    """Adds A'A x (test matrix) of these windows to ``total``; ``scaled`` is weights x test matrix, and both end with a zero row."""
    for low in range(0, len(rows), 512):
        part = rows[low : low + 512]
        got = scaled[part[:, 0]]
        for j in range(1, WORDS):
            got = got + scaled[part[:, j]]
        got /= np.maximum((weights[part] ** 2).sum(1), 1e-9)[:, None]
        flat = part.ravel()
        order = np.argsort(flat, kind="stable")
        marks = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0])
        sums = np.add.reduceat(got[order // WORDS], marks, axis=0)
        codes = flat[order][marks]
        total[codes] += sums * weights[codes][:, None]


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[row] = sums.get(row, 0.0) + part.values.to_numpy().astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["row", "part"])


def latent_basis(gathered: DataFrame, items: Items, rank: int = RANK, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(words x rank, singular values): the first right singular vectors of the passages' TF-IDF matrix A, by a randomised SVD in
    one pass. With a test matrix T, the tasks add up Y = A'A T; the Nystroem form Y (T'Y)^-1 Y' of A'A then gives vectors and values."""
    size = items.size
    wide = min(rank + 16, size)
    if not size:
        return np.zeros((0, 0)), np.zeros(0)
    least = max(1.0, float(items.least(KNOWN).min(initial=WORDS)))
    test = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, wide)))[0]
    weights = np.r_[items.weights, 0.0].astype(np.float32)
    held = gathered.sparkSession.sparkContext.broadcast((np.vstack([test, np.zeros(wide)]).astype(np.float32) * weights[:, None], weights))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, weights = held.value
        total = np.zeros(scaled.shape, np.float32)
        for batch in batches:
            codes = batch.column(0).flatten().to_numpy().astype(np.int64)
            start, stop, _ = _places(batch.column(0).value_lengths().to_numpy().astype(np.int64))
            rows = _rows(codes, start, stop)
            _spread(rows[(rows >= 0).sum(1) >= least], scaled, weights, total)
        used = np.flatnonzero(np.abs(total).sum(1))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * wide, pa.int32()), pa.array(total[used].ravel(), pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), values], ["row", "part"])

    total = np.zeros((size + 1, wide))
    flat = np.concatenate(items.coded)
    start, stop, _ = _places(np.array([len(c) for c in items.coded]))
    _spread(_rows(flat, start, stop), held.value[0].astype(np.float64), weights.astype(np.float64), total)
    blocks = gathered.where("kind = 'doc'").select("codes").mapInArrow(per_task, "row int, part array<float>")
    for r in blocks.repartition("row").mapInArrow(_add_rows, "row int, part array<double>").collect():
        total[r.row] += np.array(r.part)
    return nystroem(total[:-1], test, rank)


def nystroem(product: np.ndarray, test: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and roots of the eigenvalues of a positive matrix G, given G x test."""
    shift = 1e-7 * max(np.linalg.norm(product), 1e-30)
    shifted = product + shift * test
    core = test.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-9 * max(values.max(), 1e-30)))
    left, found, _ = np.linalg.svd(shifted @ root, full_matrices=False)
    return left[:, :rank], np.sqrt(np.maximum(found**2 - shift, 0.0))[:rank]


def _project(rows: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """Unit vectors of windows in the latent space."""
    got = scaled[rows[:, 0]]
    for j in range(1, WORDS):
        got = got + scaled[rows[:, j]]
    return got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)


def build_index(items: Items, basis: np.ndarray, rounds: int = 8, seed: int = 7) -> Items:
    """All item windows in the cells of an inverted file, about two cells a root of their number (spherical k-means over all)."""
    weights = np.r_[items.weights, 0.0]
    items.scaled = (np.vstack([basis, np.zeros(basis.shape[1])]) * weights[:, None]).astype(np.float32)
    if not items.size:
        return items
    start, stop, owner = _places(np.array([len(c) for c in items.coded]))
    vectors = _project(_rows(np.concatenate(items.coded), start, stop), items.scaled)
    centres = vectors[np.random.default_rng(seed).permutation(len(vectors))[: max(1, int(2 * len(vectors) ** 0.5))]]
    for _ in range(rounds):
        cell = _nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-12), centres)
    cell = _nearest(vectors, centres)
    order = np.argsort(cell, kind="stable")
    items.centres, items.cells = centres, np.searchsorted(cell[order], np.arange(len(centres) + 1))
    items.windows, items.owner = vectors[order], owner[order]
    return items


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(vectors[k : k + 4096] @ centres.T).argmax(1) for k in range(0, len(vectors), 4096)])


def _highest(window: np.ndarray, item: np.ndarray, likeness: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of window and item once, at its highest cosine."""
    order = np.lexsort((-likeness, item, window))
    window, item, likeness = window[order], item[order], likeness[order]
    first = np.r_[True, (np.diff(window) != 0) | (np.diff(item) != 0)] if len(window) else np.zeros(0, bool)
    return window[first], item[first], likeness[first]


def nearest_items(vectors: np.ndarray, items: Items, cosine: float, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, cosine): the items with a window this near to each vector, of the ``probes`` nearest cells."""
    likeness = vectors @ items.centres.T
    many = min(probes, likeness.shape[1])
    chosen = np.argpartition(-likeness, many - 1, axis=1)[:, :many]
    cell = chosen.ravel()
    order = np.argsort(cell, kind="stable")
    who = np.repeat(np.arange(len(vectors)), many)[order]
    bounds = np.searchsorted(cell[order], np.arange(len(items.centres) + 1))
    found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for c in np.flatnonzero(np.diff(bounds)):
        inside = slice(items.cells[c], items.cells[c + 1])
        mine = who[bounds[c] : bounds[c + 1]]
        close = vectors[mine] @ items.windows[inside].T
        row, column = np.nonzero(close >= cosine)
        found.append((mine[row], items.owner[inside][column], close[row, column]))
    return _highest(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _alike(a: str, b: str) -> bool:
    """Misspelt: at most one change (two from eight letters) between words of four letters or more."""
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 2 or a.isdigit() or b.isdigit():
        return False
    most = 2 if max(len(a), len(b)) >= 8 else 1
    previous = list(range(len(b) + 1))
    two = None
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return False
        two, previous = previous, row
    return previous[-1] <= most


def best_scores(texts: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """The scores of the best local alignments of many pairs at once: (words, 2) codes with codes of an item.

    A match counts 1, a replaced word -1.2, a dropped or added one -0.8."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda k: (len(texts[k]), len(items[k])))
    for low in range(0, len(order), 256):
        part = order[low : low + 256]
        text, item = _padded([texts[k] for k in part], [items[k] for k in part])
        costs = (0.8 * np.arange(item.shape[1] + 1)).astype(np.float32)
        score = np.zeros((len(part), item.shape[1] + 1), np.float32)
        best = np.zeros(len(part), np.float32)
        for word in text:
            gain = np.where((item == word[:, :1]) | (item == word[:, 1:]), np.float32(1), np.float32(-1.2))
            gain += score[:, :-1]
            score -= np.float32(0.8)
            np.maximum(score[:, 1:], gain, out=score[:, 1:])
            np.maximum(score, 0, out=score)
            score += costs
            np.maximum.accumulate(score, axis=1, out=score)
            score -= costs
            np.maximum(best, score.max(1), out=best)
        out[part] = best
    return out


def _padded(texts: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    text = np.full((max(map(len, texts)), len(texts), 2), -1, np.int32)
    item = np.full((len(items), max(map(len, items))), -3, np.int32)
    for r, (t, i) in enumerate(zip(texts, items, strict=True)):
        text[: len(t), r] = t
        item[r, : len(i)] = np.where(i < 0, -3, i)
    return text, item


def paths(texts: list[np.ndarray], items: list[np.ndarray], used: list[set[tuple[int, int]]] | None = None) -> list[list[tuple[int, int]]]:
    """Of many pairs at once the matched places (in the text, in the item) of the best alignment, without the pairs ``used``."""
    out: list[list[tuple[int, int]]] = [[]] * len(texts)
    order = sorted(range(len(texts)), key=lambda k: (len(texts[k]), len(items[k])))
    low = 0
    while low < len(order):
        part = [order[low]]
        while low + len(part) < len(order) and (len(part) + 1) * len(texts[order[low + len(part)]]) * len(items[order[low + len(part)]]) < 8_000_000:
            part.append(order[low + len(part)])
        low += len(part)
        text, item = _padded([texts[k] for k in part], [items[k] for k in part])
        n, m = len(part), item.shape[1]
        costs = (0.8 * np.arange(m + 1)).astype(np.float32)
        score = np.zeros((n, m + 1), np.float32)
        best, end = np.zeros(n, np.float32), np.zeros((n, 2), np.int64)
        moves = np.zeros((len(text) + 1, n, m + 1), np.int8)  # 1 both, 2 a word of the text, 3 a word of the item, 4 a match, 0 starts here
        for t, word in enumerate(text, 1):
            same = (item == word[:, :1]) | (item == word[:, 1:])
            for r, k in enumerate(part) if used else ():
                same[r, [j for i, j in used[k] if i == t - 1]] = False
            both = np.where(same, np.float32(1), np.float32(-1.2)) + score[:, :-1]
            up = score - np.float32(0.8)
            new = np.maximum(up, 0)
            np.maximum(new[:, 1:], both, out=new[:, 1:])
            move = np.where(up[:, 1:] > both, 2, np.where(same, 4, 1)).astype(np.int8)
            moves[t, :, 1:] = np.where(new[:, 1:] <= 0, 0, move)
            score = np.maximum.accumulate(new + costs, axis=1) - costs
            moves[t][score > new + 1e-4] = 3
            k = score.argmax(1)
            top = score[np.arange(n), k]
            better = top > best + 1e-4
            best[better], end[better] = top[better], np.c_[np.full(n, t), k][better]
        for r, k in enumerate(part):
            (i, j), found = end[r].tolist(), []
            while move := int(moves[i, r, j]):
                if move == 4:
                    found.append((i - 1, j - 1))
                i, j = i - (move != 3), j - (move != 2)
            out[k] = found[::-1]
    return out


def _extent(path: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """(matched words, length in the item, start, end in the text)."""
    return (len(path), path[-1][1] - path[0][1] + 1, path[0][0], path[-1][0] + 1) if path else (0, 0, 0, 0)


#: A passage counts with so many matched words, over so many words of the item, and this share of them,
LEAST, PASSAGE, DENSE = 16, 18, 0.75
#: and its alignment scores so much: 16 matches with six words of the item or of the text between them replaced, dropped or added.
SCORE = 8.0


def _accepted(matched: int, passage: int, item_words: int) -> bool:
    return (item_words < WORDS and matched >= 0.85 * item_words) or (matched >= LEAST and passage >= PASSAGE and matched >= DENSE * passage)


def _part(path: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
    """The longest part of a path that counts by itself."""
    at = np.array([j for _, j in path])
    for n in range(len(path), LEAST - 1, -1):
        spans = at[n - 1 :] - at[: len(at) - n + 1] + 1
        fit = np.flatnonzero((spans >= PASSAGE) & (n >= DENSE * spans))
        if len(fit):
            return _extent(path[fit[0] : fit[0] + n])
    return None


def best_passages(texts: list[np.ndarray], items: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """Of many pairs at once the extent of the best connected passage, and of all passages and their parts one that counts, if there
    is one: a path that fails as a whole may hold a part that doesn't, and without its pairs other paths come to light,
    until no path has enough words."""
    out: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)] * len(texts)
    used: list[set[tuple[int, int]]] = [set() for _ in texts]
    left = list(range(len(texts)))
    again = False
    while left:
        found = paths([texts[k] for k in left], [items[k] for k in left], [used[k] for k in left] if again else None)
        more = []
        for k, path in zip(left, found, strict=True):
            got = _extent(path)
            if not again:
                out[k] = got
            if _accepted(got[0], got[1], int((items[k] >= 0).sum())):
                out[k] = got
            elif part := _part(path):
                out[k] = part
            elif len(path) >= LEAST:
                used[k] |= set(path)
                more.append(k)
        left, again = more, True
    return out


def _stretches(low: int, high: int, reach: int) -> Iterator[tuple[int, int]]:
    """Words ``low`` to ``high`` in overlapping stretches of some thousand words, so that an alignment stays small."""
    length = max(2048, 4 * reach)
    while high - low > length:
        yield low, low + length
        low += length - 2 * reach
    yield low, high


LEAKS = "doc_id long, item_id long, matched int, passage int, item_words int, answer_near boolean, cosine double"


class _Search:
    """Candidates and alignments of one task."""

    def __init__(self, items: Items, cosine: float):
        self.items, self.cosine = items, cosine
        self.some, self.known = items.least(OVERLAP), max(1.0, items.least(KNOWN).min(initial=WORDS))
        self.spelt: dict[str, tuple[int, int]] = {}

    def misspelt(self, word: str) -> tuple[int, int]:
        """The codes of at most two items' words that ``word``, itself none of them, may be a misspelling of, else -1."""
        close: set[str] = set()
        if len(word) >= 4 and not word.isdigit():
            bits = _letters(word)
            for n in range(len(word) - 2, len(word) + 3):
                for end in (word[0], word[-1] + "$"):
                    if found := self.items.near.get((end, n)):
                        close |= {found[0][k] for k in np.flatnonzero(np.bitwise_count(found[1] ^ bits) <= 4)}
        codes = [self.items.codes[x] for x in sorted(close) if _alike(word, x)]
        return (*codes, -1, -1)[:2]

    def meant(self, words: list[str], codes: np.ndarray) -> np.ndarray:
        """Codes of what each word may stand for: (words, 2), the word's own or those of which it may be a misspelling."""
        out = np.full((len(words), 2), -1, np.int32)
        out[:, 0] = codes
        unknown = np.flatnonzero(codes < 0)
        spelt, found = self.spelt, []
        for w in map(words.__getitem__, unknown.tolist()):
            if (got := spelt.get(w)) is None:
                if len(spelt) > 500_000:
                    spelt.clear()
                got = spelt[w] = self.misspelt(w)
            found.append(got)
        if found:
            out[unknown] = found
        return out

    def candidates(self, codes: np.ndarray, lengths: np.ndarray, words: Callable[[int], list[str]]) -> Iterator[tuple[int, int, int, float]]:
        """(text, item, place of the window, cosine); ``words`` gives those of a text."""
        items = self.items
        start, stop, text = _places(lengths)
        begins = np.cumsum(lengths) - lengths
        for low in range(0, len(start), 8192):
            part = slice(low, low + 8192)
            rows = _rows(codes, start[part], stop[part])
            near = np.flatnonzero((rows >= 0).sum(1) >= self.known)
            if not len(near):
                continue
            rows, first, last, owner = rows[near], start[part][near], stop[part][near], text[part][near]
            window, item, likeness = nearest_items(_project(rows, items.scaled), items, self.cosine)
            exact = items.shared(rows[window], item)
            sure = exact >= self.some[item]
            unknown = (last - first) - (rows >= 0).sum(1)
            for k in np.flatnonzero(~sure & (exact + unknown[window] >= self.some[item])):
                w = window[k]
                at = int(first[w] - begins[owner[w]])
                meant = self.meant(words(int(owner[w]))[at : at + int(last[w] - first[w])], codes[first[w] : last[w]])
                own = items.coded[item[k]]
                sure[k] = (np.isin(meant, own[own >= 0]).any(1)).sum() >= self.some[item[k]]
            for w, i, c in zip(window[sure].tolist(), item[sure].tolist(), likeness[sure].tolist(), strict=True):
                yield int(owner[w]), i, int(first[w] - begins[owner[w]]), c

    def regions(self, words: int, item: int, places: list[int]) -> Iterator[tuple[int, int]]:
        """The stretches of a text around the given windows that an alignment with the item has to read."""
        reach = len(self.items.words[item]) + WORDS
        for a, b in _groups(sorted(set(places)), reach):
            yield from _stretches(max(0, a - reach), min(words, b + WORDS + reach), reach)

    def passages(self, spots: dict[tuple[int, int], list[int]], codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, words: Callable[[int], list[str]]) -> Iterator[tuple]:
        """((text, item), best passage) of the pairs of ``spots`` whose best alignment scores enough."""
        waiting: list[tuple] = []
        held = 0
        for d, i in sorted(spots):
            for start, end in self.regions(int(lengths[d]), i, spots[d, i]):
                at = int(begins[d])
                waiting.append(((d, i), start, self.meant(words(d)[start:end], codes[at + start : at + end])))
                held += end - start
            if held > 500_000:
                yield from self._judged(waiting)
                waiting, held = [], 0
        yield from self._judged(waiting)

    def _judged(self, waiting: list[tuple]) -> Iterator[tuple]:
        texts, items = [w[2] for w in waiting], [self.items.coded[w[0][1]] for w in waiting]
        scores = best_scores(texts, items)
        good = [k for k, x in enumerate(scores.tolist()) if x >= min(SCORE, 0.5 * len(items[k]))]
        best: dict[tuple[int, int], tuple] = {}
        for k, got in zip(good, best_passages([texts[k] for k in good], [items[k] for k in good]), strict=True):
            pair, start, _ = waiting[k]
            size = int((items[k] >= 0).sum())
            if pair not in best or (_accepted(got[0], got[1], size), got[0]) > (_accepted(best[pair][0], best[pair][1], size), best[pair][0]):
                best[pair] = (got[0], got[1], got[2] + start, got[3] + start)
        yield from best.items()


def _groups(places: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Runs of sorted places with at most ``reach`` between them: (first, last)."""
    first = last = places[0]
    for p in places[1:]:
        if p - last > reach:
            yield first, last
            first = p
        last = p
    yield first, last


def search(gathered: DataFrame, items: Items, cosine: float = 0.65) -> DataFrame:
    """Every (document, item) with a candidate passage, aligned: a passage that counts before a longer one that doesn't; map-only."""
    held = gathered.sparkSession.sparkContext.broadcast(items)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64())

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        task = _Search(items, cosine)
        for batch in batches:
            rows = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            codes = batch.column(2).flatten().to_numpy().astype(np.int64)
            lengths = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            begins = np.cumsum(lengths) - lengths
            split: dict[int, list[str]] = {}

            def words(d: int, split=split, texts=texts) -> list[str]:
                if d not in split:
                    split.clear()
                    split[d] = texts[d].split(" ")
                return split[d]

            spots: dict[tuple[int, int], list[int]] = {}
            nearest: dict[tuple[int, int], float] = {}
            if items.size:
                for d, i, place, c in task.candidates(codes, lengths, words):
                    spots.setdefault((d, i), []).append(place)
                    nearest[d, i] = max(c, nearest.get((d, i), -1.0))
            for (d, i), best in task.passages(spots, codes, begins, lengths, words):
                text = words(d)
                answer = items.answers[i]
                around = text[max(0, best[2] - 30) : best[3] + 30]
                near = bool(answer) and any(around[p : p + len(answer)] == answer for p in range(len(around) - len(answer) + 1))
                rows.append((ids[d], items.ids[i], best[0], best[1], int(items.counted[i].sum()), near, nearest[d, i]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in LEAKS.split(", ")])

    return gathered.where("kind = 'doc'").select("doc_id", "words", "codes").mapInArrow(per_task, LEAKS)


def candidates(docs: DataFrame, doc_id: str, text: str, evals: DataFrame, item_id: str, item_text: str, answer: str) -> DataFrame:
    """``LEAKS`` rows of all items, block by block."""
    chosen = evals.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"), F.col(answer).alias("a"))
    common = shared_grams(chosen, "t")
    spaces = chosen.select(F.sum(F.length("t") / 5 + 1).alias("n")).first().n or 0
    blocks = max(1, -(-int(spaces) // BLOCK))
    out = None
    for block in range(blocks):
        rows = [tuple(r) for r in chosen.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).orderBy("i").collect()]
        items = prepare_items(rows, common)
        gathered = gather(docs, doc_id, text, items)
        items = with_weights(items, gathered)
        items = build_index(items, latent_basis(gathered, items)[0])
        part = search(gathered, items)
        out = part if out is None else out.unionByName(part)
    return out


def leaked(found: DataFrame, least: int = LEAST, passage: int = PASSAGE) -> DataFrame:
    """``doc_id, item_id``: the whole item, or a connected passage of about twenty of its words."""
    whole = (F.col("item_words") < WORDS) & (F.col("matched") >= 0.85 * F.col("item_words"))
    part = (F.col("matched") >= least) & (F.col("passage") >= passage) & (F.col("matched") >= DENSE * F.col("passage"))
    return found.where(whole | part).select("doc_id", "item_id").distinct()
