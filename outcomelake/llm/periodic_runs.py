"""Runs of repeated word sequences by the linear tandem-repeat method on suffix structures.

A text is a sequence of word numbers. Its Lempel-Ziv blocks give squares (a root written twice) that cover the
leftmost occurrence of every square; walks along suffix links from these complete the vocabulary of squares; all
occurrences of the vocabulary, read from the suffix tree's leaves, merge into the maximal runs.

The suffix tree is kept in arrays: the order of suffixes, the common prefixes of neighbours, and for each power of
two the classes of equal substrings of that length. A place in the tree is an interval of the suffix order with a
depth; its suffix link is the place of the same substring without its first word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of several texts that are worked on as one sequence; a longer text is a sequence of its own.
CHUNK_WORDS = 1 << 17
#: Extensions asked for at once.
QUERIES = 1 << 18


class SuffixTree:
    """Suffix order, common prefixes and substring classes of a sequence whose last symbol stands nowhere else."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        _, first = np.unique(symbols, return_inverse=True)
        self.symbols = first.astype(np.int64)
        self.classes: list[np.ndarray] = []
        ranks, width = self.symbols, 1
        while True:
            self.classes.append(ranks.astype(np.int32))
            if int(ranks.max()) + 1 == n:
                break
            key = ranks * (n + 1)
            key[: n - width] += ranks[width:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.empty(n, dtype=np.int64)
            fresh[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            ranks, width = fresh, 2 * width
        self.rank = ranks
        self.order = np.argsort(ranks)
        self.common = np.zeros(n + 1, dtype=np.int32)  # of neighbours r - 1 and r; 0 at both ends
        if n > 1:
            self.common[1:n] = self.forward(self.order[:-1], self.order[1:])
        self.least = [self.common]  # least[l][r]: the least common prefix of r .. r + 2 ** l - 1
        while 2 << (len(self.least) - 1) <= n + 1:
            half = 1 << (len(self.least) - 1)
            last = self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the sequence reads alike from the different positions ``a`` and ``b`` on."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.classes) - 1, -1, -1):
            step = (self.classes[level][a] == self.classes[level][b]).astype(np.int64) << level
            a += step
            b += step
            out += step
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far it reads alike leftwards from ``a`` and ``b`` (both included, ``a`` < ``b``, -1 allowed)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.classes) - 1, -1, -1):
            back = (1 << level) - 1
            inside = a >= back
            x, y = np.where(inside, a - back, 0), np.where(inside, b - back, 0)
            step = (inside & (self.classes[level][x] == self.classes[level][y])).astype(np.int64) << level
            a -= step
            b -= step
            out += step
        return out

    def places(self, start: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that begin like ``start`` for ``depth`` symbols."""
        low, high = self.rank[start].astype(np.int64), self.rank[start] + 1
        for level in range(len(self.least) - 1, -1, -1):
            table, width = self.least[level], 1 << level
            at = low - width + 1
            low = np.where((at >= 0) & (table[np.maximum(at, 0)] >= depth), low - width, low)
            inside = high < len(table)
            high = np.where(inside & (table[np.where(inside, high, 0)] >= depth), high + width, high)
        return low, high - 1

    def child(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """A position whose suffix is in the place and goes on with ``symbol`` after ``depth`` symbols, else -1."""
        end = high
        while True:
            wide = low < high
            if not wide.any():
                break
            middle = (low + high) // 2
            less = wide & (self.symbols[np.minimum(self.order[middle] + depth, self.n - 1)] < symbol)
            high = np.where(wide & ~less, middle, high)
            low = np.where(less, middle + 1, low)
        at = self.order[np.minimum(low, end)]
        return np.where(self.symbols[np.minimum(at + depth, self.n - 1)] == symbol, at, -1)


def blocks(tree: SuffixTree) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each the longest stretch that also begins earlier, or one symbol."""
    before, after = [-1] * tree.n, [-1] * tree.n  # nearest suffixes in order that begin earlier in the sequence
    stack: list[int] = []
    for at in tree.order.tolist():
        while stack and stack[-1] > at:
            after[stack.pop()] = at
        before[at] = stack[-1] if stack else -1
        stack.append(at)
    longest = np.zeros(tree.n, dtype=np.int64)
    for near in (np.array(before), np.array(after)):
        some = np.flatnonzero(near >= 0)
        longest[some] = np.maximum(longest[some], tree.forward(near[some], some))
    starts, at, steps = [], 0, np.maximum(longest, 1).tolist()
    while at < tree.n:
        starts.append(at)
        at += steps[at]
    return np.array(starts, dtype=np.int64)


def _is_primitive(tree: SuffixTree, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the root at ``start`` of length ``half`` is no shorter root written several times."""
    out, rest = np.ones(len(start), dtype=bool), half.copy()
    factor = np.arange(int(half.max(initial=1)) + 1)
    for p in range(2, int(len(factor) ** 0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, len(factor), p)] = p
    while True:
        at = np.flatnonzero((rest > 1) & out)
        if not len(at):
            return out
        prime = factor[rest[at]]
        period = half[at] // prime
        out[at] = tree.forward(start[at], start[at] + period) < half[at] - period
        rest[at] //= prime


def _unique_pairs(start: np.ndarray, half: np.ndarray, n: int) -> np.ndarray:
    return np.unique(half * (n + 1) + start)


def covering_squares(tree: SuffixTree) -> np.ndarray:
    """Stretches of squares with primitive roots, as half * (n + 1) + start, that cover every square's leftmost occurrence.

    For a block [h, e) and every length k up to it, the sequence is compared around e - k and e; for k up to
    this and the next block's length together, around h and h + k. Where the two extensions are k or more in all,
    a stretch of squares of half length k begins at the left one's end.
    """
    n, starts = tree.n, blocks(tree)
    ends = np.append(starts[1:], n)
    own = ends - starts
    both = own + np.append(own[1:], 0)
    found = [np.empty(0, dtype=np.int64)]
    for base, most, sign in ((ends, own, -1), (starts, both, 1)):
        first = np.concatenate(([0], np.cumsum(most)))
        for low in range(0, int(first[-1]), QUERIES):
            number = np.arange(low, min(low + QUERIES, int(first[-1])))
            block = np.searchsorted(first, number, "right") - 1
            k = number - first[block] + 1
            a, b = (base[block] - k, base[block]) if sign < 0 else (base[block], base[block] + k)
            inside = (b < n) & (a >= 0)
            a, b, k = a[inside], b[inside], k[inside]
            right, left = tree.forward(a, b), tree.backward(a - 1, b - 1)
            square = right + left >= k
            start, k = (a - left)[square], k[square]
            whole = _is_primitive(tree, start, k)
            found.append(_unique_pairs(start[whole], k[whole], n))
    return np.unique(np.concatenate(found))


def _distinct(low: np.ndarray, high: np.ndarray, half: np.ndarray, n: int) -> np.ndarray:
    _, at = np.unique(low * (n + 1) + half, return_index=True)
    return np.stack((low[at], high[at], half[at]))


def vocabulary(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, half) of every distinct square with a primitive root: its place in the tree and half its length.

    From each stretch of squares all rotations that the stretch itself holds are taken at once. Past its last
    square the walk follows the suffix link and looks for the branch that goes on with the square's first symbol;
    where there is one, the stretch around that occurrence is new, or has been walked already.
    """
    n = tree.n
    fresh = covering_squares(tree)
    walked = np.empty(0, dtype=np.int64)
    places: list[np.ndarray] = []
    while len(fresh):
        walked = np.union1d(walked, fresh)
        start, half = fresh % (n + 1), fresh // (n + 1)
        squares = tree.forward(start, start + half) - half + 1
        for low in range(0, len(start), QUERIES):
            part = slice(low, low + QUERIES)
            number = np.repeat(np.arange(len(start[part])), squares[part])
            within = np.arange(len(number)) - np.repeat(np.cumsum(squares[part]) - squares[part], squares[part])
            k = half[part][number]
            left, right = tree.places(start[part][number] + within, 2 * k)
            places.append(_distinct(left, right, k, n))
        last = start + squares - 1
        left, right = tree.places(np.minimum(last + 1, n - 1), 2 * half - 1)
        at = tree.child(left, right, 2 * half - 1, tree.symbols[last])
        on, k = at[at >= 0], half[at >= 0]
        on = on - tree.backward(on - 1, on + k - 1)
        fresh = np.setdiff1d(_unique_pairs(on, k, n), walked, assume_unique=True)
    if not places:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(_distinct(*np.concatenate(places, axis=1), n))


def runs_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of a sequence whose last symbol stands nowhere else, by start and period.

    A run is a stretch with smallest period p and a length of 2 * p at least that neither neighbour extends.
    """
    tree = SuffixTree(symbols)
    low, high, half = vocabulary(tree)
    counts = high - low + 1
    number = np.repeat(np.arange(len(low)), counts)
    within = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
    keys = np.sort(half[number] * (tree.n + 1) + tree.order[low[number] + within])
    if not len(keys):
        return (np.empty(0, dtype=np.int64),) * 3
    cut = np.flatnonzero(np.diff(keys) != 1) + 1
    first, last = keys[np.concatenate(([0], cut))], keys[np.concatenate((cut - 1, [len(keys) - 1]))]
    period, start = first // (tree.n + 1), first % (tree.n + 1)
    order = np.lexsort((period, start))
    return start[order], (last - first + 2 * period)[order], period[order]


def repeated_stretches(words: np.ndarray, width: int) -> np.ndarray:
    """Whether each word lies in a ``width``-word sequence that stands in the text twice or more.

    Sequences are compared by hash: equal ones never differ, so no repeat is missed.
    """
    n = len(words) - width + 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    if n < 2:
        return covered[:-1].astype(bool)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + n]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, np.minimum(at + width, len(words)), -1)
    return np.cumsum(covered[:-1]) > 0


def runs_of_texts(texts: list[np.ndarray], least_length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of at least ``least_length`` words of each text, a sequence of word numbers.

    A run of length L >= ``least_length`` and period p <= L / 2 repeats a sequence of L - p words, half of
    ``least_length`` or more, and all its words lie in such sequences. Stretches of other words are no part of a
    run, so one symbol that stands nowhere else takes the place of each.
    """
    width = max(1, least_length // 2)
    none = (np.empty(0, dtype=np.int64),) * 3
    out = [none] * len(texts)
    parts: list[np.ndarray] = []
    places: list[np.ndarray] = []
    members: list[int] = []
    used = offset = 0

    def finish() -> None:
        nonlocal parts, places, members, used, offset
        if members:
            symbols, position, bounds = np.concatenate(parts), np.concatenate(places), np.cumsum([len(p) for p in parts])
            symbols = np.where(symbols < 0, offset + np.arange(len(symbols)), symbols)  # each gap a symbol of its own
            start, length, period = runs_of(symbols)
            long = length >= least_length
            start, length, period = start[long], length[long], period[long]
            owner = np.searchsorted(bounds, start, "right")
            for i in np.unique(owner).tolist():
                own = owner == i
                out[members[i]] = position[start[own]], length[own], period[own]
        parts, places, members, used, offset = [], [], [], 0, 0

    for number, words in enumerate(texts):
        if len(words) < least_length:
            continue
        covered = repeated_stretches(words, width)
        if not covered.any():
            continue
        at = np.flatnonzero(covered)
        gap = np.flatnonzero(np.diff(at) > 1) + 1
        symbols = np.append(np.insert(words[at] + offset, gap, -1), -1)
        position = np.append(np.insert(at, gap, -1), -1)
        if used and used + len(symbols) > CHUNK_WORDS:
            symbols = np.where(symbols < 0, -1, symbols - offset)
            finish()
        parts.append(symbols)
        places.append(position)
        members.append(number)
        used += len(symbols)
        offset += int(words.max()) + 1
    finish()
    return out


def collapsed(words: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """The words joined by blanks, without those that a run holds after its first period."""
    start, length, period = runs
    if not len(start):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(least_length: int, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
            words: list[list[bytes]] = []
            numbers: list[np.ndarray] = []
            for i, text in zip(ids, texts, strict=True):
                own = (text.as_py() or b"").split()  # at the ASCII blanks, space and tab to carriage return
                own = rewrite(i, own) if rewrite is not None else own
                known: dict[bytes, int] = {}
                words.append(own)
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)))
            found = runs_of_texts(numbers, least_length)
            sizes = np.concatenate(([0], np.cumsum([len(r[0]) for r in found])))
            flat = [pa.array(np.concatenate([r[c] for r in found]) if found else [], pa.int64()) for c in range(3)]
            spans = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(_RUN)))
            kept = pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.large_binary()).cast(pa.large_string())
            yield pa.record_batch([batch.column(0), pa.array([len(w) for w in words], pa.int64()), spans, kept.cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 12, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed): the maximal runs of repeated words of each whole text.

    Words are the stretches without space, tab, line feed, vertical tab, form feed and carriage return, numbered
    from 0. A run is a stretch of words with smallest period p, of at least 2 * p and ``least_length`` words, that
    neither neighbouring word extends; runs come by start, then period, as (start, length, period). ``collapsed``
    has the words that no run holds after its first p words, joined by one blank. ``rewrite`` may change the words
    of a text, given its id, before they are looked at.

    Every text is worked on by itself, so no text meets another; memory follows the longest text.

    Defined cases: a null or empty text, or one of blanks, has no words and no runs. Null ids and rows that repeat
    an id are rows like others. Overlapping runs each drop their words. Extra columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.mapInArrow(_find(least_length, rewrite), schema).withColumnRenamed("id", id_col)


def with_planted_periods(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of all texts, by crc32 of the decimal id, made periodic from a word on; others as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]
