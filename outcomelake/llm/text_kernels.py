"""Numpy kernels over the UTF-8 bytes of many texts at once, used inside Arrow tasks.

A task gets its texts as an Arrow string column. The kernels look at its byte buffer, so that finding
words and hashing them costs a few vector operations a byte and no Python call a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; it bounds the memory of the wide numpy arrays, not the length of a text.
CHUNK_BYTES = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Two prime moduli with a base each. Sums of bytes times powers are taken in a prime field: modulo a power of two,
#: whole families of texts (Thue-Morse words among them) would have equal sums under every base.
_LANES = ((np.uint64(2147483647), np.uint64(1_104_729_377)), (np.uint64(2147483629), np.uint64(1_758_213_953)))
#: Bytes hashed at once; no sum of so many terms overflows.
_HASH_BYTES = 1 << 17
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection, so that equal outputs mean equal inputs)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _powers_of(base: int, modulus: int, n: int) -> np.ndarray:
    """base ** i modulo a prime below 2 ** 31, for i below n."""
    out, done = np.ones(n, dtype=np.uint64), 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, modulus)) % np.uint64(modulus)
        done += more
    return out


def _power_tables(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the lane's base and of its inverse; tables for longer ranges than usual are not kept."""
    modulus, base = map(int, _LANES[lane])
    if n <= _HASH_BYTES + 1 and lane in _powers:
        return _powers[lane]
    size = max(n, _HASH_BYTES + 1)
    tables = _powers_of(base, modulus, size), _powers_of(pow(base, -1, modulus), modulus, size)
    if size == _HASH_BYTES + 1:
        _powers[lane] = tables
    return tables


class Texts:
    """The bytes of a run of texts: ``data`` with text ``i`` at ``offsets[i]:offsets[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower_ascii(self) -> Texts:
        """A-Z lower-cased; all other characters are left alone."""
        data = self.data.copy()
        data[(data >= 65) & (data <= 90)] += 32
        return Texts(data, self.offsets)

    def words(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes that are no separators, and each text's first word.

        ``separator`` is a table of 256 booleans. The third array has one more entry than there are texts.
        """
        inside = ~separator[self.data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        starts[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return first, last, np.searchsorted(first, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges, which stand in order: equal bytes have equal hashes wherever they stand.

        Runs of ranges of about :data:`_HASH_BYTES` are hashed at once; memory follows the longest range.
        """
        out, at = np.empty(len(starts), dtype=np.uint64), 0
        while at < len(starts):
            end = max(at + 1, int(np.searchsorted(ends, starts[at] + _HASH_BYTES, "right")))
            low, high = int(starts[at]), int(ends[end - 1])
            own, first, last = self.data[low:high].astype(np.uint64) + np.uint64(1), starts[at:end] - low, ends[at:end] - low
            both = np.zeros(end - at, dtype=np.uint64)
            for lane, (modulus, _) in enumerate(_LANES):
                up, down = _power_tables(lane, len(own) + 1)
                terms = own * up[: len(own)]
                if len(own) > _HASH_BYTES:
                    terms %= modulus
                total = np.zeros(len(own) + 1, dtype=np.uint64)
                np.cumsum(terms, out=total[1:])
                both = (both << np.uint64(31)) | ((total[last] - total[first]) % modulus * down[first] % modulus)
            out[at:end] = mix64(both)
            at = end
        return out


def string_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of plain strings; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole texts of about :data:`CHUNK_BYTES`, as (first row, end row, bytes).

    A longer text makes a run of its own; no text is cut.
    """
    column = string_column(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, end, Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans that is true in the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = byte_table((0x20, 0x20), (0x09, 0x0D))


def shingle_sets(texts: Texts, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles over lower-cased blank-separated words.

    A text of fewer than ``k`` words, one at least, has the whole sequence as its one shingle; a text
    without words has none.
    """
    texts = texts.lower_ascii()
    starts, ends, first = texts.words(BLANKS)
    words = texts.hashes(starts, ends)
    salt = mix64(np.arange(1, k + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    by_width = mix64(np.arange(k + 1, dtype=np.uint64))
    out = []
    for i in range(len(texts)):
        own = words[first[i] : first[i + 1]]
        n = max(min(len(own), 1), len(own) - k + 1)
        if not n:
            out.append(np.empty(0, dtype=np.uint64))
            continue
        width = min(k, len(own))
        h = own[:n] * salt[0] + by_width[width]
        for j in range(1, width):
            h = mix64(h) + own[j : j + n] * salt[j]
        h = mix64(h)
        h.sort()
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
    return out
