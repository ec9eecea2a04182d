"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

_PIECES = "id long, piece int, start long, length long, ids_crc32 long, part int, place long"


class TextEncoder:
    """Ids of whole texts, as the tokenizer's plain ``encode(text, add_special_tokens=False)`` gives them.

    So the string of a special token that stands in a text becomes that token. With ``ranks``, a file of the
    same vocabulary as merge ranks, all other texts are encoded by these, which gives the same ids in a
    fraction of the time.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path, self.plain, self.by_ranks = path, None, None
        if ranks is None:
            return
        import tiktoken

        with open(path, encoding="utf-8") as file:
            special = [t["content"] for t in json.load(file).get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.by_ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.by_ranks is not None and not self.special.search(text):
            return self.by_ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return np.asarray(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def default_tokenizer() -> tuple[str, str, str]:
    """(tokenizer file, the same vocabulary as ranks, pattern of the parts that are merged)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which may be shorter."""
    first = tokens % capacity or min(tokens, capacity)
    starts = [0, *range(first, tokens, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], tokens], strict=True)]


def _pieces(vocabulary: tuple[str, ...], capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Made for each task: a worker that later tasks of other kinds reuse keeps no vocabulary.
        encode, part = TextEncoder(*vocabulary), TaskContext.get().partitionId()
        closing, places = np.array([end], "<u4").tobytes(), [0] * (capacity + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode.ids(text.as_py() or "") + closing
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = [doc_id, piece, start, length, zlib.crc32(own), part, places[length]]
                    places[length] += 1
                    for column, value in zip(out, [*row, own] if with_ids else row, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "place"] + ["ids"] * with_ids
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how often each is taken, so that their sum is the largest possible within ``room``.

    Bit ``s`` of a set says that the sum ``s`` can be reached. The sets grow over lengths in ascending
    order; going back from the longest, each is taken as often as the rest stays reachable.
    """
    lengths = sorted(x for x, n in counts.items() if n and x <= room)
    mask, sets = (1 << (room + 1)) - 1, [1]
    for length in lengths:
        reach, left, step = sets[-1], min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            reach |= reach << (take * length)
            left, step = left - take, step * 2
        sets.append(reach & mask)
    total, taken = sets[-1].bit_length() - 1, {}
    for i in range(len(lengths) - 1, -1, -1):
        length = lengths[i]
        for n in range(min(counts[length], total // length), -1, -1):
            if sets[i] >> (total - n * length) & 1:
                break
        if n:
            taken[length] = n
            total -= n * length
    return taken


def bin_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, lengths in each): minimum bin slack, bin by bin.

    Every bin starts with the longest piece left and takes the fullest combination of the others beside
    it; the same combination is taken as often as the counts allow at once.
    """
    left, patterns = dict(counts), []
    while left := {x: n for x, n in left.items() if n}:
        longest = max(left)
        left[longest] -= 1
        taken = fullest(left, capacity - longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[x] // n for x, n in taken.items())
        for x, n in taken.items():
            left[x] -= times * n
        patterns.append((times, taken))
    return patterns


def _placement(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length in a sequence, offset of the first)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, taken in patterns:
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            rows.append((length, used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + times * n
            offset += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(plan: np.ndarray):
    """Sequence and offset of each piece from its length and its rank among the pieces of that length."""
    keys = (plan[:, 0] << 45) + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = plan[np.searchsorted(keys, (length << 45) + rank, "right") - 1]
            ahead = rank - row[:, 1]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.record_batch(
                [*(batch[n] for n in names), pa.array(row[:, 2] + ahead // row[:, 3]), pa.array(row[:, 4] + ahead % row[:, 3] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def pack(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer_path: str | None = None, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, [ids,] sequence_id, offset): pieces packed into sequences.

    A document is the ids of its text (by the public 50k byte vocabulary, or that of ``tokenizer_path``, and
    ``ranks_path`` with ``pattern`` if it has them) and ``end_id``. Only one of more than ``capacity`` ids is cut; all
    its pieces are full but the first. Bins are found from how many pieces of each length there are
    (``capacity`` numbers at most, whatever the size of the table), by minimum bin slack, as patterns
    that hold for many bins. Each piece's rank among those of its length, from its task's count and the
    counts of the tasks before, then gives its sequence and offset; so no group of pieces is ever brought
    together. Sequences are numbered from 0; offsets in one are gapless from 0. With ``with_ids`` the
    pieces' ids are returned too, as little-endian unsigned 32-bit integers.

    Defined cases: a null text is empty and makes one piece, the end id. Null ids and repeated rows are
    packed like any others. Other columns are ignored. An empty table gives an empty result.
    """
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = _PIECES + ", ids binary" * with_ids
    pieces = written(docs.mapInArrow(_pieces((tokenizer_path, ranks_path, pattern) if tokenizer_path else default_tokenizer(), capacity, end_id, with_ids), schema), "packing-pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    totals = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = _placement(bin_patterns(totals, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # One row for each task, of ``capacity`` numbers at most, so that the join has as few rows as there are tasks.
    firsts = starts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "first"))).alias("firsts"))
    ranked = pieces.join(firsts, "part").withColumn("rank", F.col("firsts")[F.col("length")] + F.col("place")).drop("part", "place", "firsts")
    columns = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = dict(ranked.dtypes)
    placed = ranked.select(*columns, "rank").mapInArrow(_place(plan), ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
