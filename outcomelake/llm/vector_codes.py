"""Vector compression by codebooks of parts, trained by Lloyd's rounds that filter candidates down kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .skew import joined_by_count

#: Vectors in one tree, and points in a leaf.
TREE_ROWS, LEAF = 4096, 16
#: Differences of leaves' points and entries that are held at once.
LEAF_CELLS = 1 << 21
#: Whole numbers below this are worked on in 64 bits without overflow; greater ones as Python's integers.
NARROW = 1 << 24
#: Sums travel in pieces of so many bits, so that they stay exact however large they are.
PIECE_BITS = 90
MOST = (1 << 63) - 1


def whole_numbers(vectors: np.ndarray, scale_bits: int) -> np.ndarray:
    """floor(x * 2 ** scale_bits), exactly; Python's integers where one is NARROW or more."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(1 << scale_bits))
    if not scaled.size or np.abs(scaled).max() < NARROW:
        return scaled.astype(np.int64)
    out = np.empty(vectors.shape, dtype=object)
    for at, x in np.ndenumerate(vectors):
        top, bottom = float(x).as_integer_ratio()
        out[at] = (top << scale_bits) // bottom
    return out


class Tree:
    """A balanced kd-tree over points with whole-number components: boxes, sums and counts of every subtree.

    Nodes of a level stand in one array, so that a level is built, and filtered, by a few array operations.
    The points are made up to LEAF * 2 ** depth by copies that count nothing.
    """

    def __init__(self, points: np.ndarray):
        n, width = points.shape
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        size = LEAF << self.depth
        self.order = np.minimum(np.arange(size), n - 1)
        self.weight = (np.arange(size) < n).astype(np.int64)
        number = np.arange(size)
        for level in range(self.depth):
            split = points[self.order[number]].reshape(1 << level, -1, width)
            wide = np.argmax(split.max(1) - split.min(1), axis=1)
            along = np.take_along_axis(split, wide[:, None, None], 2)[:, :, 0]
            number = np.take_along_axis(number.reshape(1 << level, -1), np.argsort(along, axis=1, kind="stable"), 1).ravel()
        self.order, self.weight = self.order[number], self.weight[number]
        self.points = points[self.order]
        leaves = self.points.reshape(-1, LEAF, width)
        low, high = [leaves.min(1)], [leaves.max(1)]
        count = [self.weight.reshape(-1, LEAF).sum(1)]
        total = [(leaves * self.weight.reshape(-1, LEAF, 1)).sum(1)]
        for _ in range(self.depth):
            low.append(np.minimum(low[-1][::2], low[-1][1::2]))
            high.append(np.maximum(high[-1][::2], high[-1][1::2]))
            count.append(count[-1][::2] + count[-1][1::2])
            total.append(total[-1][::2] + total[-1][1::2])
        self.low, self.high, self.count, self.total = low[::-1], high[::-1], count[::-1], total[::-1]

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each point in the order given, points of each entry, their sums): nearest entries, ties to the lower.

        An entry is eliminated for a whole box where another one, nearest to the box's middle, is nearer to the
        box's corner that lies furthest towards the entry (or as near and lower in number): then it is so for
        all of the box. A subtree with one entry left goes to it with its cached sum and count.
        """
        k, size = len(entries), len(self.points)
        codes, counts, sums = np.zeros(size, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros_like(entries)
        nodes, left = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        numbers = np.arange(k)
        for level in range(self.depth + 1):
            low, high = self.low[level][nodes], self.high[level][nodes]
            twice = 2 * entries[None] - (low + high)[:, None]
            far = (twice * twice).sum(2)
            best = np.argmin(np.where(left, far, np.iinfo(np.int64).max), axis=1)
            chosen = entries[best]
            corner = np.where(entries[None] > chosen[:, None], high[:, None], low[:, None])
            one, other = entries[None] - corner, chosen[:, None] - corner
            one, other = (one * one).sum(2), (other * other).sum(2)
            left &= (one < other) | ((one == other) & (numbers <= best[:, None]))
            single = left.sum(1) == 1
            whole, entry = nodes[single], best[single]
            np.add.at(counts, entry, self.count[level][whole])
            np.add.at(sums, entry, self.total[level][whole])
            codes.reshape(1 << level, -1)[whole] = entry[:, None]
            nodes, left = nodes[~single], left[~single]
            if level < self.depth:
                nodes, left = np.repeat(2 * nodes, 2), np.repeat(left, 2, axis=0)
                nodes[1::2] += 1
        # Leaves in runs, so that memory does not follow the width of the parts.
        run = max(1, LEAF_CELLS // (LEAF * k * entries.shape[1]))
        for at in range(0, len(nodes), run):
            some, known = nodes[at : at + run], left[at : at + run]
            points, weight = self.points.reshape(len(self.low[-1]), LEAF, -1)[some], self.weight.reshape(-1, LEAF)[some]
            away = points[:, :, None] - entries[None, None]
            code = np.argmin(np.where(known[:, None], (away * away).sum(3), np.iinfo(np.int64).max), axis=2)
            np.add.at(counts, code.ravel(), weight.ravel())
            np.add.at(sums, code.ravel(), (points * weight[:, :, None]).reshape(code.size, -1))
            codes.reshape(-1, LEAF)[some] = code
        out = np.empty(int(self.order.max()) + 1, dtype=np.int64)
        out[self.order] = codes
        return out, counts, sums


def _exactly(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :meth:`Tree.assign` gives, a point at a time in Python's integers, for components of any size."""
    own = [[int(x) for x in e] for e in entries]
    codes, counts, sums = [], np.zeros(len(own), dtype=np.int64), np.zeros(entries.shape, dtype=object)
    for point in points:
        point = [int(x) for x in point]
        code = min(range(len(own)), key=lambda z: (sum((a - b) ** 2 for a, b in zip(point, own[z], strict=True)), z))
        codes.append(code)
        counts[code] += 1
        sums[code] += np.array(point, dtype=object)
    return np.array(codes, dtype=np.int64), counts, sums


def assign(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, counts and sums of points by their nearest entries: by a tree, but for points or entries too wide for it."""
    if entries.dtype == object:
        return _exactly(points, entries)
    if points.dtype != object:
        return Tree(points).assign(entries)
    narrow = np.array([all(abs(x) < NARROW for x in p) for p in points])
    codes, counts, sums = _exactly(points[~narrow], entries)
    out = np.empty(len(points), dtype=np.int64)
    out[~narrow] = codes
    if narrow.any():
        codes, more, total = Tree(points[narrow].astype(np.int64)).assign(entries)
        out[narrow], counts, sums = codes, counts + more, sums + total
    return out, counts, sums


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale_bits: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of up to TREE_ROWS rows with their whole numbers; shorter vectors are filled up with zeros."""
    waiting: list[pa.RecordBatch] = []

    def whole() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(waiting)
        column = table["vector"].combine_chunks()
        lengths = np.diff(column.offsets.to_numpy())
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        vectors = np.zeros((len(column), width))
        if (lengths == width).all():
            vectors[:] = values.reshape(len(column), width)
        else:
            vectors[np.arange(width) < lengths[:, None]] = values
        return table, whole_numbers(vectors, scale_bits)

    rows = 0
    for batch in batches:
        for at in range(0, batch.num_rows, TREE_ROWS):
            piece = batch.slice(at, TREE_ROWS)
            if rows + piece.num_rows > TREE_ROWS:
                yield whole()
                waiting, rows = [], 0
            waiting.append(piece)
            rows += piece.num_rows
    if rows:
        yield whole()


def _narrowed(part: np.ndarray) -> np.ndarray:
    if part.dtype == object and all(abs(x) < NARROW for x in part.ravel()):
        return part.astype(np.int64)
    return part


def _sums(codebooks: list[np.ndarray], width: int, scale_bits: int):
    """(part, entry, place, piece, value): counts (place -1) and sums of a task's parts by their entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, step = len(codebooks), width // len(codebooks)
        counts = np.zeros((parts, len(codebooks[0])), dtype=np.int64)
        sums = [np.zeros(c.shape, dtype=object) for c in codebooks]
        for _, numbers in _blocks(batches, width, scale_bits):
            for p, entries in enumerate(codebooks):
                _, n, total = assign(_narrowed(numbers[:, p * step : (p + 1) * step]), entries)
                counts[p] += n
                sums[p] = sums[p] + total
        rows = []
        for p in range(parts):
            for e in np.flatnonzero(counts[p]).tolist():
                rows.append((p, e, -1, 0, str(counts[p, e])))
                for place, value in enumerate(sums[p][e]):
                    value, piece = int(value), 0
                    while value:
                        low = value if -(1 << PIECE_BITS) < value < 1 << PIECE_BITS else value & ((1 << PIECE_BITS) - 1)
                        rows.append((p, e, place, piece, str(low)))
                        value, piece = (value - low) >> PIECE_BITS, piece + 1
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.record_batch([*(pa.array(c, pa.int32()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=["part", "entry", "place", "piece", "value"])

    return run


def _codes(codebooks: list[np.ndarray], width: int, scale_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = width // len(codebooks)
        for table, numbers in _blocks(batches, width, scale_bits):
            codes = np.empty((len(numbers), len(codebooks)), dtype=np.uint8)
            error = np.zeros(len(numbers), dtype=np.int64)
            for p, entries in enumerate(codebooks):
                points = _narrowed(numbers[:, p * step : (p + 1) * step])
                codes[:, p] = assign(points, entries)[0]
                away = points - entries[codes[:, p]]
                error = error + (away * away).sum(1)
            error = [min(int(e), MOST) for e in error]
            yield pa.record_batch([table["id"].combine_chunks(), table["label"].combine_chunks(), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return run


def finite_vectors(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector of doubles) of the rows whose vector is not null and holds finite components only."""
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def vector_codes(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale_bits: int = 8) -> tuple[DataFrame, list[list[list[int]]]]:
    """(id, label, code, error, label_error) of every finite vector, and the codebooks that the codes refer to.

    A component x becomes the integer floor(x * 2 ** ``scale_bits``), and a vector is cut into ``parts`` equal
    consecutive parts (256 ``entries`` at most). A part position's codebook begins with that part of the vectors
    with the smallest ids. Each round assigns all parts to their nearest entries by squared distance, ties to the
    lower entry, and replaces every used entry by its parts' componentwise floor(sum / count). At last all parts are
    assigned again: ``code`` has two hex digits a part, ``error`` is the squared distance over all parts, and
    ``label_error`` sums it over rows of equal labels, null labels together.

    Every task builds kd-trees over its parts with cached sums and counts, and assigns whole subtrees at once. What
    leaves a task is a sum for each entry; the codebooks, ``entries`` vectors' worth of numbers, are all that reaches
    the driver. All arithmetic is exact.

    Defined cases: rows whose vector is null, or holds null or non-finite components, are left out. Vectors
    are filled up with zeros to the longest one's length, made up to a multiple of ``parts``. Rows that repeat an id
    each get their code; as first entry an id gives its smallest vector, and a null id comes after all others.
    With fewer ids there are fewer entries. Errors beyond 2 ** 63 - 1 are given as that. Extra columns are ignored,
    whatever their names. An empty table gives an empty result and no codebooks.
    """
    rows = finite_vectors(embeddings, id_col, vector_col, label_col)
    spark = rows.sparkSession
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], f"`{id_col}` long, label string, code string, error long, label_error long"), []
    width = max(1, -(-longest // parts)) * parts
    ids = [r.id for r in rows.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    known = F.col("id").isin([i for i in ids if i is not None])
    first = rows.where(known | F.col("id").isNull() if None in ids else known).groupBy("id").agg(F.min("vector").alias("vector")).orderBy(F.col("id").asc_nulls_last()).collect()
    vectors = np.array([r.vector + [0.0] * (width - len(r.vector)) for r in first])
    step = width // parts
    numbers = whole_numbers(vectors, scale_bits)
    codebooks = [_narrowed(numbers[:, p * step : (p + 1) * step]) for p in range(parts)]

    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(codebooks, width, scale_bits), "part int, entry int, place int, piece int, value string")
        sums = sums.groupBy("part", "entry", "place", "piece").agg(F.sum(F.col("value").cast("decimal(28,0)")).alias("value"))
        total: dict[tuple[int, int, int], int] = {}
        for r in sums.collect():
            total[r.part, r.entry, r.place] = total.get((r.part, r.entry, r.place), 0) + (int(r.value) << (PIECE_BITS * r.piece))
        fresh = []
        for p, own in enumerate(codebooks):
            moved = np.array([[int(x) for x in e] for e in own], dtype=object)
            for e in range(len(own)):
                if n := total.get((p, e, -1), 0):
                    moved[e] = [total.get((p, e, place), 0) // n for place in range(step)]
            fresh.append(_narrowed(moved))
        codebooks = fresh

    coded = rows.mapInArrow(_codes(codebooks, width, scale_bits), "id long, label string, code string, error long")
    coded = written(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "vector-codes")
    totals = coded.groupBy("key").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total"), F.count("*").alias("rows"))
    totals = written(totals.select("key", "rows", F.least("total", F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error")), "vector-labels")
    result = joined_by_count(coded, totals, ["key"], "rows")
    return result.select(F.col("id").alias(id_col), "label", "code", "error", "label_error"), [[[int(x) for x in e] for e in own] for own in codebooks]


def digest_of(codebooks: list[list[list[int]]]) -> str:
    """Hex SHA-256 of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for own in codebooks for entry in own for x in entry).encode()).hexdigest()
