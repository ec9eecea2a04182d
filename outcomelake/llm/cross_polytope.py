"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..sources.storage import written

#: Rows of a bucket, visitors too, that are compared as one block; a larger bucket is dealt out as pairs of blocks.
BLOCK_ROWS = 4096
#: Bits of a code within its table; a bucket's number holds the vectors' length and the table above them.
CODE_BITS = 42
#: More tables than any vector has; a bucket's number counts them.
MOST_TABLES = 64
#: Vectors of up to so many components have few buckets, all of which that may hold a link are visited.
NARROW = 8
#: Rows hashed at once.
HASH_ROWS = 2048
#: Buckets without a pair are left out before vectors are sent, if they hold this share of the places.
IDLE_SHARE = 0.25
#: Side of the tiles in which a block's cosines are computed.
TILE = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform along the last axis, whose length is a power of two."""
    shape, size, half = x.shape, x.shape[-1], 1
    while half < size:
        pairs = x.reshape(*shape[:-1], size // (2 * half), 2, half)
        x = np.stack((pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]), axis=-2).reshape(shape)
        half *= 2
    return x / np.sqrt(size)


def rotations(count: int, size: int, seed: int) -> np.ndarray:
    """Random signs of three rounds for each of ``count`` pseudo-random rotations."""
    return np.random.default_rng([seed, size]).choice([-1.0, 1.0], size=(count, 3, size))


def narrow_codes(unit: np.ndarray, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(home, visited) in one table, every bucket visited in which a vector with a cosine of ``threshold`` may be at home.

    A vector at an angle of at most t is nearer to axis b than to this vector's own nearest axis a only if this
    vector's components along a and b differ by no more than tan(t) times the distance of a and b. ``visited``
    is filled up with -1. No link is missed.
    """
    n, width = unit.shape
    size = 1 << max(1, (width - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :width] = unit
    reach = np.sqrt(max(0.0, 1 - threshold * threshold)) / threshold if threshold > 0 else np.inf
    number, best, near = np.arange(2 * size), [], []
    for signs in rotations(2, size, seed):
        x = padded
        for round_ in range(3):
            x = hadamard(x * signs[round_])
        x = np.stack((x, -x), axis=2).reshape(n, 2 * size)
        best.append(x.argmax(1))
        apart = np.where(number // 2 == best[-1][:, None] // 2, 2.0, np.sqrt(2.0))
        near.append(np.take_along_axis(x, best[-1][:, None], 1) - x <= reach * apart + 1e-9)
    home = best[0] * 2 * size + best[1]
    visited = np.where((near[0][:, :, None] & near[1][:, None, :]).reshape(n, -1), np.arange(4 * size * size), -1)
    visited[np.arange(n), home] = -1
    return home[:, None], visited[:, None]


def shape_of(width: int) -> tuple[int, int]:
    """(tables, visited buckets a table) at which a pair at 0.9 is missed less often than once in a hundred times (measured in the tests)."""
    return (12, 2) if width <= 512 else (16, 3)


def codes(unit: np.ndarray, tables: int, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(home, visited): for each vector and table the code of its bucket, and those of the next ``probes`` buckets.

    A code joins the nearest signed axes of two rotations. Buckets to visit take the second or third
    nearest axis instead, in order of the squared distance that this gives up.
    """
    n, width = unit.shape
    size = 1 << max(1, (width - 1).bit_length())
    home, visited = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    padded = np.zeros((n, size))
    padded[:, :width] = unit
    signs = rotations(2 * tables, size, seed)
    choices = [(1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
    for t in range(tables):
        axes, lost = [], []
        for r in (2 * t, 2 * t + 1):
            x = padded
            for round_ in range(3):
                x = hadamard(x * signs[r, round_])
            top = np.argpartition(-np.abs(x), 2, axis=1)[:, :3]
            value = np.take_along_axis(x, top, 1)
            order = np.argsort(-np.abs(value), axis=1, kind="stable")
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            axes.append(2 * top + (value < 0))
            lost.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        home[:, t] = axes[0][:, 0] * 2 * size + axes[1][:, 0]
        other = np.stack([axes[0][:, i] * 2 * size + axes[1][:, j] for i, j in choices], axis=1)
        cost = np.stack([lost[0][:, i] + lost[1][:, j] for i, j in choices], axis=1)
        visited[:, t] = np.take_along_axis(other, np.argsort(cost, axis=1, kind="stable")[:, :probes], 1)
    return home, visited


def code_type(width: int) -> type:
    """The narrowest kind of number that holds the codes of vectors of this length."""
    return np.int16 if width <= 64 else np.int32 if width <= 1 << 14 else np.int64


_PREPARED = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("vector", pa.binary())])
_HASHED = pa.schema([("id", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()), ("codes", pa.binary()), ("home", pa.list_(pa.int64())), ("visited", pa.list_(pa.int64()))])
_BLOCK = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, vector as bytes); digest and vector are null where the vector can't link."""
    for batch in batches:
        kind = np.float32 if pa.types.is_float32(batch.schema.field(1).type.value_type) else np.float64
        digests, vectors = [], []
        for value in batch.column(1):
            x = None if not value.is_valid else value.values.to_numpy(zero_copy_only=False).astype(kind)
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                digests.append(None)
                vectors.append(None)
            else:
                raw = (x + kind(0)).tobytes()  # -0.0 becomes 0.0
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
                vectors.append(raw)
        yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], schema=_PREPARED)


def _binaries(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a binary column, all of one length, as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first so that no square overflows or vanishes."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _hash(kind: type, threshold: float, seed: int):
    """Each row's codes, as they go with its vector, and the numbers of the buckets in which it is at home or visits.

    A bucket's number holds the vectors' length and the table above the code, so that only like meets like. Narrow
    vectors take no codes along: they are computed again where they are needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array([len(v.as_buffer()) for v in batch.column(2)], dtype=np.int64)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                for at in range(0, len(rows), HASH_ROWS):
                    part = batch.take(pa.array(rows[at : at + HASH_ROWS]))
                    unit = unit_rows(_binaries(part.column(2), kind))
                    n, length = unit.shape
                    home, visited = _codes_of(unit, threshold, seed)
                    packed = [b""] * n
                    if length > NARROW:
                        packed = [c.tobytes() for c in np.concatenate((home[:, :, None], visited), axis=2).astype(code_type(length))]
                    base = (np.int64(length) * MOST_TABLES + np.arange(home.shape[1])) << np.int64(CODE_BITS)
                    visits = [(v[v >= 0]) for v in np.where(visited >= 0, visited + base[:, None], -1).reshape(n, -1)]
                    yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array(packed, pa.binary()), pa.array(list(home + base), pa.list_(pa.int64())), pa.array(visits, pa.list_(pa.int64()))], schema=_HASHED)

    return run


def _codes_of(unit: np.ndarray, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    if unit.shape[1] <= NARROW:
        return narrow_codes(unit, threshold, seed)
    return codes(unit, *shape_of(unit.shape[1]), seed)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each pair; ``label`` holds each row's root, which is its set's smallest row."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _block(rows: pa.Table, key: int, split: bool, kind: type, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(id, links, root id) of the rows of one block of a bucket that have links which no earlier bucket shows."""
    rows = rows.combine_chunks()
    column = {name: rows[name].chunk(0) for name in rows.column_names}
    n = rows.num_rows
    visitor = column["visitor"].to_numpy()
    homes = int(np.count_nonzero(visitor == 0))
    ids, copies, part = column["id"].to_numpy(), column["copies"].to_numpy(), column["part"].to_numpy()
    unit = unit_rows(_binaries(column["vector"], kind))
    if unit.shape[1] <= NARROW:
        home, visited = narrow_codes(unit, threshold, seed)
    else:
        both = _binaries(column["codes"], code_type(unit.shape[1])).reshape(n, shape_of(unit.shape[1])[0], -1)
        home, visited = both[:, :, 0], both[:, :, 1:]
    table, code = (key >> CODE_BITS) % MOST_TABLES, key & ((1 << CODE_BITS) - 1)
    links, label = np.zeros(n, np.int64), np.arange(n)
    for top in range(0, homes, TILE):
        bottom = min(top + TILE, homes)
        for left in range(top, n, TILE):
            right = min(left + TILE, n)
            near = unit[top:bottom] @ unit[left:right].T >= threshold
            if left < homes:
                near &= np.arange(left, right) > np.arange(top, bottom)[:, None]
            if split:
                near &= part[left:right] != part[top:bottom, None]
            h, a = np.nonzero(near)
            if not len(h):
                continue
            h, a = h + top, a + left
            # Where both visit the other's bucket, the pair counts in the bucket of the smaller number.
            fresh = ~((home[a, table] < code) & (visited[h, table] == home[a, table, None]).any(1))
            for earlier in range(table):
                x, y = home[h, earlier], home[a, earlier]
                fresh &= ~((x == y) | (visited[a, earlier] == x[:, None]).any(1) | (visited[h, earlier] == y[:, None]).any(1))
            h, a = h[fresh], a[fresh]
            np.add.at(links, h, copies[a])
            np.add.at(links, a, copies[h])
            _unite(label, h, a)
    linked = np.flatnonzero(links)
    return (ids[linked], links[linked], ids[label[linked]]) if len(linked) else None


def _blocks(kind: type, threshold: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by block, homes first; a block may go over the end of a batch."""
        rest: pa.Table | None = None

        def done(rows: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
            key, low, high = (rows[c].to_numpy() for c in ("key", "low", "high"))
            change = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            starts = np.concatenate(([0], change))
            ends = np.concatenate((change, [rows.num_rows]))
            visitor, found = rows["visitor"].to_numpy(), []
            for s, e in zip(starts if last else starts[:-1], ends if last else ends[:-1], strict=True):
                if e - s > 1 and visitor[s] == 0 and (got := _block(rows.slice(s, e - s), int(key[s]), low[s] != high[s], kind, threshold, seed)):
                    found.append(got)
            return found, None if last else rows.slice(starts[-1])

        def out(found: list) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], schema=_BLOCK)

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                found, rest = done(rows if rest is None else pa.concat_tables([rest, rows]), False)
                yield from out(found)
        if rest is not None:
            yield from out(done(rest, True)[0])

    return run


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, seed: int = 20240) -> DataFrame:
    """(id, n_links, component_id, kept): vectors whose cosine, in double precision, is at least ``threshold``.

    Equal vectors form one class with a count. In each table of :func:`shape_of` a class lies in one bucket and
    visits the next ones; vectors of up to :data:`NARROW` components have one table, in which they visit every bucket
    that may hold a link. Within a bucket, homes are compared with homes and visitors by exact
    cosines in tiles. A pair that meets in several buckets counts in the first alone, which follows from
    the codes that both rows carry; so links are counted and joined where they are found, and neither pairs
    nor their distinct set are ever made as rows. A bucket of more than ``BLOCK_ROWS`` homes and visitors is
    dealt out as pairs of blocks, which any number of tasks may take; a task holds one block. Buckets that hold
    no pair are left out before vectors are sent, where they are many. Recall of a pair at 0.9 exactly is 1 up to
    :data:`NARROW` components, over 0.999 for 64 and over 0.99 for 768 and 1536 (measured in the tests); nearer pairs
    are missed less often. Lower thresholds have lower recall beyond :data:`NARROW` components.

    Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with
    nothing and is its own component. Vectors of different lengths never link. A null id has a null
    component and is kept. Rows that repeat an id are one vertex, each returned; equal vectors link and
    count one by one. Other columns are ignored. An empty table gives an empty result.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind, sql = (np.float32, "float") if isinstance(element, T.FloatType) else (np.float64, "double")
    source = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{sql}>").alias("vector"))
    prepared = written(source.mapInArrow(_prepare, "id long, digest binary, vector binary"), "vectors-prepared")
    classes = written(prepared.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors-classes")
    reps = prepared.join(classes.withColumnRenamed("rep", "id"), ["digest", "id"]).dropDuplicates(["digest", "id"]).select("id", "copies", "vector")
    hashed = written(reps.mapInArrow(_hash(kind, threshold, seed), "id long, copies long, vector binary, codes binary, home array<long>, visited array<long>"), "vectors-hashed")

    at = F.explode(F.expr("concat(transform(home, k -> struct(k as key, 0 as visitor)), transform(visited, k -> struct(k as key, 1 as visitor)))")).alias("at")
    # Large buckets: homes and visitors are dealt out apart. Of a bucket without homes nothing is compared.
    sizes = hashed.select(at).groupBy("at.key").agg(F.count_if(F.col("at.visitor") == 0).alias("homes"), F.count_if(F.col("at.visitor") == 1).alias("visitors"))
    sizes = written(sizes, "vectors-buckets")
    live, places = (F.col("homes") > 0) & (F.col("homes") + F.col("visitors") > 1), F.col("homes") + F.col("visitors")
    share = sizes.agg(F.sum(F.when(live, 0).otherwise(places)) / F.sum(places)).first()[0] or 0.0
    if share < IDLE_SHARE:
        placed = hashed.select("id", "copies", "vector", "codes", at).select("id", "copies", "vector", "codes", "at.key", "at.visitor")
    else:
        met = hashed.select("id", at).select("id", "at.key", "at.visitor").join(sizes.where(live).select("key"), "key", "left_semi")
        placed = met.join(hashed.select("id", "copies", "vector", "codes"), "id").select("id", "copies", "vector", "codes", "key", "visitor")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    heavy = written(sizes.where(F.col("homes") + F.col("visitors") > BLOCK_ROWS).select("key", blocks("homes").alias("parts"), blocks("visitors").alias("others")), "vectors-heavy")
    if heavy.isEmpty():
        placed = placed.select("*", F.lit(0).alias("part"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    else:
        # Homes of part i meet the homes of part j in block (i, j), and the visitors of part v in block (i, parts + v).
        placed = placed.join(heavy, "key", "left").where("parts is null or parts > 0")
        drawn = F.xxhash64("id").bitwiseAND(F.lit((1 << 31) - 1))
        part = F.when(F.col("parts").isNull(), 0).when(F.col("visitor") == 0, drawn % F.greatest("parts", F.lit(1))).otherwise(F.col("parts") + drawn % F.greatest("others", F.lit(1))).cast("int")
        met = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("visitor") == 0, F.sequence(F.lit(0), F.col("parts") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        placed = placed.withColumn("part", part).withColumn("other", F.explode(met))
        placed = placed.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("parts", "others", "other")
    placed = placed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "visitor", "id")
    found = written(placed.mapInArrow(_blocks(kind, threshold, seed), "id long, links long, root long"), "vectors-found")

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "vectors-groups")
    labels = classes.withColumnRenamed("rep", "id").join(counts, "id", "left").join(groups, "id", "left")
    labels = written(labels.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "vectors-labels")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    result = prepared.select("id", "digest").join(labels, "digest", "left")
    return result.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
