"""Near-duplicate documents by min-max hashing, banding and confirmation on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.storage import written
from .text_kernels import mix64, shingle_sets, text_chunks

#: Up to so many ids are sent to all executors to filter a scan (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: Members of a band, and shingles of them all, that are compared as one block; a larger band is dealt out as pairs
#: of blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19
#: Shingles counted at once within a block.
COLUMNS = 4096

_SIGNATURE_SCHEMA = "id long, n_shingles long, digest binary, bands array<long>"
_SIGNATURE_ARROW = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SET_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary())])


def banding(threshold: float, values: int, miss: float = 1e-4) -> tuple[int, int]:
    """(bands, rows): the most rows a band at which a pair just at ``threshold`` is missed less often than ``miss``."""
    for rows in range(16, 1, -1):
        if (1 - threshold**rows) ** (values // rows) <= miss:
            return values // rows, rows
    return values, 1


def band_keys(sets: list[np.ndarray], permutations: int, bands: int, rows: int) -> np.ndarray:
    """Band keys (one row a set) of min-max signatures.

    A permutation is one multiply-add of the 64-bit hashes; both its least and its greatest value are
    kept, so that ``permutations`` evaluations give twice as many signature values.
    """
    multipliers = mix64(np.arange(1, permutations + 1, dtype=np.uint64)) | np.uint64(1)
    addends = mix64(np.arange(1, permutations + 1, dtype=np.uint64) << np.uint64(32))
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    signature = np.empty((2 * permutations, len(sets)), dtype=np.uint64)
    permuted = np.empty_like(flat)
    for j in range(permutations):
        np.multiply(flat, multipliers[j], out=permuted)
        permuted += addends[j]
        signature[2 * j] = np.minimum.reduceat(permuted, starts)
        signature[2 * j + 1] = np.maximum.reduceat(permuted, starts)
    keys = np.empty((bands, len(sets)), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(sets), b + 1, dtype=np.uint64)
        for value in signature[b * rows : (b + 1) * rows]:
            h = mix64(h) + value
        keys[b] = mix64(h)
    return keys.T


def _signatures(k: int, permutations: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in text_chunks(batch.column(1)):
                sets = shingle_sets(texts, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, band_keys([sets[i] for i in full], permutations, bands, rows).view(np.int64), strict=True):
                        keys[i] = row
                yield pa.record_batch(
                    [
                        batch.column(0)[at:end],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    schema=_SIGNATURE_ARROW,
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in text_chunks(batch.column(1)):
                sets = shingle_sets(texts, k)
                yield pa.record_batch(
                    [batch.column(0)[at:end], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    schema=_SET_ARROW,
                )

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, n, hashes) of the documents with the given ids, made anew from their texts."""
    needed = written(ids.select("id").distinct(), "minhash-needed")
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    return written(docs.join(needed, "id", "left_semi").mapInArrow(_full_sets(k), "id long, n long, hashes binary"), "minhash-sets")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share, as a matrix."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.concatenate(([0], np.cumsum(flat[1:] != flat[:-1])))
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    common = np.zeros((len(sets), len(sets)), np.int32)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(column, column[at] + COLUMNS, "left"))
        present = np.zeros((len(sets), int(column[end - 1] - column[at]) + 1), np.float32)
        present[owner[at:end], column[at:end] - column[at]] = 1
        common += (present @ present.T).astype(np.int32)
        at = end
    return common


def _links_across(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the groups of one block of a band: enough to connect all that its links connect."""
    rows = rows.combine_chunks()
    ids, group = rows["id"].to_numpy(), rows["group"].to_numpy()
    label = np.unique(group, return_inverse=True)[1]
    if not label.any():
        return ids[:0], ids[:0]
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["hashes"]]
    sizes, common = np.array([len(s) for s in sets]), common_counts(sets)
    near = 100 * common >= percent * (sizes[:, None] + sizes - common)
    a, b = np.nonzero(np.triu(near & (label[:, None] != label), 1))
    taken = []
    for i, j in zip(a, b, strict=True):
        if label[i] != label[j]:
            label[label == label[j]] = label[i]
            taken.append((i, j))
    i, j = np.array(taken, dtype=np.int64).reshape(-1, 2).T
    return ids[i], ids[j]


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _across(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by block; a block may go over the end of a batch."""
        rest: pa.Table | None = None
        for batch in _and_end(batches):
            if batch is not None:
                more = pa.Table.from_batches([batch])
                rest = more if rest is None else pa.concat_tables([rest, more])
            if rest is None or not rest.num_rows:
                continue
            band, low, high = (rest[c].to_numpy() for c in ("band", "low", "high"))
            change = np.flatnonzero((band[1:] != band[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(band)]))
            table, rest = rest, None
            if batch is not None:
                starts, ends, rest = starts[:-1], ends[:-1], table.slice(starts[-1])
            found = [_links_across(table.slice(s, e - s), percent) for s, e in zip(starts, ends, strict=True) if e - s > 1]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, permutations: int = 128) -> DataFrame:
    """(id, n_shingles, component_id, kept): groups of documents that near-duplicate links connect.

    A document's set holds the distinct ``words``-word shingles of its lower-cased, blank-separated words.
    Two documents link when ``100 * |common| >= percent * |union|``. Equal sets become one class at once.
    Class representatives are banded over min-max signatures. Every member of a band is compared with one
    other of it; a band whose members are then still in several groups is compared whole, by counting
    common shingles of all its members in a task and returning no more links than join its groups. So a
    group of thousands of copies never becomes pairs as rows, and no candidate pair is left out. A band of
    more than ``BLOCK_ROWS`` members, or ``BLOCK_SHINGLES`` shingles, is dealt out as pairs of blocks. Every link is confirmed on full sets.

    Shingles are compared by 62-bit hashes of their words under fixed bases: two different ones are taken for one with a
    chance of some 2 ** -60, but for texts that are made to collide.

    Defined cases: a null, empty or blank text has ``n_shingles`` 0, is its own component and kept. A null
    id is returned with a null component, kept. Rows that repeat an id are one vertex, each returned. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    bands, rows = banding(percent / 100, 2 * permutations)
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = written(docs.mapInArrow(_signatures(words, permutations, bands, rows), _SIGNATURE_SCHEMA), "minhash-signatures")
    classes = written(signed.where("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep")), "minhash-classes")

    reps = signed.select("id", "n_shingles", "digest", "bands").join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi")
    members = reps.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    crowded = written(members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band"), "minhash-bands")
    members = written(members.join(crowded, "band", "left_semi").distinct(), "minhash-members")

    # First each member of a band against one other of it, then whatever is still in several groups.
    leaders = members.groupBy("band").agg(F.min_by(F.struct("id", "n"), F.xxhash64("id", "band")).alias("leader"))
    leaders = written(leaders.select("band", F.col("leader.id").alias("other"), F.col("leader.n").alias("other_n")), "minhash-leaders")
    enough = F.expr(f"100 * least(n, other_n) >= {percent} * greatest(n, other_n)")
    pairs = members.join(leaders, "band").where(enough & (F.col("id") != F.col("other")))
    pairs = written(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "minhash-pairs")
    groups = None
    if not members.isEmpty():
        sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, words)
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
        links = written(both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"), "minhash-links")
        groups = connected_components(links, "minhash-groups")

        placed = members.join(groups, "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("group"))
        split = placed.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("size"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("id")).alias("who")).where("low <> high and size > 2")
        # Bands of the same members are compared once.
        split = split.groupBy("size", "shingles", "who").agg(F.min_by(F.struct("band", "size", "shingles"), "band").alias("one")).select("one.*")
        parts = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        split = written(split.select("band", parts.alias("parts")), "minhash-open")
        placed = written(placed.join(split, "band"), "minhash-placed")
        if not placed.isEmpty():
            part = F.pmod(F.xxhash64("id"), "parts").cast("int")
            blocks = placed.select("band", "id", "group", part.alias("part"), F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
            blocks = blocks.select("band", "id", "group", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
            blocks = blocks.join(_sets_of(placed, docs, words).select("id", "hashes"), "id")
            blocks = blocks.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "id")
            across = written(blocks.select("id", "group", "hashes", "band", "low", "high").mapInArrow(_across(percent), "a long, b long"), "minhash-across")
            groups = connected_components(links.unionByName(across), "minhash-groups")

    if groups is not None:
        classes = written(classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "minhash-labels")
    else:
        classes = classes.withColumnRenamed("rep", "component")
    result = signed.select("id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return result.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _by_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi or anti join with distinct ids: sent to all tasks up to :data:`BROADCAST_IDS` of them, else by a shuffle."""
    ids = written(ids, "minhash-ids").withColumnRenamed("id", id_col)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, id_col, how).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents``, with all their columns, that near-duplicate removal keeps: one a group.

    Of rows that repeat an id the one with the least text stays, too (of those with one text, the one
    whose columns have the least hash). Rows with a null id all stay, and so does one row of each null or
    empty text's id, since they link with nothing. Columns of any name are kept; an empty table gives an empty result.
    """
    found = written(near_duplicates(documents, id_col=id_col, text_col=text_col, words=words, percent=percent).withColumnRenamed(id_col, "id"), "minhash-result")
    left = _by_ids(documents, found.where("not kept").select("id").distinct(), id_col, "left_anti")
    repeated = written(found.where("kept and id is not null").groupBy("id").count().where("count > 1").select("id"), "minhash-repeated")
    if repeated.isEmpty():
        return left
    # Tasks keep one row an id before anything is shuffled.
    again = _by_ids(left, repeated, id_col, "left_semi")
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(again.columns)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rest = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(again.columns)))))
    once = again.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min_by(F.struct(*own), F.struct(text, rest)).alias("row"))
    once = once.select("row.*").toDF(*again.columns)
    return _by_ids(left, repeated, id_col, "left_anti").unionByName(once)
