"""Bounded, repeatable samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written

#: Bytes of text that a classifier is fitted on at most, since the driver holds them.
MOST_BYTES = 64 << 20


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(folds))


def one_text_each(rows: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """One row for each of ``keys``: of rows that repeat them the text with the least hash stays.

    ``carried`` columns are the same in all rows of a key. Tasks keep one text a key before anything is shuffled.
    """
    text = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return rows.groupBy(*keys).agg(text, *(F.first(c).alias(c) for c in carried))


def within_bytes(sample: DataFrame, most_bytes: int, by: list[str]) -> DataFrame:
    """The rows of a bounded sample in the order of ``by``, until their texts come to ``most_bytes``; one at least.

    Sizes alone, one row of the sample each, are looked at on the driver.
    """
    sizes = sample.select(*by, F.octet_length("text").alias("bytes")).orderBy(*by).collect()
    if not sizes:
        return sample
    total = np.cumsum([r.bytes for r in sizes])
    fit = max(1, int(np.searchsorted(total, most_bytes, "right")))
    if fit >= len(sizes):
        return sample
    return sample.where(F.struct(*by) <= F.struct(*(F.lit(sizes[fit - 1][c]).cast(sample.schema[c].dataType) for c in by)))


def labelled_sample(documents: DataFrame, labels: DataFrame, *, label_col: str, rows: int, keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text", by_class: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, text, label): at most ``rows`` labelled documents, those with the smallest hashes of their ids.

    With ``by_class`` at most ``rows`` of each of the labels 0 and 1. ``keep`` is a condition on the label
    table's column ``id``. Null ids and labels are left out, and a label given several times counts by its
    mean. Of rows that repeat an id, the text with the least hash serves alone. Texts of more than
    ``most_bytes`` in all (with ``by_class`` half of that a class) are left out in the order of the hashes. The
    ids, ``rows`` longs at most for each class, are sent to all tasks of one scan of the documents; the texts
    found are written to the shared folder.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label")).withColumn("order", F.xxhash64("id"))
    if by_class:
        chosen = known.where("label = 0").orderBy("order", "id").limit(rows).unionByName(known.where("label = 1").orderBy("order", "id").limit(rows))
    else:
        chosen = known.orderBy("order", "id").limit(rows)
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = one_text_each(docs.join(F.broadcast(chosen), "id"), ["id"], ["label", "order"])
    found = written(found, "labelled-sample")
    if by_class:
        found = within_bytes(found.where("label = 0"), most_bytes // 2, ["order", "id"]).unionByName(within_bytes(found.where("label = 1"), most_bytes // 2, ["order", "id"]))
    else:
        found = within_bytes(found, most_bytes, ["order", "id"])
    return found.select("id", "text", "label")


def kept_rows(documents: DataFrame, text_col: str, keep: Callable[[pa.Array], list[bool] | np.ndarray]) -> DataFrame:
    """The rows of ``documents`` whose text passes ``keep``, a batch of texts at a time; columns of any name are kept."""
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    plain = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)
