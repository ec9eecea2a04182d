"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, kept_rows, labelled_sample

#: Code points worked on at once (it bounds memory; texts are never cut).
CHUNK_CHARS = 1 << 17

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)
_AGAIN = np.uint32(0x5BD1E995)


def _spread(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    h ^= h >> np.uint32(15)
    return h


def feature_hashes(points: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, 32-bit hashes) of each kind of feature in the code points of texts with a newline after each.

    The kinds are words, the word *again* where a word repeats the one before it, and for every given
    length the character n-grams of words with a blank for the edges of a word. No feature goes over the end
    of a text, so a text's features don't depend on the texts beside it.
    """
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    starts = ~blank
    starts[1:] &= blank[:-1]
    ends = ~blank
    ends[:-1] &= blank[1:]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if len(first):
        power = np.full(len(points), _MULTIPLIERS[0], dtype=np.uint32)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        inverse = np.full(len(points), np.uint32(pow(int(_MULTIPLIERS[0]), -1, 1 << 32)), dtype=np.uint32)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        total = np.concatenate((np.zeros(1, np.uint32), np.cumsum((points + np.uint32(1)) * power, dtype=np.uint32)))
        words = (total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint32)
        yield first, _spread(words + np.uint32(1))
        owner = np.searchsorted(offsets, first, "right")
        again = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
        yield first[again], np.full(len(again), _spread(np.array([_AGAIN]))[0])
    for n in lengths:
        if len(points) < n:
            continue
        size = len(points) - n + 1
        h = np.full(size, n, dtype=np.uint32)
        inner = np.ones(size, dtype=bool)
        for j in range(n):
            h += np.where(blank[j : j + size], np.uint32(32), points[j : j + size]) * _MULTIPLIERS[j]
            if 0 < j < n - 1:
                inner &= ~blank[j : j + size]
        for j in range(1, n):
            over = offsets[1:] - j
            inner[over[(over >= 0) & (over < size)]] = False
        at = np.flatnonzero(inner)
        yield at, _spread(h[at])


def point_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets) of runs of whole texts, with a newline after each."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy().astype(np.int64) + 1
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_CHARS, "right")) - 1)
        joined = "".join([(x or "") + "\n" for x in column.slice(at, end - at).to_pylist()])
        yield at, end, np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), bounds[at : end + 1] - bounds[at]
        at = end


@dataclass
class SubwordModel:
    """What scoring needs: for each bucket and class the product of its vector and the class's output weights."""

    gains: np.ndarray
    bias: np.ndarray
    lengths: tuple[int, ...]

    def logits(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each text: the mean over its features and the bias; the bias alone without features."""
        shift = np.uint32(32 - (len(self.gains) - 1).bit_length())
        texts, classes = len(offsets) - 1, self.gains.shape[1]
        total, count = np.zeros((texts, classes)), np.zeros(texts)
        for at, hashes in feature_hashes(points, offsets, self.lengths):
            if not len(at):
                continue
            cuts = np.searchsorted(at, offsets)
            count += np.diff(cuts)
            bucket = hashes >> shift
            for c in range(classes):
                sums = np.concatenate(([0.0], np.cumsum(self.gains[bucket, c], dtype=np.float64)))
                total[:, c] += np.diff(sums[cuts])
        return total / np.maximum(count, 1)[:, None] + self.bias

    def posteriors(self, column: pa.Array) -> np.ndarray:
        """Class probabilities of whole texts; null counts as empty."""
        out = np.empty((len(column), len(self.bias)))
        for at, end, points, offsets in point_chunks(column):
            z = self.logits(points, offsets)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at:end] = z / z.sum(axis=1, keepdims=True)
        return out


def train(texts: list[str], classes: np.ndarray, n_classes: int, *, prior: np.ndarray | None = None, lengths: tuple[int, ...] = (3, 4), buckets: int = 1 << 18, size: int = 8, epochs: int = 5, least_steps: int = 1000, rate: float = 0.5, batch: int = 32, seed: int = 7) -> SubwordModel:
    """Fit vectors and output weights by stochastic gradient descent on softmax cross-entropy.

    There are ``epochs`` passes, or as many more as make ``least_steps`` steps.
    ``prior`` holds the classes' true shares where the sample was drawn by class; the bias is moved by it.
    """
    shift = np.uint32(32 - (buckets - 1).bit_length())
    rng = np.random.default_rng(seed)
    documents = []
    for _, _, points, offsets in point_chunks(pa.array(texts, pa.string())):
        ids: list[list[np.ndarray]] = [[] for _ in range(len(offsets) - 1)]
        for at, hashes in feature_hashes(points, offsets, lengths):
            bucket, cuts = hashes >> shift, np.searchsorted(at, offsets)
            for i, own in enumerate(ids):
                own.append(bucket[cuts[i] : cuts[i + 1]])
        for own in ids:
            found, counts = np.unique(np.concatenate([*own, np.empty(0, np.uint32)]), return_counts=True)
            documents.append((found, (counts / max(1, counts.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / size, 1 / size, (buckets, size)).astype(np.float32)
    output, bias = np.zeros((size, n_classes), np.float32), np.zeros(n_classes, np.float32)
    a_pass = max(1, -(-len(documents) // batch))
    epochs = max(epochs, -(-least_steps // a_pass))
    steps, total = 0, epochs * a_pass
    for _ in range(epochs):
        order = rng.permutation(len(documents))
        for at in range(0, len(order), batch):
            own = [i for i in order[at : at + batch] if len(documents[i][0])]
            if own:
                step = rate * (1 - steps / total)
                ids = np.concatenate([documents[i][0] for i in own])
                weights = np.concatenate([documents[i][1] for i in own])
                sizes = np.array([len(documents[i][0]) for i in own])
                hidden = np.add.reduceat(vectors[ids] * weights[:, None], np.concatenate(([0], np.cumsum(sizes)[:-1])))
                z = hidden @ output + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(own)), classes[own]] -= 1
                back = p @ output.T
                output -= step * hidden.T @ p
                bias -= step * p.sum(axis=0) / len(own)
                np.add.at(vectors, ids, -step * weights[:, None] * np.repeat(back, sizes, axis=0))
            steps += 1
    if prior is not None:
        shares = np.bincount(classes, minlength=n_classes) / max(1, len(classes))
        bias = bias + np.log(np.maximum(prior, 1e-9)) - np.log(np.maximum(shares, 1e-9))
    return SubwordModel((vectors @ output).astype(np.float32), bias.astype(np.float64), lengths)


def _score(model: SubwordModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.posteriors(batch.column(1))[:, 1])], names=["id", "score"])

    return run


def quality_model(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1, rows_per_class: int = 2000) -> SubwordModel:
    """The model fitted on at most ``rows_per_class`` labelled documents of each class outside the held-out fold."""
    train_rows = fold(F.col("id"), folds) != held_out
    sample = labelled_sample(documents, labels, label_col="quality", rows=rows_per_class, keep=train_rows, id_col=id_col, text_col=text_col, by_class=True).orderBy("id").toPandas()
    share = labels.where((fold(F.col("doc_id"), folds) != held_out) & F.col("quality").isNotNull()).agg(F.avg(F.col("quality").cast("double")).alias("p")).first().p
    share = 0.5 if share is None else share
    if sample.label.nunique() == 2:
        model = train(sample.text.tolist(), sample.label.to_numpy(np.int64), 2, prior=np.array([1 - share, share]))
    else:
        model = SubwordModel(np.zeros((2, 2), np.float32), np.log(np.array([max(1 - share, 1e-9), max(share, 1e-9)])), ())
    return model


def without_low_quality(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, with all their columns, whose whole text is predicted good; one pass, no shuffle.

    Null and empty texts, null ids and repeated rows are judged as :func:`quality_scores` does; columns of any
    name are kept. Without a usable label every row stays; an empty table gives an empty result.
    """
    model = quality_model(documents, labels, id_col=id_col, text_col=text_col)
    return kept_rows(documents, text_col, lambda texts: model.posteriors(texts)[:, 1] >= 0.5)


def quality_scores(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1, rows_per_class: int = 2000) -> DataFrame:
    """(id, held_out, score, predicted): the probability that a document's quality label is 1.

    The model is fitted on at most ``rows_per_class`` labelled documents of each class outside the held-out
    fold, drawn by hash; the bias follows the classes' shares among all labelled rows outside it. Every
    whole text is scored by looking up one number for each word and character n-gram.

    Defined cases: a null text is empty; without features a text has the bias's probability. A null id is
    not held out. With no usable label every score is 0.5; with labels of one class, that class's share.
    Repeated rows are each scored alike. Other columns are ignored. An empty table gives an empty result.
    """
    model = quality_model(documents, labels, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out, rows_per_class=rows_per_class)
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = docs.mapInArrow(_score(model), "id long, score double")
    out = F.coalesce(fold(F.col("id"), folds) == held_out, F.lit(False))
    return scored.select(F.col("id").alias(id_col), out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
