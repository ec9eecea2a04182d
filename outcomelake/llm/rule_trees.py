"""Quality rules: document statistics, fixed base rules, and gradient-boosted trees with monotonic constraints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold
from ..sources.storage import written
from .text_kernels import BLANKS, Texts, byte_table, mix64, text_chunks

SYMBOLS = byte_table(*((ord(c), ord(c)) for c in "#*$%&|<>"))
_UPPER, _LOWER, _DIGIT = byte_table((65, 90)), byte_table((97, 122)), byte_table((48, 57))
_MARKS = byte_table((33, 34), (39, 41), (44, 47), (58, 59), (63, 64), (91, 96), (123, 126))
_CONTINUED = byte_table((0x80, 0xBF))
_ODD = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_again", "n_upper", "n_lower", "n_digits", "n_marks")

#: The trees' inputs and how the verdict may move with each: -1 never up as it grows, 0 freely.
FEATURES = (("log_words", 0), ("word_length", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("again_share", -1), ("upper_share", -1), ("digit_share", -1), ("mark_share", 0), ("lines_per_word", 0))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def _equal_to_earlier(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def statistics(texts: Texts) -> dict[str, np.ndarray]:
    """:data:`COUNTS` of each text. A word is a run of non-blanks; lines end at newlines."""
    data, offsets, n = texts.data, texts.offsets, len(texts)
    starts, ends, first = texts.words(BLANKS)
    words, owner = np.diff(first), np.repeat(np.arange(n), np.diff(first))
    hashes = texts.hashes(starts, ends)
    by_text = mix64((np.arange(n, dtype=np.uint64) + np.uint64(1)) * _ODD)
    out = {"n_words": words}
    out["word_chars"] = _per_text(~BLANKS[data] & ~_CONTINUED[data], offsets)
    for name, table in (("n_symbols", SYMBOLS), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_marks", _MARKS)):
        out[name] = _per_text(table[data], offsets)

    lone = np.zeros(256, dtype=bool)
    lone[10] = True
    line_starts, line_ends, _ = texts.words(lone)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    again = _equal_to_earlier(texts.hashes(line_starts, line_ends) ^ by_text[line_owner])
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    out["n_dup_lines"] = np.bincount(line_owner[again], minlength=n)

    covered = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 2:
        whole = owner[2:] == owner[:-2]
        window = mix64(mix64(hashes[:-2] + by_text[owner[:-2]]) + hashes[1:-1] * _ODD) + hashes[2:]
        at = np.flatnonzero(whole)
        keys = mix64(window[at])
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        at = at[twice]
        for j in range(3):
            covered[at + j] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=n)
    next_same = np.zeros(len(hashes), dtype=bool)
    next_same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out["n_again"] = np.bincount(owner[next_same], minlength=n)
    return {name: out[name].astype(np.int64) for name in COUNTS}


def inputs(counts: dict[str, np.ndarray]) -> np.ndarray:
    """A row of :data:`FEATURES` for each text."""
    c = {k: np.asarray(v, dtype=np.float64) for k, v in counts.items()}
    words, chars, letters = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.stack([np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words, c["n_again"] / words, c["n_upper"] / letters, c["n_digits"] / chars, c["n_marks"] / chars, c["n_lines"] / words], axis=1)


@dataclass
class Trees:
    """Boosted trees as flat node arrays; node 0 of each tree is its root, and a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches, all rows and trees a level at a time."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def boost(x: np.ndarray, y: np.ndarray, directions: tuple[int, ...], *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Logistic boosting over histograms.

    A split on a constrained feature must order its children's values; each child's values are then
    bounded by the mean of the two, so that the order holds for whole subtrees and so for the sum.
    """
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)], axis=1)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        number = len(nodes)
        g, h = gradient[rows], hessian[rows]
        value = float(np.clip(-g.sum() / (h.sum() + ridge), low, high))
        nodes.append([0, np.inf, number, number, rate * value])
        if level == depth or len(rows) < 2 * least:
            margin[rows] += rate * value
            return number
        best, parent = (1e-6,), g.sum() ** 2 / (h.sum() + ridge)
        for f, direction in enumerate(directions):
            size = len(edges[f]) + 1
            sums = [np.cumsum(np.bincount(binned[rows, f], weights=w, minlength=size)) for w in (g, h, np.ones(len(rows)))]
            (gl, hl, nl), (gt, ht, nt) = (s[:-1] for s in sums), (s[-1] for s in sums)
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gt - gl) / (ht - hl + ridge), low, high)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - parent
            gain[(nl < least) | (nt - nl < least) | (direction * (vr - vl) < 0)] = -np.inf
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (gain[k], f, k, direction, vl[k], vr[k])
        if len(best) == 1:
            margin[rows] += rate * value
            return number
        _, f, k, direction, vl, vr = best
        middle = (vl + vr) / 2
        inside = binned[rows, f] <= k
        to_left = grow(rows[inside], level + 1, low if direction >= 0 else middle, high if direction <= 0 else middle)
        to_right = grow(rows[~inside], level + 1, low if direction <= 0 else middle, high if direction >= 0 else middle)
        nodes[number] = [f, edges[f][k], to_left, to_right, 0.0]
        return number

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    f, t, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(f, t, left, right, value, np.array(roots), depth, base)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, texts in text_chunks(batch.column(1)):
            counts = statistics(texts)
            yield pa.record_batch([batch.column(0)[at:end], *(pa.array(counts[c]) for c in COUNTS)], names=["id", *COUNTS])


def _judge(trees: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = inputs({c: batch[c].to_numpy() for c in COUNTS})
            score = trees.probabilities(x) if trees is not None else np.ones(len(x))
            yield pa.record_batch([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return run


def quality_rules(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1, fit_rows: int = 20_000, least_words: int = 50, most_repeated: float = 0.5) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept).

    All counts are over whole texts. ``base_failed`` is n_words < ``least_words`` or n_repeat_words above
    ``most_repeated`` of the words; such documents are not kept. The others are kept where boosted trees
    over the counts' shares give a good-quality probability of 0.5 or more. The trees are fitted on the
    counts of at most ``fit_rows`` labelled documents outside the held-out fold, those with the smallest
    hashes; more symbols, repeated lines, repeated windows, stuttered words, capitals or digits never
    raise the verdict.

    Words and lines are compared within a text by 62-bit hashes of fixed bases, so texts made to collide could be
    counted wrongly.

    Defined cases: a null or empty text has counts of 0 and fails the base rules. Without labels of both
    classes every score is 1, so the base rules decide alone. Null ids and repeated rows are judged like
    others; of rows that repeat an id, the trees are fitted on the one with the least counts. Other columns are ignored. An empty table gives an empty result.
    """
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = written(docs.mapInArrow(_count, "id long, " + ", ".join(f"{c} long" for c in COUNTS)), "rules-counts")
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("label")).where((fold(F.col("id"), folds) != held_out) & F.col("label").isNotNull())
    known = known.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    sample = counted.join(F.broadcast(known), "id").groupBy("id").agg(F.min(F.struct(*COUNTS)).alias("least"), F.first("label").alias("label"))
    sample = sample.select("id", "label", "least.*").orderBy("id").toPandas()
    trees = None
    if sample.label.nunique() == 2:
        trees = boost(inputs({c: sample[c].to_numpy() for c in COUNTS}), sample.label.to_numpy(np.float64), tuple(d for _, d in FEATURES))
    judged = counted.mapInArrow(_judge(trees), "id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    result = judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= 0.5))
    return result.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
