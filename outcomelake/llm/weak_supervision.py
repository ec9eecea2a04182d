"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, kept_rows, labelled_sample
from ..sources.storage import written

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are terms beside whole words.
STEMS = (3, 4, 5, 6)
#: Words whose terms a task remembers, and how long they may be; beyond that it starts anew (this bounds memory
#: and changes no score).
REMEMBERED_WORDS, REMEMBERED_LENGTH = 60_000, 64
TOXIC, CLEAN, ABSTAIN = 1, 0, 2


def terms_of(word: str) -> list[str]:
    """A lower-case word as a term, and its beginnings, marked with a trailing ``*``."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def words_of(text: str) -> set[str]:
    """The distinct lower-case runs of letters of a whole text."""
    return set(_WORD.findall(text.lower()))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, by label, over what this task reads of the bounded sample."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
            counts[label].update({t for w in words_of(text) for t in terms_of(w)})
    terms = list(counts[0] | counts[1])
    yield pa.record_batch([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])


def _log_tail(hits: int, n: int, p: float) -> float:
    """Natural logarithm of the chance of ``hits`` or more in ``n`` draws of probability ``p``."""
    logs = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * np.log(p) + (n - k) * np.log1p(-p) for k in range(hits, n + 1)]
    return float(np.logaddexp.reduce(logs))


def mine_terms(sample: DataFrame, most: int, expected_false: float = 0.3) -> list[tuple[str, int, int]]:
    """(term, toxic documents, clean documents): terms far too frequent among toxic documents to be chance.

    Over all terms in as many documents or more, fewer than ``expected_false`` would look so by chance. A
    term must be 4 times as frequent in toxic documents as in clean ones, which is possible at every share
    of toxic documents, and 9 of 10 documents with it must be toxic.
    """
    totals = {row.label: row.n for row in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return []
    share = totals[1] / (totals[0] + totals[1])
    counts = sample.select("text", "label").mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts.where("toxic + clean >= 3"), "toxicity-terms")
    by_size = {row.n: row.terms for row in counts.groupBy((F.col("toxic") + F.col("clean")).alias("n")).agg(F.count("*").alias("terms")).collect()}
    at_least, total = {}, 0
    for n in sorted(by_size, reverse=True):
        total += by_size[n]
        at_least[n] = total
    likely = counts.where(F.col("toxic") * (1 - share) >= 4 * share * F.col("clean")).where("toxic >= 9 * clean")
    chance = likely.mapInArrow(_unlikely(share, at_least, expected_false), "term string, toxic long, clean long")
    return [tuple(r) for r in chance.orderBy(F.desc("toxic"), "clean", "term").limit(most).collect()]


def _unlikely(share: float, at_least: dict[int, int], expected_false: float):
    """The terms whose toxic documents are too many for chance, given how many terms stand in as many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = batch["toxic"].to_numpy(), batch["clean"].to_numpy()
            kept = [_log_tail(int(t), int(t + c), share) + np.log(at_least[int(t + c)]) <= np.log(expected_false) for t, c in zip(toxic, clean, strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return run


PATTERNS = ("shouting", "exclaiming", "several_terms", "two_terms", "no_term", "short_clean")


def pattern_votes(text: str, hits: int) -> list[int]:
    """Votes of the pattern voters, in the order of :data:`PATTERNS`."""
    upper, lower = sum(map(str.isupper, text)), sum(map(str.islower, text))
    return [
        TOXIC if upper > lower else ABSTAIN,
        TOXIC if "!!" in text else ABSTAIN,
        TOXIC if hits >= 3 else ABSTAIN,
        TOXIC if hits >= 2 else CLEAN,
        CLEAN if hits == 0 else ABSTAIN,
        CLEAN if hits == 0 and len(text) < 200 else ABSTAIN,
    ]


@dataclass
class LabelModel:
    """A class prior and, for each voter, a table of its vote given the class and the vote of its parent voter."""

    prior: float
    parents: list[int]
    tables: np.ndarray  # voter, class, parent's vote, own vote
    accuracies: np.ndarray
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic class for each row of votes."""
        logs = np.log(np.array([1 - self.prior, self.prior])) + np.zeros((len(votes), 2))
        for j, parent in enumerate(self.parents):
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), np.int64)
            logs += np.log(self.tables[j][:, given, votes[:, j]]).T
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def near_copies(hot: np.ndarray, agreement: float = 0.98) -> list[int]:
    """For each voter itself, or an earlier one that gives the same vote in that share of the rows where either votes."""
    votes = hot[:, :, :2].reshape(len(hot), -1)
    both = (votes.T @ votes).reshape(hot.shape[1], 2, hot.shape[1], 2)
    same = both[:, 0, :, 0] + both[:, 1, :, 1]
    cast = same.diagonal()
    either = cast[:, None] + cast - both.sum((1, 3))
    first = []
    for j in range(hot.shape[1]):
        like = [i for i in range(j) if first[i] == i and either[i, j] and same[i, j] >= agreement * either[i, j]]
        first.append(like[0] if like else j)
    return first


def triple_moments(signed: np.ndarray, prior: float, most_z: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(d, dependent pairs): each voter's mean vote over toxic rows less that over clean rows, without labels.

    Of voters that err independently the covariance is prior * (1 - prior) * d_i * d_j, so three of them give
    d_i from their three covariances; the median over all pairs of others is taken. The pair whose covariance
    is furthest from its product, if by more than ``most_z`` standard errors, is dependent and left out, and all is
    measured again.
    """
    n, voters = signed.shape
    spread = prior * (1 - prior)
    covariance = np.cov(signed, rowvar=False, bias=True).reshape(voters, voters)
    deviation = np.sqrt(np.maximum(covariance.diagonal(), 1e-12))
    error = np.outer(deviation, deviation) / np.sqrt(n)
    free, dependent = ~np.eye(voters, dtype=bool), []
    while True:
        clear = free & (np.abs(covariance) > 2 * error)
        d = np.zeros(voters)
        for i in range(voters):
            others = np.flatnonzero(free[i])
            j, k = np.array([(j, k) for a, j in enumerate(others) for k in others[a + 1 :] if clear[j, k]], dtype=np.int64).reshape(-1, 2).T
            if len(j):
                d[i] = np.median(np.sqrt(np.maximum(covariance[i, j] * covariance[i, k] / covariance[j, k], 0) / spread))
            elif len(others):
                d[i] = np.sqrt(max(covariance[i, others].max(), 0) / spread)
        off = np.where(free, (covariance - spread * np.outer(d, d)) / error, 0)
        i, j = np.unravel_index(np.abs(off).argmax(), off.shape) if voters > 3 else (0, 0)
        if abs(off[i, j]) <= most_z or len(dependent) >= voters * (voters - 1) // 4:
            return d, dependent
        free[i, j] = free[j, i] = False
        dependent.append((int(i), int(j)))


def _forest(weight: np.ndarray) -> list[int]:
    """Parents in the forest of greatest total weight; pairs without a positive weight are not joined."""
    voters = len(weight)
    group, joined = list(range(voters)), [[] for _ in range(voters)]
    for i, j in sorted(zip(*np.nonzero(np.triu(weight > 0, 1)), strict=True), key=lambda p: -weight[p]):
        if group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
            joined[i].append(int(j))
            joined[j].append(int(i))
    parents, seen = [-1] * voters, set()
    for root in range(voters):
        stack = [root] if root not in seen else []
        while stack:
            at = stack.pop()
            seen.add(at)
            for other in joined[at]:
                if other not in seen:
                    parents[other] = at
                    stack.append(other)
    return parents


def fit_label_model(votes: np.ndarray, prior: float, *, rounds: int = 5000, smoothing: float = 0.5, strength: float = 80.0, tolerance: float = 1e-4, structures: int = 3) -> LabelModel:
    """Accuracies and correlations of the voters, from how they agree; labels give the share ``prior`` of toxic rows alone.

    Voters that all but repeat an earlier one hang on it from the start. For the others :func:`triple_moments` gives
    what a vote says of the class, and which pairs depend on one another; expectation-maximisation goes on from
    there until no posterior moves by more than ``tolerance``. Then each pair's mutual information, given the class, is
    measured: pairs whose information pays for its parameters (by the Bayesian information criterion) are joined in
    a forest, in which a voter's table has its parent's vote as a condition, and the model is fitted again,
    ``structures`` times at most. Where moments tell nothing of a voter, a vote multiplies the odds of its class by
    ``strength`` at the start. Equal rows of votes are worked on once.
    """
    votes, counts = np.unique(votes, axis=0, return_counts=True)
    n, voters = int(counts.sum()), votes.shape[1]
    hot = (votes[:, :, None] == np.arange(3)).astype(np.float64)
    first = near_copies(hot * np.sqrt(counts)[:, None, None])
    own = [j for j in range(voters) if first[j] == j]
    signed = np.repeat(hot[:, own, TOXIC] - hot[:, own, CLEAN], counts, axis=0)
    d, dependent = triple_moments(signed, prior, np.sqrt(2 * np.log(n) + 2 * np.log(max(2, len(own)))))
    used = {j: values for j, values in enumerate((hot.any(0)).sum(1))}
    weight = np.zeros((voters, voters))
    covariance = np.cov(signed, rowvar=False, bias=True).reshape(len(own), len(own))
    for i, j in dependent:
        weight[own[i], own[j]] = weight[own[j], own[i]] = 1e-9 + abs(covariance[i, j] - prior * (1 - prior) * d[i] * d[j]) / np.sqrt(max(covariance[i, i] * covariance[j, j], 1e-12))
    copied = [(first[j], j) for j in range(voters) if first[j] != j]

    def parents_of(weight: np.ndarray) -> list[int]:
        weight = weight.copy()
        for i, j in copied:
            weight[j], weight[:, j] = 0, 0
        for i, j in copied:
            weight[i, j] = weight[j, i] = np.inf
        return _forest(weight)

    def tables_of(parents: list[int], q: np.ndarray) -> np.ndarray:
        tables = np.empty((voters, 2, 3, 3))
        for j, parent in enumerate(parents):
            code = votes[:, j] + 3 * (votes[:, parent] if parent >= 0 else 0)
            for c, w in enumerate(((1 - q) * counts, q * counts)):
                found = np.bincount(code, weights=w, minlength=9).reshape(3, 3)
                tables[j, c] = (found if parent >= 0 else found[:1].repeat(3, axis=0)) + smoothing
        return tables / tables.sum(-1, keepdims=True)

    # What each vote says of the class: its share in either class by its covariance with the other voters.
    start = np.empty((voters, 2, 3))
    odds = prior / (1 - prior) * np.array([1 / strength, strength, 1.0])  # of rows with a vote CLEAN, TOXIC, ABSTAIN
    shares = (hot * counts[:, None, None]).sum(0) / n
    toxic = odds / (1 + odds)
    bound = {frozenset((own[i], own[j])) for i, j in dependent}
    centred = signed - signed.mean(0)
    for j in range(voters):
        others = [i for i in range(len(own)) if own[i] != first[j] and frozenset((own[i], first[j])) not in bound]
        square = float((d[others] ** 2).sum())
        if square > 1e-3 and d[own.index(first[j])] > 0:
            with_others = np.repeat(hot[:, j], counts, axis=0).T @ centred[:, others] / n
            shift = with_others @ d[others] / (prior * (1 - prior) * square)
            start[j] = np.clip(shares[j] + np.outer([-prior, 1 - prior], shift), 1e-3, 1)
            start[j][:, shares[j] == 0] = 1e-6
        else:
            start[j] = np.stack((1 - toxic, toxic)) * shares[j] + 1e-6
    start /= start.sum(-1, keepdims=True)
    alone = [j if first[j] == j else -2 for j in range(voters)]
    logs = np.log([1 - prior, prior]) + sum(np.log(start[j][:, votes[:, j]]).T for j in range(voters) if alone[j] >= 0)
    q = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    parents, information = parents_of(weight), np.zeros((voters, voters))
    model = LabelModel(prior, parents, tables_of(parents, q), np.empty(0), information)
    for _ in range(structures):
        for _ in range(rounds):
            before, q = q, model.posterior(votes)
            model.tables = tables_of(parents, q)
            if np.abs(q - before).max() <= tolerance:
                break
        flat, joint = hot.reshape(len(hot), -1), []
        for w in ((1 - q) * counts, q * counts):
            joint.append(((flat * w[:, None]).T @ flat).reshape(voters, 3, voters, 3).transpose(0, 2, 1, 3))
        p = (np.stack(joint) + smoothing / 9) / (n + smoothing * 2)
        by_class = p.sum((3, 4), keepdims=True)
        information = (p * np.log(p * by_class / (p.sum(4, keepdims=True) * p.sum(3, keepdims=True)))).sum((0, 3, 4))
        cost = np.array([[(used[i] - 1) * (used[j] - 1) * np.log(n) / n for j in range(voters)] for i in range(voters)])
        gain = information - cost
        np.fill_diagonal(gain, 0)
        fresh = parents_of(gain)
        if fresh == parents:
            break
        parents = fresh
        model = LabelModel(prior, parents, tables_of(parents, q), np.empty(0), information)
    model.correlations = information
    agreed = ((hot[:, :, TOXIC] * q[:, None] + hot[:, :, CLEAN] * (1 - q)[:, None]) * counts[:, None]).sum(0)
    model.accuracies = agreed / np.maximum((hot[:, :, :2] * counts[:, None, None]).sum((0, 2)), 1)
    return model


@dataclass
class LinearModel:
    """Weights of terms that a document holds, and a bias."""

    weights: dict[str, float]
    bias: float

    def score(self, words: set[str], remembered: dict[str, tuple[str, ...]]) -> float:
        held: set[str] = set()
        for word in words:
            found = remembered.get(word)
            if found is None:
                found = tuple(t for t in terms_of(word) if t in self.weights)
                if len(word) <= REMEMBERED_LENGTH:
                    if len(remembered) >= REMEMBERED_WORDS:
                        remembered.clear()
                    remembered[word] = found
            if found:
                held.update(found)
        z = self.bias + sum(self.weights[t] for t in sorted(held))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train_linear(rows: list[list[int]], target: np.ndarray, terms: list[str], *, ridge: float = 1e-4, steps: int = 600, rate: float = 1.0) -> LinearModel:
    """Logistic regression of posterior labels on which terms a document holds, by full-batch gradient steps."""
    which = np.array([t for r in rows for t in r], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights, bias, square = np.zeros(len(terms)), float(np.log(max(target.mean(), 1e-6) / max(1 - target.mean(), 1e-6))), np.full(len(terms) + 1, 1e-8)
    for _ in range(steps):
        z = bias + np.bincount(owner, weights=weights[which], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        g = np.append(np.bincount(which, weights=error[owner], minlength=len(terms)) / len(rows) + ridge * weights, error.mean())
        square += g * g
        step = rate * g / np.sqrt(square)
        weights, bias = weights - step[:-1], bias - step[-1]
    return LinearModel(dict(zip(terms, weights.tolist(), strict=True)), float(bias))


def fit(sample: DataFrame, *, most_terms: int = 400, lexicon_voters: int = 40) -> LinearModel:
    """Mine terms, let voters vote on the sample, fit the label model and train the classifier on its posteriors.

    Labels serve to find the lexicon and the share of toxic documents from which the label model starts.
    How right each voter is, and which repeat one another, the label model finds from their votes alone; the
    classifier's targets are its posteriors. Without labels of both classes, or without terms, the model is
    the share of toxic documents (0 without any label).
    """
    texts = sample.orderBy("id").toPandas()
    share = float(texts.label.mean()) if len(texts) else 0.0
    mined = mine_terms(sample, most_terms)
    if not mined:
        return LinearModel({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    terms = [t for t, _, _ in mined]
    number = {t: i for i, t in enumerate(terms)}
    held = [sorted({number[t] for w in words_of(text) for t in terms_of(w) if t in number}) for text in texts.text]
    presence = np.zeros((len(held), len(terms)), dtype=bool)
    for i, row in enumerate(held):
        presence[i, row] = True
    # Voters of the lexicon: the term that adds most documents that fewer than three chosen ones hold,
    # again and again; terms in nearly the same documents as a chosen one are its doubles.
    need, chosen, presence_left = np.full(len(held), 3), [], presence.copy()
    while len(chosen) < min(lexicon_voters, len(terms)):
        gain = (presence_left & (need > 0)[:, None]).sum(0)
        if not gain.max():
            break
        chosen.append(int(gain.argmax()))
        own = presence[:, chosen[-1]]
        need[own] -= 1
        both, size = (presence & own[:, None]).sum(0), presence.sum(0)
        presence_left[:, both >= 0.9 * np.maximum(size, own.sum())] = False
    stems = [t for t in terms if t.endswith("*")]
    whole = presence[:, [not t.endswith("*") for t in terms]].sum(1)
    hits = np.maximum(whole, presence[:, [t in stems for t in terms]].sum(1))
    votes = np.full((len(held), len(chosen) + len(PATTERNS)), ABSTAIN)
    votes[:, : len(chosen)][presence[:, chosen]] = TOXIC
    votes[:, len(chosen) :] = [pattern_votes(text, int(n)) for text, n in zip(texts.text, hits, strict=True)]
    prior = min(max(share, 1e-3), 1 - 1e-3)
    posterior = fit_label_model(votes, prior).posterior(votes)
    return train_linear(held, posterior, terms)


def _score(model: LinearModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            scores = [model.score(words_of(text.as_py() or ""), remembered) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def toxicity_model(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, fit_rows: int = 12_000) -> LinearModel:
    """The model fitted on at most ``fit_rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(documents, labels, label_col="toxic", rows=fit_rows, keep=fold(F.col("id"), folds) != held_out, id_col=id_col, text_col=text_col)
    return fit(sample)


def without_toxic(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, with all their columns, whose whole text is not predicted toxic; one pass, no shuffle.

    Null and empty texts, null ids and repeated rows are judged as :func:`toxicity_scores` does; columns of any
    name are kept. Without labels of both classes all rows go or stay by the share of toxic labels; an empty
    table gives an empty result.
    """
    model = toxicity_model(documents, labels, id_col=id_col, text_col=text_col)
    remembered: dict[str, tuple[str, ...]] = {}  # every task gets its own, empty at first

    def is_clean(texts: pa.Array) -> list[bool]:
        return [model.score(words_of(text.as_py() or ""), remembered) < 0.5 for text in texts]

    return kept_rows(documents, text_col, is_clean)


def toxicity_scores(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, fit_rows: int = 12_000) -> DataFrame:
    """(id, held_out, score, predicted): the probability that a document is toxic.

    The model is fitted on at most ``fit_rows`` labelled documents outside the held-out fold, those with
    the smallest hashes of their ids; every whole text is scored.

    Defined cases: a null or empty text has the bias's probability. A null id is not held out. Without
    labels of both classes every score is the share of toxic labels, 0 when there are none. Repeated rows
    are each scored alike. Other columns are ignored. An empty table gives an empty result.
    """
    model = toxicity_model(documents, labels, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out, fit_rows=fit_rows)
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = docs.mapInArrow(_score(model), "id long, score double")
    out = F.coalesce(fold(F.col("id"), folds) == held_out, F.lit(False))
    return scored.select(F.col("id").alias(id_col), out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
