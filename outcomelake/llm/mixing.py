"""Mixing to target weights: domain posteriors by a classifier, and document rates by projected-gradient least squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..sources.storage import written
from .labelled import MOST_BYTES, one_text_each, within_bytes
from .subword import SubwordModel, train
from .text_kernels import BLANKS, text_chunks

#: More domains than this are an error, since every document carries a posterior for each.
MOST_DOMAINS = 4096
#: Up to so many domains each is a column of the sums; beyond it the sums are rows.
COLUMN_DOMAINS = 64
#: Documents that the classifier is fitted on, over all domains.
MOST_ROWS = 32_000
#: Rounds after which the documents' state is written, so that no round goes over more rounds than these again.
KEEP_ROUNDS = 10

#: Columns that are added while documents are rated; no column of theirs is lost if it has such a name.
TOKENS, POSTERIORS = "mixing tokens", "mixing posteriors"


def _memberships(model: SubwordModel, text_at: int, keep: list[int]):
    """Batches with the columns numbered ``keep``, their tokens and their posteriors; the text is read where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posteriors, tokens = model.posteriors(batch.column(text_at)), np.zeros(batch.num_rows, np.int64)
            for at, end, texts in text_chunks(batch.column(text_at)):
                tokens[at:end] = np.diff(texts.words(BLANKS)[2])
            flat, offsets = pa.array(posteriors.ravel()), np.arange(batch.num_rows + 1, dtype=np.int32) * posteriors.shape[1]
            columns = [*(batch.column(i) for i in keep), pa.array(tokens), pa.ListArray.from_arrays(pa.array(offsets), flat)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"c{i}" for i in keep), TOKENS, POSTERIORS])

    return run


def domain_model(documents: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, domain_col: str, rows_per_domain: int) -> tuple[list[str], SubwordModel]:
    """Domains, and a classifier of texts fitted on documents that the label table covers.

    At most ``rows_per_domain`` documents of each domain serve (:data:`MOST_ROWS` over all domains, and texts of
    :data:`~.labelled.MOST_BYTES`), those with the smallest hashes of their ids. Documents of a null domain serve for
    none; of rows that repeat id and domain the text with the least hash serves alone.
    """
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{domain_col}`").cast("string").alias("domain"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    named = docs.select("id", "domain").where("id is not null and domain is not null").distinct()
    known = written(named.join(labels.select(F.col("doc_id").cast("long").alias("id")).distinct(), "id"), "mixing-labelled")
    domains = sorted(r.domain for r in known.select("domain").distinct().limit(MOST_DOMAINS + 1).collect())
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    if len(domains) < 2:
        return domains or ["all"], SubwordModel(np.zeros((2, max(1, len(domains))), np.float32), np.zeros(max(1, len(domains))), ())
    most = max(1, min(rows_per_domain, MOST_ROWS // len(domains)))
    place = F.row_number().over(Window.partitionBy("domain").orderBy("order", "id"))
    chosen = known.withColumn("order", F.xxhash64("id")).withColumn("place", place).where(F.col("place") <= most)
    sample = written(one_text_each(docs.join(F.broadcast(chosen), ["id", "domain"]), ["id", "domain"], ["place"]), "mixing-sample")
    sample = within_bytes(sample, MOST_BYTES, ["place", "domain", "id"]).orderBy("id", "text", "domain").toPandas()
    classes = sample.domain.map({d: i for i, d in enumerate(domains)}).to_numpy(np.int64)
    return domains, train(sample.text.tolist(), classes, len(domains), lengths=(3,), buckets=1 << 16, least_steps=600)


def domain_sums(memberships: DataFrame, weight: Column, k: int) -> np.ndarray:
    """The sum over all documents of a weight times each of the posteriors; zeros of no documents."""
    if k <= COLUMN_DOMAINS:
        row = memberships.agg(*(F.sum(weight * F.col("posteriors")[d]).alias(f"d{d}") for d in range(k))).first()
        return np.array([x or 0.0 for x in row], dtype=np.float64)
    rows = memberships.select(weight.alias("weight"), "posteriors").select("weight", F.posexplode("posteriors").alias("domain", "p"))
    out = np.zeros(k)
    for row in rows.groupBy("domain").agg(F.sum(F.col("weight") * F.col("p")).alias("s")).collect():
        out[row.domain] = row.s or 0.0
    return out


def extreme_pulls(memberships: DataFrame, total: float, k: int) -> tuple[float, float]:
    """Bounds of the eigenvalues of sum_i (n_i / N) p_i p_i', which say how fast the rates of the domains move.

    Up to :data:`COLUMN_DOMAINS` domains the matrix is summed up. Its rows add up to the domains' parts, the
    greatest of which is no less than any eigenvalue; this serves beyond.
    """
    if k > COLUMN_DOMAINS:
        return 0.0, float(domain_sums(memberships, F.col("tokens") / F.lit(total), k).max())
    matrix = np.array([domain_sums(memberships, F.col("tokens") / F.lit(total) * F.col("posteriors")[i], k) for i in range(k)]) if k <= 8 else _pull_matrix(memberships, total, k)
    values = np.linalg.eigvalsh(matrix)
    return float(values[0]), float(values[-1])


def _pull_matrix(memberships: DataFrame, total: float, k: int) -> np.ndarray:
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = memberships.agg(*(F.sum(F.col("tokens") / F.lit(total) * F.col("posteriors")[i] * F.col("posteriors")[j]).alias(f"m{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((k, k))
    for i, j in pairs:
        out[i, j] = out[j, i] = sums[f"m{i}_{j}"] or 0.0
    return out


def fit_rates(memberships: DataFrame, targets: np.ndarray, *, ridge: float = 1e-4, most_rounds: int = 100, tolerance: float = 1e-3) -> Column:
    """Every document's rate, as a column of its posteriors.

    With n_i tokens, posteriors p_i and N tokens in all, the rates r >= 0 minimise
    |sum_i (n_i / N) p_i r_i - targets|^2 + ridge * sum_i (n_i / N) (r_i - 1)^2. In the metric that weighs
    a document by its tokens, a projected gradient step for document i reads p_i . residual and its own
    rate only. So a rate follows from the residuals so far, and a round is one sum over the documents of
    as many numbers as there are domains. Every :data:`KEEP_ROUNDS` rounds tokens, posteriors and the state of each
    document are written, so that the rounds' cost grows with their number only. The step and the momentum come
    from :func:`extreme_pulls`. Rounds end when no domain's share is further than
    ``tolerance`` from its target or from its last value's by a hundredth of that.
    """
    k = len(targets)
    total = memberships.agg(F.sum("tokens").alias("n")).first().n or 0
    if not total:
        return F.lit(1.0)
    least, most = (x + ridge for x in extreme_pulls(memberships, float(total), k))
    step, spread = 1 / most, np.sqrt(most / max(least, ridge))
    momentum = float((spread - 1) / (spread + 1))
    history: list[np.ndarray] = []
    kept = 0
    state = memberships.select("tokens", "posteriors").withColumn("state", first_state())
    for _ in range(most_rounds):
        if len(history) - kept == KEEP_ROUNDS:
            state = written(state.withColumn("state", rate_column(history[kept:], step, momentum, ridge, F.col("state"))), "mixing-state")
            kept = len(history)
        ahead = rate_column(history[kept:], step, momentum, ridge, F.col("state"))["point"]
        history.append(domain_sums(state, F.col("tokens") / F.lit(float(total)) * ahead, k) - targets)
        if np.abs(history[-1]).max() <= tolerance or (len(history) > 1 and np.abs(history[-1] - history[-2]).max() <= tolerance / 100):
            break
    return rate_column(history, step, momentum, ridge, first_state())["rate"]


def first_state() -> Column:
    """A document's rate, and the point at which the next step is taken, before the first round."""
    return F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("point"))


def rate_column(history: list[np.ndarray], step: float, momentum: float, ridge: float, start: Column) -> Column:
    """A document's state after the given residuals, from the state ``start`` on."""
    if not history:
        return start

    def move(state: Column, residual: Column) -> Column:
        pull = F.aggregate(F.zip_with("posteriors", residual, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
        new = F.greatest(F.lit(0.0), state["point"] - step * (pull + ridge * (state["point"] - 1.0)))
        return F.struct(new.alias("rate"), (new + momentum * (new - state["rate"])).alias("point"))

    return F.aggregate(F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in history)), start, move)


def targets_of(domains: list[str], weights: dict[str, float] | None, present: np.ndarray) -> np.ndarray:
    """Each domain's target part of the tokens.

    Without ``weights`` all are alike. A domain that ``weights`` does not name keeps its ``present`` part, and
    the named ones share the rest by their weights. Weights of unknown domains are left out.
    """
    if not weights:
        return np.full(len(domains), 1 / len(domains))
    own = np.array([weights.get(d, 0.0) for d in domains])
    named = np.array([d in weights for d in domains])
    if own.sum() <= 0:
        return present
    return np.where(named, own / own.sum() * (1 - present[~named].sum()), present)


def present_parts(memberships: DataFrame, k: int) -> np.ndarray:
    """The domains' expected parts of the tokens before mixing; equal ones of no tokens."""
    total = memberships.agg(F.sum("tokens").alias("n")).first().n or 0
    return domain_sums(memberships, F.col("tokens") / F.lit(float(total)), k) if total else np.full(k, 1 / k)


def _rated(documents: DataFrame, labels: DataFrame, *, keep: list[str], id_col: str, text_col: str, domain_col: str, weights: dict[str, float] | None, rows_per_domain: int, ridge: float) -> DataFrame:
    """The columns ``keep`` as c0, c1, ..., with id, tokens, posteriors, rate and copies.

    Every text goes to Python once, within its row.
    """
    domains, model = domain_model(documents, labels, id_col=id_col, text_col=text_col, domain_col=domain_col, rows_per_domain=rows_per_domain)
    columns = list(dict.fromkeys([*keep, id_col, text_col]))
    kinds = {f.name: f.dataType for f in documents.schema}
    rows = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    if not isinstance(kinds[text_col], StringType):
        rows = rows.withColumn("text", F.col(f"c{columns.index(text_col)}").cast("string"))
    text_at = columns.index(text_col) if isinstance(kinds[text_col], StringType) else len(columns)
    kept = sorted({*range(len(keep)), columns.index(id_col)})
    schema = StructType([*(StructField(f"c{i}", kinds[columns[i]]) for i in kept), StructField(TOKENS, LongType()), StructField(POSTERIORS, ArrayType(DoubleType()))])
    memberships = written(rows.mapInArrow(_memberships(model, text_at, kept), schema), "mixing-memberships")
    memberships = memberships.withColumns({"id": F.col(f"c{columns.index(id_col)}").cast("long"), "tokens": F.col(f"`{TOKENS}`"), "posteriors": F.col(f"`{POSTERIORS}`")})
    wanted = targets_of(domains, weights, present_parts(memberships, len(domains)))
    rate = fit_rates(memberships, wanted, ridge=ridge)
    chance = F.pmod(F.xxhash64("id", F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return memberships.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def mix(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", weights: dict[str, float] | None = None, rows_per_domain: int = 500, ridge: float = 1e-4) -> DataFrame:
    """(id, tokens, posteriors, rate, copies): how often each document enters the mixture.

    Domains are the values of ``domain_col`` among documents that the label table covers; a classifier
    fitted on ``rows_per_domain`` of each gives every document its posteriors, in the domains' order.
    ``weights`` are the domains' target parts of the tokens, equal ones without it; the expected total
    stays that of the input, and a domain that ``weights`` does not name keeps its part. ``copies`` is the
    rate rounded down, or up with the probability of its fraction, by a hash of the id.
    :func:`mixture_residual` says how near the targets the rates came.

    Defined cases: a null or empty text has no tokens and rate as its posteriors say. A null id is mixed
    by the hash of null. Repeated rows are rated alike. With fewer than two domains all rates are near 1.
    Weights of unknown domains are left out and the rest scaled to sum 1. More than :data:`MOST_DOMAINS` domains
    are an error. Other columns are ignored. An empty table gives an empty result.
    """
    rated = _rated(documents, labels, keep=[], id_col=id_col, text_col=text_col, domain_col=domain_col, weights=weights, rows_per_domain=rows_per_domain, ridge=ridge)
    return rated.select(F.col("id").alias(id_col), "tokens", "posteriors", "rate", "copies")


def mixture_residual(mixed_rows: DataFrame, targets: np.ndarray) -> np.ndarray:
    """By how much each domain's expected part of the tokens, at the rates of :func:`mix`, is off its target."""
    total = mixed_rows.agg(F.sum("tokens").alias("n")).first().n or 0
    if not total:
        return -targets
    return domain_sums(mixed_rows, F.col("tokens") / F.lit(float(total)) * F.col("rate"), len(targets)) - targets


def mixed(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", weights: dict[str, float] | None = None, rows_per_domain: int = 500, ridge: float = 1e-4) -> DataFrame:
    """The rows of ``documents``, with all their columns, as often as :func:`mix` gives each; no shuffle.

    Null ids, null texts and repeated rows are treated as there; columns of any name are kept. An empty
    table gives an empty result.
    """
    rated = _rated(documents, labels, keep=documents.columns, id_col=id_col, text_col=text_col, domain_col=domain_col, weights=weights, rows_per_domain=rows_per_domain, ridge=ridge)
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)]
    return rated.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*own)
