"""The pipeline's stages against brute force, one text and one pair at a time, and their defined cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from outcomelake.llm import mixing, packing, subword, weak_supervision
from outcomelake.llm.queries import MIXTURE
from outcomelake.sources.storage import written

DIR = "/root/testdata/sf0.001"


def brute_toxicity(model, text):
    """Probability of the toxic class: every term of the model is looked for among all words."""
    words, z = re.findall(r"[^\W\d_]+", (text or "").lower()), model.bias
    for term, weight in model.weights.items():
        if any(w == term or (term.endswith("*") and w.startswith(term[:-1])) for w in words):
            z += weight
    return 1 / (1 + np.exp(-z))


def spread(h):
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        h = ((h ^ (h >> shift)) * factor) & 0xFFFFFFFF
    return h ^ (h >> 15)


def brute_posteriors(model, text):
    """Class probabilities of one text, its features hashed one by one."""
    factors, points = [int(x) for x in subword._MULTIPLIERS], [32 if ord(c) in (9, 10, 11, 12, 13, 32) else ord(c) for c in (text or "") + "\n"]
    whole, hashes, before = "".join(" " if p == 32 else chr(p) for p in points), [], None
    for word in (w for w in whole.split(" ") if w):
        h = (sum((ord(c) + 1) * pow(factors[0], i, 1 << 32) for i, c in enumerate(word)) + len(word)) & 0xFFFFFFFF
        hashes.append(spread((h + 1) & 0xFFFFFFFF))
        if h == before:
            hashes.append(spread(int(subword._AGAIN)))
        before = h
    for n in model.lengths:
        for i in range(len(points) - n + 1):
            window = points[i : i + n]
            if 32 not in window[1:-1]:
                hashes.append(spread((n + sum(p * f for p, f in zip(window, factors, strict=False))) & 0xFFFFFFFF))
    z = np.array(model.bias)
    if hashes:
        shift = 32 - (len(model.gains) - 1).bit_length()
        z = z + model.gains[[h >> shift for h in hashes]].astype(float).mean(axis=0)
    e = np.exp(z - z.max())
    return e / e.sum()


def brute_kept(texts):
    """Ids left of a group each: 5-word shingles, 100 * common >= 80 * union, of all pairs."""
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in texts if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i for i in texts if find(i) == i}


def brute_rates(posteriors, tokens, target, ridge=1e-4):
    """Rates by projected gradient, every document's as a variable of its own, run to the end."""
    n, rate = tokens / tokens.sum(), np.ones(len(tokens))
    step = 1 / (np.linalg.eigvalsh((posteriors * n[:, None]).T @ posteriors)[-1] + ridge)
    for _ in range(6000):
        residual = (posteriors * (n * rate)[:, None]).sum(0) - target
        rate = np.maximum(0, rate - step * (posteriors @ residual + ridge * (rate - 1)))
    return rate


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_equal_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    stages, outs = dict(corpus_pipeline.STAGES), []
    assert list(stages) == ["toxicity", "quality_classifier", "minhash_near_dedup", "mixing", "best_fit_packing"]
    for name in list(stages)[:4]:
        out = written(stages[name](spark, outs[-1] if outs else docs, DIR), "test-stage")
        assert out.columns == docs.columns
        outs.append(out)

    texts, model = texts_of(docs), weak_supervision.toxicity_model(docs, labels)
    assert set(texts_of(outs[0])) == {i for i, t in texts.items() if brute_toxicity(model, t) < 0.5}
    scores = {r.doc_id: r.score for r in weak_supervision.toxicity_scores(docs, labels).collect()}
    assert all(abs(scores[i] - brute_toxicity(model, t)) < 1e-9 for i, t in texts.items())

    texts, model = texts_of(outs[0]), subword.quality_model(outs[0], labels)
    good = {i: brute_posteriors(model, t)[1] for i, t in texts.items()}
    assert set(texts_of(outs[1])) == {i for i, p in good.items() if p >= 0.5}
    scores = {r.doc_id: r.score for r in subword.quality_scores(outs[0], labels).collect()}
    assert all(abs(scores[i] - p) < 1e-6 for i, p in good.items())

    assert set(texts_of(outs[2])) == brute_kept(texts_of(outs[1]))

    texts = texts_of(outs[2])
    domains, model = mixing.domain_model(outs[2], labels, id_col="doc_id", text_col="text", domain_col="lang", rows_per_domain=500)
    posteriors = np.array([brute_posteriors(model, t) for t in texts.values()])
    tokens = np.array([len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts.values()], dtype=float)
    present = (posteriors * tokens[:, None]).sum(0) / tokens.sum()
    target = mixing.targets_of(domains, MIXTURE, present)
    rates = brute_rates(posteriors, tokens, target)
    mixed = {r.doc_id: r for r in mixing.mix(outs[2], labels, weights=MIXTURE).collect()}
    assert np.abs(np.array([mixed[i].rate for i in texts]) - rates).max() < 0.05
    assert np.abs(mixing.mixture_residual(mixing.mix(outs[2], labels, weights=MIXTURE), target)).max() < 2e-3
    copies = {r.doc_id: r["count"] for r in outs[3].groupBy("doc_id").count().collect()}
    assert all(copies.get(i, 0) == r.copies and int(r.rate) <= r.copies <= int(r.rate) + 1 for i, r in mixed.items())

    packed = stages["best_fit_packing"](spark, outs[3], DIR).toPandas()
    encoder, texts = packing.TextEncoder(packing.default_tokenizer()[0]), texts_of(outs[3])
    sizes = {i: len(encoder.ids(t or "")) // 4 + 1 for i, t in texts.items()}
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: n * copies[i] for i, n in sizes.items()}
    by_sequence = packed.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by_sequence.length.sum() <= 1024).all() and all((g.length.cumsum() - g.length == g.offset).all() for _, g in by_sequence)
    assert packed.sequence_id.nunique() <= 1.03 * -(-packed.length.sum() // 1024)


def test_texts_are_scored_alone():
    """A text's score doesn't depend on its neighbours in a batch."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    model = subword.SubwordModel(rng.normal(size=(1 << 10, 2)).astype(np.float32), np.zeros(2), (3, 4))
    texts = ["a b", "b", "", None, "é ab abc", "abc abc", "\n", "x" * 5000, "abc"]
    whole = model.posteriors(pa.array(texts))
    for text, row in zip(texts, whole, strict=True):
        assert np.allclose(model.posteriors(pa.array([text], pa.string()))[0], row) and np.allclose(brute_posteriors(model, text), row, atol=1e-6)


def test_pipeline_cases(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows and clashing columns go through every stage; so does an empty table."""
    rows = [(1, "", "en", "s", 0), (2, None, "en", "s", None), (None, "some words here", None, None, 1), (4, "same row", "de", "s", 2), (4, "same row", "de", "s", 2), (5, "x y " * 40_000, "en", "s", 3), (6, "\n \t", "fr", "s", 4)]
    docs = spark.createDataFrame([(*r, "clash", "a dot") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, `tokens.x` string")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, str(tmp_path)), "test-case")
        assert out.columns == docs.columns and (name == "mixing" or out.count() <= len(rows)), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path)).groupBy("doc_id").count().where("doc_id = 4").first()["count"] == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("weights", [None, {"en": 1.0}, {"en": 0.5, "de": 0.5}, {"none": 1.0}])
def test_unlisted_domains_keep_their_part(weights):
    present = np.array([0.2, 0.3, 0.5])
    want = mixing.targets_of(["de", "en", "fr"], weights, present)
    expected = {None: [1 / 3] * 3, "en": [0.2, 0.3, 0.5], "en,de": [0.25, 0.25, 0.5], "none": [0.2, 0.3, 0.5]}
    assert np.allclose(want, expected[None if weights is None else ",".join(weights)])


def test_min_and_max_of_a_permutation_band_as_measured():
    """Recall of the real signatures for pairs at the threshold exactly."""
    from outcomelake.llm import minhash

    rng = np.random.default_rng(5)
    for percent in (80, 85):
        common = 2 * percent
        own = 200 - common
        base = rng.integers(0, 1 << 63, size=(1500, common + own), dtype=np.uint64)
        pairs = [(np.sort(row[: common + own // 2]), np.sort(np.concatenate((row[:common], row[common + own // 2 :])))) for row in base]
        bands, rows = minhash.banding(percent / 100, 256)
        x, y = (minhash.band_keys([p[i] for p in pairs], 128, bands, rows) for i in (0, 1))
        assert (x == y).any(axis=1).mean() >= 0.998


def test_archives_of_long_payloads_and_hot_keys(spark):
    from outcomelake.llm import warc
    from outcomelake.sources.storage import new_path

    rows = [(None, None, f"page {i} " * 40) for i in range(200)] + [(1, "http://a/", "long " * 400_000)]
    folder = new_path(spark, "warc-test")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(pages, folder, shard_bytes=20_000)
    assert manifest.select("shard").distinct().count() > 3  # rows without url and id don't share a shard
    assert warc.read_archives(spark, folder).agg(F.sum("payload_bytes")).first()[0] == sum(len(r[2]) for r in rows)
