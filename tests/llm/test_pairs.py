"""Near-duplicate documents and vectors against brute force, with the defined cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcomelake.llm import cross_polytope, minhash
from outcomelake.operators.components import connected_components


def components(ids, linked):
    """Smallest id reachable of each id, by following links."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_documents(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    return sets, [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def varied_texts(rng, groups=12, members=14, words=60):
    vocabulary = [f"w{i}" for i in range(400)]
    texts, i = {}, 0
    for _ in range(groups):
        base = list(rng.choice(vocabulary, words))
        for _ in range(members):
            own = list(base)
            for at in rng.choice(words, rng.integers(0, 7), replace=False):
                own[at] = rng.choice(vocabulary)
            texts[i] = " ".join(own)
            i += 1
    return texts


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_documents_match_brute_force(spark, k, percent):
    texts = varied_texts(np.random.default_rng(percent))
    sets, linked = near_documents(texts, k, percent)
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=k, percent=percent).toPandas().set_index("doc_id")
    want = components(texts, linked)
    assert linked and got.component_id.to_dict() == want
    assert got.n_shingles.to_dict() == {i: len(s) for i, s in sets.items()}
    assert got.kept.to_dict() == {i: i == c for i, c in want.items()}


def test_blocks_of_a_large_band(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 5)
    texts = varied_texts(np.random.default_rng(3), groups=3, members=30)
    want = components(texts, near_documents(texts, 3, 85)[1])
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=3, percent=85).toPandas().set_index("doc_id")
    assert got.component_id.to_dict() == want


def test_documents_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = dict(docs.toPandas().itertuples(index=False, name=None))
    want = components(texts, near_documents(texts, 3, 85)[1])
    got = minhash.near_duplicates(docs, words=3, percent=85).toPandas().set_index("doc_id")
    assert got.component_id.to_dict() == want


def test_document_cases(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, "a b"), (2, "A\tb"), (3, ""), (4, None), (5, " \n"), (None, "a b"), (7, long), (8, long + " end"), (9, "a b"), (9, "a b")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, component_id string, n_shingles int")
    got = [tuple(r) for r in minhash.near_duplicates(docs, words=3, percent=85).collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(got, key=key) == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (None, 1, None, True), (7, 29_998, 7, True), (8, 29_999, 7, False), (9, 1, 1, False), (9, 1, 1, False)], key=key)
    kept = minhash.one_of_each(docs, words=3, percent=85)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "7", "None"])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.one_of_each(docs.limit(0)).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "e f g h")], "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.one_of_each(docs).collect()) == [1, 2]


def test_of_repeated_ids_the_least_text_stays(spark):
    rows = [(1, "z y x w v u", "a"), (1, "b c d e f g", "x"), (1, "b c d e f g", "y"), (2, None, "n"), (2, "q", "n"), (3, "", "e"), (3, None, "e")]
    stayed = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame([(i, t, m, [m]) for i, t, m in order], "doc_id long, text string, id string, more array<string>").repartition(3)
        left = sorted(minhash.one_of_each(docs, words=3).collect(), key=lambda r: r.doc_id)
        assert [r.doc_id for r in left] == [1, 2, 3] and left[0].text == "b c d e f g" and left[1].text is None and docs.columns == list(left[0].asDict())
        stayed.add(str(left))
    assert len(stayed) == 1


def test_shared_hashes_are_counted_exactly():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 5000, 9000, 7000)]
    common = minhash.common_counts(sets)
    assert common.dtype.kind == "i" and all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(5) for j in range(5) if i != j)


def test_ids_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    texts = varied_texts(np.random.default_rng(1), groups=4, members=6)
    want = components(texts, near_documents(texts, 3, 85)[1])
    docs = spark.createDataFrame([*texts.items(), *list(texts.items())[:5]], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=3, percent=85).collect()} == want
    assert sorted(r.doc_id for r in minhash.one_of_each(docs, words=3, percent=85).collect()) == sorted(set(want.values()))


def test_banding_misses_little():
    for threshold in (0.8, 0.85, 0.9):
        bands, rows = minhash.banding(threshold, 256)
        assert bands * rows <= 256 and (1 - threshold**rows) ** bands <= 1e-4


def cosines(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("block", [4096, 20])
def test_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cross_polytope, "BLOCK_ROWS", block)
    monkeypatch.setattr(cross_polytope, "TILE", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64))
    vectors = np.vstack([c + rng.normal(size=(n, 64)) * 0.12 for c, n in zip(centres, [60] + [8] * 19, strict=True)] + [rng.normal(size=(200, 64))]).astype(np.float32)
    near = cosines(vectors.astype(float))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = cross_polytope.near_vectors(table).toPandas().set_index("vec_id").sort_index()
    want = components(range(len(vectors)), np.argwhere(near))
    assert near.sum() > 3000 and got.n_links.tolist() == near.sum(1).tolist()
    assert got.component_id.to_dict() == want and (got.kept == (got.component_id == got.index)).all()


@pytest.mark.parametrize(("width", "least"), [(1, 1), (2, 1), (3, 1), (5, 1), (8, 1), (9, 0.99), (16, 0.999), (64, 0.999), (300, 0.99), (768, 0.99), (1536, 0.99)])
def test_recall_at_the_threshold(width, least):
    rng, n = np.random.default_rng(1), 3000 if width <= 300 else 1000
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True) if width > 1 else 2 * x
    (hx, vx), (hy, vy) = (cross_polytope._codes_of(v, 0.9, 20240) for v in (x, y))
    found = ((hx == hy) | (vx == hy[:, :, None]).any(2) | (vy == hx[:, :, None]).any(2)).any(1)
    assert found.mean() >= least


@pytest.mark.parametrize("width", [2, 3, 8, 12, 768])
@pytest.mark.parametrize("idle", [0.0, 2.0])
def test_vectors_of_other_lengths(spark, monkeypatch, width, idle):
    """Few and many components, with idle buckets left out and not; all links of few components are found."""
    monkeypatch.setattr(cross_polytope, "IDLE_SHARE", idle)
    monkeypatch.setattr(cross_polytope, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(width)
    centres = rng.normal(size=(30, width))
    vectors = np.vstack([c + rng.normal(size=(6, width)) * 0.2 for c in centres]).astype(np.float32)
    near = cosines(vectors.astype(float))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = cross_polytope.near_vectors(table).toPandas().set_index("vec_id").sort_index()
    assert near.sum() > 100 and got.n_links.tolist() == near.sum(1).tolist()
    assert got.component_id.to_dict() == components(range(len(vectors)), np.argwhere(near))


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(2).normal(size=(5, 32))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(x)), x)


def test_vector_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]), (8, [None, 1.0, 0.0]), (9, []), (None, [1.0, 0.0, 0.0]), (11, [1.0, 0.0]), (12, [1e300, 0.0, 0.0]), (12, [1e300, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = {}
    for r in cross_polytope.near_vectors(table).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    alone = {i: [(0, i, True)] for i in (4, 5, 6, 7, 8, 9, 11)}
    assert got == alone | {1: [(4, 1, True)], 2: [(4, 1, False)], 3: [(4, 1, False)], None: [(0, None, True)], 12: [(4, 1, False)] * 2}
    assert cross_polytope.near_vectors(table.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hash_tables_are_all_filled(spark):
    assert minhash.near_duplicates(spark.range(40).select(F.col("id").alias("doc_id"), F.lit("same words in all").alias("text"))).where("kept").count() == 1
