"""Periodic runs against brute force: small alphabets, planted periods, and the defined cases."""

import hashlib
import zlib

import numpy as np
import pytest

from outcomelake.llm import periodic_runs as R


def brute_runs(words, least):
    """Every stretch whose words repeat after q, for each q, that has no smaller period."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            own = words[start : start + length]
            if length >= max(least, 2 * q) and not any(all(own[j] == own[j + d] for j in range(length - d)) for d in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 12)
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{l},{q}\n" for s, l, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def plain(found):
    return list(zip(*(c.tolist() for c in found), strict=True))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_all_runs_of_random_sequences(letters):
    rng = np.random.default_rng(letters)
    for n in [2, 3, 7, 20, 33, 60, 61, 90]:
        for _ in range(12):
            words = rng.integers(0, letters, n)
            assert plain(R.runs_of(np.append(words, -1))) == brute_runs(words.tolist(), 2)


def test_runs_of_special_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    thue = "".join(str(bin(i).count("1") % 2) for i in range(150))
    nested = ("abcab" * 3 + "d") * 4 + "abcab" * 2
    for text in (fib[-1], thue, nested, "a" * 60, "ab" * 40 + "c" + "ba" * 30, "abcabcabxabcabcab", "aabaabaabaab" * 5):
        words = np.array([ord(c) for c in text])
        assert plain(R.runs_of(np.append(words, -1))) == brute_runs(list(text), 2)


def test_several_texts_in_one_sequence(monkeypatch):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(60):
        words = rng.integers(0, 40, rng.integers(0, 120))
        for _ in range(int(rng.integers(0, 4))):
            at, p, times = int(rng.integers(0, len(words) + 1)), int(rng.integers(1, 15)), int(rng.integers(2, 6))
            words = np.concatenate((words[:at], np.tile(rng.integers(0, 40, p), times), words[at:]))
        texts.append(words.astype(np.int64))
    want = [brute_runs(t.tolist(), 12) for t in texts]
    assert sum(map(len, want)) > 30
    for size in (1 << 17, 300, 1):
        monkeypatch.setattr(R, "CHUNK_WORDS", size)
        assert [plain(r) for r in R.runs_of_texts(texts, 12)] == want


@pytest.mark.parametrize("size", [1 << 18, 50])
def test_queries_in_slices(monkeypatch, size):
    monkeypatch.setattr(R, "QUERIES", size)
    words = np.random.default_rng(3).integers(0, 2, 70)
    assert plain(R.runs_of(np.append(words, -1))) == brute_runs(words.tolist(), 2)


def test_blocks_and_shared_beginnings():
    tree = R.SuffixTree(np.array([ord(c) for c in "abababbab$"]))
    assert R.blocks(tree).tolist() == [0, 1, 2, 6, 9]
    a, b = np.array([0, 1, 0]), np.array([2, 3, 4])
    assert tree.forward(a, b).tolist() == [4, 3, 2] and tree.backward(np.array([3, -1]), np.array([5, 2])).tolist() == [4, 0]


def test_query_equals_brute_force(spark):
    from outcomelake.llm.queries import op11_periodic_runs

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    rows = [r for r in docs.collect() if len((r.text or "").split()) <= 400]
    assert len(rows) > 100 and sum(got[r.doc_id][1] > 0 for r in rows) > 10
    for r in rows:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text)


def test_cases(spark):
    line = "one two three four five six seven "
    rows = [(1, ""), (2, None), (None, line * 3), (4, line * 2), (4, line * 2), (5, "x " * 50_000), (6, "\n\t "), (7, "é e " * 12), (8, "a b c d e f"), (None, "")]
    docs = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, collapsed string, runs int")
    got = R.periodic_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"] and got.count() == len(rows)
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert found[1] == found[2] == found[6] == [(0, [], "")] and found[5] == [(50_000, [(0, 50_000, 1)], "x")]
    assert sorted(found[None]) == [(0, [], ""), (21, [(0, 21, 7)], line.strip())] and found[4] == [(14, [(0, 14, 7)], line.strip())] * 2
    assert found[7] == [(12, [(0, 12, 1)], "é e")] and found[8] == [(6, [], "a b c d e f")]
    assert R.periodic_runs(docs.limit(0)).count() == 0
