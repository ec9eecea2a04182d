"""Line dedup and vector codes against brute force, with the defined cases."""

import glob
import os
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from outcomelake.llm import line_dedup, queries, skew, vector_codes

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", ["op12_line_dedup", "op13_vector_codes"])
def test_query_equals_its_sql(spark, duck, name):
    got = queries.queries()[name](spark, DIR)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def brute_lines(rows, least_documents, least_chars):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)] |= {i} - {None}
    common = {k: max(ids) for k, ids in holders.items() if len(k) >= least_chars and len(ids) >= least_documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if common.get(key(line), i) == i and (i is not None or key(line) not in common)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(str, out))


@pytest.mark.parametrize(("keys", "lines"), [(100_000, 500_000), (3, 500_000), (100_000, 0), (3, 0)])
def test_lines_match_brute_force(spark, monkeypatch, keys, lines):
    """With and without the sides that are sent to all tasks."""
    monkeypatch.setattr(skew, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", lines)
    rng = np.random.default_rng(4)
    pool = [f"{'Ä' if i % 2 else 'A'} Line Number {i} {'x' * 40}" for i in range(12)] + ["short line", "", "İ" + "I" * 45, "K" + "k" * 45]
    rows = []
    for i in range(120):
        own = [str(rng.choice([" ", "\t", ""])) + str(rng.choice([s, s.swapcase()])) + str(rng.choice(["\r", "", "\x0b "])) for s in rng.choice(pool, rng.integers(0, 9), p=[0.4, *[0.6 / 15] * 15])]
        rows.append((i, "\n".join([*own, f"a line of its own, which no other text holds: {i}"] if i % 3 else own)))
    rows += [(3, pool[0]), (None, pool[0] + "\n" + pool[1] + "\nend"), (None, pool[0]), (200, None), (7, rows[7][1]), (201, "\n".join([pool[0]] * 3))]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, hash string, n_lines int")
    got = line_dedup.without_common_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_lines(rows, 5, 40)
    assert got.where("n_dropped > 0").count() > 40


def test_line_cases(spark):
    line = "é" * 40
    docs = spark.createDataFrame([(i, line) for i in range(4)] + [(3, line), (None, line), (9, ""), (10, None), (11, "\n"), (12, line[:39])], "doc_id long, text string")
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.without_common_lines(docs).collect()}
    assert got == {*((i, line, 1, 0) for i in [0, 1, 2, 3, None]), (9, "", 1, 0), (10, "", 1, 0), (11, "\n", 2, 0), (12, line[:39], 1, 0)}  # four documents only
    long = spark.createDataFrame([(i, (line + "\n") * 20_000) for i in range(5)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.without_common_lines(long).collect()) == [(i, 20_001, 20_000 * (i < 4)) for i in range(5)]
    assert line_dedup.without_common_lines(docs.limit(0)).count() == 0


def brute_codes(rows, parts, entries, rounds):
    """(codes and errors by row, codebooks) in Python's integers."""
    rows = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, _, v in rows) // parts)) * parts
    floor = lambda x: (lambda a, b: (a << 8) // b)(*float(x).as_integer_ratio())
    numbers = [[floor(x) for x in v] + [0] * (width - len(v)) for _, _, v in rows]
    order = lambda i: (i is None, i or 0)
    first = {}
    for at, (i, _, v) in sorted(enumerate(rows), key=lambda r: (order(r[1][0]), r[1][2])):
        first.setdefault(i, numbers[at])
    step = width // parts
    books = [[v[p * step : (p + 1) * step] for v in list(first.values())[:entries]] for p in range(parts)]

    def nearest(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, e, strict=True)), z) for z, e in enumerate(book))

    for r in range(rounds + 1):
        found = [[nearest(v[p * step : (p + 1) * step], books[p]) for p in range(parts)] for v in numbers]
        if r < rounds:
            for p in range(parts):
                for z in range(len(books[p])):
                    own = [v[p * step : (p + 1) * step] for v, f in zip(numbers, found, strict=True) if f[p][1] == z]
                    if own:
                        books[p][z] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    most = (1 << 63) - 1
    errors = [min(most, sum(d for d, _ in f)) for f in found]
    by_label = defaultdict(int)
    for (_, label, _), e in zip(rows, errors, strict=True):
        by_label[label] += e
    return sorted(str((i, "".join(f"{z:02x}" for _, z in f), e, min(most, by_label[label]))) for (i, label, _), f, e in zip(rows, found, errors, strict=True)), books


def coded(spark, rows, **options):
    table = spark.createDataFrame([(i, v, label, 0, "x") for i, label, v in rows], "vec_id long, embedding array<double>, label int, code int, error string")
    got, books = vector_codes.vector_codes(table, **options)
    return sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got.collect()), books


@pytest.mark.parametrize(("rows_a_tree", "cells"), [(4096, 1 << 21), (40, 1)])
def test_codes_match_brute_force(spark, monkeypatch, rows_a_tree, cells):
    monkeypatch.setattr(vector_codes, "TREE_ROWS", rows_a_tree)
    monkeypatch.setattr(vector_codes, "LEAF_CELLS", cells)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(9, 12))
    rows = [(int(i) - 50, None if i % 7 == 0 else int(i % 3), [round(float(x), int(i % 3)) for x in centres[i % 9] + rng.normal(size=12) * 0.2]) for i in rng.permutation(400)]
    want, books = brute_codes(rows, 4, 16, 2)
    assert coded(spark, rows, parts=4, entries=16, rounds=2) == (want, books)


def test_code_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [1.0, -2.0, 0.5, 3.0]), (1, 0, [1.0, -2.0, 0.4, 3.0]), (None, None, [0.0, 0.0, 1e-320, -1e-320]), (3, None, None), (4, 1, [nan, 1.0, 1.0, 1.0]), (5, 1, [inf, 1.0, 1.0, 1.0]), (6, 1, [None, 1.0, 1.0, 1.0])]
    rows += [(7, 1, []), (8, 2, [1.0, 2.0]), (9, 2, [5.0, 5.0, 5.0, 5.0, 5.0]), (10, 3, [1e300, -1e308, 7e4, 65536.0]), (10, 3, [1e300, -1e308, 7e4, 65536.0]), (11, 3, [70000.5, -3.0, 2.0, 1.0])]
    for entries in (64, 3, 1):
        want, books = brute_codes(rows, 4, entries, 2)
        assert coded(spark, rows, parts=4, entries=entries, rounds=2) == (want, books)
    assert coded(spark, rows[3:7], parts=4) == ([], [])
    empty, books = vector_codes.vector_codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert empty.count() == 0 and books == []


def test_trees_equal_a_scan():
    rng = np.random.default_rng(8)
    for n, k, width in [(1, 1, 1), (5, 3, 2), (16, 4, 3), (17, 8, 4), (3000, 64, 4), (500, 64, 1)]:
        points, entries = rng.integers(-30, 30, (n, width)), rng.integers(-30, 30, (k, width))
        entries[k // 2] = entries[0]  # a double: ties go to the lower
        codes, counts, sums = vector_codes.Tree(points).assign(entries)
        want = ((points[:, None] - entries) ** 2).sum(2).argmin(1)
        assert (codes == want).all() and (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[z] == points[want == z].sum(0)).all() for z in range(k))
