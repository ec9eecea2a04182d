"""Every registered query of the core against its SQL in DuckDB; those without SQL against a replay or one another."""

import glob
import math
import os
import random
import time

import duckdb
import pyarrow as pa
import pytest

from outcomelake.functions import columns as C
from outcomelake.operators import distill
from outcomelake.plans import queries as plans
from outcomelake.plans.tables import experiences

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    want = duck.execute(SQL[name])
    places = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(places) == names
    rows = sorted(tuple(plain(r[n]) for n in names) for r in got.collect())
    assert rows == sorted(tuple(plain(r[places[n]]) for n in names) for r in want.fetchall())


def replayed(rows):
    """Clusters by a fold over all records in order: (members, key) of each."""
    by_key, clusters = {}, []
    for r in sorted(rows, key=lambda r: (r.recorded_at, r.experience_id)):
        known = [k for k in r["keys"] if k in by_key]
        if known:
            own = by_key[known[0]]
            for other in [by_key[k] for k in known[1:]]:
                if other is not own and other in clusters:
                    own["members"] |= other["members"]
                    clusters.remove(other)
                    for k, c in by_key.items():
                        if c is other:
                            by_key[k] = own
            if all(k.startswith(distill.MESSAGE) for k in known):
                own["key"] = known[0]
        else:
            own = {"members": set(), "key": r["keys"][0]}
            clusters.append(own)
        own["members"].add(r.experience_id)
        by_key.update(dict.fromkeys(r["keys"], own))
    return sorted((sorted(c["members"]), c["key"]) for c in clusters)


def test_clusters_equal_a_replay(spark):
    every = experiences(spark, DIR)
    rows = every.where("actor_kind <> 'uncertain'").select("recorded_at", "experience_id", distill.cluster_keys().alias("keys")).collect()
    found = {}
    for r in distill.clusters(every).collect():
        members, _ = found.setdefault(r.component, (set(), r.cluster_key))
        members.add(r.experience_id)
    assert sorted((sorted(m), k) for m, k in found.values()) == replayed(rows)
    assert all(min(m) == c for c, (m, _) in found.items())


def test_drafted_rules(spark):
    rules = distill.draft_rules(experiences(spark, DIR)).collect()
    assert rules and len({r.id for r in rules}) == len(rules)
    for r in rules:
        assert 0 <= r.confidence <= 1 and r.evidence_count == len(r.experiences) and r.kind in ("avoid", "playbook")
        assert r.status == ("contradicted" if r.contradictions else "candidate") and (r.evidence_count >= 3 or r.confidence <= 0.6)
        assert len(r.scope_paths) <= 3 and all(not p.startswith("tests/") for p in r.scope_paths)
    gone = distill.draft_rules(experiences(spark, DIR), working_tree=spark.createDataFrame([("elsewhere.py",)], "path string"))
    assert {r.status for r in gone.select("status").collect()} == {"stale"}


def test_report_has_the_summary(spark):
    report, summary = QUERIES["report_one_row"](spark, DIR).collect(), QUERIES["err_summary"](spark, DIR).first()
    assert len(report) == 1 and all(report[0][c] == summary[c] for c in summary.asDict())
    assert report[0].gate_status == ("failed" if summary.headline_err > 0.25 else "passed") and report[0].baseline_status == "missing"


def test_digest_and_cost(spark):
    once, again = (QUERIES["source_digest"](spark, DIR).first().source_digest for _ in range(2))
    assert once == again and once.startswith("sha256:")
    cost = QUERIES["provider_cost"](spark, DIR).first()
    assert cost.input_tokens > 0 and cost.status == ("over_cap" if cost.cost > 5 else "within_cap")


def test_no_experiences(spark):
    """Operators take empty tables."""
    none = experiences(spark, DIR).limit(0)
    assert distill.clusters(none).count() == 0
    assert plans.recurrence.in_window(none, 14).count() == 0
    marked = plans.recurrence.with_flakes(none)
    assert plans.recurrence.recurrence_pairs(marked).count() == 0
    assert plans.recurrence.error_recurrence(marked, plans.recurrence.recurrence_pairs(marked)).first().headline_err == 0
    assert C.FAILURE_KINDS == ("ci_failure", "revert", "review_correction")


def test_clusters_of_repeated_records_equal_a_replay(spark):
    """Few keys in any order, many records with the same ones; only the first of them, and the last by messages alone, can change a cluster."""
    draw = random.Random(5)
    pick = lambda name, n: draw.choice(["", *(f"{name}{i}" for i in range(n))])
    rows = [(f"e{i:04}", draw.randrange(300), "agent", pick("s", 9), pick("c", 3), pick("k", 30), pick("x", 3), pick("m", 25), "ci_failure") for i in range(600)]
    kinds = "experience_id string, at int, actor_kind string, signature_id string, check_name string, key string, class string, message string, kind string"
    every = spark.createDataFrame(rows, kinds).selectExpr("*", "timestamp_seconds(at) as recorded_at")
    found = {}
    for r in distill.clusters(every).collect():
        members, _ = found.setdefault(r.component, (set(), r.cluster_key))
        members.add(r.experience_id)
    keyed = every.select("recorded_at", "experience_id", distill.cluster_keys().alias("keys")).collect()
    assert sorted((sorted(m), k) for m, k in found.values()) == replayed(keyed)


def test_a_cluster_is_taken_over_at_once():
    """One record after another joins a cluster to the first; going through all keys each time took the square of them."""
    n = 20_000
    keys = [[f"k{i}"] for i in range(n)] + [["k0", f"k{i}"] for i in range(1, n)]
    batch = pa.record_batch({"component": pa.array(["e"] * len(keys)), "keys": pa.array(keys), "signal": pa.array(["s"] * len(keys))})
    began = time.process_time()
    (found,) = distill._names(iter([batch]))
    assert found.to_pylist() == [{"component": "e", "cluster_key": "k0", "signal": "s"}] and time.process_time() - began < 8
