"""Steps whose rows must grow with the tables, not with their product, and work that must not stand in one task."""

import pytest
from pyspark.sql import functions as F

from outcomelake.functions import changes, columns
from outcomelake.operators import coverage, normalize
from outcomelake.plans import queries as plans
from outcomelake.plans import tables

RULE = "id string, kind string, scope_paths array<string>, confidence double, evidence_count long, experiences array<string>, provenance array<struct<pr: long, outcome: string, url: string, experience_id: string>>"
N = 200


@pytest.fixture(scope="module")
def many(spark):
    """Many rules of one directory, one of them also of a file, and a playbook elsewhere; two rules of different scopes share an address."""
    cited = lambda i: [(i, "ci_failure", f"u{i}", f"e{i}")]
    rows = [(f"r{i:03}", "avoid", ["src/a"], i / N, 1, [], cited(i)) for i in range(N)]
    rows += [("both", "avoid", ["src/a", "src/a/0.py"], 0.1, 2, [], cited(N)), ("file", "avoid", ["src/a/1.py"], 0.2, 3, [], cited(0)), ("good", "playbook", ["doc/*.md"], 0.9, 4, [], [(1, "fix_held", "u", "e")])]
    return spark.createDataFrame(rows, RULE)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i % 2, f"src/a/{i}.py") for i in range(N)] + [(2, "doc/x.md"), (2, "doc/x.md"), (3, "none"), (3, None)], "change_id long, path string")


def test_paths_meet_types_of_rules(spark, many, asked):
    types, members = coverage.rule_types(many)
    assert types.count() == 4 and members.count() == N + 3
    assert coverage.type_matches(asked, types).count() == 2 * N + 1 + 1
    assert coverage.path_matches(asked, many).distinct().count() == coverage.path_matches(asked, many).count() == N * (N + 1) + 1 + 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_a_type_meet(spark, many, asked, monkeypatch):
    """Rows for single rules come from lists that met; no join makes them. Short lists give the same rows."""
    monkeypatch.setattr(coverage, "LIST_ROWS", 7)
    texts = asked.where("path is not null").selectExpr("path as context_id", "concat('see ', path) as context")
    own = sorted((f"src/a/{i}.py", f"r{n:03}") for i in range(N) for n in range(N)) + [(f"src/a/{i}.py", "both") for i in range(N)] + [("src/a/1.py", "file"), ("doc/x.md", "good")]
    for found in (coverage.path_matches(asked, many), coverage.recall_in_texts(texts, many)):
        plan = _plan(found)
        assert plan.index("Generate explode(right") < plan.index("Join")
        assert sorted(tuple(r) for r in found.collect()) == sorted(own)
    cited = coverage.path_citations(asked, many)
    assert _plan(cited).index("Generate explode(right") < _plan(cited).index("Join")
    # What two types share is one address.
    assert sorted(tuple(r) for r in cited.collect()) == sorted({(p, {"both": f"u{N}", "file": "u0", "good": "u"}.get(r, f"u{r[1:].lstrip('0') or 0}")) for p, r in own})


def _sent(spark):
    """Bytes that all stages up to now have written for others."""
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_pairs_of_a_type_are_not_sent(spark):
    """What is sent grows with the rows of both sides, not with the pairs that they make."""
    sides = {"path": 6000, "rule_id": 900}
    left, right = (spark.range(rows).select(F.lit(7).cast("long").alias("type"), F.sha2(F.concat(F.lit(n), F.col("id").cast("string")), 256).alias(n)) for n, rows in sides.items())
    before = _sent(spark)
    found = coverage.of_types(left, right)
    assert found.agg(F.count("*"), F.min(F.length("path") + F.length("rule_id"))).first() == (5_400_000, 128)
    assert _sent(spark) - before < 2_000_000
    assert found.agg(F.count_distinct("path"), F.count_distinct("rule_id")).first() == (6000, 900)
    plan = _plan(found)
    assert "Repartition" not in plan[: plan.index("Join")]


def test_paths_share_their_lists(spark, many, asked, monkeypatch):
    """The rules of a directory are put in order once for its paths, and by compiled code."""
    monkeypatch.setattr(coverage, "SET_PATHS", 3)
    found = coverage.path_coverage(asked, many)
    assert "array_sort" not in _plan(found) and "lambdafunction" not in _plan(found).split("Join")[0]
    got = {r.path: r for r in found.collect()}
    assert len(got) == N + 3
    ordered = [f"r{i:03}" for i in range(N - 1, -1, -1)]
    ordered.insert(ordered.index(f"r{N // 10:03}"), "both")
    for i in range(N):
        names = list(ordered)
        if i == 1:
            names.insert(names.index(f"r{N // 5:03}"), "file")
        row = got[f"src/a/{i}.py"]
        assert row.matched_rule_ids == names and row.matched_rule_count == len(names) and row.coverage == "covered_risky"
        assert row.citations == list(dict.fromkeys({"both": f"u{N}", "file": "u0"}.get(r, f"u{r[1:].lstrip('0') or 0}") for r in names))
    assert (got["doc/x.md"].matched_rule_ids, got["doc/x.md"].citations, got["doc/x.md"].coverage) == (["good"], ["u"], "covered_clean")
    assert (got["none"].matched_rule_ids, got["none"].experience_ids, got["none"].coverage, got[None].matched_rule_ids) == ([], [], "no_coverage", [])


def test_equal_lists_are_made_once_and_stand_together(spark, monkeypatch):
    """Texts of lists are joined for a directory, not for each path, and paths with rules of their own stand apart from those that share one."""
    monkeypatch.setattr(coverage, "SET_PATHS", 15)
    row = lambda i, name, scope: (name, "avoid", [scope], i / 100, 1, [f"e{i % 7}"], [])
    rules = spark.createDataFrame([row(i, f"d{i:02}", "src/a") for i in range(20)] + [row(3 * i, f"f{i:02}", f"src/a/{4 * i}.py") for i in range(10)], RULE)
    paths = spark.createDataFrame([(f"src/a/{i}.py",) for i in range(40)] + [("none",)], "path string")
    monkeypatch.setattr(plans, "touched", lambda *_: paths)
    monkeypatch.setattr(plans, "rules", lambda *_: rules)
    found = plans.coverage_paths(spark, "")
    assert "array_join" not in _plan(found).split("Join")[0]
    got = found.withColumn("task", F.spark_partition_id()).collect()
    for task in {r.task for r in got}:
        texts = [r.matched_rule_ids for r in got if r.task == task]
        assert len(set(texts)) == 1 + sum(a != b for a, b in zip(texts, texts[1:]))
    for r in got:
        n = -1 if r.path == "none" else int(r.path[6:-3])
        own = [(-i / 100, f"d{i:02}", f"e{i % 7}") for i in range(20) if n >= 0] + [(-3 * i / 100, f"f{i:02}", f"e{3 * i % 7}") for i in range(10) if n == 4 * i]
        assert (r.matched_rule_ids, r.experience_ids) == (",".join(x[1] for x in sorted(own)), ",".join(dict.fromkeys(x[2] for x in sorted(own))))
        assert (r.matched_rule_count, r.evidence_count, r.coverage) == (len(own), len(own), "covered_risky" if own else "no_coverage")
    assert len(got) == 41


def test_changes_and_levels_count_rules_once(spark, many, asked):
    got = {r.change_id: r for r in coverage.assess_changes(asked, many).collect()}
    assert [(got[i].touched_path_count, got[i].covered_risky_count, got[i].covered_clean_count, got[i].no_coverage_count) for i in range(4)] == [(N // 2, N // 2, 0, 0), (N // 2, N // 2, 0, 0), (1, 0, 1, 0), (2, 0, 0, 2)]
    assert [(got[i].matched_rule_count, got[i].evidence_count) for i in range(4)] == [(N + 1, N + 2), (N + 2, N + 5), (1, 4), (0, 0)]
    assert [got[i].max_avoid_confidence for i in range(4)] == [(N - 1) / N, (N - 1) / N, None, None]
    levels = {r.path: r for r in coverage.levels_of(asked, many).collect()}
    assert (levels["src/a/1.py"].matched_rule_count, levels["src/a/2.py"].matched_rule_count, levels["doc/x.md"].coverage, levels["none"].coverage) == (N + 2, N + 1, "covered_clean", "no_coverage")


def test_addresses_that_types_share_count_once(spark, many):
    texts = spark.createDataFrame([(i, f"see src/a/{i}.py") for i in range(3)] + [(9, "nothing")], "context_id long, context string")
    got = {r.context_id: r for r in coverage.recall_answers(texts, many).collect()}
    assert {i: (r.rules, r.citations) for i, r in got.items()} == {0: (N + 1, N + 1), 1: (N + 2, N + 1), 2: (N + 1, N + 1)}
    paths = spark.createDataFrame([(f"src/a/{i}.py",) for i in range(3)], "path string")
    cited = coverage.path_citations(paths, many)
    assert cited.count() == cited.distinct().count() == 3 * (N + 1)


def test_parts_are_spread(spark):
    """Rules, diffs and plans are made of a table whose file is read by one task."""
    cores = spark.sparkContext.defaultParallelism
    assert tables.table(spark, "/root/testdata/sf0.1", "part").rdd.getNumPartitions() == 1 < cores
    assert tables.rules(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == tables.parts(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == cores


def test_contract_computes_a_number_once(spark):
    """What errors are made of is read as values; spelled out in each of them, it is computed hundreds of times for a row."""
    kept = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = plans.queries()["rule_contract"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", kept)
    assert plan.count(r", (\d+), 1)") == 1


def test_fields_not_given_are_not_computed(spark):
    """Normalising trims each field that events have once, and reads none that they lack."""
    kept = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        checked = normalize.normalized(plans.raw_events(spark, "/root/testdata/sf0.001"), plans.POLICY, ref=F.col("row_id"))
        plan = checked._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", kept)
    assert "signature_class" in plan and plan.count("trim(") < 250
    assert "coauthor_trailers" not in plan and "check_run_url" not in plan


def test_header_lines_are_read_as_rows(spark):
    """A row for each header line and not a list for each diff, so that what is read from a line is compiled."""
    names = changes.head_paths(spark.createDataFrame([(1, '+++ "b/sp ace/x.py"'), (2, "--- /dev/null"), (3, 'diff --git "a/q\\303\\251.py" b/q')], "change_id long, line string"))
    assert sorted(map(tuple, names.collect())) == [(1, "sp ace/x.py"), (3, "qé.py")]


def test_a_clean_path_is_not_taken_apart(spark):
    """Only a path with an empty part, ``.`` or ``..`` is folded part by part."""
    text = columns.clean_path(F.col("p"))._jc.toString().lower()
    assert "rlike" in text and text.index("rlike") < text.index("aggregate(")
