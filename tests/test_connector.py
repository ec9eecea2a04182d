"""The pull request source on recorded answers, snapshot tables under failures and races, and the stream of advice."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from outcomelake import schemas
from outcomelake.operators import advice, coverage, lifecycle
from outcomelake.operators.normalize import accepted, normalized
from outcomelake.sources import lineage, pulls, scans, sinks, snapshots
from outcomelake.streaming import advice as advice_streaming
from outcomelake.streaming import ingest

ROOT = "https://api.github.com/repos/acme/shop"
WEB = "https://github.com/acme/shop"


def record(folder, url, value=None, link=None, **answer):
    headers = {"Link": f'<{link}>; rel="next", <{ROOT}>; rel="last"'} if link else {}
    body = json.dumps(value) if value is not None else answer.get("body", "")
    (folder / pulls.replay_name(url)).write_text(json.dumps({"status": answer.get("status", 200), "headers": headers | answer.get("headers", {}), "body": body}))


def recorded(folder, number, merged=True, pages=2):
    """One pull request with files on several pages, failed and other checks, marked comments and later reverts."""
    pull = f"{ROOT}/pulls/{number}"
    at = "2026-01-02T00:00:00Z"
    record(folder, pull, {"number": number, "head": {"sha": f"head{number}"}, "html_url": f"{WEB}/pull/{number}", "merged_at": at if merged else None, "merge_commit_sha": f"merge{number}", "base": {"ref": "ma in"}, "user": {"login": "bot", "email": "x@y"}, "labels": [{"name": "ai", "color": "f"}], "body": "long text"})
    for page in range(1, pages + 1):
        first = f"{pull}/files?per_page=100"
        record(folder, first if page == 1 else f"{first}&page={page}", [{"filename": f"src/p{page}.py", "patch": "secret patch"}], f"{first}&page={page + 1}" if page < pages else None)
    record(folder, f"{pull}/commits?per_page=100", [{"sha": f"c{number}", "commit": {"message": "x\n\nCo-authored-by: A Bot <a@b>\r\nco-authored-by: A Bot <c@d>"}}, {"sha": f"head{number}", "commit": {"message": "y"}}])
    record(folder, f"{ROOT}/commits/c{number}/check-runs?filter=all&per_page=100", {"check_runs": [{"name": "unit", "conclusion": "failure" if number % 2 else "success", "completed_at": at, "html_url": f"{WEB}/pull/{number}/checks/1", "output": {"summary": "boom", "text": "log"}}]})
    record(folder, f"{ROOT}/commits/head{number}/check-runs?filter=all&per_page=100", {"check_runs": []})
    record(folder, f"{pull}/comments?per_page=100", [{"body": "fine"}, {"body": "Outcomelake:Correction use b", "path": "src/p1.py", "html_url": f"{WEB}/pull/{number}/files/1", "created_at": at}] if number == 3 else [])
    record(folder, f"{ROOT}/issues/{number}/comments?per_page=100", [])
    later = f"{ROOT}/commits?per_page=100&sha=ma%20in&since=2026-01-02T00%3A00%3A00Z"
    record(folder, later, [{"sha": "r1", "html_url": f"{WEB}/commit/r1", "commit": {"message": "Revert #4 now, not #41", "committer": {"date": at}}}, {"sha": "r2", "commit": {"message": "reverting #31 or PR #5x"}}])


@pytest.fixture
def options(tmp_path):
    # Readers are made in Python workers, whose environment is as old as the JVM: any variable that is set there will do.
    folder = tmp_path / "answers"
    folder.mkdir()
    for number in (1, 2, 3, 4):
        recorded(folder, number)
    return {"repo": "acme/shop", "pulls": "1, 2,3,4,2", "approved": True, "allow_network": True, "allow_credentials": True, "token_env": "PATH", "token_scope": "read-only", "replay": str(folder)}, folder


def test_pulls_become_the_events_of_an_export(spark, options, tmp_path):
    given, _ = options
    found = pulls.read_pulls(spark, **given)
    assert found.rdd.getNumPartitions() == 4
    rows = found.orderBy("number").collect()
    assert [(r.number, r.requests, r.pages) for r in rows] == [(n, 9, 9) for n in (1, 2, 3, 4)]
    assert all(x not in r.export for r in rows for x in ("secret patch", "x@y", "long text", "fine", "a@b", "log\""))
    assert json.loads(rows[0].export)["pull_requests"][0]["files"] == ["src/p1.py", "src/p2.py"]
    events = pulls.pull_events(found)
    key = lambda r: (r.pr, r.outcome_kind)
    assert sorted((r.pr, r.outcome_kind) for r in events.collect()) == [("1", "ci_failure"), ("2", "merged_clean"), ("3", "ci_failure"), ("3", "review_correction"), ("4", "revert")]
    # The same answers as one export, read as a document.
    export = {"repo": {"owner": "acme", "name": "shop"}, "pull_requests": [json.loads(r.export)["pull_requests"][0] for r in rows]}
    (tmp_path / "export.json").write_text(json.dumps(export))
    same = scans.export_events(scans.read_export(spark, str(tmp_path / "export.json")))
    assert sorted(events.collect(), key=key) == sorted(same.collect(), key=key)
    assert all(not r.errors for r in normalized(events.withColumn("actor_kind", F.lit("agent"))).collect())


def test_filters_leave_out_partitions(spark, options, tmp_path):
    given, folder = options
    (folder / pulls.replay_name(f"{ROOT}/pulls/1")).unlink()  # would fail if it were asked for
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r.number for r in pulls.read_pulls(spark, **given).where("number in (2, 3)").select("number").orderBy("number").collect()] == [2, 3]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def refused(spark, given, **change):
    with pytest.raises(Exception) as caught:
        pulls.read_pulls(spark, **(given | change)).collect()
    return str(caught.value)


def test_refusals(spark, options):
    given, folder = options
    one = given | {"pulls": "1"}
    assert "more than 1 pages" in refused(spark, one, max_pages=1)
    for change, told in [({"approved": False}, "approved must be true"), ({"token_scope": "write"}, "read-only"), ({"token_env": "9x"}, "environment variable"), ({"token_env": "UNSET_TOKEN"}, "is empty"), ({"repo": "acme"}, "owner/name"), ({"pulls": "0"}, "positive numbers"), ({"pulls": ""}, "positive numbers")]:
        assert told in refused(spark, one, **change)
    first = f"{ROOT}/pulls/1/files?per_page=100"
    for address in ("https://evil.example/x", "http://api.github.com/x", "https://user@api.github.com/x"):
        record(folder, first, [], address)
        assert "outside api.github.com" in refused(spark, one)
    for answer, told in [({"status": 429}, "rate limit"), ({"status": 403, "headers": {"Retry-After": "7"}}, "retry-after=7"), ({"status": 403, "body": "Secondary rate limit"}, "rate limit"), ({"status": 401}, "token was refused"), ({"status": 500}, "status 500"), ({"body": "{"}, "no JSON"), ({"body": "{}"}, "no list")]:
        record(folder, first, **answer)
        assert told in refused(spark, one)


def test_a_long_search_for_reverts_may_end_early(spark, options):
    given, folder = options
    later = f"{ROOT}/commits?per_page=100&sha=ma%20in&since=2026-01-02T00%3A00%3A00Z"
    record(folder, later, [], f"{later}&page=2")
    for page in range(2, 4):
        record(folder, f"{later}&page={page}", [], f"{later}&page={page + 1}")
    row = pulls.read_pulls(spark, **(given | {"pulls": "2", "max_pages": 3})).first()
    assert json.loads(row.export)["pull_requests"][0]["revert_scan_truncated"] is True
    assert pulls.pull_events(pulls.read_pulls(spark, **(given | {"pulls": "2", "max_pages": 3}))).count() == 0


EVENTS = [{"experience_id": f"exp_{i}", "repo": "acme/shop", "recorded_at": f"2026-0{1 + i % 2}-08T10:00:00Z", "pr": 140 + i, "commit": f"abc{i}", "paths": ["src/a.py"], "actor_kind": "agent", "outcome_kind": "ci_failure", "provenance_urls": [f"{WEB}/pull/{140 + i}"]} for i in range(4)]


def rows_of(spark, tmp_path, events, name="e.jsonl"):
    (tmp_path / name).write_text("".join(json.dumps(e) + "\n" for e in events))
    return accepted(normalized(scans.events_jsonl(spark, str(tmp_path / name)))).withColumn("batch_seq", F.lit(0).cast("long"))


def seen(spark, table, **more):
    return {r.pr: r.flake_discount for r in snapshots.read_snapshot(spark, table, **more).collect()}


def test_a_failure_between_files_leaves_the_old_table(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    assert seen(spark, table) == {}
    assert snapshots.upsert_snapshot(rows_of(spark, tmp_path, EVENTS), table) == 1
    fresh = rows_of(spark, tmp_path, EVENTS).withColumn("flake_discount", F.lit(0.5))
    publish = snapshots.publish
    # All data of both months is written, and the writer dies before the entry, and while it is renamed.
    for broken in (lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()), lambda spark, path, *a: (snapshots._write_text(spark, f"{path}/_log/.draft-x{len(a)}{id(a)}", "{"), (_ for _ in ()).throw(KeyboardInterrupt()))):
        monkeypatch.setattr(snapshots, "publish", broken)
        with pytest.raises(KeyboardInterrupt):
            snapshots.upsert_snapshot(fresh, table)
        assert set(seen(spark, table).values()) == {0.0} and snapshots.versions(spark, table) == [1]
    monkeypatch.setattr(snapshots, "publish", publish)
    assert snapshots.upsert_snapshot(fresh, table) == 2 and set(seen(spark, table).values()) == {0.5}
    assert set(seen(spark, table, version=1).values()) == {0.0} and seen(spark, table, months=["2026-02"]).keys() == {141, 143}
    assert snapshots.restore(spark, table, 1) == 3 and set(seen(spark, table).values()) == {0.0}
    assert snapshots.expire(spark, table, keep=1) == 3 and set(seen(spark, table).values()) == {0.0}
    with pytest.raises(ValueError):
        snapshots.entry(spark, table, 1)


def test_of_two_writers_both_are_kept(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    snapshots.upsert_snapshot(rows_of(spark, tmp_path, EVENTS[:1], "a"), table)
    publish, other = snapshots.publish, rows_of(spark, tmp_path, EVENTS[2:3], "b")
    raced = []

    def late(*args):
        if not raced:  # another writer makes the same entry first
            raced.append(1)
            snapshots.upsert_snapshot(other, table)
        return publish(*args)

    monkeypatch.setattr(snapshots, "publish", late)
    assert snapshots.upsert_snapshot(rows_of(spark, tmp_path, EVENTS[1:2], "c"), table) == 3
    assert seen(spark, table).keys() == {140, 141, 142}


def test_a_batch_is_merged_once(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = rows_of(spark, tmp_path, EVENTS)
    assert snapshots.upsert_snapshot(rows, table, stream="s", batch=0) == 1
    assert snapshots.upsert_snapshot(rows.withColumn("flake_discount", F.lit(0.5)), table, stream="s", batch=0) is None
    assert snapshots.upsert_snapshot(rows.where("pr = 140").withColumn("flake_discount", F.lit(0.25)), table, stream="s", batch=1) == 2
    assert snapshots.upsert_snapshot(rows.limit(0), table, stream="t", batch=5) == 3
    assert seen(spark, table) == {140: 0.25, 141: 0.0, 142: 0.0, 143: 0.0} and snapshots.entry(spark, table)["batches"] == {"s": 1, "t": 5}


def test_streamed_ingest_into_a_snapshot(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table, marks = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for name, events in (("a", EVENTS), ("b", [EVENTS[0] | {"flake_discount": 0.5}, EVENTS[1] | {"pr": 0}])):
        (tmp_path / "in" / f"{name}.json").write_text("".join(json.dumps(e) + "\n" for e in events))
        query = ingest.ingest_stream(ingest.event_stream(spark, str(tmp_path / "in")), table, marks, stream="events")
        assert query.awaitTermination(240) and query.exception() is None
    assert seen(spark, table) == {140: 0.5, 141: 0.0, 142: 0.0, 143: 0.0} and snapshots.entry(spark, table)["batches"] == {"events": 1}


def test_two_files_change_together(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "report")
    snapshots.commit_files(spark, path, {"report.json": "{}", "report.md": "old"})
    write = snapshots._write_text

    def fails(spark, at, text):
        if at.endswith("report.md"):
            raise KeyboardInterrupt
        write(spark, at, text)

    monkeypatch.setattr(snapshots, "_write_text", fails)
    with pytest.raises(KeyboardInterrupt):
        snapshots.commit_files(spark, path, {"report.json": '{"new": 1}', "report.md": "new"})
    assert snapshots.read_files(spark, path) == {"report.json": "{}", "report.md": "old"}
    monkeypatch.setattr(snapshots, "_write_text", write)
    snapshots.commit_files(spark, path, {"report.json": '{"new": 1}', "report.md": "new é"})
    assert snapshots.read_files(spark, path) == {"report.json": '{"new": 1}', "report.md": "new é"} and snapshots.read_files(spark, path, 1)["report.md"] == "old"


START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def assessments(n=60):
    risks = ("covered_clean", "match_high", "match_medium", "no_coverage")
    return [(i % 4, f"a{i:03d}", START + timedelta(minutes=(i * 7) % 240 + i), risks[(i * 5 + i // 9) % 4], "no_coverage" if i % 6 == 0 else "covered", (i % 10) / 10.0 if i % 11 else None, f"f{(i // 5) % 3}") for i in range(n)]


def step_by_step(spark, rows, policy):
    """Each assessment by the batch operator, after the state that the one before it left."""
    out, states = [], {}
    for change, name, at, risk, coverage, confidence, fingerprint in sorted(rows, key=lambda r: (r[2], r[1])):
        asked = spark.createDataFrame([(name, change, risk, coverage, confidence, fingerprint)], "assessment_id string, change_id long, risk_level string, coverage string, max_avoid_confidence double, diff_fingerprint string")
        prior = spark.createDataFrame([states[change]] if change in states else [], "change_id long, diff_fingerprint string, risk_level string, generated_at timestamp")
        got = lifecycle.comment_decision(asked, prior, at.strftime("%Y-%m-%d %H:%M:%S"), debounce_minutes=policy.debounce_minutes, least_confidence=policy.least_confidence).first()
        states[change] = (change, got.state_fingerprint, got.published_risk, got.state_at)
        out.append((name, got.skip_reason, got.comment, got.published_risk, got.state_fingerprint))
    return sorted(out)


def test_advice_replayed_and_streamed(spark, tmp_path):
    """Batches of a stream, before and after a restart, decide like the batch operator taken step by step."""
    policy, rows = advice.Policy(debounce_minutes=60), assessments()
    want = step_by_step(spark, rows, policy)
    assert {w[1] for w in want} == {"", "clean", "unchanged", "low_confidence", "debounced"}
    plain = lambda found: sorted((r.assessment_id, r.skip_reason, r.comment, r.published_risk, r.state_fingerprint) for r in found)
    table = spark.createDataFrame(rows, advice.ASSESSMENT)
    assert plain(advice.replayed(table, policy).collect()) == want
    spark.conf.set(*advice_streaming.STORE)
    (tmp_path / "in").mkdir()
    ordered = sorted(rows, key=lambda r: (r[2], r[1]))
    names = [c.split(" ")[0] for c in advice.ASSESSMENT.split(", ")]
    for part in range(3):  # each run is a restart from the checkpoint
        lines = [json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in zip(names, r, strict=True)}) for r in ordered[part * 20 : part * 20 + 20][::-1]]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(lines))
        found = advice_streaming.advice_stream(advice_streaming.assessment_stream(spark, str(tmp_path / "in")), policy)
        query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "marks")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(300) and query.exception() is None
    assert plain(spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_policies_and_empty_advice(spark):
    table = spark.createDataFrame(assessments(8), advice.ASSESSMENT)
    assert {r.skip_reason for r in advice.replayed(table, advice.Policy(enabled=False)).collect()} == {"disabled"}
    assert {r.skip_reason for r in advice.replayed(table, advice.Policy(most_comments=0)).collect()} == {"comment_cap"}
    assert advice.replayed(table.limit(0)).count() == 0


def test_lines_are_numbered_over_blocks(spark, tmp_path, monkeypatch):
    """Files larger than a block: every line's number is that of Python's enumerate."""
    rng = __import__("random").Random(2)
    files = {}
    for name in ("a.jsonl", "b.jsonl", "empty.jsonl"):
        own = ["" if rng.random() < 0.1 else f"{name} {i} " + "x" * rng.randint(0, 400) + "é" for i in range(0 if name.startswith("e") else 3000)]
        (tmp_path / name).write_text("".join(line + "\n" for line in own))
        files[name] = own
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        for few in (lineage.BROADCAST_BLOCKS, 0):
            monkeypatch.setattr(lineage, "BROADCAST_BLOCKS", few)
            found = lineage.numbered_lines(spark, str(tmp_path / "*.jsonl"))
            assert found.rdd.getNumPartitions() > 8 or not few
            got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in found.collect()}
            assert got == {(name, i): line for name, own in files.items() for i, line in enumerate(own, 1)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_shards_of_stored_and_raw_records(spark, tmp_path):
    stored = {"experience_id": "e1", "object_type": "record", "repo": {"owner": "acme", "name": "shop"}, "recorded_at": "2026-01-08T10:00:00Z", "attribution": {"actor_kind": "agent"}, "context": {"paths": ["a.py"]}, "action": {"pr": 1, "commit": "c1"}, "outcome": {"kind": "revert"}, "provenance": {"urls": [f"{WEB}/pull/1"]}}
    lines = [json.dumps(EVENTS[0]), "", json.dumps(stored), "{broken", "  ", "[1]", json.dumps(EVENTS[1] | {"pr": 0})]
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    events, rejects = lineage.read_shards(spark, str(tmp_path))
    path = str(tmp_path / "s.jsonl")
    assert sorted((r.source_ref, r.line) for r in rejects.collect()) == [(f"{path}:4", "{broken"), (f"{path}:6", "[1]")]
    assert sorted((r.source_line, r.canonical) for r in events.collect()) == [(1, False), (3, True), (7, False)]
    checked = normalized(events, ref=F.col("source_ref"))
    counters = lineage.ingest_observed(checked, str(tmp_path / "out"))
    assert counters == {"records": 3, "accepted": 2, "rejected": 1, "agent": 2, "human": 0, "uncertain": 0}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.source_ref, r.errors) for r in out.where("part = 'rejected'").collect()] == [(f"{path}:7", ["pr", "provenance_pr"])]
    assert {r.experience_id for r in out.where("part = 'accepted'").collect()} == {"exp_0", "e1"}


def test_digests_of_whole_records(spark):
    """Canonical JSON is the same for any order of fields and keys; parts follow an upsert; freshness has no influence."""
    a = spark.createDataFrame([(1, "x\"é", [1.5, None], {"b": "2", "a": None}, START, (2, "z"))], "n long, s string, l array<double>, m map<string, string>, t timestamp, o struct<q: int, p: string>")
    line = a.select(lifecycle.record_line(a).alias("j")).first().j
    assert json.loads(line) == {"l": [1.5, None], "m": {"a": None, "b": "2"}, "n": 1, "o": {"p": "z", "q": 2}, "s": 'x"é', "t": "2026-01-01T00:00:00.000000Z"}
    b = spark.createDataFrame([((2, "z"), START, {"a": None, "b": "2"}, [1.5, None], "x\"é", 1, "elsewhere")], "o struct<q: int, p: string>, t timestamp, m map<string, string>, l array<double>, s string, n long, source_ref string")
    assert b.select(lifecycle.record_line(b).alias("j")).first().j == line
    rows = spark.range(50).selectExpr("id", "cast(id % 4 as string) as shard", "'v' as v")
    other = rows.withColumn("v", F.when(F.col("id") < 13, "w").otherwise(F.col("v"))).where("id <> 49")
    shard = F.col("shard")
    parts = lifecycle.changed_parts(lifecycle.digest_parts(rows, shard), lifecycle.digest_parts(rows.where("id < 13 or id = 49"), shard), lifecycle.digest_parts(other.where("id < 13"), shard))
    whole = lifecycle.source_digest(other, shard).first().source_digest
    assert lifecycle.digest_of(parts).first().source_digest == whole != lifecycle.source_digest(rows, shard).first().source_digest
    assert lifecycle.digest_of(lifecycle.digest_parts(rows.limit(0), shard)).count() == 1


def test_scopes_that_once_were_directories(spark):
    rules = spark.createDataFrame([("gone", ["old/dir"]), ("file", ["src/a"]), ("named", ["lib/"]), ("glob", ["src/*.py"]), ("below", ["x/**"]), ("same", ["src/a/b.py"])], "id string, scope_paths array<string>")
    history = spark.createDataFrame([("old/dir/x.py", START), ("old/dir/y.py", START + timedelta(days=9)), ("src/a", START)], "path string, added_at timestamp")
    paths = ["old/dir/z.py", "src/a/b.py", "src/a", "lib/q", "src/p.py", "x/y/z"]
    asked = spark.createDataFrame([(p,) for p in paths], "path string")
    got = sorted(tuple(r) for r in coverage.path_matches(asked, rules, history).collect())
    assert got == sorted([("old/dir/z.py", "gone"), ("src/a", "file"), ("lib/q", "named"), ("src/p.py", "glob"), ("x/y/z", "below"), ("src/a/b.py", "same")])
    early = asked.withColumn("at", F.lit(START - timedelta(days=1)))
    assert ("old/dir/z.py", "gone") not in {(r.path, r.rule_id) for r in coverage.path_matches(early, rules, history).collect()}
    assert {r.rule_id for r in coverage.path_matches(asked, rules).where("path = 'src/a/b.py'").collect()} == {"file", "same"}


def test_recall_by_anchors_equals_a_scan(spark):
    """Scopes of one word, two and more, cut words at their ends, words of other case, repeated and empty texts."""
    rng = __import__("random").Random(4)
    words = ["alpha", "Beta", "gammaRay", "de", "épsilon", "zeta-9", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))).replace("x ", "x\t" if i % 3 else "x ") for i in range(120)] + [None, "", "ALPHA BETA", "prealpha betapost"]
    scopes = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(30)] + ["lph", "a b", "pha bet", "ha beta gamm", "é", "nothing here", "  "]
    rules = spark.createDataFrame([(f"r{i}", [s, s.upper()]) for i, s in enumerate(scopes)], "id string, scope_paths array<string>")
    contexts = spark.createDataFrame(list(enumerate(texts)), "context_id long, context string")
    want = {(i, f"r{j}") for i, t in enumerate(texts) for j, s in enumerate(scopes) if t and s.strip() and s.strip().lower() in t.lower()}
    for few in (coverage.BROADCAST_GRAMS, 0):
        coverage.BROADCAST_GRAMS, kept = few, coverage.BROADCAST_GRAMS
        found = [tuple(r) for r in coverage.recall_in_texts(contexts, rules).collect()]
        coverage.BROADCAST_GRAMS = kept
        assert len(want) > 100 and set(found) == want and len(found) == len(want)


def test_states_and_baselines_ahead_of_a_report(spark, tmp_path):
    table = spark.createDataFrame([(n, c, r, v, x, f) for c, n, _, r, v, x, f in assessments(4)], "assessment_id string, change_id long, risk_level string, coverage string, max_avoid_confidence double, diff_fingerprint string")
    prior = spark.createDataFrame([(1, "f0", "match_high", START)], "change_id long, diff_fingerprint string, risk_level string, generated_at timestamp")
    decided = lifecycle.comment_decision(table.withColumn("diff_fingerprint", F.lit("f9")).withColumn("risk_level", F.lit("no_coverage")), prior, "2026-01-01 00:05:00")
    sinks.write_states(decided, str(tmp_path / "states"))
    got = {r.change_id: (r.diff_fingerprint, r.risk_level, r.skip_reason, r.generated_at) for r in scans.advisory_states(spark, str(tmp_path / "states")).collect()}
    want = {r.change_id: (r.state_fingerprint, r.published_risk, r.skip_reason, r.state_at) for r in decided.collect()}
    assert got == want and got[1][:3] == ("f0", "no_coverage", "debounced") and got[2][:3] == ("f9", "no_coverage", "")
    again = lifecycle.comment_decision(table.withColumn("diff_fingerprint", F.lit("f9")).withColumn("risk_level", F.lit("no_coverage")), scans.advisory_states(spark, str(tmp_path / "states")), "2026-01-01 00:06:00")
    assert {r.change_id: r.skip_reason for r in again.collect()} == {0: "unchanged", 1: "debounced", 2: "unchanged", 3: "unchanged"}
    for name, value, want in [("a", {"headline_err": "0.2"}, ("stale", 0.2, "no_digest")), ("b", {"summary": {"headline_err": 0.3}, "metadata": {"source_artifact_digest": "d"}}, ("stale", 0.3, "no_window")), ("c", {"headline_err": 0, "metadata": {"source_artifact_digest": "d"}, "window": {"start": "s", "end": "e"}}, ("stale", 0.0, "unverified")), ("d", {"headline_err": 7}, ("broken", None, "no_rate"))]:
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        assert tuple(scans.forward_baseline(spark, str(tmp_path / f"{name}.json")).first()) == want
    assert tuple(scans.forward_baseline(spark, str(tmp_path / "none.json")).first()) == ("missing", None, "not_saved")


def test_schemas_against_their_contract(spark):
    rules = spark.createDataFrame([], schemas.RULE)
    assert schemas.mismatches(rules.schema, schemas.RULE) == []
    assert schemas.mismatches(rules.drop("id").withColumn("confidence", F.lit("x")).schema, schemas.RULE) == ["id is missing", "confidence is string, not double"]


def test_fields_without_lists_read_as_with_lists(spark):
    """A field that is no list is read without functions over lists, with the same result."""
    values = [None, "", " ", " a.py ", "5", "-1.5", '{"x":1}', "[", "[]", "[broken", ' ["x", " ", "{y}", "5"] ', '[{"filename":"f"},"g"]']
    rows = spark.createDataFrame([(a, b) for a in values for b in values], "files string, path string")
    fields = [F.col("files"), F.col("path")]
    texts = F.filter(F.transform(F.array(*fields), lambda f: F.filter(scans._list(f), lambda x: (F.trim(x) != "") & ~x.startswith("{"))), lambda t: F.size(t) > 0)
    plain = F.coalesce(F.try_element_at(texts, F.lit(1)), F.array().cast("array<string>"))
    for r in rows.select("files", "path", plain.alias("want"), scans._first_list(*fields).alias("got")).collect():
        assert r.got == r.want, r


def test_an_address_is_judged_once(spark):
    """An outcome's address is taken apart once; all that follows from it reads values."""
    kept = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        export = spark.range(1).select(F.from_json(F.col("id").cast("string"), scans.EXPORT).alias("e")).select("e.*")
        plan = scans.export_events(export)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", kept)
    assert plan.count("/pull/([1-9][0-9]{0,17})(?:/") == 1
