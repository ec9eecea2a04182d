"""Review logs against a sequential replay, redaction at depth against recursion, and the whole rule contract."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from outcomelake.functions import columns
from outcomelake.operators import lifecycle, redaction, reviews
from outcomelake.schemas import RULE
from outcomelake.sources import scans, sinks

CLOSED = ("stale", "contradicted", "retired")


def replay(rule, log):
    """A rule after its log, action by action, and for each action (status before, status after, refused)."""
    rule, receipts = dict(rule), []
    for a in log:
        before = rule["status"]
        action, label = a["action"], a.get("label")
        ok = False
        if (action == "approve" and label in (None, "accepted")) or (action == "label" and label in (None, "accepted")):
            if ok := before not in CLOSED:
                rule |= {"status": "active", "review_label": "accepted", "review_decision": "approved", "merged_into": None}
        elif action == "label" and label in ("suggested", "needs_user_input"):
            ok = True
            if not (before == "retired" and rule["review_decision"] in ("rejected", "merged")):
                rule |= {"review_decision": "pending" if label == "suggested" else label, "merged_into": None, "status": "candidate" if before == "active" else before}
            rule["review_label"] = label
        elif action == "edit" and (a.get("statement") or a.get("scope_paths")) and label in (None, "suggested", "needs_user_input"):
            if ok := before not in CLOSED:
                rule |= {"status": "candidate", "review_label": label or "suggested", "review_decision": "pending", "merged_into": None}
                if a.get("statement"):
                    rule |= {"statement": a["statement"].strip(), "statement_origin": "human_authored"}
                if a.get("scope_paths"):
                    rule["scope_paths"] = a["scope_paths"]
        elif action == "reject":
            ok = True
            rule |= {"status": "retired", "review_label": "needs_user_input", "review_decision": "rejected", "merged_into": None}
        elif action == "merge" and a.get("target"):
            ok = True
            rule |= {"status": "retired", "review_label": "needs_user_input", "review_decision": "merged", "merged_into": a["target"]}
        receipts.append((a["seq"], action, before, rule["status"], not ok))
    return rule, receipts


@pytest.mark.parametrize(("stretch", "lists"), [(7, 9), (1, 1), (0, 1)])
def test_logs_equal_a_replay(spark, monkeypatch, stretch, lists):
    """Long and short logs, one rule with most of the actions; short stretches make several levels of them."""
    monkeypatch.setattr(reviews, "STRETCH_BITS", stretch)
    monkeypatch.setattr(reviews, "LIST_BITS", lists)
    rng = random.Random(stretch)
    rules = [{"id": f"r{i}", "status": s, "review_label": "suggested", "review_decision": d, "statement": "s", "statement_origin": "cluster_summary", "scope_paths": ["a.py"], "human_review": False, "merged_into": None} for i, (s, d) in enumerate([("candidate", "pending"), ("active", "approved"), ("stale", "pending"), ("contradicted", "pending"), ("retired", "rejected"), ("retired", "pending"), ("candidate", "pending")])]
    kinds = ["approve"] * 5 + ["edit"] * 5 + ["label"] * 6 + ["reject", "merge", "dance"]
    log = []
    for seq in range(300):
        action = rng.choice(kinds if seq > 150 else kinds[:16])
        log.append({"rule_id": rng.choice(["r0"] * 12 + ["r1", "r2", "r3", "r4", "r5", "nobody"]), "seq": seq, "action": action, "label": rng.choice([None, "accepted", "suggested", "needs_user_input"]) if action in ("label", "approve") else None, "statement": rng.choice([None, f" text {seq} "]), "scope_paths": rng.choice([None, [f"p{seq}.py"]]), "target": rng.choice([None, "r6"])})
    schema = "rule_id string, seq long, action string, label string, statement string, scope_paths array<string>, target string"
    shuffled = rng.sample(log, len(log))
    actions = spark.createDataFrame([tuple(a.values()) for a in shuffled], schema)
    table = spark.createDataFrame([tuple(r.values()) for r in rules], "id string, status string, review_label string, review_decision string, statement string, statement_origin string, scope_paths array<string>, human_review boolean, merged_into string")
    want = {r["id"]: replay(r, [a for a in log if a["rule_id"] == r["id"]]) for r in rules}
    found = {r.id: r for r in reviews.reviewed(table, actions).collect()}
    for i, (rule, receipts) in want.items():
        assert {k: found[i][k] for k in rule if k != "human_review"} == {k: v for k, v in rule.items() if k != "human_review"}, i
        assert found[i].refused == sum(r[4] for r in receipts)
    assert not found["r6"].human_review and found["r0"].human_review
    got = {}
    for r in reviews.review_receipts(table, actions).collect():
        got.setdefault(r.rule_id, []).append((r.seq, r.action, r.status_before, r.status_after, r.refused))
    assert {i: sorted(v) for i, v in got.items() if i != "nobody"} == {i: v[1] for i, v in want.items() if v[1]}
    assert all(r[2:] == (None, None, True) for r in got.get("nobody", []))


def test_reject_then_approve_stays_retired(spark):
    table = spark.createDataFrame([("r", "candidate", "suggested", "pending", "s", "cluster_summary", False)], "id string, status string, review_label string, review_decision string, statement string, statement_origin string, human_review boolean")
    log = spark.createDataFrame([("r", 1, "reject"), ("r", 2, "approve")], "rule_id string, seq long, action string")
    got = reviews.reviewed(table, log).first()
    assert (got.status, got.review_decision, got.refused) == ("retired", "rejected", 1)
    assert reviews.reviewed(table, log.limit(0)).first().status == "candidate" and reviews.reviewed(table.limit(0), log).count() == 0


def redacted(value, names=()):
    """(value, paths of what may be a secret) by recursion."""
    known, unknown = "ghp_" + "a1B2" * 8, "qW3eR5tY7uI9oP1aS2dF4gH6jK8lZ0xC"
    if isinstance(value, dict):
        out, bad = {}, []
        for k in sorted(value):
            if known in k or unknown in k:
                bad.append(".".join([*names, "<key>"]))
            if k.lower().replace("-", "_") in ("token", "client_secret", "api_key", "db_credential_id"):
                out[k] = "[REDACTED:secret]"
            else:
                out[k], more = redacted(value[k], (*names, k))
                bad += more
        return out, bad
    if isinstance(value, list):
        both = [redacted(v, (*names, str(i))) for i, v in enumerate(value)]
        return [v for v, _ in both], [b for _, bs in both for b in bs]
    if isinstance(value, str):
        return value.replace(known, "[REDACTED:token]"), [".".join(names)] if unknown in value and "node_id" not in names else []
    return value, []


def test_redaction_at_any_depth(spark):
    rng = random.Random(5)

    def made(depth):
        kind = rng.choice(["object", "list", "leaf"] if depth else ["object", "list"])
        if depth > 5 or kind == "leaf":
            return rng.choice(["plain", 'q"\\\n\té', "", 1, 2.5, None, True, "see ghp_" + "a1B2" * 8, "x qW3eR5tY7uI9oP1aS2dF4gH6jK8lZ0xC y"])
        if kind == "list":
            return [made(depth + 1) for _ in range(rng.randint(0, 12 if depth == 0 else 3))]
        keys = rng.sample(["a", "b b", "token", "Client-Secret", "api_key", "db_credential_id", 'k"y', "node_id", "ghp_" + "a1B2" * 8], rng.randint(0, 4))
        return {k: made(depth + 1) for k in keys}

    values = [made(0) for _ in range(60)]
    deep = "leaf qW3eR5tY7uI9oP1aS2dF4gH6jK8lZ0xC"
    for i in range(40):
        deep = {"w": deep} if i % 2 else [deep]
    values.append(deep)
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, t string")
    got = {r.id: r for r in redaction.redacted_json(rows, "i", "t").collect()}
    for i, v in enumerate(values):
        want, bad = redacted(v)
        assert json.loads(got[i].json) == want and got[i].bad_paths == sorted(bad) and not got[i].unsafe, v


def test_the_contract_of_sound_and_missing_scopes(spark):
    sound = dict(id="r", kind="avoid", status="candidate", statement="s", scope_paths=["src/a.py", "lib/*.py", "pkg/**"], scope_signals=[], confidence=0.8, evidence_count=1, contradictions=0, experiences=["e"], provenance=[(1, "revert", "https://github.com/a/b/pull/1", "e")], review_label="suggested", review_decision="pending", statement_origin="human_authored", human_review=False)
    rows = [sound, sound | {"id": "stale", "status": "stale", "scope_paths": ["gone.py"]}, sound | {"id": "lost", "scope_paths": ["src/a.py", "gone/x.py"]}, sound | {"id": "drafted", "statement_origin": "llm_drafted"}, sound | {"id": "empty", "provenance": None, "scope_paths": None, "experiences": None}]
    columns = [f.strip() for f in RULE.split(", merged_into")[0:1]][0]
    table = spark.createDataFrame([tuple(r.values()) for r in rows], columns)
    tree = spark.createDataFrame([("src",), ("src/a.py",), ("lib",), ("pkg",)], "path string")
    got = {r.id: r.errors for r in lifecycle.rule_errors(table, tree).collect()}
    assert got == {"lost": ["scope_missing"], "empty": ["experiences", "scope", "provenance"]}
    whole = table.withColumn("confidence_label", F.lit("low"))
    assert {r.id: r.errors for r in lifecycle.rule_errors(whole).collect()} == {"drafted": ["confidence_label"], "empty": ["experiences", "scope", "provenance"]}
    assert lifecycle.rule_errors(table.limit(0)).count() == 0


def test_rules_written_and_read(spark, tmp_path):
    """A table of rules is written with its contract checked, and read back equal."""
    row = ("r", "avoid", "active", "s", ["a.py"], ["sig"], 0.8, 2, 0, ["e"], [(1, "revert", "https://github.com/a/b/pull/1", "e")], "accepted", "approved", "human_authored", True, None, "high", None, None)
    rules = spark.createDataFrame([row], RULE)
    sinks.write_rules(rules, str(tmp_path / "rules"))
    assert [tuple(r) for r in scans.rules_parquet(spark, str(tmp_path / "rules")).collect()] == [tuple(rules.first())]
    with pytest.raises(sinks.BrokenRules, match="confidence"):
        sinks.write_rules(rules.withColumn("confidence", F.lit(2.0)), str(tmp_path / "rules"))
    assert scans.rules_parquet(spark, str(tmp_path / "rules")).count() == 1


def test_page_has_all_rules(spark, tmp_path):
    url = "https://github.com/a/b/pull/"
    cite = lambda i: [(i, "revert", f"{url}{i}", f"e{i}"), (i, "revert", f"{url}{i}", f"e{i}"), (0, "revert", "", "")]
    rows = [(f"r{i:04d}", "avoid", ("candidate", "active", "retired")[i % 3], f"say\n{i}", 0.25, 2, 0, cite(i), "suggested", "cluster_summary") for i in range(1500)]
    rules = spark.createDataFrame(rows, "id string, kind string, status string, statement string, confidence double, evidence_count long, contradictions long, provenance array<struct<pr: long, outcome: string, url: string, experience_id: string>>, review_label string, statement_origin string")
    sinks.write_memory_page(rules, str(tmp_path / "page"))
    page = "".join(p.read_text() for p in sorted((tmp_path / "page").glob("part-*")))
    assert page.startswith("# Memory\n") and page.count("\n#### ") == 1500 and page.index("## Strong memory") < page.index("#### `r0001`") < page.index("## Weak memory") < page.index("#### `r0000`") < page.index("#### `r0002`")
    assert "| active | 500 | served |" in page and "| stale | 0 | visible only |" in page and page.count("[PR #7](") == 1 and "say 7" in page
    assert page.index("### Candidate") < page.index("### Retired") and "### Stale" not in page
    empty = sinks.memory_lines(rules.limit(0)).orderBy("place").collect()
    assert any(r.line == "No active rules." for r in empty) and any(r.line == "No weak rules." for r in empty)


def spread_secret(path):
    """Secrets over several segments, window by window."""
    trim = lambda x: x.strip("-_=+")
    raw = path.strip("/").split("/")
    alphabets = lambda t: any(c.islower() for c in t) + any(c.isupper() for c in t) + any(c.isdigit() for c in t)

    def bits(t):
        return -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))

    def follows(i):
        route = trim(raw[2]).lower() if len(raw) > 2 else ""
        if i != 2 or len(raw) < 4:
            return False
        if route in ("commit", "commits"):
            return bool(re.fullmatch("[0-9a-fA-F]{6,64}", raw[3].strip()))
        if route in ("pull", "pulls", "issues", "runs"):
            return raw[3].isdigit()
        return raw[3].lower() == "runs" if route == "actions" else route in ("checks", "suites", "workflow-runs", "tree", "blob", "compare")

    def safe():
        route = trim(raw[2]).lower()
        if route in ("commit", "commits", "pull", "pulls", "issues", "runs"):
            return follows(2)
        if route == "actions":
            return trim(raw[3]).lower() == "runs" and len(raw) > 4 and trim(raw[4]).isdigit()
        return route in ("tree", "blob") and all(trim(x) for x in raw[3:]) and not spread_secret("/".join(raw[3:]))

    segments = []
    for i, x in enumerate(raw):
        structural = follows(i) or (i == 3 and trim(raw[2]).lower() == "actions" and trim(raw[3]).lower() == "runs")
        segments.append("" if structural else trim(x))
    for start in range(len(segments)):
        own = []
        for end in range(start, len(segments)):
            x = segments[end]
            if not x:
                if follows(end):
                    text = "/".join(own)
                    bare = "".join(own)
                    suspicious = len(own) > 1 and len(bare) >= 16 and alphabets(bare) >= 2 and bits(text) > 3.2
                    if not suspicious or safe():
                        own = []
                continue
            if not re.fullmatch("[A-Za-z0-9+_=-]+", x):
                break
            own.append(x)
            bare = "".join(own)
            if len(own) > 1 and len(bare) >= 32 and alphabets(bare) >= 2 and bits("/".join(own)) > 4.2:
                return True
    return False


def test_secrets_over_several_segments(spark):
    rng = random.Random(6)
    token = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    routes = ["pull", "commit", "tree", "blob", "actions", "checks", "runs", "wiki", "-pull-", "compare"]
    paths = ["acme/shop/pull/12/checks/3456789", "acme/shop/commit/" + "0a" * 20, "a/b", "", "acme/shop/actions/runs/12/job/34", "acme/shop/tree/main/src/very/long/path/of/many/common/words/in/it.py"]
    for _ in range(400):
        own = [rng.choice(["acme", token(rng.randint(6, 14))]), rng.choice(["shop", token(rng.randint(6, 14))])]
        own += [rng.choice(routes)] if rng.random() < 0.8 else []
        own += [rng.choice(["12", "main", "runs", "abcdef12", token(8), "x.py", "", "--"]) for _ in range(rng.randint(0, 2))]
        own += [token(rng.randint(4, 20)) for _ in range(rng.randint(0, 3))]
        paths.append("/".join(own))
    rows = spark.createDataFrame(list(enumerate(paths)), "i long, p string").select("i", columns.has_spread_secret(F.col("p")).alias("r")).collect()
    got = {r.i: r.r for r in rows}
    want = {i: len(p) > 32 and spread_secret(p) for i, p in enumerate(paths)}
    assert got == want and 50 < sum(want.values()) < 350, [(paths[i], got[i]) for i in got if got[i] != want[i]][:5]


def test_tasks_of_a_log_follow_its_length(spark, monkeypatch):
    """Twice the actions are dealt out to twice the tasks, so that what one task holds stays the same."""
    monkeypatch.setattr(reviews, "TASK_ROWS", 10)
    table = spark.createDataFrame([(f"r{i}", "candidate", "suggested", "pending") for i in range(20)], "id string, status string, review_label string, review_decision string")
    for n in (200, 400):
        log = spark.range(n).select(F.format_string("r%d", F.col("id") % 20).alias("rule_id"), F.col("id").alias("seq"), F.lit("approve").alias("action"))
        found = reviews.review_receipts(table, log)
        assert found.rdd.getNumPartitions() == n // 10
        assert found.count() == n and found.where("refused").isEmpty()
