"""Rules' life: review, merging with earlier reviews, compiled context, and comments on changes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DateType, MapType, StringType, StructType, TimestampType

from ..functions.columns import LIFECYCLE, OUTCOME_KINDS, clean_path, filled, pr_url_number, rfc3339, sha256, staged
from .recurrence import ranked

def merge_lifecycle(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """Drafts with earlier reviews carried over: an accepted active rule outlasts a candidate, a retired one anything."""
    kept = existing.select("id", *(F.col(c).alias(f"old_{c}") for c in ("status", "review_label", "review_decision", "human_review")))
    both = drafts.join(kept, "id", "left")
    active = (F.col("old_status") == "active") & (F.col("old_review_label") == "accepted") & (F.col("status") == "candidate")
    retired = (F.col("old_status") == "retired") & F.col("old_review_decision").isin("merged", "rejected")
    carry = F.coalesce(active | retired, F.lit(False))
    return both.withColumns({c: F.when(carry, F.col(f"old_{c}")).otherwise(F.col(c)) for c in ("status", "review_label", "review_decision", "human_review")}).drop("old_status", "old_review_label", "old_review_decision", "old_human_review")


def status_counts(rules: DataFrame) -> DataFrame:
    """(status, rules) for all five states, zeros included."""
    states = rules.sparkSession.createDataFrame([(s, i) for i, s in enumerate(LIFECYCLE)], "status string, place int")
    counts = rules.groupBy("status").agg(F.count("*").alias("n"))
    return states.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("rules"), "place").orderBy("place").drop("place")


def by_lifecycle(rules: DataFrame) -> DataFrame:
    """Rules with their place in the order of their life, unknown states last, then by id, and their state as a title."""
    place = F.array_position(F.array(*map(F.lit, LIFECYCLE)), F.col("status"))
    return ranked(rules, F.when(place == 0, len(LIFECYCLE) + 1).otherwise(place), "id", name="place").withColumn("title", F.initcap("status"))


def draft_summary(rules: DataFrame) -> DataFrame:
    """(status, kind, review_label, drafts, least_confidence): drafted rules by state."""
    return rules.groupBy("status", "kind", "review_label").agg(F.count("*").alias("drafts"), F.min("confidence").alias("least_confidence"))


def merge_targets(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """Merge actions (rule_id, target) with ``valid``: whether the target is another rule that exists and is not itself retired."""
    alive = rules.where("status <> 'retired'").select(F.col("id").alias("target"), F.lit(True).alias("known"))
    return actions.join(alive, "target", "left").select("rule_id", "target", (F.coalesce("known", F.lit(False)) & (F.col("rule_id") != F.col("target"))).alias("valid"))


def compiled_context_id(chosen: DataFrame, target: str) -> DataFrame:
    """One row: an id of a target and the rules compiled for it (200 at most, see :func:`compiled`), their confidences and addresses."""
    line = F.concat_ws("|", "id", F.format_string("%.4f", F.col("confidence")), F.array_join(F.array_sort(F.transform("provenance", lambda p: p["url"])), ","))
    lines = F.array_sort(F.collect_list(line))
    return chosen.agg(sha256(F.concat(F.lit(target + "\n"), F.array_join(lines, "\n"))).alias("context_id"), F.count("*").alias("rules"))


def latest_states(states: DataFrame) -> DataFrame:
    """(change_id, diff_fingerprint, risk_level, generated_at): the newest advisory state of each change, for :func:`comment_decision`."""
    newest = F.max(F.struct("generated_at", "diff_fingerprint", "risk_level")).alias("last")
    return states.groupBy("change_id").agg(newest).select("change_id", "last.diff_fingerprint", "last.risk_level", "last.generated_at")


def compiled(rules: DataFrame, most: int = 25) -> DataFrame:
    """The ``most`` (1 to 200) most confident rules that a human approved."""
    if not 1 <= most <= 200:
        raise ValueError("most must be from 1 to 200")
    own = rules.where("status = 'active' and review_label = 'accepted' and human_review and review_decision = 'approved'")
    return own.orderBy(F.coalesce(F.col("confidence"), F.lit(-1.0)).desc(), "id").limit(most)


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "high").when(confidence >= 0.5, "medium").otherwise("low")


def rule_errors(rules: DataFrame, known_paths: DataFrame | None = None) -> DataFrame:
    """(id, errors): rules that break the contract, each with the names of what it breaks, in the contract's order.

    A rule needs an id, statement, kind, status, a confidence from 0 to 1, a scope, experiences, evidence and citations
    that agree with each other; its review must fit its status; what was not written by a human must state how its
    confidence came about. Columns of the contract that ``rules`` lacks are not looked at. With ``known_paths`` (path:
    files and directories) a scope path that is none of them, as it stands or as a glob's fixed beginning, is an error
    unless the rule is stale.
    """
    c, own = F.col, set(rules.columns)
    false = F.lit(False)
    some = lambda x: F.coalesce(x, false)
    none = F.array().cast("array<string>")
    texts = lambda n: F.filter(F.coalesce(c(n), none), lambda x: filled(x) != "")
    cites = c("provenance")
    active, decision, label = c("status") == "active", c("review_decision"), c("review_label")
    broken = {
        "id": filled(c("id")) == "",
        "statement": filled(c("statement")) == "",
        "kind": ~some(c("kind").isin("avoid", "playbook")),
        "status": ~some(c("status").isin(*LIFECYCLE)),
        "confidence": ~some(c("confidence").between(0, 1)),
        "experiences": F.size(texts("experiences")) == 0,
        "scope": F.size(F.concat(texts("scope_paths"), texts("scope_signals") if "scope_signals" in own else none)) == 0,
        "scope_path": F.exists(F.coalesce(c("scope_paths"), none), lambda p: clean_path(p).isNull()),
        "evidence_count": ~some(c("evidence_count") >= 1),
        "contradictions": ~some(c("contradictions") >= 0),
        "provenance": some(F.size(cites) < 1) | cites.isNull(),
        "citation_pr": some(F.exists(cites, lambda p: ~some(p["pr"] >= 1))),
        "citation": some(F.exists(cites, lambda p: F.coalesce(pr_url_number(p["url"]) != p["pr"], F.lit(True)))),
        "citation_outcome": some(F.exists(cites, lambda p: ~some(p["outcome"].isin(*OUTCOME_KINDS)))),
        "playbook_evidence": some((c("kind") == "playbook") & ~F.exists(cites, lambda p: some(p["outcome"].isin("fix_held", "merged_clean")))),
        "review_label": ~some(label.isin("accepted", "suggested", "needs_user_input")),
        "active_unreviewed": some(active & (label != "accepted")),
        "accepted_inactive": some(~active & (label == "accepted")),
        "review_decision": some(~decision.isin("pending", "approved", "needs_user_input", "rejected", "merged")),
        "active_undecided": some(active & (decision != "approved")),
        "approved_inactive": some(~active & (decision == "approved")),
        "decided_alive": some(decision.isin("rejected", "merged") & (c("status") != "retired")),
        "merged_into": some((decision == "merged") & (filled(c("merged_into") if "merged_into" in own else F.lit(None).cast("string")) == "")),
        "statement_origin": ~some(c("statement_origin").isin("llm_drafted", "cluster_summary", "human_authored")),
    }
    drafted = some(c("statement_origin") != "human_authored")
    if "confidence_label" in own:
        broken["confidence_label"] = drafted & ~some(c("confidence_label") == confidence_label(c("confidence")))
    if "confidence_inputs" in own:
        inputs = c("confidence_inputs")
        broken["inputs_evidence"] = drafted & ~some((inputs["evidence_count"] >= 1) & (inputs["evidence_count"] == c("evidence_count")))
        broken["inputs_contradictions"] = drafted & ~some((inputs["contradictions"] >= 0) & (inputs["contradictions"] == c("contradictions")))
        broken |= {f"inputs_{n}": drafted & ~some(inputs[n].between(0, 1)) for n in ("recency_weight", "flake_discount", "extraction_confidence")}
        broken["inputs_model_weight"] = drafted & ~some(inputs["drafting_model_weight"] == 0)
    if "decay" in own:
        broken["half_life"] = drafted & ~some(c("decay.half_life_days") >= 1)
        broken |= {f"decay_{n}": drafted & rfc3339(c(f"decay.{n}")).isNull() for n in ("latest_evidence_at", "oldest_evidence_at", "anchor_recorded_at")}
    if known_paths is not None:
        asked = rules.where("status <> 'stale'").select("id", F.explode("scope_paths").alias("path")).select("id", clean_path(F.regexp_replace("path", r"/?[^/]*[*?\[].*$", "")).alias("path"))
        lost = asked.where("path is not null").join(known_paths.select("path").distinct(), "path", "left_anti").select("id").distinct()
        rules = rules.join(lost.withColumn("lost_path", F.lit(True)), "id", "left")
        broken["scope_missing"] = some(c("lost_path"))
    return staged(rules.select("id", F.array_compact(F.array(*(F.when(b, F.lit(n)) for n, b in broken.items()))).alias("errors"))).where(F.size("errors") > 0)


def comment_decision(assessments: DataFrame, prior: DataFrame, now: str, *, enabled: bool = True, most_comments: int = 1, debounce_minutes: int = 10, least_confidence: float = 0.6) -> DataFrame:
    """Whether each assessment (assessment_id, change_id, risk_level, coverage, max_avoid_confidence, diff_fingerprint) gets a comment.

    ``prior`` has each change's last state (change_id, diff_fingerprint, risk_level, generated_at). Reasons not to
    comment, in this order: disabled, no comments allowed, clean or too little confidence (a change that has a
    state gets a comment that clears it instead, once for a fingerprint), the same fingerprint and risk as in the state,
    a state that is too fresh. ``published_risk`` is the risk, or that its confidence is too small; the state that
    follows is in ``state_fingerprint``, ``published_risk`` and ``state_at``. A path without coverage makes
    confidence no matter.
    """
    c = F.col
    own = prior.select("change_id", c("diff_fingerprint").alias("last_fingerprint"), (c("risk_level") if "risk_level" in prior.columns else F.lit("")).alias("last_risk"), c("generated_at").alias("last_at"))
    both = assessments.join(own, "change_id", "left")
    at = F.to_timestamp(F.lit(now))
    known = F.coalesce(c("last_fingerprint"), F.lit("")) != ""
    same = known & (c("diff_fingerprint") == c("last_fingerprint"))
    uncovered = F.coalesce(c("coverage") == "no_coverage", F.lit(False)) if "coverage" in assessments.columns else F.lit(False)
    clean = c("risk_level") == "covered_clean"
    low = ~c("risk_level").isin("no_coverage", "covered_clean") & ~uncovered & (F.coalesce(c("max_avoid_confidence"), F.lit(0.0)) < least_confidence)
    last_risk = F.coalesce(c("last_risk"), F.lit(""))
    debounced = known & F.coalesce(at < c("last_at") + F.expr(f"INTERVAL {int(debounce_minutes)} MINUTES"), F.lit(False))
    reason = (
        F.when(F.lit(not enabled), "disabled")
        .when(F.lit(most_comments <= 0), "comment_cap")
        .when(clean, F.when(~known, "clean").when(same & (last_risk == "covered_clean"), "unchanged").otherwise(""))
        .when(low, F.when(same & (last_risk == "below_min_confidence"), "unchanged").otherwise("low_confidence"))
        .when(same & ((last_risk == "") | (last_risk == c("risk_level"))), "unchanged")
        .when(debounced, "debounced")
        .otherwise("")
    )
    both = both.withColumn("skip_reason", reason)
    comment = (c("skip_reason") == "") | ((c("skip_reason") == "low_confidence") & known)
    both = both.withColumn("comment", comment).withColumn("published_risk", F.when(c("skip_reason") == "low_confidence", "below_min_confidence").otherwise(c("risk_level")))
    kept = c("skip_reason") == "debounced"
    both = both.withColumn("state_fingerprint", F.when(kept, c("last_fingerprint")).otherwise(c("diff_fingerprint"))).withColumn("state_at", F.when(kept, c("last_at")).otherwise(at))
    return both.drop("last_fingerprint", "last_risk", "last_at")


def provider_cost(experiences: DataFrame, price_per_1000: float, cap: float, drafts: int = 1, line: Column | None = None) -> DataFrame:
    """One row: estimated tokens of all records, as the text ``line`` or JSON (a quarter of the bytes each, rounded up), and their price."""
    text = line if line is not None else F.to_json(F.struct(*experiences.columns))
    sums = experiences.agg(F.sum(F.ceil(F.octet_length(text) / 4.0)).alias("input_tokens"))
    cost = F.round((F.col("input_tokens") + F.col("output_tokens")) / 1000.0 * price_per_1000, 4)
    return sums.withColumn("output_tokens", F.lit(96 + 64 * drafts).cast("long")).withColumn("cost", cost).withColumn("status", F.when(F.col("cost") > cap, "over_cap").otherwise("within_cap"))


#: Fields that say when a record was taken in, not what happened; they have no influence on a digest.
FRESHNESS = ("last_ingest_at", "merged_since_ingest", "source_ref")


def canonical_json(value: Column, kind: DataType) -> Column:
    """A value as one JSON text, whatever the order of its fields: keys of objects and maps stand in order at every depth."""
    null = F.lit("null")
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNull(), null).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    if isinstance(kind, ArrayType):
        return F.when(value.isNull(), null).otherwise(F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]")))
    if isinstance(kind, MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), F.concat(_quoted(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType)).alias("t"))))
        return F.when(value.isNull(), null).otherwise(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: e["t"]), ","), F.lit("}")))
    if isinstance(kind, TimestampType):
        return F.coalesce(_quoted(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), null)
    if isinstance(kind, (StringType, DateType, BinaryType)):
        return F.coalesce(_quoted(value.cast("string")), null)
    return F.coalesce(value.cast("string"), null)


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def record_line(experiences: DataFrame) -> Column:
    """A whole record as canonical JSON, without the fields of :data:`FRESHNESS`."""
    own = StructType([f for f in experiences.schema if f.name not in FRESHNESS])
    return canonical_json(F.struct(*(F.col(f"`{f.name}`") for f in own)), own)


def digest_parts(experiences: DataFrame, shard: Column, line: Column | None = None) -> DataFrame:
    """(shard, n, p0, p1, p2, p3): how many records a shard has, and their digests added up in four parts.

    Each record is the text ``line``, or its canonical JSON. Sums can be taken apart again: parts of a table that
    changed follow from those before and the rows that went and came (:func:`changed_parts`).
    """
    lines = experiences.select(shard.alias("shard"), F.sha2(line if line is not None else record_line(experiences), 256).alias("digest"))
    parts = [F.sum(F.conv(F.substring("digest", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    return lines.groupBy("shard").agg(F.count("*").alias("n"), *parts)


def changed_parts(parts: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """The parts after some rows went and others came, from their own parts; shards without records are left out."""
    names = ("n", "p0", "p1", "p2", "p3")
    every = parts.unionByName(come).unionByName(gone.select("shard", *((-F.col(n)).alias(n) for n in names)))
    sums = every.groupBy("shard").agg(F.sum("n").cast("long").alias("n"), *(F.sum(n).cast("decimal(38,0)").alias(n) for n in names[1:]))
    return sums.where("n <> 0")


def digest_of(parts: DataFrame) -> DataFrame:
    """One row: the digest that the parts of all shards come to. The shards, months, are few; their digests are put in order."""
    one = F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(F.col(f"p{i}").cast("string") for i in range(4))), 256)
    return parts.select(one.alias("digest")).agg(sha256(F.array_join(F.array_sort(F.collect_list("digest")), "\n")).alias("source_digest"))


def source_digest(experiences: DataFrame, shard: Column, line: Column | None = None) -> DataFrame:
    """One row: a digest that changes with any record, whatever their order.

    Of a shard's records, each as the text ``line`` (its canonical JSON without it), the digests are summed up in four
    parts, so no list of them is ever made; the digests of the few shards are put in order.
    """
    return digest_of(digest_parts(experiences, shard, line))
