"""Schemas of the domain."""

from __future__ import annotations

from pyspark.sql.types import StructType

#: A normalised outcome: what happened to a pull request, to whom it is attributed, and by which signature.
EXPERIENCE = (
    "experience_id string, repo_owner string, repo_name string, recorded_at timestamp, pr long, commit string, "
    "paths array<string>, diff_fingerprint string, actor_kind string, attribution_method string, attribution_confidence double, "
    "kind string, terminal_state string, signature_id string, class string, check_name string, key string, message string, "
    "extraction string, flake_discount double, urls array<string>, source_ref string, last_ingest_at timestamp, merged_since_ingest long, "
    "metadata map<string, string>"
)

#: A reviewed or drafted rule.
RULE = (
    "id string, kind string, status string, statement string, scope_paths array<string>, scope_signals array<string>, "
    "confidence double, evidence_count long, contradictions long, experiences array<string>, "
    "provenance array<struct<pr: long, outcome: string, url: string, experience_id: string>>, "
    "review_label string, review_decision string, statement_origin string, human_review boolean, merged_into string, confidence_label string, "
    "confidence_inputs struct<evidence_count: long, contradictions: long, recency_weight: double, flake_discount: double, extraction_confidence: double, drafting_model_weight: double>, "
    "decay struct<half_life_days: long, latest_evidence_at: string, oldest_evidence_at: string, anchor_recorded_at: string>"
)

#: A raw outcome event as JSON lines give it, flat or nested.
EVENT = (
    "experience_id string, repo string, repo_owner string, repo_name string, recorded_at string, pr string, commit string, commits array<string>, "
    "paths array<string>, labels array<string>, pr_labels array<string>, coauthors array<string>, coauthor_trailers array<string>, actor string, author string, actor_kind string, attribution_method string, "
    "attribution_confidence string, outcome_kind string, terminal_state string, terminal string, signature_id string, signature_class string, check_name string, "
    "signature_key string, message_fingerprint string, message string, log string, extraction_confidence string, flake_discount string, "
    "provenance_urls array<string>, pr_url string, check_run_url string, revert_url string, review_url string, diff_fingerprint string, "
    "source_kind string, memory_source string, "
    "action struct<pr: string, commit: string, commits: array<string>>, context struct<paths: array<string>, diff_fingerprint: string>, "
    "outcome struct<kind: string, terminal_state: string, terminal: string, message: string, signature: struct<class: string, check_name: string, check: string, key: string, message_fingerprint: string, extraction_confidence: string, signature_id: string>>, "
    "attribution struct<actor_kind: string, method: string, confidence: string>, "
    "provenance struct<urls: array<string>, pr_url: string, check_run_url: string, revert_url: string, review_url: string>, metadata map<string, string>"
)


def mismatches(schema: StructType, contract: str) -> list[str]:
    """What a table's schema lacks of a contract (the schemas above): fields that are missing or of another type, in order."""
    own = {f.name: f.dataType.simpleString() for f in schema}
    out = []
    for field in StructType.fromDDL(contract):
        kind = own.get(field.name)
        if kind is None:
            out.append(f"{field.name} is missing")
        elif kind != field.dataType.simpleString():
            out.append(f"{field.name} is {kind}, not {field.dataType.simpleString()}")
    return out
