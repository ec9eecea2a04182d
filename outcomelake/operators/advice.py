"""Comments on changes as their assessments come: each decision depends on the state that the last one left."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What :func:`replayed` and the stream of advice read, and what they return.
ASSESSMENT = "change_id long, assessment_id string, assessed_at timestamp, risk_level string, coverage string, max_avoid_confidence double, diff_fingerprint string"
DECISION = "change_id long, assessment_id string, assessed_at timestamp, skip_reason string, comment boolean, published_risk string, state_fingerprint string, state_at timestamp"


@dataclass(frozen=True)
class Policy:
    enabled: bool = True
    most_comments: int = 1
    debounce_minutes: int = 10
    least_confidence: float = 0.6


class State(NamedTuple):
    """What is known of a change: the fingerprint and risk last looked at, and when."""

    fingerprint: str
    risk: str
    at: datetime


def decide(state: State | None, risk: str, coverage: str | None, confidence: float | None, fingerprint: str, at: datetime, policy: Policy) -> tuple[str, bool, State]:
    """(skip reason, comment, state after it): :func:`~.lifecycle.comment_decision` for one assessment."""
    known = state is not None and state.fingerprint != ""
    same = known and state.fingerprint == fingerprint
    low = risk not in ("no_coverage", "covered_clean") and coverage != "no_coverage" and (confidence or 0.0) < policy.least_confidence
    if not policy.enabled:
        reason = "disabled"
    elif policy.most_comments <= 0:
        reason = "comment_cap"
    elif risk == "covered_clean":
        reason = "clean" if not known else "unchanged" if same and state.risk == "covered_clean" else ""
    elif low:
        reason = "unchanged" if same and state.risk == "below_min_confidence" else "low_confidence"
    elif same and state.risk in ("", risk):
        reason = "unchanged"
    elif known and at < state.at + timedelta(minutes=policy.debounce_minutes):
        reason = "debounced"
    else:
        reason = ""
    published = "below_min_confidence" if reason == "low_confidence" else risk
    after = State(state.fingerprint, published, state.at) if reason == "debounced" else State(fingerprint, published, at)
    return reason, reason == "" or (reason == "low_confidence" and known), after


_ARROW = pa.schema([("change_id", pa.int64()), ("assessment_id", pa.string()), ("assessed_at", pa.timestamp("us", "UTC")), ("skip_reason", pa.string()), ("comment", pa.bool_()), ("published_risk", pa.string()), ("state_fingerprint", pa.string()), ("state_at", pa.timestamp("us", "UTC"))])


def _replay(policy: Policy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by change and time; one state is held, whatever a change's length."""
        change, state, begun = None, None, False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not begun or r["change_id"] != change:
                    change, state, begun = r["change_id"], None, True
                reason, comment, state = decide(state, r["risk_level"], r["coverage"], r["max_avoid_confidence"], r["diff_fingerprint"] or "", r["assessed_at"], policy)
                out.append({"change_id": change, "assessment_id": r["assessment_id"], "assessed_at": r["assessed_at"], "skip_reason": reason, "comment": comment, "published_risk": state.risk, "state_fingerprint": state.fingerprint, "state_at": state.at})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


def replayed(assessments: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Decisions (:data:`DECISION`) on all assessments (:data:`ASSESSMENT`), change by change in order of time, then id.

    A change's assessments are gone through in order by one task, which holds its state alone; changes are spread over
    all tasks.
    """
    rows = assessments.select(*(F.col(n).cast(k).alias(n) for n, k in (x.split(" ") for x in ASSESSMENT.split(", "))))
    rows = rows.repartition("change_id").sortWithinPartitions("change_id", "assessed_at", "assessment_id")
    return rows.mapInArrow(_replay(policy), DECISION)
