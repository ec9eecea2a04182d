"""Advice as a stream: the state of every change is kept by the engine, and outlives the query that made it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from ..operators.advice import ASSESSMENT, DECISION, Policy, State, decide

#: Setting that the session needs for state that is kept by value.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = StructType([StructField("fingerprint", StringType()), StructField("risk", StringType()), StructField("at", TimestampType())])


def assessment_stream(spark: SparkSession, path: str) -> DataFrame:
    """Assessments as JSON lines, as files come."""
    return spark.readStream.schema(ASSESSMENT).json(path)


class Advice(StatefulProcessor):
    """One state a change; the assessments of a micro-batch are taken in order of time, then id."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("advice", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["assessed_at", "assessment_id"], kind="stable")
        stored = self.state.get() if self.state.exists() else None
        state = State(stored[0], stored[1], pd.Timestamp(stored[2])) if stored is not None else None
        out = []
        for r in own.itertuples(index=False):
            reason, comment, state = decide(state, r.risk_level, r.coverage, None if pd.isna(r.max_avoid_confidence) else r.max_avoid_confidence, r.diff_fingerprint or "", r.assessed_at, self.policy)
            out.append((key[0], r.assessment_id, r.assessed_at, reason, comment, state.risk, state.fingerprint, state.at))
        self.state.update((state.fingerprint, state.risk, pd.Timestamp(state.at).to_pydatetime()))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in DECISION.split(", ")])

    def close(self) -> None:
        pass


def advice_stream(assessments: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Decisions (:data:`~outcomelake.operators.advice.DECISION`) on a stream of assessments (:data:`~outcomelake.operators.advice.ASSESSMENT`).

    Batch by batch the rows are those of :func:`~outcomelake.operators.advice.replayed`, as long as no assessment comes
    later than a newer one of its change. The session must name :data:`STORE`. A batch's assessments of one change
    are sorted in one task.
    """
    return assessments.groupBy("change_id").transformWithStateInPandas(Advice(policy), DECISION, "Append", "None")
