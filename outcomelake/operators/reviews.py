"""A log of review actions folded onto rules in its order, however long a rule's log is.

What an action may do depends on the rule's state alone, and there are six states. So a stretch of the log is a map
of states to states; stretches compose, and only the state at each stretch's beginning is needed to go through all of
them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_path, filled, trimmed
from ..sources.storage import written

#: States of a rule under review. ``decided`` is retired by a rejection or a merge, which no label takes back.
STATES = ("candidate", "active", "stale", "contradicted", "retired", "decided")
LABELS = ("accepted", "suggested", "needs_user_input")
#: The state that each step leads to from each of :data:`STATES`; the same state where it is refused.
STEPS = ("approve", "edit", "reject", "merge", "relabel", "none")
LEADS_TO = {
    "approve": ("active", "active", "stale", "contradicted", "retired", "decided"),
    "edit": ("candidate", "candidate", "stale", "contradicted", "retired", "decided"),
    "reject": ("decided",) * 6,
    "merge": ("decided",) * 6,
    "relabel": ("candidate", "candidate", "stale", "contradicted", "retired", "decided"),
    "none": STATES,
}
#: Steps that rules which are stale, contradicted or retired refuse.
NEED_OPEN = ("approve", "edit")
#: Actions of a stretch, as a power of two, and stretches that are gone through as one list, likewise.
STRETCH_BITS, LIST_BITS = 7, 9
#: Actions that one task sorts and folds, so that its memory doesn't grow with the log.
TASK_ROWS = 500_000


#: The number of the state of a rule that isn't there, after those of :data:`STATES`.
UNKNOWN = len(STATES)


def _table() -> Column:
    return F.array(*(F.array(*(F.lit(STATES.index(s)) for s in LEADS_TO[step]), F.lit(UNKNOWN)) for step in STEPS))


def _step(action: Column, label: Column, statement: Column, paths: Column, target: Column) -> Column:
    """The step that an action is: labelling as accepted approves; an action that lacks what it needs is none."""
    paths = F.coalesce(paths, F.array().cast("array<string>"))
    edits = ((trimmed(statement) != "") | (F.size(paths) > 0)) & ~F.exists(paths, lambda p: clean_path(p).isNull())
    return (
        F.when((action == "approve") & (filled(label, F.lit("accepted")) == "accepted"), "approve")
        .when((action == "label") & (filled(label, F.lit("accepted")) == "accepted"), "approve")
        .when((action == "label") & label.isin(*LABELS), "relabel")
        .when((action == "edit") & F.coalesce(edits, F.lit(False)) & filled(label, F.lit("suggested")).isin("suggested", "needs_user_input"), "edit")
        .when((action == "reject") & filled(label, F.lit("needs_user_input")).isin("needs_user_input"), "reject")
        .when((action == "merge") & (filled(target) != "") & filled(label, F.lit("needs_user_input")).isin("needs_user_input"), "merge")
        .otherwise("none")
    )


def _beginnings(maps: DataFrame, first: DataFrame, parts: int) -> DataFrame:
    """(rule_id, stretch, state): the state in which each stretch begins; ``maps`` has (rule_id, stretch, to)."""
    several = maps.withColumn("list", F.shiftright("stretch", LIST_BITS)).repartition(parts, "rule_id", "list")
    lists = several.groupBy("rule_id", "list").agg(F.sort_array(F.collect_list(F.struct(F.col("stretch").alias("at"), "to"))).alias("maps")).withColumnRenamed("list", "stretch")
    lists = written(lists, "review-lists")
    if lists.groupBy("rule_id").count().where("count > 1").isEmpty():
        known = lists.repartition(parts, "rule_id").join(first, "rule_id")
    else:
        whole = F.aggregate("maps", F.array(*map(F.lit, range(len(STATES) + 1))), lambda to, m: F.transform(to, lambda s: m["to"][s]))
        known = lists.join(_beginnings(lists.select("rule_id", "stretch", whole.alias("to")), first, parts), ["rule_id", "stretch"])
    start = F.struct(F.col("state"), F.array().cast("array<struct<stretch: long, state: int>>").alias("found"))
    found = F.aggregate("maps", start, lambda a, m: F.struct(m["to"][a["state"]].alias("state"), F.concat(a["found"], F.array(F.struct(m["at"].alias("stretch"), a["state"].alias("state")))).alias("found")))
    return known.select("rule_id", F.explode(found["found"]).alias("one")).select("rule_id", "one.stretch", "one.state")


def review_receipts(rules: DataFrame, actions: DataFrame) -> DataFrame:
    """(rule_id, seq, action, status_before, status_after, refused, ...): what every action of the log did, in its order.

    ``actions`` has rule_id, seq and action (approve, edit, reject, merge, label), and for some of them label,
    statement, scope_paths or target; columns that it lacks are null. Refused are: approving or editing a rule that is
    stale, contradicted or retired, an action of an unknown kind or without what it needs, and one on an unknown rule
    (its states are null). Actions of equal seq stand in the order of their texts.

    The log is sorted by rule and seq over all tasks and cut into stretches, so that a rule which a third of the
    log is about is worked on by many of them. The number of tasks follows from the counted log: what one holds is bounded.
    """
    kinds = {"label": "string", "statement": "string", "scope_paths": "array<string>", "target": "string"}
    given = actions.select("rule_id", F.col("seq").cast("long").alias("seq"), "action", *((F.col(n) if n in actions.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))
    c = F.col
    given = given.withColumn("step", F.array_position(F.array(*map(F.lit, STEPS)), _step(c("action"), c("label"), c("statement"), c("scope_paths"), c("target"))).cast("int") - 1)
    spark = rules.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-given.count() // TASK_ROWS))
    order = ("rule_id", "seq", "action", "label", "statement", "scope_paths", "target")
    log = given.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    log = written(log.withColumn("stretch", F.shiftright("at", STRETCH_BITS)), "review-log")

    rows = F.sort_array(F.collect_list(F.struct("at", "step", "seq", "action", *kinds))).alias("rows")
    stretches = written(log.repartition(parts, "rule_id", "stretch").groupBy("rule_id", "stretch").agg(rows), "review-stretches")
    decided = (c("status") == "retired") & c("review_decision").isin("rejected", "merged")
    first = rules.select(c("id").alias("rule_id"), (F.when(decided, F.lit(STATES.index("decided") + 1)).otherwise(F.array_position(F.array(*map(F.lit, STATES[:-1])), c("status"))) - 1).cast("int").alias("state"))
    first = first.where("state >= 0")
    to = F.aggregate("rows", F.array(*map(F.lit, range(len(STATES) + 1))), lambda m, a: F.transform(m, lambda s: _table()[a["step"]][s]))
    starts = _beginnings(stretches.select("rule_id", "stretch", to.alias("to")), first, parts)
    begun = stretches.repartition(parts, "rule_id", "stretch").join(starts.repartition(parts, "rule_id", "stretch"), ["rule_id", "stretch"], "left").withColumn("state", F.coalesce("state", F.lit(UNKNOWN)))
    states = F.aggregate("rows", F.array(c("state")), lambda found, a: F.concat(found, F.array(_table()[a["step"]][F.element_at(found, -1)])))
    begun = begun.select("rule_id", "rows", states.alias("states"))
    each = begun.select("rule_id", F.explode(F.zip_with("rows", F.zip_with(F.slice("states", F.lit(1), F.size("rows")), F.slice("states", F.lit(2), F.size("rows")), lambda a, b: F.struct(a.alias("before"), b.alias("after"))), lambda r, s: F.struct(r.alias("row"), s.alias("state")))).alias("one"))
    each = each.select("rule_id", "one.row.*", c("one.state.before").alias("before"), c("one.state.after").alias("after"))
    name = F.array(*map(F.lit, (*STATES[:-1], "retired", None)))
    open_state = F.lit(STATES.index("active"))
    step = F.array(*map(F.lit, STEPS))[c("step")]
    refused = (step == "none") | (step.isin(*NEED_OPEN) & (c("before") > open_state)) | (c("before") == UNKNOWN)
    return each.select(
        "rule_id", "seq", "at", "action", step.alias("step"), name[c("before")].alias("status_before"), name[c("after")].alias("status_after"), refused.alias("refused"),
        (c("before") == STATES.index("decided")).alias("was_decided"), *kinds,
    )


def reviewed(rules: DataFrame, actions: DataFrame) -> DataFrame:
    """Rules after all review actions in their order; ``refused`` counts those that were refused.

    Approving makes a rule active, accepted and approved; an edit takes it back to a candidate with its statement or
    paths; a rejection or a merge retires it for good; another label takes an active rule back to a candidate. A
    label on a rejected or merged rule leaves that decision as it is.
    """
    receipts = review_receipts(rules, actions)
    c = F.col
    done = ~c("refused")
    decides = done & ~((c("step") == "relabel") & c("was_decided"))
    label = F.when(c("step") == "approve", "accepted").when(c("step").isin("reject", "merge"), "needs_user_input").otherwise(filled(c("label"), F.lit("suggested")))
    decision = F.when(c("step") == "approve", "approved").when(c("step") == "reject", "rejected").when(c("step") == "merge", "merged").when((c("step") == "relabel") & (label == "needs_user_input"), "needs_user_input").otherwise("pending")
    last = lambda when, value, alias: F.max(F.when(when, F.struct("at", value.alias("value")))).alias(alias)
    edits = done & (c("step") == "edit")
    paths = F.transform("scope_paths", clean_path)
    ends = receipts.groupBy(c("rule_id").alias("id")).agg(
        last(done, c("status_after"), "new_status"), last(done, label, "new_label"), last(decides, decision, "new_decision"), last(decides, F.when(c("step") == "merge", trimmed(c("target"))), "new_target"),
        last(edits & (filled(c("statement")) != ""), trimmed(c("statement")), "new_statement"), last(edits & (F.size("scope_paths") > 0), paths, "new_paths"), F.count_if("refused").alias("refused"),
    )
    both = rules.join(ends, "id", "left")
    has = lambda n: c(n).isNotNull()
    value = lambda n, old: F.when(has(n), c(f"{n}.value")).otherwise(c(old) if old in rules.columns else F.lit(None))
    fresh = {"status": value("new_status", "status"), "review_label": value("new_label", "review_label"), "review_decision": value("new_decision", "review_decision"), "merged_into": value("new_target", "merged_into").cast("string")}
    if "statement" in rules.columns:
        fresh["statement"] = value("new_statement", "statement")
    if "scope_paths" in rules.columns:
        fresh["scope_paths"] = value("new_paths", "scope_paths")
    fresh["statement_origin"] = F.when(has("new_statement"), "human_authored").otherwise(c("statement_origin"))
    fresh["human_review"] = F.coalesce(c("human_review"), F.lit(False)) | has("new_decision")
    fresh["refused"] = F.coalesce("refused", F.lit(0)).cast("long")
    return both.withColumns(fresh).select(*dict.fromkeys([*rules.columns, *fresh]))
