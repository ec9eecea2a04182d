"""Sinks: experiences by month with upsert, and one-row reports as JSON, Markdown and HTML."""

from __future__ import annotations

import html
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import LIFECYCLE
from ..operators.lifecycle import rule_errors, status_counts
from ..schemas import RULE
from .storage import new_path, written


def merged_months(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Experiences of both by (month, experience_id): the last write of each, ``fresh`` being last.

    ``fresh`` has a column ``batch_seq`` for the order within it. A record whose time moved to another month
    leaves its old row where it was.
    """
    month = F.date_format("recorded_at", "yyyy-MM")
    both = stored.withColumn("batch_seq", F.lit(-1).cast("long")).withColumn("month", month).unionByName(fresh.withColumn("month", month))
    last = Window.partitionBy("month", "experience_id").orderBy(F.desc("batch_seq"))
    return both.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place", "batch_seq")


def upsert_experiences(fresh: DataFrame, path: str) -> None:
    """Rewrite just the months that ``fresh`` touches.

    The merged months are first written whole under a temporary path, so a failure before the swap leaves
    the table as it was. The swap is made month by month: a failure within it leaves some months new and some
    old, and running it again gives the same table.
    """
    spark = fresh.sparkSession
    months = [r.month for r in fresh.select(F.date_format("recorded_at", "yyyy-MM").alias("month")).distinct().collect()]
    plain = fresh.drop("batch_seq")
    try:
        stored = spark.read.parquet(path).where(F.col("month").cast("string").isin(months)).drop("month").select(*plain.columns)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        stored = plain.limit(0)
    staged = new_path(spark, "upsert")
    merged_months(stored, fresh).write.partitionBy("month").parquet(staged)
    ready = spark.read.option("basePath", staged).parquet(staged).withColumn("month", F.col("month").cast("string"))
    ready.write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def report_json(report: DataFrame) -> str:
    """The one-row report as indented JSON with sorted keys."""
    return json.dumps(json.loads(report.select(F.to_json(F.struct(*report.columns)).alias("r")).first().r), sort_keys=True, indent=2)


def save_baseline(report: DataFrame, path: str) -> bool:
    """Write the one-row report as the next runs' baseline, unless its gate failed; says whether it was written.

    The row is computed and held before the old baseline is replaced, so a report that can't be computed leaves
    it as it was.
    """
    row = report.select(F.to_json(F.struct(*report.columns)).alias("value"), "gate_status").first()
    if row is None or row.gate_status == "failed":
        return False
    report.sparkSession.createDataFrame([(row.value,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return True


def report_text(report: DataFrame, kinds: DataFrame) -> str:
    """The one-row report for people, with failures by kind in order; a kind is one of a fixed few."""
    row = report.first()
    lines = [f"Recurrence: {row.headline_err_percent} ({row.confirmed_recurrence_count} of {row.agent_failure_denominator} failures)", f"Possible: {row.possible_recurrence_count}"]
    return "\n".join(lines + [f"{r.kind}: {r.failures}" for r in kinds.orderBy("kind").collect()]) + "\n"


def report_html(report: DataFrame) -> str:
    """The one-row report as a table; all text is escaped."""
    rows = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(str(v))}</td></tr>" for k, v in report.first().asDict().items())
    return f"<!doctype html><title>Recurrence report</title><table>{rows}</table>"


def code_span(text: str) -> str:
    """Markdown code of any text: the fence is longer than the runs of backticks inside."""
    text = "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in text)
    longest = max((len(run) for run in "".join(c if c == "`" else " " for c in text).split()), default=0)
    fence = "`" * (longest + 1)
    pad = " " if text.startswith("`") or text.endswith("`") or not text.strip() else ""
    return f"{fence}{pad}{text}{pad}{fence}"


BEGIN, END = "<!-- outcomelake:begin -->", "<!-- outcomelake:end -->"


def upsert_block(content: str, block: str) -> tuple[str, bool]:
    """(content, changed) with what stands between the markers replaced; appended where there are none."""
    if content.count(BEGIN) > 1 or content.count(BEGIN) != content.count(END) or (BEGIN in content and content.index(BEGIN) > content.index(END)):
        raise ValueError("the managed block's markers are not one pair in order")
    fresh = f"{BEGIN}\n{block.rstrip()}\n{END}"
    if BEGIN in content:
        out = content[: content.index(BEGIN)] + fresh + content[content.index(END) + len(END) :]
    else:
        out = content.rstrip("\n") + ("\n\n" if content.strip() else "") + fresh + "\n"
    return out, out != content


class BrokenRules(ValueError):
    """Some rule breaks the contract, so none is written."""


def write_rules(rules: DataFrame, path: str, known_paths: DataFrame | None = None) -> None:
    """Write rules in the schema of rules, all of them or, where one breaks the contract, none; columns that lack are null.

    They are computed once, beside the table, which is replaced at the end.
    """
    kinds = StructType.fromDDL(RULE)
    whole = written(rules.select(*((F.col(f.name) if f.name in rules.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds)), "rules")
    stated = whole.drop(*(c for c in ("confidence_label", "confidence_inputs", "decay") if c not in rules.columns))
    broken = rule_errors(stated, known_paths).limit(5).collect()
    if broken:
        raise BrokenRules("; ".join(f"{r.id}: {', '.join(r.errors)}" for r in broken))
    whole.write.mode("overwrite").parquet(path)


def _span(text: Column) -> Column:
    """Markdown code of a text, on one line; :func:`code_span` as an expression."""
    line = F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")
    longest = F.array_max(F.transform(F.regexp_extract_all(line, F.lit("`+"), F.lit(0)), lambda x: F.length(x)))
    fence = F.repeat(F.lit("`"), F.coalesce(longest, F.lit(0)) + 1)
    pad = F.when(line.startswith("`") | line.endswith("`") | (F.trim(line) == ""), " ").otherwise("")
    return F.concat(fence, pad, line, pad, fence)


def memory_lines(rules: DataFrame) -> DataFrame:
    """(place, line): the page of all rules, line by line; ``place`` is (section, state, rule id, number), in order.

    The page has a table of all states with their counts, zeros included; active rules as strong memory, and all others
    as weak memory, by state and id, each with what it says, its evidence and its receipts: the pull requests it
    cites, without repeats. A rule's lines are made within its row, so a page of any length is made by all tasks.
    """
    c = F.col
    n = F.lit
    place = lambda section, state, rule, number: F.struct(section.cast("int").alias("section"), state.cast("int").alias("state"), rule.alias("rule"), number.cast("int").alias("number"))
    spark = rules.sparkSession
    counts = status_counts(rules).withColumn("state", F.array_position(F.array(*map(F.lit, LIFECYCLE)), c("status")))
    heads = [(0, "# Memory"), (1, ""), (2, "## Lifecycle"), (3, ""), (4, "| state | rules | use |"), (5, "| --- | ---: | --- |")]
    fixed = [(0, i, t) for i, t in heads] + [(2, i, t) for i, t in enumerate(["", "## Strong memory", "", "Active rules are served.", ""])] + [(4, i, t) for i, t in enumerate(["## Weak memory", "", "All other rules are visible for review only.", ""])]
    parts = [spark.createDataFrame(fixed, "section int, number int, line string").select(place(c("section"), n(0), n(""), c("number")).alias("place"), "line")]
    use = F.when(c("status") == "active", "served").otherwise("visible only")
    parts.append(counts.select(place(n(1), c("state"), n(""), n(0)).alias("place"), F.concat(n("| "), "status", n(" | "), c("rules").cast("string"), n(" | "), use, n(" |")).alias("line")))
    strong = c("status") == "active"
    section = F.when(strong, 3).otherwise(5)
    state = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LIFECYCLE)), c("status")), F.lit(0)), F.lit(len(LIFECYCLE) + 1))
    some = counts.where("rules > 0")
    parts.append(some.select(place(section, c("state"), n(""), n(0)).alias("place"), F.explode(F.array(F.concat(n("### "), F.initcap("status")), n(""))).alias("line")).withColumn("line", c("line")))
    for flag, at, told in ((strong, 3, "No active rules."), (~strong, 5, "No weak rules.")):
        parts.append(counts.agg(F.sum(F.when(flag, c("rules")).otherwise(0)).alias("n")).where("n = 0").select(place(n(at), n(0), n(""), n(0)).alias("place"), n(told).alias("line")))
    plain = lambda name: F.regexp_replace(F.coalesce(c(name).cast("string"), n("")), r"[\x00-\x1F\x7F]+", " ")
    cited = F.filter("provenance", lambda p: (p["pr"] > 0) & (F.coalesce(p["url"], n("")) != ""))
    receipts = F.array_distinct(F.transform(cited, lambda p: F.concat(n("  - [PR #"), p["pr"].cast("string"), n("]("), p["url"], n(")"), F.when(p["outcome"] != "", F.concat(n(" - outcome `"), p["outcome"], n("`"))).otherwise(""), F.when(p["experience_id"] != "", F.concat(n(", experience `"), p["experience_id"], n("`"))).otherwise(""))))
    confidence = F.format_string("%.4g", c("confidence"))
    lines = F.concat(
        F.array(F.concat(n("#### "), _span(c("id"))), n(""), F.concat(n("- "), plain("kind"), n(", "), plain("status"), n(", confidence "), confidence), F.concat(n("- review: "), plain("review_label"), n(", "), plain("statement_origin")),
                F.concat(n("- evidence: "), c("evidence_count").cast("string"), n(" for, "), c("contradictions").cast("string"), n(" against")), F.concat(n("- statement: "), F.trim(plain("statement")))),
        F.when(F.size(receipts) > 0, F.concat(F.array(n("- receipts:")), receipts)).otherwise(F.array().cast("array<string>")), F.array(n("")),
    )
    own = rules.select(section.alias("section"), state.alias("state"), "id", F.posexplode(lines).alias("number", "line"))
    parts.append(own.select(place(c("section"), c("state"), c("id"), c("number")).alias("place"), "line"))
    return reduce(DataFrame.unionByName, parts)


def write_memory_page(rules: DataFrame, path: str) -> None:
    """The page of all rules as text, in parts whose names are in the page's order."""
    lines = memory_lines(rules)
    parts = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, "place", "line").sortWithinPartitions("place", F.desc("line")).select("line").write.mode("overwrite").text(path)


def comment_text(risk_level: Column, paths: Column, fingerprint: Column) -> Column:
    """:func:`advisory_comment` as an expression, for the comments of many changes."""
    three = F.transform(F.slice(paths, 1, 3), _span)
    more = F.when(F.size(paths) > 3, F.concat(F.lit(" and "), (F.size(paths) - 3).cast("string"), F.lit(" more"))).otherwise("")
    named = F.when(F.size(paths) > 0, F.concat(F.array_join(three, ", "), more)).otherwise("none")
    return F.concat(F.lit("<!-- outcomelake:advisory "), fingerprint, F.lit(" -->\n**Risk:** "), risk_level, F.lit("\n\nWithout coverage: "), named, F.lit("\n"))


def advisory_comment(risk_level: str, paths: list[str], fingerprint: str) -> str:
    """A comment's text with a hidden marker of the change; no more than three uncovered paths are named."""
    named = ", ".join(code_span(p) for p in paths[:3]) + (f" and {len(paths) - 3} more" if len(paths) > 3 else "")
    return f"<!-- outcomelake:advisory {fingerprint} -->\n**Risk:** {risk_level}\n\nWithout coverage: {named or 'none'}\n"


def state_text(decided: DataFrame) -> DataFrame:
    """``decided`` (see :func:`~outcomelake.operators.lifecycle.comment_decision`) with ``state``: each change's next state as JSON.

    A debounced assessment keeps the fingerprint and time of the state before; the fingerprint that it had is noted beside.
    """
    at = F.date_format("state_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    debounced = F.when(F.col("skip_reason") == "debounced", F.col("diff_fingerprint"))
    metadata = F.struct(at.alias("generated_at"), F.col("published_risk").alias("risk_level"), debounced.alias("debounced_diff_fingerprint"))
    return decided.withColumn("state", F.to_json(F.struct("change_id", F.col("state_fingerprint").alias("diff_fingerprint"), F.col("comment").alias("should_comment"), "skip_reason", F.struct("risk_level").alias("assessment"), metadata.alias("metadata"))))


def write_states(decided: DataFrame, path: str) -> None:
    """The next states of all changes as JSON lines, replacing those at ``path``."""
    state_text(decided).select("state").write.mode("overwrite").text(path)
