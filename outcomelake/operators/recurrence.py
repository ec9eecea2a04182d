"""Recurrence: windows, flake discounts, as-of pairing of failures with earlier ones, rates and report lists.

Experiences are rows of the columns listed in :data:`outcomelake.schemas.EXPERIENCE`. "Earlier" is the
order of (recorded_at, experience_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written
from ..functions.columns import clean_paths, is_failure, is_reliable, joined, percent_text, primary_url, rfc3339_text, scope_paths, short_hash, trimmed

SEPARATOR = "\u0000"
#: Rows of a key that are put in order by one task.
CHUNK_ROWS = 200_000


def signature_keys() -> Column:
    """The keys by which failures are the same: class and key, and the message; the signature id without either."""
    kind, key, message = (F.coalesce(trimmed(F.col(c)), F.lit("")) for c in ("class", "key", "message"))
    by_class = F.when((kind != "") & (key != ""), F.concat_ws(SEPARATOR, F.lit("class_key"), kind, key))
    by_message = F.when(message != "", F.concat_ws(SEPARATOR, F.lit("message"), message))
    found = F.array_compact(F.array(by_class, by_message))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.concat_ws(SEPARATOR, F.lit("id"), F.coalesce("signature_id", F.lit("")))))


def key_text(key: Column) -> Column:
    """A key as reports show it."""
    return F.regexp_replace(F.regexp_replace(key, "^id" + SEPARATOR, ""), SEPARATOR, ":")


def order_key() -> Column:
    return F.struct(F.col("recorded_at").alias("at"), F.col("experience_id").alias("id"))


def window_bounds(experiences: DataFrame, days: int) -> tuple[object, object]:
    """(start, anchor): the latest time of all records and ``days`` times 24 hours before; two values for the driver.

    Literal bounds let a scan of experiences stored by month skip other months.
    """
    row = experiences.agg((F.max("recorded_at") - F.expr(f"INTERVAL {int(days)} DAYS")).alias("start"), F.max("recorded_at").alias("anchor")).first()
    return row.start, row.anchor


def in_window(experiences: DataFrame, days: int) -> DataFrame:
    """Records from the anchor back over ``days`` days, both ends included."""
    start, anchor = window_bounds(experiences, days)
    if anchor is None:
        return experiences.limit(0)
    return experiences.where(F.col("recorded_at").between(F.lit(start), F.lit(anchor)))


def flaky_keys(experiences: DataFrame) -> DataFrame:
    """(sig): keys of three agent failures or more that touch pairwise different paths outside tests."""
    failures = experiences.where((F.col("actor_kind") == "agent") & is_failure(F.col("kind")))
    by_key = failures.select("experience_id", scope_paths(F.col("paths")).alias("own"), F.explode(signature_keys()).alias("sig"))
    sizes = by_key.groupBy("sig").agg(F.count("*").alias("members"))
    paths = by_key.select("sig", F.explode("own").alias("path")).groupBy("sig", "path").agg(F.count("*").alias("uses"))
    paths = paths.groupBy("sig").agg(F.count("*").alias("paths"), F.max("uses").alias("most"))
    return sizes.where("members >= 3").join(paths, "sig").where("most = 1 and paths >= members").select("sig")


def with_flakes(experiences: DataFrame) -> DataFrame:
    """Experiences with ``heuristic``: an agent failure without a discount of its own, of a flaky key."""
    flaky = flaky_keys(experiences)
    keyed = experiences.where((F.col("actor_kind") == "agent") & is_failure(F.col("kind")) & (F.col("flake_discount") == 0)).select("experience_id", F.explode(signature_keys()).alias("sig"))
    hit = keyed.join(flaky, "sig", "left_semi").select("experience_id").distinct().withColumn("heuristic", F.lit(True))
    return experiences.join(hit, "experience_id", "left").withColumn("heuristic", F.coalesce("heuristic", F.lit(False)))


def is_discounted() -> Column:
    return (F.col("flake_discount") > 0) | F.col("heuristic")


def newest_prior(rows: DataFrame, keys: list[str], chunk: str = "day") -> DataFrame:
    """(*keys, id, prior): of rows with columns ``keys``, recorded_at, id and pr, the newest earlier row of the same
    key and another pr.

    No pairs are made. A key's rows are taken in chunks of time; each chunk is summed up by its newest row
    and its newest one of another pr, and only these few rows of a key are brought into one order. Within
    a chunk the row before and the last change of pr give the answer. So a key that holds a large part of
    all rows is spread over as many tasks as it has chunks.
    """
    row = F.struct(F.col("recorded_at").alias("at"), F.col("id").alias("id"), F.col("pr").alias("pr"))
    rows = rows.select(*keys, F.date_trunc(chunk, "recorded_at").alias("chunk"), row.alias("row"))
    newest = rows.groupBy(*keys, "chunk", F.col("row.pr").alias("pr")).agg(F.max("row").alias("row"))
    ranked = newest.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy(F.desc("row")))).where("rank <= 2")
    by_time = Window.partitionBy(*keys).orderBy("row")
    before = F.lag("row").over(by_time)
    heads = ranked.withColumn("before", before)
    heads = heads.withColumn("other", F.last(F.when(F.col("before.pr") != F.col("row.pr"), F.col("before")), ignorenulls=True).over(by_time))
    ends = heads.where("rank = 1").select(*keys, "chunk", F.struct("row", "other").alias("end"))
    carried = ends.select(*keys, "chunk", F.lag("end").over(Window.partitionBy(*keys).orderBy("chunk")).alias("carry"))
    inside = Window.partitionBy(*keys, "chunk").orderBy("row")
    # Keys are coalesced for the join only, so that rows with a null key part meet their own.
    placed = rows.join(carried, [*keys, "chunk"])
    placed = placed.withColumn("before", F.coalesce(F.lag("row").over(inside), F.col("carry.row")))
    placed = placed.withColumn("other", F.coalesce(F.last(F.when(F.col("before.pr") != F.col("row.pr"), F.col("before")), ignorenulls=True).over(inside), F.when(F.col("carry.row.pr") != F.col("row.pr"), F.col("carry.row")), F.col("carry.other")))
    second = F.coalesce(F.lag("other").over(inside), F.col("carry.other"))
    prior = F.when(F.col("before.pr") != F.col("row.pr"), F.col("before")).otherwise(second)
    return placed.select(*keys, F.col("row.id").alias("id"), prior.alias("prior")).where("prior is not null")


def chunk_of(rows: DataFrame, keys: list[str]) -> str:
    """The longest unit of time in which no key has more than ``CHUNK_ROWS`` rows; seconds if there is none.

    One sum answers where no key has more rows at all; only else keys are counted by time.
    """
    if (rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0) <= CHUNK_ROWS:
        return "day"
    counts = rows.groupBy(*keys, F.date_trunc("minute", "recorded_at").alias("at")).agg(F.count("*").alias("n"))
    largest = {}
    for unit in ("minute", "hour", "day"):
        counts = written(counts, "chunk-sizes") if unit == "minute" else counts.groupBy(*keys, F.date_trunc(unit, "at").alias("at")).agg(F.sum("n").alias("n"))
        largest[unit] = counts.agg(F.max("n").alias("n")).first().n or 0
    return next((u for u in ("day", "hour", "minute") if largest[u] <= CHUNK_ROWS), "second")


def recurrence_pairs(experiences: DataFrame, *, chunk: str | None = None) -> DataFrame:
    """Pairs of an agent's failure with an earlier failure, one at most for each.

    ``experiences`` carry ``heuristic`` (see :func:`with_flakes`). Discounted failures and uncertain rows
    take no part; human failures are priors only. A pair is confirmed where both extractions are reliable
    and the cleaned paths overlap; the newest such prior goes before any newer one that is only possible.
    The matched key is the first of the prior's that the current row has too. Rows without a signature id,
    which no normalised record lacks, confirm nothing. ``chunk`` is the unit of time by which a key's rows are
    taken; without it, it follows from how many rows the largest key has (:func:`chunk_of`).
    """
    own = experiences.where(is_failure(F.col("kind")) & (F.col("actor_kind") != "uncertain") & ~is_discounted())
    url = primary_url(F.col("urls"), F.col("repo_owner"), F.col("repo_name"), F.col("pr")).alias("url")
    own = written(own.select("recorded_at", "experience_id", "pr", "actor_kind", "extraction", "signature_id", "source_ref", signature_keys().alias("sigs"), clean_paths(F.col("paths")).alias("clean"), url), "pairs-own")
    keyed = own.select("recorded_at", F.col("experience_id").alias("id"), "pr", "actor_kind", "extraction", "signature_id", "clean", F.explode("sigs").alias("sig"))
    chunk = chunk or chunk_of(keyed, ["sig"])
    agents = own.where("actor_kind = 'agent'").select(F.col("experience_id").alias("id"))
    # A row stands under its key alone, and, if it can confirm, under its key with each of its paths: one search for both.
    reliable = is_reliable(F.col("extraction")) & (trimmed(F.col("signature_id")) != "")
    anywhere = F.array(F.lit(""))
    placed = keyed.select("recorded_at", "id", "pr", "sig", F.explode(F.when(reliable, F.concat(anywhere, "clean")).otherwise(anywhere)).alias("path"))
    best = newest_prior(placed, ["sig", "path"], chunk).select("id", (F.col("path") != "").alias("confirmed"), "prior")
    best = best.join(agents, "id", "left_semi").groupBy("id").agg(F.max(F.struct("confirmed", "prior")).alias("best"))
    best = best.select("id", "best.confirmed", F.col("best.prior.id").alias("prior_id"))

    side = own.select("experience_id", "pr", "sigs", "signature_id", "source_ref", "url", "recorded_at")
    current = side.select(*(F.col(c).alias(f"current_{c}") for c in side.columns))
    prior = side.select(*(F.col(c).alias(f"prior_{c}") for c in side.columns))
    pairs = best.join(current, F.col("id") == F.col("current_experience_id")).join(prior, F.col("prior_id") == F.col("prior_experience_id"))
    matched = F.try_element_at(F.filter("prior_sigs", lambda k: F.array_contains("current_sigs", k)), F.lit(1))
    return pairs.select(
        "current_experience_id", "prior_experience_id", "current_pr", "prior_pr", "current_url", "prior_url",
        F.col("current_signature_id").alias("signature_id"), key_text(matched).alias("matched_signature_id"),
        F.when(F.col("confirmed"), "confirmed").otherwise("possible").alias("confidence"), F.array("prior_source_ref", "current_source_ref").alias("refs"), F.col("current_recorded_at").alias("seen_at"),
    )


def counters(experiences: DataFrame) -> DataFrame:
    """One row of counts over a window; experiences carry ``heuristic``."""
    agent, failure, uncertain = F.col("actor_kind") == "agent", is_failure(F.col("kind")), F.col("actor_kind") == "uncertain"
    return experiences.agg(
        F.count("*").alias("window_experience_count"),
        F.count_if(agent & failure).alias("agent_failure_denominator"),
        F.count_if(~uncertain & ~agent & failure).alias("human_failure_excluded_count"),
        F.count_if(~uncertain & ~failure).alias("non_failure_outcome_count"),
        F.count_if(uncertain).alias("attribution_uncertain_count"),
        F.count_if(agent & failure & is_discounted()).alias("flake_discounted_count"),
        F.countDistinct("pr").alias("prs_analyzed"),
        F.countDistinct(F.when(agent, F.col("pr"))).alias("agent_attributed_prs"),
        F.count_if(agent).alias("agent_attributed_experiences"),
    )


def failures_by_kind(experiences: DataFrame) -> DataFrame:
    """(kind, failures) of agents, discounted ones included."""
    return experiences.where((F.col("actor_kind") == "agent") & is_failure(F.col("kind"))).groupBy("kind").agg(F.count("*").alias("failures"))


def error_recurrence(experiences: DataFrame, pairs: DataFrame) -> DataFrame:
    """The one-row summary: counters, pair counts, and the confirmed pairs per agent failure."""
    sums = pairs.agg(F.count_if(F.col("confidence") == "confirmed").alias("confirmed_recurrence_count"), F.count_if(F.col("confidence") == "possible").alias("possible_recurrence_count"))
    both = counters(experiences).join(sums)  # one row each
    rate = F.round(F.coalesce(F.try_divide(F.col("confirmed_recurrence_count").cast("double"), F.col("agent_failure_denominator").cast("double")), F.lit(0.0)), 4)
    return both.withColumn("headline_err", rate).withColumn("headline_err_percent", percent_text(F.col("headline_err")))


def ranked(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in a total order: a range-partitioned sort, and each partition's rows counted from those before it.

    Only one row a partition is ever brought together.
    """
    placed = written(rows.orderBy(*order).withColumn("ranked at", F.monotonically_increasing_id()), "ranked").withColumn("ranked part", F.shiftright("`ranked at`", 33))
    counts = placed.groupBy("ranked part").agg(F.count("*").alias("n"))
    before = Window.orderBy("ranked part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("ranked part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked before"))
    within = F.col("ranked at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(starts), "ranked part").withColumn(name, F.col("ranked before") + within + 1)
    return numbered.drop("ranked part", "ranked at", "ranked before")


def mistake_members(pairs: DataFrame) -> DataFrame:
    """(signature_id, experience_id, pr, url, source_ref, is_repeat): the two sides of confirmed pairs, a row each, by the matched signature."""
    confirmed = pairs.where("confidence = 'confirmed'").withColumn("signature_id", F.coalesce(F.nullif("matched_signature_id", F.lit("")), F.col("signature_id"))).where("signature_id <> ''")
    side = lambda name, ref, repeat: F.struct(F.col(f"{name}_experience_id").alias("experience_id"), F.col(f"{name}_pr").alias("pr"), F.col(f"{name}_url").alias("url"), F.col("refs")[ref].alias("source_ref"), F.lit(repeat).alias("is_repeat"))
    return confirmed.select("signature_id", F.explode(F.array(side("prior", 0, False), side("current", 1, True))).alias("side")).select("signature_id", "side.*")


def top_mistakes(pairs: DataFrame) -> DataFrame:
    """(rank, signature_id, repeat_count, prs, experiences): signatures by how many confirmed pairs they have.

    ``prs`` and ``experiences`` are how many different ones take part; :func:`mistake_members` names them, a
    row each, since a signature may have any number.
    """
    grouped = mistake_members(pairs).groupBy("signature_id").agg(
        F.count_if("is_repeat").alias("repeat_count"), F.countDistinct(F.when(F.col("pr") != 0, F.col("pr"))).alias("prs"), F.countDistinct("experience_id").alias("experiences"),
    )
    return ranked(grouped, F.desc("repeat_count"), "signature_id")


def flake_supporters(experiences: DataFrame) -> DataFrame:
    """(sig, experience_id, pr, source_ref): agent failures by key, which support every discounted one of that key."""
    failures = experiences.where((F.col("actor_kind") == "agent") & is_failure(F.col("kind")))
    return failures.select(F.explode(signature_keys()).alias("sig"), "experience_id", "pr", "source_ref")


def flake_support(experiences: DataFrame) -> DataFrame:
    """Discounted agent failures with their keys and how many other agent failures share one.

    The failures themselves are those of :func:`flake_supporters` with one of the keys; they are not listed
    for every flake, which would make all pairs of a key's rows. A record has two keys at most, so the
    number follows from the sizes of its keys and of the two together.
    """
    failures = experiences.where((F.col("actor_kind") == "agent") & is_failure(F.col("kind"))).select("experience_id", "pr", "signature_id", "flake_discount", "heuristic", signature_keys().alias("sigs"))
    by_key = failures.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    by_both = failures.where("size(sigs) = 2").groupBy("sigs").agg(F.count("*").alias("both"))
    flakes = failures.where(is_discounted()).withColumns({"first": F.col("sigs")[0], "second": F.try_element_at("sigs", F.lit(2))})
    flakes = flakes.join(by_key.select(F.col("sig").alias("first"), F.col("n").alias("n1")), "first", "left").join(by_key.select(F.col("sig").alias("second"), F.col("n").alias("n2")), "second", "left").join(by_both, "sigs", "left")
    discount = F.round(F.when(F.col("flake_discount") == 0, F.lit(1.0)).otherwise(F.col("flake_discount")), 4)
    zero = F.lit(0).cast("long")
    supporting = F.coalesce("n1", zero) + F.coalesce("n2", zero) - F.coalesce("both", zero) - 1
    return flakes.select("experience_id", "pr", "signature_id", discount.alias("flake_discount"), F.when(F.col("heuristic"), "heuristic").otherwise("explicit").alias("reason"), "sigs", supporting.alias("supporting"))


def citations(experiences: DataFrame, pairs: DataFrame) -> DataFrame:
    """One citation a pull request: of the rows cited, the one cited last.

    Uncertain rows, discounted failures of agents and humans are cited in their turn, a pair's rows in
    the current row's turn, the prior first.
    """
    url = primary_url(F.col("urls"), F.col("repo_owner"), F.col("repo_name"), F.col("pr"))
    explicit_human = (F.col("actor_kind") == "human") & is_failure(F.col("kind")) & (F.col("flake_discount") > 0)
    agent_flake = (F.col("actor_kind") == "agent") & is_failure(F.col("kind")) & is_discounted()
    single = experiences.where((F.col("actor_kind") == "uncertain") | explicit_human | agent_flake).select("pr", url.alias("url"), "experience_id", F.struct("recorded_at", "experience_id", F.lit(0).alias("turn")).alias("seen"))
    side = lambda name, turn: F.struct(F.col(f"{name}_pr").alias("pr"), F.col(f"{name}_url").alias("url"), F.col(f"{name}_experience_id").alias("experience_id"), F.struct(F.col("seen_at").alias("recorded_at"), F.col("current_experience_id").alias("experience_id"), F.lit(turn).alias("turn")).alias("seen"))
    paired = pairs.select(F.inline(F.array(side("prior", 0), side("current", 1))))
    every = single.unionByName(paired).where("url <> ''")
    last = every.groupBy("pr").agg(F.max(F.struct("seen", "url", "experience_id")).alias("last"))
    return last.select("pr", "last.url", "last.experience_id")


def report_lists(experiences: DataFrame, pairs: DataFrame) -> DataFrame:
    """(list, place, pr, experience_id): a report's pairs, flakes and uncertain records in the order in which it gives them."""
    agent_flake = (F.col("actor_kind") == "agent") & is_failure(F.col("kind")) & is_discounted()
    parts = {
        "pairs": pairs.select(F.col("current_pr").alias("pr"), F.col("current_experience_id").alias("experience_id")),
        "flakes": experiences.where(agent_flake).select("pr", "experience_id"),
        "uncertain": experiences.where("actor_kind = 'uncertain'").select("pr", "experience_id"),
    }
    found = [ranked(rows, "pr", "experience_id", name="place").select(F.lit(name).alias("list"), "place", "pr", "experience_id") for name, rows in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def ingest_freshness(experiences: DataFrame) -> DataFrame:
    """One row: the latest ingest time, and of its rows the most pull requests merged since; nulls are ignored."""
    latest = experiences.where("last_ingest_at is not null").groupBy("last_ingest_at").agg(F.max("merged_since_ingest").alias("merged_since_ingest"))
    return latest.orderBy(F.desc("last_ingest_at")).limit(1)


def badge(report: DataFrame, now: str) -> DataFrame:
    """Badge text and colour of one-row reports with headline_err, last_ingest_at and merged_since_ingest."""
    age = F.to_timestamp(F.lit(now)) - F.col("last_ingest_at")
    stale = F.col("last_ingest_at").isNull() | F.col("merged_since_ingest").isNull() | (age > F.expr("INTERVAL 30 DAYS")) | (F.col("merged_since_ingest") > 20)
    color = F.when(stale, "lightgrey").when(F.col("headline_err") >= 0.3, "orange").when(F.col("headline_err") >= 0.1, "yellow").otherwise("brightgreen")
    return report.withColumn("badge_message", F.concat(F.lit("ERR "), percent_text(F.col("headline_err")), F.when(stale, " stale").otherwise(""))).withColumn("badge_color", color).withColumn("badge_stale", stale)


def gate(report: DataFrame, enabled: bool, threshold: float | None) -> DataFrame:
    """Whether the rate passes the threshold; off without one. A failed gate has exit code 5."""
    if not enabled or threshold is None:
        return report.withColumns({"gate_status": F.lit("disabled"), "gate_exit_code": F.lit(0)})
    failed = F.col("headline_err") > threshold
    return report.withColumns({"gate_status": F.when(failed, "failed").otherwise("passed"), "gate_exit_code": F.when(failed, 5).otherwise(0)})


def report_id(start: Column, end: Column, digest: Column) -> Column:
    """An id of a report's window, sources and headline counts; the same sources give the same id."""
    counts = ("agent_failure_denominator", "confirmed_recurrence_count", "possible_recurrence_count")
    return F.concat(F.lit("backtest_"), short_hash(joined(SEPARATOR, rfc3339_text(start), rfc3339_text(end), digest, *(F.col(c) for c in counts))))


#: What a report says about itself, by the column that must be over 0 (none for what it always says).
DIAGNOSTICS = {
    "memory_source_verified": ("pass", None),
    "possible_recurrences_excluded": ("info", "possible_recurrence_count"),
    "flake_discounts_visible": ("info", "flake_discounted_count"),
    "uncertain_attribution_excluded": ("info", "attribution_uncertain_count"),
}


def diagnosed(report: DataFrame) -> DataFrame:
    """One-row reports with ``diagnostics`` (type, status), in order, and ``feedback``: what it found in a sentence, and what to do next.

    A baseline of other sources (``baseline_status`` stale) is a warning, where the report was compared with one.
    """
    found = [F.when(F.lit(True) if c is None else F.col(c) > 0, F.struct(F.lit(n).alias("type"), F.lit(s).alias("status"))) for n, (s, c) in DIAGNOSTICS.items()]
    if "baseline_status" in report.columns:
        found.append(F.when(F.col("baseline_status") == "stale", F.struct(F.lit("stale_baseline").alias("type"), F.lit("warn").alias("status"))))
    summary = F.concat(F.col("headline_err_percent"), F.lit(" of failures repeated: "), F.col("confirmed_recurrence_count").cast("string"), F.lit(" confirmed recurrences across "), F.col("agent_failure_denominator").cast("string"), F.lit(" agent failures."))
    following = F.when(F.col("agent_failure_denominator") > 0, "distill").otherwise("ingest")
    return report.withColumns({"diagnostics": F.array_compact(F.array(*found)), "feedback": F.struct(summary.alias("summary"), following.alias("next_step"))})
