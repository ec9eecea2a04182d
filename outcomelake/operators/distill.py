"""Distilling rules from experiences: clusters, evidence, confidence, contradictions, scopes and drafts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import extraction_score, is_failure, primary_url, scope_paths, short_hash, slug, trimmed
from ..sources.storage import written
from .components import connected_components
from .recurrence import SEPARATOR, with_flakes

MESSAGE = "message" + SEPARATOR


def cluster_keys() -> Column:
    """Keys by which records cluster: (id, check, key) of a stable signature, (class, check, key), message; else the id."""
    ident, check, key, kind, message = (F.coalesce(trimmed(F.col(c)), F.lit("")) for c in ("signature_id", "check_name", "key", "class", "message"))
    stable = F.when((ident != "") & ~ident.startswith("sig_generated") & (check != "") & (key != ""), F.concat_ws(SEPARATOR, F.lit("id_check_key"), ident, check, key))
    by_class = F.when((kind != "") & (check != "") & (key != ""), F.concat_ws(SEPARATOR, F.lit("class_check_key"), kind, check, key))
    by_message = F.when(message != "", F.concat_ws(SEPARATOR, F.lit("message"), message))
    alone = F.when(by_class.isNull() & by_message.isNull(), F.concat_ws(SEPARATOR, F.lit("id"), F.coalesce("signature_id", F.lit(""))))
    return F.array_compact(F.array(stable, by_class, by_message, alone))


def record_signal() -> Column:
    """The first of check name, key, signature id and kind that is not blank."""
    return F.coalesce(*(F.when(trimmed(F.col(c)) != "", F.col(c)) for c in ("check_name", "key", "signature_id", "kind")), F.lit("signature"))


def cluster_members(experiences: DataFrame) -> DataFrame:
    """(experience_id, component): records that share a key, directly or through others; component is the smallest id.

    Each key links its records to one of them; uncertain records take no part.
    """
    keyed = experiences.where("actor_kind <> 'uncertain'").select("experience_id", F.explode(cluster_keys()).alias("key"))
    heads = written(keyed.groupBy("key").agg(F.min("experience_id").alias("head")), "cluster-heads")
    links = keyed.join(heads, "key").select(F.col("experience_id").alias("a"), F.col("head").alias("b"))
    groups = connected_components(links, "clusters").withColumnRenamed("id", "experience_id")
    ids = experiences.where("actor_kind <> 'uncertain'").select("experience_id").distinct()
    return ids.join(groups, "experience_id", "left").select("experience_id", F.coalesce("component", "experience_id").alias("component"))


class _Cluster:
    def __init__(self, key: str):
        self.key, self.signal, self.into = key, "", self

    def root(self) -> _Cluster:
        """The cluster that took this one over, or itself; what is passed on the way is pointed nearer."""
        at = self
        while at.into is not at:
            at.into = at.into.into
            at = at.into
        return at


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, cluster_key, signal) from records sorted by component and time.

    A component's records are replayed in order. The cluster of a record's first known key takes over
    those of its other known keys; it is called after a message when messages are all that the record
    has in common with it. Only the keys seen are held, and what a cluster takes over is not gone through.
    """
    current: str | None = None
    by_key: dict[str, _Cluster] = {}
    cluster: _Cluster | None = None
    done: list[tuple] = []
    for batch in batches:
        for component, keys, signal in zip(*(batch[c].to_pylist() for c in ("component", "keys", "signal")), strict=True):
            if component != current:
                if cluster is not None:
                    done.append((current, cluster.key, cluster.signal))
                current, by_key = component, {}
            known = [k for k in keys if k in by_key]
            if known:
                cluster = by_key[known[0]].root()
                for k in known[1:]:
                    by_key[k].root().into = cluster
                if all(k.startswith(MESSAGE) for k in known):
                    cluster.key = known[0]
            else:
                cluster = _Cluster(keys[0])
            by_key.update(dict.fromkeys(keys, cluster))
            cluster.signal = cluster.signal or signal
    if cluster is not None:
        done.append((current, cluster.key, cluster.signal))
    if done:
        yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["component", "cluster_key", "signal"])


def clusters(experiences: DataFrame) -> DataFrame:
    """(experience_id, component, cluster_key, signal)."""
    members = written(cluster_members(experiences), "cluster-members")
    rows = experiences.select("experience_id", "recorded_at", cluster_keys().alias("keys"), record_signal().alias("signal")).join(members, "experience_id")
    # Once its keys are known in one cluster, a record with the same ones changes nothing but, by messages alone, the name,
    # so the last of these stands for all but the first.
    seen = F.struct("recorded_at", "experience_id", "signal")
    rows = rows.groupBy("component", "keys").agg(F.min(seen).alias("first"), F.max(seen).alias("last"))
    renames = F.forall("keys", lambda k: k.startswith(MESSAGE)) & (F.col("last") > F.col("first"))
    rows = rows.select("component", "keys", F.explode(F.when(renames, F.array("first", "last")).otherwise(F.array("first"))).alias("seen")).select("component", "keys", "seen.*")
    rows = rows.repartition("component").sortWithinPartitions("component", "recorded_at", "experience_id").select("component", "keys", "signal")
    names = rows.mapInArrow(_names, "component string, cluster_key string, signal string")
    return members.join(written(names, "cluster-names"), "component")


def effective_discount() -> Column:
    """A record's flake discount between 0 and 1; 1 for a heuristic one."""
    return F.when(F.col("heuristic"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("flake_discount"))))


def evidence(experiences: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows of evidence by cluster and rule kind: failures for avoid, held and clean outcomes for playbook.

    A cluster drafts an avoid rule where some failure's discount is below 0.75, and a playbook rule where
    some fix held.
    """
    rows = experiences.join(placed, "experience_id").withColumn("discount", effective_discount())
    avoid = rows.where(is_failure(F.col("kind"))).withColumn("rule_kind", F.lit("avoid"))
    playbook = rows.where(F.col("kind").isin("fix_held", "merged_clean")).withColumn("rule_kind", F.lit("playbook"))
    every = avoid.unionByName(playbook)
    drafts = every.groupBy("component", "rule_kind").agg(F.min("discount").alias("least"), F.max((F.col("kind") == "fix_held").cast("int")).alias("held"))
    drafts = written(drafts.where("(rule_kind = 'avoid' and least < 0.75) or (rule_kind = 'playbook' and held = 1)").select("component", "rule_kind"), "drafts")
    return every.join(drafts, ["component", "rule_kind"])


def confidence(rows: DataFrame, contradictions: DataFrame, anchor: Column, half_life_days: int = 90, by: tuple[str, ...] = ("component", "rule_kind")) -> DataFrame:
    """Confidence of grouped evidence with its parts; ``contradictions`` has the groups' counts, absent ones are 0.

    Amount, recency, extraction and absence of flakes weigh .40, .25, .20 and .15; each contradiction
    takes a quarter away, .65 at most; fewer than three records reach .6 at most.
    """
    age = F.greatest(F.lit(0.0), (F.unix_micros(anchor) - F.unix_micros("recorded_at")) / F.lit(86_400e6))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("evidence_count"),
        F.avg(F.pow(F.lit(0.5), age / F.lit(float(half_life_days)))).alias("recency"),
        F.avg(extraction_score(F.col("extraction"))).alias("extraction_mean"),
        F.avg("discount").alias("flake_mean"),
        F.min("recorded_at").alias("oldest"),
        F.max("recorded_at").alias("latest"),
    )
    sums = sums.join(contradictions, list(by), "left").withColumn("contradictions", F.coalesce("contradictions", F.lit(0).cast("long")))
    amount = F.least(F.lit(1.0), F.sqrt("evidence_count") / F.sqrt(F.lit(3.0)))
    raw = (0.40 * amount + 0.25 * F.col("recency") + 0.20 * F.col("extraction_mean") + 0.15 * F.greatest(F.lit(0.0), 1 - F.col("flake_mean"))) * (1 - F.least(F.lit(0.65), F.col("contradictions") * 0.25))
    value = F.round(raw, 4)
    value = F.when((F.col("evidence_count") < 3) & (value > 0.6), 0.6).otherwise(value)
    label = F.when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    return sums.withColumn("confidence", value).withColumn("confidence_label", label).select(
        *by, "confidence", "confidence_label", "evidence_count", "contradictions", F.round("recency", 4).alias("recency_weight"),
        F.round("extraction_mean", 4).alias("extraction_confidence"), F.round("flake_mean", 4).alias("flake_discount"), "oldest", "latest",
    )


def contradiction_counts(experiences: DataFrame, placed: DataFrame) -> DataFrame:
    """(component, rule_kind, contradictions): outcomes of the other sort after the latest of the rule's own."""
    rows = experiences.join(placed, "experience_id").select("component", "recorded_at", is_failure(F.col("kind")).alias("failed"), F.col("kind").isin("fix_held", "merged_clean").alias("fine"))
    latest = rows.groupBy("component").agg(F.max(F.when(F.col("failed"), F.col("recorded_at"))).alias("last_failed"), F.max(F.when(F.col("fine"), F.col("recorded_at"))).alias("last_fine"))
    latest = written(latest, "latest-evidence")
    counts = rows.join(latest, "component").groupBy("component").agg(F.count_if(F.col("fine") & (F.col("recorded_at") > F.col("last_failed"))).alias("avoid"), F.count_if(F.col("failed") & (F.col("recorded_at") > F.col("last_fine"))).alias("playbook"))
    return counts.unpivot("component", ["avoid", "playbook"], "rule_kind", "contradictions")


def top_values(values: DataFrame, by: list[str], value: str, name: str, limit: int = 3) -> DataFrame:
    """The ``limit`` most frequent values of a group, ties by value, as an ordered list."""
    counts = values.where(trimmed(F.col(value)) != "").groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))).where(F.col("place") <= limit)
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda x: x[value]).alias(name))


def rule_status(scope_missing: Column, contradictions: Column) -> Column:
    """A draft is stale where its whole scope is gone, else contradicted, else a candidate; never active."""
    return F.when(F.coalesce(scope_missing, F.lit(False)), "stale").when(contradictions > 0, "contradicted").otherwise("candidate")


def review_label(status: Column, confidence_: Column) -> Column:
    return F.when(status == "active", "accepted").when(status.isin("stale", "contradicted", "retired"), "needs_user_input").when(confidence_ < 0.55, "needs_user_input").otherwise("suggested")


def scopes_alive(rules: DataFrame, working_tree: DataFrame, by: list[str]) -> DataFrame:
    """The ``by`` of rules some of whose scope paths, as files or directories, exist in a tree of files (path)."""
    below = working_tree.select(F.explode(ancestors(F.col("path"))).alias("scope")).distinct()
    return rules.select(*by, F.explode("scope_paths").alias("scope")).join(below, "scope", "left_semi").select(*by).distinct()


def provenance_entries(rules: DataFrame) -> DataFrame:
    """(id, place, pr, outcome, url, experience_id): what rules cite, in the order of pull request and experience, a row each."""
    ordered = F.array_sort(F.transform("provenance", lambda p: F.struct(F.coalesce(p["pr"], F.lit(0).cast("long")).alias("pr"), p["experience_id"].alias("experience_id"), p["outcome"].alias("outcome"), p["url"].alias("url"))))
    return rules.select("id", F.posexplode(ordered).alias("place", "p")).select("id", (F.col("place") + 1).alias("place"), "p.pr", "p.outcome", "p.url", "p.experience_id")


def statement_of(kind: Column, signal: Column, paths: Column) -> Column:
    """What a drafted rule says, by its kind, signal and scope."""
    where = F.when(F.size(paths) > 0, F.array_join(paths, ", ")).otherwise("this scope")
    playbook = F.concat(F.lit("Prefer the held "), signal, F.lit(" pattern in "), where, F.lit(" when this signature appears."))
    return F.when(kind == "playbook", playbook).otherwise(F.concat(F.lit("Avoid repeating "), signal, F.lit(" in "), where, F.lit(" without addressing the prior failure evidence.")))


def rule_id(kind: Column, signal: Column, cluster_key: Column) -> Column:
    """A drafted rule's id: its kind, its signal in plain letters and a hash of its cluster's key."""
    return F.concat_ws("-", kind, F.coalesce(F.nullif(slug(signal), F.lit("")), F.lit("signature")), short_hash(F.concat(kind, F.lit(SEPARATOR), cluster_key)))


def draft_rules(experiences: DataFrame, *, half_life_days: int = 90, working_tree: DataFrame | None = None) -> DataFrame:
    """Drafted rules of all clusters of a set of experiences.

    ``working_tree`` has a column ``path`` of existing files; a rule none of whose scope paths exists, as a
    file or a directory, is stale. Without it no rule is.
    """
    marked = written(with_flakes(experiences), "distill-marked")
    placed = clusters(marked)
    rows = written(evidence(marked, placed), "distill-evidence")
    anchor = F.lit(experiences.agg(F.max("recorded_at").alias("t")).first().t)
    by = ["component", "rule_kind"]
    scored = confidence(rows, contradiction_counts(marked, placed), anchor, half_life_days)
    paths = top_values(rows.select(*by, F.explode(scope_paths(F.col("paths"))).alias("path")), by, "path", "scope_paths")
    named = rows.select(*by, "cluster_key", "signal").distinct()
    signals = rows.select(*by, record_signal().alias("value")).unionByName(named.select(*by, F.col("signal").alias("value")))
    signals = top_values(signals, by, "value", "scope_signals")
    url = primary_url(F.col("urls"), F.col("repo_owner"), F.col("repo_name"), F.col("pr"))
    cited = rows.select(*by, "pr", F.col("kind").alias("outcome"), url.alias("url"), F.struct("recorded_at", "experience_id").alias("seen"))
    cited = cited.groupBy(*by, "pr", "outcome", "url").agg(F.min("seen").alias("seen"))
    cited = cited.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pr", F.col("seen.experience_id").alias("experience_id"), "outcome", "url"))).alias("provenance"))
    members = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("recorded_at", "experience_id"))).alias("members"))
    rules = scored.join(named, by).join(paths, by, "left").join(signals, by, "left").join(cited, by).join(members, by)
    none = F.array().cast("array<string>")
    rules = rules.withColumns({"scope_paths": F.coalesce("scope_paths", none), "scope_signals": F.coalesce("scope_signals", none)}).where("size(scope_paths) > 0 or size(scope_signals) > 0")
    if working_tree is None:
        rules = rules.withColumn("scope_missing", F.lit(False))
    else:
        rules = rules.join(scopes_alive(rules, working_tree, by).withColumn("alive", F.lit(True)), by, "left").withColumn("scope_missing", (F.size("scope_paths") > 0) & F.col("alive").isNull())
    statement, name = statement_of(F.col("rule_kind"), F.col("signal"), F.col("scope_paths")), rule_id(F.col("rule_kind"), F.col("signal"), F.col("cluster_key"))
    rules = rules.withColumn("status", rule_status(F.col("scope_missing"), F.col("contradictions")))
    return rules.select(
        name.alias("id"), F.col("rule_kind").alias("kind"), "status", statement.alias("statement"), "scope_paths", "scope_signals", "confidence", "confidence_label",
        "evidence_count", "contradictions", F.transform("members", lambda m: m["experience_id"]).alias("experiences"),
        F.transform("provenance", lambda p: F.struct(p["pr"].alias("pr"), p["outcome"].alias("outcome"), p["url"].alias("url"), p["experience_id"].alias("experience_id"))).alias("provenance"),
        review_label(F.col("status"), F.col("confidence")).alias("review_label"), F.lit("pending").alias("review_decision"), F.lit("cluster_summary").alias("statement_origin"),
        F.lit(False).alias("human_review"), "recency_weight", "extraction_confidence", "flake_discount", "cluster_key",
    )


def ancestors(path: Column) -> Column:
    """A path and all directories above it, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
