"""Scans: outcome events, exports of pull requests, rules, and texts of changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import distinct_filled, filled, pr_path_number, pr_url_number, rfc3339, staged, trimmed, url_repo, valid_provenance_url
from ..schemas import EVENT, EXPERIENCE, RULE

_SIGNATURE = "signature_id: string, class: string, key: string, check_name: string, check: string, extraction_confidence: string, message_fingerprint: string"
#: What a check run, a revert, a correction and a pull request may all say. Fields that exports give as a text, a list
#: or an object are read as text.
_ITEM_TEXTS = (
    "name", "check_name", "status", "conclusion", "completed_at", "updated_at", "created_at", "merged_at",
    "committed_at", "recorded_at", "resolved_at", "head_sha", "commit", "commit_sha", "sha", "commit_id",
    "merge_commit_sha", "paths", "changed_files", "files", "path", "filename", "signature_class",
    "signature_key", "signature_id", "message", "summary", "title", "body", "html_url", "details_url", "url",
    "check_run_url", "commit_url", "revert_url", "review_url", "extraction_confidence", "flake_discount",
    "message_fingerprint", "actor_kind", "attribution_method", "attribution_confidence", "marked",
    "correction", "requires_correction", "is_correction", "source_kind", "memory_source",
)
_ITEM = (
    ", ".join(f"{n}: string" for n in _ITEM_TEXTS) + f", outcome: struct<flake_discount: string, signature: struct<{_SIGNATURE}>>, output: struct<summary: string>, "
    "attribution: struct<actor_kind: string, method: string, confidence: string>"
)
_PULL = (
    f"{_ITEM}, number: string, pr: string, action: struct<pr: string>, repo: string, head: struct<sha: string>, pr_url: string, author: string, user: string, actor: string, labels: string, label_names: string, "
    "coauthors: string, coauthor_trailers: string, revert_scan_truncated: string, metadata: struct<revert_scan_truncated: string>, "
    + ", ".join(f"{n}: array<struct<{_ITEM}>>" for n in ("check_runs", "checks", "reverts", "review_corrections", "marked_review_corrections"))
)
#: A nested export of pull requests with what happened to each.
EXPORT = f"repo string, repo_owner string, repo_name string, pull_requests array<struct<{_PULL}>>, prs array<struct<{_PULL}>>"


def events_jsonl(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Events as JSON lines, blank lines skipped; a line that is no such object fails the read."""
    return spark.read.json(path, schema=EVENT, mode=mode)


def events_document(spark: SparkSession, path: str) -> DataFrame:
    """Events of whole-file JSON documents: an object, an array, or an envelope with ``events``."""
    enveloped = spark.read.json(path, schema=f"events array<struct<{EVENT}>>, {EVENT}", multiLine=True, mode="FAILFAST")
    own = [c for c in enveloped.columns if c != "events"]
    single = enveloped.where("events is null").select(*own)
    return single.unionByName(enveloped.where("events is not null").select(F.inline("events")))


def experiences_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Stored experiences, partitioned by month; time filters skip months."""
    return spark.read.schema(f"{EXPERIENCE}, month string").parquet(path)


def rules_parquet(spark: SparkSession, path: str, active_only: bool = False) -> DataFrame:
    rules = spark.read.schema(RULE).parquet(path)
    return rules.where("status = 'active'") if active_only else rules


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=EXPORT, multiLine=True, mode="FAILFAST")


def _truthy(*flags: Column) -> Column:
    return F.coalesce(F.exists(F.array(*flags), lambda x: F.lower(trimmed(x)).isin("true", "yes", "required", "correction")), F.lit(False))


def is_failed_check(check: Column) -> Column:
    return F.lower(filled(check["conclusion"], check["status"])).isin("failure", "failed", "timed_out", "action_required")


def is_marked(correction: Column) -> Column:
    return _truthy(*(correction[n] for n in ("marked", "correction", "requires_correction", "is_correction")))


def _list(value: Column) -> Column:
    """What a field holds as a list: a JSON list's elements, or a text alone; none for numbers and objects."""
    value = trimmed(value)
    alone = F.when((value != "") & ~value.rlike(r"^([0-9.+-]+$|\{|\[\])"), F.array(value))
    return F.coalesce(F.when(value.startswith("["), F.from_json(value, "array<string>")), alone, F.array().cast("array<string>"))


def _is_list(field: Column) -> Column:
    return F.coalesce(trimmed(field).startswith("["), F.lit(False))


def _first_text(*fields: Column) -> Column:
    """What :func:`_first_list` finds where no field is a list: the first text that is no number and no object, or null."""
    return F.coalesce(*(F.when((f != "") & ~f.rlike(r"^([0-9.+-]+$|\{)"), f) for f in map(trimmed, fields)))


def _any_list(fields: Sequence[Column], lists: Column, text: Callable[[Column], Column]) -> Column:
    """``lists`` where some field is a list, else ``text`` of :func:`_first_text`: functions over lists are not compiled, so rows without lists keep off them."""
    return F.when(reduce(Column.__or__, map(_is_list, fields)), lists).otherwise(text(_first_text(*fields)))


def _first_list(*fields: Column) -> Column:
    """The texts of the first field that holds any. Every field is parsed once, by one expression for them all."""
    none = F.array().cast("array<string>")
    texts = F.transform(F.array(*fields), lambda f: F.filter(_list(f), lambda x: (trimmed(x) != "") & ~x.startswith("{")))
    lists = F.coalesce(F.try_element_at(F.filter(texts, lambda t: F.size(t) > 0), F.lit(1)), none)
    return _any_list(fields, lists, lambda t: F.when(t.isNotNull(), F.array(t)).otherwise(none))


def _names(field: Column, *keys: str) -> Column:
    """Of a list's objects the first of the keys that each fills."""
    own = F.transform(F.filter(_list(field), lambda x: x.startswith("{")), lambda x: filled(*(F.get_json_object(x, f"$.{k}") for k in keys)))
    return F.when(_is_list(field), F.filter(own, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def _paths(item: Column, fallback: Column) -> Column:
    fields = [item[n] for n in ("paths", "changed_files", "files", "path", "filename")]
    own = distinct_filled(F.concat(_first_list(*fields), _names(item["files"], "filename", "path")))
    return _any_list(fields, F.when(F.size(own) > 0, own).otherwise(fallback), lambda t: F.when(t.isNotNull(), F.array(t)).otherwise(fallback))


def _labels(labels: Column, names: Column) -> Column:
    none = F.array().cast("array<string>")
    return _any_list([labels, names], distinct_filled(F.concat(_first_list(labels, names), _names(labels, "name"))), lambda t: F.when(t.isNotNull(), F.array(t)).otherwise(none))


def _object_or_text(value: Column, key: str) -> tuple[Column, Column]:
    """(the key of an object, or nothing; the text that is no object, or nothing)."""
    is_object = value.startswith("{")
    return F.when(is_object, F.get_json_object(value, f"$.{key}")), F.when(~is_object, value)


def _repository(item: Column) -> Column:
    owner, text = _object_or_text(item["repo"], "owner")
    name, _ = _object_or_text(item["repo"], "name")
    return filled(F.when((trimmed(owner) != "") & (trimmed(name) != ""), F.concat(trimmed(owner), F.lit("/"), trimmed(name))), F.when(text.rlike(r"[^/\s]\s*/\s*[^/\s]"), text))


#: For each kind of outcome: fields of its time, commit, check name, message and address, and its signature's class.
_KINDS = {
    "ci_failure": (("completed_at", "updated_at", "created_at"), ("head_sha", "commit"), ("name",), ("message", "summary", "output.summary", "conclusion"), ("html_url", "details_url", "url", "check_run_url"), "test_failure"),
    "revert": (("merged_at", "committed_at", "recorded_at", "created_at"), (), (), ("message", "title"), ("html_url", "url", "commit_url", "revert_url"), "revert"),
    "review_correction": (("resolved_at", "updated_at", "created_at", "recorded_at"), ("commit_id", "commit", "head_sha"), (), ("message", "body", "title"), ("html_url", "url", "review_url"), "review_correction"),
    "merged_clean": (("merged_at", "updated_at", "created_at"), (), (), (), (), "unknown"),
}


def _event(kind: Column, item: Column) -> list[Column]:
    """The columns of an outcome of a kind that ``item`` tells, of rows with their pull request's columns."""

    def field(path: str) -> Column:
        out = item
        for key in path.split("."):
            out = out[key]
        return out

    def by_kind(value: Callable[[str], Column]) -> Column:
        return F.coalesce(*(F.when(kind == k, value(k)) for k in _KINDS))

    given = item["outcome"]["signature"]
    at = by_kind(lambda k: filled(*map(field, _KINDS[k][0]), item["updated_at"], item["created_at"]))
    commit = by_kind(lambda k: filled(*map(field, _KINDS[k][1]), F.col("base_commit")))
    check = by_kind(lambda k: filled(item["check_name"], given["check_name"], given["check"], *map(field, _KINDS[k][2]), F.lit("merge" if k == "merged_clean" else k)))
    message = by_kind(lambda k: filled(*map(field, _KINDS[k][3])) if _KINDS[k][3] else F.lit(""))
    own_class = by_kind(lambda k: filled(item["signature_class"], given["class"], F.lit(_KINDS[k][5])))
    # Chosen between lists, not by functions over lists, which are not compiled.
    none, own_url, url = F.array().cast("array<string>"), F.col("base_url"), F.col("x_url")
    taken = F.col("x_canonical") & F.col("x_matches")
    urls = F.when(own_url.isNull(), F.when(taken, F.array(url)).otherwise(none)).when(taken & (own_url != url), F.array(own_url, url)).otherwise(F.array(own_url))
    wrong = {"child_provenance": F.col("x_canonical") & ~F.col("x_matches"), "child_commit": commit == "", "child_paths": F.size("x_paths") == 0}
    errors = F.when(reduce(Column.__or__, wrong.values()), F.concat("base_errors", F.array_compact(F.array(*(F.when(bad, F.lit(n)) for n, bad in wrong.items()))))).otherwise(F.col("base_errors"))
    return [
        F.col("base_repo").alias("repo"), F.col("base_number").alias("pr"), kind.alias("outcome_kind"), at.alias("recorded_at"),
        commit.alias("commit"), F.col("x_paths").alias("paths"), F.col("base_labels").alias("labels"), F.col("base_coauthors").alias("coauthors"), F.col("base_actor").alias("actor"),
        check.alias("check_name"), own_class.alias("signature_class"),
        filled(item["signature_key"], given["key"], *(_object_or_text(item[n], "path")[1] for n in ("path", "filename")), F.try_element_at("x_paths", F.lit(1))).alias("signature_key"),
        filled(item["signature_id"], given["signature_id"]).alias("signature_id"), message.alias("message"),
        filled(item["message_fingerprint"], given["message_fingerprint"]).alias("message_fingerprint"), filled(item["extraction_confidence"], given["extraction_confidence"], F.lit("structured")).alias("extraction_confidence"),
        filled(item["flake_discount"], item["outcome"]["flake_discount"]).alias("flake_discount"), filled(item["actor_kind"], item["attribution"]["actor_kind"], F.col("base_actor_kind")).alias("actor_kind"),
        filled(item["attribution_method"], item["attribution"]["method"], F.col("base_method")).alias("attribution_method"), filled(item["attribution_confidence"], item["attribution"]["confidence"], F.col("base_confidence")).alias("attribution_confidence"),
        urls.alias("provenance_urls"), filled(item["source_kind"], F.col("base_source_kind")).alias("source_kind"), filled(item["memory_source"], F.col("base_memory_source")).alias("memory_source"),
        F.when(kind == "revert", filled(item["commit_sha"], item["sha"], item["commit"])).otherwise("").alias("source_commit"), errors.alias("export_errors"),
    ]


def _items(*lists: Column) -> Column:
    """The first list that has items; an empty one without."""
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists), F.array().cast(f"array<struct<{_ITEM}>>"))


def export_events(export: DataFrame) -> DataFrame:
    """Events of an export (:data:`EXPORT`), as :func:`outcomelake.operators.normalize.normalized` takes them.

    A failed check, a revert and a marked correction are one each; corrections in the list of marked ones
    need no mark. A pull request is a clean merge where it merged, reverts were looked for to the end, and
    none of the other three happened. What is missing in an outcome comes from its pull request, but a
    revert's own commit is its ``source_commit``. Addresses that are no canonical ones of the host are left
    out. ``export_errors`` names what breaks the provenance of an event: a number that is none, an address of the pull
    request that is not its own, an outcome's address of another repository or pull request (which never enters the
    event), an outcome without commit or paths.

    An export is parsed and its pull requests' fields are found once; all outcomes of a pull request, each with its
    kind, are exploded as one list. Nothing is gathered or sorted.
    """
    whole = F.struct(F.col("repo"))
    envelope = filled(_repository(whole), F.when((filled(F.col("repo_owner")) != "") & (filled(F.col("repo_name")) != ""), F.concat(trimmed(F.col("repo_owner")), F.lit("/"), trimmed(F.col("repo_name")))))
    pulls = export.select(envelope.alias("envelope_repo"), F.explode(F.coalesce(F.when(F.size("pull_requests") > 0, F.col("pull_requests")), F.col("prs"))).alias("p"))
    p = F.col("p")
    logins, texts = zip(*(_object_or_text(p[n], "login") for n in ("author", "user", "actor")), strict=True)
    item_kind = StructType.fromDDL(_ITEM)
    itself = F.struct(*(p[f.name].alias(f.name) for f in item_kind)).cast(item_kind)
    given_url = filled(p["html_url"], p["pr_url"], F.when(valid_provenance_url(trimmed(p["url"])), p["url"]))
    pulls = pulls.select(
        filled(_repository(p), F.col("envelope_repo")).alias("stated"), filled(F.coalesce(p["number"], p["pr"], p["action"]["pr"])).alias("base_number"), given_url.alias("given_url"),
        filled(p["head_sha"], p["head"]["sha"], p["commit"], p["merge_commit_sha"]).alias("base_commit"),
        _paths(p, F.array().cast("array<string>")).alias("base_paths"), _labels(p["labels"], p["label_names"]).alias("base_labels"),
        _first_list(p["coauthors"], p["coauthor_trailers"]).alias("base_coauthors"), filled(*logins, *texts).alias("base_actor"), filled(p["actor_kind"], p["attribution"]["actor_kind"]).alias("base_actor_kind"),
        filled(p["attribution_method"], p["attribution"]["method"]).alias("base_method"), filled(p["attribution_confidence"], p["attribution"]["confidence"]).alias("base_confidence"),
        filled(p["source_kind"]).alias("base_source_kind"), filled(p["memory_source"]).alias("base_memory_source"),
        F.filter(_items(p["check_runs"], p["checks"]), is_failed_check).alias("failed"), _items(p["reverts"]).alias("undone"),
        F.concat(F.filter(_items(p["review_corrections"]), is_marked), _items(p["marked_review_corrections"])).alias("corrected"),
        ((filled(p["merged_at"]) != "") & ~_truthy(p["revert_scan_truncated"], p["metadata"]["revert_scan_truncated"])).alias("landed"), itself.alias("itself"),
    )
    pulls = staged(pulls)
    url = F.when(F.col("given_url") != "", F.col("given_url")).when((F.col("stated") != "") & (F.col("base_number") != ""), F.concat(F.lit("https://github.com/"), F.col("stated"), F.lit("/pull/"), F.col("base_number")))
    # The pull request itself tells of its clean merge.
    is_clean = F.col("landed") & (F.size("failed") + F.size("undone") + F.size("corrected") == 0)
    told = lambda name, kind: F.transform(name, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast(item_kind).alias("item")))
    clean = F.when(is_clean, F.array(F.struct(F.lit("merged_clean").alias("kind"), F.col("itself").alias("item")))).otherwise(F.array().cast(f"array<struct<kind: string, item: struct<{_ITEM}>>>"))
    outcomes = F.concat(told("failed", "ci_failure"), told("undone", "revert"), told("corrected", "review_correction"), clean)
    pulls = pulls.withColumn("base_url", url).withColumn("url_repo", url_repo(F.col("base_url")))
    base = [c for c in pulls.columns if c.startswith("base_")]
    pulls = staged(pulls.select(*base, "stated", "url_repo", outcomes.alias("outcomes")))
    repo, number = filled(F.col("stated"), F.col("url_repo")), F.col("base_number").try_cast("long")
    own = F.coalesce((F.col("url_repo") == F.lower(repo)) & (pr_url_number(F.col("base_url")) == number), F.lit(False))
    errors = F.array_compact(F.array(F.when(~F.coalesce(number >= 1, F.lit(False)), "pull_number"), F.when(~own, "pull_provenance")))
    # Staged before outcomes are exploded, or what a pull request says would be found again for each.
    pulls = staged(pulls.select(*base, repo.alias("base_repo"), errors.alias("base_errors"), "outcomes"))
    rows = pulls.select(*base, "base_repo", "base_errors", F.explode("outcomes").alias("x")).select(*base, "base_repo", "base_errors", "x.kind", "x.item")
    item = F.col("item")
    address = F.coalesce(*(F.when(F.col("kind") == k, filled(*(item[n] for n in v[4])) if v[4] else F.lit("")) for k, v in _KINDS.items()))
    matches = (url_repo(address) == F.lower("base_repo")) & F.coalesce(pr_path_number(address) == F.col("base_number").try_cast("long"), F.lit(True))
    rows = staged(rows.withColumns({"x_url": address, "x_paths": _paths(item, F.col("base_paths")), "x_canonical": valid_provenance_url(address), "x_matches": F.coalesce(matches, F.lit(False))}))
    return rows.select(*_event(F.col("kind"), item))


def coauthors(message: Column) -> Column:
    """Names in the co-author trailers of a commit message, distinct, in order."""
    lines = F.filter(F.split(message, r"\r?\n"), lambda x: x.rlike(r"(?i)^\s*co-authored-by\s*:"))
    return F.array_distinct(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"(?i)^\s*co-authored-by\s*:\s*([^<]*)", 1))))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """A stored rate, at the top or under ``summary``, between 0 and 1; one row with nulls for anything else."""
    raw = spark.read.json(path, schema="headline_err string, source_digest string, summary struct<headline_err: string>", multiLine=True, mode="PERMISSIVE")
    value = F.coalesce(F.col("headline_err").try_cast("double"), F.col("summary.headline_err").try_cast("double"))
    return raw.select(F.when(value.between(0, 1), value).alias("baseline_err"), "source_digest")


def forward_baseline(spark: SparkSession, path: str) -> DataFrame:
    """One row (status, baseline_err, reason) for advice ahead of a report: a stored baseline can't be verified there, so it is stale, or missing.

    ``reason`` says what a later comparison would lack: digest, window, or only the comparison itself. A baseline that
    gives no rate from 0 to 1 has the status broken.
    """
    kinds = "headline_err string, summary struct<headline_err: string>, metadata struct<source_artifact_digest: string>, window struct<start: string, end: string>"
    c = F.col
    raw = spark.read.json(path, schema=kinds, multiLine=True, mode="PERMISSIVE") if _exists(spark, path) else spark.createDataFrame([], kinds)
    value = F.coalesce(c("headline_err").try_cast("double"), c("summary.headline_err").try_cast("double"))
    reason = F.when(filled(c("metadata.source_artifact_digest")) == "", "no_digest").when((filled(c("window.start")) == "") | (filled(c("window.end")) == ""), "no_window").otherwise("unverified")
    sound = F.coalesce(value.between(0, 1), F.lit(False))
    found = raw.limit(1).select(F.when(sound, "stale").otherwise("broken").alias("status"), F.when(sound, value).alias("baseline_err"), F.when(sound, reason).otherwise("no_rate").alias("reason"))
    one = spark.range(1).select(F.lit(1).alias("one"))
    both = one.join(found.withColumn("one", F.lit(1)), "one", "left")
    return both.select(F.coalesce("status", F.lit("missing")).alias("status"), "baseline_err", F.coalesce("reason", F.lit("not_saved")).alias("reason"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def advisory_states(spark: SparkSession, path: str) -> DataFrame:
    """(change_id, diff_fingerprint, risk_level, skip_reason, generated_at): stored states of changes, as JSON lines of :func:`~.sinks.state_text`."""
    kinds = "change_id long, diff_fingerprint string, skip_reason string, assessment struct<risk_level: string>, metadata struct<generated_at: string, risk_level: string>"
    raw = spark.read.json(path, schema=kinds, mode="FAILFAST")
    risk = filled(F.col("metadata.risk_level"), F.col("assessment.risk_level"))
    return raw.select("change_id", "diff_fingerprint", risk.alias("risk_level"), "skip_reason", rfc3339(F.col("metadata.generated_at")).alias("generated_at"))


def compare_baseline(report: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The report with the baseline's rate and the change since; status is missing, stale (of other sources) or current."""
    if stored is None or stored.isEmpty():
        return report.withColumns({"baseline_status": F.lit("missing"), "baseline_err": F.lit(None).cast("double"), "err_delta": F.lit(None).cast("double")})
    own = stored.limit(1).withColumnRenamed("source_digest", "baseline_digest")
    status = F.when(F.col("baseline_err").isNull(), "missing").when(F.col("baseline_digest").eqNullSafe(F.col("source_digest")), "current").otherwise("stale")
    return report.join(own).withColumn("baseline_status", status).withColumn("err_delta", F.round(F.col("headline_err") - F.col("baseline_err"), 4)).drop("baseline_digest")


def models_on_disk(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Manifest rows (path, sha256) with whether a file of just that digest is there."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("found"))
    return manifest.join(files, "path", "left").withColumn("verified", F.coalesce(F.col("found") == F.lower("sha256"), F.lit(False))).drop("found")

