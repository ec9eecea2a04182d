"""Normalising raw outcome events into experiences, with every broken rule named."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..functions.columns import (
    ACTOR_KINDS, ATTRIBUTION_METHODS, CLASS_BY_KIND, EXTRACTION_SCORES, OUTCOME_KINDS, TERMINAL_BY_KIND, TERMINAL_STATES,
    clean_path, filled, first_filled, has_secret_like_segment, has_secret_like_token, is_secret_name, is_self_report, joined, lookup, number, pr_path_number, redact_tokens, rfc3339, rfc3339_text, sha256, short_hash, staged, trimmed, url_repo, valid_provenance_url,
)
from ..schemas import EVENT, EXPERIENCE
from .redaction import DIGEST, is_unsafe_key, looks_nested, redacted_maps

NUL = "\u0000"
URL_FIELDS = ("pr_url", "check_run_url", "revert_url", "review_url", "provenance_urls", "urls")
#: Shapes of hashes, which are no secrets in the fields of these names.
HASH_FIELDS = {"commit": "[0-9a-fA-F]{6,64}", "commits": "[0-9a-fA-F]{6,64}", "diff_fingerprint": DIGEST, "message_fingerprint": DIGEST, "signature_id": "sig_[0-9a-fA-F]{6,64}|" + DIGEST}


@dataclass(frozen=True)
class AttributionPolicy:
    """Whom labels, co-author trailers and logins point to; what becomes of uncertain rows."""

    labels: tuple[str, ...] = ()
    coauthors: tuple[str, ...] = ()
    logins: tuple[str, ...] = ()
    include_uncertain: bool = False


class InvalidEvents(ValueError):
    """Some event breaks the contract, so none is taken."""


def _any_of(values: Column, wanted: tuple[str, ...]) -> Column:
    own = F.transform(F.coalesce(values, F.array().cast("array<string>")), F.lower)
    return F.arrays_overlap(own, F.array(*(F.lit(w.strip().lower()) for w in wanted))) if wanted else F.lit(False)


def attribution(labels: Column, coauthors: Column, login: Column, stated: Column, policy: AttributionPolicy) -> tuple[Column, Column]:
    """(actor kind, method): the kind as stated, else by label, co-author or login, else uncertain; the method found."""
    by_login = F.coalesce(F.lower(trimmed(login)).isin(*(x.strip().lower() for x in policy.logins)), F.lit(False)) if policy.logins else F.lit(False)
    method = F.when(_any_of(labels, policy.labels), "pr_label").when(_any_of(coauthors, policy.coauthors), "coauthor_trailer").when(by_login, "bot_login").otherwise("uncertain")
    return F.when(stated != "", stated).when(method == "uncertain", "uncertain").otherwise("agent"), method


def experience_id(pr: Column, recorded_at: Column, urls: Column, *parts: Column) -> Column:
    """An id from what happened: pull request, time, outcome, signature and the sorted URLs; null without time or number."""
    identity = joined(NUL, pr, parts[0], rfc3339_text(recorded_at), *parts[1:])
    whole = F.concat(identity, F.when(F.size(urls) > 0, F.concat(F.lit(NUL), F.array_join(F.array_sort(urls), NUL))).otherwise(""))
    made = F.concat(F.lit("exp_"), F.when(F.length(pr.cast("string")) < 4, F.lpad(pr.cast("string"), 4, "0")).otherwise(pr.cast("string")), F.lit("_"), short_hash(whole))
    return F.when(recorded_at.isNotNull() & pr.isNotNull(), made)


def _redacted(value: Column, kind: DataType) -> Column:
    """A field with the known tokens of all its texts replaced, its texts trimmed, and the values of a map's secret names replaced."""
    if isinstance(kind, StringType):
        return trimmed(redact_tokens(value))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _redacted(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(_redacted(value[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, v: F.when(is_secret_name(k), F.lit("[REDACTED:secret]")).otherwise(redact_tokens(v)))
    return value


def _unsafe(value: Column, kind: DataType, name: str) -> list[Column]:
    """Conditions under which a field's trimmed texts hold a token that may be a secret of an unknown kind, or a key any token."""
    if isinstance(kind, ArrayType):
        return [F.exists(value, lambda x: F.greatest(*_unsafe(x, kind.elementType, name), F.lit(False)))]
    if isinstance(kind, StructType):
        return [c for f in kind for c in _unsafe(value[f.name], f.dataType, f.name)]
    if isinstance(kind, MapType):
        safe = lambda k, v: F.lower(k).contains("fingerprint") | F.lower(k).isin("digest", "checksum", "node_id") & trimmed(v).rlike(f"^({DIGEST})$")
        # Objects and lists among the values have been judged leaf by leaf.
        values = F.exists(F.map_entries(value), lambda e: ~looks_nested(e["value"]) & has_secret_like_token(e["value"]) & ~safe(e["key"], e["value"]))
        return [values, F.exists(F.map_keys(value), is_unsafe_key)]
    if not isinstance(kind, StringType):
        return []
    if name in URL_FIELDS:
        return [has_secret_like_segment(value)]
    if name in HASH_FIELDS:
        return [has_secret_like_token(value) & ~value.rlike(f"^({HASH_FIELDS[name]})$")]
    return [has_secret_like_token(value)]


def _some(*lists: Column) -> Column:
    """The first list of trimmed texts that holds one that is not empty, without empty ones and repeats; an empty one without."""
    if not lists:
        return F.array().cast("array<string>")
    own = F.filter(F.array(*(F.array_distinct(F.filter(x, lambda t: t != "")) for x in lists)), lambda x: F.size(x) > 0)
    return F.coalesce(F.try_element_at(own, F.lit(1)), F.array().cast("array<string>"))


def normalized(events: DataFrame, policy: AttributionPolicy = AttributionPolicy(), *, ref: Column | None = None) -> DataFrame:
    """Experiences with a column ``errors``; the schema of ``events`` is :data:`outcomelake.schemas.EVENT`.

    Every field is the first spelling that is not blank, flat or nested; columns of the schema that
    ``events`` lacks are null. Known tokens are redacted in every text field, and so are the values of secret
    names in ``metadata``, at any depth of its objects and lists; a token that may be a secret of an unknown kind
    breaks the rule ``redaction``, except for hashes in their fields and canonical URLs, of which each segment is
    looked at by itself. Errors of an export (its column ``export_errors``) come before the others. Rows of
    uncertain attribution leave the result unless the policy includes them.

    Fields are found, then what follows from them, each in a stage of its own, so that no expression is
    evaluated twice.
    """
    c = F.col
    kinds = {f.name: f.dataType for f in StructType.fromDDL(EVENT)}
    given = {f.name: f.dataType for f in events.schema if f.name in kinds}
    source = ref if ref is not None else F.lit("event")
    from_export = F.coalesce(c("export_errors"), F.array().cast("array<string>")) if "export_errors" in events.columns else F.array().cast("array<string>")
    events = events.select(*given, source.alias("source_ref"), from_export.alias("export_errors"))
    events = redacted_maps(events, "metadata") if isinstance(given.get("metadata"), MapType) else events.withColumn("nested_unsafe", F.lit(False))
    # Texts of actor and author are logins or JSON objects as they stand.
    rows = staged(events.select(*((redact_tokens(c(n)) if n in ("actor", "author") else _redacted(c(n), k)).alias(n) for n, k in given.items()), "source_ref", "export_errors", "nested_unsafe"))
    # Fields that aren't given are left out of what is computed, instead of being read as nulls row by row.
    own = lambda *names: [c(n) for n in names if n.partition(".")[0] in given]
    unsafe = F.greatest(F.lit(False), c("nested_unsafe"), *(F.coalesce(x, F.lit(False)) for n, k in given.items() for x in _unsafe(c(n), k, n)))
    repo, kind = first_filled(*own("repo")), first_filled(*own("outcome_kind", "outcome.kind"))
    half = lambda i, k: first_filled(trimmed(F.when(repo.startswith("{"), F.get_json_object(repo, f"$.{k}")).otherwise(F.split_part(repo, F.lit("/"), F.lit(i)))), *own(f"repo_{k}"))
    stated = first_filled(*own("actor_kind", "attribution.actor_kind"))
    login = filled(*(F.when(x.startswith("{"), F.get_json_object(x, "$.login")) for x in own("actor", "author")), *own("actor", "author"))
    none = F.array().cast("array<string>")
    address = ("pr_url", "check_run_url", "revert_url", "review_url")
    single = F.array_compact(F.array(*(F.nullif(first_filled(*own(n, f"provenance.{n}")), F.lit("")) for n in address)))
    discount_text = first_filled(*own("flake_discount"))
    metadata = c("metadata") if "metadata" in given else F.lit(None).cast(kinds["metadata"])
    reported = [*own("source_kind", "memory_source"), *(x["source_kind"] for x in own("metadata")), *(x["memory_source"] for x in own("metadata"))]
    pr_number = number(first_filled(*own("pr", "action.pr")))
    rows = rows.select(
        "source_ref", "export_errors", metadata.alias("metadata"), first_filled(*own("experience_id")).alias("experience_id"), half(1, "owner").alias("repo_owner"), half(2, "name").alias("repo_name"),
        F.date_trunc("second", rfc3339(first_filled(*own("recorded_at")))).alias("recorded_at"), F.when(pr_number == F.floor(pr_number), pr_number.cast("long")).alias("pr"),
        first_filled(*own("commit", "action.commit"), F.try_element_at(_some(*own("commits", "action.commits")), F.lit(1))).alias("commit"), _some(*own("paths", "context.paths")).alias("paths"),
        kind.alias("kind"), first_filled(*own("terminal_state", "terminal", "outcome.terminal_state", "outcome.terminal")).alias("terminal_state"),
        *(x.alias(n) for x, n in zip(attribution(_some(*own("labels", "pr_labels")), _some(*own("coauthors", "coauthor_trailers")), login, stated, policy), ("actor_kind", "found"), strict=True)),
        first_filled(*own("attribution_method", "attribution.method")).alias("method"), stated.alias("stated"), number(first_filled(*own("attribution_confidence", "attribution.confidence"))).alias("certainty"),
        first_filled(*own("signature_class", "outcome.signature.class")).alias("class"), first_filled(*own("check_name", "outcome.signature.check", "outcome.signature.check_name")).alias("check_name"),
        first_filled(*own("signature_key", "outcome.signature.key")).alias("key"), first_filled(*own("extraction_confidence", "outcome.signature.extraction_confidence"), F.lit("structured")).alias("extraction"),
        first_filled(*own("message_fingerprint", "outcome.signature.message_fingerprint")).alias("fingerprint"), first_filled(*own("message", "log", "outcome.message")).alias("text"),
        first_filled(*own("signature_id", "outcome.signature.signature_id")).alias("signature_id"), F.array_distinct(F.concat(_some(*own("provenance_urls", "provenance.urls")), F.coalesce(single, none))).alias("urls"),
        first_filled(*own("diff_fingerprint", "context.diff_fingerprint")).alias("diff"), F.when(discount_text == "", 0.0).otherwise(number(discount_text)).alias("flake_discount"),
        rfc3339(metadata["last_ingest_at"]).alias("last_ingest_at"), F.coalesce(metadata["merged_prs_since_last_ingest"], metadata["merged_since_ingest"]).try_cast("long").alias("merged_since_ingest"),
        (F.exists(F.array(*reported), is_self_report) if reported else F.lit(False)).alias("self_reported"), unsafe.alias("unsafe"),
    )
    if not policy.include_uncertain:
        rows = rows.where("actor_kind <> 'uncertain'")
    rows = staged(rows)
    rows = rows.withColumns({
        "terminal_state": first_filled(c("terminal_state"), lookup(c("kind"), TERMINAL_BY_KIND)), "class": first_filled(c("class"), lookup(c("kind"), CLASS_BY_KIND, "unknown")), "check_name": first_filled(c("check_name"), c("kind")),
        "key": first_filled(c("key"), F.try_element_at("paths", F.lit(1)), c("commit")), "message": first_filled(c("fingerprint"), F.when(c("text") != "", sha256(c("text")))),
        "attribution_method": F.when(c("stated") == "", c("found")).otherwise(first_filled(c("method"), F.when(c("actor_kind") == "human", "manual").otherwise("uncertain"))),
        "diff_fingerprint": first_filled(c("diff"), sha256(F.concat(c("pr").cast("string"), F.lit("|"), c("commit"), F.lit("|"), F.array_join("paths", "|")))),
    })
    rows = staged(rows.drop("fingerprint", "text", "found", "method", "stated", "diff"))
    default = F.when(c("attribution_method") == "manual", 1.0).when(c("attribution_method").isin("pr_label", "coauthor_trailer", "bot_login"), 0.9).otherwise(0.0)
    rows = rows.withColumns({
        "signature_id": first_filled(c("signature_id"), F.concat(F.lit("sig_"), short_hash(joined("|", c("class"), c("check_name"), c("key"))))), "attribution_confidence": F.when(c("certainty") >= 0, c("certainty")).otherwise(default),
    })
    rows = staged(rows.drop("certainty"))
    made = experience_id(c("pr"), c("recorded_at"), c("urls"), c("commit"), c("kind"), c("terminal_state"), c("signature_id"), c("extraction"), c("class"), c("check_name"), c("key"), c("message"))
    rows = rows.withColumns({"experience_id": first_filled(c("experience_id"), made), "errors": F.concat("export_errors", record_errors())})
    return rows.select(*(f.name for f in StructType.fromDDL(EXPERIENCE)), "errors")


def record_errors() -> Column:
    """Names of the rules that a record breaks; an empty list for a sound one."""
    c = F.col
    rules = {
        "self_report": c("self_reported"),
        "redaction": c("unsafe"),
        "repo": (c("repo_owner") == "") | (c("repo_name") == ""),
        "recorded_at": c("recorded_at").isNull(),
        "pr": c("pr").isNull() | (c("pr") < 1),
        "commit": c("commit") == "",
        "outcome_kind": ~c("kind").isin(*OUTCOME_KINDS),
        "terminal_state": ~c("terminal_state").isin(*TERMINAL_STATES),
        "extraction": ~c("extraction").isin(*EXTRACTION_SCORES),
        "actor_kind": ~c("actor_kind").isin(*ACTOR_KINDS),
        "attribution_method": ~c("attribution_method").isin(*ATTRIBUTION_METHODS),
        "attribution_confidence": ~c("attribution_confidence").between(0, 1),
        "paths": (F.size("paths") == 0) | F.exists("paths", lambda p: clean_path(p).isNull()),
        "flake_discount": c("flake_discount").isNull() | ~c("flake_discount").between(0, 1),
        "provenance": (F.size("urls") == 0) | F.exists("urls", lambda u: ~valid_provenance_url(u)),
        "provenance_repo": F.exists("urls", lambda u: url_repo(u) != F.lower(F.concat(c("repo_owner"), F.lit("/"), c("repo_name")))),
        "provenance_pr": F.exists("urls", lambda u: F.coalesce(pr_path_number(u) != c("pr"), F.lit(False))),
    }
    # Not a filter over an array of them all: what stands below such a function is not compiled.
    names = F.concat_ws(",", *(F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()))
    return F.when(names == "", F.array().cast("array<string>")).otherwise(F.split(names, ","))


def accepted(checked: DataFrame, mode: str = "fail") -> DataFrame:
    """Experiences without ``errors``: with ``fail`` one broken row refuses them all, with ``quarantine`` it is left out."""
    if mode == "fail":
        broken = checked.where(F.size("errors") > 0).select("source_ref", "errors").limit(5).collect()
        if broken:
            raise InvalidEvents("; ".join(f"{r.source_ref}: {', '.join(r.errors)}" for r in broken))
        return checked.drop("errors")
    return checked.where(F.size("errors") == 0).drop("errors")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0)


def ingest_counters(experiences: DataFrame) -> DataFrame:
    return experiences.agg(F.count("*").alias("records"), F.count_if(F.col("actor_kind") == "agent").alias("agent"), F.count_if(F.col("actor_kind") == "human").alias("human"), F.count_if(F.col("actor_kind") == "uncertain").alias("uncertain"))


def attribution_precision(cases: DataFrame) -> DataFrame:
    """Of labelled cases that are not uncertain, the part attributed rightly."""
    sure = F.col("expected") != "uncertain"
    return cases.agg(F.count("*").alias("cases"), F.count_if(sure).alias("evaluated"), F.round(F.try_divide(F.count_if(sure & (F.col("expected") == F.col("actual"))).cast("double"), F.count_if(sure).cast("double")), 4).alias("precision"))
