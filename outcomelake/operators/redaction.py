"""Redaction of JSON values at any depth: taken apart level by level, judged leaf by leaf, and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has_secret_like_segment, has_secret_like_token, is_secret_name, redact_tokens, trimmed, valid_provenance_url
from ..sources.storage import written

REDACTED = "[REDACTED:secret]"
#: Shapes of hashes, which are no secrets in the fields of these names.
DIGEST = r"[0-9a-fA-F]{6,128}|sha1:[0-9a-fA-F]{40}|sha256:[0-9a-fA-F]{64}|sha512:[0-9a-fA-F]{128}"
#: Fields of addresses: their path's segments count one by one.
ADDRESS_FIELDS = ("pr_url", "check_run_url", "revert_url", "review_url", "provenance_urls", "html_url", "details_url")
_EXACT = {"commit": "[0-9a-fA-F]{6,64}", "commits": "[0-9a-fA-F]{6,64}", "signature_id": "sig_[0-9a-fA-F]{6,64}|" + DIGEST, "digest": DIGEST, "checksum": DIGEST}


def looks_nested(text: Column) -> Column:
    """Whether a text is a JSON object or list."""
    return F.coalesce(trimmed(text).rlike(r"^[{\[]"), F.lit(False))


def _shape_of(names: Column) -> Column:
    """The pattern of values that are no secrets under these names, outermost first; null where there is none."""
    shapes = F.transform(names, lambda n: F.coalesce(*(F.when(n == k, F.lit(v)) for k, v in _EXACT.items()), F.when(n == "node_id", ".*"), F.when(n.contains("fingerprint"), DIGEST)))
    return F.try_element_at(F.filter(shapes, lambda x: x.isNotNull()), F.lit(1))


def is_unsafe_leaf(text: Column, names: Column) -> Column:
    """Whether a text, already without known tokens, holds a token that may be a secret of an unknown kind.

    ``names`` are the lower-case keys above it: hashes are no secrets under theirs, and canonical addresses
    under theirs are judged by their path's segments.
    """
    address = F.arrays_overlap(names, F.array(*map(F.lit, ADDRESS_FIELDS)))
    shape = _shape_of(names)
    safe = F.coalesce(F.rlike(text, F.concat(F.lit("^(?s)("), shape, F.lit(")$"))), F.lit(False))
    return F.when(address & has_secret_like_segment(trimmed(text)), True).when(address & valid_provenance_url(trimmed(text)), False).otherwise(has_secret_like_token(text) & ~safe)


def is_unsafe_key(key: Column) -> Column:
    """Whether an object's key holds a known token, or one that may be a secret."""
    return (redact_tokens(key) != key) | has_secret_like_token(key)


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "list").when(shape == "STRING", "text").otherwise("other")


def redacted_json(rows: DataFrame, id_col: str, text_col: str, names_col: str | None = None) -> DataFrame:
    """(id, json, unsafe, bad_paths) for JSON texts of any depth; ``id_col`` names a row and must not repeat.

    Values of secret names, whatever they are, become one marker; known tokens go from every text; ``bad_paths`` are
    the dotted paths of leaves and keys that may still hold a secret, in order, with list places as numbers and
    ``<key>`` for a key. ``names_col`` has the lower-case keys above the text. A text that is no JSON is ``unsafe`` and
    comes back without its contents.

    Objects and lists are taken apart one level a step and put together in the opposite order by their places, so
    any depth and size works; what is under a secret name is not looked at. ``json`` has its keys in order.
    """
    c = F.col
    start = rows.select(c(id_col).alias("id"), F.try_parse_json(c(text_col)).alias("value"), (c(names_col) if names_col else F.array().cast("array<string>")).alias("names"))
    level = start.select("id", F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("place"), F.lit(None).cast("string").alias("key"), "names", "value", F.lit(False).alias("secret"))
    levels: list[DataFrame] = []
    while True:
        kind = F.when(c("secret"), "secret").when(c("value").isNull(), "none").otherwise(_kind(c("value")))
        plain = redact_tokens(F.variant_get("value", "$", "string"))
        found = level.withColumn("kind", kind)
        found = found.withColumn("text", F.when(c("kind") == "secret", F.lit(f'"{REDACTED}"')).when(c("kind") == "text", plain).when(c("kind") == "other", F.to_json("value")))
        bad = F.array_compact(F.array(
            F.when((c("kind") == "text") & is_unsafe_leaf(c("text"), c("names")), F.array_join("path", ".")),
            F.when(c("key").isNotNull() & is_unsafe_key(c("key")), F.array_join(F.concat(F.slice("path", F.lit(1), F.size("path") - 1), F.array(F.lit("<key>"))), ".")),
        ))
        quoted = F.when(c("kind") == "text", F.to_json(F.to_variant_object(F.array("text")))).otherwise(c("text"))
        found = found.withColumn("bad", bad).withColumn("text", F.when(c("kind") == "text", F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(quoted))
        found = written(found, "json-level")
        levels.append(found)
        inner = found.where("kind in ('object', 'list')")
        if inner.isEmpty():
            break
        # Names of objects stand in order, places of lists are padded numbers.
        members = F.expr("transform(map_entries(try_cast(value AS MAP<STRING, VARIANT>)), e -> struct(e.key as place, e.key as key, e.value as value))")
        items = F.expr("transform(try_cast(value AS ARRAY<VARIANT>), (x, i) -> struct(lpad(cast(i as string), 10, '0') as place, cast(null as string) as key, x as value))")
        one = inner.select("id", "path", "place", "names", F.explode(F.when(c("kind") == "object", members).otherwise(items)).alias("one"))
        name = F.when(c("one.key").isNotNull(), c("one.key")).otherwise(F.regexp_replace("one.place", "^0+(?=.)", ""))
        level = one.select(
            "id", F.concat("path", F.array(name)).alias("path"), F.concat("place", F.array("one.place")).alias("place"), c("one.key").alias("key"),
            F.when(c("one.key").isNotNull(), F.concat("names", F.array(F.lower("one.key")))).otherwise(c("names")).alias("names"), c("one.value").alias("value"), F.coalesce(is_secret_name(c("one.key")), F.lit(False)).alias("secret"),
        )
    # From the innermost level outwards: the members of each value, in order, become its text.
    whole = levels[-1].select("id", "place", "key", "text", "bad")
    for found in reversed(levels[:-1]):
        own_key = F.to_json(F.to_variant_object(F.array("key")))
        member = F.when(c("key").isNotNull(), F.concat(F.substring(own_key, F.lit(2), F.length(own_key) - 2), F.lit(":"), c("text"))).otherwise(c("text"))
        above = whole.select("id", F.slice("place", F.lit(1), F.size("place") - 1).alias("place"), F.struct(F.element_at("place", -1).alias("at"), member.alias("text"), "bad").alias("member"))
        inside = above.groupBy("id", "place").agg(F.sort_array(F.collect_list("member")).alias("members"))
        both = found.select("id", "place", "key", "kind", "text", "bad").join(inside, ["id", "place"], "left")
        listed = F.array_join(F.transform(F.coalesce("members", F.array().cast("array<struct<at: string, text: string, bad: array<string>>>")), lambda m: m["text"]), ",")
        text = F.when(c("kind") == "object", F.concat(F.lit("{"), listed, F.lit("}"))).when(c("kind") == "list", F.concat(F.lit("["), listed, F.lit("]"))).otherwise(c("text"))
        inner_bad = F.flatten(F.transform(F.coalesce("members", F.array().cast("array<struct<at: string, text: string, bad: array<string>>>")), lambda m: m["bad"]))
        whole = written(both.select("id", "place", "key", text.alias("text"), F.concat("bad", inner_bad).alias("bad")), "json-whole")
    return whole.select("id", F.coalesce("text", F.lit(f'"{REDACTED}"')).alias("json"), F.col("text").isNull().alias("unsafe"), F.array_sort("bad").alias("bad_paths"))


def redacted_maps(rows: DataFrame, map_col: str) -> DataFrame:
    """``rows`` with the JSON objects and lists among a map's values redacted, and ``nested_unsafe``: some may hold a secret.

    Values under secret names are left to the caller, who replaces them whole. Only rows with such values are written
    and taken apart; without any, the rows come back as they are.
    """
    c = F.col
    values = F.filter(F.map_entries(map_col), lambda e: looks_nested(e["value"]) & ~is_secret_name(e["key"]))
    has = F.coalesce(F.size(values) > 0, F.lit(False))
    nested = rows.where(has)
    if nested.isEmpty():
        return rows.withColumn("nested_unsafe", F.lit(False))
    nested = written(nested.withColumn("nested_row", F.monotonically_increasing_id()), "json-rows")
    each = nested.select("nested_row", F.explode(values).alias("e"))
    each = written(each.select(F.concat_ws(":", c("nested_row").cast("string"), "e.key").alias("id"), "nested_row", c("e.key").alias("key"), c("e.value").alias("text"), F.array(F.lower("e.key")).alias("names")), "json-values")
    found = redacted_json(each, "id", "text", "names").join(each.select("id", "nested_row", "key"), "id")
    maps = found.groupBy("nested_row").agg(F.map_from_entries(F.collect_list(F.struct("key", "json"))).alias("fresh"), F.max(c("unsafe") | (F.size("bad_paths") > 0)).alias("nested_unsafe"))
    both = nested.join(maps, "nested_row").withColumn(map_col, F.transform_values(map_col, lambda k, v: F.coalesce(F.try_element_at("fresh", k), v)))
    return rows.where(~has).withColumn("nested_unsafe", F.lit(False)).unionByName(both.select(*rows.columns, "nested_unsafe"))
