"""Touched paths of many changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.changes import PATH_KEYS, PROSE_KEYS, diff_heads, head_paths, is_ignored, listed_paths, prose_paths
from .storage import written


def _plan_texts(plans: DataFrame) -> list[DataFrame]:
    """(change_id, form, text) of structured plans (change_id, value), level by level: strings under path and prose keys."""
    c = F.col
    level = plans.select("change_id", F.lit("").alias("key"), "value")
    found: list[DataFrame] = []
    while True:
        shape = F.schema_of_variant("value")
        kind = F.when(c("value").isNull(), "none").when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "list").when(shape == "STRING", "text").otherwise("other")
        level = written(level.withColumn("kind", kind), "plan-level")
        form = F.when(c("key").isin(*sorted(PATH_KEYS)), "path").when(c("key").isin(*sorted(PROSE_KEYS)), "prose")
        found.append(level.where("kind = 'text'").select("change_id", form.alias("form"), F.variant_get("value", "$", "string").alias("text")).where("form is not null"))
        inner = level.where("kind in ('object', 'list')")
        if inner.isEmpty():
            return found
        members = F.expr("transform(map_entries(try_cast(value AS MAP<STRING, VARIANT>)), e -> struct(lower(e.key) as key, e.value as value))")
        items = F.expr("transform(try_cast(value AS ARRAY<VARIANT>), x -> struct(key, x as value))")
        level = inner.select("change_id", F.explode(F.when(c("kind") == "object", members).otherwise(items)).alias("one")).select("change_id", "one.key", "one.value").where(~is_ignored(c("key")))


def touched_paths(changes: DataFrame, *, id_col: str = "change_id", text_col: str = "content") -> DataFrame:
    """(change_id, input_kind, path): a row for each path that a diff or plan touches; none without paths.

    A text is tried as a unified diff, then as a plan in JSON, then as one in prose. Diffs and prose are read by
    expressions within their row; plans in JSON are taken apart level by level, without what stands under keys that
    name nothing to touch. A null text touches nothing, and rows of one id and kind count together.
    """
    rows = changes.select(F.col(id_col).alias("change_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    read = rows.select("change_id", "content", diff_heads(F.col("content")).alias("diff"))
    is_diff = F.col("diff.is_diff")
    parsed = F.when(~is_diff & F.col("content").rlike(r"^\s*[{\[]"), F.try_parse_json("content"))
    read = written(read.select("change_id", is_diff.alias("is_diff"), F.when(is_diff, F.col("diff.heads")).alias("heads"), F.when(~is_diff, F.col("content")).alias("content"), parsed.alias("value")), "changes")
    named = head_paths(read.where("is_diff").select("change_id", F.explode("heads").alias("line")))
    paths = [named.select("change_id", F.lit("diff").alias("input_kind"), "path")]
    prose = read.where("not is_diff and value is null").select("change_id", F.lit("prose").alias("form"), F.col("content").alias("text"))
    plans = read.where("value is not null").select("change_id", "value")
    texts = reduce(DataFrame.unionByName, [prose, *(_plan_texts(plans) if not plans.isEmpty() else [])])
    own = F.when(F.col("form") == "path", listed_paths(F.col("text"))).otherwise(prose_paths(F.col("text")))
    paths.append(texts.select("change_id", F.lit("plan").alias("input_kind"), F.explode(own).alias("path")))
    return paths[0].unionByName(paths[1]).distinct()
