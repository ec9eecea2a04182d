"""Projections of the star-schema and stream tables onto the domain, for queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import lookup

KIND_BY_TYPE = {"error": "ci_failure", "click": "review_correction", "signup": "revert", "purchase": "fix_held", "view": "merged_clean"}
EXTRACTIONS = ("structured", "log_parsed_high", "log_parsed_low", "unknown")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as there are cores, where a small table's few files would leave most idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text(*parts: object) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiences made of ``events``."""
    user, k, event = F.col("user_id"), F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    pr = F.floor(event / 3).cast("long") + 1
    return spread(table(spark, sf_dir, "events")).select(
        text("exp_", F.lpad(event.cast("string"), 8, "0")).alias("experience_id"), F.lit("acme").alias("repo_owner"), F.lit("shop").alias("repo_name"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("recorded_at"), pr.alias("pr"), F.substring(F.sha2(event.cast("string"), 256), 1, 8).alias("commit"),
        F.array(text("src/m", F.pmod(F.bround("value").cast("long"), F.lit(25)), ".py"), text("tests/test_", k % 9, ".py")).alias("paths"),
        F.when(user % 10 == 0, "uncertain").when(user % 10 <= 2, "human").otherwise("agent").alias("actor_kind"), lookup(F.col("event_type"), KIND_BY_TYPE).alias("kind"),
        F.when(F.rint(k % 6) == 0, text("sig_generated_", event)).otherwise(text("sig_", user, "_", k % 3)).alias("signature_id"),
        F.when(k % 11 == 0, "").otherwise(F.col("event_type")).alias("class"), text("chk", k % 4).alias("check_name"), text("u", user, ":", k % 3).alias("key"),
        F.when(k % 5 == 0, text("m", user % 40, ":", k)).otherwise("").alias("message"), F.element_at(F.array(*map(F.lit, EXTRACTIONS)), (k % 4 + 1).cast("int")).alias("extraction"),
        F.when(k % 17 == 0, 1.0).otherwise(0.0).alias("flake_discount"), F.array(text("https://github.com/acme/shop/pull/", pr)).alias("urls"), text("events:", event).alias("source_ref"),
        F.when(user % 7 == 0, F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("last_ingest_at"), F.when(user % 7 == 0, k).alias("merged_since_ingest"),
    )


EXPERIENCES = """exp AS (
  SELECT 'exp_' || lpad(event_id::VARCHAR, 8, '0') AS experience_id, date_trunc('second', ts) AS recorded_at, event_id // 3 + 1 AS pr,
    ['src/m' || (round_even(value, 0)::BIGINT % 25) || '.py', 'tests/test_' || (k % 9) || '.py'] AS paths,
    CASE WHEN user_id % 10 = 0 THEN 'uncertain' WHEN user_id % 10 <= 2 THEN 'human' ELSE 'agent' END AS actor_kind,
    CASE event_type WHEN 'error' THEN 'ci_failure' WHEN 'click' THEN 'review_correction' WHEN 'signup' THEN 'revert' WHEN 'purchase' THEN 'fix_held' ELSE 'merged_clean' END AS kind,
    CASE WHEN k % 6 = 0 THEN 'sig_generated_' || event_id ELSE 'sig_' || user_id || '_' || (k % 3) END AS signature_id,
    CASE WHEN k % 11 = 0 THEN '' ELSE event_type END AS class, 'chk' || (k % 4) AS check_name, 'u' || user_id || ':' || (k % 3) AS key,
    CASE WHEN k % 5 = 0 THEN 'm' || (user_id % 40) || ':' || k ELSE '' END AS message,
    (['structured', 'log_parsed_high', 'log_parsed_low', 'unknown'])[k % 4 + 1] AS extraction,
    CASE WHEN k % 17 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flake_discount, 'https://github.com/acme/shop/pull/' || (event_id // 3 + 1) AS url, 'events:' || event_id AS source_ref,
    CASE WHEN user_id % 7 = 0 THEN date_trunc('day', ts) END AS last_ingest_at, CASE WHEN user_id % 7 = 0 THEN k END AS merged_since_ingest
  FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events))"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` over all tasks: its file is so small that one task would read it, and do all that is made of its rows."""
    return spread(table(spark, sf_dir, "part"))


def part_path() -> Column:
    return text("src/", F.lower(F.regexp_replace("p_brand", "#", "_")), "/", F.lower(F.regexp_replace("p_type", " ", "_")), "/p", F.col("p_partkey"), ".py")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule made of every row of ``part``: files, directories, globs and subtrees. Their paths lie in one folder each."""
    key, folder = F.col("p_partkey"), text("src/", F.lower(F.regexp_replace("p_brand", "#", "_")), "/", F.lower(F.regexp_replace("p_type", " ", "_")))
    scope = F.when(key % 4 == 0, part_path()).when(key % 4 == 1, folder).when(key % 4 == 2, text(folder, "/*1.py")).otherwise(text(folder, "/**"))
    kind = F.when(F.col("p_size") % 3 == 0, "playbook").otherwise("avoid")
    url = text("https://github.com/acme/shop/pull/", key)
    return parts(spark, sf_dir).select(
        text("rule_", key).alias("id"), kind.alias("kind"), F.element_at(F.array(*map(F.lit, ("candidate", "active", "active", "stale", "retired"))), (key % 5 + 1).cast("int")).alias("status"), text("statement ", key).alias("statement"),
        F.array(scope).alias("scope_paths"), F.round((key % 101) / 100.0, 2).alias("confidence"), F.col("p_size").cast("long").alias("evidence_count"), F.array(text("exp_", key)).alias("experiences"),
        F.array(F.struct(key.alias("pr"), F.when(kind == "playbook", "fix_held").otherwise("ci_failure").alias("outcome"), url.alias("url"), text("exp_", key).alias("experience_id"))).alias("provenance"),
        F.when(key % 5 == 1, "accepted").otherwise("suggested").alias("review_label"), F.when(key % 5 == 1, "approved").otherwise("pending").alias("review_decision"), F.lit("cluster_summary").alias("statement_origin"), (key % 2 == 0).alias("human_review"),
    )


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all parts that were returned."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return parts(spark, sf_dir).join(returned, "p_partkey", "left_semi").select(part_path().alias("path"))


RULES = """parts AS (SELECT *, 'src/' || lower(replace(p_brand, '#', '_')) || '/' || lower(replace(p_type, ' ', '_')) AS folder FROM part),
files AS (SELECT *, folder || '/p' || p_partkey || '.py' AS path FROM parts),
rules AS (SELECT 'rule_' || p_partkey AS id, p_partkey, CASE WHEN p_size % 3 = 0 THEN 'playbook' ELSE 'avoid' END AS kind, (['candidate', 'active', 'active', 'stale', 'retired'])[p_partkey % 5 + 1] AS status,
    CASE p_partkey % 4 WHEN 0 THEN path WHEN 1 THEN folder WHEN 2 THEN folder || '/*1.py' ELSE folder || '/**' END AS scope, folder, p_partkey % 4 AS form,
    round((p_partkey % 101) / 100.0, 2)::DOUBLE AS confidence, p_size::BIGINT AS evidence_count, CASE WHEN p_partkey % 5 = 1 THEN 'accepted' ELSE 'suggested' END AS review_label,
    CASE WHEN p_partkey % 5 = 1 THEN 'approved' ELSE 'pending' END AS review_decision, p_partkey % 2 = 0 AS human_review
  FROM files),
touched AS (SELECT DISTINCT path, folder FROM files WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')),
matches AS (SELECT DISTINCT t.path, r.id FROM touched t JOIN rules r ON t.folder = r.folder AND CASE r.form WHEN 0 THEN t.path = r.scope WHEN 2 THEN regexp_full_match(t.path, replace(r.folder, '.', '\\.') || '/[^/]*1\\.py') ELSE starts_with(t.path, r.folder || '/') END)"""
