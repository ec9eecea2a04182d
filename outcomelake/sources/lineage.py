"""Where a record stands: the file, line and place of every event, whatever the size of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import trimmed
from ..schemas import EVENT

#: Blocks of files whose first numbers are sent to all tasks at most; more are joined by a shuffle.
BROADCAST_BLOCKS = 200_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): every line of text files; ``line`` counts a file's lines from 1.

    Files are read in blocks by as many tasks as they have. Each block's lines are counted, and a line's number is
    its place in its block after the lines of the blocks before; only a row a block is ever brought together. Rows
    keep the order in which their block is read, so both readings of the files give the same numbers.
    """
    raw = spark.read.text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    own = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("before"))
    few = blocks.count() <= BROADCAST_BLOCKS
    both = raw.join(F.broadcast(blocks) if few else blocks, ["file", "block"])
    return both.select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def shard_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines with where they stand: ``source_ref`` is ``file:line``, ``source_line`` the line, ``canonical`` whether the
    record has the nested form of stored ones, ``broken`` the text of a line that is no JSON object.

    A file may hold stored records and raw events side by side. Blank lines are left out, and count.
    """
    lines = numbered_lines(spark, path).where(trimmed(F.col("value")) != "")
    whole = F.from_json("value", f"{EVENT}, object_type string, broken_line string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken_line"})
    parsed = lines.select("file", "line", "value", whole.alias("e"))
    is_object = trimmed(F.col("value")).startswith("{")
    broken = F.when(~is_object | F.col("e").isNull(), F.col("value")).otherwise(F.col("e.broken_line"))
    stored = F.col("e.action").isNotNull() & F.col("e.context").isNotNull() & F.col("e.outcome").isNotNull() & F.col("e.attribution").isNotNull()
    name = F.regexp_replace("file", "^file:(//)?(?=/)", "")
    return parsed.select("e.*", F.concat(name, F.lit(":"), F.col("line").cast("string")).alias("source_ref"), F.col("line").alias("source_line"), F.coalesce(stored, F.lit(False)).alias("canonical"), broken.alias("broken")).drop("broken_line", "object_type")


def read_shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events with ``source_ref``, rejects): the sound lines, and (source_ref, line) of those that are no JSON object."""
    found = shard_events(spark, path)
    return found.where("broken is null").drop("broken"), found.where("broken is not null").select("source_ref", F.col("broken").alias("line"))


def observed(checked: DataFrame) -> tuple[DataFrame, Observation]:
    """Normalised rows, with counters that are taken while whatever reads them runs: no pass of their own.

    The counters are there once an action over all rows has ended: records, accepted, rejected, agent, human, uncertain.
    """
    seen = Observation("ingest")
    sound = F.size("errors") == 0
    kinds = {k: F.count_if(sound & (F.col("actor_kind") == k)).alias(k) for k in ("agent", "human", "uncertain")}
    return checked.observe(seen, F.count(F.lit(1)).alias("records"), F.count_if(sound).alias("accepted"), F.count_if(~sound).alias("rejected"), *kinds.values()), seen


def ingest_observed(checked: DataFrame, path: str) -> dict[str, int]:
    """Write normalised rows, sound ones to ``accepted`` and the others to ``rejected`` with their errors, in one pass; the counters."""
    rows, seen = observed(checked)
    sound = F.when(F.size("errors") == 0, "accepted").otherwise("rejected")
    rows.withColumn("part", sound).write.partitionBy("part").mode("overwrite").parquet(path)
    return seen.get
