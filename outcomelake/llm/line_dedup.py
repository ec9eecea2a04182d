"""Lines that many documents share: exploded, hashed, counted by documents, dropped and put together again."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .skew import joined_by_count

#: Space and the characters from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Dropped lines that are sent to all tasks at most; beyond it they are joined with their documents by a shuffle.
BROADCAST_LINES = 500_000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased; all other characters are left alone."""
    stripped = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(stripped) == F.char_length(stripped), F.lower(stripped)).otherwise(F.translate(stripped, string.ascii_uppercase, string.ascii_lowercase))


def common_lines(lines: DataFrame, least_documents: int) -> DataFrame:
    """(hash, rows, last): hashes that at least ``least_documents`` distinct ids hold, their rows and greatest id.

    Distinct pairs of hash and id are formed first, spread by both, so that a line of all documents is one row a
    task when the hashes meet.
    """
    pairs = lines.groupBy("hash", "id").agg(F.count("*").alias("rows"))
    found = pairs.groupBy("hash").agg(F.count("id").alias("n"), F.sum("rows").alias("rows"), F.max("id").alias("last"))
    return found.where(F.col("n") >= least_documents).select("hash", "rows", "last")


def without_common_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_documents: int = 5, least_chars: int = 40) -> DataFrame:
    """(id, text, n_lines, n_dropped): whole texts without the lines that many documents share.

    A text is split at line feeds. A line's key is the line without blanks (space, tab to carriage return) at its
    ends, with A-Z lower-cased. Keys of at least ``least_chars`` code points that stand in at least
    ``least_documents`` documents lose all their lines, but for those of the greatest id that holds them. All other
    lines stay in their order, joined by line feeds. Keys are compared by 128 bits of their SHA-256.

    Only hashes and positions of long lines are shuffled; texts once at most, to meet the positions that they lose.
    A key that a third of all lines share is counted within tasks first and then sent to all of them.

    Defined cases: a null or empty text has one empty line, which stays. A text of which no line stays is empty.
    Rows that repeat an id are one document: they count once for a key, and keep or lose it alike. Rows without an
    id count for no key, and lose the lines of every key that others make common. Extra columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # Rows of one id and one text share their fate, so these two numbers may stand for a row.
    docs = docs.select("id", "text", F.xxhash64("id", "text").alias("row"), F.xxhash64(F.lit("row"), "text", "id").alias("row2"))
    lines = docs.select("id", "row", "row2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("id", "row", "row2", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    lines = written(lines.select("id", "row", "row2", "pos", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("hash")), "line-hashes")
    common = written(common_lines(lines, least_documents), "line-common")

    lost = joined_by_count(lines, common, ["hash"], "rows").where("id is null or id <> last")
    lost = lost.select("row", "row2", "pos").distinct().groupBy("row", "row2").agg(F.collect_list("pos").alias("lost"))
    lost = written(lost, "line-lost")
    few = lost.agg(F.coalesce(F.sum(F.size("lost")), F.lit(0))).first()[0] <= BROADCAST_LINES
    both = docs.join(F.broadcast(lost) if few else lost, ["row", "row2"], "left").select("id", "text", "lost", F.split("text", "\n").alias("lines"))
    both = both.select("id", "text", "lost", "lines", F.size("lines").alias("n"))
    stay = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("lost"))
    text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n"))
    return both.select(F.col("id").alias(id_col), text.alias("text"), F.col("n").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))
