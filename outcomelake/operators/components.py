"""Connected components of a link table, by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in ``links`` (columns a, b); component is the smallest id reachable.

    Every round points each vertex at its smallest neighbour or itself and replaces both ends of each
    link by what they point at. A star, chain or clique shrinks by a factor of at least two a round, and
    usually vanishes in two or three. Only counts come to the driver. All grouping is by ``min`` with
    map-side partial aggregation, so a vertex with very many links costs its task one row from each map
    task; the joins are plain equi joins whose large side adaptive execution may split. Every round's
    tables are written to the shared folder, so a lost executor never costs earlier rounds. Null ends and
    self-links are ignored; repeated links count once; an empty table gives an empty result.
    """
    links = written(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), name)
    labels: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("b"))
        parents = written(lowest.select(F.col("a").alias("id"), F.least("a", "b").alias("parent")), name)
        # Smallest neighbours may form chains; follow two more steps before contracting.
        for _ in range(2):
            up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
            parents = parents.join(up, "parent").select("id", F.col("above").alias("parent"))
        parents = written(parents, name)
        if labels is None:
            labels = parents.select("id", F.col("parent").alias("component"))
        else:
            step = parents.withColumnsRenamed({"id": "component", "parent": "above"})
            labels = labels.join(step, "component", "left").select("id", F.coalesce("above", "component").alias("component"))
        labels = written(labels, name)
        for end in ("a", "b"):
            links = links.join(parents.withColumnsRenamed({"id": end, "parent": "to"}), end).drop(end).withColumnRenamed("to", end)
        links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
