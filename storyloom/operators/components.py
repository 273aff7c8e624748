"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def _oriented(edges: DataFrame) -> DataFrame:
    """Different edges without loops, smaller end first."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """(id, root): parents followed to the end; every jump halves the way."""
    while True:
        further = parents.select(F.col("id").alias("root"), F.col("root").alias("far"))
        moved = cut(parents.join(further, "root", "left").select("id", F.coalesce("far", "root").alias("root"), (F.col("far") < F.col("root")).alias("moved")))
        parents = moved.select("id", "root")
        if moved.filter("moved").isEmpty():
            return parents


def contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (id, root) of all ends, and the different edges left between roots.

    Every id points at the smallest id next to it (counted map-side, so a hub costs
    its distinct neighbours once) and pointers are followed to their roots, ids
    smaller than all next to them.  Both ends of every edge are then renamed to
    their roots; loops and repeats drop out.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nearest = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("root"))
    roots = _roots(cut(nearest))
    # A hub's edges share one end: each renaming is a join of its own, written or shuffled at once, so adaptive skew handling can split it.
    left = edges.join(roots.select(F.col("id").alias("a"), F.col("root").alias("first")), "a").select("b", "first")
    right = left.join(roots.select(F.col("id").alias("b"), F.col("root").alias("second")), "b")
    return roots, cut(_oriented(right.select(F.col("first").alias("a"), F.col("second").alias("b"))))


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id of each component.

    ``edges`` has two columns ``a`` and ``b`` of one type.  Rounds contract the
    graph until no edge is left: a chain of any order is one root after one round,
    a star after two, and only ids that are smaller than their neighbours reach
    the next round, so what is written falls each time.  The rounds' maps are then
    applied one after the other, last round first.  ``vertices`` (``id``) adds
    isolated ids.
    """
    left = cut(_oriented(edges.select("a", "b").filter("a is not null AND b is not null")))
    loops = edges.filter("a = b").select(F.col("a").alias("id"))
    maps = []
    while not left.isEmpty():
        roots, left = contract(left)
        maps.append(roots)
    if not maps:
        labels = loops.distinct().select("id", F.col("id").alias("component"))
    else:
        labels = maps.pop().withColumnRenamed("root", "component")
        while maps:
            later = labels.select(F.col("id").alias("root"), "component")
            labels = cut(maps.pop().join(later, "root", "left").select("id", F.coalesce("component", "root").alias("component")))
        alone = loops.distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
        labels = labels.unionByName(alone)
    if vertices is not None:
        labels = vertices.select("id").distinct().join(labels, "id", "left").select(
            "id", F.coalesce("component", "id").alias("component")
        )
    return labels
