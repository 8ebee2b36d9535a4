"""Connected components of a link table by repeated contraction, all in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for each node that links(a long, b long) join to another: two have one root exactly if links join them.

    Each round maps a node to the neighbour of least hash, itself included, follows that map twice,
    rewrites the links by it and drops loops and repeats. Every node that is nobody's choice is
    gone after the round, so the rounds grow with the logarithm of the nodes. Each round's tables
    are written to the shared folder. A node with a thousandth of the links or more is joined by
    broadcast, so a hub's links don't meet in one task. Loops and links with a null end are ignored; no links give no rows.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    tidy = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = common.stage(tidy(links), "links")
    roots: DataFrame | None = None
    while not links.isEmpty():
        ends = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = ends.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least(order("a"), F.col("m"))["id"].alias("p"))
        step = common.stage(chosen, "step")
        for _ in range(2):
            onward = step.select(F.col("a").alias("p"), F.col("p").alias("further"))
            last, step = step, common.stage(common.join_counted(step, onward, "p", "left").select("a", F.coalesce("further", "p").alias("p")), "step")
            common.drop(last)
        if roots is None:
            roots = common.stage(step.select(F.col("a").alias("node"), F.col("p").alias("root")), "roots")
        else:
            moved = step.select(F.col("a").alias("root"), F.col("p").alias("further"))
            last, roots = roots, common.stage(common.join_counted(roots, moved, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "roots")
            common.drop(last)
        to_a, to_b = step.select("a", F.col("p").alias("pa")), step.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        half = common.stage(common.join_counted(links, to_a, "a").select("pa", "b"), "half")
        last, links = links, common.stage(tidy(common.join_counted(half, to_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "links")
        common.drop(last, half, step)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
