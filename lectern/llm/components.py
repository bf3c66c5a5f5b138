"""Connected components of a table of links, by contracting towards smaller ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(vid, comp): for each id in ``edges`` (a, b: long) the smallest id of its component.

    Each round hooks every component to the smallest one beside it, follows the hooks to their ends by doubling, and
    writes the links anew between what is left; the links' number falls by a factor each round. Everything is
    a table in the shared folder; a component with many links is only ever aggregated (min), never gathered.

    Defined cases: no links, or only from an id to itself: no rows; repeated links count once; nulls aren't expected.
    """
    links = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    labels = None
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        hooks = stored(hooks, "cc-hooks")
        while True:  # hooks lead to smaller ids, so there are no circles
            up = hooks.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hooks = stored(hooks.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"), (F.col("q") < F.col("p")).alias("moved")), "cc-hooks")
            if hooks.where("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        ends = hooks.select("a", F.col("p").alias("to"))
        if labels is None:
            labels = ends.select(F.col("a").alias("vid"), F.col("to").alias("comp"))
        else:
            labels = stored(labels.join(ends, labels.comp == ends.a, "left").select("vid", F.coalesce("to", "comp").alias("comp")), "cc-labels")
        moved = links.join(ends.withColumnRenamed("to", "x"), "a").drop("a").join(ends.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        links = stored(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-links")
    if labels is None:
        labels = links.select(F.col("a").alias("vid"), F.col("b").alias("comp"))
    return labels
