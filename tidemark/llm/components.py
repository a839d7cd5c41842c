"""Connected components of a link table by minimum labels with pointer jumping; labels never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: Label rows (16 bytes each) that are broadcast in a round; more are joined by a shuffle.
MAX_LABELS = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` long pairs to ``(node, root)``; root is the smallest node of the component.

    Each round takes the least label of the neighbours and then the label's own label, so the number of rounds grows
    with the logarithm of a component's width. Empty links give no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    edges = materialize(both, "cc-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "cc-0")
    n = 0
    while True:
        n += 1
        known = broadcast_if_small(labels, MAX_LABELS)
        least = edges.join(known.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        mine = labels.join(broadcast_if_small(materialize(least, f"cc-{n}-least"), MAX_LABELS), "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        mine = materialize(mine, f"cc-{n}-own")
        up = broadcast_if_small(mine.select(F.col("node").alias("root"), F.col("root").alias("above")), MAX_LABELS)
        labels = materialize(mine.join(up, "root").select("node", "was", F.col("above").alias("root")), f"cc-{n}")
        if labels.filter("was != root").limit(1).count() == 0:
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def absorb(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` of :func:`components` after more links: only the components that they join are worked on again."""
    ends = links
    for end in ("a", "b"):
        known = broadcast_if_small(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), MAX_LABELS)
        ends = ends.join(known, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    ends = materialize(ends.select("a", "b", "root_a", "root_b"), "cc-ends")
    joined = components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    seen = ends.select(F.col("a").alias("node"), F.col("root_a").alias("root")).unionByName(ends.select(F.col("b").alias("node"), F.col("root_b").alias("root")))
    every = roots.unionByName(seen).distinct()
    new = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return materialize(every.join(broadcast_if_small(new, MAX_LABELS), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "cc-roots")
