"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

#: Edges for each file that a round writes, where there would be more small ones.
ROWS = 200_000


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of the nodes of ``a, b`` edges; root is the component's smallest node.

    Each round takes the smallest label among a node and its neighbours and then the label's own label, until none
    changes; every second one is written to the shared folder, and only whether labels changed in it reaches the driver. Hubs are
    met by map-side minima and by splitting skewed joins. No edges give no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    files = max(8, edges.count() // ROWS)
    both = saved(both, files)
    at = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), files)
    while True:
        labels = at.select("node", "root")
        for _ in range(2):  # two steps for each table that is written
            seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
            step = labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("to"))
            jump = labels.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
            step = step.join(jump, "to", "left").select("node", "was", F.least("to", "beyond").alias("root"))
            labels = step.select("node", "root")
        step = saved(step, files)
        discard(at)
        if step.filter("root <> was").isEmpty():
            discard(both)
            return step.select("node", "root")
        at = step
