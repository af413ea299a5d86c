"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """``v`` and ``comp``, the smallest vertex reachable over ``edges(a, b)``.

    Each round takes the smallest label among the neighbours and then jumps to
    the label's own label, which shortens chains to about their logarithm.
    Vertices without edges are left out; repeated edges and loops change
    nothing; an empty table gives no rows.
    """
    both = common.materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = common.materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("comp")))
    for _ in range(most):
        near = both.join(labels, F.col("b") == F.col("v")).groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "v").select("v", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        top = labels.select(F.col("v").alias("t"), F.col("comp").alias("up"))
        jump = common.materialize(step.join(top, step["comp"] == top["t"]).select("v", "old", F.least("comp", "up").alias("comp")))
        labels = jump.select("v", "comp")
        if jump.filter("old <> comp").isEmpty():
            return labels
    raise RuntimeError("components didn't settle")
