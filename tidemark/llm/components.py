"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of `edges` (a, b): comp is the least node that can be reached.

    Each round maps a node to the least of itself and its neighbours, and replaces the edges by those between what their
    ends are mapped to.  A node that is mapped to itself has a neighbour that is not, so at least half of the nodes go
    with each round, whatever the shape of the graph.  Aggregates are partial and joins are plain, so a node with very
    many edges is spread over tasks.
    """
    both = lambda e: e.filter("a <> b").select("a", "b").union(e.filter("a <> b").select("b", "a")).distinct()
    rest = materialise(both(edges))
    labels = None
    while True:
        step = materialise(rest.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
        if labels is None:
            labels = step
        else:
            further = step.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
            labels = materialise(labels.join(further, "comp", "left").select("node", F.coalesce("further", "comp").alias("comp")))
        to = lambda c: step.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_to"))  # noqa: B023, E731
        rest = materialise(both(rest.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))))
        if rest.isEmpty():
            return labels
