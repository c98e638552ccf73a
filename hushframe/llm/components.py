"""Connected components of a table of links, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.shared import join_per_key, stored


def connected(links: DataFrame) -> DataFrame:
    """links (a, b): one row (node, component) for each node that has a link; component is the smallest node reached.

    Each round takes the smallest component of the neighbours and then follows components' own components, so a chain
    of n links needs about log n rounds. Each round's table is written to the shared folder. A hub with many links,
    or a component with many nodes, is joined by broadcast of its few numbers, so neither fills a task.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    n_links = both.count()
    state = stored(both.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("node"), F.least("a", "least").alias("component"), "n"), "components")
    n_nodes = state.count()
    while True:
        near = join_per_key(both.select("a", F.col("b").alias("node")), state, ["node"], "n", n_links).groupBy("a").agg(F.min("component").alias("near"))
        hooked = stored(state.join(near, state["node"] == near["a"]).select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"), "n"), "components")
        sizes = hooked.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        up = stored(sizes.join(state.select(F.col("node").alias("component"), F.col("component").alias("up")), "component"), "components-up")
        jumped = stored(join_per_key(hooked, up, ["component"], "size", n_nodes).select("node", "before", F.least("component", "up").alias("component"), "n"), "components")
        if jumped.filter("component <> before").isEmpty():
            return jumped.select("node", "component")
        state = jumped.select("node", "component", "n")
