"""Connected components of a table of links, by hooking to smaller neighbours and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.shared import drop, save

#: Times that labels are followed between two contractions: paths of 2 ** JUMPS nodes at once.
JUMPS = 3


def relabelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links between the labels of their ends, each once, without those within one label."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("_la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("_lb"))
    got = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_la", "a").alias("a"), F.coalesce("_lb", "b").alias("b"))
    return got.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node that is reachable by ``links`` (a, b), for each node in them.

    Every round each node hooks to its smallest neighbour, hooks are followed some steps, and the
    links are contracted to those between labels, so they shrink from round to round. Minima are
    taken before the shuffle: a node with very many links costs each task one row. Self-links,
    repeated links and null ends do no harm; no links give no rows.
    """
    whole = links.select("a", "b").where("a is not null and b is not null")
    nodes = whole.select(F.col("a").alias("node")).unionByName(whole.select(F.col("b").alias("node"))).distinct()
    labels = save(nodes.withColumn("label", F.col("node")), "labels")
    edges = save(whole.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if not edges.limit(1).count():
            drop(edges)
            return labels
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = hooks = save(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "hooks")
        for _ in range(JUMPS):
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("_up"))
            hooks = hooks.join(up, "label").select("node", F.col("_up").alias("label"))
        hooks = save(hooks, "hooks")
        step = hooks.select(F.col("node").alias("label"), F.col("label").alias("_to"))
        old, labels = labels, save(labels.join(step, "label", "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")
        was, edges = edges, save(relabelled(edges, hooks), "edges")
        drop(first, hooks, old, was)
    raise RuntimeError("labels did not settle")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links are added to those they are of."""
    more = components(relabelled(links, labels))
    up = more.select(F.col("node").alias("label"), F.col("label").alias("_up"))
    old = labels.join(up, "label", "left").select("node", F.coalesce("_up", "label").alias("label"))
    new = more.join(labels.select("node"), "node", "left_anti")
    out = save(old.unionByName(new.select("node", "label")), "labels")
    drop(more, labels)
    return out
