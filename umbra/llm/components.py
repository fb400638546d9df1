"""Connected components of a link table, by labels that only shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import stored


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) of every node in ``links`` (a, b), with the smallest id of its component.

    Each round takes the least label of a node's neighbours and then the label of that
    label, so long chains shorten fast. Rounds are written to the shared folder; links
    never reach the driver, only the number of labels that changed does. A node with
    very many links costs partial minima only. No links give no rows.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), label)
    held = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), label)
    while True:
        near = both.join(held, both.b == held.id).groupBy("a").agg(F.min("component").alias("m"))
        less = held.join(near, held.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        of = held.select(F.col("id").alias("__of"), F.col("component").alias("__its"))
        jumped = less.join(of, less.component == of.__of, "left").select("id", F.least("component", "__its").alias("component"), "old")
        held = stored(jumped, label)
        if not held.where("component != old").limit(1).count():
            return held.select("id", "component")
