"""Connected components of a link table, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.storage import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): component is the smallest node reachable.

    Each round every node takes the smallest label among its neighbours and then its label's
    label, so that labels travel in doubling steps. Rounds are tables in the shared folder; the
    driver sees only the number of labels that changed. A hub's rows combine before the shuffle.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = hooked.join(of, hooked["label"] == of["_n"], "left").select("node", "old", F.least("label", "_l").alias("label"))
        jumped = materialize(jumped, "labels")
        if not jumped.where("old <> label").limit(1).count():
            return jumped.select("node", F.col("label").alias("component"))
        labels = jumped.select("node", "label")
