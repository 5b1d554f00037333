"""Connected sets of nodes that share an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paleoline.session import materialise, release


def components(links: DataFrame, node: str = "doc_id", entity: str = "entity") -> DataFrame:
    """Connected sets of nodes that share an entity: ``node`` and ``group``, the smallest node of its set.

    Each entity links its nodes to its smallest one, so a hot entity costs as many edges as it has nodes. Then the labels
    of a node, of its neighbours and of its label are hooked onto the smallest label seen, and labels are replaced by
    their own labels, until nothing changes: a logarithmic number of rounds in practice, each written to shared storage.
    Nulls in ``entity`` link nothing. Repeated rows change nothing.
    """
    rows = materialise(links.select(F.col(node).alias("n"), F.col(entity).alias("e")).where("n is not null"), "links")
    nodes = rows.select("n").distinct()
    least = rows.where("e is not null").groupBy("e").agg(F.min("n").alias("m"))
    edges = rows.where("e is not null").join(least, "e").select("n", "m").where("n <> m").distinct()
    edges = materialise(edges.unionByName(edges.select(F.col("m").alias("n"), F.col("n").alias("m"))), "edges")
    label = materialise(edges.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("f")), "labels-0")
    held, rnd = label, 0
    while True:
        rnd += 1
        up = label.select(F.col("n").alias("f"), F.col("f").alias("g"))
        state = materialise(label.join(up, "f").select("n", "f", "g"), f"grand-{rnd}")
        seen = edges.join(state.select(F.col("n").alias("m"), F.col("g").alias("mg")), "m").groupBy("n").agg(F.min("mg").alias("mg"))
        with_min = state.join(seen, "n").select("n", "f", "g", F.least("g", "mg").alias("to"))
        hooks = with_min.select(F.col("n"), F.col("to")).unionByName(with_min.groupBy(F.col("f").alias("n")).agg(F.min("to").alias("to")))
        new = hooks.groupBy("n").agg(F.min("to").alias("to")).join(state, "n").select("n", F.least("to", "g").alias("f"), F.col("f").alias("old"))
        new = materialise(new, f"labels-{rnd}")
        release(state, held)
        held = new
        if new.where("f <> old").isEmpty():
            break
        label = new.select("n", "f")
    out = nodes.join(new.select("n", "f"), "n", "left")
    return out.select(F.col("n").alias(node), F.coalesce("f", "n").alias("group"))
