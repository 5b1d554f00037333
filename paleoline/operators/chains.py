"""Chains of lines whose words continue, by doubling along the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paleoline.functions.text import LINE_BREAK
from paleoline.operators.hierarchy import resolve_links
from paleoline.session import current, materialise, release


def chains(ordered: DataFrame, link: str = "nonbreaking_next_line") -> DataFrame:
    """Chain of every line of :func:`document_order`: ``id``, ``doc_id``, ``pos``, ``head_pos``, ``pos_in_chain``.

    A link counts if it names a line of the same document. Lines are visited in document order, and a chain takes every
    line not yet taken; a line therefore belongs to the first line in document order from which links lead to it, itself
    included. That first line is found by handing it on along jumps of doubling length, the nearest copy first, so links
    backward, lines named twice and loops need no special case, and no chain is gathered in a task.
    """
    links = ordered.where(f"{link} <> ''").select("doc_id", "pos", F.col(link).alias("to"))
    target = ordered.select("doc_id", F.col("id").alias("to"), F.col("pos").alias("next"))
    jump = materialise(links.join(target, ["doc_id", "to"]).select("doc_id", "pos", "next"), "chain-links")
    nodes = jump.select("doc_id", "pos").unionByName(jump.select("doc_id", F.col("next").alias("pos"))).distinct()
    best = materialise(nodes.select("doc_id", "pos", F.struct(F.col("pos").alias("head"), F.lit(0).alias("dist")).alias("first")).withColumn("old", F.col("first")), "chain-0")
    step = 1
    while True:  # ends in the first round that changes nothing
        handed = jump.join(best, ["doc_id", "pos"]).select("doc_id", F.col("next").alias("pos"), F.struct(F.col("first.head"), (F.col("first.dist") + step).alias("dist")).alias("first"))
        own = best.select("doc_id", "pos", "first", F.col("first").alias("old"))
        new = own.unionByName(handed, allowMissingColumns=True).groupBy("doc_id", "pos").agg(F.min("first").alias("first"), F.min("old").alias("old"))
        new = materialise(new, f"chain-{step}")
        release(best)
        best = new
        if new.where("first <> old").isEmpty():
            break
        far = jump.select("doc_id", F.col("pos").alias("next"), F.col("next").alias("far"))
        longer = materialise(jump.join(far, ["doc_id", "next"]).select("doc_id", "pos", F.col("far").alias("next")), f"chain-jump-{step}")
        release(jump)
        jump = longer
        step *= 2
    found = best.select("doc_id", "pos", F.col("first.head").alias("head_pos"), F.col("first.dist").alias("pos_in_chain"))
    out = ordered.select("id", "doc_id", "pos").join(found, ["doc_id", "pos"], "left")
    return out.select("id", "doc_id", "pos", F.coalesce("head_pos", "pos").alias("head_pos"), F.coalesce("pos_in_chain", F.lit(0)).alias("pos_in_chain"))


def profiled_chains(lines: DataFrame) -> DataFrame:
    """Chains from each line that is nobody's successor, over document borders: ``head_id``, ``n_lines``, ``n_bytes``.

    Bytes are those of ``source_sic`` joined by a line-break sign. Shared tails count in every chain. A head whose links
    lead into a loop has no profile.
    """
    cur = materialise(current(lines, "nonbreaking_next_line", F.octet_length(F.coalesce("source_sic", F.lit(""))).alias("bytes"), "file_pos"), "profile-lines")
    succ = cur.where("nonbreaking_next_line <> ''").select(F.col("nonbreaking_next_line").alias("id")).distinct()
    heads = cur.join(succ, "id", "left_anti").select("id", "bytes")
    tree = resolve_links(cur, weight="bytes")
    sep = len(LINE_BREAK.encode())
    long = heads.join(tree.where("depth > 0"), "id").join(cur.select(F.col("id").alias("root_id"), F.col("bytes").alias("last")), "root_id")
    long = long.select(F.col("id").alias("head_id"), (F.col("depth") + 1).alias("n_lines"), (F.col("total") + F.col("last") + F.col("depth") * sep).alias("n_bytes"))
    single = heads.join(tree.select("id"), "id", "left_anti").select(F.col("id").alias("head_id"), F.lit(1).alias("n_lines"), F.col("bytes").cast("bigint").alias("n_bytes"))
    return long.unionByName(single)


def chain_profile(profiles: DataFrame) -> DataFrame:
    """Count, mean, largest, and the values at 95 and 99 percent (0-based floor index) of the chains' bytes.

    The percentiles come from counts per value, of which there are few, not from a sort of all chains.
    """
    from pyspark.sql import Window

    per = profiles.groupBy("n_bytes").agg(F.count("*").alias("n"))
    upto = per.withColumn("upto", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("n_bytes")))
    total = per.agg(F.sum("n").alias("t"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("t") * p), F.col("n_bytes")))
    return upto.crossJoin(F.broadcast(total)).agg(F.max("t").alias("chains"), (F.sum(F.col("n") * F.col("n_bytes")) / F.max("t")).alias("mean_bytes"), F.max("n_bytes").alias("max_bytes"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def chain_histogram(profiles: DataFrame) -> DataFrame:
    """Chains by number of lines, with their share."""
    from pyspark.sql import Window

    per = profiles.groupBy("n_lines").agg(F.count("*").alias("n"))
    return per.select("n_lines", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))
