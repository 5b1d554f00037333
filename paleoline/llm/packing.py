"""Filling fixed-capacity containers with texts (problem 8)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, OPEN_BINS, SHARD_ROWS = 4096, 64, 50_000
_BLOCK = 1_000_000


def best_fit(sizes: list[int], capacity: int, open_bins: int) -> list[tuple[int, int, int]]:
    """(item, container, tokens) by bounded-space online best fit.

    ``free`` is a bitset whose bit f says that some open container has f tokens of free space; the best fit of an item of
    s tokens is the lowest set bit from s on. If none fits and ``open_bins`` are open, the fullest closes. An item over
    the capacity is cut: whole containers of its own, and the rest placed like an item.
    """
    at: dict[int, list[int]] = {}
    free, n_open, new = 0, 0, 0
    out = []
    for k, s in enumerate(sizes):
        while s > capacity:
            out.append((k, new, capacity))
            new, s = new + 1, s - capacity
        fits = free >> s
        if fits:
            space = s + (fits & -fits).bit_length() - 1
            stack = at[space]
            b = stack.pop()
            if not stack:
                free &= ~(1 << space)
        else:
            if n_open == open_bins:
                space = (free & -free).bit_length() - 1
                stack = at[space]
                stack.pop()
                if not stack:
                    free &= ~(1 << space)
                n_open -= 1
            b, space = new, capacity
            new, n_open = new + 1, n_open + 1
        out.append((k, b, s))
        left = space - s
        if left:
            at.setdefault(left, []).append(b)
            free |= 1 << left
        else:
            n_open -= 1
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Containers for the texts of ``docs``: ``doc_id``, ``part``, ``n_parts``, ``tokens``, ``container``.

    Sizes are tokens of a byte tokenizer: UTF-8 bytes plus one end token. Only ids and sizes move; the texts stay where
    they are. Rows are hashed into shards of about ``shard_rows``, each packed by one task in the order of a hash, so the
    result is the same on every cluster; a shard leaves at most ``open_bins`` containers half full. ``container`` is
    unique over all shards. A document of more than ``capacity`` tokens has several parts, every other one exactly one.

    Defined cases: null text is no item, empty text is one token; a null ``doc_id`` is kept; repeated rows are items of their own; an
    empty table gives no rows.
    """
    items = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc"), (F.octet_length("text") + 1).alias("size"))
    n = max(1, -(-items.count() // shard_rows))
    # Rows with the same id and size, of which there may be many, are counted and numbered, so each has a shard of its own.
    many = items.groupBy("doc", "size").agg((F.count("*") - 1).alias("last")).withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"last div {_BLOCK}"))))
    items = many.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least(F.lit(_BLOCK - 1), F.col("last") - F.col("block") * _BLOCK)))).select("doc", "size", (F.col("block") * _BLOCK + F.col("copy")).alias("copy"))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc", "size", "copy"), F.lit(n)).cast("int"))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        order = b.assign(h=pd.util.hash_array(b["doc"].fillna("").to_numpy(object))).sort_values(["h", "size", "copy"], kind="stable")
        placed = pd.DataFrame(best_fit(order["size"].tolist(), capacity, open_bins), columns=["k", "container", "tokens"])
        out = pd.DataFrame({"doc": order["doc"].iloc[placed["k"]].to_numpy(), "part": placed.groupby("k").cumcount().to_numpy(), "n_parts": placed.groupby("k")["k"].transform("size").to_numpy(), "tokens": placed["tokens"].to_numpy()})
        out["container"] = placed["container"].to_numpy() * n + int(key[0])
        return out

    packed = items.groupBy("shard").applyInPandas(run, "doc string, part int, n_parts int, tokens int, container bigint")
    return packed.select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "part", "n_parts", "tokens", "container")


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, mean fill, and share of containers filled to 95 % or more."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("t"))
    return per.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count("*") * F.lit(capacity))).alias("mean_fill"), F.avg((F.col("t") >= 0.95 * capacity).cast("double")).alias("share_95"))
