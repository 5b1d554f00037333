"""Splits that keep related records together (problem 4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paleoline.llm.language import label_set
from paleoline.operators.components import components
from paleoline.session import current, materialise, small_or_plain

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}
BLOCK_COMPONENTS, CHAINS, STEPS = 4096, 4, 6000
#: A label of at least this share of all lines is balanced for itself; rarer ones, and lines without any, together.
LEAST_LABEL = 0.01


def entity_links(lines: DataFrame, works: DataFrame) -> DataFrame:
    """(``doc_id``, ``entity``) of every document in ``lines`` or ``works``; a document without any has one row with null.

    Entities are authors (``P`` and seven digits), sources (``S`` and seven digits), read without case and outer blanks,
    and work numbers before ``-{vol}-{page}-lb-`` in current line ids; other values name nobody. Null documents are left out.
    """
    clean = lambda c, letter: F.regexp_extract(F.upper(F.regexp_replace(c, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")), f"^({letter}[0-9]{{7}})$", 1)
    works = works.select("doc_id", F.explode(F.array(clean("author_id", "P"), clean("source_id", "S"))).alias("entity")).distinct()
    work = F.regexp_extract("id", r"^(.+)-[^-]+-[^-]+-lb-", 1)
    held = current(lines, "doc_id").select("doc_id", F.concat(F.lit("W:"), work).alias("entity")).distinct()
    rows = works.unionByName(held).where("doc_id is not null")
    return rows.select("doc_id", F.when(~F.col("entity").isin("", "W:"), F.col("entity")).alias("entity")).distinct()


def doc_groups(lines: DataFrame, works: DataFrame) -> DataFrame:
    """``doc_id`` and ``group_doc``, the smallest document of its connected set."""
    return components(entity_links(lines, works)).select("doc_id", F.col("group").alias("group_doc"))


def _anneal(size: np.ndarray, labels: np.ndarray, start: np.ndarray, goal_size: np.ndarray, goal_labels: np.ndarray, seed: int, steps: int, excess: bool = False) -> tuple[np.ndarray, float]:
    """One chain: moves and swaps of whole components that reduce the deviation of sizes and labels; the best state seen.

    With ``excess`` only what lies above the goals counts, for components that others will be added to.
    """
    rng = np.random.default_rng(seed)
    k, n = len(goal_size), len(size)
    at = start.copy()
    have = np.bincount(at, weights=size, minlength=k)
    held = np.stack([np.bincount(at, weights=labels[:, j], minlength=k) for j in range(labels.shape[1])], 1)
    total = max(1.0, float(size.sum()))

    far = (lambda x: np.maximum(x, 0)) if excess else np.abs

    def cost(h: np.ndarray, lab: np.ndarray) -> float:
        return float((far(h - goal_size) / np.maximum(goal_size, 1e-9)).sum() + 0.2 * far(lab - goal_labels).sum() / total)

    now = best = cost(have, held)
    best_at = at.copy()
    heat = 0.05
    picks, second, to, luck = rng.integers(0, n, steps), rng.integers(0, n, steps), rng.integers(0, k, steps), rng.random(steps)
    for t in range(steps):
        i, j = picks[t], second[t]
        swap = t % 2 and at[i] != at[j]
        a, b = at[i], (at[j] if swap else to[t])
        if a == b:
            continue
        move, lab = size[i] - (size[j] if swap else 0), labels[i] - (labels[j] if swap else 0)
        h, c = have.copy(), held.copy()
        h[a] -= move
        h[b] += move
        c[a] -= lab
        c[b] += lab
        new = cost(h, c)
        if new <= now or luck[t] < np.exp((now - new) / heat):
            at[i] = b
            if swap:
                at[j] = a
            have, held, now = h, c, new
            if now < best:
                best, best_at = now, at.copy()
        heat = max(1e-4, heat * 0.999)
    return best_at, best


def assign_splits(lines: DataFrame, groups: DataFrame, shares: dict[str, float] | None = None, label: Column | None = None, block: int = BLOCK_COMPONENTS, chains: int = CHAINS, steps: int = STEPS, seed: int = 0) -> DataFrame:
    """``doc_id``, ``group_doc``, ``split``: all documents of a group in one split, current lines in the given shares.

    Every group starts from a hash and is moved and exchanged as a whole by ``chains`` independent chains of annealing in
    parallel tasks, so that sizes and the counts of ``label`` (default: the first of the line's languages by
    ``label_set``) come near the shares; the best chain is kept. Groups larger than a tenth of the smallest share, of
    which there are at most a few dozen whatever the data's size, are searched first, together, and only what exceeds a
    split's share counts against them. All others are hashed into blocks of about ``block`` groups, each searched for
    itself, with the sizes and labels that the large ones leave as its goal. Labels of at least ``LEAST_LABEL`` of all
    lines are balanced each for itself, all others and null together as one, so every line counts.

    Defined cases: documents without lines have size 0 and still get a split; lines of documents that aren't in
    ``groups`` are ignored; an empty table gives no rows; shares are scaled to a sum of 1.
    """
    shares = shares or SHARES
    names = list(shares)
    want = np.array([shares[n] for n in names], float)
    want /= want.sum()
    label = F.get(label_set(F.col("lang")), F.lit(0)) if label is None else label
    counts = current(lines, "doc_id", label.alias("label")).groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    sized = groups.join(counts, "doc_id", "left").groupBy("group_doc", "label").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    sized = materialise(sized, "split-sizes")
    total = sized.agg(F.sum("n")).first()[0] or 0
    # At most 1 / LEAST_LABEL rows.
    labels = sorted(r["label"] for r in sized.where("label is not null").groupBy("label").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_LABEL * total).collect())
    per = sized.groupBy("group_doc").agg(F.sum("n").alias("size"), *[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(f"l{j}") for j, x in enumerate(labels)], F.sum(F.when(F.col("label").isin(labels), 0).otherwise(F.col("n"))).alias(f"l{len(labels)}"))
    bound = max(1.0, 0.1 * float(want.min()) * total)
    per = materialise(per.withColumn("large", F.col("size") >= bound), "split-groups")
    cols = [f"l{j}" for j in range(len(labels) + 1)]
    all_labels = np.array([x or 0 for x in per.agg(*[F.sum(c) for c in cols]).first()], float)
    goals = np.outer(want, np.concatenate([[total], all_labels]))

    def search(rows: DataFrame, goals: np.ndarray, name: str, excess: bool) -> DataFrame:
        """The best chain of each block: ``group_doc``, ``split``. ``goals`` are sizes and labels by split."""
        share = goals[:, 0] / goals[:, 0].sum() if goals[:, 0].sum() else want
        cut = np.cumsum(share)
        whole = np.maximum(goals[:, 1:].sum(0), 1e-9)

        def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("group_doc", kind="stable")
            size, lab = b["size"].to_numpy(float), b[cols].to_numpy(float)
            spot = pd.util.hash_array(b["group_doc"].to_numpy(object)) / 2.0**64
            start = np.minimum(np.searchsorted(cut, spot, "right"), len(names) - 1)
            goal_size, goal_lab = (goals[:, 0], goals[:, 1:]) if excess else (share * size.sum(), goals[:, 1:] / whole * lab.sum(0))
            at, cost = _anneal(size, lab, start, goal_size, goal_lab, seed * 7919 + int(key[0]) * 31 + int(key[1]), steps, excess)
            return pd.DataFrame({"group_doc": b["group_doc"], "block": key[0], "chain": key[1], "split": [names[x] for x in at], "cost": cost})

        tasks = rows.withColumn("chain", F.explode(F.array(*[F.lit(c) for c in range(chains)])))
        found = materialise(tasks.groupBy("block", "chain").applyInPandas(run, "group_doc string, block int, chain int, split string, cost double"), name)
        best = found.groupBy("block").agg(F.min_by("chain", F.struct("cost", "chain")).alias("chain"))
        return found.join(small_or_plain(best), ["block", "chain"], "left_semi").select("group_doc", "split")

    large = search(per.where("large").withColumn("block", F.lit(0)), goals, "split-large", True)
    held = np.zeros_like(goals)
    sums = large.join(per, "group_doc").groupBy("split").agg(F.sum("size").alias("size"), *[F.sum(c).alias(c) for c in cols])
    for r in sums.collect():
        held[names.index(r["split"])] = [r["size"], *[r[c] for c in cols]]
    n_blocks = max(1, -(-per.where("not large").count() // block))
    small = per.where("not large").withColumn("block", F.pmod(F.xxhash64("group_doc"), F.lit(n_blocks)).cast("int"))
    out = large.unionByName(search(small, np.maximum(goals - held, 0), "split-chains", False))
    return groups.join(out, "group_doc").select("doc_id", "group_doc", "split")


def balance(lines: DataFrame, splits: DataFrame, shares: dict[str, float] | None = None, most: float = 0.02) -> DataFrame:
    """One row that checks :func:`assign_splits`: ``documents``, ``groups``, ``divided`` groups, and whether every share is ``near``: off by ``most`` at most, or by what the largest group exceeds the smallest share."""
    shares = shares or SHARES
    held = splits.join(current(lines, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per = held.groupBy("group_doc").agg(F.count("*").alias("docs"), F.count_distinct("split").alias("k"), F.sum("n").alias("n"), *[F.sum(F.when(F.col("split") == x, F.col("n")).otherwise(0)).alias(f"n_{x}") for x in shares])
    total = F.greatest(F.sum("n"), F.lit(1))
    off = F.greatest(*[F.abs(F.sum(f"n_{x}") / total - w / sum(shares.values())) for x, w in shares.items()])
    # A group larger than a share can't leave it near.
    free = F.greatest(F.lit(most), F.max("n") / total - min(shares.values()) / sum(shares.values()))
    return per.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("documents"), F.count("*").alias("groups"), F.count_if(F.col("k") > 1).alias("divided"), (off <= free).alias("near"))
