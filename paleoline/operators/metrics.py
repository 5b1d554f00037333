"""Scores of boundary predictions and of expanded text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paleoline.operators.order import ranked


def scored(boundaries: DataFrame) -> DataFrame:
    """Latest scored row of each boundary with a probability; ties by probability. Rows without probability don't count."""
    w = Window.partitionBy("boundary_id").orderBy(F.desc("scored_at"), F.desc("prob"), F.desc("label"))
    return boundaries.where("boundary_id is not null and prob is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def prf(rows: DataFrame, by: list[str], threshold: float = 0.6) -> DataFrame:
    """Precision, recall and F1 of ``prob >= threshold`` against ``label`` by groups; 0 where undefined."""
    hit = F.col("prob") >= threshold
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("n_positive"))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def pr_curve(rows: DataFrame) -> DataFrame:
    """Precision and recall at every distinct probability: ``threshold``, ``precision``, ``recall``, and the end point of precision 1 and recall 0, without a threshold.

    Counts per value come first; the running sums then go over range partitions whose totals are carried, so no task sees
    all thresholds.
    """
    per = rows.groupBy("prob").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p"))
    run = _running(per)
    total = run.agg(F.max("cum_pos").alias("all_pos"))
    curve = run.join(F.broadcast(total)).select(F.col("prob").alias("threshold"), (F.col("cum_pos") / F.col("cum_n")).alias("precision"), F.when(F.col("all_pos") == 0, 1.0).otherwise(F.col("cum_pos") / F.col("all_pos")).alias("recall"))
    return curve.unionByName(curve.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def _running(per: DataFrame) -> DataFrame:
    block = 65536
    r = ranked(per, [], [F.desc("prob")]).withColumn("b", (F.col("pos") / block).cast("bigint"))
    w = Window.partitionBy("b").orderBy("pos")
    r = r.withColumns({"cn": F.sum("n").over(w), "cp": F.sum("p").over(w)})
    sums = r.groupBy("b").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))
    v = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("b", F.coalesce(F.sum("bn").over(v), F.lit(0)).alias("on"), F.coalesce(F.sum("bp").over(v), F.lit(0)).alias("op"))
    return r.join(sums, "b").select("prob", (F.col("cn") + F.col("on")).alias("cum_n"), (F.col("cp") + F.col("op")).alias("cum_pos"))


def pick_threshold(curve: DataFrame, least_precision: float = 0.9, fallback: float = 0.9) -> DataFrame:
    """Lowest threshold with the wanted precision, or the fallback."""
    return curve.agg(F.coalesce(F.min(F.when(F.col("precision") >= least_precision, F.col("threshold"))), F.lit(fallback)).alias("threshold"))


def error_samples(rows: DataFrame, threshold: float = 0.6, k: int = 20) -> DataFrame:
    """The first ``k`` false positives and false negatives in order of ``boundary_id``: ``kind``, ``rank``, ``boundary_id``, ``prob``."""
    hit = F.col("prob") >= threshold
    kind = F.when(hit & (F.col("label") == 0), "false_positive").when(~hit & (F.col("label") == 1), "false_negative")
    w = Window.partitionBy("kind").orderBy("boundary_id")
    return rows.withColumn("kind", kind).where("kind is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("kind", "rank", "boundary_id", "prob")


def cer(predicted: Column, gold: Column) -> Column:
    """Edits over reference letters, summed over rows; 0 for an empty reference."""
    n = F.sum(F.char_length(gold))
    return F.when(n == 0, 0.0).otherwise(F.sum(F.levenshtein(predicted, gold)) / n)
