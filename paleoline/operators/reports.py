"""Heads of tables, positional zips, fallbacks for empty splits, thresholds from files, and reports as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paleoline.operators.order import ranked


def head(df: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first ``n`` rows by ``order``, the same ones however the table is partitioned, for smoke tests and quick evaluations."""
    return ranked(df, [], order, "_at").where(F.col("_at") < n).drop("_at")


def zip_positions(parts: dict[str, DataFrame], order: list[Column | str]) -> DataFrame:
    """Rows of several tables side by side by their position in ``order``: ``pos`` and, of each table, the column of its name.

    The result is as long as the shortest table. Each table needs the order's columns.
    """
    sides = [ranked(df, [], order).select("pos", name) for name, df in parts.items()]
    return reduce(lambda a, b: a.join(b, "pos"), sides)


def or_all(split: DataFrame, whole: DataFrame) -> DataFrame:
    """``split``, or ``whole`` if it has no row."""
    return whole if split.isEmpty() else split


def load_threshold(spark: SparkSession, path: str | None, default: float = 0.6) -> float:
    """``threshold`` of a JSON file written beside a model; the default without a file or without a number in it."""
    if not path:
        return default
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return default
    row = spark.read.schema("threshold double").option("multiLine", True).json(path).first()
    return default if row is None or row[0] is None else row[0]


def latest_checkpoint(spark: SparkSession, path: str, prefix: str = "checkpoint-", needs: tuple[tuple[str, ...], ...] = (("model.safetensors", "pytorch_model.bin", "adapter_model.safetensors"), ("trainer_state.json",))) -> str | None:
    """The checkpoint folder below ``path`` with the highest number, if it has a file of each group of ``needs``; else the one before it, if that has; else nothing."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith(prefix) and name.removeprefix(prefix).isdigit():
            found.append((int(name.removeprefix(prefix)), name))
    for _, name in sorted(found)[:-3:-1]:
        held = {s.getPath().getName() for s in fs.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, name))}
        if all(held & set(group) for group in needs):
            return f"{path.rstrip('/')}/{name}"
    return None


def numeric_suffix(name: Column | str) -> Column:
    """The number at the end of a name, to sort names like ``checkpoint-900`` and ``checkpoint-1000`` by; null without one."""
    return F.regexp_extract(name, r"([0-9]+)$", 1).try_cast("bigint")


def nested(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with a column for each part: a struct if the part has one row, a sorted array of structs if it may have more.

    For documents of metrics, whose parts are small by nature; a part's name ending in ``[]`` asks for the array.
    """
    rows = []
    for name, df in parts.items():
        every = F.array_sort(F.collect_list(F.struct(*df.columns)))
        rows.append(df.agg((every if name.endswith("[]") else every[0]).alias(name.removesuffix("[]"))))
    return reduce(lambda a, b: a.crossJoin(b), rows)


def text_report(figures: DataFrame, title: str, first: int = 0) -> DataFrame:
    """``n``, ``line``: one row of figures as text lines ``name: value`` under a title, numbered from ``first``; fractions with two digits."""
    def shown(c: str, t: str) -> Column:
        v = F.col(c)
        return F.coalesce(F.format_string("%.2f", v) if t in ("double", "float") else v.cast("string"), F.lit("-"))

    lines = [F.lit(title), *[F.concat(F.lit(f"{c}: "), shown(c, t)) for c, t in figures.dtypes]]
    return figures.select(F.posexplode(F.array(*lines)).alias("n", "line")).withColumn("n", F.col("n") + first)


def most_common(counts: DataFrame, first: str, *names: str) -> DataFrame:
    """``counts`` with ``rank`` (from 1) by falling ``n``; of equal counts the one whose ``first`` is smaller comes first, then by ``names``."""
    return ranked(counts, [], [F.desc("n"), first, *names], "rank").withColumn("rank", F.col("rank") + 1)


def first_of_each(rows: DataFrame, by: str, order: list[str], k: int = 20) -> DataFrame:
    """The first ``k`` rows of each group by ``order``. The engine keeps ``k`` rows a group and task before it shuffles."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")
