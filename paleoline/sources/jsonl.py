"""JSON-lines and CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paleoline.schema import LINE_SCHEMA


def read_strict(spark: SparkSession, path: str, schema: str = LINE_SCHEMA) -> DataFrame:
    """Lines of one or many files (a glob); a malformed record fails the query, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str = LINE_SCHEMA) -> DataFrame:
    """Lines without the malformed ones."""
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


def read_verbatim(spark: SparkSession, path: str, schema: str = LINE_SCHEMA) -> DataFrame:
    """Every line as ``ordinal``, ``raw`` and ``row``; ``row`` is null for blank and malformed ones, so a rewrite can keep them.

    ``ordinal`` rises with file and place in the file: partition and row number, not consecutive.
    """
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.col("value").alias("raw"))
    parsed = F.from_json("raw", schema, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json("raw").isNotNull() & F.trim("raw").startswith("{")
    return text.select("ordinal", "raw", F.when(ok, parsed).alias("row"))


def with_file_position(lines: DataFrame) -> DataFrame:
    """Adds ``file_pos``, which rises in reading order."""
    return lines.withColumn("file_pos", F.monotonically_increasing_id())


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON record a line, non-ASCII letters as they are, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(lines: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled, with a header; languages joined by a blank."""
    flat = lines.withColumn("lang", F.array_join("lang", " ")) if "lang" in lines.columns else lines
    flat.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def route(report: DataFrame, paths: dict[str, str], kind: str = "kind") -> None:
    """One input to several outputs by the value of a column; the input is read once from storage each."""
    from paleoline.session import materialise

    held = materialise(report, "routed")
    for value, path in paths.items():
        held.where(F.col(kind) == value).write.mode("overwrite").json(path)


def read_split_cache(spark: SparkSession, path: str, columns: set[str], splits: set[str]) -> DataFrame | None:
    """A cache partitioned by ``split``, or nothing if it is missing or lacks a column or split, so it is built again."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    if not columns <= set(df.columns) or "split" not in df.columns:
        return None
    return df if splits <= {r[0] for r in df.select("split").distinct().collect()} else None


def write_split_cache(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)
