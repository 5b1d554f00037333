"""Session helpers: table access, lineage cuts in shared storage, and size-checked joins."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is sent to every executor only if a count proves it to be at most this many rows.
BROADCAST_ROWS = 200_000

_OWN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables.

    The session's ``spark.checkpoint.dir`` comes first, then a checkpoint folder set on the context. Only where neither is
    set, one below the warehouse is chosen, which the executors share; it is removed when the program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if (app := spark.sparkContext.applicationId) not in _OWN:
            _OWN.add(app)
            atexit.register(_drop_at_end, spark, f"{base}/paleoline/{app}")
    return f"{base.rstrip('/')}/paleoline/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage in one pass, survives the loss of executors, and lets later stages prune columns.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_at_end(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, path)


def release(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialise` wrote and that nothing still to be computed reads, such as those of a past round."""
    for t in tables:
        if path := getattr(t, "_scratch_path", None):
            _delete(t.sparkSession, path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every intermediate table of this application."""
    _delete(spark, scratch_dir(spark))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows. The count stops at the bound, so it stays cheap on a large table."""
    return df.limit(rows + 1).count() <= rows


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if :func:`is_small`; unchanged, so joined by shuffle, beyond that."""
    return F.broadcast(df) if is_small(df, rows) else df


def current(lines: DataFrame, *cols: str | Column, key: str = "id", order: str = "file_pos") -> DataFrame:
    """Last-writer-wins view: of the rows with the same ``key``, the one with the greatest ``order``.

    Rows without key are left out. A null ``order`` counts as the smallest. If several rows share the greatest one, one of
    them is kept, chosen by the values themselves, first by a column named ``doc_id``, so the result doesn't depend on partitioning.
    """
    picked = [F.col(c) if isinstance(c, str) else c for c in cols]
    narrow = lines.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(order).alias("_order"), *picked)
    names = [c for c in narrow.columns if c not in ("_key", "_order")]
    ties = [F.col("doc_id").asc_nulls_first()] if "doc_id" in names else []
    ties += [F.xxhash64(*names)] if names else [F.lit(0)]
    w = Window.partitionBy("_key").orderBy(F.col("_order").desc_nulls_last(), *ties)
    return narrow.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(F.col("_key").alias(key), *names)
