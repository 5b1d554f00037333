"""Document order and neighbours without a task per document.

A document may hold a third of all lines, so no window here is partitioned by document alone. Rows are range-partitioned
by group and key, numbered within each partition, and the partitions' sizes give the offsets; neighbours are found in
blocks of fixed length, to which the rows at the edges of the next blocks are copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paleoline.functions.text import line_key
from paleoline.session import current, materialise, small_or_plain

BLOCK = 4096


def ranked(df: DataFrame, group: list[str], order: list[Column | str], name: str = "pos") -> DataFrame:
    """``df`` with the position (from 0) of each row within its ``group`` by ``order``, written to shared storage.

    Ties are broken by a hash of the row. Nulls sort first; rows with null group columns form groups of their own.
    """
    tie = F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])
    keys = [*[F.col(g).asc_nulls_first() for g in group], *[F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order], tie]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    spread = materialise(spread, "ranked")
    parts = spread.groupBy("_p", *group).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1) if group else Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).select("_p", *[F.col(g).alias(f"_g_{g}") for g in group], "_off")
    parts = materialise(parts, "rank-offsets")
    on = [spread["_p"] == parts["_p"], *[spread[g].eqNullSafe(parts[f"_g_{g}"]) for g in group]]
    return spread.join(small_or_plain(parts), on).withColumn(name, F.col("_i") + F.col("_off")).select(*df.columns, name)


def document_order(lines: DataFrame, *cols: str) -> DataFrame:
    """Current lines with ``doc_id``, ``k`` (parsed id), ``pos`` in the document, and ``cols``.

    Null texts among ``cols`` stay null; lines without id are left out; malformed ids sort first in their document.

    Only ids, documents and keys are ranked; the other columns are shuffled once, by id, where the current row is picked,
    and meet the positions there.
    """
    keys = current(lines, "doc_id", "file_pos").withColumn("k", line_key("id"))
    place = ranked(keys, ["doc_id"], ["k", "file_pos"])
    extra = [c for c in dict.fromkeys(cols) if c not in ("id", "doc_id", "file_pos")]
    if extra:
        place = current(lines, "doc_id", *extra).drop("doc_id").join(place, "id").select("id", "doc_id", *extra, "file_pos", "k", "pos")
    return materialise(place, "ordered")


def with_neighbours(df: DataFrame, group: list[str], cols: dict[str, tuple[Column, int]], pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """``df`` with, for each name, the column's value in the row at an offset (-/+) by ``pos`` within ``group``."""
    reach = max(abs(n) for _, n in cols.values())
    b = (F.col(pos) / block).cast("bigint")
    here = F.col(pos) % block
    copies = F.filter(F.array(F.lit(0), F.when((here < reach) & (b > 0), -1), F.when(here >= block - reach, 1)), lambda x: x.isNotNull())
    spread = df.withColumn("_d", F.explode(copies)).withColumn("_b", b + F.col("_d"))
    w = Window.partitionBy(*group, "_b").orderBy(pos)
    out = spread.select("*", *[(F.lead(c, n) if n > 0 else F.lag(c, -n)).over(w).alias(name) for name, (c, n) in cols.items()])
    return out.where("_d = 0").drop("_d", "_b")
