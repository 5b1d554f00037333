"""Comparing exports, and diagnostics of line starts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paleoline.functions.align import unescape_nfc
from paleoline.functions.text import FOLD_DIAG, fold, fold_markers
from paleoline.session import current


def same_text(a: Column, b: Column) -> Column:
    """Equality modulo letter classes and markers; two nulls are equal."""
    return fold_markers(a).eqNullSafe(fold_markers(b))


def blank_only(a: Column, b: Column) -> Column:
    """Whether texts differ in nothing but blanks (modulo letter classes and markers); null counts as empty."""
    bare = lambda x: F.regexp_replace(fold_markers(F.coalesce(x, F.lit(""))), r"(?U)\s+", "")
    return bare(a) == bare(b)


def compare_exports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of ``b`` (``id``, ``source``, ``target``, ``target_corr``) against the line of the same id in ``a``.

    Texts are compared with character references resolved and in canonical composition. ``status`` is ``missing_in_A``, ``match`` or ``differences_found``; ``details`` maps a differing field to its values
    ``A`` and ``B``. The source pair is listed if it differs or if a target does. Null equals null only.
    """
    left = b.select("id", F.col("source").alias("bs"), F.col("target").alias("bt"), F.col("target_corr").alias("bc"))
    right = a.select("id", F.col("source_sic").alias("as"), F.col("target_sic").alias("at"), F.col("target_corr").alias("ac"), F.lit(True).alias("hit"))
    j = _normalised(left.join(right, "id", "left"), ("as", "at", "ac", "bs", "bt", "bc"))
    target, corr, source = (~same_text(F.col(x), F.col(y)) for x, y in (("at", "bt"), ("ac", "bc"), ("as", "bs")))
    pair = lambda x, y: F.struct(F.col(x).alias("A"), F.col(y).alias("B"))
    every = F.create_map(F.lit("target"), pair("at", "bt"), F.lit("target_corr"), pair("ac", "bc"), F.lit("source"), pair("as", "bs"))
    some = F.map_filter(every, lambda k, v: ((k == "target") & target) | ((k == "target_corr") & corr) | ((k == "source") & (source | target | corr)))
    odd = F.col("hit") & (target | corr | source)
    return j.select("id", F.when(F.col("hit").isNull(), "missing_in_A").when(odd, "differences_found").otherwise("match").alias("status"), F.when(odd, some).alias("details"))


def _normalised(rows: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """``rows`` with character references resolved and letters composed in ``cols``; rows that need neither stay inside the engine."""
    odd = reduce(lambda x, y: x | y, [F.coalesce(F.col(c).rlike(r"&|[^\x00-\u02ff\u1e00-\u1eff\u2000-\u206f\u2983\u2984]"), F.lit(False)) for c in cols])
    return rows.where(~odd).unionByName(rows.where(odd).withColumns({c: unescape_nfc(c) for c in cols}))


def triage(report: DataFrame) -> DataFrame:
    """Rows with differences as ``id``, ``kind``: ``blank_only`` if every listed field differs in blanks alone, else ``real``."""
    some = report.where("status = 'differences_found'")
    return some.select("id", F.when(F.forall(F.map_values("details"), lambda v: blank_only(v["A"], v["B"])), "blank_only").otherwise("real").alias("kind"))


def lookback_links(lines: DataFrame, reach: int = 25) -> DataFrame:
    """Lines whose source and target begin with different letters, with the nearest of the ``reach`` rows before them in file order that links to them.

    Result: ``id``, ``preceding_id``, ``last_src_token``, ``last_trg_token``; lines without such a row are left out. Rows
    are those of the export itself, so older states and repeated rows count. An equi-join on the link with a bound on the
    distance; each current row meets only rows that name it.
    """
    rows = lines.select("id", "nonbreaking_next_line", "file_pos", "source_sic", "target_sic")
    first = lambda c: fold(F.left(c, F.lit(1)), FOLD_DIAG)
    cur = rows.where("source_sic <> '' and target_sic <> ''").where(first("source_sic") != first("target_sic")).select("id", "file_pos")
    token = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)(\S+)\s*$", 1)
    prev = rows.where("nonbreaking_next_line <> ''").select(F.col("nonbreaking_next_line").alias("id"), F.col("id").alias("p"), F.col("file_pos").alias("at"), token("source_sic").alias("s"), token("target_sic").alias("t"))
    near = cur.join(prev, "id").where(f"file_pos - at between 1 and {reach}")
    best = near.groupBy("id", "file_pos").agg(F.max_by(F.struct("p", "s", "t"), "at").alias("x"))
    return best.select("id", F.col("x.p").alias("preceding_id"), F.col("x.s").alias("last_src_token"), F.col("x.t").alias("last_trg_token"))


def apply_corrections(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """Current lines with the views of the latest correction of their id: a hit overwrites even with null."""
    cur = current(lines, "source_corr", "target_sic", "target_corr")
    fix = current(corrections, F.col("new_source_corr"), F.col("new_target_sic"), F.col("new_target_corr"), F.lit(True).alias("hit"), order="corrected_at")
    j = cur.join(fix, "id", "left")
    return j.select("id", *[F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("source_corr", "target_sic", "target_corr")])
