"""References to rows that do not exist, and the rows that inherit the fault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paleoline.session import materialise


def _current_with_first(lines: DataFrame) -> DataFrame:
    """One row an id: the current row's link and month, and the month of the id's earliest export."""
    month = F.date_format("exported_at", "yyyy-MM")
    last = F.max_by(F.struct(F.col("nonbreaking_next_line").alias("link"), month.alias("period")), F.coalesce("file_pos", F.lit(-1)))
    return lines.where("id is not null").groupBy("id").agg(last.alias("last"), F.min(month).alias("first_period")).select("id", "last.link", "last.period", "first_period")


def orphan_references(lines: DataFrame, boundaries: DataFrame, corrections: DataFrame, line_deletions: DataFrame) -> DataFrame:
    """Distinct orphan references: ``table_name``, ``period``, ``ref_id``, ``kind``.

    References are ``nonbreaking_next_line`` of current lines, and ``boundary_id`` and ``id`` of any row of the other two
    tables. ``kind`` is ``deleted`` if the id is in ``line_deletions``, else ``missing`` if ``lines`` has no such id, else
    ``late`` if its earliest export lies in a later month than ``period``; all other references are left out.

    Defined cases: null and empty references are none; ids are compared as written, so one of blanks is missing; a null
    timestamp gives a null ``period``, which can be ``deleted`` or ``missing`` but not ``late``, nor can an id all of whose
    exports are undated; repeated rows count once; empty tables are allowed.

    References are made distinct before they meet the ids, so a reference that a third of all rows share is one row.
    """
    cur = _current_with_first(lines)
    month = lambda c: F.date_format(c, "yyyy-MM").alias("period")
    refs = reduce(
        DataFrame.unionByName,
        (
            cur.select(F.lit("lines").alias("table_name"), "period", F.col("link").alias("ref_id")),
            boundaries.select(F.lit("boundaries").alias("table_name"), month("scored_at"), F.col("boundary_id").alias("ref_id")),
            corrections.select(F.lit("corrections").alias("table_name"), month("corrected_at"), F.col("id").alias("ref_id")),
        ),
    )
    refs = refs.where("ref_id <> ''").distinct()
    gone = line_deletions.where("id is not null").select(F.col("id").alias("ref_id")).distinct().withColumn("gone", F.lit(True))
    known = cur.select(F.col("id").alias("ref_id"), "first_period", F.lit(True).alias("known"))
    kind = F.when(F.col("gone"), "deleted").when(F.col("known").isNull(), "missing").when(F.col("first_period") > F.col("period"), "late")
    return refs.join(known, "ref_id", "left").join(gone, "ref_id", "left").select("table_name", "period", "ref_id", kind.alias("kind")).where("kind is not null")


def orphan_cascade(lines: DataFrame, boundaries: DataFrame, corrections: DataFrame, line_deletions: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """Every orphaned reference with ``state`` ``direct`` or ``inherited`` and the ``level`` of the cascade.

    A line whose link is orphaned is itself orphaned, so whatever refers to that line inherits the fault, and so on down
    the foreign-key graph until nothing is added. Result: ``table_name``, ``period``, ``ref_id``, ``kind`` (null for
    inherited ones), ``state``, ``level`` (0 for direct ones, else the number of links to the line that holds the direct one). A reference that is orphaned
    directly isn't listed as inherited. Lines whose links end or loop without an orphaned one are sound.

    Each round's semi-joins go twice as far down the links as the last; as lines at every smaller distance exist, a round
    that finds none ends the fixpoint.
    """
    direct = materialise(direct if direct is not None else orphan_references(lines, boundaries, corrections, line_deletions), "orphans")
    cur = materialise(_current_with_first(lines).where("link <> ''").select("id", "link", "period"), "orphan-links")
    own = direct.where("table_name = 'lines'").select(F.col("ref_id").alias("link"), F.col("period"))
    own = cur.join(own, [cur.link == own.link, cur.period.eqNullSafe(own.period)], "left_semi").select("id", F.lit(0).alias("level"))
    bad = [materialise(own, "orphan-lines-0")]
    todo = materialise(cur.select("id", F.col("link").alias("to")).join(bad[0], "id", "left_anti"), "orphan-todo-0")
    jump = 1
    while True:
        far = reduce(DataFrame.unionByName, bad).select(F.col("id").alias("to"), F.lit(None).cast("string").alias("next"), "level")
        far = far.unionByName(todo.select(F.col("id").alias("to"), F.col("to").alias("next"), F.lit(None).cast("int").alias("level")))
        step = materialise(todo.join(far, "to").select("id", F.col("next").alias("to"), (F.col("level") + jump).alias("level")), f"orphan-step-{jump}")
        new = step.where("level is not null").select("id", "level")
        if new.isEmpty():
            break
        bad.append(new)
        todo = step.where("level is null").select("id", "to")
        jump *= 2
    bad = reduce(DataFrame.unionByName, bad).select(F.col("id").alias("ref_id"), "level")
    month = lambda c: F.date_format(c, "yyyy-MM").alias("period")
    refs = cur.select(F.lit("lines").alias("table_name"), "period", F.col("link").alias("ref_id"))
    refs = refs.unionByName(boundaries.select(F.lit("boundaries").alias("table_name"), month("scored_at"), F.col("boundary_id").alias("ref_id")))
    refs = refs.unionByName(corrections.select(F.lit("corrections").alias("table_name"), month("corrected_at"), F.col("id").alias("ref_id"))).where("ref_id <> ''").distinct()
    late = refs.join(bad, "ref_id").select("table_name", "period", "ref_id", F.lit(None).cast("string").alias("kind"), F.lit("inherited").alias("state"), (F.col("level") + 1).alias("level"))
    d = direct.select("table_name", "period", "ref_id")
    on = [late.table_name == d.table_name, late.period.eqNullSafe(d.period), late.ref_id == d.ref_id]
    return late.join(d, on, "left_anti").unionByName(direct.select("table_name", "period", "ref_id", "kind", F.lit("direct").alias("state"), F.lit(0).alias("level")))
