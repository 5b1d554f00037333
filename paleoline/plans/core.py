"""Queries of general problems (hierarchies, orphans) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paleoline.operators import hierarchy, orphans
from paleoline.session import materialise, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_links(table(spark, d, "lines"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "lines")).select("id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(materialise(hierarchy.hierarchy(table(spark, d, "lines")), "nodes"))


def _four(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in ("lines", "boundaries", "corrections", "line_deletions")]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The cascade's direct orphans, its level 0."""
    return orphans.orphan_cascade(*_four(spark, d)).where("state = 'direct'").select("table_name", "period", "ref_id", "kind")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_cascade(*_four(spark, d)).groupBy("table_name", "period", "state").agg(F.count("*").alias("refs"))


QUERIES = {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p7_found, p7_report)}

CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_pos DESC) rn FROM lines WHERE id IS NOT NULL) WHERE rn = 1)"
_WALK = f"""WITH RECURSIVE c AS (SELECT id, nonbreaking_next_line p FROM {CURRENT}),
    e AS (SELECT c.id, c.p FROM c SEMI JOIN c d ON c.p = d.id WHERE c.p <> ''),
    w AS (SELECT id, p, [id] path FROM e UNION ALL SELECT w.id, e.p, list_append(w.path, e.id) FROM w JOIN e ON w.p = e.id WHERE NOT list_contains(w.path, e.id)),
    f AS (SELECT id, p, path, len(path) depth, row_number() OVER (PARTITION BY id ORDER BY len(path) DESC) rn FROM w),
    g AS (SELECT f.*, coalesce(list_position(path, p), 0) loop_at FROM f WHERE rn = 1)"""
_MONTH = "strftime({}, '%Y-%m')"

_ORPHANS = f"""r AS (SELECT 'lines' AS table_name, {_MONTH.format("exported_at")} AS period, nonbreaking_next_line AS ref_id FROM {CURRENT}
            UNION SELECT 'boundaries', {_MONTH.format("scored_at")}, boundary_id FROM boundaries
            UNION SELECT 'corrections', {_MONTH.format("corrected_at")}, id FROM corrections),
        f AS (SELECT id, min({_MONTH.format("exported_at")}) first_period FROM lines WHERE id IS NOT NULL GROUP BY id),
        o AS (SELECT * FROM (SELECT table_name, period, ref_id,
            CASE WHEN ref_id IN (SELECT id FROM line_deletions WHERE id IS NOT NULL) THEN 'deleted' WHEN f.id IS NULL THEN 'missing' WHEN f.first_period > period THEN 'late' END AS kind
            FROM r LEFT JOIN f ON f.id = ref_id WHERE ref_id <> '') WHERE kind IS NOT NULL)"""

SQL = {
    "p3_found": _WALK + " SELECT id, CASE WHEN loop_at > 0 THEN list_min(path[loop_at:]) ELSE p END AS root_id, CAST(CASE WHEN loop_at > 0 THEN -1 ELSE depth END AS INT) AS depth FROM g",
    "p3_paths": _WALK
    + """ SELECT id, CASE WHEN loop_at > 0 THEN list_min(path[loop_at:]) ELSE p END AS root_id, CAST(CASE WHEN loop_at > 0 THEN -1 ELSE depth END AS INT) AS depth,
        CASE WHEN loop_at > 0 THEN NULL ELSE array_to_string(list_reverse(list_append(path, p)), '/') END AS path FROM g
        UNION ALL SELECT id, id, 0, id FROM c WHERE id NOT IN (SELECT id FROM e)""",
    "p3_descendants": _WALK
    + """ , u AS (SELECT id, depth, unnest(list_append(path, p)) ancestor, generate_subscripts(list_append(path, p), 1) k FROM g WHERE loop_at = 0)
        SELECT ancestor, id AS descendant, CAST(k - 1 AS INT) AS distance FROM u WHERE k > 1""",
    "p7_found": f"WITH {_ORPHANS} SELECT * FROM o",
    "p7_report": f"""
        WITH RECURSIVE {_ORPHANS},
        l AS (SELECT id, nonbreaking_next_line link, {_MONTH.format("exported_at")} period FROM {CURRENT} WHERE nonbreaking_next_line <> ''),
        b AS (SELECT DISTINCT l.id FROM l JOIN o ON o.table_name = 'lines' AND o.ref_id = l.link AND o.period IS NOT DISTINCT FROM l.period UNION SELECT l.id FROM b JOIN l ON l.link = b.id)
        SELECT table_name, period, state, count(*) AS refs FROM (
            SELECT table_name, period, 'direct' AS state FROM o
            UNION ALL SELECT r.table_name, r.period, 'inherited' FROM r WHERE ref_id IN (SELECT id FROM b)
                AND NOT EXISTS (SELECT 1 FROM o WHERE o.table_name = r.table_name AND o.ref_id = r.ref_id AND o.period IS NOT DISTINCT FROM r.period))
        GROUP BY ALL""",
}
