"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paleoline.session import current, materialise


def _edges(lines: DataFrame, parent: str, weight: str | None) -> DataFrame:
    cur = current(lines, F.col(parent).alias("parent"), *([F.col(weight).cast("bigint").alias("total")] if weight else []))
    links = cur.where("parent <> ''")
    return links.join(cur.select(F.col("id").alias("parent")), "parent", "left_semi")


def resolve_links(lines: DataFrame, parent: str = "nonbreaking_next_line", with_path: bool = False, weight: str | None = None) -> DataFrame:
    """Root and depth of every row of ``lines`` whose link is the id of an existing row.

    ``lines`` needs ``id``, ``file_pos`` and the link column; other columns are ignored. Result: ``id``, ``root_id``,
    ``depth``, with ``with_path`` ``path`` (ids from the root down to the row: a chain of n rows has n * (n + 1) / 2 ids in
    its paths, which is what full paths are), and with ``weight`` ``total``, the sum of
    that column from the row up to, without, the root.

    Defined cases: rows with null id are left out; of repeated ids the current row counts; a null or empty link, or one
    that names no row, makes its row a root, which isn't in this result; a row that links to itself is a loop of one. For
    rows on a loop or leading into one, ``depth`` is -1, ``root_id`` the smallest id on the loop, and ``path`` and ``total`` null. An
    empty table gives no rows.

    Every round joins the open rows' pointers with all pointers, which doubles the jump length; ancestors of an open row
    have every smaller depth, so a round that closes none proves that all open rows lead into loops. From there only those
    rows are doubled further, with the least id on the way, until the jump is as long as their number. Each round's rows
    are written to shared storage; a hot parent only makes its children's side of the join large, which adaptive execution splits.
    """
    add = {**({"path": F.concat} if with_path else {}), **({"total": lambda a, b: F.col(a) + F.col(b)} if weight else {})}
    path = list(add)
    e = _edges(lines, parent, weight).withColumn("path", F.array("id")).select("id", F.col("parent").alias("anc"), F.lit(1).alias("dist"), *path)
    e = materialise(e, "links")

    heads = e.select(F.col("id").alias("anc"), F.lit(1).alias("open"))
    first = materialise(e.join(heads, "anc", "left"), "links-0")
    done = [first.where("open is null").select("id", F.col("anc").alias("root_id"), F.col("dist").alias("depth"), *path)]
    todo = first.where("open = 1").select("id", "anc", "dist", *path)
    n_open, rnd = todo.count(), 0
    while n_open:
        rnd += 1
        closed = reduce(DataFrame.unionByName, done).select(F.col("id").alias("anc"), F.col("root_id").alias("to"), F.col("depth").alias("more"), F.lit(True).alias("closed"), *[F.col(p).alias(f"rest_{p}") for p in path])
        still = todo.select(F.col("id").alias("anc"), F.col("anc").alias("to"), F.col("dist").alias("more"), F.lit(False).alias("closed"), *[F.col(p).alias(f"rest_{p}") for p in path])
        step = todo.join(closed.unionByName(still), "anc").select("id", F.col("to").alias("anc"), (F.col("dist") + F.col("more")).alias("dist"), "closed", *[f(p, f"rest_{p}").alias(p) for p, f in add.items()])
        step = materialise(step, f"links-{rnd}")
        done.append(step.where("closed").select("id", F.col("anc").alias("root_id"), F.col("dist").alias("depth"), *path))
        todo = step.where("not closed").drop("closed")
        left = todo.count()
        if left == n_open:
            break
        n_open = left
    out = reduce(DataFrame.unionByName, done)
    if with_path:
        out = out.withColumn("path", F.reverse(F.concat("path", F.array("root_id"))))
    if n_open:
        loops = _loops(todo.select("id"), e.select("id", "anc"), n_open)
        out = out.unionByName(loops.select("id", "root_id", F.lit(-1).alias("depth"), *[F.lit(None).cast({"path": "array<string>", "total": "bigint"}[p]).alias(p) for p in path]))
    return out


def _loops(ids: DataFrame, e: DataFrame, n: int) -> DataFrame:
    """Smallest id of the loop that each of ``n`` rows, none of which has a root, leads into."""
    state = e.join(ids, "id", "left_semi").withColumn("least", F.col("id"))
    jump, rnd = 1, 0
    while jump < n:
        far = state.select(F.col("id").alias("anc"), F.col("anc").alias("to"), F.col("least").alias("m"))
        state = state.join(far, "anc").select("id", F.col("to").alias("anc"), F.least("least", "m").alias("least"))
        jump, rnd = jump * 2, rnd + 1
        if rnd % 2 == 0:
            state = materialise(state, f"loops-{rnd}")
    state = materialise(state, "loops")
    return state.select("id", "anc").join(state.select(F.col("id").alias("anc"), F.col("least").alias("root_id")), "anc").select("id", "root_id")


def hierarchy(lines: DataFrame, parent: str = "nonbreaking_next_line") -> DataFrame:
    """Every id with ``root_id``, ``depth`` and ``path``; roots have depth 0 and a path of themselves.

    Loops as in :func:`resolve_links`: depth -1, path null.
    """
    linked = materialise(resolve_links(lines, parent, with_path=True), "hierarchy")
    roots = current(lines).join(linked.select("id"), "id", "left_anti")
    return linked.unionByName(roots.select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.array("id").alias("path")))


def descendants(nodes: DataFrame) -> DataFrame:
    """(``ancestor``, ``descendant``, ``distance``) for all pairs, from the paths of :func:`hierarchy`.

    Rows on loops have no path and so are in no pair. Nothing is gathered by ancestor: each row unfolds its own path.
    """
    up = nodes.where("path is not null").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return up.where("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
