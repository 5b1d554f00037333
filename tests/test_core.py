import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from paleoline.operators import hierarchy, orphans
from paleoline.operators.components import components
from tests.conftest import rows


def brute_links(link):
    """id -> (root, depth) by following links."""
    out = {}
    for i, p in link.items():
        if not p or p not in link:
            continue
        seen, x = [], i
        while x not in seen and link.get(x) and link[x] in link:
            seen.append(x)
            x = link[x]
        out[i] = (min(seen[seen.index(x) :]), -1) if x in seen else (x, len(seen))
    return out


def test_links_against_brute_force(spark, make_lines):
    rng = random.Random(3)
    ids = [f"L{k:03d}" for k in range(160)]
    link = {i: rng.choice([*ids, "", "nowhere", None]) for i in ids}
    for k in range(30):  # a long chain
        link[ids[k]] = ids[k + 1]
    link[ids[30]] = ""
    link["self"] = "self"
    df = make_lines([{"id": i, "nonbreaking_next_line": p} for i, p in link.items()])
    got = {r["id"]: (r["root_id"], r["depth"]) for r in hierarchy.resolve_links(df).collect()}
    assert got == brute_links(link)
    nodes = {r["id"]: r for r in hierarchy.hierarchy(df).collect()}
    assert set(nodes) == set(link)
    assert nodes[ids[0]]["path"] == ids[30::-1] if brute_links(link)[ids[0]][1] == 30 else True
    pairs = {(r["ancestor"], r["descendant"]): r["distance"] for r in hierarchy.descendants(hierarchy.hierarchy(df)).collect()}
    assert pairs[(ids[30], ids[0])] == 30
    assert nodes["self"]["depth"] == -1 and nodes["self"]["path"] is None


def test_links_nulls_repeats_and_empty(spark, make_lines):
    df = make_lines([{"id": None, "nonbreaking_next_line": "a"}, {"id": "a"}, {"id": "b", "nonbreaking_next_line": "nowhere"}, {"id": "b", "nonbreaking_next_line": "a", "file_pos": 9}, {"id": "b", "nonbreaking_next_line": "a", "file_pos": 9}, {"id": "c", "nonbreaking_next_line": None, "file_pos": None}])
    assert rows(hierarchy.resolve_links(df)) == [("b", "a", 1)]
    assert hierarchy.resolve_links(make_lines([])).count() == 0
    assert hierarchy.hierarchy(make_lines([])).count() == 0


def tables(spark, make_lines, lines, boundaries=(), corrections=(), deletions=()):
    ts = "timestamp"
    return (
        make_lines(lines),
        spark.createDataFrame(list(boundaries), f"boundary_id string, scored_at {ts}, id string, kind string"),
        spark.createDataFrame(list(corrections), f"id string, corrected_at {ts}, period string"),
        spark.createDataFrame(list(deletions), f"id string, deleted_at {ts}"),
    )


def test_orphans_kinds_and_cascade(spark, make_lines):
    jan, mar = dt.datetime(2024, 1, 5), dt.datetime(2024, 3, 5)
    lines = [
        {"id": "a", "nonbreaking_next_line": "gone", "exported_at": jan}, {"id": "b", "nonbreaking_next_line": "a", "exported_at": jan}, {"id": "c", "nonbreaking_next_line": "b", "exported_at": jan},
        {"id": "d", "nonbreaking_next_line": "late", "exported_at": jan}, {"id": "late", "exported_at": mar}, {"id": "del", "exported_at": jan}, {"id": "e", "nonbreaking_next_line": "del", "exported_at": None},
        {"id": "f", "nonbreaking_next_line": "f", "exported_at": jan}, {"id": "g", "nonbreaking_next_line": " ", "exported_at": jan}, {"id": "h", "nonbreaking_next_line": "undated", "exported_at": jan}, {"id": "undated", "exported_at": None},
    ]
    t = tables(spark, make_lines, lines, [("late", jan, "x", "y"), ("late", mar, "x", "y"), ("", jan, None, None), (None, jan, None, None), ("c", jan, None, None)], [("gone", None, "p"), ("gone", None, "p"), ("a", mar, "p")], [("del", jan), (None, None), ("del", mar)])
    direct = rows(orphans.orphan_references(*t))
    want = [("boundaries", "2024-01", "late", "late"), ("corrections", None, "gone", "missing"), ("lines", "2024-01", " ", "missing"), ("lines", "2024-01", "gone", "missing"), ("lines", "2024-01", "late", "late"), ("lines", None, "del", "deleted")]
    assert direct == sorted(want, key=str)
    cascade = {(r["table_name"], r["ref_id"]): (r["state"], r["level"]) for r in orphans.orphan_cascade(*t).collect()}
    assert cascade[("lines", "a")] == ("inherited", 1) and cascade[("lines", "b")] == ("inherited", 2)
    assert cascade[("boundaries", "c")] == ("inherited", 3) and cascade[("corrections", "a")] == ("inherited", 1)
    assert ("lines", "f") not in cascade and cascade[("lines", "gone")] == ("direct", 0)


def test_orphans_empty(spark, make_lines):
    t = tables(spark, make_lines, [])
    assert orphans.orphan_references(*t).count() == 0 and orphans.orphan_cascade(*t).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 12)), max_size=40))
def test_components_against_union_find(pairs):
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    data = [(f"n{n:02d}", f"e{e}" if e else None) for n, e in pairs]
    parent = {n: n for n, _ in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for n, e in data:
        if e:
            a, b = find(n), find(by.setdefault(e, n))
            parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["group"] for r in components(spark.createDataFrame(data, "doc_id string, entity string")).collect()}
    assert got == {n: find(n) for n in parent}
