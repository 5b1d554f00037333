"""A few queries against their SQL on the smallest tables; the driver compares all of them at a larger scale."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = ["dedup_last_writer", "linked_pairs", "boundary_counts", "lexicon_hits", "export_diff", "lookback_links", "apply_corrections", "prf_by_lang", "pr_curve", "error_samples", "p3_found", "p7_found", "p7_report", "first_lines", "zipped_views", "eval_examples", "chain_report", "boundary_figures", "leaping_chains", "xml_cases", "xml_process", "byte_tokens", "character_table", "abbreviation_letters"]


def plain(v):
    if v is None or v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert sorted(tuple(map(plain, r)) for r in df.select(*cols).collect()) == sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    same_as_sql(spark, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
