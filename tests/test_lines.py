import random

import pytest
from pyspark.sql import functions as F

from paleoline.functions import align
from paleoline.functions import text as tx
from paleoline.operators import chains as ch
from paleoline.operators import compare as cp
from paleoline.operators import examples as ex
from paleoline.operators import order as od
from paleoline.operators import repair as rp
from paleoline.operators.infer import run_pipeline, split_back
from tests.conftest import rows


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_line_key(spark):
    k = one(spark, tx.line_key(F.lit("W0013-A-0125-lb-m003")).alias("k"), tx.line_key(F.lit("a-b-00-7-lb-12")).alias("l"), tx.line_key(F.lit("")).alias("m"), tx.line_key(F.lit("xyz")).alias("n"))
    assert tuple(k["k"]) == ("W0013", None, 125, True, 3)
    assert tuple(k["l"]) == ("a-b", 0, 7, False, 12)
    assert k["m"]["page"] is None and k["n"]["seq"] is None


def test_text_functions(spark):
    r = one(
        spark, tx.last_plain(F.lit("abcẽſ")).alias("a"), tx.last_token(F.lit("uno dos ")).alias("b"), tx.first_token(F.lit("  x y")).alias("c"), tx.has_abbreviation_letters(F.lit("abc")).alias("d"),
        tx.fold_markers(F.lit("⦃vſ⦄ꝗ")).alias("e"), tx.bare_word(F.lit("(Quod);")).alias("f"), tx.wrapped(F.lit(" a \n b ")).alias("g"), tx.last_plain(F.lit("ẽ")).alias("h"),
    )
    assert tuple(r) == ("c", "dos", "x", False, "usq", "quod", "⦃a b⦄", None)


def brute_chains(order, link):
    """Visit in order, take what isn't taken."""
    pos, taken, out = {i: k for k, i in enumerate(order)}, set(), {}
    for i in order:
        if i in taken:
            continue
        x, n = i, 0
        while x in pos and x not in taken:
            taken.add(x)
            out[x] = (pos[i], n)
            x, n = link.get(x), n + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_chains_against_brute_force(spark, make_lines, seed):
    rng = random.Random(seed)
    ids = [f"W1-00-0001-lb-{k:04d}" for k in range(60)]
    link = {i: (ids[k + 1] if k + 1 < 60 and rng.random() < 0.5 else rng.choice([*ids, "", None, "nowhere"])) for k, i in enumerate(ids)}
    df = make_lines([{"id": i, "nonbreaking_next_line": p} for i, p in link.items()], extra=False)
    got = {r["id"]: (r["head_pos"], r["pos_in_chain"]) for r in ch.chains(od.document_order(df, "nonbreaking_next_line")).collect()}
    assert got == brute_chains(ids, link)


def test_neighbours_cross_blocks(spark):
    df = spark.createDataFrame([("d", k) for k in range(50)], "doc_id string, pos bigint")
    out = od.with_neighbours(df, ["doc_id"], {"a": (F.col("pos"), 1), "b": (F.col("pos"), -2)}, block=8)
    assert rows(out, "pos", "a", "b") == sorted(((k, k + 1 if k < 49 else None, k - 2 if k > 1 else None) for k in range(50)), key=str)


def test_budget_windows_against_loop(spark, make_lines):
    rng = random.Random(5)
    ids = [f"W1-00-0001-lb-{k:04d}" for k in range(40)]
    size = [rng.randint(1, 200) for _ in ids]
    df = make_lines([{"id": i, "source_sic": "ä" * (n // 2) + "x" * (n % 2), "nonbreaking_next_line": ids[k + 1] if k % 3 == 0 and k < 39 else ""} for k, (i, n) in enumerate(zip(ids, size))], extra=False)
    o = od.document_order(df, "nonbreaking_next_line", "source_sic")
    c = ch.chains(o)
    got = {r["head_pos"]: (r["n_before"], r["n_after"], r["n_bytes"]) for r in ex.budget_windows(o, c).collect()}
    for h, (b, a, total) in got.items():
        chain = [h, h + 1] if h % 3 == 0 and h < 39 else [h]
        before, after = list(range(max(0, h - 2), h)), list(range(chain[-1] + 1, min(40, chain[-1] + 3)))
        byte = lambda x: sum(size[k] for k in x) + len(x) - 1
        while byte(before + chain + after) > 480 and after:
            after.pop()
        while byte(before + chain + after) > 480 and before:
            before.pop(0)
        assert (b, a, total) == (len(before), len(after), byte(before + chain + after))


def test_rendered_windows_come_back(spark, make_lines):
    ids = [f"W1-00-0001-lb-{k:04d}" for k in range(12)]
    df = make_lines([{"id": i, "source_sic": f"text {k}" if k != 5 else None, "nonbreaking_next_line": ids[k + 1] if k in (2, 3, 7) else ""} for k, i in enumerate(ids)], extra=False)
    o = od.document_order(df, "nonbreaking_next_line", "source_sic")
    c = ch.chains(o)
    w = ex.budget_windows(o, c)
    assert rows(split_back(o, c, w, lambda x: x)) == sorted((i, f"text {k}" if k != 5 else "") for k, i in enumerate(ids))
    broken = split_back(o, c, w, lambda x: x.withColumn("source", F.lit("one¬too↵many¬parts↵here¬a¬b¬c¬d¬e¬f")))
    assert rows(broken) == sorted((i, f"text {k}" if k != 5 else "") for k, i in enumerate(ids))


def test_pipeline_with_own_models(spark, make_lines):
    ids = [f"W1-00-0001-lb-{k:04d}" for k in range(6)]
    df = make_lines([{"id": i, "source_sic": t, "target_corr": t} for i, t in zip(ids, ["volun", "tas et ⦃q̃⦄", "fin.", "alia", "", None])], extra=False)
    score = lambda p: p.withColumn("prob", F.when(F.col("line_end") == "volun", 1.0).otherwise(0.0))
    expand = lambda w: w.withColumn("source", F.replace("source", F.lit("⦃q̃⦄"), F.lit("que")))
    got = {r["id"]: (r["predicted_next_line"], r["expanded_text"]) for r in run_pipeline(df, score=score, expand=expand).collect()}
    assert got[ids[0]] == (ids[1], "volun") and got[ids[1]] == ("", "tas et que") and got[ids[5]] == ("", "")


GLYPHS = [
    ("ego autem videns eius ſalutarem ⦃intentionẽ", "ego autem videns eius salutarem intentionen", "ego autem videns eius ſalutarem intentionen"),
    ("do⦄ illi ſumptus neceſſarios", "do illi sumptus necessarios", "do illi ſumptus neceſſarios"), ("cælum", "caelum", "cælum"), ("caelum", "caelum", "caelum"), ("pœna", "poena", "pœna"),
    ("ſæculo", "saeculo", "ſæculo"), ("Æneas", "AEneas", "Æneas"), ("", "abc", "abc"), ("ſ", "", ""),
]


@pytest.mark.parametrize("source,target,want", GLYPHS)
def test_glyphs(source, target, want):
    assert align.restore(source, target) == want


def test_spans_and_alignment():
    assert align.parse_spans("a⦃b⦄c⦄d⦃e") == ("abcd⦃e", [(1, 2)])
    assert align.align_spans("dixit ⦃q̃⦄ est", "dixit qui est", "dixit que est") == [{"abbr": "q̃", "gold": "que", "predicted": "qui"}]
    assert align.differing("abc", "abd") == [{"a": "c", "b": "d"}] and align.differing("uſ", "vs") == []
    assert align.changed_words("el señor dixo", "el senor dixo") == [(3, 8, 3, 8)]


def test_map_break():
    assert align.map_break("volũtas", "voluntas", 4) == 5
    assert align.map_break("abc", "abc", 0) == 0 and align.map_break("", "abc", 0) == 0 and align.map_break("abc", "abcd", 3) == 4
    assert align.break_in_expansion("ẽẽab", "xyzqab", 3) == 5


def pair(*views):
    return rp.Line(*views[:4]), rp.Line(*views[4:])


def test_repairs_keep_the_text():
    a, b = pair("et volun", "et volun", "et volu", "et volu", "tas est", "tas est", "ntas est", "ntas est")
    assert rp.repair_pair(a, b) == "A" and (a.target_sic, b.target_sic, a.target_corr) == ("et volun", "tas est", "et volun")
    a, b = pair("et volu", "et volu", "et volun", "et volun", "ntas", "ntas", "tas", "tas")
    assert rp.repair_pair(a, b) == "B" and (a.target_sic, b.target_corr) == ("et volu", "ntas")
    a, b = pair("et volũ", "et volũ", "et volu", "et volu", "tas", "tas", "ntas", "ntas")
    before = a.target_sic + b.target_sic
    assert rp.repair_pair(a, b) in ("A", "C") and a.target_sic + b.target_sic == before and a.target_sic == "et volun"
    a, b = pair("et peccatu", "et peccatu", "et peccatu", "et peccatu", "m", "m", "m", "m")
    assert rp.repair_pair(a, b) == ""
    a, b = pair("restaut", "restituti", "restaut", "restituti", "io", "o", "io", "o")
    kinds = rp.repair_pair(a, b)
    assert a.source_corr + b.source_corr == "restitutio" and a.target_corr + b.target_corr == "restitutio" and kinds in ("", "D")


def test_repairs_hand_over_along_a_chain(spark, make_lines):
    v = lambda s, t: {"source_sic": s, "source_corr": s, "target_sic": t, "target_corr": t}
    df = make_lines([{"id": "W1-00-0001-lb-0001", "nonbreaking_next_line": "W1-00-0001-lb-0002", **v("et volun", "et volu")}, {"id": "W1-00-0001-lb-0002", "nonbreaking_next_line": "W1-00-0001-lb-0003", **v("tas reg", "ntas re")}, {"id": "W1-00-0001-lb-0003", **v("num", "gnum")}, {"id": "x", "nonbreaking_next_line": "W1-00-0001-lb-0003", **v(None, None)}])
    got = {r["id"]: r["target_sic"] for r in rp.break_repairs(df).collect()}
    assert got["W1-00-0001-lb-0001"] == "et volun" and got["W1-00-0001-lb-0002"] == "tas reg" and got["W1-00-0001-lb-0003"] == "num"
    assert rp.break_repairs(make_lines([])).count() == 0


def test_compare_and_corrections(spark, make_lines):
    a = make_lines([{"id": "1", "source_sic": "uſ", "target_sic": "us", "target_corr": "us"}, {"id": "2", "source_sic": "a", "target_sic": "a b", "target_corr": None}])
    b = spark.createDataFrame([("1", "vs", "vs", "⦃us⦄"), ("2", "a", "ab", None), ("3", None, None, None)], "id string, source string, target string, target_corr string")
    r = cp.compare_exports(a, b)
    assert rows(r, "id", "status") == [("1", "match"), ("2", "differences_found"), ("3", "missing_in_A")]
    assert rows(cp.triage(r)) == [("2", "blank_only")]
    fix = spark.createDataFrame([("1", None, "new", None, None)], "id string, new_source_corr string, new_target_sic string, new_target_corr string, corrected_at timestamp")
    assert rows(cp.apply_corrections(a, fix).where("id = '1'")) == [("1", None, "new", None)]


def test_lookback_batch_and_stream(spark, make_lines, tmp_path):
    from paleoline.streaming.lookback import event_counts, lookback_stream

    data = [{"id": f"l{k}", "source_sic": "abc x", "target_sic": "abc y", "nonbreaking_next_line": f"l{k + 1}"} for k in range(40)]
    data[7]["target_sic"] = "zbc"
    data[30].update(target_sic="q", source_sic="a")
    data[29]["nonbreaking_next_line"] = ""
    data[2]["nonbreaking_next_line"] = "l30"
    df = make_lines(data, extra=False)
    want = [("l7", "l6", "x", "y")]
    assert rows(cp.lookback_links(df)) == want
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = lookback_stream(stream).writeStream.format("memory").queryName("lb").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("lb")) == want
    ev = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 2.0)], "ts string, event_type string, value double")
    assert rows(event_counts(ev), "event_type", "n", "total") == [("a", 2, 3.0)]


def test_boundary_examples_and_lexicon(spark, make_lines):
    df = make_lines([{"id": f"W1-00-000{1 + k // 3}-lb-000{k}", "ancestor_id": "p1" if k < 4 else None, "source_sic": None if k == 1 else "x" * 50 + str(k), "nonbreaking_next_line": "W1-00-0001-lb-0001" if k == 0 else ""} for k in range(6)], extra=False)
    got = {r["boundary_id"]: (r["label"], len(r["line_end"]), len(r["line_start"]), r["crosses_page_break"]) for r in ex.boundary_examples(df).collect()}
    assert got["W1-00-0001-lb-0000"] == (1, 40, 0, False) and got["W1-00-0001-lb-0002"] == (0, 40, 40, True) and "W1-00-0002-lb-0003" not in got
    words = ex.lexicon(spark.createDataFrame([("Quod, quod (quod) ab ab ab",), (None,), ("",)], "target_corr string"))
    assert rows(words) == [("quod", 3)]
