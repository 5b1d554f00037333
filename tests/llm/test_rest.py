import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paleoline.llm import leakage as lk
from paleoline.llm import packing as pk
from paleoline.llm import pieces as pc
from paleoline.llm import residue as rs
from paleoline.llm import splits as sp
from paleoline.llm.fmindex import FMIndex, suffix_array
from tests.conftest import rows


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. ;éſ̃\U00010400\n", max_size=400), st.integers(40, 120), st.integers(0, 15))
def test_pieces_cover_and_fit(t, limit, overlap):
    cuts = pc.cut(t, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(t)
    for s, e in cuts:
        assert len(t[s:e].encode()) <= limit
    for (s, e), (s2, e2) in zip(cuts, cuts[1:]):
        assert s < s2 <= e < e2, "each piece begins inside or at the end of the last and goes on beyond it"
    assert "".join(t[max(s, d) : e] for (s, e), d in zip(cuts, [0, *[e for _, e in cuts]])) == t


def test_pieces_natural():
    t = "Prima sententia est haec. " * 40
    cuts = pc.cut(t)
    assert all(t[:e].endswith(". ") for _, e in cuts[:-1]) and all(35 <= e - s2 <= 60 for (_, e), (s2, _) in zip(cuts, cuts[1:]))


def test_piece_rows(spark, make_lines):
    df = make_lines([{"id": "a", "source_sic": "x" * 480, "target_corr": "y" * 481}, {"id": "b", "source_sic": None, "target_corr": ""}, {"id": None, "source_sic": "z" * 999}, {"id": "c", "source_sic": "é" * 241, "file_pos": 1}, {"id": "c", "source_sic": "short", "file_pos": 50}])
    got = rows(pc.line_pieces(df), "id", "field", "n_pieces", "piece")
    assert got == [("a", "source_sic", 1, 0), ("a", "target_corr", 2, 0), ("a", "target_corr", 2, 1), ("b", "target_corr", 1, 0), ("c", "source_sic", 1, 0)]
    assert rows(pc.line_pieces(df, only_large=True), "id", "piece") == [("a", 0), ("a", 1)]
    assert pc.line_pieces(make_lines([])).count() == 0


@given(st.lists(st.integers(1, 300), max_size=200), st.integers(1, 9))
def test_best_fit(sizes, bins):
    out = pk.best_fit(sizes, 100, bins)
    fill, per = {}, {}
    for k, c, s in out:
        fill[c] = fill.get(c, 0) + s
        per[k] = per.get(k, 0) + s
    assert per == dict(enumerate(sizes)) and all(f <= 100 for f in fill.values())
    assert all(sum(1 for x, _, _ in out if x == k) == 1 for k, s in enumerate(sizes) if s <= 100)


def test_pack(spark):
    docs = spark.createDataFrame([(k, "x" * (k * 37 % 900), "c") for k in range(300)] + [(900, None, "c"), (901, "é" * 5000, "c"), (901, "é" * 5000, "c"), (902, "y" * 4095, "c"), (903, "y" * 4096, "c"), (None, "a", "c")], "doc_id bigint, text string, container string")
    p = pk.pack(docs, shard_rows=50).cache()
    assert p.groupBy("container").sum("tokens").where("`sum(tokens)` > 4096").count() == 0
    assert p.count() == 300 + 3 + 3 + 1 + 2 + 1 and rows(p.where("n_parts > 1").select("doc_id").distinct()) == [(901,), (903,)]
    assert p.selectExpr("sum(tokens)").first()[0] == docs.where("text is not null").selectExpr("sum(octet_length(text) + 1)").first()[0]
    assert pk.pack(docs.limit(0)).count() == 0 and pk.container_fill(pk.pack(docs, shard_rows=1000)).first()["mean_fill"] > 0.9


@pytest.mark.parametrize("n,sigma", [(1, 2), (30, 3), (700, 4), (3000, 90)])
def test_fm_index(n, sigma):
    rng = np.random.default_rng(n)
    t = rng.integers(1, sigma, n)
    t[n // 2 : n // 2 + n // 4] = t[: n // 4]
    ended = np.append(t, 0)
    assert suffix_array(ended, sigma).tolist() == sorted(range(n + 1), key=lambda i: ended[i:].tolist())
    m = min(3, n)
    p = np.concatenate([[t[k : k + m] for k in rng.integers(0, n - m + 1, 20)], rng.integers(1, sigma, (20, m))])
    f = FMIndex(t, sigma)
    for q, lo, hi in zip(p, *f.search(p)):
        assert sorted(f.locate(np.arange(lo, hi)).tolist()) == [k for k in range(n - m + 1) if (t[k : k + m] == q).all()]


def test_leaked_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(9) for b in range(4)]
    item = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(8)] + ["too short", "", None]
    items = [(k, t, "test") for k, t in enumerate(item)] + [(0, item[0], "test"), (50, item[1], "val")]
    docs = []
    for d in range(40):
        w = [rng.choice(vocab) for _ in range(60)]
        if d % 2:
            src = item[d % 8].split()
            s, n = rng.randrange(10), rng.choice([11, 12, 15])
            w[20 : 20 + n] = [x.upper().replace("w", "ｗ") if d % 3 else x for x in src[s : s + n]]
        t = " ".join(w)
        docs.append((d, t.replace(" ", " ", 9).replace("wa", "w-\na", 2).replace("wb", "w­b", 3) if d % 5 else t, "x"))
    docs += [(98, None, "x"), (99, "", "x"), (1, docs[1][1], "x"), (None, item[0], "x"), (97, item[0] + " " + item[0], "x"), (96, "alia " * 3000 + item[3], "x")]
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string, set_name string")
    grams = {}
    for i, t, _ in items:
        w = lk.levelled_words(t or "")
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t, _ in docs:
        w = lk.levelled_words(t or "")
        for k in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ()) if d is not None}
    assert {(r["doc_id"], r["item_id"]) for r in lk.leaked(df, ev).collect()} == want and {(97, 0), (96, 3), (97, 0)} <= want
    assert {(r["doc_id"], r["item_id"]) for r in lk.leaked(df, ev, shard_words=60).collect()} == want
    span = {r["doc_id"]: r["spans"] for r in lk.leaked(df, ev, spans=True).collect()}
    assert [docs_text[s["start"] : s["end"]] for docs_text in [dict((d, t) for d, t, _ in docs)[96]] for s in span[96]] == [item[3]]
    assert len(span[97]) == 1
    assert {r["item_id"]: r["documents"] for r in lk.leaked_items(lk.leaked(df, ev), ev).collect()}[8] == 0
    assert lk.leaked(df.limit(0), ev).count() == 0 and lk.leaked(df, ev.limit(0)).count() == 0


RESIDUE = [
    ("Et si {{work.title}} imperio", None, "slot"), ("non <%= doc_id %> x", None, "slot"), ("a [year goes here] b", None, "slot"), ("a [Aquí va el año] b", None, "slot"), ("%%TITLE%% est", None, "slot"), ("x #{place} y __AUTHOR__", None, "slot"),
    ("The apparatus uses {fol. 277r} for changes and [...] for lacunae of the witness < a >.", None, None), ("xx xxx xxxx xx et", None, "filler"), ("quod Dummy text Dummy text", None, "filler"), ("dolor sit amet consectetur elit sed do lorem amet", None, "filler"),
    ("Dolor ipsum animi non tollit obligationem, sit licet amarum quod debetur.", None, None), ("qwerty qwerty", None, "filler"), ("abc abc abc 63 abc", None, "filler"), ("bonum est bonum est et bonum", None, None),
    ("404 Not Found", None, "notice"), ("Home | Works | Authors\nFehler 12: Die angeforderte Seite ist nicht verfügbar.\nZurück zur Startseite", None, "notice"), ("Summa de poenis\n\nToo many requests. Your access has been limited; wait 24 seconds.", "Summa de poenis", "notice"),
    ("Error communis, ut hic in folio 404 legitur, non excusat eum qui legem non servat.", None, None), ("In the viewer the margin can be hidden; without JavaScript the reader still gets the plain transcription.", None, None),
    ('For some weeks readers met the notice "page not found" when they followed the older links.', None, None), ("<h1>exerr:ERROR document not found [at line 1, column 2]</h1>\n<p>In function: render:page(node())</p>", None, "notice"),
    ("Traceback (most recent call last):\n  File \"render.py\", line 459, in build\nKeyError: 'doc_id'", None, "notice"), ("", None, None), (None, "t", None), ("et " * 20000 + "{$author}", "t", "slot"), ("PLEASE ENABLE JAVASCRIPT TO VIEW THIS EDITION.", "x", "notice"),
]


def test_residue(spark):
    data = [(k, t, title, "web", "x") for k, (t, title, _) in enumerate(RESIDUE)]
    data += [(500 + k, f"Sorry, volume {k} is asleep on its server; come again to this browser address.", None, f"h{k % 2}", "x") for k in range(4)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, title string, source string, reason string")
    got = {r["doc_id"]: r["reason"] for r in rs.residue(df).collect()}
    assert {k: got[k] for k in range(len(RESIDUE))} == {k: want for k, (_, _, want) in enumerate(RESIDUE)}
    assert {got[500 + k] for k in range(4)} == {"mismatch"}
    marks = rs.residue(df)
    assert rs.keep_content(df, marks).count() == sum(w is None for _, _, w in RESIDUE)
    assert rs.residue(df.limit(0)).count() == 0


def test_splits(spark, make_lines):
    rng = random.Random(1)
    works = [(f"D{k:03d}", f" p{rng.randrange(10**3):07d}" if k % 7 else "unknown", f"S{k // 2:07d}" if k % 5 == 0 else None, "train") for k in range(120)]
    works += [("D000", "P9999999", None, "train"), ("D001", "p9999999 ", None, "train"), (None, "P9999999", None, None)]
    lines = [{"id": f"N{k % 100:03d}-00-0001-lb-{k:04d}", "doc_id": f"D{k % 100:03d}", "lang": ["la" if k % 3 else "es"]} for k in range(900)] + [{"id": "N000-01-0001-lb-9999", "doc_id": "Dother"}, {"id": "odd id", "doc_id": "Dodd"}]
    df, w = make_lines(lines), spark.createDataFrame(works, "doc_id string, author_id string, source_id string, group string")
    groups = {r["doc_id"]: r["group_doc"] for r in sp.doc_groups(df, w).collect()}
    assert groups["D000"] == groups["D001"] == groups["Dother"] and groups["Dodd"] == "Dodd" and None not in groups
    assert all(g <= d for d, g in groups.items()) and len(groups) == 122
    out = sp.assign_splits(df, sp.doc_groups(df, w), chains=2, steps=1500).collect()
    by = {}
    for r in out:
        assert by.setdefault(r["group_doc"], r["split"]) == r["split"]
    n = {s: 0 for s in sp.SHARES}
    for x in lines:
        n[by[groups[x["doc_id"]]]] += 1
    assert len(out) == 122 and abs(n["train"] / 902 - 0.8) < 0.05 and abs(n["val"] / 902 - 0.1) < 0.04
    assert sp.assign_splits(make_lines([]), sp.doc_groups(make_lines([]), w.limit(0))).count() == 0


def test_repeated_answers_need_no_phrases(spark, monkeypatch):
    monkeypatch.setattr(rs, "WEAK", frozenset(["none"]))
    rng = random.Random(5)
    vocab = [a + b + c for a in "bdfglm" for b in ("ar", "el", "in", "os") for c in ("a", "um", "it")]
    real = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    docs = []
    for k in range(6):  # unseen languages, numbers and paths differ, titles and hosts differ
        docs += [(100 + k, f"Sidan {k} kunde inte hittas.", f"Titel {vocab[k]}", f"h{k % 2}"), (200 + k, f"<h1>Страница /w/{k} не найдена</h1>", f"Opus {vocab[k + 9]}", f"h{k % 3}")]
    docs += [(300 + k, "Formula haec est. " + real(40), f"Opus {vocab[k]}", f"h{k % 2}") for k in range(9)]  # a formula before other words
    long = real(300)
    docs += [(400 + k, long, f"Opus {vocab[k]}", f"h{k % 2}") for k in range(4)]  # a long text in several places
    docs += [(500 + k, "De iure belli sermo.", "De iure belli", f"h{k % 2}") for k in range(4)]  # the title says it
    docs += [(600 + k, "Vide infra paginam.", f"Opus {vocab[k]}", "h0") for k in range(4)]  # one host
    docs += [(700, "Sidan kunde inte.", "x", None), (None, real(5), None, None), (None, real(5), None, None), (701, "", "t", "h"), (702, None, None, None), (703, "Kyrie eleison " * 4 + real(30), "t", "h")]
    docs += [(2**60 + 1, "a {{title}} b", "t", "h"), (2**60 + 2, "a b c", "t", "h")]
    docs += [(100, "Sidan 0 kunde inte hittas.", f"Titel {vocab[0]}", "h0")]  # the same row again
    df = spark.createDataFrame(docs, "doc_id bigint, text string, title string, source string").selectExpr("*", "1 as row", "'k' as key", "2 as copies", "'s' as segs", "'o' as host")
    got = rs.residue(df).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"] for r in got if r["reason"]} == {*range(100, 106), *range(200, 206), 2**60 + 1}
    assert {r["copies"] for r in got if r["doc_id"] in range(100, 106)} == {7} and {r["hosts"] for r in got if r["reason"] == "mismatch"} == {2}


def test_pack_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(pk, "_BLOCK", 7)
    big = 2**60 + 1
    docs = spark.createDataFrame([(5, "x" * 999)] * 100 + [(None, "yy")] * 60 + [(big, "z")], "doc_id bigint, text string")
    p = pk.pack(docs, shard_rows=20).cache()
    assert rows(p.groupBy("doc_id").count()) == sorted([(None, 60), (5, 100), (big, 1)], key=str)
    assert p.groupBy("container").sum("tokens").where("`sum(tokens)` > 4096").count() == 0 and p.select("container").distinct().count() < 45
    assert {r["doc_id"] for r in p.collect()} == {None, 5, big}
