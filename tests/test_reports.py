import json

import pytest
from pyspark.sql import functions as F

from paleoline.functions import text as tx
from paleoline.operators import boundary_model as bm
from paleoline.operators import chains as ch
from paleoline.operators import compare as cp
from paleoline.operators import examples as ex
from paleoline.operators import metrics as mt
from paleoline.operators import order as od
from paleoline.operators import reports as rt
from paleoline.operators.infer import model_expander
from paleoline.plans import lines as pl
from paleoline.sources import jsonl, tei
from tests.conftest import rows


def test_head_and_zip(spark):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "p int, v string").repartition(5)
    assert rows(rt.head(df, 3, ["p"]), "v") == [("v0",), ("v1",), ("v2",)] and rt.head(df, 99, ["p"]).count() == 20 and rt.head(df.limit(0), 3, ["p"]).count() == 0
    z = rt.zip_positions({"a": df.select("p", F.col("v").alias("a")), "b": df.where("p >= 15").select("p", F.col("v").alias("b"))}, ["p"])
    assert rows(z, "pos", "a", "b") == sorted(((k, f"v{k}", f"v{k + 15}") for k in range(5)), key=str)


def test_fallback_threshold_and_suffix(spark, tmp_path):
    df = spark.range(3)
    assert rt.or_all(df.where("id > 1"), df).count() == 1 and rt.or_all(df.where("id > 9"), df).count() == 3
    (tmp_path / "t.json").write_text(json.dumps({"threshold": 0.75}, indent=1))
    (tmp_path / "n.json").write_text("{}")
    assert [rt.load_threshold(spark, p) for p in (str(tmp_path / "t.json"), str(tmp_path / "n.json"), str(tmp_path / "none.json"), None)] == [0.75, 0.6, 0.6, 0.6]
    names = spark.createDataFrame([("checkpoint-900",), ("checkpoint-1000",), ("final",), (None,)], "n string")
    assert [r[0] for r in names.orderBy(rt.numeric_suffix("n").desc_nulls_last(), "n").collect()][:2] == ["checkpoint-1000", "checkpoint-900"]


def test_documents_and_text(spark, tmp_path):
    s = spark.createDataFrame([("a", "D1", 1, 0.9, True), ("b", "D1", 0, 0.8, False), ("c", "D2", 1, 0.1, False)], "boundary_id string, doc_id string, label int, prob double, crosses_page_break boolean")
    doc = rt.nested({"overall": mt.prf(s, []), "by_doc[]": mt.prf(s, ["doc_id"]), "none[]": s.where("label = 7")})
    jsonl.write_jsonl(doc, str(tmp_path / "m"))
    got = json.loads(next((tmp_path / "m").glob("*.json")).read_text())
    assert got["overall"]["precision"] == 0.5 and [x["doc_id"] for x in got["by_doc"]] == ["D1", "D2"] and got["none"] == []
    text = rt.text_report(spark.createDataFrame([(3, 1.5, None)], "n int, mean double, top int"), "Report")
    assert [r["line"] for r in text.orderBy("n").collect()] == ["Report", "n: 3", "mean: 1.50", "top: -"]
    curve = {(r["threshold"], r["precision"], r["recall"]) for r in mt.pr_curve(s).collect()}
    assert curve == {(0.9, 1.0, 0.5), (0.8, 0.5, 0.5), (0.1, 2 / 3, 1.0), (None, 1.0, 0.0)}
    assert mt.pick_threshold(mt.pr_curve(s)).first()[0] == 0.9 and mt.pick_threshold(mt.pr_curve(s.limit(0))).first()[0] == 0.9


def test_ranks(spark):
    df = spark.createDataFrame([("x", 2, 9), ("y", 5, 8), ("z", 2, 1)], "c string, n int, f int")
    assert [(r["c"], r["rank"]) for r in rt.most_common(df, "f", "c").orderBy("rank").collect()] == [("y", 1), ("z", 2), ("x", 3)]
    assert rows(rt.first_of_each(df, "n", ["f"], 1), "c") == [("y",), ("z",)]


def test_addresses(spark):
    ids = ["facs:W0013-A-0125", "#W0013-0125", "W0013-0125x", None, "W0000013-0001"]
    df = spark.createDataFrame([(i,) for i in ids], "f string")
    urls = [r[0] for r in df.select(tx.facs_url("f", "https://s/", tx.FACS_FOLDERS, "/full.jpg")).collect()]
    assert urls == ["https://s/W0013!A!W0013-A-0125/full.jpg", "https://s/W0013!W0013-0125/full.jpg", "", "", ""]
    assert [r[0] for r in df.select(tx.facs_url("f", "s/")).collect()][-1] == "s/W0000013-0001"


def test_glyphs_of_both_pairs(spark, make_lines, monkeypatch):
    df = make_lines([
        {"id": "1", "source_sic": "cælum", "source_corr": "caelum", "target_sic": "caelum", "target_corr": "caelum"},
        {"id": "2", "source_sic": "ſæculo", "source_corr": "ſæculo", "target_sic": "saeculo", "target_corr": "saeculo"},
        {"id": "3", "source_sic": None, "source_corr": "pœna", "target_sic": "poena", "target_corr": "poena"}, {"id": "4", "source_sic": "pœna", "source_corr": None, "target_sic": None, "target_corr": "poena"}, {"id": "5"},
    ])
    monkeypatch.setattr(pl, "_lines", lambda s, d: df)
    got = rows(pl.restore_glyphs(spark, ""))
    assert got == [("1", "cælum", "caelum"), ("2", "ſæculo", "ſæculo"), ("3", "poena", "pœna"), ("4", None, "poena"), ("5", None, None)]


def test_comparison_reads_references_and_compositions(spark, make_lines):
    a = make_lines([{"id": "1", "source_sic": "a &amp; b", "target_sic": "sé", "target_corr": None}, {"id": "2", "source_sic": "x &lt; y", "target_sic": "t", "target_corr": "t"}])
    b = spark.createDataFrame([("1", "a & b", "sé", None), ("2", "x > y", "t", "t")], "id string, source string, target string, target_corr string")
    got = {r["id"]: (r["status"], r["details"]) for r in cp.compare_exports(a, b).collect()}
    assert got["1"] == ("match", None) and got["2"][0] == "differences_found" and got["2"][1]["source"]["A"] == "x < y"


def test_examples_without_markers_and_drawn_copies(spark):
    w = spark.createDataFrame([("D", k, f"⦃a⦄{k}", f"t{k}", k % 2 == 0) for k in range(40)], "doc_id string, head_pos bigint, source string, target string, has_abbr boolean")
    heads = w.select("doc_id", F.col("head_pos").alias("pos"), F.lit(None).cast("array<string>").alias("lang"))
    assert {r["source"] for r in ex.seq2seq_examples(w, heads, oversample=1, strip=True).collect()} == {f"a{k}" for k in range(40)}
    out = ex.seq2seq_examples(w, heads, oversample=1.5)
    extra = out.where("copy > 0").collect()
    assert out.count() == 40 + 10 and all(r["has_abbr"] for r in extra) and sorted(r["copy"] for r in extra) == list(range(1, 11))
    assert {r["source"][:4] for r in ex.seq2seq_examples(w, heads, oversample=1, lang_prefix=True).collect()} == {"[LA]"}


def test_a_leap_holds_no_document(spark, make_lines, monkeypatch):
    monkeypatch.setattr(ex, "LONGEST_LEAP", 10)
    ids = [f"W1-00-0001-lb-{k:04d}" for k in range(60)]
    link = {0: 50, 50: 51, 20: 21}
    df = make_lines([{"id": i, "source_sic": f"t{k}", "target_corr": f"t{k}", "nonbreaking_next_line": ids[link[k]] if k in link else ""} for k, i in enumerate(ids)], extra=False)
    o = od.document_order(df, "nonbreaking_next_line", "source_sic", "target_corr", "contains_abbr")
    got = {r["head_pos"]: r["source"] for r in ex.context_windows(o, ch.chains(o)).collect()}
    assert got[0] == "t0¬t50¬t51↵t52↵t53" and got[20] == "t18↵t19↵t20¬t21↵t22↵t23" and len(got) == 57
    spans = ex.chain_spans(ch.chains(o))
    assert rows(spans.where("leaps"), "head_pos", "last_pos") == [(0, 51)]


def test_model_is_loaded_once_a_task(spark):
    df = spark.createDataFrame([(k, f"s{k}") for k in range(70)], "n int, source string").repartition(2)

    def load():
        return {"calls": 0}

    def apply(model, texts):
        model["calls"] += 1
        assert len(texts) <= 8
        return [f"{t}:{model['calls']}" for t in texts]

    got = [r["source"] for r in model_expander(load, apply, 8)(df).collect()]
    assert len(got) == 70 and max(int(x.split(":")[1]) for x in got) >= 4


def test_xml_in_one_call(spark):
    from paleoline.operators.infer import run_pipeline

    head = '<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="W9"><text><body>'
    docs = [("a", head + '<p><lb xml:id="a-00-0001-lb-0001"/>et volun<lb xml:id="a-00-0001-lb-0002"/>tas ⦃q̃⦄ est</p></body></text></TEI>'), ("b", head + "<p>no line</p></body></text></TEI>"), ("c", None)]
    score = lambda p: p.withColumn("prob", F.when(F.col("line_end").endswith("volun"), 1.0).otherwise(0.0))
    expand = lambda w: w.withColumn("source", F.replace("source", F.lit("⦃q̃⦄"), F.lit("quod")))
    out = {r["file_name"]: (r["xml"], r["skipped"]) for r in tei.process_documents(spark.createDataFrame(docs, "file_name string, xml string"), lambda lines: run_pipeline(lines.withColumn("target_corr", F.lit(None).cast("string")), score=score, expand=expand)).collect()}
    assert "<abbr>⦃q̃⦄</abbr><expan>quod</expan>" in out["a"][0] and 'lb-0002" break="no"' in out["a"][0] and out["a"][1] == 0
    assert out["b"] == (docs[1][1], 0) and out["c"][0] is None


def test_routes_epochs_and_strict_reading(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "x")], "id string, kind string")
    jsonl.route(df, {"x": str(tmp_path / "x"), "y": str(tmp_path / "y"), "none": str(tmp_path / "n")})
    assert [spark.read.schema("id string").json(str(tmp_path / p)).count() for p in "xyn"] == [2, 1, 0]
    e = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, None)], "epoch int, precision double")
    assert tuple(bm.best_epoch(e).first()) == (3, 0.9)
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_strict(spark, str(tmp_path / "bad.jsonl")).collect()


def test_repairs_go_in_input_order(spark, make_lines):
    from paleoline.operators import repair as rp

    v = lambda s, t: {"source_sic": s, "source_corr": s, "target_sic": t, "target_corr": t}
    ids = ["W1-00-0001-lb-0001", "W1-00-0001-lb-0002"]
    one = [{"id": ids[0], "nonbreaking_next_line": "W1-00-0001-lb-0003", "file_pos": 9, **v("et volun", "et volu")}, {"id": ids[1], "nonbreaking_next_line": "W1-00-0001-lb-0003", "file_pos": 2, **v("al volun", "al volu")}, {"id": "W1-00-0001-lb-0003", "file_pos": 3, **v("tas", "ntas")}]
    got = {r["id"]: r["target_sic"] for r in rp.break_repairs(make_lines(one)).collect()}
    assert got[ids[1]] == "al volun" and ids[0] not in got or got.get(ids[0]) == "et volu"


def test_byte_tokens(spark):
    from paleoline.functions import tokens as tk

    df = spark.createDataFrame([("aé",), ("",), (None,), ("x" * 9,), ("éééé",)], "t string")
    got = [(r[0], r[1]) for r in df.select(tk.byte_ids("t", 8), tk.text_of_ids(tk.labels(tk.byte_ids("t", 8)))).collect()]
    assert got == [([100, 198, 172, 1], "aé"), ([1], ""), (None, None), ([123] * 7 + [1], "x" * 7), ([198, 172] * 3 + [198, 1], "ééé")]
    ids = spark.createDataFrame([([0, 100, -100, 1, 2, 300, 101],)], "i array<int>")
    assert ids.select(tk.labels("i"), tk.text_of_ids("i")).first()[:] == ([-100, 100, -100, 1, 2, 300, 101], "ab")


def test_latest_checkpoint(spark, tmp_path):
    assert rt.latest_checkpoint(spark, str(tmp_path / "none")) is None
    for n, files in ((900, ["model.safetensors", "trainer_state.json"]), (1000, ["trainer_state.json"]), (50, [])):
        (tmp_path / f"checkpoint-{n}").mkdir()
        for f in files:
            (tmp_path / f"checkpoint-{n}" / f).write_text("")
    (tmp_path / "checkpoint-x").mkdir()
    assert rt.latest_checkpoint(spark, str(tmp_path)).endswith("checkpoint-900")
    (tmp_path / "checkpoint-1000" / "pytorch_model.bin").write_text("")
    assert rt.latest_checkpoint(spark, str(tmp_path)).endswith("checkpoint-1000")
    (tmp_path / "checkpoint-1100").mkdir()
    (tmp_path / "checkpoint-1200").mkdir()
    assert rt.latest_checkpoint(spark, str(tmp_path)) is None
