from pyspark.sql import functions as F

from paleoline.llm import leakage as lk
from paleoline.llm import residue as rs
from paleoline.llm import splits as sp
from paleoline.llm import text as tx
from paleoline.plans import lines as pl

DOCS = "doc_id bigint, text string, title string, source string"
NAMES = [f"{a}{b}{c}" for a in ("mar", "tol", "ven", "qui") for b in ("a", "e", "io", "u") for c in ("bis", "dem", "gor", "lus", "nix", "pra")]


def _reasons(spark, texts):
    return {r["doc_id"]: r["reason"] for r in rs.residue(spark.createDataFrame([(k, t, None, f"h{k % 3}") for k, t in enumerate(texts)], DOCS)).collect()}


def test_notices_of_any_length(spark):
    page = "<html><head><style>" + " ".join(f".{x} {{ margin: {k} }}" for k, x in enumerate(NAMES)) + "</style></head><body><nav>" + "".join(f"<a href='/{x}'></a>" for x in NAMES[:40]) + "Home | Works</nav><h1>404 Not Found</h1></body></html>"
    trace = "Traceback (most recent call last):\n" + "".join(f'  File "{x}.py", line {k}, in {x}\n' for k, x in enumerate(NAMES)) + "KeyError: 'doc_id'"
    real = "404 Not Found\n" + "".join(f"Restitutio {x} in foro debetur. " for x in NAMES) + "\nPage not found."
    asleep = "".join(f"Sorry, {x} is asleep on its server; come again with this browser. " for x in NAMES[:30])
    talk = "Whoever looks for the page finds an error in it. " + "".join(f"The printer {x} set each line by hand and left the sense to us. " for x in NAMES)
    assert min(map(len, (page, trace, real, asleep, talk))) > 700
    got = _reasons(spark, [page, trace, real, *[asleep] * 3, *[talk] * 3])
    assert [got[k] for k in range(9)] == ["notice", "notice", None, *["mismatch"] * 3, *[None] * 3]


def test_dirty_slots_and_filler_in_long_texts(spark):
    real = "".join(f"Restitutio {x} in foro debetur. " for x in NAMES)
    dirty = ["Et si ｛｛title｝｝ imperio.", "Et si {{ti​tle}} imperio.", "Et si lorem ipsum imperio.", "qwe​rty qwerty", "a {{ti\x00tle}} b"]
    got = _reasons(spark, [*dirty, *[real + x for x in dirty], real + "é"])
    assert [got[k] for k in range(11)] == ["slot", "slot", "filler", "filler", "slot"] * 2 + [None]


def test_words_divided_by_any_hyphen():
    for part, rest in [("conf－\n", "issão"), ("conf‑\n", "issão"), ("conf﹣ \r\n ", "issão"), ("cõ-\n", "fissão"), ("c⦃on⦄-\n", "fissão"), ("c⦃on-⦄\n", "fissão"), ("conf​-​\n​ ", "issão"), ("conf­-\n", "issão"), ("conf­\n", "issão"), ("ｃｏｎｆ－\n", "ｉｓｓãｏ")]:
        t = f"et {part}{rest} est"
        assert len(lk.levelled_words(t)) == 3 and lk.levelled_words(t)[1].endswith("issao"), repr(t)
        assert [t[s:e] for s, e, _ in lk._spans(t)] == ["et", part + rest, "est"] and [w for _, _, w in lk._spans(t)] == lk.levelled_words(t)
    for t in ("et conf -\nissa", "et conf.-\nissa", "et conf ​-\nissa", "et conf--\nissa", "anno 12-\nissa et", "et conf⠀issa"):
        assert len(lk.levelled_words(t)) == 3 or t.startswith("anno") and lk.levelled_words(t) == ["anno", "issa", "et"], repr(t)
    assert lk._join_divided("-\nab c" + "-" * 9 + "\nd") == "-\nab c" + "-" * 9 + "\nd"


def test_spans_of_several_blocks(spark, monkeypatch):
    items = [(k, " ".join(f"{x}{'abcdefgh'[k]}" for x in NAMES[:14])) for k in range(8)]
    docs = [(1, " | ".join(t for _, t in items)), (2, f"{items[0][1]} et {items[3][1]}, {items[3][1]}"), (3, "et " * 20)]
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    ask = lambda: {(r["doc_id"], r["item_id"]): [(s["start"], s["end"]) for s in r["spans"]] for r in lk.leaked(df, ev, spans=True).collect()}
    one = ask()
    monkeypatch.setattr(lk, "BLOCK_WORDS", 40)
    assert ask() == one and len(one) == 8 + 2
    assert one[1, 5] == [(0, len(docs[0][1]))] and [docs[1][1][a:b] for a, b in one[2, 0]] == [items[0][1], f"{items[3][1]}, {items[3][1]}"]


def test_letters_of_any_other_script(spark, make_lines):
    bad = ["deжan", "dеrжn", "tհlis", "Ꭰqua", "aⲁqua", "d⦃eλ⦄an", "seλ́n"]
    good = ["λόγος", "verbum/λόγος", "(λόγος)", "1ª", "loquitꝰ", "ꝙ⁊", "CIↃ", "жена", "aquᵃ", "5µ"]
    assert [t for t in bad + good if tx.mixed_tokens(t)] == bad
    assert tx.mixed_tokens("dеrжn") == [("dеrжn", "dеrжn", True)] and tx.clean_now("dеrжn dеran") == "dеrжn deran"
    got = {r["id"]: (r["clean"], r["flags"]) for r in tx.normalise_text(make_lines([{"id": str(k), "source_sic": f"et {t} est", "target_corr": None} for k, t in enumerate(bad + good)])).where("field = 'source_sic'").collect()}
    assert got == {str(k): (f"et {t} est", ["mixed"] if t in bad else []) for k, t in enumerate(bad + good)}


def test_every_line_counts_in_the_balance_of_labels(spark, make_lines, monkeypatch):
    anneal = sp._anneal

    def whole(size, labels, *rest):
        assert (labels.sum(1) == size).all() and labels.shape[1] <= 1 + 1 / sp.LEAST_LABEL, "a label is left out"
        return anneal(size, labels, *rest)

    monkeypatch.setattr(sp, "_anneal", whole)
    lines = make_lines([{"id": f"N{k:03d}-00-0001-lb-{j:04d}", "doc_id": f"D{k:03d}", "ancestor_id": f"label {(k + j) % 25}" if j else None} for k in range(160) for j in range(8)])
    groups = spark.createDataFrame([(f"D{k:03d}", f"D{k:03d}") for k in range(161)], "doc_id string, group_doc string")
    assert sp.assign_splits(lines, groups, label=F.col("ancestor_id"), chains=1, steps=200).count() == 161
    assert sp.assign_splits(lines, groups, chains=1, steps=200).count() == 161


def test_breakdown_has_expansions_and_first_errors(spark, monkeypatch):
    spans = [(p, n, "q̃", ("que", "quem")[p % 3 == 0], "que") for p in range(90, 0, -1) for n in range(2)] + [(1, 5, "ẽ", "en", "en")]
    monkeypatch.setattr(pl, "_span_results", lambda s, d: s.createDataFrame(spans, "file_pos bigint, n int, abbr string, gold string, predicted string").withColumn("predicted", F.when(F.col("gold") == "quem", F.concat(F.lit("que"), F.col("file_pos"), F.lit("."), F.col("n"))).otherwise(F.col("predicted"))))
    got = {r["abbr"]: r.asDict(True) for r in pl.type_breakdown(spark, "").collect()}
    assert got["q̃"]["expansions"] == [{"gold": "que", "n": 120}, {"gold": "quem", "n": 60}] and got["q̃"]["n_exact"] == 120
    assert got["q̃"]["errors"] == [{"predicted": f"que{p}.{n}", "gold": "quem"} for p in range(3, 31, 3) for n in range(2)]
    assert got["ẽ"]["errors"] == [] and got["ẽ"]["expansions"] == [{"gold": "en", "n": 1}]
