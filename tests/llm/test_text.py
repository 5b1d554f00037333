from hypothesis import given
from hypothesis import strategies as st

from paleoline.llm import text as tx
from tests.conftest import rows


def test_clean_base():
    assert tx.clean_base("ſt a​b") == ("ſt ab", {"blank", "invisible"})
    assert tx.clean_base("ｌｅｘ．ﬅ ﬁ") == ("lex.ſt fi", {"form"})
    assert tx.clean_base("sé q̃ ꝑ̄") == ("sé q̃ ꝑ̄", {"apart"})
    assert tx.clean_base("æ œ ſ λόγος ἀρχή ꝙ ⁊ ª") == ("æ œ ſ λόγος ἀρχή ꝙ ⁊ ª", set())
    assert tx.clean_base("a\tb\x07") == ("a b", {"blank", "invisible"}) and tx.clean_base("") == ("", set())


def test_mixed():
    assert tx.mixed_tokens("dеrаn λόγος со") == [("dеrаn", "deran", True), ("со", "co", False)]
    assert tx.clean_now("dеrаn x") == "deran x"


@given(st.text())
def test_clean_is_stable_and_level_is_plain(s):
    once = tx.clean_base(s)[0]
    assert tx.clean_base(once)[0] == once
    assert set(tx.level(s)) <= set("abcdefghijklmnopqrstuvwxyz")


def test_level():
    assert tx.level("⦃Vſúra⦄ Jæœ ﬁ ｘ-9") == "usuraiaeoefix"


def test_normalise(spark, make_lines):
    df = make_lines([
        {"id": "1", "source_sic": "dеrаn reynos", "target_corr": "deran"}, {"id": "2", "source_sic": "zеzаx", "target_corr": "со"}, {"id": "3", "source_sic": None, "target_corr": ""}, {"id": "4", "source_sic": "λόγος q̃ ſ", "target_corr": "co ca"},
        {"id": "5", "source_sic": "x " * 5000}, {"id": "6", "source_sic": "a​", "file_pos": 1}, {"id": "6", "source_sic": "a", "file_pos": 99}, {"id": None, "source_sic": "​"},
    ])
    got = {(r["id"], r["field"]): (r["clean"], r["flags"]) for r in tx.normalise_text(df).collect()}
    assert got[("1", "source_sic")] == ("deran reynos", ["mixed"])
    assert got[("2", "source_sic")] == ("zеzаx", ["mixed"]), "no such word: flagged, not changed"
    assert got[("2", "target_corr")] == ("co", ["mixed"]) and got[("4", "source_sic")] == ("λόγος q̃ ſ", [])
    assert got[("3", "source_sic")] == (None, []) and got[("3", "target_corr")] == ("", [])
    assert got[("5", "source_sic")] == ("x " * 5000, ["blank"]) and got[("6", "source_sic")] == ("a", [])
    assert len(got) == 12 and rows(tx.normalise_text(make_lines([]))) == []


def test_dominant_script(spark, make_lines):
    texts = ["а страна abc", "кoт", "кот и кот", "cоn reyno", "соn reyno", "con dе", "рeccаn", "de", "dе, dе dе", "verbum/λόγος", "λοgος"]
    df = make_lines([{"id": f"{k:02d}", "source_sic": t} for k, t in enumerate(texts)])
    got = {r["id"]: (r["clean"], r["flags"]) for r in tx.normalise_text(df).where("field = 'source_sic'").collect()}
    want = ["а страна abc", "кот", "кот и кот", "con reyno", "con reyno", "con de", "рeccаn", "de", "dе, dе dе", "verbum/λόγος", "λοgος"]
    want[8] = "de, de de"
    assert [got[f"{k:02d}"][0] for k in range(len(texts))] == want
    assert [k for k in range(len(texts)) if got[f"{k:02d}"][1]] == [3, 4, 5, 6, 8]


@given(st.lists(st.sampled_from("de dе соn кoт а страна λόγος x".split()), max_size=8))
def test_no_new_mixed_token(words):
    s = " ".join(words)
    mixed = lambda t: len({tx._script(c) for c in t} - {""}) > 1
    before, after = s.split(" "), tx.clean_now(s).split(" ")
    assert len(before) == len(after) and all(mixed(a) or not mixed(b) for a, b in zip(before, after))
