import json

from paleoline.sources import characters, jsonl, tei
from tests.conftest import rows

XML = """<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="W9" xml:lang="la"><teiHeader><revisionDesc status="h_revised"/></teiHeader><text type="work"><body>
<pb facs="facs:W0000009-0001" xml:id="pb1"/><div xml:id="d1"><p xml:id="p1"><lb xml:id="l1"/>ego <choice><abbr><g ref="#charq0303"/></abbr><expan>que</expan></choice> vi<choice><sic>d</sic><corr>dd</corr></choice>ens<note xml:id="n1" xml:lang="es">nota <lb xml:id="n1a"/>prima <lb xml:id="n1b" break="no"/>pars</note> con<choice><abbr>scẽ<lb xml:id="l2" break="no"/>tiã</abbr><expan>scen<lb sameAs="#l2"/>tiam</expan></choice> et
<pb sameAs="#pb1"/><lb xml:id="l3"/>ultima <hi xml:lang="es">pala<g ref="#none"/>bra</hi> li~nea</p><table><row><cell><lb xml:id="l4"/>a</cell><cell><lb xml:id="l5"/>b</cell></row></table></div></body></text></TEI>"""


def test_shred(spark):
    df = tei.shred_documents(spark.createDataFrame([("f.xml", XML), ("g.xml", XML.replace("h_revised", "draft")), ("h", None)], "file_name string, xml string"))
    got = {r["id"]: r for r in df.collect()}
    assert set(got) == {"l1", "l2", "l3", "l4", "l5", "n1a", "n1b"}
    assert [got["l1"][v] for v in ("source_sic", "source_corr", "target_sic", "target_corr")] == ["ego ⦃q̃⦄ videns con⦃scẽ", "ego ⦃q̃⦄ viddens con⦃scẽ", "ego que videns conscen", "ego que viddens conscen"]
    assert got["l2"]["source_sic"] == "tiã⦄ et" and got["l2"]["target_corr"] == "tiam et" and got["l1"]["nonbreaking_next_line"] == "l2"
    assert got["n1a"]["source_sic"] == "prima" and got["n1a"]["is_in_note"] == "true" and got["n1a"]["nonbreaking_next_line"] == "n1b" and got["n1a"]["lang"] == ["es"]
    assert got["l3"]["lang"] == ["la", "es"] and got["l3"]["source_sic"] == "ultima pala@bra li~nea" and got["l3"]["facs_id"] == "W0000009-0001" and got["l3"]["image_jpg_url"].endswith("default.jpg")
    assert got["l4"]["source_sic"] == "a" and got["l5"]["ancestor_type"] == "div" and got["l1"]["contains_sic"] == "true"


def test_read_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text(XML, encoding="utf-8")
    got = jsonl.with_file_position(tei.read_tei(spark, str(tmp_path))).collect()
    assert len(got) == 7 and len({r["file_pos"] for r in got}) == 7 and all(r["file_name"].endswith("f.xml") for r in got)


def test_note_start():
    ids = [(r["id"], r["source_sic"]) for r in tei.shred(XML, note_initial=True)]
    assert ids[1:3] == [("n1__init", "nota"), ("n1a", "prima")]


def test_round_trip(spark):
    docs = spark.createDataFrame([("f", XML)], "file_name string, xml string")
    text = dict(tei.plain_lines(XML))
    assert text["l3"] == "ultima palabra li~nea" or "pala" in text["l3"]
    new = spark.createDataFrame([("f", "l3", text["l3"].replace("li~nea", "linnea"), ""), ("f", "l1", text["l1"], "l2"), ("f", "l4", "z", "l3")], "file_name string, id string, text string, next_id string")
    out = tei.write_expansions(docs, new).first()["xml"]
    assert "<choice><abbr>li~nea</abbr><expan>linnea</expan></choice>" in out and 'xml:id="l3" break="no"' in out
    assert "<abbr>a</abbr><expan>z</expan>" in out


def test_characters(spark):
    assert len(characters.characters()) == 106
    refs = spark.createDataFrame([("#charn0303", ""), ("#charq0303", "x"), ("#charf1e1", "P"), ("#nowhere", ""), ("#chare8b3", ""), (None, "t")], "ref string, text string")
    assert {r["ref"]: r["glyph"] for r in characters.glyph_lookup(refs).collect()} == {"#charn0303": "ñ", "#charq0303": "q̃", "#charf1e1": "P", "#nowhere": "@", "#chare8b3": "q", None: "t"}


def test_jsonl(spark, tmp_path):
    good = {"id": "a", "lang": ["la"], "source_sic": "ſ\"\\"}
    (tmp_path / "x.jsonl").write_text(json.dumps(good, ensure_ascii=False) + "\n\n{broken\n" + json.dumps({"id": "b"}) + "\n", encoding="utf-8")
    assert rows(jsonl.read_tolerant(spark, str(tmp_path)), "id", "source_sic") == [("a", 'ſ"\\'), ("b", None)]
    raw = jsonl.read_verbatim(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r["row"] is not None for r in raw] == [True, False, False, True] and raw[2]["raw"] == "{broken"
    df = jsonl.read_tolerant(spark, str(tmp_path))
    jsonl.write_jsonl(df, str(tmp_path / "out"))
    assert rows(jsonl.read_strict(spark, str(tmp_path / "out"))) == rows(df)
    jsonl.write_csv(df, str(tmp_path / "csv"))
    assert rows(spark.read.csv(str(tmp_path / "csv"), header=True, escape='"'), "id", "lang") == [("a", "la"), ("b", None)]
    assert jsonl.read_split_cache(spark, str(tmp_path / "none"), {"id"}, {"train"}) is None
    jsonl.write_split_cache(df.selectExpr("*", "'train' as split"), str(tmp_path / "cache"))
    assert jsonl.read_split_cache(spark, str(tmp_path / "cache"), {"id"}, {"train"}).count() == 2
    assert jsonl.read_split_cache(spark, str(tmp_path / "cache"), {"id"}, {"val"}) is None
