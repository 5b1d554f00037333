"""A few edition documents with every case of the shredder, the lines they must give, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD = '<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="{}" xml:lang="la"><teiHeader>{}<revisionDesc status="{}"/></teiHeader><text type="{}"><body>'
_END = "</body></text></TEI>"

DOCUMENTS = [
    # Choices of both kinds, one that straddles a break, a note with a break and one without, another language within a line.
    ("a.xml", _HEAD.format("X1", "", "h_revised", "work") + (
        '<pb facs="facs:W0000009-0001" xml:id="pb1"/><div xml:id="d1"><head xml:id="h1"><lb xml:id="a1"/>De <choice><abbr>leg<g ref="#chara770"/></abbr><expan>legibus</expan></choice></head>'
        '<p xml:id="p1"><lb xml:id="a2"/>ego vi<choice><sic>d</sic><corr>dd</corr></choice>ens <choice><orig>Vsus</orig><reg>usus</reg></choice><note xml:id="n1" xml:lang="es">nota <lb xml:id="a3"/>prima <lb xml:id="a4" break="no"/>pars</note>'
        ' con<choice><abbr>scẽ<lb xml:id="a5" break="no"/>tiã</abbr><expan>scen<lb sameAs="#a5"/>tiam</expan></choice> et<note xml:id="n2">sine versu</note> alia</p>'
        '<pb sameAs="#pb1"/><p xml:id="p2"><lb xml:id="a6"/>ultima <hi xml:lang="es">palabra</hi> &amp; finis</p></div>'
    ) + _END),
    # Table cells, lists, verse, and every way a glyph is written: precomposed, composed, the element's own text, standardized, unknown.
    ("b.xml", _HEAD.format("X2", "", "g_enriched_approved", "work") + (
        '<pb facs="facs:W0000009-A-0002"/><table><row><cell><lb xml:id="b1"/>unum</cell><cell><lb xml:id="b2"/>duo</cell></row></table>'
        '<list xml:id="t1"><item><lb xml:id="b3"/>tres <lb xml:id="b4"/>quattuor</item></list><lg xml:id="g1"><l xml:id="v1"><lb xml:id="b5"/>arma</l></lg>'
        '<p xml:id="p3"><lb xml:id="b6"/>x<g ref="#charn0303"/>y<g ref="#charq0303"/>z<g ref="#charf1e1">P</g>w<g ref="#chare8b3"/>v<g ref="#nowhere"/>u</p>'
    ) + _END),
    # Not admitted: a draft, a volume's wrapper, and an excluding note of the project.
    ("c.xml", _HEAD.format("X3", "", "c_draft", "work") + '<p><lb xml:id="c1"/>nihil</p>' + _END),
    ("d.xml", _HEAD.format("X4", "", "h_revised", "work_volume") + '<p><lb xml:id="d1"/>nihil</p>' + _END),
    ("e.xml", _HEAD.format("X5", '<editorialDecl><p xml:id="X5-AEW"/></editorialDecl>', "h_revised", "work") + '<p><lb xml:id="e1"/>nihil</p>' + _END),
]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOCUMENTS, "file_name string, xml string")


def xml_cases(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the documents above, all views and fields."""
    from paleoline.sources.tei import shred_documents

    out = shred_documents(documents(spark))
    fields = ("id", "doc_id", "ancestor_id", "ancestor_type", "facs_id", "image_info_url", "is_in_note", "contains_abbr", "contains_sic", "source_sic", "source_corr", "target_sic", "target_corr", "nonbreaking_next_line")
    return out.select(*fields, F.array_join("lang", ",").alias("lang"))


def xml_process(spark: SparkSession, d: str) -> DataFrame:
    """From XML to XML with a pipeline that expands one word, continues one line and changes one that holds a choice already: counts and signs of each document."""
    from paleoline.sources.tei import process_documents

    def pipeline(lines: DataFrame) -> DataFrame:
        text = F.replace(F.replace("source_sic", F.lit("quattuor"), F.lit("iiii")), F.lit("De leg"), F.lit("Dx lxg"))
        return lines.select("id", text.alias("expanded_text"), F.when(F.col("id") == "b3", "b4").alias("predicted_next_line"))

    out = process_documents(documents(spark), pipeline)
    n = lambda x: F.regexp_count("xml", F.lit(x)).alias
    return out.select("file_name", "skipped", n("<choice>")("choices"), n('xml:id="b4" break="no"')("continued"), n("<abbr>quattuor</abbr><expan>iiii</expan>")("expanded"))


QUERIES = {f.__name__: f for f in (xml_cases, xml_process)}

_COLUMNS = "id, doc_id, ancestor_id, ancestor_type, facs_id, image_info_url, is_in_note, contains_abbr, contains_sic, source_sic, source_corr, target_sic, target_corr, nonbreaking_next_line, lang"
_A, _B = "'W0000009-0001', 'https://facs.example.invalid/iiif/image/W0000009-0001'", "'W0000009-A-0002', 'https://facs.example.invalid/iiif/image/W0000009_A-0002'"
_same = lambda t: ", ".join([f"'{t}'"] * 4)

SQL = {
    "xml_cases": f"""SELECT * FROM (VALUES
        ('a1', 'X1', 'h1', 'head', {_A}, 'false', 'true', 'false', 'De ⦃legꝰ⦄', 'De ⦃legꝰ⦄', 'De legibus', 'De legibus', '', 'la'),
        ('a2', 'X1', 'p1', 'p', {_A}, 'false', 'true', 'true', 'ego videns Vsus con⦃scẽ', 'ego viddens Vsus con⦃scẽ', 'ego videns Vsus conscen', 'ego viddens Vsus conscen', 'a5', 'la'),
        ('a3', 'X1', 'n1', 'note', {_A}, 'true', 'false', 'false', {_same("prima")}, 'a4', 'es'),
        ('a4', 'X1', 'n1', 'note', {_A}, 'true', 'false', 'false', {_same("pars")}, '', 'es'),
        ('a5', 'X1', 'p1', 'p', {_A}, 'false', 'true', 'false', 'tiã⦄ et alia', 'tiã⦄ et alia', 'tiam et alia', 'tiam et alia', '', 'la'),
        ('a6', 'X1', 'p2', 'p', {_A}, 'false', 'false', 'false', {_same("ultima palabra & finis")}, '', 'la,es'),
        ('b1', 'X2', '', '', {_B}, 'false', 'false', 'false', {_same("unum")}, '', 'la'),
        ('b2', 'X2', '', '', {_B}, 'false', 'false', 'false', {_same("duo")}, '', 'la'),
        ('b3', 'X2', 't1', 'list', {_B}, 'false', 'false', 'false', {_same("tres")}, '', 'la'),
        ('b4', 'X2', 't1', 'list', {_B}, 'false', 'false', 'false', {_same("quattuor")}, '', 'la'),
        ('b5', 'X2', 'v1', 'l', {_B}, 'false', 'false', 'false', {_same("arma")}, '', 'la'),
        ('b6', 'X2', 'p3', 'p', {_B}, 'false', 'false', 'false', {_same("xñyq̃zPwqv@u")}, '', 'la')) v({_COLUMNS})""",
    "xml_process": "SELECT * FROM (VALUES ('a.xml', 1, 5, 0, 0), ('b.xml', 0, 1, 1, 1), ('c.xml', 0, 0, 0, 0), ('d.xml', 0, 0, 0, 0), ('e.xml', 0, 0, 0, 0)) v(file_name, skipped, choices, continued, expanded)",
}
