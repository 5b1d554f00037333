"""The character table of the editions: how a glyph element is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, precomposed, composed and standardized form of every character that the editions declare.
CHARACTERS = [
    ("char0026", "&", None, "&"),
    ("char00b6", "¶", None, "¶"),
    ("char00df", "ß", None, "ss"),
    ("char00e6", "æ", None, "ae"),
    ("char00c6", "Æ", None, "AE"),
    ("char0180", "ƀ", None, "b"),
    ("char0111", "đ", None, "d"),
    ("char0142", "ł", None, "l"),
    ("char0153", "œ", None, "oe"),
    ("char0152", "Œ", None, "OE"),
    ("char017f", "ſ", None, "s"),
    ("char1e9c", "ẜ", None, "s"),
    ("char01d4", "ǔ", None, "u"),
    ("char0250", "ɐ", None, "a"),
    ("char0259", "ə", None, "e"),
    ("char026f", "ɯ", None, "m"),
    ("char0292", "ʒ", None, "z"),
    ("char204a", "⁊", None, "et"),
    ("char211f", "℟", None, "R"),
    ("char2184", "ↄ", None, "con"),
    ("chara751", "ꝑ", None, "p"),
    ("chara750", "Ꝑ", None, "P"),
    ("chara753", "ꝓ", None, "p"),
    ("chara759", "ꝙ", None, "q"),
    ("chara75d", "ꝝ", None, "rum"),
    ("chara75f", "ꝟ", None, "v"),
    ("chara76d", "ꝭ", None, "is"),
    ("chara770", "ꝰ", None, "us"),
    ("chara757", "ꝗ", None, "q"),
    ("char00D1", "Ñ", None, "N"),
    ("char0254", "ɔ", None, "o"),
    ("char2013", "–", None, "–"),
    ("char2014", "—", None, "—"),
    ("char2020", "†", None, "+"),
    ("char271d", "✝", None, "+"),
    ("chara0300", "à", None, "a"),
    ("chara0302", "â", None, "a"),
    ("chara0303", "ã", None, "a"),
    ("chara0304", "ā", None, "a"),
    ("charb0307", None, "ḃ", "b"),
    ("charc0303", None, "c̃", "c"),
    ("charc0327", "ç", None, "c"),
    ("chare0300", "è", None, "e"),
    ("chare0302", "ê", None, "e"),
    ("chare0303", "ẽ", None, "e"),
    ("chare0304", "ē", None, "e"),
    ("chare0308", "ë", None, "e"),
    ("chare0327", "ȩ", None, "e"),
    ("chare0328", "ę", None, "e"),
    ("charg0304", "ḡ", None, "g"),
    ("chari0300", "ì", None, "i"),
    ("chari0301", "í", None, "i"),
    ("chari0302", "î", None, "i"),
    ("chari0303", "ĩ", None, "i"),
    ("chari0304", "ī", None, "i"),
    ("charj0303", None, "j̃", "j"),
    ("charj0308", None, "j̈", "j"),
    ("charl0303", None, "l̃", "l"),
    ("charl0309", None, "l̉", "l"),
    ("charm0303", None, "m̃", "m"),
    ("charm0304", None, "m̄", "m"),
    ("charn0303", "ñ", None, "n"),
    ("charn0304", None, "n̄", "n"),
    ("charo0300", "ò", None, "o"),
    ("charo0302", "ô", None, "o"),
    ("charo0303", "õ", None, "o"),
    ("charo0304", "ō", None, "o"),
    ("charp0301", "ṕ", None, "p"),
    ("charp0303", None, "p̃", "p"),
    ("charp0307", None, "ṗ", "p"),
    ("charq0300", None, "q̀", "q"),
    ("charq0301", None, "q́", "q"),
    ("charq0303", None, "q̃", "q"),
    ("charq0304", None, "q̄", "q"),
    ("charq0308", None, "q̈", "q"),
    ("charq0366", None, "qͦ", "q"),
    ("charr0303", None, "r̃", "r"),
    ("charr0304", None, "r̄", "r"),
    ("chars0303", None, "s̃", "s"),
    ("chars0308", None, "s̈", "s"),
    ("charS0308", None, "S̈", "S"),
    ("chart0303", None, "t̃", "t"),
    ("charu0300", "ù", None, "u"),
    ("charu0302", "û", None, "u"),
    ("charu0303", "ũ", None, "u"),
    ("charu0304", "ū", None, "u"),
    ("charx0303", None, "x̃", "x"),
    ("chary0302", "ŷ", None, "y"),
    ("chary0304", "ȳ", None, "y"),
    ("charf1e1", None, None, None),
    ("chare682", None, "q̇", "q"),
    ("chare8b3", None, None, "q"),
    ("chare8bf", None, None, "q"),
    ("chare68b", None, "ꝗ̃", "q"),
    ("char0308", None, "ꝗ̈", "q"),
    ("charebd1", None, "ꝺ̇", "d"),
    ("charf159", None, None, "d"),
    ("chare4e9", None, None, "e"),
    ("charg1E23", "ḣ", "ḣ", "h"),
    ("charo00F6", None, None, "o"),
    ("char01310323", "ı̣", None, "i"),
    ("char21840303", None, "ↄ̃", "con"),
    ("chara7590303", None, "ꝙ̃", "q"),
    ("chare8bf0301", None, "\ue8bf́", "q"),
    ("chare8bf0308", None, "\ue8bf̈", "q"),
    ("char-turnedfl", None, None, "fl."),
]


def characters() -> dict[str, tuple[str | None, str | None, str | None]]:
    """Id to (precomposed, composed, standardized)."""
    return {k: (pre, comp, std) for k, pre, comp, std in CHARACTERS}


def character_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHARACTERS, "id string, precomposed string, composed string, standardized string")


def glyph_lookup(refs: DataFrame) -> DataFrame:
    """``ref``, ``text``, ``glyph`` of glyph elements: precomposed, else composed, else the element's own text, else standardized, else ``@``.

    The table has about a hundred rows whatever the data, so it is sent to every executor.
    """
    table = F.broadcast(character_table(refs.sparkSession))
    j = refs.join(table, F.regexp_replace("ref", "^#", "") == F.col("id"), "left")
    return j.select("ref", "text", F.coalesce("precomposed", "composed", F.when(F.col("text") != "", F.col("text")), "standardized", F.lit("@")).alias("glyph"))
