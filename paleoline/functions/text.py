"""Column functions of the line table: ids, markers, tokens, equivalences. All run inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and separators of the line table.
ABBR_OPEN, ABBR_CLOSE, LINE_SEP, LINE_BREAK = "⦃", "⦄", "¬", "↵"
# Letters that count as equal; the diagnostic table has one pair more than the repair table.
FOLD_REPAIR = ("vVſ⁊ʒ", "uUsyz")
FOLD_DIAG = ("vVſ⁊ʒꝗ", "uUsyzq")
PUNCTUATION = ".,;:!?()[]\"'"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def line_key(line_id: str | Column) -> Column:
    """Sort key of a line id ``{work}-{vol}-{page}-lb-[m]{seq}`` as a struct; malformed numbers are null and sort first."""
    x = _c(line_id)
    head, tail = F.split_part(x, F.lit("-lb-"), F.lit(1)), F.split_part(x, F.lit("-lb-"), F.lit(2))
    parts = F.split(head, "-")
    number = lambda c: c.try_cast("int")
    return F.struct(
        F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "-").alias("work"),
        number(F.try_element_at(parts, F.lit(-2))).alias("vol"),
        number(F.try_element_at(parts, F.lit(-1))).alias("page"),
        tail.startswith("m").alias("marg"),
        number(F.regexp_replace(tail, "^m", "")).alias("seq"),
    )


def crosses_page(a: str | Column, b: str | Column) -> Column:
    """Whether two lines lie on different pages: work, volume or page differ."""
    page = lambda x: F.struct(*[line_key(x)[n] for n in ("work", "vol", "page")])
    return ~page(a).eqNullSafe(page(b))


def strip_markers(x: str | Column) -> Column:
    return F.translate(_c(x), ABBR_OPEN + ABBR_CLOSE, "")


def fold(x: str | Column, table: tuple[str, str] = FOLD_DIAG) -> Column:
    """One letter for each equivalence class, so equality modulo the classes is plain equality and can be joined on."""
    return F.translate(_c(x), *table)


def fold_markers(x: str | Column) -> Column:
    """:func:`fold`, with both markers deleted."""
    return F.translate(_c(x), FOLD_DIAG[0] + ABBR_OPEN + ABBR_CLOSE, FOLD_DIAG[1])


def last_token(x: str | Column) -> Column:
    """Last word between blanks, or the whole text if there is none."""
    t = F.regexp_extract(_c(x), r"(?U)(\S+)\s*$", 1)
    return F.when(t == "", _c(x)).otherwise(t)


def first_token(x: str | Column) -> Column:
    t = F.regexp_extract(_c(x), r"(?U)^\s*(\S+)", 1)
    return F.when(t == "", _c(x)).otherwise(t)


def normalize_space(x: str | Column) -> Column:
    return F.trim(F.regexp_replace(_c(x), "[ \\t\\r\\n]+", " "))


def bare_word(x: str | Column) -> Column:
    """Word without punctuation at its ends, lower case."""
    return F.lower(F.btrim(_c(x), F.lit(PUNCTUATION)))


def wrapped(x: str | Column) -> Column:
    """Abbreviation in markers, inner blanks normalised."""
    return F.concat(F.lit(ABBR_OPEN), normalize_space(x), F.lit(ABBR_CLOSE))


def closed_spans(x: str | Column) -> Column:
    """Texts of the closed abbreviation spans."""
    return F.regexp_extract_all(_c(x), F.lit(f"{ABBR_OPEN}([^{ABBR_CLOSE}]*){ABBR_CLOSE}"), F.lit(1))


def has_abbreviation_letters(x: str | Column) -> Column:
    """Any mark, private-use character or letter outside ASCII."""
    return _c(x).rlike(r"[\p{M}\p{Co}]|[\p{L}&&[^\x00-\x7F]]")


def last_plain(x: str | Column) -> Column:
    """The last character that is no abbreviation letter; null if there is none."""
    sign = r"(?:[\p{M}\p{Co}]|[\p{L}&&[^\x00-\x7F]])"
    t = F.regexp_extract(_c(x), rf"(?s)((?!{sign}).){sign}*$", 1)
    return F.when(t != "", t)


def hash_uniform(seed: int, *parts: str | Column) -> Column:
    """A number in [0, 1) from a seed and columns, equal in every engine with md5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# Forms of page image ids, and how the image server names them; an id of neither form has no address.
FACS_FORMS = (("^(W[0-9]{7}-[0-9]{4})$", "$1"), ("^(W[0-9]{7})-([A-Z0-9])-([0-9]{4})$", "$1_$2-$3"))
#: The same for four-digit works, whose images lie in a folder of their work, and of its volume.
FACS_FOLDERS = (("^((W[0-9]{4})-([A-Z])-[0-9]{4})$", "$2!$3!$1"), ("^((W[0-9]{4})-[0-9]{4})$", "$2!$1"))


def facs_url(facs: str | Column, server: str = "https://facs.example.invalid/iiif/image/", forms: tuple[tuple[str, str], ...] = FACS_FORMS, suffix: str = "") -> Column:
    """Image address of a page image id by the first of the ``forms`` (pattern, replacement) it has, with ``suffix``; empty if it has none."""
    bare = F.regexp_replace(_c(facs), "^(facs:|#)", "")
    out = None
    for pattern, name in forms:
        url = F.concat(F.lit(server), F.regexp_replace(bare, pattern, name), F.lit(suffix))
        out = F.when(bare.rlike(pattern), url) if out is None else out.when(bare.rlike(pattern), url)
    return out.otherwise(F.lit(""))
