"""Visually identical text with different characters: one consistent form (problem 5), and levelled letters."""

from __future__ import annotations

import re
import unicodedata as U
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paleoline.session import current, is_small, materialise, small_or_plain

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "3", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
#: Decomposition tags of width and presentation forms. ``<compat>`` counts for ligatures and presentation forms only (U+FB00 and above), so the long s stays.
FORM_TAGS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>")
BRACKETS = "⦃⦄"

FLAGS = ("invisible", "blank", "form", "apart", "mixed")

#: Text in which nothing can need repair, as the engine's own regular expression: plain ASCII, brackets, and letters and signs of the editions.
PLAIN = "^[ -~⦃⦄¡-¬®-ɏʒẠ-ỿ⁊ꝑꝓꝙꝯ–—‘-”]*$"


@lru_cache(maxsize=4096)
def _char(c: str) -> tuple[str, str]:
    """What stands for one character, and the flag that calls for it."""
    cat = U.category(c)
    if cat == "Cf" or c in "͏ᅟᅠㅤﾠ" or "︀" <= c <= "️" or (cat == "Cc" and c not in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"):
        return "", "invisible"
    if c != " " and (c.isspace() or cat in ("Zs", "Zl", "Zp") or c == "⠀"):
        return " ", "blank"
    d = U.decomposition(c)
    if d and (d.startswith(FORM_TAGS) or d.startswith("<compat>") and c >= "ﬀ"):
        return "".join(_char(chr(int(x, 16)))[0] for x in d.split()[1:]), "form"
    if d and not d.startswith("<") and " " not in d and not ("ἀ" <= c <= "῿"):
        return U.normalize("NFC", c), "form"
    return c, ""


#: Beginnings of names of letters that belong to no script, or to the Latin one under another name.
_NO_SCRIPT = ("MODIFIER LETTER", "FEMININE ORDINAL", "MASCULINE ORDINAL", "MICRO SIGN", "SUPERSCRIPT", "SUBSCRIPT", "ROMAN NUMERAL")


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    if not c.isalpha():
        return ""
    name = U.name(c, "")
    for s in ("LATIN", "GREEK", "CYRILLIC"):
        if name.startswith(s):
            return s
    if not name or name.startswith(_NO_SCRIPT) or "℀" <= c <= "⅏":
        return ""
    return "OTHER" if c not in "ʒ" else "LATIN"


def clean_base(s: str, keep: str = "") -> tuple[str, set[str]]:
    """Text without invisible characters, with ordinary blanks, usual widths and composed letters, and the flags that applied.

    Marks that have no single character, the long s, ae and oe, the abbreviation letters and whatever ``keep`` holds stay as they are.
    """
    flags: set[str] = set()
    if not s.isascii():
        for c in set(s).difference(keep):
            to, flag = _char(c)
            if flag:
                flags.add(flag)
                s = s.replace(c, to)
        composed = U.normalize("NFC", s)
        if len(composed) < len(s):
            flags.add("apart")
        s = composed
    elif not s.isprintable():
        for c in set(s).difference(keep):
            to, flag = _char(c)
            if flag:
                flags.add(flag)
                s = s.replace(c, to)
    return s, flags


def _mixes(token: str) -> bool:
    """Whether a run of letters, with their marks and abbreviation brackets, has a Latin letter and one of another script."""
    latin = other = False
    for c in token:
        if k := _script(c):
            latin, other = latin or k == "LATIN", other or k != "LATIN"
            if latin and other:
                return True
        elif not (c.isalpha() or c in BRACKETS or U.category(c)[0] == "M"):
            latin = other = False
    return False


#: The same letters the other way round, by script.
_BACK = {k: {to: c for c, to in LOOKALIKES.items() if _script(c) == k} for k in ("GREEK", "CYRILLIC")}


def _mixed(s: str) -> list[tuple[int, str, list[str], bool, bool]]:
    """(place among the blank-separated tokens, token, forms in one script, first form is Latin, certain) of tokens in doubt.

    A token is in doubt if a letter of another script stands in one word with a Latin one, or if it has only Cyrillic
    look-alikes, as it may be a wholly replaced word. The script of most of its letters is its own, Latin where as many are
    Latin, and its forms are the token with all look-alikes in its own script, then in the other; letters without a
    look-alike there leave a form out. A token with fewer Latin letters is certainly a Latin word only if all others are
    look-alikes and no other word of the line is in their script; one without any Latin letter is in doubt only if the
    line's other letters are mostly Latin. Whole Greek words are no case, nor ones joined to a Latin word by other signs.
    """
    if s.isascii():
        return []
    tokens = s.split(" ")
    held = [{} if t.isascii() else Counter(k for k in map(_script, t) if k) for t in tokens]
    if not any(k != "LATIN" for h in held for k in h):
        return []
    whole: Counter = Counter()
    for t, h in zip(tokens, held):
        if not h:
            whole["LATIN"] += sum(map(str.isalpha, t))
        elif len(h) == 1:
            whole.update(h)
        else:
            whole["LATIN"] += h["LATIN"]
    out = []
    for k, (t, h) in enumerate(zip(tokens, held)):
        strange = [x for x in h if x != "LATIN"]
        if not strange:
            continue
        n_strange = sum(h[x] for x in strange)
        one = strange[0] if len(strange) == 1 and strange[0] in _BACK else None
        known = all(c in LOOKALIKES or _script(c) in ("", "LATIN") for c in t)
        latin = "".join(LOOKALIKES.get(c, c) for c in t)
        if not h["LATIN"]:
            if known and one == "CYRILLIC" and whole["LATIN"] >= whole[one] - h[one]:
                out.append((k, t, [latin], True, False))
            continue
        back = "".join(_BACK[one].get(c, c) if _script(c) == "LATIN" else c for c in t) if one else ""
        back = back if one and not any(_script(c) == "LATIN" for c in back) else ""
        first = h["LATIN"] >= n_strange
        forms = [f for f in ((latin if known else "", back) if first else (back, latin if known else "")) if f]
        if known or _mixes(t):
            out.append((k, t, forms, bool(forms) and forms[0] == latin, first or known and not any(whole[x] for x in strange)))
    return out


def mixed_tokens(s: str) -> list[tuple[str, str, bool]]:
    """(token, token in the script it is most likely in, certain) of the tokens in doubt; as it is where a letter has no look-alike."""
    return [(t, forms[0] if forms else t, certain) for _, t, forms, _, certain in _mixed(s)]


def _put_back(s: str, at: dict[int, str]) -> str:
    """``s`` with the blank-separated tokens at the given places replaced, and no other."""
    return " ".join(at.get(k, t) for k, t in enumerate(s.split(" "))) if at else s


def clean_now(s: str) -> str:
    """Cleaned text for one row on its own: look-alikes are replaced in every token that is certainly a Latin word, without the vocabulary."""
    s, _ = clean_base(s)
    return _put_back(s, {k: forms[0] for k, _, forms, latin, certain in _mixed(s) if certain and latin})


_LEVEL = str.maketrans({"v": "u", "j": "i", "æ": "ae", "œ": "oe", "ſ": "s"})
_NOT_LETTERS = re.compile("[^a-z]+")


def level(s: str) -> str:
    """Levelled letters: only a-z, without case, accents, marks, brackets and blanks; long s = s, v = u, j = i, ae and oe open."""
    return _NOT_LETTERS.sub("", (s if s.isascii() else U.normalize("NFKD", s)).lower().translate(_LEVEL))


def _word(t: str) -> str:
    return t.strip(".,;:!?()[]\"'" + BRACKETS).replace("⦃", "").replace("⦄", "").lower()


def _first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for s in b["text"]:
            base, flags = clean_base(s)
            mixed = [{"at": k, "forms": forms, "words": [_word(f) for f in forms], "latin": latin, "certain": certain} for k, _, forms, latin, certain in _mixed(base)]
            rows.append((base, [f for f in FLAGS if f in flags], mixed))
        yield pd.DataFrame({"id": b["id"], "field": b["field"], "clean": [r[0] for r in rows], "flags": [r[1] for r in rows], "mixed": [r[2] for r in rows]})


_FIRST = "id string, field string, clean string, flags array<string>, mixed array<struct<at:int,forms:array<string>,words:array<string>,latin:boolean,certain:boolean>>"


def _put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = b[["id", "field", "clean", "flags"]].copy()
        for k, (s, flags, mixed, known) in enumerate(zip(b["clean"], b["flags"], b["mixed"], b["known"])):
            known = set(known) if known is not None else set()
            at, flag = {}, False
            for m in mixed:
                hit = next((j for j, w in enumerate(m["words"]) if w and w in known), None)
                if hit is not None:
                    at[m["at"]] = m["forms"][hit]
                flag = flag or (m["certain"] if hit is None else m["latin"] == (hit == 0))
            out.iat[k, 2] = _put_back(s, at)
            out.iat[k, 3] = [*flags, "mixed"] if flag else list(flags)
        yield out


def normalise_text(lines: DataFrame, fields: tuple[str, ...] = ("source_sic", "target_corr")) -> DataFrame:
    """One consistent form of the given fields of every current line: ``id``, ``field``, ``clean``, ``flags``.

    ``flags`` names what was found: ``invisible`` characters (dropped), ``blank`` other than the ordinary space (made one),
    ``form`` of width or presentation (usual letters), letter and accent ``apart`` (composed), and ``mixed``: a letter of
    any other script within a Latin word. Look-alikes are put right only in tokens of mixed scripts, and only if the result
    is a word of the corpus: one that stands in some current line in one script. The script of most of the token's letters
    comes first, then the other. A token neither of whose forms is a word stays as it is, flagged if it is a Latin word by
    :func:`_mixed`; one put right in Greek or Cyrillic has no flag. A token only of Cyrillic look-alikes in a Latin line is
    repaired and flagged only if the result is a word.

    Defined cases: null text gives null and no flags, empty text stays empty; rows with null id are left out; of repeated
    ids the current row counts; texts of any length are treated whole. Plain text is recognised by the engine and never
    leaves it; only the rest goes through Python. Words are looked up the other way round: the candidates, a small part of
    all words, are made distinct and matched against every word of the corpus.
    """
    cur = current(lines, *fields)
    long = materialise(reduce(DataFrame.unionByName, [cur.select("id", F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]), "text-current")
    plain = F.col("text").isNull() | F.col("text").rlike(PLAIN)
    first = materialise(long.where(~plain).mapInPandas(_first_pass, _FIRST), "text-first")
    words = first.select(F.explode(F.flatten("mixed.words")).alias("word")).where("word <> ''").distinct()
    strip = F.regexp_replace(F.lower(F.col("w")), "[.,;:!?()\\[\\]\"'⦃⦄]+", "")
    words = materialise(words, "text-words")
    corpus = long.select(F.explode(F.split("text", " ")).alias("w")).select(strip.alias("word"))
    # Frequent words are one row before anything is shuffled.
    found = corpus.join(F.broadcast(words), "word", "left_semi").distinct() if is_small(words) else corpus.distinct().join(words, "word", "left_semi")
    found = materialise(found, "text-vocabulary")
    return _with_vocabulary(long.where(plain), first, found)


def _with_vocabulary(plain: DataFrame, first: DataFrame, found: DataFrame) -> DataFrame:
    odd = first.where(F.size("mixed") > 0)
    hits = odd.select("id", "field", F.explode(F.flatten("mixed.words")).alias("word")).join(small_or_plain(found), "word").groupBy("id", "field").agg(F.collect_set("word").alias("known"))
    some = odd.join(hits, ["id", "field"], "left").select("id", "field", "clean", "flags", "mixed", "known").mapInPandas(_put, "id string, field string, clean string, flags array<string>")
    rest = first.where(F.size("mixed") == 0).select("id", "field", "clean", "flags")
    none = plain.select("id", "field", F.col("text").alias("clean"), F.array().cast("array<string>").alias("flags"))
    return none.unionByName(rest).unionByName(some)
