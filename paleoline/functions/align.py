"""Sequence alignment in Arrow-batched Python: span mapping, glyph restoration, differing letters, break positions."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paleoline.functions.text import ABBR_CLOSE, ABBR_OPEN, FOLD_DIAG, FOLD_REPAIR

# Glyphs and what they stand for in normalised text.
GLYPHS = {"ſ": "s", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}
_REPAIR, _DIAG = str.maketrans(*FOLD_REPAIR), str.maketrans(*FOLD_DIAG)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def unescape_nfc(s: pd.Series) -> pd.Series:
    """Character references resolved, then canonical composition; null stays null."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", html.unescape(x)))


@F.pandas_udf(T.StringType())
def char_name(s: pd.Series) -> pd.Series:
    """``U+XXXX 'c' (NAME)`` of the first character; empty text gives an empty name."""
    return s.map(lambda x: x if not x else f"U+{ord(x[0]):04X} '{x[0]}' ({unicodedata.name(x[0], 'UNKNOWN')})")


def _blocks(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def parse_spans(marked: str) -> tuple[str, list[tuple[int, int]]]:
    """Text without markers and the places of its closed spans. From an unclosed opener on, the rest, opener included, is plain; a closer without opener is dropped."""
    plain, spans, n = [], [], 0
    rest = marked
    while True:
        head, opener, tail = rest.partition(ABBR_OPEN)
        head = head.replace(ABBR_CLOSE, "")
        plain.append(head)
        n += len(head)
        if not opener:
            break
        inner, closer, rest = tail.partition(ABBR_CLOSE)
        if not closer:
            plain.append(opener + tail)
            break
        plain.append(inner)
        spans.append((n, n + len(inner)))
        n += len(inner)
    return "".join(plain), spans


def position_map(a: str, b: str) -> list[int]:
    """Place in ``b`` for every place in ``a``: one to one where equal, in proportion where replaced, the same place where deleted."""
    to = [0] * (len(a) + 1)
    for op, i, i2, j, j2 in _blocks(a, b):
        if op == "insert":
            continue
        scale = {"equal": 1.0, "delete": 0.0}.get(op)
        for k in range(i2 - i + 1):
            if scale is not None:
                to[i + k] = j + int(k * scale)
            else:
                to[i + k] = j2 if k == i2 - i else j + k * (j2 - j) // (i2 - i)
    return to


def align_spans(marked: str, output: str, target: str) -> list[dict[str, str]]:
    """Abbreviation, its expansion in the target, and in the output, for every closed span."""
    plain, spans = parse_spans(marked)
    if not spans:
        return []
    gold = position_map(plain, target)
    pred = gold if output == target else position_map(plain, output)
    return [{"abbr": plain[s:e], "gold": target[gold[s] : gold[e]], "predicted": output[pred[s] : pred[e]]} for s, e in spans]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("abbr", "gold", "predicted")])))
def span_results(marked: pd.Series, output: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([[] if m is None or o is None or t is None else align_spans(m, o, t) for m, o, t in zip(marked, output, target)])


def restore(source: str, target: str) -> str:
    """``target`` with the glyphs of ``source`` put back where the alignment and the letters that follow support it."""
    if not source or not target or not any(g in source for g in GLYPHS):
        return target
    spelled = [(c, GLYPHS.get(g, "") and g) for g in source for c in GLYPHS.get(g, g)]
    glyph_at: dict[int, str] = {}
    for op, i, i2, j, j2 in _blocks("".join(c for c, _ in spelled), target.replace("ſ", "s")):
        if op in ("equal", "replace"):
            glyph_at.update({j + k: spelled[i + k][1] for k in range(min(i2 - i, j2 - j)) if spelled[i + k][1]})
    out, at = [], 0
    while at < len(target):
        glyph = glyph_at.get(at)
        if glyph and target.startswith(GLYPHS[glyph], at):
            out.append(glyph)
            at += len(GLYPHS[glyph])
        else:
            out.append(target[at])
            at += 1
    return "".join(out)


@F.pandas_udf(T.StringType())
def restore_glyphs(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([t if s is None or t is None else restore(s, t) for s, t in zip(source, target)])


def differing(a: str, b: str) -> list[dict[str, str | None]]:
    """Pairs of letters that differ in the alignment, shorter sides padded with nothing, equal classes left out."""
    out = []
    for op, i, i2, j, j2 in _blocks(a, b):
        if op == "equal":
            continue
        x, y = a[i:i2], b[j:j2]
        for k in range(max(len(x), len(y))):
            p, q = x[k : k + 1], y[k : k + 1]
            if p.translate(_DIAG) != q.translate(_DIAG):
                out.append({"a": p, "b": q})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in "ab"])))
def differing_letters(a: pd.Series, b: pd.Series) -> pd.Series:
    drop = str.maketrans("", "", ABBR_OPEN + ABBR_CLOSE)
    return pd.Series([differing(unicodedata.normalize("NFC", (x or "").translate(drop)), unicodedata.normalize("NFC", (y or "").translate(drop))) for x, y in zip(a, b)])


def changed_words(a: str, b: str, wrap_inserts: bool = False) -> list[tuple[int, int, int, int]]:
    """Ranges (in ``a``, in ``b``) of replaced text, widened to whole words and merged where they touch."""
    def widen(t: str, s: int, e: int) -> tuple[int, int]:
        while s > 0 and not t[s - 1].isspace():
            s -= 1
        while e < len(t) and not t[e].isspace():
            e += 1
        return s, e

    out: list[tuple[int, int, int, int]] = []
    for op, i, i2, j, j2 in _blocks(a, b):
        if op == "replace" or wrap_inserts and op in ("insert", "delete"):
            new = (*widen(a, i, i2), *widen(b, j, j2))
            if out and new[0] <= out[-1][1]:
                last = out.pop()
                new = (min(last[0], new[0]), max(last[1], new[1]), min(last[2], new[2]), max(last[3], new[3]))
            out.append(new)
    return out


def plain_letter(c: str) -> bool:
    """Whether a character is no sign of an abbreviation: no mark, no private-use character, no letter outside ASCII."""
    cat = unicodedata.category(c)
    return not (cat[0] == "M" or cat == "Co" or cat[0] == "L" and not c.isascii())


def _anchor(src: str, fs: str, ft: str, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int] | None:
    """First plain source letter with an equal target letter that the next plain letter confirms nearby."""
    plain = [k for k in range(a0, a1) if plain_letter(src[k])]
    for n, si in enumerate(plain):
        nxt = plain[n + 1] if n + 1 < len(plain) else a1
        ti = ft.find(fs[si], b0, b1)
        while ti >= 0:
            gap = nxt - si
            if nxt == a1 or ti + gap >= b1 or ft.find(fs[nxt], ti + 1, min(ti + 1 + 3 * gap, b1)) >= 0:
                return si, ti
            ti = ft.find(fs[si], ti + 1, b1)
    return None


def map_break(src: str, tgt: str, brk: int) -> int | None:
    """Where a break before ``src[brk]`` lies in the expanded word ``tgt``; null if that stays open.

    The words are narrowed to the stretch that holds the break: common heads and tails map one to one, and in between an
    anchor splits the stretch, until the break lies at an edge.
    """
    fs, ft = src.translate(_REPAIR), tgt.translate(_REPAIR)
    s0, s1, t0, t1 = 0, len(src), 0, len(tgt)
    while True:
        if s0 == s1 or brk <= s0:
            return t0
        if brk >= s1:
            return t1
        most = min(s1 - s0, t1 - t0)
        head = next((k for k in range(most) if fs[s0 + k] != ft[t0 + k]), most)
        if brk <= s0 + head:
            return t0 + brk - s0
        tail = next((k for k in range(most) if fs[s1 - 1 - k] != ft[t1 - 1 - k]), most)
        if tail and brk >= s1 - tail:
            return t1 - (s1 - brk)
        a0, a1, b0, b1 = s0 + head, s1 - tail, t0 + head, t1 - tail
        if a0 >= a1 or b0 >= b1:
            return b0
        found = _anchor(src, fs, ft, a0, a1, b0, b1)
        if found is None:
            return None
        si, ti = found
        s0, s1, t0, t1 = (a0, si, b0, ti) if brk <= si else (si, a1, ti, b1)


def break_in_expansion(src: str, tgt: str, brk: int) -> int | None:
    """:func:`map_break`, else counted back from the end if the words end in the same ASCII letters."""
    at = map_break(src, tgt, brk)
    if at is None and src and tgt and src[-1] == tgt[-1] and src[-1].isascii() and src[-1].isalpha():
        at = len(tgt) - (len(src) - brk)
        at = at if 0 < at < len(tgt) else None
    return at

