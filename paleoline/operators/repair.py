"""Repair of misplaced line breaks in linked lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paleoline.functions.align import _REPAIR, break_in_expansion, plain_letter
from paleoline.functions.text import FOLD_REPAIR, first_token, fold, last_token
from paleoline.operators.components import components
from paleoline.session import current, materialise

VIEWS = ("source_sic", "source_corr", "target_sic", "target_corr")


@dataclass
class Line:
    source_sic: str
    source_corr: str
    target_sic: str
    target_corr: str


def _same(a: str, b: str) -> bool:
    return a.translate(_REPAIR) == b.translate(_REPAIR)


def _last(t: str) -> str:
    w = t.split()
    return w[-1] if w else t


def _first(t: str) -> str:
    w = t.split(None, 1)
    return w[0] if w else t


def _move(a: str, b: str, n: int) -> tuple[str, str] | None:
    """The last ``n`` letters of ``a`` go before ``b``, or the first ``-n`` of ``b`` behind ``a``; null if there aren't as many."""
    both = a + b
    cut = len(a) - n
    return (both[:cut], both[cut:]) if n and 0 <= cut <= len(both) else None


def _is_farther(a: Line, b: Line, n: int) -> bool:
    """Whether moving ``n`` letters takes the target's break farther from where the alignment of both words puts it."""
    src, tgt = (_last(a.source_sic), _first(b.source_sic)), (_last(a.target_sic), _first(b.target_sic))
    if "".join(src) == "".join(tgt):
        return False
    ideal = break_in_expansion("".join(src), "".join(tgt), len(src[0]))
    return ideal is not None and abs(len(tgt[0]) - n - ideal) > abs(len(tgt[0]) - ideal)


def _begins_otherwise(b: Line) -> bool:
    x = b.source_sic[0]
    return x.isascii() and x.isprintable() and not _same(x, b.target_sic[0])


def _spilled(a: Line, b: Line) -> int:
    """A: the next line's target begins with up to five letters that end this line's source."""
    if not _begins_otherwise(b):
        return 0
    plain = next((c for c in reversed(a.source_sic) if plain_letter(c)), None)
    for n in range(1, min(6, len(b.target_sic))):
        if _same(b.target_sic[n], b.source_sic[0]) and (plain is None or _same(b.target_sic[n - 1], plain)) and len(a.source_sic) >= n and _same(a.source_sic[-n:], b.target_sic[:n]):
            return 0 if _is_farther(a, b, -n) else -n
    return 0


def _held_back(a: Line, b: Line) -> int:
    """B: this line's target ends with up to five letters that begin the next line's source; the longest counts."""
    if not _begins_otherwise(b):
        return 0
    for n in range(5, 0, -1):
        if len(a.target_sic) >= n and _same(b.source_sic[:n], a.target_sic[-n:]):
            return 0 if _is_farther(a, b, n) else n
    return 0


def _abbreviated(t: str) -> bool:
    return not all(map(plain_letter, t))


def _corrected(a_src: str, b_src: str, b_tgt: str) -> bool:
    """Whether different first letters come from an editor's correction, not from an expansion at the break."""
    x, y = b_src[:1], b_tgt[:1]
    if not (x and y and x.isascii() and y.isascii()) or _same(x, y):
        return False
    if _abbreviated(b_src) or _abbreviated(a_src) and len(b_tgt) > len(b_src):
        return False
    if b_tgt.endswith(b_src) or b_src.endswith(b_tgt):
        return False
    return not any(_same(c, x) for c in b_tgt[1:4])


def _expanded(a: Line, b: Line) -> int:
    """C: an abbreviation is expanded at the break, and the alignment of both words puts the break elsewhere."""
    if not a.source_sic or not a.target_sic:
        return 0
    s0, s1, t0, t1 = _last(a.source_sic), _first(b.source_sic), _last(a.target_sic), _first(b.target_sic)
    word = t0 + t1
    if _corrected(s0, s1, t1) or s0 + s1 == word:
        return 0
    to = break_in_expansion(s0 + s1, word, len(s0))
    if to is None or to == len(t0):
        return 0
    fits = lambda k: k < len(word) and _same(word[k], s1[0])
    if fits(len(t0)) and not fits(to):
        return 0
    n = len(t0) - to
    return n if _move(a.target_sic, b.target_sic, n) and (n <= len(a.target_sic) if n > 0 else -n <= len(b.target_sic)) else 0


def _correction_break(a: Line, b: Line) -> bool:
    """D: where reading and correction differ at the break, the correction's break follows the reading's; true if lines changed."""
    if not (a.source_sic and b.source_sic and a.source_corr and b.source_corr):
        return False
    s0, c0 = _last(a.source_sic), _last(a.source_corr)
    sic, corr = s0 + _first(b.source_sic), c0 + _first(b.source_corr)
    if sic == corr:
        return False
    at = break_in_expansion(sic, corr, len(s0))
    if at is None:
        return False
    source = _move(a.source_corr, b.source_corr, len(c0) - at)
    target = None
    if a.target_corr and b.target_corr:
        t0 = _last(a.target_corr)
        word = t0 + _first(b.target_corr)
        to = at if corr == word else break_in_expansion(corr, word, at)
        target = None if to is None else _move(a.target_corr, b.target_corr, len(t0) - to)
    if source:
        a.source_corr, b.source_corr = source
    if target:
        a.target_corr, b.target_corr = target
    return bool(source or target)


def repair_pair(a: Line, b: Line) -> str:
    """Repair one linked pair in place; the letters of the kinds of repair made."""
    if not b.source_sic or not b.target_sic:
        return ""
    kinds = ""
    for kind, find in (("A", _spilled), ("B", _held_back), ("C", _expanded)):
        if n := find(a, b):
            a.target_sic, b.target_sic = _move(a.target_sic, b.target_sic, n)
            giver = a.target_corr if n > 0 else b.target_corr
            if giver and len(giver) >= abs(n):
                a.target_corr, b.target_corr = _move(a.target_corr, b.target_corr, n)
            kinds = kind
            break
    return kinds + ("D" if _correction_break(a, b) else "")


_OUT = "id string, source_corr string, target_sic string, target_corr string, kinds string, n_fixes int"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs sorted by component and order, one after another; only the current component's changed lines are held."""
    comp, held, kinds = None, {}, {}

    def flush() -> pd.DataFrame:
        return pd.DataFrame([(k, x.source_corr, x.target_sic, x.target_corr, "".join(kinds[k]), len(kinds[k])) for k, x in held.items()], columns=[c.split()[0] for c in _OUT.split(", ")])

    for b in batches:
        for r in b.itertuples(index=False):
            if r.comp != comp:
                if held:
                    yield flush()
                comp, held, kinds = r.comp, {}, {}
            a = held.get(r.id) or Line(*(getattr(r, f"a_{v}") or "" for v in VIEWS))
            z = a if r.next_id == r.id else held.get(r.next_id) or Line(*(getattr(r, f"b_{v}") or "" for v in VIEWS))
            if made := repair_pair(a, z):
                held[r.id], held[r.next_id] = a, z
                kinds.setdefault(r.id, []).append(made)
                kinds.setdefault(r.next_id, [])
    if held:
        yield flush()


def break_repairs(lines: DataFrame, order: str = "file_pos") -> DataFrame:
    """Changed lines: ``id``, ``source_corr``, ``target_sic``, ``target_corr``, ``kinds`` of the repairs of the pairs it begins, ``n_fixes``.

    Pairs of lines joined by a live link are repaired in the order of ``order``, each seeing what was changed before. The engine
    keeps only connected sets of links that hold a trigger (different first letters, different words at the break, or a
    correction there); a set is folded in order by one task, which holds just its changed lines. Null views count as empty.
    """
    cur = materialise(current(lines, *VIEWS, "nonbreaking_next_line", order), "repair-lines")
    links = cur.where("nonbreaking_next_line <> ''")
    nxt = cur.select(F.col("id").alias("next_id"), *[F.col(v).alias(f"b_{v}") for v in VIEWS])
    pairs = links.withColumnRenamed("nonbreaking_next_line", "next_id").join(nxt, "next_id").select("id", "next_id", F.col(order).alias("o"), *[F.col(v).alias(f"a_{v}") for v in VIEWS], *[f"b_{v}" for v in VIEWS])
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    words = lambda v: F.concat(last_token(e(f"a_{v}")), first_token(e(f"b_{v}")))
    first = lambda c: fold(F.left(e(c), F.lit(1)), FOLD_REPAIR)
    trigger = (first("b_source_sic") != first("b_target_sic")) | (words("source_sic") != words("target_sic")) | (words("source_sic") != words("source_corr")) | (words("source_corr") != words("target_corr"))
    pairs = materialise(pairs.withColumn("trigger", trigger), "repair-pairs")
    ends = pairs.select(F.col("id").alias("doc_id"), F.col("id").alias("entity")).unionByName(pairs.select(F.col("next_id").alias("doc_id"), F.col("id").alias("entity")))
    comp = components(ends).select(F.col("doc_id").alias("id"), F.col("group").alias("comp"))
    held = materialise(pairs.join(comp, "id"), "repair-components")
    live = held.where("trigger").select("comp").distinct()
    work = held.join(live, "comp", "left_semi").select("comp", "o", "id", "next_id", *[f"{s}_{v}" for s in "ab" for v in VIEWS])
    work = work.repartition("comp").sortWithinPartitions("comp", "o", "id").drop("o")
    return work.mapInPandas(_fold, _OUT)
