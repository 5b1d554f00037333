"""Splitting oversized texts at natural boundaries, with an overlap (problem 6)."""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paleoline.session import current

LIMIT, OVERLAP = 480, 40
_SENTENCE = re.compile(r"[.!?;:][⦄)\"'”’]*\s+")
_BLANK = re.compile(r"\s+")


def _free(text: str, at: int) -> bool:
    """A cut before ``at`` parts no mark from its letter."""
    return at >= len(text) or not (U.combining(text[at]) or text[at] in "‍️") and text[at - 1] != "‍"


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) in code points of pieces of at most ``limit`` bytes that cover ``text``.

    A piece ends after a sentence's end if one lies in its last third, else after the last blank that leaves it longer
    than the overlap, else, as in a word without blanks, at the limit, but never between a letter and its marks. The next
    piece begins at the last word start at least ``overlap`` code points before that end, if it isn't more than half as
    much farther, else exactly that far back. The piece always goes on beyond the last one's end.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    bytes_to = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
    if bytes_to[-1] <= limit:
        return [(0, len(text))]
    blanks = np.fromiter((m.end() for m in _BLANK.finditer(text)), np.int64)
    sentences = np.fromiter((m.end() for m in _SENTENCE.finditer(text)), np.int64)
    out, start, done = [], 0, 0
    while True:
        most = int(np.searchsorted(bytes_to, bytes_to[start] + limit, "right")) - 1
        if most >= len(text):
            out.append((start, len(text)))
            return out
        end = 0
        floor = max(done, start + (most - start) // 3 * 2)
        k = int(np.searchsorted(sentences, most, "right"))
        if k and sentences[k - 1] > floor:
            end = int(sentences[k - 1])
        else:
            k = int(np.searchsorted(blanks, most, "right"))
            if k and blanks[k - 1] > max(done, start + overlap):
                end = int(blanks[k - 1])
        if not end:
            end = most
            while end > max(done, start) + 1 and not _free(text, end):
                end -= 1
        out.append((start, end))
        back = max(end - overlap, start + 1)
        k = int(np.searchsorted(blanks, back, "right"))
        new = int(blanks[k - 1]) if k and blanks[k - 1] >= back - overlap // 2 and blanks[k - 1] > start else back
        while new < end and not _free(text, new):
            new += 1
        if bytes_to[min(end + 1, len(text))] - bytes_to[new] > limit:  # a limit hardly above the overlap
            new = end
        start, done = new, end


def split_texts(df: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of ``text``: the keys, ``piece`` (from 0), ``n_pieces``, ``start``, ``end`` (code points) and ``piece_text``.

    Defined cases: null text gives no piece, empty text one empty piece, text within the limit itself as its only piece;
    repeated rows are cut each for itself; other columns are dropped. ``limit`` must hold a few characters (at least 8
    bytes). Only texts over the limit leave the engine.
    """
    if limit < 8 or overlap < 0:
        raise ValueError("limit must be at least 8 bytes and overlap not negative")
    rows = df.select(*keys, F.col(text).alias("_text")).where("_text is not null")
    small = rows.where(F.octet_length("_text") <= limit)
    small = small.select(*keys, F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.char_length("_text").alias("end"), F.col("_text").alias("piece_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[(k, i, s, e, t[s:e]) for i, (s, e) in enumerate(cut(t, limit, overlap))] for k, t in enumerate(b["_text"])]
            flat = [x for f in found for x in f]
            out = b[keys].iloc[[x[0] for x in flat]].reset_index(drop=True)
            out["piece"], out["start"], out["end"], out["piece_text"] = ([x[k] for x in flat] for k in (1, 2, 3, 4))
            out["n_pieces"] = [len(f) for f in found for _ in f]
            yield out[[*keys, "piece", "n_pieces", "start", "end", "piece_text"]]

    return small.unionByName(rows.where(F.octet_length("_text") > limit).mapInPandas(run, small.schema))


def line_pieces(lines: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, only_large: bool = False) -> DataFrame:
    """Pieces of ``source_sic`` and ``target_corr`` of the current lines, by ``id`` and ``field``.

    ``only_large`` keeps to texts over the limit; then no other text is shuffled to find the current lines.
    """
    fields = ("source_sic", "target_corr")
    keep = [F.when(F.octet_length(f) > limit, F.col(f)).alias(f) if only_large else F.col(f) for f in fields]
    cur = current(lines, *keep)
    long = reduce(DataFrame.unionByName, [cur.select("id", F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return split_texts(long, ["id", "field"], "text", limit, overlap)
