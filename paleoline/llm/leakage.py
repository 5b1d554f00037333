"""Evaluation passages inside training documents, found with an FM-index of each shard (problem 9)."""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paleoline.llm.fmindex import FMIndex
from paleoline.llm.text import BRACKETS, _char, clean_base, level
from paleoline.session import materialise

WORDS, SHARD_WORDS, BLOCK_WORDS = 12, 2_000_000, 2_000_000
_PART = 100_000
#: A hyphen at a line end, with whatever may be invisible around it; ``_divisions`` looks closer.
_DIVIDED = re.compile(r"(?<=[^\s!-@\[-`{-~‐‑⸗﹣－])[-\u00ad‐‑⸗﹣－]((?:[^\w\n\r!-~]|[\u115f\u1160\u3164\uffa0])*)[\n\r]")
_SPANS = "array<struct<start:int,end:int>>"
#: A span with the numbers of its first and last word.
_NUMBERED = "struct<start:int,end:int,first:int,last:int>"
_LETTER = re.compile(r"[^\W\d_]")
_RAW = re.compile(r"\S+")


def _unseen(c: str) -> bool:
    return c in BRACKETS or _char(c)[1] == "invisible"


def _blank(c: str) -> bool:
    return c.isspace() or _char(c)[0] == " "


def _divisions(t: str) -> list[tuple[int, int]]:
    """(start, end) of what stands between the parts of each divided word: a hyphen of any width after a letter, the line end, blanks.

    Marks, abbreviation brackets and invisible characters may follow the letter, and brackets and invisible ones the hyphen.
    """
    out = []
    for m in _DIVIDED.finditer(t):
        k = m.start() - 1
        while k > 0 and (_unseen(t[k]) or U.category(t[k])[0] == "M"):
            k -= 1
        if not _unseen(t[k]) and _LETTER.match(t[k]) and all(_unseen(c) or _blank(c) for c in m[1]):
            end = m.end()
            while end < len(t) and (_blank(t[end]) or _char(t[end])[1] == "invisible"):
                end += 1
            out.append((m.start(), end))
    return out


def _join_divided(t: str) -> str:
    if "⠀" in t:  # a blank that the splitting of words doesn't know
        t = t.replace("⠀", " ")
    gone = _divisions(t) if "\n" in t or "\r" in t else []
    return "".join(t[a:b] for a, b in zip([0, *[e for _, e in gone]], [*[s for s, _ in gone], len(t)])) if gone else t


def levelled_words(t: str) -> list[str]:
    """Words of a text as they are compared: split at any blank, divided ones joined, levelled letters, empty ones skipped."""
    return [w for w in (level(clean_word(x)) for x in _join_divided(t).split()) if w]


def clean_word(w: str) -> str:
    return w if w.isascii() else clean_base(w)[0]


def _spans(t: str) -> list[tuple[int, int, str]]:
    """(start, end, levelled word) in code points of the text as stored; a divided word spans its line end."""
    t = t.replace("⠀", " ")
    keep, gone = np.ones(len(t), bool), _divisions(t) if "\n" in t or "\r" in t else []
    for s, e in gone:
        keep[s:e] = False
    back = np.flatnonzero(keep)
    out = []
    for m in _RAW.finditer("".join(t[i] for i in back) if gone else t):
        if w := level(clean_word(m.group())):
            out.append((int(back[m.start()]), int(back[m.end() - 1]) + 1, w))
    return out


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"item_id": b["item_id"], "words": [_hashes(levelled_words(t)).tobytes() for t in b["text"]]})


class _Items:
    """The items of one block: their words as numbers (from 2) of the sorted distinct word hashes, one item after the other."""

    def __init__(self, rows: list[tuple[int, bytes]], words: int) -> None:
        held = [np.frombuffer(w, np.uint64) for _, w in rows]
        size = np.array([len(h) for h in held], np.int64)
        self.words = words
        self.known, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_inverse=True)
        self.flat = (flat.ravel() + 2).astype(np.int32)
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.ends = np.cumsum(size)

    def number(self, words: list[str]) -> np.ndarray:
        """Numbers of levelled words; 1 for words of no item, 0 for the empty one."""
        h = _hashes(words)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        out = np.where(self.known[at] == h, at + 2, 1)
        out[[k for k, w in enumerate(words) if not w]] = 0
        return out

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows of ``words`` words as rows, and the number of the item each is of, a part at a time."""
        for lo in range(0, len(self.flat), _PART):
            start = np.arange(lo, min(lo + _PART, len(self.flat)))
            owner = np.searchsorted(self.ends, start, "right")
            start, owner = start[(k := start + self.words <= self.ends[owner])], owner[k]
            if len(start):
                yield self.flat[start[:, None] + np.arange(self.words)].astype(np.int64), owner


def _search_shard(texts: list[str], docs: list[int], items: _Items, memo: dict[str, int], spans: bool) -> Iterator[tuple]:
    """Index one shard, look all windows up in it, and locate them."""
    raw = [_join_divided(t).split() for t in texts]
    fresh = list({x for w in raw for x in w if x not in memo})
    memo.update(zip(fresh, items.number([level(clean_word(x)) for x in fresh]).tolist()))
    seqs = []
    for w in raw:
        a = np.fromiter(map(memo.__getitem__, w), np.int32, len(w))
        seqs.append(a[a > 0])
    flat = np.concatenate([x for s in seqs for x in (s, np.array([1], np.int32))])
    size = np.array([len(s) + 1 for s in seqs])
    owner = np.repeat(np.arange(len(seqs)), size)
    number = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    # Words of no item can be in no match: runs of them become one separator, which shortens the index without loss.
    keep = np.concatenate([[True], (flat[1:] != 1) | (flat[:-1] != 1)])
    flat, owner, number = flat[keep], owner[keep], number[keep]
    index = FMIndex(flat, len(items.known) + 2)
    parts = [np.zeros((3, 0), np.int64)]
    for windows, item in items.windows():
        lo, hi = index.search(windows)
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        rows = np.repeat(lo[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        distinct, inverse = np.unique(rows, return_inverse=True)  # a window that items share is located once
        at = index.locate(distinct)[inverse]
        parts.append(np.unique(np.stack([owner[at], np.repeat(items.ids[item[hit]], n), number[at]] if spans else [owner[at], np.repeat(items.ids[item[hit]], n), np.zeros(len(at), np.int64)]), axis=1))
    found = np.concatenate(parts, axis=1)
    for d in np.unique(found[0]).tolist():
        own = found[:, found[0] == d]
        merged = None
        if spans:
            places, first = _spans(texts[d]), np.unique(own[2])
            cut = np.flatnonzero(np.diff(first) > items.words) + 1  # windows that overlap or touch are one span
            merged = [{"start": places[g[0]][0], "end": places[g[-1] + items.words - 1][1], "first": int(g[0]), "last": int(g[-1]) + items.words - 1} for g in np.split(first, cut)]
        yield from ((docs[d], i, merged) for i in np.unique(own[1]).tolist())


def leaked(documents: DataFrame, eval_items: DataFrame, words: int = WORDS, spans: bool = False, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Documents that share at least ``words`` consecutive words with an item: ``doc_id``, ``item_id``, and ``spans``.

    Words are split at any blank, invisible characters are dropped, a word divided by a hyphen of any width at a line end is
    one, also with marks, brackets or invisible characters beside the hyphen, words are compared by their levelled letters, and words without letters are skipped. ``spans`` (else null) are the stretches
    of the stored text, in code points, that all items' matches in this document cover together, ready for removal.

    Each task indexes its share of the documents in shards of about ``shard_words`` words: suffix array, wavelet matrix of
    the transform, sampled positions. All windows of the items are searched backward at once, and what is found is located
    by the sampled positions; spans are the located words. Word numbers stand for 64-bit hashes of levelled words.

    The items are the stated query set; their words' hashes, 8 bytes each, come to the driver in blocks of about
    ``BLOCK_WORDS`` words and are sent to the executors as at most 12 bytes a word (24 MB a block, unless one item is
    longer); windows are made there, ``_PART`` at a time. Each block is one pass over the documents.

    Defined cases: null or empty texts match nothing; items of fewer than ``words`` words match nothing; repeated rows
    give one row; null ids are left out; empty tables give no rows.
    """
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null and text <> ''").select("doc_id", "text")
    items = eval_items.where("item_id is not null and text <> ''").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (BLOCK_WORDS * 6)))
    hashed = items.mapInPandas(_item_words, "item_id bigint, words binary").where(F.length("words") >= 8 * words)
    hashed = materialise(hashed, "leak-items") if blocks > 1 else hashed
    out = None
    for k in range(blocks):
        part = hashed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        if not part:
            continue
        sent = spark.sparkContext.broadcast(_Items([(r["item_id"], bytes(r["words"])) for r in part], words))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            items, memo = sent.value, {}
            texts: list[str] = []
            docs: list[int] = []
            held = 0

            def flush() -> pd.DataFrame:
                return pd.DataFrame(list(_search_shard(texts, docs, items, memo, spans)), columns=["doc_id", "item_id", "spans"])

            for b in batches:
                for d, t in zip(b["doc_id"], b["text"]):
                    texts.append(t)
                    docs.append(d)
                    held += len(t) // 6 + 1
                    if held >= shard_words:
                        yield flush()
                        texts.clear()
                        docs.clear()
                        held = 0
                if len(memo) > 2_000_000:
                    memo.clear()
            if texts:
                yield flush()

        found = docs.mapInPandas(run, f"doc_id bigint, item_id bigint, spans array<{_NUMBERED}>")
        found = materialise(found, "leaked") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"doc_id bigint, item_id bigint, spans {_SPANS}")
    if not spans:
        return out.select("doc_id", "item_id").distinct().withColumn("spans", F.lit(None).cast(_SPANS))
    all_of = out.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"), F.flatten(F.collect_set("spans")).alias("spans"))
    return all_of.select("doc_id", F.explode("items").alias("item_id"), _merged("spans").cast(_SPANS).alias("spans"))


def _merged(spans: str) -> Column:
    """Spans of all blocks, those that overlap or whose words follow each other as one: what one block would give."""

    def put(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"], F.greatest(last["end"], s["end"]), last["first"], F.greatest(last["last"], s["last"])).cast(_NUMBERED)
        return F.when((F.size(done) > 0) & (s["first"] <= last["last"] + 1), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    merged = F.aggregate(F.array_sort(spans), F.array().cast(f"array<{_NUMBERED}>"), put)
    return F.transform(merged, lambda s: F.struct(s["start"], s["end"]))


def leaked_items(pairs: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Every item with the number of documents that hold it; 0 if none."""
    n = pairs.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))
    return eval_items.select("item_id", "set_name").distinct().join(n, "item_id", "left").select("item_id", "set_name", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"))
