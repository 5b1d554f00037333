"""Same or nearly same lines across splits: an exact prefix-filter join on rare shingles (problem 2).

A line's levelled letters x and y are a pair if their edit distance is at most t = max(|x|, |y|) // 10. Of m disjoint
shingles of the evaluation line, t edits spoil at most t, so at least m - t stand unchanged in the training line, in
order, moved by no more than the edits before and after them. Short lines take their t + 2 rarest disjoint shingles of six
letters as prefix, of which two must stand, and the index holds every two of them; long ones take the rarest of their
adjacent shingles of seven, half as many beyond t as there are, which then must match. Training lines probe that index
with every shingle, or two shingles, they have, sieved first by what the index holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paleoline.llm.text import level
from paleoline.session import current, materialise, small_or_plain

LEAST, SHORT, Q_SHORT, Q_LONG = 50, 128, 6, 7
#: Partners of short lines have at most, and of long ones at least, so many letters.
MOST_SHORT, LEAST_LONG = (SHORT - 1) * 10 // 9, SHORT * 9 // 10
COUNT_BITS, SLICES, FAN_IN = 20, 64, 256
#: A filter has at least so many bits a key, up to ``MOST_BITS``, which bounds what is broadcast (16 MB each); with fewer than ``SHARP_BITS`` left, short lines are joined on single shingles, and with fewer than ``LEAST_BITS`` the filter is left out.
BITS_A_KEY, MOST_BITS, SHARP_BITS, LEAST_BITS, SLICE_BITS = 32, 1 << 27, 8, 2, 1 << 18

#: Letter counts at which a bit of the signature is set, per letter; an edit changes at most two counts by one, so it flips at most two bits.
#: 64 bits, around the usual counts in a line of about sixty letters, where they tell most.
_STEPS = {"e": range(5, 10), "a": range(4, 9), "i": range(4, 9), "u": range(3, 8), "o": range(2, 7), **{c: range(3, 7) for c in "st"}, **{c: range(2, 6) for c in "rn"}, "m": range(1, 5), **{c: range(1, 4) for c in "dclp"}, "b": range(1, 3), **{c: range(1, 2) for c in "qgfhx"}}
_AT = np.array([ord(c) - 97 for c, r in _STEPS.items() for _ in r])
_OVER = np.array([k for r in _STEPS.values() for k in r])


def most_edits(n: np.ndarray) -> np.ndarray:
    """The largest edit distance a line of ``n`` letters may have to any partner."""
    longest = n * 10 // 9
    longest = np.where(longest + 1 - n <= (longest + 1) // 10, longest + 1, longest)
    return longest // 10


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Flat:
    """Texts of a batch as one array of letters, with every shingle's code, text and place."""

    def __init__(self, texts: list[str], q: int) -> None:
        self.n = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        self.letters = np.frombuffer("".join(texts).encode(), np.uint8).astype(np.uint64) - 97
        total = len(self.letters)
        code = np.zeros(max(0, total - q + 1), np.uint64)
        for k in range(q if len(code) else 0):
            code = code * np.uint64(26) + self.letters[k : total - q + 1 + k]
        owner = np.repeat(np.arange(len(texts)), self.n)[: len(code)]
        place = np.arange(len(code)) - self.begin[owner]
        whole = place <= self.n[owner] - q
        self.code, self.owner, self.place = _mix(code[whole]), owner[whole], place[whole]

    def signature(self) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.n)), self.n)
        counts = np.bincount(owner * 26 + self.letters.astype(np.int64), minlength=26 * len(self.n)).reshape(-1, 26)
        return np.ascontiguousarray(np.packbits(counts[:, _AT] >= _OVER, axis=1)).view(np.int64).ravel()


def _length_class(n: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.floor(np.log2(np.maximum(n, LEAST) / LEAST))).astype(np.int64)


def _key(code: np.ndarray, cls: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    u = lambda x: x.astype(np.uint64)
    return _mix(code ^ _mix((u(cls) << np.uint64(48)) | (u(head + 8) << np.uint64(24)) | u(tail + 8))).view(np.int64)


def _count_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the shingles of short lines (upper half) and of long ones, by the upper bits of their code."""
    counts = np.zeros((2, 1 << COUNT_BITS), np.uint32)
    for b in batches:
        for half, (q, texts) in enumerate(((Q_SHORT, [t for t in b["t"] if len(t) <= MOST_SHORT]), (Q_LONG, [t for t in b["t"] if len(t) >= LEAST_LONG]))):
            counts[half] += np.bincount(_bucket(_Flat(texts, q).code), minlength=1 << COUNT_BITS).astype(np.uint32)
    yield pd.DataFrame({"slice": range(SLICES), "part": TaskContext.get().partitionId(), "counts": [x.tobytes() for x in np.split(counts.ravel(), SLICES)]})


def _bucket(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _add_slices(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((2 << COUNT_BITS) // SLICES, np.uint64)
    for x in b["counts"]:
        total += np.frombuffer(x, np.uint32)
    return pd.DataFrame({"slice": [key[0]], "part": [key[1]], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket of shingles occurs in all of ``texts`` (``t``): one row for short lines, one for long ones. Tasks are added up at most ``FAN_IN`` at a time (32 MB), however many there are."""
    tasks = texts.rdd.getNumPartitions()
    rows = texts.mapInPandas(_count_shingles, "slice int, part int, counts binary")
    while tasks:
        tasks = -(-tasks // FAN_IN) if tasks > FAN_IN else 0
        rows = rows.withColumn("part", F.expr(f"cast(part div {FAN_IN} as int)") if tasks else F.lit(0)).groupBy("slice", "part").applyInPandas(_add_slices, "slice int, part int, counts binary")
    out = np.zeros((SLICES, (2 << COUNT_BITS) // SLICES), np.uint32)
    for r in rows.collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(2, -1)


def _rarest_disjoint(cost: np.ndarray, need: np.ndarray, q: int) -> np.ndarray:
    """Per row, ``need`` places whose shingles of ``q`` don't overlap and whose costs add up to the least; as a mask."""
    n, width = cost.shape
    most = int(need.max())
    best = np.full((most + 1, width + q, n), np.inf)
    best[0] = 0
    take = np.zeros((most + 1, width, n), bool)
    for p in range(width - 1, -1, -1):
        with_p, without = cost[:, p][None] + best[:most, p + q], best[1:, p + 1]
        take[1:, p] = with_p < without
        best[1:, p] = np.minimum(with_p, without)
    out, left, free = np.zeros((n, width), bool), need.copy(), np.zeros(n, np.int64)
    rows = np.arange(n)
    for p in range(width):
        now = (left > 0) & (p >= free) & take[left, p, rows]
        out[now, p] = True
        left -= now
        free[now] = p + q
    return out


def short_prefix(texts: list[str], counts: np.ndarray) -> list[np.ndarray]:
    """Places of the ``most_edits + 2`` rarest disjoint shingles of each short evaluation line."""
    f = _Flat(texts, Q_SHORT)
    first = np.searchsorted(f.owner, np.arange(len(f.n)))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    order = np.argsort(f.n, kind="stable")
    for lo in range(0, len(order), 2048):
        rows = order[lo : lo + 2048]
        width = int(f.n[rows].max()) - Q_SHORT + 1
        ok = np.arange(width) < (f.n[rows] - Q_SHORT + 1)[:, None]
        at = np.where(ok, first[rows][:, None] + np.arange(width), 0)
        cost = np.where(ok, counts[_bucket(f.code[at])] + 1.0, np.inf)
        for r, m in zip(rows, _rarest_disjoint(cost, most_edits(f.n[rows]) + 2, Q_SHORT)):
            out[r] = np.flatnonzero(m)
    return out


def long_prefix(f: _Flat, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles of long evaluation lines are indexed, and how many of each: of m adjacent ones the rarest, half as many beyond t as there are."""
    at = np.flatnonzero(f.place % Q_LONG == 0)
    order = np.lexsort((f.place[at], counts[_bucket(f.code[at])], f.owner[at]))
    at = at[order]
    first = np.searchsorted(f.owner[at], np.arange(len(f.n)))
    most = most_edits(f.n)
    size = most + (f.n // Q_LONG - most + 1) // 2
    rank = np.arange(len(at)) - first[f.owner[at]]
    return at[rank < size[f.owner[at]]], size


def _pack(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Length and place in one number of few bytes, so the rows that are shuffled stay narrow; negative for texts of 65,536 letters or more."""
    return np.where(n < 1 << 16, (n << 16) | place, -((n << 31) | place))


def _unpack(p: str) -> tuple[str, str]:
    """SQL for length and place."""
    return f"if({p} >= 0, shiftright({p}, 16), shiftright(-{p}, 31))", f"if({p} >= 0, {p} & 65535, -{p} & 2147483647)"


def _near_keys(code: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which shingle, key) of every length class and rough place in which it may stand in a partner."""
    edits, tail = most_edits(n), n - place
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    low, high = _length_class((n * 9 + 9) // 10), _length_class(n * 10 // 9 + 1)
    for step in range(2):
        cls = low + step
        some = cls <= high
        wide = np.int64(8) << cls
        reach = int(np.ceil((edits / wide).max())) if len(edits) else 0
        for dh in range(-reach, reach + 1):
            head_b = place // wide + dh
            far_h = np.maximum(0, np.maximum(head_b * wide - place, place - (head_b * wide + wide - 1)))
            for dt in range(-reach, reach + 1):
                tail_b = tail // wide + dt
                far_t = np.maximum(0, np.maximum(tail_b * wide - tail, tail - (tail_b * wide + wide - 1)))
                k = np.flatnonzero(some & (far_h + far_t <= edits) & (head_b >= 0) & (tail_b >= 0))
                parts.append((k, _key(code[k], cls[k], head_b[k], tail_b[k])))
    return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])


def _own_keys(f: _Flat) -> np.ndarray:
    """Key of every shingle where it stands."""
    n = f.n[f.owner]
    cls = _length_class(f.n)[f.owner]
    return _key(f.code, cls, f.place >> (cls + 3), (n - f.place) >> (cls + 3))


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a ^ _mix(b + np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def _chosen(b: pd.DataFrame) -> tuple[_Flat, np.ndarray, np.ndarray]:
    """Shingles of short lines, the chosen ones among them, and each line's first chosen one."""
    f = _Flat(b["t"].tolist(), Q_SHORT)
    first = np.searchsorted(f.owner, np.arange(len(f.n)))
    at = np.concatenate([first[k] + np.asarray(p, np.int64) for k, p in enumerate(b["places"])])
    return f, at, np.searchsorted(f.owner[at], np.arange(len(f.n) + 1))


def _two_of(group: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of entries of the same group; ``group`` is sorted."""
    i = np.arange(n)
    for k in range(1, n):
        i = i[: np.searchsorted(i, n - k)]
        i = i[group[i] == group[i + k]]
        if not len(i):
            return
        yield i, i + k


def _short_rows(f: _Flat, at: np.ndarray, num: np.ndarray, name: str, keep=None) -> pd.DataFrame:  # noqa: ANN001
    """One row for every two of the shingles ``at`` of a line that don't overlap; ``keep`` drops keys early."""
    sig, owner, place, code = f.signature(), f.owner[at], f.place[at], f.code[at]
    parts = [(np.zeros(0, np.int64),) * 3]
    for i, j in _two_of(owner, len(at)):
        apart = place[j] - place[i] >= Q_SHORT
        i, j = i[apart], j[apart]
        key = _pair_key(code[i], code[j])
        if keep is not None:
            hit = keep(key)
            i, j, key = i[hit], j[hit], key[hit]
        parts.append((i, j, key))
    i, j, key = (np.concatenate(x) for x in zip(*parts))
    o = owner[i]
    return pd.DataFrame({"key": key, name: num[o], f"p_{name}": f.n[o] << 32 | place[i] << 16 | place[j], f"s_{name}": sig[o]})


def _long_rows(f: _Flat, k: np.ndarray, key: np.ndarray, num: np.ndarray, name: str) -> pd.DataFrame:
    o = f.owner[k]
    return pd.DataFrame({"key": key, name: num[o], f"p_{name}": _pack(f.n[o], f.place[k])})


class _Sieve:
    """A filter of keys, sized by their number and built by the engine, each task its own range of keys.

    A key's word is its upper bits, and three bits in it are set; the filter only saves rows that can't match. ``sharp``
    tells whether it has enough bits to drop nearly all others, ``useful`` to drop some.
    """

    def __init__(self, keys: DataFrame) -> None:
        spark = keys.sparkSession
        n = keys.count()
        bits = min(MOST_BITS, 1 << max(10, int(BITS_A_KEY * n - 1).bit_length() if n else 0))
        self.sharp, self.useful = bits >= SHARP_BITS * n, bits >= LEAST_BITS * n
        self.word_bits = bits.bit_length() - 7
        if not self.useful:
            return
        per_slice = min(SLICE_BITS, bits) // 64
        shift = 64 - self.word_bits + per_slice.bit_length() - 1

        def own(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(per_slice, np.uint64)
            word, mask = self.place(b["key"].to_numpy(np.int64))
            np.bitwise_or.at(out, word % per_slice, mask)
            return pd.DataFrame({"slice": [key[0]], "bits": [out.tobytes()]})

        word = np.zeros((bits // 64 // per_slice, per_slice), np.uint64)
        held = keys.withColumn("slice", F.shiftrightunsigned("key", shift).cast("int") if shift < 64 else F.lit(0))
        for r in held.groupBy("slice").applyInPandas(own, "slice int, bits binary").collect():
            word[r["slice"]] = np.frombuffer(r["bits"], np.uint64)
        self.sent = spark.sparkContext.broadcast(word.ravel())

    def place(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = key.view(np.uint64)
        mask = np.zeros(len(u), np.uint64)
        for k in (0, 6, 12):
            mask |= np.uint64(1) << ((u >> np.uint64(k)) & np.uint64(63))
        return (u >> np.uint64(64 - self.word_bits)).astype(np.int64), mask

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """Numbers of the keys that may be held; all of them if the filter isn't useful."""
        if not self.useful:
            return np.arange(len(key))
        word, mask = self.place(key)
        return np.flatnonzero((self.sent.value[word] & mask) == mask)


def _single_rows(f: _Flat, k: np.ndarray, key: np.ndarray, num: np.ndarray, name: str) -> pd.DataFrame:
    """One row for every shingle ``k`` and its key."""
    o = f.owner[k]
    return pd.DataFrame({"key": key, name: num[o], f"p_{name}": f.n[o] << 32 | f.place[k], f"s_{name}": f.signature()[o]})


def _blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for lo in range(0, len(b), size):
            yield b.iloc[lo : lo + size]


def _all_near_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _blocks(batches, 2000):
        f, at, _ = _chosen(b)
        yield pd.DataFrame({"key": np.unique(_near_keys(f.code[at], f.n[f.owner[at]], f.place[at])[1])})


def _index_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _blocks(batches, 2000):
        f, at, _ = _chosen(b)
        yield _short_rows(f, at, b["num"].to_numpy(), "ev")


def _index_single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _blocks(batches, 2000):
        f, at, _ = _chosen(b)
        k, key = _near_keys(f.code[at], f.n[f.owner[at]], f.place[at])
        yield _single_rows(f, at[k], key, b["num"].to_numpy(), "ev")


def levelled_lines(lines: DataFrame, works: DataFrame) -> DataFrame:
    """Current lines of works with a split and at least 50 levelled letters: ``id``, ``split``, ``source_id``, ``cid``, ``t``."""
    split = works.where("doc_id is not null and split in ('train', 'val', 'test')").groupBy("doc_id").agg(F.min("split").alias("split"), F.min("source_id").alias("source_id"))
    # A row's text and document stand on the same row, so texts of documents without a split need not be shuffled to find the current rows.
    joined = lines.select("id", "file_pos", "doc_id", "source_sic").join(small_or_plain(split), "doc_id", "left")
    keep = F.col("split").isNotNull() & (F.char_length("source_sic") * 3 >= LEAST)
    cur = current(joined, *[F.when(keep, F.col(c)).alias(n) for c, n in (("split", "split"), ("source_id", "source_id"), ("source_sic", "text"))])
    rows = cur.where("text is not null").select("id", "split", "source_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["t"] = [level(x) for x in b["text"]]
            yield b.loc[b["t"].str.len() >= LEAST, ["id", "split", "source_id", "t"]]

    return rows.mapInPandas(run, "id string, split string, source_id string, t string").withColumn("cid", F.xxhash64("t"))


def cross_split_pairs(lines: DataFrame, works: DataFrame) -> DataFrame:
    """All pairs of a training line and a val or test line that are the same or nearly the same.

    Result: ``id_train``, ``id_eval``, ``split`` and ``source_id`` of the evaluation line, ``edits``. Both ``source_sic`` have at
    least 50 levelled letters, and their edit distance is at most a tenth of the longer one's. No pair is lost.

    Equal texts are one class each; classes are joined and verified, and only pairs of classes unfold into their lines at
    the end, so copies cost one join row. Short lines meet on two shingles, long ones on a shingle, length class and rough
    place from both ends; places, lengths and a signature of letter counts filter within the join.

    What evaluation lines hold sieves the probes before they are shuffled: two shingles are formed only of shingles that
    some evaluation line may have chosen near that place, by filters sized by the number of keys (and 8 MB of shingle
    counts). Unrelated lines share two shingles by chance the more often the more lines there are, so where ``MOST_BITS``
    aren't enough for the keys, the lines meet on single chosen shingles instead, of which two must match: at most one row
    is shuffled for every shingle of a training line, however many evaluation lines there are, and places, lengths and
    signatures filter before anything is shuffled again.

    Defined cases: null or short texts, null ids and documents without a split are in no pair; of repeated ids the
    current row counts; texts of any length are compared whole; empty tables give no rows.
    """
    spark = lines.sparkSession
    held = materialise(levelled_lines(lines, works), "overlap-lines")
    classes = held.groupBy("cid", "t").agg(F.max((F.col("split") == "train").cast("int")).alias("tr"), F.max((F.col("split") != "train").cast("int")).alias("ev"))
    classes = materialise(classes.withColumn("pid", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "overlap-classes")
    # A short number for each class: row within its partition, partitions interleaved.
    parts = (classes.agg(F.max("pid")).first()[0] or 0) + 1
    classes = classes.withColumn("num", F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) * parts + F.col("pid")).drop("row", "pid")

    sent = spark.sparkContext.broadcast(shingle_counts(classes.where("tr = 1").select("t")))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _blocks(batches, 4096):
            yield pd.DataFrame({"num": b["num"], "t": b["t"], "places": short_prefix(b["t"].tolist(), sent.value[0])})

    def index_long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _blocks(batches, 500):
            f = _Flat(b["t"].tolist(), Q_LONG)
            at, size = long_prefix(f, sent.value[1])
            k, key = _near_keys(f.code[at], f.n[f.owner[at]], f.place[at])
            yield _long_rows(f, at[k], key, b["num"].to_numpy(), "ev").assign(size=size[f.owner[at[k]]])

    ev, tr = classes.where("ev = 1").select("num", "t"), classes.where("tr = 1").select("num", "t")
    chosen = materialise(ev.where(F.length("t") < SHORT).mapInPandas(choose, "num bigint, t string, places array<int>"), "overlap-prefixes")
    one = materialise(ev.where(F.length("t") >= SHORT).mapInPandas(index_long, "key bigint, ev bigint, p_ev bigint, size bigint"), "overlap-index-long")
    near_keys = materialise(chosen.mapInPandas(_all_near_keys, "key bigint"), "overlap-near")
    near, known_long = _Sieve(near_keys), _Sieve(one.select("key"))
    two = materialise(chosen.mapInPandas(_index_short, "key bigint, ev bigint, p_ev bigint, s_ev bigint"), "overlap-index") if near.sharp else None
    known = _Sieve(two.select("key")) if near.sharp else None

    def probe_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _blocks(batches, 2000):
            f = _Flat(b["t"].tolist(), Q_SHORT)
            yield _short_rows(f, near(_own_keys(f)), b["num"].to_numpy(), "tr", known)

    def probe_single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _blocks(batches, 2000):
            f = _Flat(b["t"].tolist(), Q_SHORT)
            key = _own_keys(f)
            k = near(key)
            yield _single_rows(f, k, key[k], b["num"].to_numpy(), "tr")

    def probe_long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _blocks(batches, 2000):
            f = _Flat(b["t"].tolist(), Q_LONG)
            key = _own_keys(f)
            k = known_long(key)
            yield _long_rows(f, k, key[k], b["num"].to_numpy(), "tr")

    probing = tr.where(F.length("t") <= MOST_SHORT)
    n, i, j = ((f"shiftright(p_{x}, 32)" for x in ("ev", "tr")), (f"(shiftright(p_{x}, 16) & 65535)" for x in ("ev", "tr")), (f"(p_{x} & 65535)" for x in ("ev", "tr")))
    (n1, n2), (i1, i2), (j1, j2) = n, i, j
    edits = f"(greatest({n1}, {n2}) div 10)"
    alike = f"bit_count(s_ev ^ s_tr) <= 2 * {edits} - abs({n1} - {n2})"
    if near.sharp:
        probes = probing.mapInPandas(probe_short, "key bigint, tr bigint, p_tr bigint, s_tr bigint")
        moved = f"abs({i1} - {i2}) + abs(({j1} - {i1}) - ({j2} - {i2})) + abs(({n1} - {j1}) - ({n2} - {j2})) <= {edits}"
        short = two.join(probes, "key").where(f"{moved} and {alike}").select("ev", "tr")
    else:
        single = chosen.mapInPandas(_index_single, "key bigint, ev bigint, p_ev bigint, s_ev bigint")
        probes = probing.mapInPandas(probe_single, "key bigint, tr bigint, p_tr bigint, s_tr bigint")
        moved = f"abs({j1} - {j2}) + abs(({n1} - {j1}) - ({n2} - {j2})) <= {edits}"
        hits = single.join(probes, "key").where(f"{moved} and {alike}").select("ev", "tr", F.expr(j1).alias("at"))
        short = hits.groupBy("ev", "tr").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a < b").select("ev", "tr")

    probes = tr.where(F.length("t") >= LEAST_LONG).mapInPandas(probe_long, "key bigint, tr bigint, p_tr bigint")
    (n1, i1), (n2, i2) = _unpack("p_ev"), _unpack("p_tr")
    edits = f"(greatest({n1}, {n2}) div 10)"
    moved = f"abs({i1} - {i2}) + abs(({n1} - {i1}) - ({n2} - {i2})) <= {edits}"
    hits = one.join(probes, "key").where(moved).select("ev", "tr", F.expr(i1).alias("at"), F.expr(f"size - {edits}").alias("need"))
    long = hits.groupBy("ev", "tr").agg(F.count_distinct("at").alias("k"), F.max("need").alias("need")).where("k >= need").select("ev", "tr")
    pairs = short.unionByName(long).distinct()
    pairs = materialise(pairs, "overlap-candidates")

    # Only texts and lines of candidates travel; where those are few, their numbers are sent to the executors to pick them out.
    def text(c: str) -> DataFrame:
        own = classes.select(F.col("num").alias(c), F.col("cid").alias(f"h_{c}"), F.col("t").alias(f"t_{c}"))
        return own.join(small_or_plain(pairs.select(c).distinct()), c, "left_semi")

    wide = pairs.join(text("tr"), "tr").join(text("ev"), "ev")
    banded = "levenshtein(t_tr, t_ev, cast(greatest(length(t_tr), length(t_ev)) div 10 as int))"
    close = wide.withColumn("edits", F.expr(banded)).where("edits >= 0")
    close = materialise(close, "overlap-verified")

    def members(c: str, train: bool) -> DataFrame:
        own = held.where("split = 'train'" if train else "split <> 'train'").withColumnsRenamed({"cid": f"h_{c}", "t": f"t_{c}"})
        return own.join(small_or_plain(close.select(f"h_{c}").distinct()), f"h_{c}", "left_semi")

    a = members("tr", True).select(F.col("id").alias("id_train"), "h_tr", "t_tr")
    b = members("ev", False).select(F.col("id").alias("id_eval"), "split", "source_id", "h_ev", "t_ev")
    return close.join(a, ["h_tr", "t_tr"]).join(b, ["h_ev", "t_ev"]).select("id_train", "id_eval", "split", "source_id", "edits")


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Pairs, evaluation lines and training lines concerned, per split and source of the evaluation line."""
    return pairs.groupBy("split", "source_id").agg(F.count("*").alias("pairs"), F.count_distinct("id_eval").alias("eval_lines"), F.count_distinct("id_train").alias("train_lines"), F.sum((F.col("edits") == 0).cast("bigint")).alias("exact"))
