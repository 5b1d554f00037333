import random

import numpy as np
import pytest

from paleoline.llm import overlap as ov
from paleoline.llm.text import level
from tests.conftest import rows


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def edited(rng, t, k):
    t = list(t)
    for _ in range(k):
        p = rng.randrange(len(t))
        op = rng.randrange(3)
        if op == 0:
            t[p] = rng.choice("abcdefgh")
        elif op == 1:
            t.insert(p, rng.choice("abcdefgh"))
        else:
            del t[p]
    return "".join(t)


def test_most_edits():
    for n in range(50, 3000):
        longest = max(m for m in range(n, n * 2) if m - n <= m // 10)
        assert ov.most_edits(np.array([n]))[0] == longest // 10


def test_pairs_against_brute_force(spark, make_lines):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefghilmnopqrstu") for _ in range(rng.choice([49, 50, 51, 54, 63, 80, 127, 128, 200, 420]))) for _ in range(40)]
    texts = []
    for t in base:
        texts += [(t, "train"), (edited(rng, t, len(t) // 10), "val"), (edited(rng, t, len(t) // 10 + 1), "test"), (edited(rng, t, rng.randrange(1 + len(t) // 8)), "val"), (edited(rng, t, 3), "train")]
    texts += [(base[0], "test"), (base[0], "train"), (base[1][:25] * 2, "train"), (base[1][:25] * 2, "test"), ("a" * 60, "train"), ("a" * 57, "val"), (None, "val"), ("", "train"), (base[3], None)]
    works = spark.createDataFrame([(f"D{s}", s, "S1") for s in ("train", "val", "test", None)] + [("Dval", "val", "S1")], "doc_id string, split string, source_id string")
    df = make_lines([{"id": f"L{k:04d}", "doc_id": f"D{s}", "source_sic": t if t is None or k % 2 else " ".join(t[j : j + 5] for j in range(0, len(t), 5)).upper()} for k, (t, s) in enumerate(texts)])
    want = set()
    lev = [(f"L{k:04d}", level(t or ""), s) for k, (t, s) in enumerate(texts)]
    for i, a, s in lev:
        for j, b, r in lev:
            if s == "train" and r in ("val", "test") and min(len(a), len(b)) >= 50 and distance(a, b) <= max(len(a), len(b)) // 10:
                want.add((i, j))
    pairs = ov.cross_split_pairs(df, works)
    assert {(r["id_train"], r["id_eval"]) for r in pairs.collect()} == want and len(want) > 80
    report = {r["split"]: r["pairs"] for r in ov.overlap_report(pairs).collect()}
    assert sum(report.values()) == len(want)


def test_empty(spark, make_lines):
    works = spark.createDataFrame([], "doc_id string, split string, source_id string")
    assert rows(ov.cross_split_pairs(make_lines([]), works)) == []


@pytest.mark.parametrize("bits", [1 << 9, 1 << 14])
def test_without_sharp_filters(spark, make_lines, monkeypatch, bits):
    """Filters too small for their keys: the same pairs, by a join on single shingles."""
    made = []
    sieve = ov._Sieve

    class Seen(sieve):
        def __init__(self, keys):
            super().__init__(keys)
            made.append((self.sharp, self.useful))

    monkeypatch.setattr(ov, "_Sieve", Seen)
    monkeypatch.setattr(ov, "MOST_BITS", bits)
    test_pairs_against_brute_force(spark, make_lines)
    assert made[0] == (False, bits == 1 << 14)


def test_sieve_holds_every_key(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, 30_000)
    s = ov._Sieve(spark.createDataFrame([(int(k),) for k in keys], "key bigint"))
    other = rng.integers(-(2**63), 2**63 - 1, 100_000)
    assert s.sharp and len(s(keys)) == len(keys) and len(s(other)) < 1000
    assert len(ov._Sieve(spark.createDataFrame([], "key bigint"))(other)) == 0


def test_long_prefix_leaves_enough():
    rng = random.Random(1)
    f = ov._Flat(["".join(rng.choice("abcde") for _ in range(n)) for n in (128, 129, 500, 4001)], ov.Q_LONG)
    at, size = ov.long_prefix(f, np.random.default_rng(1).integers(0, 99, 1 << ov.COUNT_BITS))
    assert (np.bincount(f.owner[at]) == size).all() and (size - ov.most_edits(f.n) >= 2).all() and (f.place[at] % ov.Q_LONG == 0).all()


def test_shingle_counts_in_levels(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([60, 150]))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(30)
    one = ov.shingle_counts(df)
    monkeypatch.setattr(ov, "FAN_IN", 3)
    assert (ov.shingle_counts(df) == one).all()
    for half, q, some in ((0, ov.Q_SHORT, [t for t in texts if len(t) <= ov.MOST_SHORT]), (1, ov.Q_LONG, [t for t in texts if len(t) >= ov.LEAST_LONG])):
        assert (np.bincount(ov._bucket(ov._Flat(some, q).code), minlength=1 << ov.COUNT_BITS) == one[half]).all() and one[half].sum() == sum(len(t) - q + 1 for t in some)
