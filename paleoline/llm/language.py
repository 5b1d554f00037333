"""Languages of lines and of their stretches (problem 1): a linear softmax on averaged hashed subword embeddings."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paleoline.llm.text import clean_now
from paleoline.session import current, materialise

LANGUAGES = ("la", "es", "pt", "it", "fr", "de")
# Three-letter codes and their two-letter equals, and labels that name no language.
THREE = {"lat": "la", "spa": "es", "por": "pt", "ita": "it", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "eng": "en", "cat": "ca", "cas": "es", "nld": "nl", "dut": "nl", "grc": "el", "ell": "el", "gre": "el", "heb": "he", "ara": "ar"}
NO_LANGUAGE = ("", "und", "zxx", "mul")
#: Bound of the labelled sample the classifier is fitted on: about this many lines a language, over the whole table.
SAMPLE_LINES = 8_000
LEAST_RUN = 3
#: How much more single words' odds count than the softmax gives them, when runs are sought.
SHARP = 2.0


def label_set(lang: Column) -> Column:
    """Sorted distinct languages a label column names: without case, region or script, three letters as two."""
    one = lambda x: F.regexp_extract(F.lower(F.trim(x)), "^([a-z]*)", 1)
    table = F.create_map(*[F.lit(y) for kv in THREE.items() for y in kv])
    two = F.transform(F.coalesce(lang, F.array().cast("array<string>")), lambda x: F.coalesce(F.try_element_at(table, one(x)), one(x)))
    return F.array_sort(F.array_distinct(F.filter(two, lambda x: x.isNotNull() & ~x.isin(*NO_LANGUAGE))))


def words_of(text: str) -> list[str]:
    """Words of two or more letters, brackets removed, after the clean-up; lower case, without marks at their ends."""
    out = []
    for t in clean_now(text).replace("⦃", "").replace("⦄", "").split():
        w = t.strip(".,;:!?()[]{}\"'«»‹›-–—§*¶").lower()
        if len(w) > 1 and sum(c.isalpha() for c in w) > 1:
            out.append(w)
    return out


#: Buckets of the table of subwords seen in training.
SEEN = 1 << 20


@dataclass
class Model:
    """Embeddings, weights, the languages each subword was seen in (bits), and the calibration; all of fixed size (5 MB)."""

    embed: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    seen: np.ndarray
    temperature: float = 1.0
    power: float = 1.0
    known: tuple[float, float, float] = (0.0, 1.0, 0.0)
    memo: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def read(self, words: list[str]) -> np.ndarray:
        """Logits of the languages for each word on its own, then the share of its subwords each language has."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.memo]
        if fresh:
            if len(self.memo) > 500_000:
                self.memo.clear()
            todo = list(dict.fromkeys(words)) if not self.memo else fresh
            rows, begin = subwords(todo)
            size = np.diff(np.append(begin, len(rows)))[:, None]
            z = np.add.reduceat(self.embed[rows % len(self.embed)], begin, axis=0) / size @ self.weight + self.bias
            has = (self.seen[rows % SEEN, None] >> np.arange(self.weight.shape[1], dtype=np.uint8)) & 1
            both = np.concatenate([z, np.add.reduceat(has.astype(np.float32), begin, axis=0) / size], 1).astype(np.float32)
            for w, v in zip(todo, both):
                self.memo[w] = v
        return np.stack([self.memo[w] for w in words])

    def confidence(self, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the languages from the averaged logits of ``n`` words each."""
        z = mean * (n**self.power / self.temperature)[:, None]
        return np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))

    def foreign(self, share: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether runs of ``n`` words with a mean ``share`` of subwords of their language are of none of the languages."""
        mean, spread, most = self.known
        return share < mean - most * spread / np.sqrt(n)


_GRAMS = (3, 4, 5)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words' subwords (3 to 5 letters with word ends, and the word), and where each word's begin."""
    rows: list[int] = []
    begin = []
    for w in words:
        begin.append(len(rows))
        u = f"<{w}>"
        rows.append(zlib.crc32(b"w" + u.encode()))
        rows.extend(zlib.crc32(u[k : k + n].encode()) for n in _GRAMS for k in range(len(u) - n + 1) if n < len(u))
    return np.array(rows, np.int64), np.array(begin, np.int64)


def log_softmax(z: np.ndarray) -> np.ndarray:
    return z - np.logaddexp.reduce(z, axis=-1, keepdims=True)


def fit(words: list[str], counts: np.ndarray, dims: int = 24, buckets: int = 1 << 15, epochs: int = 12, rate: float = 4.0, seed: int = 7) -> Model:
    """Fit embeddings and softmax by stochastic gradient descent on words with their counts per language.

    Every language weighs the same however many words it has. A word's loss is weighed by the root of its count.
    """
    rng = np.random.default_rng(seed)
    k = counts.shape[1]
    share = counts / np.maximum(counts.sum(0, keepdims=True), 1)
    share = share + 2e-7
    goal = (share / share.sum(1, keepdims=True)).astype(np.float32)
    importance = np.sqrt(counts.sum(1)).astype(np.float32)
    importance = np.minimum(importance / importance.mean(), 8)
    embed = rng.normal(0, 0.1, (buckets, dims)).astype(np.float32)
    weight, bias = rng.normal(0, 0.3, (dims, k)).astype(np.float32), np.zeros(k, np.float32)
    hashes, begin = subwords(words)
    rows = hashes % buckets
    n_sub = np.diff(np.append(begin, len(rows)))
    epochs = max(epochs, -(-800 // -(-len(words) // 256)))  # a small vocabulary needs more rounds
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        order = rng.permutation(len(words))
        for lo in range(0, len(order), 256):
            b = order[lo : lo + 256]
            n = n_sub[b]
            idx = np.repeat(begin[b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            r = rows[idx]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            mean = np.add.reduceat(embed[r], starts, axis=0) / n[:, None]
            z = mean @ weight + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            g = (p - goal[b]) * importance[b][:, None] / len(b)
            step = np.repeat((g @ weight.T) / n[:, None], n, axis=0) * (lr * 10)
            weight -= lr * (mean.T @ g)
            bias -= lr * 0.1 * g.sum(0)
            by = np.argsort(r, kind="stable")
            rs = r[by]
            first = np.flatnonzero(np.concatenate([[True], rs[1:] != rs[:-1]]))
            embed[rs[first]] -= np.add.reduceat(step[by], first, axis=0)
    seen = np.zeros(SEEN, np.uint8)
    bits = ((counts > 0) @ (1 << np.arange(k))).astype(np.uint8)
    np.bitwise_or.at(seen, hashes % SEEN, np.repeat(bits, n_sub))
    return Model(embed, weight, bias, seen)


def segment(em: list[np.ndarray], least: int = LEAST_RUN, switch: float = 12.0) -> list[np.ndarray]:
    """Most probable language of every word, in runs of at least ``least`` words, each change costing ``switch``.

    All texts of about a length are solved together; a text of fewer than twice ``least`` words has one run.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(em)
    order = sorted(range(len(em)), key=lambda i: len(em[i]))
    lo = 0
    while lo < len(order):
        longest = len(em[order[min(lo + 1999, len(order) - 1)]])
        size = max(1, min(2000, 400_000 // max(1, longest)))
        rows = order[lo : lo + size]
        lo += size
        n = np.array([len(em[i]) for i in rows])
        wide, k = int(n.max()), em[rows[0]].shape[1]
        if not wide:
            continue
        e = np.zeros((len(rows), wide, k), np.float32)
        for j, i in enumerate(rows):
            e[j, : n[j]] = em[i]
        total = np.concatenate([np.zeros((len(rows), 1, k), np.float32), np.cumsum(e, 1)], 1)
        # best[t]: score of the first t words with a run ending at t; came[t]: where that run began.
        best = np.full((wide + 1, len(rows), k), -np.inf, np.float32)
        start_best = np.full((len(rows), k), -np.inf, np.float32)  # best over starts s of (score before s) - total[s]
        start_at = np.zeros((len(rows), k), np.int32)
        came = np.zeros((wide + 1, len(rows), k), np.int32)
        top = np.full((wide + 1, len(rows)), -np.inf, np.float32)
        top[0] = switch
        for t in range(1, wide + 1):
            if t < least:
                best[t] = np.where((n == t)[:, None], total[:, t], -np.inf)
            else:
                s = t - least
                new = top[s][:, None] - switch - total[:, s]
                better = new > start_best
                start_best = np.where(better, new, start_best)
                start_at = np.where(better, s, start_at)
                best[t] = start_best + total[:, t]
                came[t] = start_at
            top[t] = best[t].max(1)
        for j, i in enumerate(rows):
            t = int(n[j])
            lab = np.zeros(t, np.int64)
            while t > 0:
                c = int(np.argmax(best[t, j]))
                s = int(came[t, j, c])
                lab[s:t] = c
                t = s
            out[i] = lab
    return out


def training_sample(lines: DataFrame, per_language: int = SAMPLE_LINES) -> DataFrame:
    """(``text``, ``label``, ``held``) of about ``per_language`` lines of each language whose label names it alone, by a hash of the id; every twentieth is ``held`` out."""
    cur = current(lines, label_set(F.col("lang")).alias("langs"), "source_sic")
    one = cur.where("size(langs) = 1 and source_sic <> ''").select("id", F.col("langs")[0].alias("label"), F.col("source_sic").alias("text")).where(F.col("label").isin(*LANGUAGES))
    n = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for x, c in n.items() for x in (x, min(1.0, per_language / c))]) if n else None
    u = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    held = F.pmod(F.xxhash64("id", F.lit(18)), F.lit(20)) == 0
    return (one.where(u < share[F.col("label")]) if n else one).select("text", "label", held.alias("held"))


def _word_counts(sample: DataFrame, model: Model | None) -> tuple[list[str], np.ndarray]:
    """Distinct words of the lines that aren't held out, and their counts per language; with a model, of lines that it finds in their label's language."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            n: Counter = Counter()
            for t, y in zip(b["text"], b["label"]):
                w = words_of(t)
                if w and (m is None or LANGUAGES[int(log_softmax(SHARP * m.read(w)[:, : len(LANGUAGES)]).sum(0).argmax())] == y):
                    n.update((x, y) for x in w)
            yield pd.DataFrame([(x, y, c) for (x, y), c in n.items()], columns=["word", "label", "n"])

    rows = sample.where("not held").select("text", "label").mapInPandas(run, "word string, label string, n bigint").groupBy("word", "label").agg(F.sum("n").alias("n")).toPandas()
    # In order, so the fit doesn't depend on partitioning.
    wide = rows.pivot(index="word", columns="label", values="n").reindex(columns=LANGUAGES).fillna(0).sort_index()
    return wide.index.tolist(), wide.to_numpy(float)


_HELD = "label int, n int, mean array<float>, share double, part double"


def _calibrate(model: Model, sample: DataFrame) -> None:
    """Fit temperature and rejection on all held-out lines.

    Labels may be wrong: the share of wrong ones is estimated beside the temperature, and a label counts as one drawn at
    random with that probability. Rejection asks for the share of subwords that training has seen in the language: the
    bound, in standard errors for a run's length, is what all but one in a thousand held-out lines, and runs of three words
    from their middle, exceed.
    """
    sent = sample.sparkSession.sparkContext.broadcast(model)
    k = len(LANGUAGES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, y in zip(b["text"], b["label"]):
                w = words_of(t)
                if len(w) >= LEAST_RUN:
                    r = sent.value.read(w)
                    mean, at = r.mean(0), len(w) // 2 - 1
                    c = int(mean[:k].argmax())
                    out.append((LANGUAGES.index(y), len(w), mean[:k].tolist(), float(mean[k + c]), float(r[at : at + LEAST_RUN, k + c].mean())))
            yield pd.DataFrame(out, columns=["label", "n", "mean", "share", "part"])

    held = sample.where("held").select("text", "label").mapInPandas(run, _HELD).toPandas()
    if not len(held):
        return
    y, n, mean = held["label"].to_numpy(), held["n"].to_numpy(float), np.array(held["mean"].tolist())
    best = np.inf
    for model_power in (0.5, 1.0):
        for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0):
            model.power, model.temperature = model_power, t
            p = model.confidence(mean, n)[np.arange(len(y)), y]
            for wrong in (0.0001, 0.001, 0.003, 0.01, 0.02, 0.05, 0.1, 0.2):
                loss = -np.log((1 - wrong) * p + wrong / k).mean()
                if loss < best - 1e-9:
                    best, chosen = loss, (model_power, t)
    model.power, model.temperature = chosen
    share, part = held["share"].to_numpy(), held["part"].to_numpy()
    centre = float(np.median(share))
    spread = max(float(np.sqrt(np.mean((part - np.median(part)) ** 2) * LEAST_RUN)), 0.02)
    odd = lambda x, m: np.sort((centre - x) * np.sqrt(m) / spread)[-1 - len(x) // 1000]
    model.known = (centre, spread, float(max(odd(share, n), odd(part, LEAST_RUN), 1.0)))


def train(lines: DataFrame, per_language: int = SAMPLE_LINES) -> Model:
    """Fit on the lines' own labels, drop training lines that the first fit finds in another language, fit again, calibrate.

    The engine's workers read the sample's texts; only distinct words with their counts, and a dozen numbers of each line
    held out, come to the driver, both bounded by the sample. Without any labelled line the model rejects everything.
    """
    sample = materialise(training_sample(lines, per_language), "language-sample")
    k = len(LANGUAGES)
    model = None
    for _ in range(2):
        words, counts = _word_counts(sample, model)
        if not words:
            return model or Model(np.zeros((8, 4), np.float32), np.zeros((4, k), np.float32), np.zeros(k, np.float32), np.zeros(SEEN, np.uint8), known=(2.0, 1.0, 0.0))
        model = fit(words, counts)
    _calibrate(model, sample)
    model.memo.clear()
    return model


_OUT = "id string, labels array<string>, n_words int, langs array<string>, segments array<struct<start:int,end:int,lang:string,confidence:double>>"


def identify(rows: DataFrame, model: Model, least_words: int = 1, switch: float = 14.0) -> DataFrame:
    """Languages of ``rows`` (``id``, ``labels``, ``text``): ``id``, ``labels``, ``n_words``, ``langs`` and ``segments``.

    ``segments`` are runs of at least three words (counted from 0 among words of two or more letters) with a language and
    a calibrated confidence, from the average of their words' embeddings. A run is rejected, its language ``und``, if too few
    of its words' subwords belong to the language (:func:`_calibrate`): text of another language or none. ``langs`` are the
    distinct languages but ``und``. ``switch`` is what a change of language must gain, in log odds of single words
    sharpened by ``SHARP``: less is common by chance where words belong to several languages. Null and empty text has no
    words, no languages and no segments.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)
    k = len(LANGUAGES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            words = [words_of(t) if t else [] for t in b["text"]]
            sel = [i for i, w in enumerate(words) if len(w) >= max(1, least_words)]
            read = [m.read(words[i]) for i in sel]
            labs = segment([log_softmax(SHARP * r[:, :k]) for r in read], switch=switch)
            langs: list[list[str]] = [[] for _ in words]
            segs: list[list[dict]] = [[] for _ in words]
            runs = [(j, s, t) for j, lab in enumerate(labs) for s, t in zip(*_edges(lab))]
            if runs:
                mean = np.stack([read[j][s:t].mean(0) for j, s, t in runs])
                n = np.array([t - s for _, s, t in runs], float)
                c = np.array([labs[j][s] for j, s, _ in runs])
                at = np.arange(len(runs))
                conf, odd = m.confidence(mean[:, :k], n)[at, c], m.foreign(mean[at, k + c], n)
                for (j, s, t), x, p, o in zip(runs, c.tolist(), conf.tolist(), odd.tolist()):
                    i, name = sel[j], "und" if o else LANGUAGES[x]
                    segs[i].append({"start": s, "end": t, "lang": name, "confidence": p})
                    if name != "und" and name not in langs[i]:
                        langs[i].append(name)
            yield pd.DataFrame({"id": b["id"], "labels": b["labels"], "n_words": [len(w) for w in words], "langs": [sorted(x) for x in langs], "segments": segs})

    return rows.select("id", "labels", "text").mapInPandas(run, _OUT)


def _edges(lab: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.concatenate([[0], np.flatnonzero(lab[1:] != lab[:-1]) + 1, [len(lab)]]).tolist()
    return edge[:-1], edge[1:]


def line_languages(lines: DataFrame, model: Model | None = None, least_words: int = 1) -> DataFrame:
    """:func:`identify` for ``source_sic`` of every current line; the model is fitted on the table itself if none is given."""
    model = model or train(lines)
    cur = current(lines, label_set(F.col("lang")).alias("labels"), F.col("source_sic").alias("text"))
    return identify(cur, model, least_words)


def wrong_labels(found: DataFrame, least_words: int = 5, least_run: int = LEAST_RUN) -> DataFrame:
    """(``id``, ``lang``): lines of at least ``least_words`` words whose labels differ from the languages of their text."""
    odd = found.where((F.col("n_words") >= least_words) & (F.size("langs") > 0) & (F.col("langs") != F.col("labels")))
    return odd.select("id", F.explode("langs").alias("lang"))
