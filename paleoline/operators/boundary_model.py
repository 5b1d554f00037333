"""A trainable boundary classifier inside the engine, as a stand-in for an external encoder, and its report."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paleoline.functions.text import LINE_BREAK, bare_word
from paleoline.operators import metrics
from paleoline.session import materialise, small_or_plain

MAX_CHARS = 128


def encode(pairs: DataFrame, known: DataFrame | None = None, strip: bool = False) -> DataFrame:
    """``pairs`` with ``text``, the end of the line, a line-break sign and the start of the next, cut to 128 code points, and ``known``, whether the words at the break join to one of ``known``."""
    end, start = F.coalesce("line_end", F.lit("")), F.coalesce("line_start", F.lit(""))
    if strip:
        end, start = F.translate(end, "⦃⦄", ""), F.translate(start, "⦃⦄", "")
    rows = pairs.withColumn("text", F.left(F.concat(end, F.lit(f" {LINE_BREAK} "), start), F.lit(MAX_CHARS)))
    if known is None:
        return rows.withColumn("known", F.lit(0.0))
    word = bare_word(F.concat(F.regexp_extract(end, r"(?U)(\S+)\s*$", 1), F.regexp_extract(start, r"(?U)^\s*(\S+)", 1)))
    hit = small_or_plain(known.select(F.col("word").alias("_w"), F.lit(1.0).alias("known")))
    return rows.withColumn("_w", word).join(hit, "_w", "left").withColumn("known", F.coalesce("known", F.lit(0.0))).drop("_w")


def fit(examples: DataFrame, known: DataFrame | None = None, cap: float = 8.0, strip: bool = False, iterations: int = 25) -> PipelineModel:
    """Weighted logistic regression on hashed letter groups and the lexicon bit; positives weigh negatives per positive, at most ``cap``."""
    rows = encode(examples.where("label is not null"), known, strip)
    n = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    weight = min(n["n"] / n["p"], cap) if n["p"] else 1.0
    rows = rows.select("text", "known", F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, weight).otherwise(1.0).alias("weight"))
    stages = [RegexTokenizer(inputCol="text", outputCol="c", pattern=".", gaps=False, toLowercase=True, minTokenLength=1)]
    for k in (2, 3, 4):
        stages += [NGram(n=k, inputCol="c", outputCol=f"g{k}"), HashingTF(inputCol=f"g{k}", outputCol=f"h{k}", numFeatures=1 << 15, binary=True)]
    stages += [VectorAssembler(inputCols=["h2", "h3", "h4", "known"], outputCol="features"), LogisticRegression(weightCol="weight", maxIter=iterations, regParam=1e-3)]
    return Pipeline(stages=stages).fit(rows)


def fit_best(examples: DataFrame, validation: DataFrame, known: DataFrame | None = None, epochs: tuple[int, ...] = (5, 10, 20, 40), threshold: float = 0.6) -> tuple[PipelineModel, int]:
    """The model of the number of iterations with the best precision on ``validation``, and that number; of equal ones the longer fit."""
    models = {n: fit(examples, known, iterations=n) for n in epochs}
    tried = [metrics.prf(scorer(m, known)(validation), [], threshold).select(F.lit(n).alias("epoch"), "precision") for n, m in models.items()]
    best = best_epoch(reduce(DataFrame.unionByName, tried)).first()["epoch"]
    return models[best], best


def scorer(model: PipelineModel, known: DataFrame | None = None, strip: bool = False):  # noqa: ANN201
    """A scorer for :func:`paleoline.operators.infer.run_pipeline`: adds ``prob``."""

    def score(pairs: DataFrame) -> DataFrame:
        out = model.transform(encode(pairs, known, strip))
        return out.select(*pairs.columns, vector_to_array("probability")[1].alias("prob"))

    return score


def report(scored: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row per group of an evaluation: ``part`` (overall, page, doc, lang), ``key``, counts, precision, recall, F1."""
    held = materialise(scored, "report")
    cols = ["n", "n_positive", "precision", "recall", "f1"]
    part = lambda df, name, key: df.select(F.lit(name).alias("part"), key.cast("string").alias("key"), *cols)
    out = part(metrics.prf(held, [], threshold), "overall", F.lit(None))
    out = out.unionByName(part(metrics.prf(held, ["crosses_page_break"], threshold), "page", F.col("crosses_page_break")))
    out = out.unionByName(part(metrics.prf(held, ["doc_id"], threshold), "doc", F.col("doc_id")))
    return out.unionByName(part(metrics.prf(held.withColumn("l", F.explode("lang")), ["l"], threshold), "lang", F.col("l")))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """The epoch with the best validation precision (``epoch``, ``precision``); of equal ones the later."""
    return epochs.agg(F.max_by(F.struct("epoch", "precision"), F.struct("precision", "epoch")).alias("x")).select("x.*")
