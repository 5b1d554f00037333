"""Inference with pluggable models: boundary scores, chains, windows, expansion, and lines again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paleoline.functions.text import ABBR_CLOSE, ABBR_OPEN, LINE_BREAK, LINE_SEP
from paleoline.operators.chains import chains
from paleoline.operators.examples import budget_windows, render
from paleoline.operators.order import document_order, with_neighbours
from paleoline.session import current, materialise, small_or_plain

Scorer = Callable[[DataFrame], DataFrame]
Expander = Callable[[DataFrame], DataFrame]


def split_back(ordered: DataFrame, chained: DataFrame, windows: DataFrame, expand: Expander, link: str = "nonbreaking_next_line") -> DataFrame:
    """``id``, ``text``: windows rendered, expanded by ``expand`` (a column ``source`` in and out), cut at both separators, and the chain's own lines kept.

    If a window's parts aren't as many as its lines, and for lines in no window, the line keeps its ``source_sic``.
    """
    last = chained.groupBy("doc_id", "head_pos").agg(F.max_by("pos", "pos_in_chain").alias("last_pos"))
    w = windows.join(last, ["doc_id", "head_pos"])
    # A chain's lines need not be neighbours; its window is its context before, the chain, and its context behind.
    own = chained.select("doc_id", "head_pos", "pos", F.lit(1).alias("part"), F.col("pos_in_chain").alias("at"))
    around = w.select("doc_id", "head_pos", F.explode(F.concat(
        F.when(F.col("n_before") > 0, F.transform(F.sequence(F.lit(1), F.col("n_before")), lambda k: F.struct(F.lit(0).alias("part"), (-k).alias("at"), (F.col("head_pos") - k).alias("pos")))).otherwise(F.array().cast("array<struct<part:int,at:int,pos:bigint>>")),
        F.when(F.col("n_after") > 0, F.transform(F.sequence(F.lit(1), F.col("n_after")), lambda k: F.struct(F.lit(2).alias("part"), k.alias("at"), (F.col("last_pos") + k).alias("pos")))).otherwise(F.array().cast("array<struct<part:int,at:int,pos:bigint>>")),
    )).alias("x")).select("doc_id", "head_pos", "x.pos", "x.part", "x.at")
    held = own.unionByName(around).join(ordered.select("doc_id", "pos", "id", link, F.coalesce("source_sic", F.lit("")).alias("source_sic")), ["doc_id", "pos"])
    # The place in the window takes the part of the position in rendering.
    held = held.withColumn("pos", F.struct("part", "at"))
    text = render(held, link, ["doc_id", "head_pos"], {"source": "source_sic"}, [F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("ids")])
    done = expand(text)
    parts = F.split("source", f"[{LINE_SEP}{LINE_BREAK}]", -1)
    out = done.select(F.posexplode("ids").alias("n", "x"), parts.alias("p"), F.size("ids").alias("k")).where("x.pos.part = 1")
    out = out.select("x.id", F.when(F.size("p") == F.col("k"), F.get("p", F.col("n"))).alias("text"))
    return ordered.select("id", F.coalesce("source_sic", F.lit("")).alias("source_sic")).join(out, "id", "left").select("id", F.coalesce("text", "source_sic").alias("text"))


def hyphen_scorer(known: DataFrame) -> Scorer:
    """Stand-in for a trained boundary model: 0.9 if the words at the break join to a known word and the line doesn't end in punctuation, else 0.1."""
    from paleoline.functions.text import bare_word

    def score(pairs: DataFrame) -> DataFrame:
        a, b = F.regexp_extract("line_end", r"(?U)(\S+)\s*$", 1), F.regexp_extract("line_start", r"(?U)^\s*(\S+)", 1)
        rows = pairs.withColumn("w", bare_word(F.concat(a, b)))
        hit = rows.join(small_or_plain(known.select(F.col("word").alias("w"), F.lit(True).alias("hit"))), "w", "left")
        return hit.withColumn("prob", F.when(F.col("hit") & ~a.rlike(r"[.,;:!?]$"), 0.9).otherwise(0.1)).drop("w", "hit")

    return score


def frequent_expander(pairs: DataFrame) -> Expander:
    """Stand-in for a trained expander: every closed span becomes its most frequent expansion in ``pairs`` (``abbr``, ``gold``), markers go.

    The table of abbreviations is small by nature; it is sent along only if a count proves it, else joined span by span.
    """
    best = pairs.groupBy("abbr", "gold").agg(F.count("*").alias("n")).groupBy("abbr").agg(F.max_by("gold", F.struct("n", "gold")).alias("gold"))
    best = materialise(best, "expansions")

    def expand(windows: DataFrame) -> DataFrame:
        rows = windows.withColumn("_w", F.monotonically_increasing_id())
        rows = materialise(rows, "windows")
        # Alternate plain stretches and spans: cut before each opener and behind each closer.
        bits = rows.select("_w", F.posexplode(F.split("source", f"(?={ABBR_OPEN})|(?<={ABBR_CLOSE})", -1)).alias("n", "bit"))
        bits = bits.withColumn("abbr", F.regexp_extract("bit", f"^{ABBR_OPEN}([^{ABBR_CLOSE}]*){ABBR_CLOSE}$", 1))
        bits = bits.join(small_or_plain(best), "abbr", "left").select("_w", "n", F.coalesce(F.when(F.col("abbr") != "", F.col("gold")), F.translate("bit", ABBR_OPEN + ABBR_CLOSE, "")).alias("bit"))
        text = bits.groupBy("_w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "bit"))), lambda x: x["bit"]), "").alias("source"))
        return rows.drop("source").join(text, "_w").drop("_w")

    return expand


def model_expander(load: Callable[[], object], apply: Callable[[object, list[str]], list[str]], batch: int = 32) -> Expander:
    """An expander of any model in Python: ``load`` is called once a task, in the worker, and ``apply`` gets the sources ``batch`` at a time, so memory never depends on how many there are."""

    def expand(windows: DataFrame) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for p in parts:
                model = load() if model is None else model
                texts = p["source"].tolist()
                p["source"] = [x for k in range(0, len(texts), batch) for x in apply(model, texts[k : k + batch])]
                yield p

        return windows.mapInPandas(run, windows.schema)

    return expand


def predict_boundaries(ordered: DataFrame, score: Scorer, threshold: float = 0.6, context: int = 40) -> DataFrame:
    """``ordered`` with ``predicted_next_line``: the next line of the document if the scorer gives the pair at least ``threshold``, else empty."""
    near = with_neighbours(ordered, ["doc_id"], {"next": (F.struct("id", F.left("source_sic", F.lit(context)).alias("start")), 1)})
    pairs = near.where("next is not null").select("id", "doc_id", F.col("next.id").alias("next_id"), F.right(F.coalesce("source_sic", F.lit("")), F.lit(context)).alias("line_end"), F.coalesce("next.start", F.lit("")).alias("line_start"))
    hit = score(pairs).where(F.col("prob") >= threshold).select("id", F.col("next_id").alias("predicted_next_line"))
    return ordered.join(hit, "id", "left").withColumn("predicted_next_line", F.coalesce("predicted_next_line", F.lit("")))


def run_pipeline(lines: DataFrame, corrections: DataFrame | None = None, score: Scorer | None = None, expand: Expander | None = None, threshold: float = 0.6, context_chars: int = 40, context_lines: int = 2, max_bytes: int = 480) -> DataFrame:
    """Every current line with ``predicted_next_line`` and ``expanded_text``.

    Lines in document order, neighbours scored, chains over the predicted links, windows within the byte budget, expansion, and the lines cut back.
    Without models the stand-ins learn from the table itself: words of the corrected views, and expansions of the closed spans.
    """
    from paleoline.functions.align import span_results
    from paleoline.operators.examples import lexicon

    ordered = document_order(lines, "source_sic")
    cur = current(lines, "source_sic", "target_corr")
    score = score or hyphen_scorer(materialise(lexicon(cur.select("target_corr")), "lexicon"))
    if expand is None:
        s = cur.where(F.col("source_sic").contains(ABBR_OPEN) & F.col("target_corr").isNotNull())
        expand = frequent_expander(s.select(F.explode(span_results("source_sic", "target_corr", "target_corr")).alias("x")).select("x.abbr", "x.gold"))
    scored = materialise(predict_boundaries(ordered, score, threshold, context_chars), "predicted")
    chained = materialise(chains(scored, "predicted_next_line"), "predicted-chains")
    windows = budget_windows(scored, chained, context_lines, max_bytes)
    text = split_back(scored, chained, windows, expand, "predicted_next_line")
    return scored.select("id", "doc_id", "predicted_next_line").join(text, "id").withColumnRenamed("text", "expanded_text")
