"""Training examples: boundary pairs, context windows, splits, oversampling, lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paleoline.functions.text import LINE_BREAK, LINE_SEP, bare_word, crosses_page, hash_uniform, line_key, strip_markers
from paleoline.operators.order import ranked, with_neighbours
from paleoline.session import current, materialise, small_or_plain


def linked_pairs(lines: DataFrame, *cols: str) -> DataFrame:
    """Current lines with a live link, beside the line it names: ``id``, ``next_id``, ``crosses_page_break`` and, of each of ``cols``, ``{c}`` and ``next_{c}``. Dangling links are dropped."""
    cur = current(lines, "nonbreaking_next_line", *cols)
    a = cur.where("nonbreaking_next_line <> ''").withColumnRenamed("nonbreaking_next_line", "next_id")
    b = cur.select(F.col("id").alias("next_id"), *[F.col(c).alias(f"next_{c}") for c in cols])
    return a.join(b, "next_id").select("id", "next_id", crosses_page("id", "next_id").alias("crosses_page_break"), *cols, *[f"next_{c}" for c in cols])


def boundary_examples(lines: DataFrame, context: int = 40) -> DataFrame:
    """Labelled line boundaries: ``boundary_id``, ``doc_id``, ``lang``, ``line_end``, ``line_start``, ``label``, ``crosses_page_break``.

    Label 1: every live link. Label 0: each line without a link and its follower in document order within the same
    paragraph (``doc_id``, ``ancestor_id``; null paragraphs are one per document). Contexts are the last and first
    ``context`` code points of ``source_sic``; null text counts as empty.
    """
    pairs = linked_pairs(lines, "doc_id", "lang", "source_sic")
    end, start = lambda c: F.right(F.coalesce(c, F.lit("")), F.lit(context)), lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(context))
    yes = pairs.select(F.col("id").alias("boundary_id"), "doc_id", "lang", end(F.col("source_sic")).alias("line_end"), start(F.col("next_source_sic")).alias("line_start"), F.lit(1).alias("label"), "crosses_page_break")
    cur = current(lines, "doc_id", "ancestor_id", "lang", "nonbreaking_next_line", F.left("source_sic", F.lit(context)).alias("first"), F.right("source_sic", F.lit(context)).alias("last"), "file_pos").withColumn("k", line_key("id"))
    para = materialise(ranked(cur, ["doc_id", "ancestor_id"], ["k", "file_pos"]), "paragraphs")
    near = with_neighbours(para, ["doc_id", "ancestor_id"], {"next": (F.struct("id", "first"), 1)})
    no = near.where("next is not null and coalesce(nonbreaking_next_line, '') = ''")
    no = no.select(F.col("id").alias("boundary_id"), "doc_id", "lang", end(F.col("last")).alias("line_end"), start(F.col("next.first")).alias("line_start"), F.lit(0).alias("label"), crosses_page("id", "next.id").alias("crosses_page_break"))
    return yes.unionByName(no)


def document_split(docs: DataFrame, test: float = 0.1, val: float = 0.1, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``split``: documents in the order of a seeded hash; the first ``max(1, floor(n * test))`` are test, the next as many by ``val`` are val, the rest train. Null documents are left out."""
    ids = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id")).distinct()
    order = ranked(ids.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))), [], ["h"])
    order = materialise(order, "split-order")
    n = order.count()
    n_test, n_val = max(1, int(n * test)), max(1, int(n * val))
    return order.select("doc_id", F.when(F.col("pos") < n_test, "test").when(F.col("pos") < n_test + n_val, "val").otherwise("train").alias("split"))


def class_weight(examples: DataFrame, by: list[str], cap: float = 8.0) -> DataFrame:
    """Negatives per positive, at most ``cap``; 1 where there is no positive."""
    out = examples.groupBy(*by).agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))
    return out.withColumn("weight", F.when(F.col("n_pos") == 0, 1.0).otherwise(F.least(F.col("n_neg") / F.col("n_pos"), F.lit(cap))))


#: A chain that ends more lines behind its first one leaps too far for its window to hold what lies between.
LONGEST_LEAP = 10_000


def chain_spans(chained: DataFrame) -> DataFrame:
    """``doc_id``, ``head_pos``, ``last_pos`` and ``n_chain`` of each chain, and whether it ``leaps``: ends more than ``LONGEST_LEAP`` lines behind its first line."""
    per = chained.groupBy("doc_id", "head_pos").agg(F.max_by("pos", "pos_in_chain").alias("last_pos"), F.count("*").alias("n_chain"))
    return per.withColumn("leaps", F.col("last_pos") - F.col("head_pos") > LONGEST_LEAP)


def chain_windows(ordered: DataFrame, chained: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Which lines each chain's context window holds: ``doc_id``, ``head_pos``, ``last_pos``, ``n_chain``, ``pos`` (one row a line).

    The window runs from ``before`` lines before the chain's first line to ``after`` lines behind its last one, within the
    document. A chain that :func:`chain_spans` finds to leap has only its own lines and the context at both ends, so one
    wrong link can't put a whole document into one window; there are few lines between the others' ends.
    """
    every = chain_spans(chained)
    far = every.where("leaps")
    ends = F.concat(F.sequence(F.greatest(F.col("head_pos") - before, F.lit(0)), F.col("head_pos")), F.sequence(F.col("last_pos"), F.col("last_pos") + after))
    far = far.select("doc_id", "head_pos", "last_pos", "n_chain", F.explode(ends).alias("pos")).unionByName(chained.select("doc_id", "head_pos", "pos").join(far.drop("leaps"), ["doc_id", "head_pos"])).distinct()
    per = every.where("not leaps").drop("leaps")
    near = per.withColumn("pos", F.explode(F.sequence(F.greatest(F.col("head_pos") - before, F.lit(0)), F.greatest(F.col("last_pos") + after, F.col("head_pos") - before, F.lit(0)))))
    return near.where("pos <= last_pos + " + str(after)).unionByName(far).join(ordered.select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")


def render(window_lines: DataFrame, link: str, keys: list[str], texts: dict[str, str], extra: list | None = None) -> DataFrame:
    """One text per window: lines in order, joined by the word-continues sign where a line's link names the next line of the window, else by the line-break sign.

    A window is gathered in one row, which is what it is for; :func:`chain_windows` keeps lines between far ends out of it.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "id", F.col(link).alias("link"), *[F.coalesce(c, F.lit("")).alias(n) for n, c in texts.items()])))
    g = window_lines.groupBy(*keys).agg(rows.alias("rows"), *(extra or []))
    def text(n: str):  # noqa: ANN202
        parts = F.transform("rows", lambda r, i: F.concat(r[n], F.when(i == F.size("rows") - 1, "").when(r["link"] == F.get("rows", i + 1)["id"], LINE_SEP).otherwise(LINE_BREAK)))
        return F.array_join(parts, "").alias(n)
    return g.select(*keys, *[c for c in g.columns if c not in (*keys, "rows")], *[text(n) for n in texts])


def context_windows(ordered: DataFrame, chained: DataFrame, context: int = 2) -> DataFrame:
    """Rendered window of each chain: ``doc_id``, ``head_pos``, ``source``, ``target``, ``has_abbr``.

    ``ordered`` needs ``source_sic``, ``target_corr``, ``contains_abbr`` and the link. Windows are joined line by line on
    (document, position), which are unique, so a large document is no hot key. A chain that ends far before its first line
    has an empty window.
    """
    w = chain_windows(ordered, chained, context, context)
    held = w.join(ordered, ["doc_id", "pos"])
    text = render(held, "nonbreaking_next_line", ["doc_id", "head_pos"], {"source": "source_sic", "target": "target_corr"}, [F.bool_or(F.col("contains_abbr") == "true").alias("has_abbr")])
    every = chained.where("pos_in_chain = 0").select("doc_id", "head_pos")
    return every.join(text, ["doc_id", "head_pos"], "left").select("doc_id", "head_pos", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target", F.lit("")).alias("target"), F.coalesce("has_abbr", F.lit(False)).alias("has_abbr"))


def budget_windows(ordered: DataFrame, chained: DataFrame, context: int = 2, max_bytes: int = 480) -> DataFrame:
    """Context windows trimmed to a byte budget: ``doc_id``, ``head_pos``, ``n_before``, ``n_after``, ``n_chain``, ``n_bytes``.

    Bytes are those of ``source_sic`` and one per separator. Context behind is dropped from the far end first, then context
    before; a chain's own lines never are. Every variant is a sum over the few context lines, and the first that fits wins.
    """
    size = F.octet_length(F.coalesce("source_sic", F.lit(""))).cast("bigint")
    near = with_neighbours(ordered.select("doc_id", "pos", size.alias("bytes")), ["doc_id"], {**{f"b{k}": (F.col("bytes"), -k) for k in range(1, context + 1)}, **{f"a{k}": (F.col("bytes"), k) for k in range(1, context + 1)}})
    own = chained.join(near, ["doc_id", "pos"]).groupBy("doc_id", "head_pos").agg(F.sum("bytes").alias("own"), F.count("*").alias("n_chain"), F.max_by("pos", "pos_in_chain").alias("last_pos"), *[F.max(F.when(F.col("pos") == F.col("head_pos"), F.col(f"b{k}"))).alias(f"b{k}") for k in range(1, context + 1)], F.max_by(F.struct(*[f"a{k}" for k in range(1, context + 1)]), "pos_in_chain").alias("tail"))
    got = own.select("doc_id", "head_pos", "n_chain", "own", *[f"b{k}" for k in range(1, context + 1)], "tail.*")
    n_b = sum((F.col(f"b{k}").isNotNull().cast("int") for k in range(1, context + 1)), F.lit(0))
    n_a = sum((F.col(f"a{k}").isNotNull().cast("int") for k in range(1, context + 1)), F.lit(0))
    got = got.withColumns({"mb": n_b, "ma": n_a})
    zero = F.lit(0).cast("bigint")
    before = [sum((F.coalesce(F.col(f"b{k}"), zero) for k in range(1, n + 1)), zero) for n in range(context + 1)]
    after = [sum((F.coalesce(F.col(f"a{k}"), zero) for k in range(1, n + 1)), zero) for n in range(context + 1)]
    def total(b: int, a: int):  # noqa: ANN202
        nb, na = F.least(F.col("mb"), F.lit(b)), F.least(F.col("ma"), F.lit(a))
        return F.struct(nb.alias("n_before"), na.alias("n_after"), (F.col("own") + before[b] + after[a] + F.col("n_chain") + nb + na - 1).alias("n_bytes"))
    variants = [*[(context, a) for a in range(context, -1, -1)], *[(b, 0) for b in range(context - 1, -1, -1)]]
    pick = None
    for b, a in variants[:-1]:
        v = total(b, a)
        pick = F.when(v["n_bytes"] <= max_bytes, v) if pick is None else pick.when(v["n_bytes"] <= max_bytes, v)
    return got.select("doc_id", "head_pos", pick.otherwise(total(0, 0)).alias("w"), F.col("n_chain").cast("int").alias("n_chain")).select("doc_id", "head_pos", "w.n_before", "w.n_after", "n_chain", "w.n_bytes")


def seq2seq_examples(windows: DataFrame, heads: DataFrame, dropout: float = 0.5, lang_prefix: bool = False, oversample: float = 2.0, seed: int = 42, strip: bool = False) -> DataFrame:
    """Examples from rendered windows: ``doc_id``, ``head_pos``, ``copy``, ``source``, ``source_marked``, ``target``, ``has_abbr``, ``lang``.

    With probability ``dropout`` a window with abbreviations loses its markers (``source_marked`` keeps them for
    evaluation); with ``strip``, for validation and test, every window loses them. Empty languages become ``la``. ``lang_prefix`` puts ``[LA]`` and the like before the source.
    ``oversample`` f adds ``floor(n * (f - 1))`` draws with replacement of examples with abbreviations as copies 1, 2, …;
    draws come from hashes of seed and number, so they don't depend on partitioning.
    """
    lang = F.when(F.coalesce(F.size("lang"), F.lit(0)) <= 0, F.array(F.lit("la"))).otherwise(F.col("lang"))
    rows = windows.join(heads.select("doc_id", F.col("pos").alias("head_pos"), lang.alias("lang")), ["doc_id", "head_pos"])
    drop = F.lit(True) if strip else F.col("has_abbr") & (hash_uniform(seed, "doc_id", "head_pos") < dropout)
    source = F.when(drop, strip_markers("source")).otherwise(F.col("source"))
    if lang_prefix:
        source = F.concat(F.lit("["), F.upper(F.get("lang", F.lit(0))), F.lit("] "), source)
    rows = rows.select("doc_id", "head_pos", F.lit(0).cast("bigint").alias("copy"), source.alias("source"), F.col("source").alias("source_marked"), "target", "has_abbr", "lang")
    if oversample <= 1:
        return rows
    rows = materialise(rows, "examples")
    # Only keys are ranked; texts travel once, to their draws.
    pool = materialise(ranked(rows.where("has_abbr").select("doc_id", "head_pos"), [], ["doc_id", "head_pos"], "i"), "example-pool")
    n = pool.count()
    extra = int(n * (oversample - 1))
    draws = rows.sparkSession.range(extra).select((F.col("id") + 1).alias("copy"), F.floor(hash_uniform(seed + 1, "id") * n).alias("i"))
    drawn = pool.join(draws, "i").select("doc_id", "head_pos", "copy")
    return rows.unionByName(rows.drop("copy").join(drawn, ["doc_id", "head_pos"]).select(*rows.columns))


def lexicon(texts: DataFrame, col: str = "target_corr", least: int = 3) -> DataFrame:
    """``word``, ``n``: words of more than two letters, without outer punctuation, lower case, that occur at least ``least`` times."""
    words = texts.select(F.explode(F.split(F.col(col), r"(?U)\s+")).alias("w")).select(bare_word("w").alias("word"))
    return words.where(F.length("word") > 2).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def lexicon_hits(boundaries: DataFrame, words: DataFrame) -> DataFrame:
    """``boundary_id``, ``candidate``, ``known``: whether the last word before a boundary and the first behind it join to a known word."""
    last = F.regexp_extract("line_end", r"(?U)(\S+)\s*$", 1)
    first = F.regexp_extract("line_start", r"(?U)^\s*(\S+)", 1)
    rows = boundaries.select("boundary_id", bare_word(F.concat(last, first)).alias("candidate"))
    return rows.join(small_or_plain(words.select(F.col("word").alias("candidate"), F.lit(True).alias("hit"))), "candidate", "left").select("boundary_id", "candidate", F.coalesce("hit", F.lit(False)).alias("known"))
