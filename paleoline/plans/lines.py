"""Queries of the line table's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paleoline.functions import align
from paleoline.functions import text as tx
from paleoline.functions import tokens as tk
from paleoline.operators import chains as ch
from paleoline.operators import compare as cp
from paleoline.operators import examples as ex
from paleoline.operators import metrics as mt
from paleoline.operators import order as od
from paleoline.operators import repair as rp
from paleoline.operators import reports as rt
from paleoline.session import current, materialise
from paleoline.session import table as _t

LINK = "nonbreaking_next_line"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lines")


def _key_columns() -> list:
    return [F.col(f"k.{n}").alias(n) for n in ("work", "vol", "page", "marg", "seq")]


def lines_sorted(spark: SparkSession, d: str) -> DataFrame:
    return od.document_order(_lines(spark, d)).select("id", "doc_id", *_key_columns(), "pos")


def dedup_last_writer(spark: SparkSession, d: str) -> DataFrame:
    return current(_lines(spark, d), "doc_id", "source_sic", "target_corr", "file_pos")


def linked_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ex.linked_pairs(_lines(spark, d), "doc_id", "source_sic")


def boundary_examples(spark: SparkSession, d: str) -> DataFrame:
    return ex.boundary_examples(_lines(spark, d)).withColumn("lang", F.array_join("lang", ",", "?"))


def _boundary_set(spark: SparkSession, d: str) -> DataFrame:
    return materialise(ex.boundary_examples(_lines(spark, d)).select("boundary_id", "doc_id", "label", "crosses_page_break"), "boundaries")


def boundary_counts(spark: SparkSession, d: str) -> DataFrame:
    return _boundary_set(spark, d).groupBy("label", "crosses_page_break").agg(F.count("*").alias("n"))


def doc_split(spark: SparkSession, d: str) -> DataFrame:
    return ex.document_split(_lines(spark, d))


def split_examples(spark: SparkSession, d: str) -> DataFrame:
    b = _boundary_set(spark, d)
    return b.join(ex.document_split(b), "doc_id").groupBy("split", "label").agg(F.count("*").alias("n"))


def class_weight(spark: SparkSession, d: str) -> DataFrame:
    b = _boundary_set(spark, d)
    return ex.class_weight(b.join(ex.document_split(b), "doc_id"), ["split"])


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return od.document_order(_lines(spark, d), LINK, "source_sic", "target_corr", "contains_abbr", "lang")


def _chained(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = _ordered(spark, d)
    return o, materialise(ch.chains(o), "chains")


def chains(spark: SparkSession, d: str) -> DataFrame:
    return ch.chains(_ordered(spark, d)).select("id", "head_pos", "pos_in_chain")


def chain_counts(spark: SparkSession, d: str) -> DataFrame:
    c = ch.chains(_ordered(spark, d)).groupBy("doc_id", "head_pos").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("chains"), F.max("n").alias("longest"))


def chain_profile(spark: SparkSession, d: str) -> DataFrame:
    return ch.chain_profile(materialise(ch.profiled_chains(_lines(spark, d)), "profiles"))


def chain_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ch.chain_histogram(ch.profiled_chains(_lines(spark, d)))


def heads(spark: SparkSession, d: str) -> DataFrame:
    cur = current(_lines(spark, d), LINK)
    return cur.select("id").join(cur.where(f"{LINK} <> ''").select(F.col(LINK).alias("id")), "id", "left_anti")


def context_windows(spark: SparkSession, d: str) -> DataFrame:
    return ex.context_windows(*_chained(spark, d))


def leaping_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains whose end lies too far behind their beginning for one window, and the widest of the others."""
    c = ex.chain_spans(ch.chains(_ordered(spark, d)))
    return c.agg(F.count_if("leaps").alias("leaping"), F.max(F.when(~F.col("leaps"), F.col("last_pos") - F.col("head_pos"))).alias("widest"))


def budget_windows(spark: SparkSession, d: str) -> DataFrame:
    return ex.budget_windows(*_chained(spark, d))


def seq2seq_examples(spark: SparkSession, d: str) -> DataFrame:
    o, c = _chained(spark, d)
    out = ex.seq2seq_examples(materialise(ex.context_windows(o, c), "windows"), o)
    return out.select("doc_id", "head_pos", "copy", "source", "target", "has_abbr", F.array_join("lang", ",", "?").alias("lang"))


def eval_examples(spark: SparkSession, d: str) -> DataFrame:
    """Validation and test examples: every window without markers, none twice; the training documents' where a split has none."""
    o, c = _chained(spark, d)
    split = materialise(ex.document_split(_lines(spark, d)), "split")
    rows = materialise(ex.seq2seq_examples(ex.context_windows(o, c), o, oversample=1, strip=True).join(split, "doc_id"), "eval-examples")
    held = [rt.or_all(rows.where(F.col("split") == s), rows.where("split = 'train'")).withColumn("split", F.lit(s)) for s in ("val", "test")]
    return held[0].unionByName(held[1]).select("split", "doc_id", "head_pos", "source", "target")


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand rows of the export, for smoke tests."""
    return rt.head(_lines(spark, d).select("file_pos", "id", "source_sic"), 1000, ["file_pos"])


def zipped_views(spark: SparkSession, d: str) -> DataFrame:
    """Inputs, outputs and targets side by side by position, as long as the shortest of the three."""
    lines = _lines(spark, d).select("file_pos", F.col("source_sic").alias("input"), F.col("target_sic").alias("output"), F.col("target_corr").alias("target"))
    parts = {"input": lines.where("input is not null"), "output": lines.where("output is not null"), "target": lines.where("target is not null")}
    return rt.zip_positions(parts, ["file_pos"])


def chain_report(spark: SparkSession, d: str) -> DataFrame:
    """The chain profile as lines of text, with the distribution of the chains' numbers of lines below."""
    held = materialise(ch.profiled_chains(_lines(spark, d)), "profiles")
    out = rt.text_report(ch.chain_profile(held), "Chains of linked lines")
    each = ch.chain_histogram(held).select((F.col("n_lines") + 100).cast("int").alias("n"), F.format_string("%d lines: %d chains (%.2f %%)", F.col("n_lines").cast("bigint"), "n", 100 * F.col("share")).alias("line"))
    return out.unionByName(each)


def boundary_document(spark: SparkSession, d: str) -> DataFrame:
    """The whole evaluation of the boundaries as one nested row, as it is written to a JSON document."""
    s = _scored(spark, d)
    by = lambda key: mt.prf(s, [key]).select(key, *_PRF)
    return rt.nested({
        "overall": mt.prf(s, []).select(*_PRF), "threshold": mt.pick_threshold(mt.pr_curve(s)), "by_page[]": by("crosses_page_break"), "by_doc[]": by("doc_id"),
        "curve[]": mt.pr_curve(s).select("recall", "precision", "threshold"), "errors[]": mt.error_samples(s),
    })


def boundary_figures(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and figures of the nested evaluation."""
    r = boundary_document(spark, d)
    return r.select("overall.n", F.col("overall.precision"), F.col("overall.recall"), "threshold.threshold", F.size("by_doc").alias("docs"), F.size("curve").alias("points"), F.size("errors").alias("errors"))


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    return ex.lexicon(current(_lines(spark, d), "target_corr"))


def lexicon_hits(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    words = materialise(ex.lexicon(current(lines, "target_corr")), "lexicon")
    return ex.lexicon_hits(_t(spark, d, "boundaries").where("boundary_id is not null").select("boundary_id", "line_end", "line_start").distinct(), words)


def canonical_equal(spark: SparkSession, d: str) -> DataFrame:
    cur = current(_lines(spark, d), "source_sic", "target_sic")
    return cur.select("id", cp.same_text(F.col("source_sic"), F.col("target_sic")).alias("equal"), cp.blank_only(F.col("source_sic"), F.col("target_sic")).alias("blank_only"))


def _second_export(spark: SparkSession, d: str) -> DataFrame:
    """A second export made of the corrections: their views, and their source where there is one; ids that lead nowhere stay."""
    fix = current(_t(spark, d, "corrections"), "new_source_corr", "new_target_sic", "new_target_corr", order="corrected_at")
    cur = current(_lines(spark, d), "source_sic")
    return fix.join(cur, "id", "left").select("id", F.coalesce("new_source_corr", "source_sic").alias("source"), F.col("new_target_sic").alias("target"), F.col("new_target_corr").alias("target_corr"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    return cp.compare_exports(current(_lines(spark, d), "source_sic", "target_sic", "target_corr"), _second_export(spark, d))


def export_diff(spark: SparkSession, d: str) -> DataFrame:
    r = _report(spark, d)
    return r.select("id", "status", F.explode_outer("details").alias("field", "v")).select("id", "status", "field", F.col("v.A").alias("a"), F.col("v.B").alias("b"))


def export_missing(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).where("status = 'missing_in_A'").select("id")


def diff_triage(spark: SparkSession, d: str) -> DataFrame:
    return cp.triage(_report(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


def diff_chars(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of letters that differ, the most frequent first; of equally frequent ones the one whose first line id is smaller."""
    r = _report(spark, d).where("status = 'differences_found'").select("id", F.explode(F.map_values("details")).alias("v"))
    pairs = r.where(~cp.blank_only(F.col("v.A"), F.col("v.B"))).select("id", F.explode(align.differing_letters("v.A", "v.B")).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return rt.most_common(counts, "first_id", "a", "b").select("rank", "a", align.char_name("a").alias("a_name"), "b", align.char_name("b").alias("b_name"), "n")


def lookback_links(spark: SparkSession, d: str) -> DataFrame:
    return cp.lookback_links(_lines(spark, d))


def apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    return cp.apply_corrections(_lines(spark, d), _t(spark, d, "corrections"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    cur = current(_lines(spark, d), "source_sic").where(F.col("source_sic").contains(tx.ABBR_OPEN))
    return cur.select("id", F.posexplode(tx.closed_spans("source_sic")).alias("n", "abbr"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return materialise(mt.scored(_t(spark, d, "boundaries")), "scored")


_PRF = ("n", "n_positive", "precision", "recall", "f1")


def prf_overall(spark: SparkSession, d: str) -> DataFrame:
    return mt.prf(_scored(spark, d), []).select(*_PRF)


def prf_by_page(spark: SparkSession, d: str) -> DataFrame:
    return mt.prf(_scored(spark, d), ["crosses_page_break"]).select("crosses_page_break", *_PRF)


def prf_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return mt.prf(_scored(spark, d), ["doc_id"]).select("doc_id", *_PRF)


def prf_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return mt.prf(_scored(spark, d).withColumn("lang", F.explode("lang")), ["lang"]).select("lang", *_PRF)


def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return mt.pr_curve(_scored(spark, d))


def threshold(spark: SparkSession, d: str) -> DataFrame:
    return mt.pick_threshold(mt.pr_curve(_scored(spark, d)))


def error_samples(spark: SparkSession, d: str) -> DataFrame:
    return mt.error_samples(_scored(spark, d))


def restore_lines(spark: SparkSession, d: str) -> DataFrame:
    """Windows rendered and cut back into their own lines, with the line's own text where the parts don't match."""
    from paleoline.operators.infer import split_back

    o, c = _chained(spark, d)
    w = ex.budget_windows(o, c)
    return split_back(o, c, w, lambda df: df)


def infer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    from paleoline.operators.infer import run_pipeline

    return run_pipeline(_lines(spark, d), _t(spark, d, "corrections")).select("id", "predicted_next_line", "expanded_text")


def facs_urls(spark: SparkSession, d: str) -> DataFrame:
    return current(_lines(spark, d), "facs_id").select("id", tx.facs_url("facs_id").alias("url"))


def abbreviation_letters(spark: SparkSession, d: str) -> DataFrame:
    return current(_lines(spark, d), "source_sic").select("id", tx.has_abbreviation_letters("source_sic").alias("has_letters"), tx.last_token("source_sic").alias("last_token"), tx.first_token("source_sic").alias("first_token"))


def span_cer(spark: SparkSession, d: str) -> DataFrame:
    """Spans, exact ones, their rate and the error rate of their letters; both rates are null without any span."""
    s = _span_results(spark, d)
    out = s.agg(F.count("*").alias("n_spans"), F.count_if(F.col("gold") == F.col("predicted")).alias("n_exact"), mt.cer(F.col("predicted"), F.col("gold")).alias("cer"))
    some = F.col("n_spans") > 0
    return out.select("n_spans", "n_exact", F.when(some, F.col("n_exact") / F.col("n_spans")).alias("exact_match"), F.when(some, F.col("cer")).alias("span_cer"))


def _span_results(spark: SparkSession, d: str) -> DataFrame:
    """Every closed span of the current lines; the reading's expansion stands for a model's output."""
    cur = current(_lines(spark, d), "source_sic", "target_sic", "target_corr", "file_pos").where(F.col("source_sic").contains(tx.ABBR_OPEN))
    return cur.select("file_pos", F.posexplode(align.span_results("source_sic", "target_sic", "target_corr")).alias("n", "s")).select("file_pos", "n", "s.*")


def type_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each abbreviation by falling frequency, of equally frequent ones the first in row order; its expansions with their counts, the most frequent first, and its first 20 errors in row order."""
    s = materialise(_span_results(spark, d), "spans")
    per = s.groupBy("abbr").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("n_exact"), mt.cer(F.col("predicted"), F.col("gold")).alias("cer"), F.min(F.struct("file_pos", "n")).alias("first"))
    per = rt.most_common(per, "first", "abbr")
    counted = s.groupBy("abbr", "gold").agg(F.count("*").alias("c")).groupBy("abbr")
    most = counted.agg(F.max_by("gold", F.struct("c", "gold")).alias("top_expansion"), F.count("*").alias("n_expansions"), F.sort_array(F.collect_list(F.struct("c", "gold")), asc=False).alias("counts"))
    first = rt.first_of_each(s.where("gold <> predicted"), "abbr", ["file_pos", "n"])
    wrong = first.groupBy("abbr").agg(F.array_sort(F.collect_list(F.struct("file_pos", "n", "predicted", "gold"))).alias("wrong"))
    expansions = F.transform("counts", lambda x: F.struct(x["gold"].alias("gold"), x["c"].alias("n"))).alias("expansions")
    errors = F.transform(F.coalesce("wrong", F.array().cast("array<struct<file_pos:bigint,n:int,predicted:string,gold:string>>")), lambda x: F.struct(x["predicted"].alias("predicted"), x["gold"].alias("gold"))).alias("errors")
    out = per.join(most, "abbr").join(wrong, "abbr", "left")
    return out.select("rank", "abbr", "n", "n_exact", (F.col("n_exact") / F.col("n")).alias("exact_match"), "cer", "top_expansion", "n_expansions", expansions, errors)


def full_line_cer(spark: SparkSession, d: str) -> DataFrame:
    cur = current(_lines(spark, d), "target_sic", "target_corr").where("target_sic is not null and target_corr is not null")
    return cur.agg(F.count("*").alias("n"), mt.cer(F.col("target_sic"), F.col("target_corr")).alias("full_line_cer"))


def validation_metrics(spark: SparkSession, d: str, cap: int = 10_000) -> DataFrame:
    """The figures of a validation during training, over the first ``cap`` inputs in order: error rate of whole lines, and of spans, rounded."""
    cur = current(_lines(spark, d), "source_sic", "target_sic", "target_corr", "file_pos").where("source_sic is not null and target_sic is not null and target_corr is not null")
    held = materialise(rt.head(cur, cap, ["file_pos"]), "validation")
    whole = held.agg(F.count("*").alias("n_lines"), F.round(mt.cer(F.col("target_sic"), F.col("target_corr")), 4).alias("full_line_cer"))
    s = held.where(F.col("source_sic").contains(tx.ABBR_OPEN)).select(F.explode(align.span_results("source_sic", "target_sic", "target_corr")).alias("s")).select("s.*")
    exact = F.count_if(F.col("gold") == F.col("predicted"))
    spans = s.agg(F.count("*").alias("n_spans"), F.round(mt.cer(F.col("predicted"), F.col("gold")), 4).alias("span_cer"), F.round(F.when(F.count("*") > 0, exact / F.count("*")).otherwise(0.0), 4).alias("span_exact_match"))
    return whole.crossJoin(spans)


def byte_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Byte tokens of each source, at most 256: their number, sum, and the text they give back."""
    ids = tk.byte_ids("source_sic", 256)
    cur = current(_lines(spark, d), "source_sic").where("source_sic is not null").select("id", ids.alias("ids"))
    return cur.select("id", F.size("ids").alias("n_tokens"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"), tk.text_of_ids(tk.labels("ids")).alias("text"))


def restore_glyphs(spark: SparkSession, d: str) -> DataFrame:
    """Glyphs of ``source_sic`` put back into ``target_sic``, and of ``source_corr`` into ``target_corr``; only lines that have one leave the engine."""
    cur = current(_lines(spark, d), "source_sic", "source_corr", "target_sic", "target_corr")
    has = lambda s, t: F.coalesce(F.col(s).rlike("[ſæÆœŒ]") & F.col(t).isNotNull(), F.lit(False))
    some = has("source_sic", "target_sic") | has("source_corr", "target_corr")
    done = cur.where(some).select("id", align.restore_glyphs("source_sic", "target_sic").alias("target_sic"), align.restore_glyphs("source_corr", "target_corr").alias("target_corr"))
    return done.unionByName(cur.where(~some).select("id", "target_sic", "target_corr"))


def repair_breaks(spark: SparkSession, d: str) -> DataFrame:
    return rp.break_repairs(_lines(spark, d))


def repair_counts(spark: SparkSession, d: str) -> DataFrame:
    r = rp.break_repairs(_lines(spark, d))
    return r.select(F.explode(F.filter(F.split("kinds", ""), lambda x: x != "")).alias("fix_type")).groupBy("fix_type").agg(F.count("*").alias("n"))


def normalized(spark: SparkSession, d: str) -> DataFrame:
    """Every text view of the current lines in canonical composition."""
    views = ("source_sic", "source_corr", "target_sic", "target_corr")
    cur = current(_lines(spark, d), *views)
    return cur.select("id", *[align.nfc(v).alias(v) for v in views])


def lang_counts(spark: SparkSession, d: str) -> DataFrame:
    cur = current(_lines(spark, d), "lang")
    langs = F.array_distinct(F.filter(F.coalesce("lang", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    return cur.select(F.explode(langs).alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))


def _page_documents(spark: SparkSession, d: str) -> DataFrame:
    """The current lines written as edition XML, one document a page: what the shredder reads."""
    o = od.with_neighbours(od.document_order(_lines(spark, d), LINK, "source_sic"), ["doc_id"], {"before": (F.col(LINK), -1)})
    esc = F.replace(F.replace(F.coalesce("source_sic", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lb = F.concat(F.lit('<lb xml:id="'), F.col("id"), F.when(F.col("before") == F.col("id"), '" break="no"/>').otherwise('"/>'), esc)
    page = F.split_part("id", F.lit("-lb-"), F.lit(1))
    g = o.groupBy("doc_id", page.alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", lb.alias("x")))), lambda r: r["x"]), "\n").alias("body"))
    head = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="'), F.coalesce("doc_id", F.lit("")), F.lit('"><teiHeader><revisionDesc status="h_revised"/></teiHeader><text type="work"><body><p>'))
    return g.select(F.col("page").alias("file_name"), F.concat(head, "body", F.lit("</p></body></text></TEI>")).alias("xml"))


def xml_lines(spark: SparkSession, d: str) -> DataFrame:
    from paleoline.sources.tei import shred_documents

    return shred_documents(_page_documents(spark, d)).select("id", "doc_id", "source_sic", "target_corr", "ancestor_type", "is_in_note")


def xml_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the corrected view of each line put in; counts of choices and of continued breaks per document."""
    from paleoline.sources.tei import write_expansions

    docs = materialise(_page_documents(spark, d), "documents")
    new = current(_lines(spark, d), "target_corr", LINK).select(F.split_part("id", F.lit("-lb-"), F.lit(1)).alias("file_name"), "id", F.coalesce("target_corr", F.lit("")).alias("text"), F.coalesce(LINK, F.lit("")).alias("next_id"))
    out = write_expansions(docs, new)
    return out.select("file_name", F.regexp_count("xml", F.lit("<choice>")).alias("choices"), F.regexp_count("xml", F.lit('break="no"')).alias("continued"))


def character_table(spark: SparkSession, d: str) -> DataFrame:
    """Every glyph reference of the character table with what stands for it."""
    from paleoline.sources.characters import character_table as table
    from paleoline.sources.characters import glyph_lookup

    return glyph_lookup(table(spark).select(F.concat(F.lit("#"), "id").alias("ref"), F.lit("").alias("text")))


def boundary_model(spark: SparkSession, d: str) -> DataFrame:
    """The boundary classifier, fitted on training documents and scored on test documents."""
    from paleoline.operators import boundary_model as bm

    rows = mt.scored(_t(spark, d, "boundaries")).drop("prob")
    split = materialise(ex.document_split(rows), "split")
    rows = materialise(rows.join(split, "doc_id"), "boundary-rows")
    known = materialise(ex.lexicon(current(_lines(spark, d), "target_corr")), "lexicon")
    model, _ = bm.fit_best(rows.where("split = 'train'"), rt.or_all(rows.where("split = 'val'"), rows.where("split = 'train'")), known, (10, 25))
    return bm.report(bm.scorer(model, known)(rows.where("split = 'test'")))


QUERIES = {
    f.__name__: f
    for f in (
        lines_sorted, dedup_last_writer, linked_pairs, boundary_examples, boundary_counts, doc_split, split_examples, class_weight, chains, chain_counts, chain_profile,
        chain_histogram, chain_report, heads, eval_examples, first_lines, zipped_views, boundary_figures, context_windows, leaping_chains, budget_windows, seq2seq_examples, lexicon, lexicon_hits, canonical_equal, export_diff, export_missing, diff_triage, diff_chars,
        lookback_links, apply_corrections, spans, prf_overall, prf_by_page, prf_by_doc, prf_by_lang, pr_curve, threshold, error_samples, restore_lines, infer_pipeline, facs_urls,
        abbreviation_letters, span_cer, type_breakdown, full_line_cer, validation_metrics, byte_tokens, restore_glyphs, repair_breaks, repair_counts, normalized, lang_counts, xml_lines, xml_roundtrip, character_table, boundary_model,
    )
}
