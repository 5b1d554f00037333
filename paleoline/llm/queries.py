"""Queries over the operators of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paleoline.llm import language, leakage, overlap, packing, pieces, residue, splits
from paleoline.llm.sql import SQL
from paleoline.llm.text import normalise_text
from paleoline.session import materialise
from paleoline.session import table as _t


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lines")
    return language.wrong_labels(language.line_languages(lines, least_words=5))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    found = language.line_languages(_t(spark, d, "lines"))
    return found.select("id", F.posexplode("segments").alias("segment", "s")).select("id", "segment", F.col("s.start").alias("first_word"), F.col("s.end").alias("end_word"), "s.lang", F.round("s.confidence", 6).alias("confidence"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(_t(spark, d, "lines"), _t(spark, d, "works"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_pairs(spark, d))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lines")
    groups = materialise(splits.doc_groups(lines, _t(spark, d, "works")), "groups")
    return splits.assign_splits(lines, groups)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d).where("group_doc <> doc_id").select("group_doc", "doc_id")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d)


def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    return splits.balance(_t(spark, d, "lines"), materialise(_splits(spark, d), "splits"))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return normalise_text(_t(spark, d, "lines"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).where(F.size("flags") > 0).select("id", "field")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).select("id", "field", "clean", F.array_join("flags", ",").alias("flags"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.line_pieces(_t(spark, d, "lines"), only_large=True).where("piece = 1").select("id", "field")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.line_pieces(_t(spark, d, "lines"))


def p6_cover(spark: SparkSession, d: str) -> DataFrame:
    """How much of each field the pieces cover, without what they repeat, and whether each of them fits."""
    p = pieces.line_pieces(_t(spark, d, "lines"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("id", "field").orderBy("piece")), F.lit(0))
    p = p.withColumn("new", F.when(F.col("start") <= before, F.col("end") - before))
    return p.groupBy("id", "field").agg(F.sum("new").alias("chars"), F.bool_and(F.octet_length("piece_text") <= pieces.LIMIT).alias("fits"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_t(spark, d, "documents")).where("part = 0 and n_parts > 1").select("doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(packing.pack(_t(spark, d, "documents")))


def p8_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each document over all containers, and whether each container that holds a part of it fits."""
    p = materialise(packing.pack(_t(spark, d, "documents")), "packed")
    full = p.groupBy("container").agg((F.sum("tokens") <= 4096).alias("fits"))
    return p.join(full, "container").groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.bool_and("fits").alias("fits"))


def _leaked(spark: SparkSession, d: str, spans: bool = False) -> DataFrame:
    return leakage.leaked(_t(spark, d, "documents"), _t(spark, d, "eval_items"), spans=spans)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "item_id")


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    found = _leaked(spark, d, spans=True).groupBy("doc_id").agg(F.first("spans").alias("spans"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_leaked(spark, d), _t(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_t(spark, d, "documents")).where("reason is not null").select("doc_id")


def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_t(spark, d, "documents")).groupBy("reason").agg(F.count("*").alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_segments, p2_found, p2_report, p4_found, p4_splits, p4_balance, p5_found, p5_clean, p6_found, p6_pieces, p6_cover, p8_found, p8_fill, p8_tokens, p9_found, p9_spans, p9_items, p10_found, p10_reasons)}


def oracle_sql() -> dict[str, str]:
    return SQL
