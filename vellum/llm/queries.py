"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.llm import leaks, look, mojibake, pieces, sentences, sitelines, subjects, tokens
from vellum.session import table

Query = Callable[[SparkSession, str], DataFrame]

#: Problem 1's tables and fields.
LOOKS = {"chapters_raw": "text", "chapter_inputs": "text", "voices": "ref_text"}


def stacked(spark: SparkSession, sf_dir: str, fields: dict[str, str], *more: str) -> DataFrame:
    """(table_name, row_id, text, more...) of several tables, one under the other."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "row_id", F.col(f).alias("text"), *more) for t, f in fields.items()]
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look.alike_pairs(stacked(spark, sf_dir, LOOKS))


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look.canonical(stacked(spark, sf_dir, LOOKS), ["table_name", "row_id"], "text")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look.alike_classes(stacked(spark, sf_dir, LOOKS))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of all prepared texts and of the chapters that sentence_check names; the texts themselves are not shuffled with copies."""
    wanted = table(spark, sf_dir, "sentence_check").where("table_name = 'chapters_raw'").select("row_id").distinct()
    chapters = table(spark, sf_dir, "chapters_raw").where("text is not null").select("row_id", "text").join(wanted, "row_id", "left_semi")
    prepared = stacked(spark, sf_dir, {"tts_pipeline": "prepared"})
    both = prepared.unionByName(chapters.select(F.lit("chapters_raw").alias("table_name"), "row_id", "text"))
    return sentences.sentence_units(both, ["table_name", "row_id"], "text")


def p2_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of every chapter and every prepared text."""
    both = stacked(spark, sf_dir, {"chapters_raw": "text", "tts_pipeline": "prepared"})
    return sentences.sentence_units(both, ["table_name", "row_id"], "text")


def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = stacked(spark, sf_dir, {"chapter_inputs": "text", "tts_pipeline": "prepared"}, "lang")
    return pieces.with_limits(both, table(spark, sf_dir, "split_limits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(limited(spark, sf_dir), ["table_name", "row_id"], "text", "max_chars", "overlap_chars")


def p3_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts in pieces whose sizes are even and whose cuts are cheap as a whole."""
    return pieces.pieces(limited(spark, sf_dir), ["table_name", "row_id"], "text", "max_chars", "overlap_chars", "total")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.occurrences(table(spark, sf_dir, "chapters_raw"))


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, found = sitelines.boilerplate(table(spark, sf_dir, "chapters_raw"))
    return found.groupBy("site", "block").agg(F.count("*").alias("lines"), F.max("support").alias("support"))


def p4_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.removed(table(spark, sf_dir, "chapters_raw"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_restored(spark, sf_dir).select("table_name", "row_id")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired(stacked(spark, sf_dir, {"chapters_raw": "text", "toc_entries": "title"}), ["table_name", "row_id"], "text")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact round trip: every text from its ids, null as empty."""
    return tokens.decoded(p6_ids(spark, sf_dir), "doc_id", "ids")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "subject_labels")
    found, _ = subjects.subject_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subjects"), labels)
    return found.select("doc_id", "subject").join(labels.select("doc_id").distinct(), "doc_id", "left_anti")


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's subjects with their shares and calibrated probabilities, labelled documents included."""
    found, _ = subjects.subject_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subjects"), table(spark, sf_dir, "subject_labels"))
    return found


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    from vellum.llm import sql

    return sql.oracles()
