"""Rule-driven cleaning: rules as data, the chapter pipeline, and its report."""

from __future__ import annotations

import json
import re as pyre
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions import udfs
from vellum.functions.predicates import CUTOFFS, DROP_TITLES, FLAGS, first_match
from vellum.functions.text import rstrip
from vellum.session import spread


@dataclass(frozen=True)
class Rules:
    """Three ordered lists of patterns. A file extends the defaults unless it replaces them."""

    drop_titles: list[str] = field(default_factory=lambda: list(DROP_TITLES))
    cutoffs: list[str] = field(default_factory=lambda: list(CUTOFFS))
    removals: list[str] = field(default_factory=list)

    NAMES = {"drop_titles": "drop_chapter_title_patterns", "cutoffs": "section_cutoff_patterns", "removals": "remove_patterns"}

    @classmethod
    def of(cls, payload: dict) -> Rules:
        given = {}
        for own, name in cls.NAMES.items():
            value = payload.get(name, [])
            if not isinstance(value, list):
                raise ValueError(f"{name} must be a list")
            for p in value:
                pyre.compile(p)
            given[own] = list(map(str, value))
        if payload.get("replace_defaults"):
            return cls(**given)
        base = cls()
        return cls(**{k: getattr(base, k) + v for k, v in given.items()})

    @classmethod
    def load(cls, *paths: str | Path | None) -> Rules:
        """The first file that exists (explicit, of the book, template), else the defaults."""
        for p in paths:
            if p and Path(p).exists():
                return cls.of(json.loads(Path(p).read_text("utf-8")))
        return cls()

    def own(self) -> dict[str, list[str]]:
        """What a file must keep: entries that are no defaults."""
        base = Rules()
        return {name: [p for p in getattr(self, k) if p not in getattr(base, k)] for k, name in self.NAMES.items()}


def cut_section(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """(text before the section, pattern): the first pattern in list order that is found cuts, wherever it stands."""
    which = first_match(text, patterns)
    kept = text
    for p in reversed(patterns):
        at = F.regexp_instr(text, F.lit(FLAGS + p))
        kept = F.when(which == p, rstrip(F.substring(text, F.lit(1), at - 1))).otherwise(kept)
    return kept, which


def removed_native(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """(text, matches of each pattern that had any), the patterns applied one after the other."""
    counts = []
    for p in patterns:
        counts.append(F.struct(F.lit(p).alias("key"), F.regexp_count(text, F.lit(FLAGS + p)).alias("value")))
        text = F.regexp_replace(text, F.lit(FLAGS + p), F.lit(""))
    found = F.filter(F.array(*counts), lambda e: e["value"] > 0) if counts else F.array().cast("array<struct<key:string,value:int>>")
    return text, F.map_from_entries(found)


def context_words(title: Column, authors: Column, chapter: Column) -> Column:
    """What else tells how words are spelled: the book's title, its authors and the chapter's title."""
    return F.filter(F.concat(F.array(title), F.coalesce(authors, F.array().cast("array<string>")), F.array(chapter)), lambda w: w.isNotNull() & (F.trim(w) != ""))


def cleaned_chapters(chapters: DataFrame, books: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Every raw chapter with its clean text or the reason it is dropped.

    Dropped titles are filtered out before any text is cleaned; a chapter without text is ``missing_raw``."""
    rules = rules or Rules()
    meta = books.groupBy("book_id").agg(F.max_by(F.struct(F.col("title").alias("t"), F.col("authors").alias("a")), F.coalesce("created_unix", F.lit(0))).alias("_m"))
    why = first_match("title", rules.drop_titles)
    x = chapters.withColumn("drop_reason", F.when(why != "", why).when(F.col("text").isNull(), "missing_raw").otherwise("")).join(meta, "book_id", "left")
    kept = spread(x.where("drop_reason = ''"), "book_id", "chapter_index").withColumn("_w", context_words(F.col("_m.t"), F.col("_m.a"), F.col("title")))
    kept = kept.withColumn("_c", udfs.cleaned(rules.removals, rules.cutoffs)("text", "_w", "headings"))
    raw_chars = F.char_length("text").alias("raw_chars")
    keys = ["row_id", "book_id", "chapter_index", "title", "headings", "heading_categories"]
    clean = kept.select(*keys, F.lit(False).alias("dropped"), "drop_reason", F.col("_c.cutoff").alias("cutoff_reason"), raw_chars, F.col("_c.text").alias("text"), F.col("_c.removed").alias("removed"))
    none = F.lit(None)
    gone = x.where("drop_reason <> ''").select(*keys, F.lit(True).alias("dropped"), "drop_reason", F.lit("").alias("cutoff_reason"), raw_chars, none.cast("string").alias("text"), none.cast("map<string,int>").alias("removed"))
    return clean.unionByName(gone).withColumn("clean_chars", F.char_length("text"))


def report(cleaned: DataFrame) -> DataFrame:
    """Totals of each book's cleaning."""
    one = lambda c: F.count(F.when(c, 1))
    return cleaned.groupBy("book_id").agg(
        F.count("*").alias("chapters"), one(F.col("dropped")).alias("dropped"), one(F.col("cutoff_reason") != "").alias("cut"),
        F.sum(F.coalesce("raw_chars", F.lit(0))).alias("raw_chars"), F.sum(F.coalesce("clean_chars", F.lit(0))).alias("clean_chars"),
    )


def removal_totals(cleaned: DataFrame) -> DataFrame:
    """Matches of each removal pattern over a book."""
    return cleaned.select("book_id", F.explode("removed").alias("pattern", "n")).groupBy("book_id", "pattern").agg(F.sum("n").cast("long").alias("matches"))
