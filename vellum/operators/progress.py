"""Progress of books and chapters, totals, and the library's summary rows, from manifests as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions.fields import or_default
from vellum.functions.text import re, strip


def chunk_rows(manifest: DataFrame, *keep: str) -> DataFrame:
    """One row a chunk from chapters with parallel arrays; arrays that are too short leave nulls."""
    zipped = F.arrays_zip("chunks", "durations_ms")
    return manifest.select(*keep, "chapter_id", "title", F.posexplode(zipped).alias("pos", "z")).select(
        *keep, "chapter_id", "title", (F.col("pos") + 1).alias("chunk_idx"), F.col("z.chunks").alias("text"), F.col("z.durations_ms").alias("duration_ms")
    )


def progress(chunks: DataFrame, keys: list[str], order: list[str], duration: str = "duration_ms") -> DataFrame:
    """total, done, percent and the first pending chunk with its place in the whole; a duration of 0 is done, null is pending."""
    place = F.struct(*order)
    first = chunks.where(F.col(duration).isNull()).groupBy(*keys).agg(F.min(place).alias("_first"))
    sums = chunks.join(first, keys, "left").groupBy(*keys).agg(
        F.count("*").alias("total"), F.count(duration).alias("done"), F.count(F.when(place <= F.col("_first"), 1)).cast("int").alias("_at"), F.first("_first").alias("_first")
    )
    current = F.when(F.col("_first").isNotNull(), F.struct(F.col("_at").alias("global_index"), *(F.col(f"_first.{o}").alias(o) for o in order)))
    return sums.select(*keys, "total", "done", current.alias("current"), F.round(100.0 * F.col("done") / F.col("total"), 2).alias("percent"))


def chunk_count(chunks: Column, spans: Column, durations: Column) -> Column:
    """A chapter's number of chunks by the first of its arrays that is not empty."""
    sizes = (F.when(F.size(x) > 0, F.size(x)) for x in (chunks, spans, durations))
    return F.coalesce(*sizes, F.lit(0))


def audio_totals(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks and finished chunks of each book; a book with a finished recording has them all."""
    done = F.least(chunk_count(F.col("chunks"), F.col("chunk_spans"), F.col("durations_ms")), F.size(F.filter("durations_ms", lambda d: d.isNotNull())))
    sums = manifest.groupBy(*keys).agg(
        F.sum(chunk_count(F.col("chunks"), F.col("chunk_spans"), F.col("durations_ms"))).alias("audio_total"), F.sum(F.greatest(F.lit(0), done)).alias("audio_done"), F.max("has_recording").alias("has_recording")
    )
    return sums.withColumn("audio_done", F.when(F.col("has_recording"), F.col("audio_total")).otherwise(F.least("audio_done", "audio_total")))


def title_sort_key(title: Column, fallback: Column) -> Column:
    """Lower case without a leading article; the id where there is no title."""
    return F.lower(re(strip(or_default(title, fallback)), r"(?i)^(the|a|an)\s+", ""))


def library(books: DataFrame, chapters: DataFrame, playback: DataFrame) -> DataFrame:
    """A row for each book: its title, authors, chapters, what was heard of it, in the order a shelf shows them.

    A book ingested twice is shown once, as ingested last; it is finished when its last chapter was heard."""
    w = Window.partitionBy("book_id").orderBy(F.col("created_unix").desc_nulls_last(), "title")
    shown = books.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    counts = chapters.groupBy("book_id").agg(F.countDistinct("chapter_index").alias("chapters"))
    out = shown.join(counts, "book_id", "left").join(playback, "book_id", "left")
    n = F.coalesce("chapters", F.lit(0))
    return out.select(
        "book_id", or_default("title", F.col("book_id")).alias("title"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), n.alias("chapters"),
        "furthest_played", (F.coalesce("furthest_played", F.lit(-1)) >= n - 1).alias("complete"), title_sort_key(F.col("title"), F.col("book_id")).alias("sort_key"),
    )
