"""Chunk manifests: build, reuse by hash, pauses over a book, and what synthesis does next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions import udfs
from vellum.functions.fields import synth_action
from vellum.functions.text import chapter_id, ellipsis_pause, ellipsis_run, sha256
from vellum.kernels.chars import SB
from vellum.session import spread

MOST, LEAST, PAD_MS = 100, 15, 350
CHAPTER_PAUSE, SECTION_PAUSE = 5, 3


def built(chapters: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """Chapters with their chunks: (…, chapter_id, text_sha256, chunks). A chapter without any chunk is left out."""
    x = spread(chapters, "book_id", "chapter_index").withColumn("chapter_id", chapter_id("path", "chapter_index"))
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    x = x.withColumn("_c", udfs.chapter_chunks(most, least)("text", F.coalesce("headings", none), F.coalesce("heading_categories", empty)))
    x = x.withColumns({"text": F.col("_c.text"), "chunks": F.col("_c.chunks")}).drop("_c").where(F.size("chunks") > 0)
    return x.withColumn("text_sha256", sha256("text"))


def exploded(manifest: DataFrame, *keep: str) -> DataFrame:
    """One row a chunk, numbered from 1."""
    return manifest.select(*keep, F.posexplode("chunks").alias("pos", "c")).select(
        *keep, (F.col("pos") + 1).alias("chunk_idx"), "c.start", "c.end", "c.text", "c.section_break", F.col("c.pause").alias("pause_multiplier")
    )


def with_chapter_pauses(chunks: DataFrame, keys: list[str], chapter: str, idx: str = "chunk_idx") -> DataFrame:
    """The last chunk of every chapter but a book's last pauses at least as long as between chapters."""
    ends = chunks.groupBy(*keys, chapter).agg(F.max(idx).alias("_last"))
    books = ends.groupBy(*keys).agg(F.max(chapter).alias("_end"))
    x = chunks.join(ends, [*keys, chapter]).join(books, keys)
    wider = (F.col(idx) == F.col("_last")) & (F.col(chapter) != F.col("_end"))
    return x.withColumn("pause_multiplier", F.when(wider, F.greatest("pause_multiplier", F.lit(CHAPTER_PAUSE))).otherwise(F.col("pause_multiplier"))).drop("_last", "_end")


def window_pauses(chunks: DataFrame, keys: list[str], text: str = "chapter_text") -> DataFrame:
    """The pause after each chunk by windows over its chapter, from start, end, chunk text, heading pause and the chapter text.

    The native form of the kernel's pauses, for manifests that are tables already."""
    from vellum.functions.predicates import ends_open, ends_sentence
    from vellum.functions.text import gap_pause, symbol_gap

    w = Window.partitionBy(*keys).orderBy("start")
    nxt = F.lead("start").over(w)
    x = chunks.withColumns({"_n": nxt, "_h": F.greatest("heading_pause", F.lead("heading_pause").over(w))})
    gap = F.substring(F.col(text), F.col("end") + 1, F.col("_n") - F.col("end"))
    x = x.withColumn("_gap", gap)
    broken = F.col("_gap").rlike("[\n]")
    joined = F.col("_gap").contains("\n") & ~F.col("_gap").contains(SB) & ends_open("text") & ~symbol_gap("_gap")
    wide = F.greatest(gap_pause("_gap"), F.when(symbol_gap("_gap"), SECTION_PAUSE), F.col("_h"))
    pause = F.when(F.col("_n").isNull() | (F.col("_n") < F.col("end")) | joined, 1).when(broken, wide).when(~ends_sentence("text"), 0).otherwise(gap_pause("_gap"))
    return x.withColumn("pause_multiplier", pause).drop("_n", "_h", "_gap")


def checked_pauses(pauses: Column, n: Column, fallback: Column) -> Column:
    """Stored pauses where there is one for each chunk, each bad one replaced by the fallback's, bad ones there by 1."""
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    good = lambda c: F.when(c >= 0, c)
    base = F.transform(places, lambda i: F.coalesce(good(F.get(fallback, i)), F.lit(1)))
    return F.when(F.size(pauses) == n, F.zip_with(pauses, base, lambda p, b: F.coalesce(good(p), b))).otherwise(base)


def legacy_pauses(section_breaks: Column, n: Column) -> Column:
    """Pauses of manifests that kept section breaks only."""
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.when(F.coalesce(F.get(section_breaks, i), F.lit(False)), SECTION_PAUSE).otherwise(1))


def to_rebuild(chapters: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters whose text or settings differ from the manifest's: an anti-join on the hash and the limits."""
    return chapters.join(manifest.select(*keys, "text_sha256", "max_chars", "min_chars"), [*keys, "text_sha256", "max_chars", "min_chars"], "left_anti")


def next_actions(chunks: DataFrame) -> DataFrame:
    """What synthesis does with each chunk (has_wav, has_voice), and how long its silence is."""
    run = ellipsis_run(F.coalesce("text", F.lit("")))
    x = chunks.withColumn("_run", run)
    return x.withColumns({"action": synth_action("text", "has_wav", "_run", "has_voice"), "silence_ms": ellipsis_pause("_run"), "pad_ms": F.coalesce("pause_multiplier", F.lit(1)) * PAD_MS}).drop("_run")


def regenerated(chunks: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of which those chosen (keys) are made again: they have no duration any more, and pause at least as long as a manifest of old has it.

    ``chunks`` has section_break, pause_multiplier and duration_ms. A pause of 0 within a sentence thus becomes 1 in a chunk that is made again."""
    x = chunks.join(chosen.select(*keys).distinct().withColumn("_again", F.lit(True)), keys, "left")
    legacy = F.when(F.coalesce("section_break", F.lit(False)), SECTION_PAUSE).otherwise(1)
    return x.withColumns({
        "pause_multiplier": F.when(F.col("_again"), F.greatest("pause_multiplier", legacy)).otherwise(F.col("pause_multiplier")),
        "duration_ms": F.when(F.col("_again").isNull(), F.col("duration_ms")),
    }).drop("_again")


def reset_sample(chunks: DataFrame, keys: list[str], chapter: str) -> DataFrame:
    """The first chapter of each book with its durations cleared, for a sample."""
    first = chunks.groupBy(*keys).agg(F.min(chapter).alias(chapter))
    return chunks.join(first, [*keys, chapter], "left_semi").withColumn("duration_ms", F.lit(None).cast("long"))
