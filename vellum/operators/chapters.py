"""Chapters from a book's spine and contents: continuation, series, coverage, followers, and edits of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions.predicates import filename_like, lines, short_structural, split_series, structural_title, title_only
from vellum.functions.text import spaced, title_from_text
from vellum.operators.running import numbered, running
from vellum.session import written

#: A following chapter that takes a bare title in has at least this text.
LEAST_TEXT = 400


def ordered_text(text: str, order: list[str]) -> Column:
    """Texts of a group in order, blank ones left out, a blank line between."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return F.array_join(F.transform(F.filter(parts, lambda p: p["_t"].isNotNull() & (p["_t"] != "")), lambda p: p["_t"]), "\n\n")


def ordered_headings(order: list[str]) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(*order, F.coalesce("headings", F.array().cast("array<string>")).alias("_h"))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r["_h"])))


def continues(title: str = "title", source: str = "source", headings: str = "headings", text: str = "text") -> Column:
    """Whether a chapter only goes on with the one before: named like its file, or without headings and titled by its own first line."""
    inferred = title_from_text(text)
    by_body = (inferred != "") & (spaced(title) == spaced(inferred))
    bare = F.coalesce(F.size(headings), F.lit(0)) <= 0
    return filename_like(title, source) | (bare & by_body & ~structural_title(title))


def merged_continuations(chapters: DataFrame, keys: list[str], order: str, starts: DataFrame | None = None) -> DataFrame:
    """Continuations joined with the chapter they go on from: islands over the book's order.

    Keys and ``order`` name a chapter; ``starts`` (keys, source) lists files that begin a chapter whatever they look like."""
    df = chapters
    if starts is not None:
        df = df.join(starts.select(*keys, "source").distinct().withColumn("_start", F.lit(True)), [*keys, "source"], "left")
    else:
        df = df.withColumn("_start", F.lit(None).cast("boolean"))
    opens = F.when(F.coalesce("_start", F.lit(False)), 1).when(continues(), 0).otherwise(1)
    marked = df.withColumn("_c", opens)
    ids = running(marked.select(*keys, order, "_c"), keys, [order], {"_b": F.col("_c")}).select(*keys, order, (F.col("_b") + F.col("_c")).alias("_g"))
    grouped = marked.join(ids, [*keys, order])
    head = F.min(F.struct(order, "title", "href", "source"))
    return grouped.groupBy(*keys, "_g").agg(head.alias("_h"), ordered_text("text", [order]).alias("text"), ordered_headings([order]).alias("headings"), F.count("*").alias("parts")).select(
        *keys, F.col(f"_h.{order}").alias(order), "_h.title", "_h.href", "_h.source", "text", "headings", "parts"
    )


def merged_title_pages(chapters: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A chapter that is its title alone, joined with the next one that has the text; a joined pair takes no third.

    Whether a chapter wants to join looks at itself and the next; in a run of those that want to, every other one does. All of this is
    decided on titles, sizes and first lines; of the texts only those that join are brought together."""
    first = F.coalesce(F.get(lines("text"), 0), F.lit(""))
    narrow = numbered(
        chapters.select(
            *keys, order, spaced("title").alias("_title"), F.coalesce(title_only("title", "text"), F.lit(False)).alias("_bare"), spaced(first).alias("_first"),
            ((F.char_length("text") >= LEAST_TEXT) & (spaced(title_from_text(F.coalesce("text", F.lit("")))) == spaced("title")) & (spaced("title") != "") & (first != "") & ~short_structural(first)).alias("_full"),
        ), keys, [order],
    )
    nxt = narrow.select(*keys, (F.col("_n") - 1).alias("_n"), F.col(order).alias("_next"), F.col("_first").alias("_next_first"), F.col("_full").alias("_next_full"))
    wants = F.coalesce(F.col("_bare") & F.col("_next_full") & (F.col("_title") != F.col("_next_first")), F.lit(False))
    wanting = narrow.join(nxt, [*keys, "_n"], "left").select(*keys, order, "_n", "_next", "_title", "_next_first", wants.alias("_w"))
    runs = running(wanting, keys, [order], {"_run": F.when(F.col("_w"), 0).otherwise(1)})
    heads = runs.groupBy(*keys, "_run").agg(F.min("_n").alias("_head"))
    placed = runs.join(heads, [*keys, "_run"]).withColumn("_joins", F.col("_w") & ((F.col("_n") - F.col("_head")) % 2 == 0))
    joins = written(placed.where("_joins").select(*keys, order, "_next", (F.col("_title") == F.col("_next_first")).alias("_same")), "joins")
    left = joins.select(*keys, F.col(order)).unionByName(joins.select(*keys, F.col("_next").alias(order)))
    none = F.array().cast("array<string>")
    columns = ("title", "href", "source", "text", "headings")
    alone = chapters.join(left, [*keys, order], "left_anti").select(*keys, order, *columns)
    text = F.when(F.col("_same"), F.col("n_text")).otherwise(F.concat(spaced("title"), F.lit("\n\n"), F.col("n_text")))
    both = F.array_distinct(F.concat(F.array("title"), F.coalesce("headings", none), F.coalesce("n_headings", none)))
    body = chapters.select(*keys, F.col(order).alias("_next"), F.col("href").alias("n_href"), F.col("source").alias("n_source"), F.col("text").alias("n_text"), F.col("headings").alias("n_headings"))
    head = chapters.select(*keys, order, "title", "headings").join(joins, [*keys, order])
    pairs = head.join(body, [*keys, "_next"]).select(*keys, order, "title", F.col("n_href").alias("href"), F.col("n_source").alias("source"), text.alias("text"), both.alias("headings"))
    return alone.unionByName(pairs)


def series_groups(spine: DataFrame, keys: list[str], order: str = "spine_pos") -> DataFrame:
    """Islands of consecutive files that are parts of one series, when the contents name one of them only."""
    x = numbered(spine.select(*keys, order, split_series("href").alias("_s"), F.coalesce(F.col("in_toc").cast("int"), F.lit(0)).alias("_named")), keys, [order])
    earlier = x.select(*keys, (F.col("_n") + 1).alias("_n"), F.col("_s").alias("_before"))
    x = x.join(earlier, [*keys, "_n"], "left").withColumn("_new", F.when(F.col("_s").isNotNull() & F.col("_s").eqNullSafe(F.col("_before")), 0).otherwise(1))
    x = running(x.drop("_before"), keys, [order], {"_b": F.col("_new")}).withColumn("series_id", F.col("_b") + F.col("_new"))
    named = x.groupBy(*keys, "series_id").agg(F.sum("_named").alias("_sum"))
    groups = x.join(named, [*keys, "series_id"]).select(*keys, order, "series_id", (F.col("_s").isNotNull() & (F.col("_sum") == 1)).alias("merges"))
    return spine.join(groups, [*keys, order])


def merged_series(chapters: DataFrame, groups: DataFrame, keys: list[str], order: str = "spine_pos") -> DataFrame:
    """Chapters with the texts of their whole series: those of ``groups`` (keys, order, series_id, merges, text) that merge are one chapter at its first file."""
    parts = groups.where("merges").groupBy(*keys, "series_id").agg(F.min(order).alias(order), ordered_text("text", [order]).alias("_text"))
    firsts = groups.where("merges").select(*keys, "series_id", order).join(parts.select(*keys, "series_id", F.col(order).alias("_at")), [*keys, "series_id"])
    out = chapters.join(firsts, [*keys, order], "left").join(parts.select(*keys, "series_id", "_text"), [*keys, "series_id"], "left")
    return out.withColumns({"text": F.coalesce("_text", "text"), order: F.coalesce("_at", order)}).drop("_text", "_at", "series_id")


def chosen_by_coverage(toc_chapters: DataFrame, spine_chapters: DataFrame, keys: list[str], least: float = 0.9) -> DataFrame:
    """For each book its chapters by the contents, or by the spine where the contents hold less than ``least`` of its text."""
    a = toc_chapters.groupBy(*keys).agg(F.sum(F.char_length("text")).alias("toc_chars"))
    b = spine_chapters.groupBy(*keys).agg(F.sum(F.char_length("text")).alias("spine_chars"))
    ratio = F.coalesce("toc_chars", F.lit(0)) / F.col("spine_chars")
    plan = b.join(a, keys, "left").select(*keys, (F.col("spine_chars").isNull() | (F.col("spine_chars") == 0) | (ratio >= least)).alias("by_toc"))
    by_toc = toc_chapters.join(plan.where("by_toc").select(*keys), keys, "left_semi")
    return by_toc.unionByName(spine_chapters.join(plan.where("NOT by_toc").select(*keys), keys, "left_semi"), allowMissingColumns=True)


def with_followers(chapters: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters with the spine items after them up to the next boundary, as long as each only goes on.

    ``spine`` has spine_pos, boundary (a chapter or start begins there), goes_on and text. The range join is a running group id over the spine."""
    stop = ~F.col("boundary") & ~F.coalesce("goes_on", F.lit(False))
    marks = spine.select(*keys, "spine_pos", F.col("boundary").cast("int").alias("_b"), stop.cast("int").alias("_stop"))
    before = running(marks, keys, ["spine_pos"], {"_g0": F.col("_b"), "_s0": F.col("_stop")})
    x = before.select(*keys, "spine_pos", (F.col("_g0") + F.col("_b")).alias("_g"), (F.col("_s0") + F.col("_stop")).alias("_s")).where("_g > 0")
    starts = x.groupBy(*keys, "_g").agg(F.min("spine_pos").alias("_at"), F.min("_s").alias("_least"))
    own = x.join(starts, [*keys, "_g"]).where("_s = _least").select(*keys, "spine_pos", "_at")
    heads = spine.select(*keys, "spine_pos", "text").join(own, [*keys, "spine_pos"]).groupBy(*keys, "_at").agg(ordered_text("text", ["spine_pos"]).alias("_text"), F.count("*").alias("items"))
    out = chapters.join(heads.withColumnRenamed("_at", "spine_pos"), [*keys, "spine_pos"], "left")
    return out.withColumn("text", F.coalesce("_text", "text")).withColumn("items", F.coalesce("items", F.lit(1))).drop("_text")


def chapter_title(*candidates: Column, href: Column, number: Column) -> Column:
    """The first candidate that is a title and not a file's name, else the chapter's number."""
    usable = (F.when(~filename_like(c, href), c) for c in candidates)
    return F.coalesce(*usable, F.concat(F.lit("Chapter "), number.cast("string")))


def reindexed(chapters: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Chapters numbered from 1 in order, which names a chapter; only keys and order are sorted, not the texts."""
    numbers = numbered(chapters.select(*keys, *order), keys, order, "_number").withColumn("_number", F.col("_number").cast("int"))
    return chapters.join(numbers, [*keys, *order]).withColumn("chapter_index", F.col("_number")).drop("_number")


def without_chapter(chapters: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters less those dropped (keys, source_index), numbered anew."""
    return reindexed(chapters.join(dropped.select(*keys, "source_index"), [*keys, "source_index"], "left_anti"), keys, ["source_index"])


def with_restored(chapters: DataFrame, restored: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters with restored ones before the first of the same or a later source, numbered anew."""
    both = chapters.withColumn("_old", F.lit(1)).unionByName(restored.withColumn("_old", F.lit(0)), allowMissingColumns=True)
    return reindexed(both, keys, ["source_index", "_old"]).drop("_old")


def unique_slugs(df: DataFrame, slug: str, order: list[str]) -> DataFrame:
    """Slugs made different: from the second of a kind on with its number; where that is a slug already, after two hyphens, which no slug has.

    ``order`` names a row. Slugs are numbered over range-partitioned shares, since all titles that leave no letter share one."""
    n = numbered(df.select(slug, *order), [slug], order).where("_n > 1")
    made = n.select(F.col(slug).alias("_s"), *order, F.concat(slug, F.lit("-"), F.col("_n").cast("string")).alias("_made"), F.concat(slug, F.lit("--"), F.col("_n").cast("string")).alias("_else"))
    taken = df.select(F.col(slug).alias("_made")).distinct().withColumn("_taken", F.lit(True))
    named = made.join(taken, "_made", "left").select(F.col("_s").alias(slug), *order, F.when(F.col("_taken"), F.col("_else")).otherwise(F.col("_made")).alias("_new"))
    return df.join(named, [slug, *order], "left").withColumn(slug, F.coalesce("_new", slug)).drop("_new")


def cover_choice(images: DataFrame, keys: list[str]) -> DataFrame:
    """One cover a book: named by the package, then as a property, then called so, then the largest; ties by position."""
    called = F.lower(F.concat_ws(" ", "href", "id")).contains("cover")
    rank = F.when(F.col("named"), 0).when(F.array_contains(F.split("properties", " "), "cover-image"), 1).when(called, 2).otherwise(3)
    best = F.min_by(F.struct("id", "href", "media_type", "size"), F.struct(rank, -F.col("size"), F.col("pos")))
    return images.groupBy(*keys).agg(best.alias("cover")).select(*keys, "cover.*")
