"""The stages of a book from raw chapters to a merge plan, composed as DataFrame transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.functions import udfs
from vellum.functions.text import href_file
from vellum.operators import chapters, cleaning, headings, lookups, manifest, timeline
from vellum.session import written
from vellum.sources import readers


PAGES = ("application/xhtml+xml", "text/html", "application/xml")


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """EPUB files as raw chapters: (book_id, chapter_index, title, href, source, text, headings, heading_categories), book_id being the file.

    Pages are read once for what they tell of their book (notes, links, heading classes) and once for their text and headings with that
    known. Chapters follow the contents, each with the pages that only go on, unless the contents leave out a tenth of the text; files of one
    series that the contents name once are one chapter; bare titles join the page they stand before."""
    keys = ["book_id"]
    items = written(readers.epub_items(spark, path).withColumnRenamed("path", "book_id"), "items")
    books = readers.epub_books(spark, path).withColumnRenamed("path", "book_id")
    raw = items.where(F.col("spine_pos").isNotNull() & F.col("content").isNotNull() & F.col("media_type").isin(*PAGES)).select("book_id", "spine_pos", "id", "href", "content")
    facts = written(raw.select("book_id", "spine_pos", "href", udfs.page_facts("content").alias("f")).select("book_id", "spine_pos", "href", "f.*"), "facts")

    sheets = items.where("media_type = 'text/css' AND content IS NOT NULL").select("book_id", udfs.style_markers("content").alias("s"))
    styled = reduce(DataFrame.unionByName, (sheets.select("book_id", F.lit(c).alias("kind"), F.explode(f"s.{c}").alias("name")) for c in ("classes", "ids")))
    used = headings.heading_classes(facts.select("book_id", F.explode("hits").alias("h")).select("book_id", "h.class", "h.uses", "h.hits")).select("book_id", F.lit("classes").alias("kind"), F.col("class").alias("name"))
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))).alias(kind)
    marks = styled.unionByName(used).groupBy("book_id").agg(of("classes"), of("ids"))  # names of a book's style sheets
    told = raw.join(lookups.note_index(facts), "book_id", "left").join(marks, "book_id", "left")
    pages = written(
        told.select("book_id", "spine_pos", "id", "href", udfs.page_text("content", "note_ids", "note_targets").alias("text"), udfs.page_headings("content", "classes", "ids").alias("marked"))
        .join(facts.select("book_id", "spine_pos", "title"), ["book_id", "spine_pos"]), "pages",
    )

    toc = books.select("book_id", F.explode("contents").alias("c")).select("book_id", "c.pos", "c.title", "c.href")
    placed = lookups.toc_spine(toc, pages.select("book_id", "spine_pos", "href", "id")).select("book_id", "spine_pos", F.col("title").alias("toc_title"))
    links = facts.select("book_id", F.col("spine_pos").alias("page"), "href", F.posexplode("links").alias("pos", "l")).select("book_id", "page", "pos", udfs.resolved_href("href", "l.href").alias("target"), F.col("l.label").alias("label"))
    sized = pages.select("book_id", "spine_pos", "href", F.char_length("text").alias("text_chars"))
    overrides = lookups.title_overrides(toc.withColumn("href", href_file("href")), links, sized).select("book_id", "spine_pos", F.col("title").alias("given"))

    lines = F.transform("marked", lambda h: h["text"])
    named = pages.join(placed, ["book_id", "spine_pos"], "left").join(overrides, ["book_id", "spine_pos"], "left")
    title = chapters.chapter_title(F.col("toc_title"), F.col("given"), F.get(lines, 0), F.col("title"), href=F.col("href"), number=F.col("spine_pos") + 1)
    spine = named.select("book_id", "spine_pos", "href", F.col("href").alias("source"), title.alias("title"), lines.alias("headings"), "text", F.col("toc_title").isNotNull().alias("in_toc"))
    spine = written(spine.withColumn("goes_on", chapters.continues() | (F.size("headings") == 0)), "spine")

    groups = chapters.series_groups(spine.select("book_id", "spine_pos", "href", "in_toc"), keys).select("book_id", "spine_pos", "series_id", "merges")
    series = spine.join(groups, ["book_id", "spine_pos"]).select("book_id", "spine_pos", "series_id", "merges", "text")
    columns = ("book_id", "spine_pos", "title", "href", "source", "headings", "text")
    by_toc = spine.where("in_toc").select(*columns)
    within = series.where("merges").select("book_id", "spine_pos", F.lit(True).alias("_series"))
    followed = spine.join(within, ["book_id", "spine_pos"], "left").select("book_id", "spine_pos", (F.col("in_toc") | F.coalesce("_series", F.lit(False))).alias("boundary"), "goes_on", "text")
    by_toc = chapters.merged_series(chapters.with_followers(by_toc, followed, keys).drop("items"), series, keys).select(*columns)
    by_spine = chapters.merged_continuations(spine.select(*columns), keys, "spine_pos").select(*columns)
    chosen = written(chapters.chosen_by_coverage(by_toc, by_spine, keys).where("text <> ''"), "chosen")
    merged = chapters.merged_title_pages(chosen, keys, "spine_pos")

    found = pages.select("book_id", F.explode("marked").alias("h")).select("book_id", F.col("h.text").alias("heading"), F.col("h.category").alias("category")).groupBy("book_id", "heading").agg(F.max("category").alias("category"))
    known = merged.select("book_id", "spine_pos", F.explode("headings").alias("heading")).distinct().join(found, ["book_id", "heading"])
    categories = known.groupBy("book_id", "spine_pos").agg(F.map_from_entries(F.collect_list(F.struct("heading", "category"))).alias("heading_categories"))
    return chapters.reindexed(merged.join(categories, ["book_id", "spine_pos"], "left"), keys, ["spine_pos"]).select("book_id", "chapter_index", "title", "href", "source", "text", "headings", "heading_categories")


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """Books from files by their suffix: EPUB files by ``ingested``, text files as a chapter each; any other suffix is an error."""
    suffix = path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()
    if suffix == "epub":
        return ingested(spark, path)
    if suffix != "txt":
        raise ValueError(f"neither an EPUB nor a text file: {path}")
    none = F.array().cast("array<string>")
    return readers.texts(spark, path).select(
        F.col("path").alias("book_id"), F.lit(1).alias("chapter_index"), F.col("title"), F.col("path").alias("href"), F.col("path").alias("source"), "text", none.alias("headings"), F.create_map().cast("map<string,string>").alias("heading_categories")
    )


def latest_delivery(raw: DataFrame) -> DataFrame:
    """One row a chapter: the delivery created last, of equals the greatest row id."""
    last = F.max_by("row_id", F.struct(F.col("created_unix").isNotNull(), "created_unix", "row_id"))
    return raw.join(raw.groupBy("book_id", "chapter_index").agg(last.alias("row_id")).select("row_id"), "row_id", "left_semi")


def sanitized(raw: DataFrame, books: DataFrame, rules: cleaning.Rules | None = None) -> DataFrame:
    """Clean chapters numbered anew, with the raw chapter each comes from."""
    # written once: its order and its texts are read apart
    cleaned = written(cleaning.cleaned_chapters(latest_delivery(raw), books, rules).where("NOT dropped AND text IS NOT NULL AND trim(text) <> ''"), "clean")
    return chapters.reindexed(cleaned.withColumnRenamed("chapter_index", "source_index"), ["book_id"], ["source_index", "row_id"])


def chunk_table(clean: DataFrame, most: int = manifest.MOST, least: int = manifest.LEAST) -> DataFrame:
    """The chunks of clean chapters with their pauses, chapter boundaries included."""
    built = manifest.built(clean.withColumn("path", F.lit(None).cast("string")), most, least)
    return manifest.with_chapter_pauses(manifest.exploded(built, "book_id", "chapter_index", "chapter_id", "title", "text_sha256"), ["book_id"], "chapter_index")


def merge_plan(segments: DataFrame, hours: float = 10.0) -> DataFrame:
    """Parts of each book from its segments (book_id, chapter_index, chunk_idx, exists, duration_ms)."""
    prefix = timeline.available_prefix(segments, ["book_id"], ["chapter_index", "chunk_idx"])
    per_chapter = timeline.chapter_durations(prefix, ["book_id", "chapter_index"])
    totals = per_chapter.groupBy("book_id").agg(F.sum("duration_ms").alias("total_ms"))
    sized = per_chapter.join(totals.where("total_ms > 0").select("book_id", timeline.split_count(F.col("total_ms"), hours).alias("parts")), "book_id")
    return timeline.split_plan(sized, ["book_id"], ["chapter_index"], "duration_ms", F.col("parts"))
