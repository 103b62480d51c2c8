"""Lookups between tables as joins: first or last row of a key, several keys in turn, and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions.fields import voice_value
from vellum.functions.text import href_file, re
from vellum.operators.running import islands, running


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key: the first in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def first_value(df: DataFrame, keys: list[str], order: Column | str, values: list[str], last: bool = False) -> DataFrame:
    """The same with partial aggregation, for few and small columns: no sort, a hot key is combined before the exchange."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*values), order).alias("_v")).select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values))


def non_empty(c: str) -> Column:
    return F.when(F.size(c) > 0, F.col(c))


def with_raw_headings(clean: DataFrame, raw: DataFrame, order: Column | None = None) -> DataFrame:
    """Clean chapters with headings: their own, else those of their source chapter, else of the raw chapter of the same file.

    Of several raw chapters of one place or file the first in ``order`` (their row numbers where the table has them) counts."""
    name = lambda c: re(c, "^.*/", "")
    own = raw.select("book_id", "chapter_index", "source", "headings", "heading_categories", (F.struct("chapter_index", "source") if order is None else order).alias("_o"))
    by_index = first_value(own, ["book_id", "chapter_index"], "_o", ["headings", "heading_categories"]).select(
        "book_id", F.col("chapter_index").alias("source_index"), F.col("headings").alias("h1"), F.col("heading_categories").alias("c1")
    )
    by_name = first_value(own.withColumn("file", name("source")).where("file <> ''"), ["book_id", "file"], "_o", ["headings", "heading_categories"]).select(
        "book_id", "file", F.col("headings").alias("h2"), F.col("heading_categories").alias("c2")
    )
    joined = clean.withColumn("file", name("path")).join(by_index, ["book_id", "source_index"], "left").join(by_name, ["book_id", "file"], "left")
    return joined.withColumns({
        "headings": F.coalesce(non_empty("headings"), non_empty("h1"), non_empty("h2")),
        "heading_categories": F.coalesce(non_empty("heading_categories"), non_empty("c1"), non_empty("c2")),
    }).drop("h1", "c1", "h2", "c2", "file")


def toc_spine(toc: DataFrame, spine: DataFrame) -> DataFrame:
    """Contents entries with their place in the spine: by file, else by the whole link, else by id; repeated places once, the first entry wins.

    Of several spine items of one file the last counts."""
    files = spine.groupBy("book_id", href_file("href").alias("key")).agg(F.max("spine_pos").alias("p1"))
    ids = spine.groupBy("book_id", F.col("id").alias("key")).agg(F.max("spine_pos").alias("p2"))
    t = toc.withColumns({"file": href_file("href")})
    found = (
        t.join(files.withColumnRenamed("key", "file"), ["book_id", "file"], "left")
        .join(ids.withColumnRenamed("key", "file"), ["book_id", "file"], "left")
        .withColumn("spine_pos", F.coalesce("p1", "p2"))
        .where("spine_pos IS NOT NULL")
    )
    return first_by(found.select("book_id", "pos", "title", "href", "spine_pos"), ["book_id", "spine_pos"], ["pos"])


def title_overrides(toc: DataFrame, links: DataFrame, pages: DataFrame, least_links: int = 3, longest: int = 120) -> DataFrame:
    """``book_id, spine_pos, title``: titles for pages from the contents, from contents pages within the book, and by inheritance.

    (a) the last contents title of a file; (b) labels on pages that link at least ``least_links`` times into the spine, where no usable title is known;
    (c) an empty page with a title passes it on to the next page with text, unless that has one."""
    from vellum.functions.predicates import filename_like, non_content

    a = first_value(toc.where("title IS NOT NULL"), ["book_id", "href"], "pos", ["title"], last=True)
    into = links.join(pages.select("book_id", F.col("href").alias("target")), ["book_id", "target"], "left_semi")
    index_pages = into.groupBy("book_id", "page").agg(F.countDistinct("target").alias("n")).where(F.col("n") >= least_links)
    b = first_value(
        into.join(index_pages.select("book_id", "page"), ["book_id", "page"], "left_semi").where(F.char_length("label").between(1, longest)),
        ["book_id", "target"], F.struct("page", "pos"), ["label"],
    )
    named = pages.join(a, ["book_id", "href"], "left").join(b.select("book_id", F.col("target").alias("href"), "label"), ["book_id", "href"], "left")
    usable = ~filename_like("title", "href") & ~non_content("title")
    own = F.when(F.coalesce(usable, F.lit(False)), F.col("title")).otherwise(F.coalesce("label", "title"))
    titled = named.select("book_id", "spine_pos", "href", own.alias("title"), (F.col("text_chars") > 0).alias("full"))
    # a page with text and the empty pages before it are one group
    group = running(titled, ["book_id"], ["spine_pos"], {"_g": F.col("full").cast("int")})
    passed_on = first_value(group.where("NOT full AND title IS NOT NULL").select("book_id", "_g", "spine_pos", F.col("title").alias("_t")), ["book_id", "_g"], "spine_pos", ["_t"], last=True)
    out = group.join(passed_on, ["book_id", "_g"], "left")
    return out.select("book_id", "spine_pos", "href", F.when(F.col("full"), F.coalesce("title", "_t")).otherwise(F.col("title")).alias("title")).where("title IS NOT NULL")


def note_index(pages: DataFrame) -> DataFrame:
    """The ids of notes and of what note numbers point at, for each book."""
    def all_of(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return pages.groupBy("book_id").agg(all_of("note_ids"), all_of("note_targets"))


def resolved_voice(chapters: DataFrame, overrides: DataFrame, books: DataFrame) -> DataFrame:
    """Each chapter's voice: its own, else the book's default, else the manifest's; blank and ``default`` are no choice."""
    own = overrides.select("book_id", "chapter_id", voice_value("voice").alias("_own"))
    shelf = books.select("book_id", voice_value("default_voice").alias("_default"), voice_value("manifest_voice").alias("_manifest"))
    out = chapters.join(own, ["book_id", "chapter_id"], "left").join(shelf, "book_id", "left")
    return out.withColumn("voice", F.coalesce("_own", "_default", "_manifest", F.lit(""))).drop("_own", "_default", "_manifest")


def stored_overrides(voice_map: Column, default: Column) -> Column:
    """A book's overrides as they are kept: choices that differ from the default."""
    return F.map_filter(F.transform_values(voice_map, lambda _, v: voice_value(v)), lambda _, v: v.isNotNull() & (v != default))


def report_match(entries: DataFrame, report: DataFrame) -> DataFrame:
    """Each entry's row in its book's report: the first whose path ends with the entry's, or is of the same file, or of the same title.

    A path that ends with another has the same file name, so two keys cover all three. The report is reduced to its first row of each
    file and of each title before it is joined, so that a common title is one row."""
    name = lambda c: re(c, "^.*/", "")
    first = lambda key, to, at: report.select("book_id", key.alias(to), "pos").where(F.col(to) != "").groupBy("book_id", to).agg(F.min("pos").alias(at))
    found = entries.withColumn("_file", name("path"))
    found = found.join(first(name("path"), "_file", "_p1"), ["book_id", "_file"], "left").withColumn("_title", F.col("title")).join(first(F.col("title"), "_title", "_p2"), ["book_id", "_title"], "left")
    return found.select(*(entries.columns), F.least("_p1", "_p2").alias("report_pos"))


def found_chapter(chapters: DataFrame, index: int, title: str) -> DataFrame:
    """One chapter a book: by index, else by title, else the first."""
    rank = F.when(F.col("chapter_index") == index, 0).when(F.col("title") == title, 1).otherwise(2)
    return first_by(chapters.withColumn("_rank", rank), ["book_id"], ["_rank", "chapter_index"]).drop("_rank")


def breaks_by_position(chunks: DataFrame, texts: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Whether ``mark`` stands in the gap after each chunk, by the position of the next."""
    w = Window.partitionBy(*keys).orderBy("start")
    joined = chunks.withColumn("_next", F.lead("start").over(w)).join(texts, keys)
    end = F.coalesce("_next", F.char_length("text"))
    return joined.withColumn("section_break", F.instr(F.substring(F.col("text"), F.col("end") + 1, end - F.col("end")), mark) > 0).drop("_next", "text")


def enclosing(spans: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """For each span the longest quote around it, by positions within the same text; null where there is none.

    Quotes nest, as matched marks do: the longest around a span is the outermost, and outermost ones stand one after the other. So one
    sweep over the starts of a text finds for each span the last outermost quote that began before it."""
    by_start = Window.partitionBy(*keys).orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    outer = quotes.select(*keys, "start", "end").distinct().withColumn("_to", F.max("end").over(by_start)).where("_to IS NULL OR end > _to")
    events = outer.select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_k"), F.struct("start", "end").alias("_q"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    own = spans.select(*keys, F.col("start").alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast(events.schema["_q"].dataType).alias("_q"), F.col("start").cast("long"), F.col("end").cast("long")).distinct()
    sweep = Window.partitionBy(*keys).orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.unionByName(own).withColumn("quote", F.last("_q", ignorenulls=True).over(sweep)).where("_k = 1")
    found = swept.select(*keys, "start", "end", F.when(F.col("quote.end") >= F.col("end"), F.col("quote")).alias("quote"))
    return spans.join(found, [*keys, "start", "end"], "left")


def merged_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The union of intervals: empty ones dropped, touching and overlapping ones joined."""
    return islands(df.where(F.col(end) > F.col(start)), keys, start, end)


def highlighted(text: Column, ranges: Column) -> Column:
    """A text with its (merged, ordered) ranges marked, everything else escaped for HTML."""
    def esc(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def step(acc: Column, r: Column) -> Column:
        plain = esc(F.substring(text, acc["at"] + 1, r["start"] - acc["at"]))
        marked = F.concat(F.lit("<mark>"), esc(F.substring(text, r["start"] + 1, r["end"] - r["start"])), F.lit("</mark>"))
        return F.struct(r["end"].cast("int").alias("at"), F.concat(acc["out"], plain, marked).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(ranges, start, step, lambda s: F.concat(s["out"], esc(F.substring(text, s["at"] + 1, F.char_length(text)))))
