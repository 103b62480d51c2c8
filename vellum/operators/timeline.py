"""Chapters in time: prefix sums, what can be merged before the first missing segment, and balanced parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions.text import re
from vellum.operators.running import running


def timeline(df: DataFrame, keys: list[str], order: list[str], duration: str) -> DataFrame:
    """``start_ms`` and ``end_ms`` of each chapter of a book; every chapter lasts at least 1 ms."""
    lasting = F.greatest(F.coalesce(F.col(duration).cast("long"), F.lit(0).cast("long")), F.lit(1).cast("long"))
    placed = running(df, keys, order, {"start_ms": lasting})
    return placed.withColumns({"start_ms": F.col("start_ms").cast("long"), "end_ms": (F.col("start_ms") + lasting).cast("long")})


def metadata_escape(c: Column) -> Column:
    return re(c, r"([\\=;#\n])", r"\\$1")


def metadata_rows(df: DataFrame, keys: list[str], order: list[str], title: str, duration: str) -> DataFrame:
    """The timeline with the metadata entry of each chapter as ``text``; titles are escaped."""
    one = F.concat(
        F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="),
        metadata_escape(F.coalesce(F.col(title), F.lit(""))), F.lit("\n"),
    )
    return timeline(df, keys, order, duration).withColumn("text", one)


def metadata_text(df: DataFrame, keys: list[str], order: list[str], title: str, duration: str, tags: str | None = None) -> DataFrame:
    """The chapter metadata of each book as one text: tags, then the chapters in order; titles are escaped.

    It is one value, so for books below 2 GB of chapter entries; ``metadata_rows`` has no such bound."""
    t = metadata_rows(df, keys, order, title, duration)
    chapters = t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_ms", "text"))).alias("chapters"), *([F.first(tags).alias("tags")] if tags else []))
    head = F.lit(";FFMETADATA1\n")
    if tags:
        lines = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), metadata_escape(e["value"]), F.lit("\n")))
        head = F.concat(head, F.array_join(lines, ""))
    return chapters.select(*keys, F.concat(head, F.array_join(F.transform("chapters", lambda x: x["text"]), "")).alias("metadata"))


def concat_rows(df: DataFrame, keys: list[str], order: list[str], path: str) -> DataFrame:
    """``keys, order, line``: the list of segment files as rows, for books of any size (``writers.lines`` writes them in order)."""
    return df.select(*keys, *order, F.concat(F.lit("file '"), F.col(path), F.lit("'")).alias("line"))


def concat_list(df: DataFrame, keys: list[str], order: list[str], path: str) -> DataFrame:
    """The list of segment files of each part as one text, one line a file in order. It is one value, so for books below 2 GB of lines; ``concat_rows`` has no such bound."""
    lines = F.sort_array(F.collect_list(F.struct(*order, F.concat(F.lit("file '"), F.col(path), F.lit("'\n")).alias("line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("concat"))


def available_prefix(segments: DataFrame, keys: list[str], order: list[str], exists: str = "exists", duration: str = "duration_ms") -> DataFrame:
    """The segments before the first missing one of each book.

    A missing segment that is meant to be silent (a duration of 0 or less) is passed over; any other ends the book."""
    place = F.struct(*order)
    stops = ~F.col(exists) & ~F.coalesce(F.col(duration) <= 0, F.lit(False))
    first = segments.where(stops).groupBy(*keys).agg(F.min(place).alias("_stop"))
    return segments.where(exists).join(first, keys, "left").where(F.col("_stop").isNull() | (place < F.col("_stop"))).drop("_stop")


def chapter_durations(segments: DataFrame, keys: list[str], duration: str = "duration_ms") -> DataFrame:
    """Segments and milliseconds of each chapter; a null duration counts as nothing."""
    return segments.groupBy(*keys).agg(F.count("*").alias("segments"), F.sum(F.coalesce(F.col(duration), F.lit(0))).cast("long").alias("duration_ms"))


def split_count(total_ms: Column, hours: float = 10.0) -> Column:
    """Into how many parts a book of this length goes."""
    return F.greatest(F.lit(1), F.ceil(total_ms / F.lit(hours * 3_600_000.0)).cast("int"))


def split_plan(df: DataFrame, keys: list[str], order: list[str], duration: str, parts: Column | int) -> DataFrame:
    """``part`` (from 1) of each chapter: consecutive, near the even share of what is left, the last part taking the rest.

    One pass over the chapters of a book in order, as a fold over an array of its durations (a book's chapters, not its text)."""
    p = F.lit(parts) if isinstance(parts, int) else parts
    rows = F.sort_array(F.collect_list(F.struct(*order, F.coalesce(F.col(duration).cast("long"), F.lit(0).cast("long")).alias("_d"))))
    books = df.groupBy(*keys).agg(rows.alias("_rows"), F.greatest(F.lit(1), F.first(p).cast("int")).alias("_parts"))
    n = F.size("_rows")
    total = F.aggregate("_rows", F.lit(0).cast("long"), lambda a, r: a + r["_d"])

    def state(left_ms: Column, left_parts: Column, held: Column, held_ms: Column, seen: Column, out: Column) -> Column:
        return F.struct(left_ms.alias("left_ms"), left_parts.alias("left_parts"), held.alias("held"), held_ms.alias("held_ms"), seen.alias("seen"), out.alias("out"))

    def step(s: Column, r: Column) -> Column:
        chapters = n - s["seen"]
        several = s["left_parts"] > 1
        must = several & (s["held"] > 0) & (chapters == s["left_parts"])
        left_ms = F.when(must, s["left_ms"] - s["held_ms"]).otherwise(s["left_ms"])
        left_parts = F.when(must, s["left_parts"] - 1).otherwise(s["left_parts"])
        held, held_ms = F.when(must, 0).otherwise(s["held"]), F.when(must, F.lit(0).cast("long")).otherwise(s["held_ms"])
        over = several & (held > 0) & (held_ms + r["_d"] > left_ms / left_parts) & (chapters >= left_parts)
        left_ms2 = F.when(over, left_ms - held_ms).otherwise(left_ms)
        left_parts2 = F.when(over, left_parts - 1).otherwise(left_parts)
        closed = F.when(must | over, 1).otherwise(0)
        part = F.coalesce(F.try_element_at(s["out"], F.lit(-1)), F.lit(1)) + closed
        return state(left_ms2, left_parts2, F.when(over, 1).otherwise(held + 1), F.when(over, r["_d"]).otherwise(held_ms + r["_d"]), s["seen"] + 1, F.concat(s["out"], F.array(part)))

    start = state(total, F.col("_parts"), F.lit(0), F.lit(0).cast("long"), F.lit(0), F.array().cast("array<int>"))
    planned = books.select(*keys, "_rows", F.aggregate("_rows", start, step, lambda s: s["out"]).alias("_out"))
    zipped = planned.select(*keys, F.explode(F.arrays_zip("_rows", "_out")).alias("_z"))
    return zipped.select(*keys, *(F.col(f"_z._rows.{o}").alias(o) for o in order), F.col("_z._rows._d").alias(duration), F.col("_z._out").alias("part"))


def part_name(stem: Column, part: Column, total: Column, suffix: str = ".m4b") -> Column:
    """The file of a part: its number as wide as the number of parts, two figures at least."""
    width = F.greatest(F.lit(2), F.length(total.cast("string")))
    return F.concat(stem, F.lit(".part"), F.lpad(part.cast("string"), width, F.lit("0")), F.lit(suffix))
