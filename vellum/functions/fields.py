"""Metadata, enumerations, times, log entries and playback state as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellum.functions.text import C, col, re, strip

# Language names and codes.
LANGUAGES = {
    "chinese": "zh",
    "zh": "zh",
    "mandarin": "zh",
    "japanese": "ja",
    "ja": "ja",
    "english": "en",
    "en": "en",
    "korean": "ko",
    "ko": "ko",
    "french": "fr",
    "fr": "fr",
    "german": "de",
    "de": "de",
    "spanish": "es",
    "es": "es",
}
# Short names of recognition models.
MODELS = {
    "turbo": "mlx-community/whisper-large-v3-turbo",
    "large": "mlx-community/whisper-large-v3-mlx",
    "medium": "mlx-community/whisper-medium-mlx",
    "small": "mlx-community/whisper-small-mlx",
    "base": "mlx-community/whisper-base-mlx",
    "tiny": "mlx-community/whisper-tiny",
}
COVER_TYPES = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif"}


def lookup(c: C, table: dict[str, str]) -> Column:
    """A value's entry in a small table, null where it has none."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[col(c)]


def or_default(c: C, default: C) -> Column:
    """A text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), col(default))


def language(c: C) -> Column:
    """The code of a language by name or code in any case; others in small letters; blank as null."""
    x = F.nullif(F.lower(strip(c)), F.lit(""))
    return F.coalesce(lookup(x, LANGUAGES), x)


def model(c: C) -> Column:
    """The full name of a model; unknown names stay, blank is the default."""
    x = F.coalesce(strip(c), F.lit(""))
    return F.when(x == "", MODELS["turbo"]).otherwise(F.coalesce(lookup(F.lower(x), MODELS), x))


def gender(c: C) -> Column:
    """female or male in any case, else null."""
    x = F.lower(strip(c))
    return F.when(x.isin("female", "male"), x)


def voice_name(raw: C, source: C) -> Column:
    """A voice's name: the given one or the source's, without folder and audio suffix."""
    base = strip(re(or_default(raw, source), "^.*/", ""))
    return F.coalesce(F.nullif(strip(re(base, r"(?i)(?<=.)\.(mp3|wav|json)$", "")), F.lit("")), F.lit("voice"))


def voice_value(c: C) -> Column:
    """A voice as chosen: blank and ``default`` are no choice."""
    x = strip(c)
    return F.when((x != "") & (F.lower(x) != "default"), x)


def cover_extension(media_type: C, href: C) -> Column:
    suffix = F.lower(F.regexp_extract(re(F.coalesce(col(href), F.lit("")), "^.*/", ""), r"(?<=.)(\.[^.]+)$", 1))
    return F.coalesce(lookup(F.lower(col(media_type)), COVER_TYPES), F.nullif(suffix, F.lit("")), F.lit(".jpg"))


def authors(c: C) -> Column:
    """Names parted by commas or line ends, blanks off, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "[,\n]+", -1), strip), lambda x: x != "")


def year(dates: C) -> Column:
    """The first year of the twentieth or twenty-first century in a list of dates, else an empty string."""
    found = F.transform(col(dates), lambda d: F.regexp_extract(d, r"((?:19|20)\d{2})", 1))
    return F.coalesce(F.get(F.filter(found, lambda x: x != ""), 0), F.lit(""))


def tags(title: C, names: C, year_: C, lang: C) -> Column:
    """The tags of a recording: blank ones are left out."""
    artist = F.array_join(F.filter(F.transform(F.coalesce(col(names), F.array().cast("array<string>")), strip), lambda x: x != ""), ", ")
    all_tags = F.create_map(*(x for k, v in (("title", title), ("album", title), ("artist", artist), ("album_artist", artist), ("date", year_), ("language", lang)) for x in (F.lit(k), strip(F.coalesce(col(v), F.lit(""))))))
    return F.map_filter(all_tags, lambda _, v: v != "")


def seconds(c: C) -> Column:
    """A time as seconds with three places at most, by seconds, MM:SS or HH:MM:SS; null where it is none."""
    parts = F.split(strip(c), ":")
    n = F.size(parts)
    number = lambda i: F.get(parts, i).try_cast("double")
    ok = F.forall(parts, lambda x: x.rlike(r"^\d+(\.\d+)?$"))
    mmss = F.when((n == 2) & ok & (number(0) < 60) & (number(1) < 60), number(0) * 60 + number(1))
    hhmmss = F.when((n == 3) & ok & (number(1) < 60) & (number(2) < 60), number(0) * 3600 + number(1) * 60 + number(2))
    plain = F.when((n == 1) & (number(0) >= 0), number(0))
    return F.round(F.coalesce(plain, mmss, hhmmss), 3)


def seconds_text(c: C) -> Column:
    """Seconds as text without trailing zeros."""
    x = F.format_string("%.3f", F.round(col(c), 3))
    return re(re(x, "0+$", ""), r"\.$", "")


def timecode_ms(c: C) -> Column:
    """HH:MM:SS.f as milliseconds, 0 where it is none."""
    parts = F.split(strip(c), ":")
    h, m = (F.get(parts, i) for i in (0, 1))
    total = F.when(h.rlike(r"^[+-]?\d+$") & m.rlike(r"^[+-]?\d+$"), h.try_cast("double") * 3600 + m.try_cast("double") * 60 + F.get(parts, 2).try_cast("double"))
    return F.when(F.size(parts) == 3, F.coalesce(F.round(total * 1000).cast("long"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def optional_ms(c: C, most: float) -> Column:
    """Milliseconds within bounds, else null."""
    x = col(c).try_cast("double")
    return F.when((x >= 0) & (x <= most), F.round(x, 3))


def log_entry_valid() -> Column:
    """Whether a boundary log entry has what it needs."""
    return (F.col("from_index") >= 0) & (F.col("to_index") >= 0) & F.col("delta_ms").between(-5000.0, 5000.0)


def log_entry_fields() -> dict[str, Column]:
    """The fields of a boundary log entry within their bounds, with their defaults."""
    rate = F.coalesce(F.nullif(F.col("playback_rate"), F.lit(0.0)), F.lit(1.0))
    return {
        "trigger_kind": or_default("trigger_kind", F.lit("auto")),
        "preloaded": F.coalesce("preloaded", F.lit(False)),
        "chapter_switch": F.coalesce("chapter_switch", F.lit(False)),
        "delta_ms": F.round("delta_ms", 3),
        "pad_ms": F.greatest(F.lit(0), F.coalesce("pad_ms", F.lit(0))),
        "playback_rate": F.round(F.greatest(F.lit(0.25), F.least(F.lit(4.0), rate)), 3),
        "output_latency_ms": optional_ms("output_latency_ms", 5000.0),
        "base_latency_ms": optional_ms("base_latency_ms", 2000.0),
        "audio_context_state": F.nullif(F.substring(strip("audio_context_state"), 1, 32), F.lit("")),
    }


def playback(c: C) -> Column:
    """Playback state: positions that are not negative, else null; bookmarks with an index."""
    x = col(c)
    whole = lambda v: F.when(v >= 0, v)
    return F.struct(
        whole(x["last_played"]).alias("last_played"), whole(x["furthest_played"]).alias("furthest_played"),
        F.filter(F.coalesce(x["bookmarks"], F.array().cast("array<struct<index:int,label:string,created_at:bigint>>")), lambda b: b["index"] >= 0).alias("bookmarks"),
    )


def synth_action(text: C, has_wav: C, ellipsis_run: C, has_voice: C) -> Column:
    """What the speech stage does with a chunk: silence, reuse, empty, no_voice or synth."""
    return (
        F.when(col(ellipsis_run) > 0, "silence")
        .when(col(has_wav), "reuse")
        .when(strip(F.coalesce(col(text), F.lit(""))) == "", "empty")
        .when(~F.coalesce(col(has_voice), F.lit(False)), "no_voice")
        .otherwise("synth")
    )


def job_stage(running: C, exit_code: C, done: C, total: C) -> Column:
    """The stage of a job from its process and progress."""
    return (
        F.when(col(running), "running").when(col(exit_code).isNotNull() & (col(exit_code) != 0), "failed")
        .when((col(total) > 0) & (col(done) >= col(total)), "done").otherwise("idle")
    )
