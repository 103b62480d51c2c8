"""Queries that compare operators of one row or one book with SQL: predicates, marks, fields, lookups, merges and plans.

The SQL spells the fixed values out again and imports none of the operators' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.functions import audio, fields, predicates, text
from vellum.operators import chapters, cleaning, headings, lookups, manifest, progress, timeline
from vellum.plans import pipeline
from vellum.plans.catalogue import CHAPTER_MS, DOTS, HAN, HOURS, LATEST, NUM, RATE, ROMAN, SEGMENTS, TERMS, UNIT, WS, ZH, query, raw, segments, sql_spaced, sql_strip
from vellum.session import table

CLOSING = "[」』）】\\]〉》”’\"'']"
LINES = "list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda v: " + sql_strip("v") + "), lambda v: v <> '')"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).where("text IS NOT NULL").select("row_id", F.explode(F.split("text", "\n", -1)).alias("line"))


LINE_SQL = "(SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM chapters_raw WHERE text IS NOT NULL)"


# -- predicates ------------------------------------------------------------------------------------------------------


@query(
    f"SELECT row_id, regexp_matches(s, 'title|chapter|section|headline|heading') OR regexp_matches(s, '(^|[-_])(ttl|hd)([-_0-9]|$)') AS heading, regexp_matches(w, '^[0-9]{{1,4}}[A-Za-z]?[.)]?$') AS note "
    f"FROM (SELECT row_id, lower({sql_strip('coalesce(source, chr(32))')}) AS s, regexp_extract({sql_strip('coalesce(title, chr(32))')}, '^\\S+') AS w FROM chapters_raw)"
)
def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a file's name marks a heading, and whether a title's first word is the number of a note."""
    word = F.regexp_extract(text.strip(F.coalesce("title", F.lit(""))), r"^\S+", 0)
    return raw(spark, sf_dir).select("row_id", predicates.heading_marker("source").alias("heading"), predicates.note_marker(word).alias("note"))


@query(
    f"SELECT row_id, count(*) FILTER (regexp_matches(line, '[{ZH}]'))::BIGINT AS chinese, count(*) FILTER (regexp_matches(line, '[{HAN}]'))::BIGINT AS han, count(*) FILTER (regexp_matches(line, '[{ZH}\\p{{Nd}}A-Za-z]'))::BIGINT AS content, "
    f"count(*) FILTER (regexp_matches(b, '[。！？?!…]$'))::BIGINT AS ended, count(*) FILTER (regexp_matches(b, '[、，,;；:：—―─━…⋯]$'))::BIGINT AS open, count(*) FILTER (regexp_matches(line, '[\\p{{Ps}}\\p{{Pe}}\\p{{Pi}}\\p{{Pf}}]'))::BIGINT AS bracketed "
    f"FROM (SELECT *, regexp_replace(regexp_replace(line, '{WS}+$', ''), '{CLOSING}+$', '') AS b FROM {LINE_SQL}) GROUP BY row_id"
)
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.count(F.when(c, 1))
    p = predicates
    return lines(spark, sf_dir).groupBy("row_id").agg(
        one(p.has_chinese("line")).alias("chinese"), one(p.has_han("line")).alias("han"), one(p.span_content("line")).alias("content"),
        one(p.ends_sentence("line")).alias("ended"), one(p.ends_open("line")).alias("open"), one(p.bracketed("line")).alias("bracketed"),
    )


@query(
    "WITH x AS (SELECT row_id, regexp_extract(text, '^([^。]*。?)', 1) AS b, text FROM chapters_raw WHERE text IS NOT NULL), g AS (SELECT row_id, b, regexp_extract(substr(text, length(b) + 1), '^[ \\t\\r\\n\\x{3000}]*') AS gap FROM x) "
    f"SELECT row_id, position(chr(10) IN gap) = 0 AND position(chr(57344) IN gap) = 0 AS same_paragraph, position(chr(10) IN gap) > 0 OR position(chr(57344) IN gap) > 0 OR (gap <> '' AND NOT regexp_matches(regexp_replace(regexp_replace(b, '{WS}+$', ''), '{CLOSING}+$', ''), '[。！？?!…]$')) AS hard, "
    "CASE WHEN position(chr(57344) IN gap) > 0 THEN 3 WHEN position(repeat(chr(10), 5) IN gap) > 0 THEN 5 WHEN position(repeat(chr(10), 3) IN gap) > 0 THEN 3 ELSE 1 END AS pause FROM g"
)
def gap_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap after the first sentence of each chapter: whether a chunk may reach over it, and its pause."""
    x = raw(spark, sf_dir).where("text IS NOT NULL").withColumn("b", F.regexp_extract("text", "^([^。]*。?)", 1))
    gap = F.regexp_extract(F.substring(F.col("text"), F.char_length("b") + 1, F.char_length("text")), "^[ \\t\\r\\n\\u3000]*", 0)
    return x.select("row_id", predicates.same_paragraph(gap).alias("same_paragraph"), predicates.hard_boundary(gap, F.col("b")).alias("hard"), text.gap_pause(gap).alias("pause"))


@query(
    f"SELECT book_id, created_unix, CASE WHEN regexp_matches(y, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$') THEN y::DOUBLE END AS as_float, CASE WHEN regexp_matches(y, '^[+-]?[0-9]+$') THEN y::BIGINT END AS as_int FROM (SELECT *, {sql_strip('pub_year')} AS y FROM books)"
)
def validated_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "books").select("book_id", "created_unix", predicates.as_float(text.strip("pub_year")).alias("as_float"), predicates.as_int("pub_year").alias("as_int"))


@query("SELECT row_id, CASE WHEN f <> '' THEN regexp_extract(f, '(?i)^(.*)(_split_|-split-)[0-9]+(\\.[^.]+)$', 1) END AS prefix, nullif(regexp_extract(f, '(?i)^(.*)(_split_|-split-)[0-9]+(\\.[^.]+)$', 3), '') AS ext FROM (SELECT row_id, replace(source, 'part', 'p_split_') AS f FROM chapters_raw WHERE source IS NOT NULL)")
def series_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the chapters as if they were parts of a series."""
    s = predicates.split_series(F.replace("source", F.lit("part"), F.lit("p_split_")))
    return raw(spark, sf_dir).where("source IS NOT NULL").select("row_id", s["prefix"].alias("prefix"), s["ext"].alias("ext"))


FIRST_LINE = "coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda v: " + sql_strip("v") + "), lambda v: v <> '')[1], '')"
#: Over t (title, spaced) and b (title without blanks).
STRUCTURAL = (
    f"(regexp_matches(b, '^(第?[{NUM}]+[{UNIT}]?|[{NUM}]+{DOTS}?|[{ROMAN}]+{DOTS}?|[IVXLCDM]+{DOTS}?)$') AND length(t) BETWEEN 1 AND 40 AND length(b) <= 20 OR lower(t) IN ({TERMS}) OR lower(b) IN ({TERMS}) "
    f"OR length(b) BETWEEN 1 AND 80 AND regexp_matches(b, '^(第?[{NUM}]+[{UNIT}]|[{NUM}]+([{UNIT}]|{DOTS})|[{ROMAN}IVXLCDM]+([{UNIT}]|{DOTS}))'))"
)
#: Whether a chapter goes on with the one before, from c (chapters with null titles, texts and sources as empty).
GOES_ON = (
    f"SELECT *, s = '' OR s = source OR s = name OR lower(s) = lower(stem) OR regexp_matches(lower(s), '\\.x?html$|^[a-z][0-9]+[a-z0-9]*$') OR (coalesce(len(headings), 0) = 0 AND i <> '' AND t = {sql_spaced('i')} AND NOT {STRUCTURAL}) AS goes_on FROM ("
    f"SELECT *, {sql_spaced('title')} AS t, regexp_replace(title, '{WS}', '', 'g') AS b, {sql_strip('title')} AS s, regexp_replace(source, '^.*/', '') AS name, regexp_replace(regexp_replace(source, '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS stem, "
    f"CASE WHEN length(l) > 40 THEN regexp_replace(substr(l, 1, 40), '{WS}+$', '') || '...' ELSE l END AS i FROM (SELECT * REPLACE (coalesce(title, '') AS title, coalesce(text, '') AS text, coalesce(source, '') AS source), {FIRST_LINE.replace('(text,', '(coalesce(text, chr(32)),')} AS l FROM c))"
)


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.latest_delivery(raw(spark, sf_dir)).withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "text", "source")})


@query(f"WITH c AS {LATEST} SELECT row_id, goes_on FROM ({GOES_ON})")
def continuation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full(spark, sf_dir).select("row_id", chapters.continues().alias("goes_on"))


@query(
    f"WITH c AS {LATEST}, g AS ({GOES_ON}), n AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY chapter_index ROWS UNBOUNDED PRECEDING) AS part FROM g) "
    "SELECT book_id, min(chapter_index)::INTEGER AS chapter_index, arg_min(title, chapter_index) AS title, (coalesce(sum(length(text)) FILTER (text <> ''), 0) + 2 * greatest(0, count(*) FILTER (text <> '') - 1))::INTEGER AS chars, count(*)::BIGINT AS parts FROM n GROUP BY book_id, part"
)
def merged_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.merged_continuations(full(spark, sf_dir), ["book_id"], "chapter_index").select("book_id", "chapter_index", "title", F.char_length("text").alias("chars"), "parts")


_L1 = f"coalesce({LINES}[1], '')"


@query(
    f"WITH c AS {LATEST}, x AS (SELECT book_id, chapter_index, title AS full_title, {sql_spaced('title')} AS t, text, {_L1} AS f, len({LINES}) AS k, {FIRST_LINE} AS l FROM (SELECT * REPLACE (coalesce(title, '') AS title, coalesce(text, '') AS text) FROM c)), "
    f"y AS (SELECT *, {sql_spaced('f')} AS fs, regexp_replace(f, '{WS}', '', 'g') AS b, {sql_spaced('f')} AS ft, CASE WHEN length(l) > 40 THEN regexp_replace(substr(l, 1, 40), '{WS}+$', '') || '...' ELSE l END AS i FROM x), "
    f"s AS (SELECT *, k = 1 AND length(f) <= 80 AND fs = t AS bare, length(text) >= 400 AND i <> '' AND t = {sql_spaced('i')} AND f <> '' AND NOT (regexp_matches(b, '^(第?[{NUM}]+[{UNIT}]?|[{NUM}]+{DOTS}?|[{ROMAN}]+{DOTS}?|[IVXLCDM]+{DOTS}?)$') AND length(ft) BETWEEN 1 AND 40 AND length(b) <= 20) AS body FROM y), "
    "w AS (SELECT *, row_number() OVER b AS n, coalesce(bare AND lead(body) OVER b AND t <> lead(fs) OVER b, false) AS wants, lead(text) OVER b AS nt, lead(fs) OVER b AS nf FROM s WINDOW b AS (PARTITION BY book_id ORDER BY chapter_index)), "
    "r AS (SELECT *, n - row_number() OVER (PARTITION BY book_id, wants ORDER BY n) AS run FROM w), p AS (SELECT *, wants AND (row_number() OVER (PARTITION BY book_id, wants, run ORDER BY n)) % 2 = 1 AS joins FROM r), "
    "q AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY book_id ORDER BY n), false) AS taken FROM p) SELECT book_id, chapter_index, full_title AS title, CASE WHEN NOT joins THEN length(text) WHEN nf = t THEN length(nt) ELSE length(t) + 2 + length(nt) END::INTEGER AS chars FROM q WHERE NOT taken"
)
def merged_title_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.merged_title_pages(full(spark, sf_dir), ["book_id"], "chapter_index").select("book_id", "chapter_index", "title", F.char_length("text").alias("chars"))


# -- marks and texts of chunks -----------------------------------------------------------------------------------------


@query(
    "SELECT row_id, regexp_replace(simplified, '\\p{Cf}', '', 'g') AS plain, length(regexp_replace(simplified, '" + WS + "', '', 'g'))::INTEGER AS compact, CASE WHEN n > 0 THEN least(1200, 380 + 120 * (n - 1)) ELSE 0 END::INTEGER AS pause "
    "FROM (SELECT *, CASE WHEN regexp_matches(q, '^[…⋯]+$') THEN length(q) ELSE 0 END AS n FROM (SELECT row_id, simplified, regexp_replace(regexp_replace(simplified, '" + WS + "', '', 'g'), '[\"“”「」『』《》]', '', 'g') AS q FROM tts_pipeline WHERE simplified IS NOT NULL))"
)
def chunk_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "tts_pipeline").where("simplified IS NOT NULL")
    return x.select("row_id", text.without_format("simplified").alias("plain"), F.char_length(text.compact("simplified")).alias("compact"), text.ellipsis_pause(text.ellipsis_run("simplified")).alias("pause"))


@query(
    f"WITH l AS (SELECT row_id, i, line, regexp_replace(line, '{WS}+$', '') AS b FROM (SELECT row_id, unnest(string_split(prepared, chr(10))) AS line, generate_subscripts(string_split(prepared, chr(10)), 1) AS i FROM tts_pipeline WHERE prepared IS NOT NULL AND regexp_matches(prepared, '[{ZH}]'))), "
    "m AS (SELECT row_id, i, CASE WHEN b <> '' AND NOT regexp_matches(b, '·$') AND NOT regexp_matches(b, '[。！？?!…、，,;；:：]$') AND NOT regexp_matches(b, '[。！？?!…、，,;；:：]" + CLOSING + "+$') THEN b || '。' || substr(line, length(b) + 1) ELSE line END AS x FROM l) "
    f"SELECT row_id, string_agg(x, chr(10) ORDER BY i) AS marked FROM m GROUP BY row_id UNION ALL SELECT row_id, prepared FROM tts_pipeline WHERE prepared IS NOT NULL AND NOT regexp_matches(prepared, '[{ZH}]')"
)
def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tts_pipeline").where("prepared IS NOT NULL").select("row_id", text.marked_lines("prepared").alias("marked"))


#: Blanks between two Chinese characters, one after the other, since a pattern cannot look around here.
@query(
    f"WITH RECURSIVE x AS (SELECT row_id, simplified AS t, 0 AS n FROM tts_pipeline WHERE simplified IS NOT NULL UNION ALL SELECT row_id, regexp_replace(regexp_replace(t, '([{ZH}])[ \\x{{3000}}]{{2,}}([{ZH}])', '\\1。\\2', 'g'), '([{ZH}])[ \\x{{3000}}]([{ZH}])', '\\1、\\2', 'g'), n + 1 FROM x WHERE n < 2) "
    "SELECT row_id, regexp_replace(t, '[ \\x{3000}]+', ' ', 'g') AS paused FROM x WHERE n = 2"
)
def paused_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tts_pipeline").where("simplified IS NOT NULL").select("row_id", text.spaces_to_pauses("simplified").alias("paused"))


@query(
    "WITH x AS (SELECT chapter_id, book_id, chunk_idx, max(chunk_idx) OVER (PARTITION BY book_id, chapter_id) AS last, max(chapter_id) OVER (PARTITION BY book_id) AS ending FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, chunk_idx ORDER BY row_id) AS r FROM tts_pipeline) WHERE r = 1)) "
    "SELECT book_id, chapter_id, chunk_idx, CASE WHEN chunk_idx = last AND chapter_id <> ending THEN 5 ELSE 1 END AS pause_multiplier FROM x"
)
def chapter_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = segments(spark, sf_dir).select("book_id", "chapter_id", "chunk_idx", F.lit(1).alias("pause_multiplier"))
    return manifest.with_chapter_pauses(chunks, ["book_id"], "chapter_id")


@query(
    "WITH c AS (SELECT chapter_id, list(chunk_idx - 2 ORDER BY row_id) AS p, count(*) AS n FROM tts_pipeline GROUP BY chapter_id) SELECT chapter_id, array_to_string(list_transform(p, lambda x: CASE WHEN x >= 0 THEN x ELSE 1 END), ',') AS kept, array_to_string(list_transform(range(n), lambda i: CASE WHEN p[i + 1] = 0 THEN 3 ELSE 1 END), ',') AS legacy FROM c"
)
def pause_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pauses mended by chapter (a chunk's number less two stands for a pause), and those of old manifests, with a break at the second chunk."""
    rows = F.array_sort(F.collect_list(F.struct("row_id", (F.col("chunk_idx") - 2).alias("p"))))
    c = table(spark, sf_dir, "tts_pipeline").groupBy("chapter_id").agg(F.transform(rows, lambda r: r["p"]).alias("p"), F.count("*").cast("int").alias("n"))
    text_of = lambda x: F.array_join(x.cast("array<string>"), ",")
    none = F.array().cast("array<int>")
    return c.select("chapter_id", text_of(manifest.checked_pauses(F.col("p"), F.col("n"), none)).alias("kept"), text_of(manifest.legacy_pauses(F.transform("p", lambda x: x == 0), F.col("n"))).alias("legacy"))


# -- fields --------------------------------------------------------------------------------------------------------------


@query(
    "WITH x AS (SELECT row_id, (row_id * 7) % 60 AS s, (row_id * 13) % 75 AS m, row_id % 30 AS h FROM toc_entries), t AS (SELECT row_id, CASE row_id % 4 WHEN 0 THEN h || ':' || m || ':' || s || '.25' WHEN 1 THEN m || ':' || s WHEN 2 THEN s || '.5' ELSE 'x:' || s END AS v, h, m, s FROM x) "
    "SELECT row_id, CASE row_id % 4 WHEN 0 THEN CASE WHEN m < 60 THEN h * 3600 + m * 60 + s + 0.25 END WHEN 1 THEN CASE WHEN m < 60 THEN m * 60 + s END WHEN 2 THEN s + 0.5 END::DOUBLE AS seconds, CASE WHEN row_id % 4 = 0 THEN (h * 3600 + m * 60 + s) * 1000 + 250 ELSE 0 END::BIGINT AS ms FROM t"
)
def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in every form, made from row numbers."""
    x = table(spark, sf_dir, "toc_entries").select("row_id", ((F.col("row_id") * 7) % 60).alias("s"), ((F.col("row_id") * 13) % 75).alias("m"), (F.col("row_id") % 30).alias("h"))
    v = F.when(F.col("row_id") % 4 == 0, F.format_string("%d:%d:%d.25", "h", "m", "s")).when(F.col("row_id") % 4 == 1, F.format_string("%d:%d", "m", "s")).when(F.col("row_id") % 4 == 2, F.format_string("%d.5", "s")).otherwise(F.format_string("x:%d", "s"))
    return x.withColumn("v", v).select("row_id", fields.seconds("v").alias("seconds"), fields.timecode_ms("v").alias("ms"))


@query(
    f"SELECT row_id, CASE WHEN b <> '' THEN b ELSE 'voice' END AS name, CASE WHEN v <> '' AND lower(v) <> 'default' THEN v END AS chosen, CASE lower(right(ref_audio, 4)) WHEN '.wav' THEN '.wav' ELSE '.jpg' END AS suffix "
    f"FROM (SELECT *, {sql_strip('voice_name')} AS v, {sql_strip(chr(114) + 'egexp_replace(regexp_replace(coalesce(nullif(ref_audio, chr(0)), voice_name), ' + chr(39) + '^.*/' + chr(39) + ', ' + chr(39) + chr(39) + '), ' + chr(39) + '(?i)[.](mp3|wav|json)$' + chr(39) + ', ' + chr(39) + chr(39) + ')')} AS b FROM voices)"
)
def voice_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "voices").select("row_id", fields.voice_name("ref_audio", "voice_name").alias("name"), fields.voice_value("voice_name").alias("chosen"), fields.cover_extension(F.lit(None).cast("string"), "ref_audio").alias("suffix"))


@query(
    "SELECT book_id, from_index, to_index, captured_unix, CASE WHEN preloaded THEN 'running' WHEN pad_ms IS NOT NULL AND pad_ms <> 0 THEN 'failed' WHEN to_index > 0 AND from_index >= to_index THEN 'done' ELSE 'idle' END AS stage, count(*)::BIGINT AS n FROM boundary_log GROUP BY ALL"
)
def job_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of jobs, entries of the log standing in for them."""
    stage = fields.job_stage("preloaded", "pad_ms", "from_index", "to_index").alias("stage")
    return table(spark, sf_dir, "boundary_log").groupBy("book_id", "from_index", "to_index", "captured_unix", stage).agg(F.count("*").alias("n"))


@query(
    "SELECT book_id, captured_unix, from_index, to_index, CASE WHEN from_index - 3 >= 0 THEN from_index - 3 END AS last_played, CASE WHEN to_index >= 0 THEN to_index END AS furthest_played, (CASE WHEN from_index - 3 >= 0 THEN 1 ELSE 0 END + 1)::INTEGER AS bookmarks, count(*)::BIGINT AS n FROM boundary_log WHERE from_index >= 0 AND to_index >= 0 GROUP BY ALL"
)
def playback_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    mark = lambda i: F.struct(i.cast("int").alias("index"), none.cast("string").alias("label"), none.cast("bigint").alias("created_at"))
    log = table(spark, sf_dir, "boundary_log").where("from_index >= 0 AND to_index >= 0")
    state = F.struct((F.col("from_index") - 3).alias("last_played"), F.col("to_index").alias("furthest_played"), F.array(mark(F.col("from_index") - 3), mark(F.col("to_index"))).alias("bookmarks"))
    p = log.withColumn("p", fields.playback(state))
    return p.groupBy("book_id", "captured_unix", "from_index", "to_index", "p.last_played", "p.furthest_played", F.size("p.bookmarks").alias("bookmarks")).agg(F.count("*").alias("n"))


# -- lookups ----------------------------------------------------------------------------------------------------------------


@query(
    "WITH r AS (SELECT *, regexp_replace(source, '^.*/', '') AS file FROM chapters_raw), i AS (SELECT book_id, chapter_index, arg_min({'h': headings}, row_id) AS x FROM r GROUP BY ALL), f AS (SELECT book_id, file, arg_min({'h': headings}, row_id) AS y FROM r WHERE file <> '' GROUP BY ALL) "
    "SELECT c.row_id, coalesce(CASE WHEN len(c.headings) > 0 THEN c.headings END, CASE WHEN len(i.x.h) > 0 THEN i.x.h END, CASE WHEN len(f.y.h) > 0 THEN f.y.h END)[1] AS heading FROM chapter_inputs c LEFT JOIN i ON c.book_id = i.book_id AND c.chapter_index = i.chapter_index "
    "LEFT JOIN f ON c.book_id = f.book_id AND regexp_replace(c.path, '^.*/', '') = f.file"
)
def raw_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of clean chapters from the raw ones where they have none."""
    clean = table(spark, sf_dir, "chapter_inputs").withColumn("source_index", F.col("chapter_index"))
    out = lookups.with_raw_headings(clean, raw(spark, sf_dir), F.col("row_id"))
    return out.select("row_id", F.get("headings", 0).alias("heading"))


@query(
    "WITH r AS (SELECT book_id, row_id AS pos, title, regexp_replace(source, '^.*/', '') AS file FROM chapters_raw), e AS (SELECT book_id, row_id, title, regexp_replace(regexp_replace(href, '#.*$', ''), '^.*/', '') AS file FROM toc_entries) "
    "SELECT e.row_id, min(r.pos)::BIGINT AS report_pos FROM e LEFT JOIN r ON e.book_id = r.book_id AND ((e.file = r.file AND e.file <> '') OR (e.title = r.title AND e.title <> '')) GROUP BY e.row_id"
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each contents entry's first chapter of the same file or title."""
    entries = table(spark, sf_dir, "toc_entries").select("book_id", F.col("row_id").alias("entry_id"), "title", text.href_file("href").alias("path"))
    report = raw(spark, sf_dir).select("book_id", F.col("row_id").alias("pos"), "title", F.col("source").alias("path"))
    return lookups.report_match(entries, report).select(F.col("entry_id").alias("row_id"), "report_pos")


@query(
    f"WITH c AS {LATEST} SELECT book_id, arg_min(row_id, {{'a': CASE WHEN chapter_index = 3 THEN 0 WHEN title = '序' THEN 1 ELSE 2 END, 'b': chapter_index}}) AS row_id FROM c GROUP BY book_id"
)
def third_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third chapter of each book, else the one titled 序, else the first."""
    return lookups.found_chapter(pipeline.latest_delivery(raw(spark, sf_dir)), 3, "序").select("book_id", "row_id")


@query(
    "WITH t AS (SELECT row_id, prepared AS x FROM tts_pipeline WHERE prepared IS NOT NULL), q AS (SELECT row_id, x, position('“' IN x) AS a, position('”' IN x) AS b FROM t) "
    "SELECT row_id, s AS start, CASE WHEN a > 0 AND b > a AND a - 1 <= s AND s + 2 <= b THEN (a - 1)::INTEGER END AS quote_start FROM (SELECT *, unnest(range(0, 60, 2))::INTEGER AS s FROM q)"
)
def enclosing_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For spans of two characters over the head of each text its first quotation, where that is around them."""
    t = table(spark, sf_dir, "tts_pipeline").where("prepared IS NOT NULL").select("row_id", "prepared")
    a, b = F.instr("prepared", "“"), F.instr("prepared", "”")
    quotes = t.where((a > 0) & (b > a)).select("row_id", (a - 1).alias("start"), b.alias("end"))
    spans = t.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(58), F.lit(2))).alias("start")).withColumn("end", F.col("start") + 2)
    return lookups.enclosing(spans, quotes, ["row_id"]).select("row_id", "start", F.col("quote.start").alias("quote_start"))


@query(
    "WITH b AS (SELECT row_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM chapters_raw WHERE text IS NOT NULL), p AS (SELECT *, (sum(length(l) + 1) OVER (PARTITION BY row_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1)::INTEGER AS e FROM b), "
    "k AS (SELECT row_id, text, e - length(l) AS s, e FROM p WHERE l <> ''), n AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY row_id ORDER BY s), length(text)) AS nx FROM k) SELECT row_id, s::INTEGER AS start, position(repeat(chr(10), 2) IN substr(text, e + 1, nx - e)) > 0 AS section_break FROM n"
)
def breaks_between_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a blank line stands after each line, by positions."""
    t = raw(spark, sf_dir).where("text IS NOT NULL").select("row_id", "text")
    starts = F.transform(F.split("text", "\n", -1), lambda l: F.char_length(l))  # noqa: E741
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = lambda s, n: F.struct((s["at"] + n + 1).alias("at"), F.when(n > 0, F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), (s["at"] + n).alias("end"))))).otherwise(s["out"]).alias("out"))
    chunks = t.select("row_id", F.inline(F.aggregate(starts, zero, step, lambda s: s["out"])))
    return lookups.breaks_by_position(chunks, t, ["row_id"], "\n\n").select("row_id", "start", "section_break")


@query(
    f"WITH b AS (SELECT book_id, arg_max({{'t': title, 'a': authors}}, coalesce(created_unix, 0)) AS m FROM books GROUP BY book_id) SELECT c.row_id, array_to_string(list_filter(list_concat(list_concat([m.t], coalesce(m.a, [])), [c.title]), lambda w: w IS NOT NULL AND trim(w) <> ''), '|') AS words FROM {LATEST} c LEFT JOIN b ON c.book_id = b.book_id"
)
def context_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "books").groupBy("book_id").agg(F.max_by(F.struct(F.col("title").alias("t"), F.col("authors").alias("a")), F.coalesce("created_unix", F.lit(0))).alias("m"))
    x = pipeline.latest_delivery(raw(spark, sf_dir)).join(meta, "book_id", "left")
    return x.select("row_id", F.array_join(cleaning.context_words(F.col("m.t"), F.col("m.a"), F.col("title")), "|").alias("words"))


# -- plans --------------------------------------------------------------------------------------------------------------------


@query(
    "WITH c AS (SELECT book_id, chapter_id, list(prepared ORDER BY chunk_idx) AS p FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, chunk_idx ORDER BY row_id) AS r FROM tts_pipeline) WHERE r = 1) GROUP BY ALL) "
    "SELECT book_id, sum(len(p))::BIGINT AS audio_total, sum(len(list_filter(p, lambda x: x IS NOT NULL)))::BIGINT AS audio_done FROM c GROUP BY book_id"
)
def audio_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each book and those with a duration, from chapters with their arrays."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_idx", "duration_ms")))
    chapters_ = segments(spark, sf_dir).groupBy("book_id", "chapter_id").agg(rows.alias("r"))
    none = F.array().cast("array<string>")
    shaped = chapters_.select("book_id", F.transform("r", lambda r: r["chunk_idx"].cast("string")).alias("chunks"), none.alias("chunk_spans"), F.transform("r", lambda r: r["duration_ms"]).alias("durations_ms"), F.lit(False).alias("has_recording"))
    return progress.audio_totals(shaped, ["book_id"]).select("book_id", "audio_total", "audio_done")


_STEP = (
    "SELECT p.book_id, c.chapter_id, c.d, c.n, CASE WHEN x.over THEN x.lm - x.hm ELSE x.lm END AS left_ms, CASE WHEN x.over THEN x.lp - 1 ELSE x.lp END AS left_parts, CASE WHEN x.over THEN 1 ELSE x.h + 1 END AS held, CASE WHEN x.over THEN c.d ELSE x.hm + c.d END AS held_ms, p.part + x.must::INTEGER + x.over::INTEGER AS part, p.total "
    "FROM plan p JOIN c ON p.book_id = c.book_id AND c.n = p.n + 1, LATERAL (SELECT p.left_parts > 1 AND p.held > 0 AND p.total - p.n = p.left_parts AS must) m, "
    "LATERAL (SELECT m.must AS must, CASE WHEN m.must THEN p.left_ms - p.held_ms ELSE p.left_ms END AS lm, CASE WHEN m.must THEN p.left_parts - 1 ELSE p.left_parts END AS lp, CASE WHEN m.must THEN 0 ELSE p.held END AS h, CASE WHEN m.must THEN 0 ELSE p.held_ms END AS hm) y, "
    "LATERAL (SELECT y.*, p.left_parts > 1 AND y.h > 0 AND y.hm + c.d > y.lm / y.lp AND p.total - p.n >= y.lp AS over) x"
)


@query(
    f"WITH RECURSIVE k AS (SELECT * FROM {CHAPTER_MS}), c AS (SELECT book_id, chapter_id, d, row_number() OVER (PARTITION BY book_id ORDER BY chapter_id) AS n FROM k), b AS (SELECT book_id, sum(d) AS total_ms, count(*) AS total, greatest(1, ceil(sum(d) / ({HOURS}::DOUBLE * 3600000))::INTEGER) AS parts FROM k GROUP BY book_id), "
    "plan AS (SELECT book_id, NULL::VARCHAR AS chapter_id, 0::BIGINT AS d, 0::BIGINT AS n, total_ms::DOUBLE AS left_ms, parts AS left_parts, 0 AS held, 0::BIGINT AS held_ms, 1 AS part, total FROM b UNION ALL " + _STEP + ") SELECT book_id, chapter_id, d AS duration_ms, part FROM plan WHERE n > 0"
)
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = timeline.chapter_durations(segments(spark, sf_dir), ["book_id", "chapter_id"])
    totals = per.groupBy("book_id").agg(F.sum("duration_ms").alias("d")).select("book_id", timeline.split_count(F.col("d"), HOURS).alias("parts"))
    return timeline.split_plan(per.join(totals, "book_id"), ["book_id"], ["chapter_id"], "duration_ms", F.col("parts")).select("book_id", "chapter_id", "duration_ms", "part")


@query(
    f"WITH c AS {LATEST}, g AS (SELECT book_id, min(chapter_index) AS m FROM c GROUP BY book_id), k AS (SELECT c.* FROM c JOIN g ON c.book_id = g.book_id WHERE chapter_index <> m), r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) AS n FROM k) SELECT row_id, n::INTEGER AS chapter_index FROM r"
)
def without_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book without its first chapter, numbered anew."""
    c = pipeline.latest_delivery(raw(spark, sf_dir)).withColumn("source_index", F.col("chapter_index")).drop("chapter_index")
    first = c.groupBy("book_id").agg(F.min("source_index").alias("source_index"))
    return chapters.without_chapter(c, first, ["book_id"]).select("row_id", "chapter_index")


@query(f"WITH c AS {LATEST} SELECT row_id, (row_number() OVER (PARTITION BY book_id ORDER BY chapter_index))::INTEGER AS chapter_index FROM c")
def restored_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book's first chapter taken out and put back."""
    c = pipeline.latest_delivery(raw(spark, sf_dir)).select("book_id", "row_id", F.col("chapter_index").alias("source_index"))
    first = c.groupBy("book_id").agg(F.min("source_index").alias("source_index"))
    gone = c.join(first, ["book_id", "source_index"], "left_semi")
    return chapters.with_restored(c.join(first, ["book_id", "source_index"], "left_anti"), gone, ["book_id"]).select("row_id", "chapter_index")


@query(
    "WITH n AS (SELECT c.row_id, sha256(c.text) AS h FROM chapter_inputs c WHERE c.text IS NOT NULL), m AS (SELECT row_id, sha256(CASE WHEN row_id % 3 = 0 THEN text || ' ' ELSE text END) AS h FROM chapter_inputs WHERE text IS NOT NULL AND row_id % 5 <> 0) SELECT n.row_id FROM n ANTI JOIN m ON n.row_id = m.row_id AND n.h = m.h"
)
def chapters_to_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters whose manifest is missing (every fifth) or of another text (every third)."""
    c = table(spark, sf_dir, "chapter_inputs").where("text IS NOT NULL")
    with_hash = lambda t: c.select("row_id", text.sha256(t).alias("text_sha256"), F.lit(100).alias("max_chars"), F.lit(15).alias("min_chars"))
    stored = with_hash(F.when(F.col("row_id") % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).where("row_id % 5 <> 0")
    return manifest.to_rebuild(with_hash(F.col("text")), stored, ["row_id"]).select("row_id")


@query(f"WITH s AS {SEGMENTS}, f AS (SELECT book_id, min(chapter_id) AS chapter_id FROM s GROUP BY book_id) SELECT s.row_id, NULL::BIGINT AS duration_ms FROM s JOIN f ON s.book_id = f.book_id AND s.chapter_id = f.chapter_id")
def sample_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.reset_sample(segments(spark, sf_dir), ["book_id"], "chapter_id").select("row_id", "duration_ms")


@query(
    f"WITH s AS (SELECT row_id, title, lower(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g')) AS x FROM toc_entries WHERE title IS NOT NULL), u AS (SELECT row_id, CASE WHEN y = '' THEN 'chapter' ELSE y END AS slug FROM (SELECT row_id, left(regexp_replace(x, '^-+|-+$', '', 'g'), 60) AS y FROM s)), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY row_id) AS n FROM u) SELECT n.row_id, CASE WHEN n = 1 THEN n.slug WHEN EXISTS (SELECT 1 FROM u WHERE u.slug = n.slug || '-' || n.n) THEN n.slug || '--' || n.n ELSE n.slug || '-' || n.n END AS slug FROM n"
)
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "toc_entries").where("title IS NOT NULL").select("row_id", text.slug_ascii("title").alias("slug"))
    return chapters.unique_slugs(x, "slug", ["row_id"]).select("row_id", "slug")


@query(
    "WITH x AS (SELECT row_id, book_id, chapter_index, replace(source, 'part', 'p' || (chapter_index // 4) || '_split_') AS href, chapter_index % 4 = 1 AS in_toc FROM " + LATEST + "), s AS (SELECT *, regexp_extract(href, '^(.*)_split_[0-9]+', 1) AS k FROM x), "
    "l AS (SELECT *, CASE WHEN k <> '' AND k = lag(k) OVER (PARTITION BY book_id ORDER BY chapter_index) THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY chapter_index ROWS UNBOUNDED PRECEDING) AS id FROM l) "
    "SELECT row_id, id::BIGINT AS series_id, k <> '' AND sum(in_toc::INTEGER) OVER (PARTITION BY book_id, id) = 1 AS merges FROM g"
)
def series_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as if every four files were a series, of which the contents name one."""
    c = pipeline.latest_delivery(raw(spark, sf_dir)).withColumn("k", F.floor(F.col("chapter_index") / 4).cast("string"))
    x = c.select("row_id", "book_id", F.col("chapter_index").alias("spine_pos"), F.replace(F.col("source"), F.lit("part"), F.concat(F.lit("p"), "k", F.lit("_split_"))).alias("href"), (F.col("chapter_index") % 4 == 1).alias("in_toc"))
    return chapters.series_groups(x, ["book_id"]).select("row_id", F.col("series_id").cast("long").alias("series_id"), "merges")


# -- samples --------------------------------------------------------------------------------------------------------------------


@query(
    "WITH p AS (SELECT vec_id, embedding AS e, least(-18.71 - 20 * log10(greatest(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding)), 1e-12)), -1.5 - 20 * log10(greatest(list_max(list_transform(embedding, lambda v: abs(v::DOUBLE))), 1e-12))) AS g FROM embeddings) "
    "SELECT vec_id, round(g, 6)::DOUBLE AS gain_db, round(CASE WHEN abs(g) >= 0.05 THEN e[1]::DOUBLE * pow(10, g / 20) ELSE e[1]::DOUBLE END, 4)::DOUBLE AS first, greatest(1, round(800 * (vec_id % 50) / 1000.0))::INTEGER * (vec_id % 50 > 0)::INTEGER AS silent FROM p"
)
def gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain of each signal, its first sample after it, and the samples of a silence."""
    e = table(spark, sf_dir, "embeddings").withColumn("g", audio.gain_db(audio.decibels(audio.rms(F.col("embedding"))), audio.peak_db("embedding")))
    quiet = F.size(audio.silence((F.col("vec_id") % 50), F.lit(RATE)))
    return e.select("vec_id", F.round("g", 6).alias("gain_db"), F.round(F.get(audio.with_gain("embedding", F.col("g")), 0).cast("double"), 4).alias("first"), quiet.alias("silent"))


_MIX = "greatest(0, least(255, round(v * 0.6 + 255 * 0.4)))::INTEGER"


@query(f"SELECT vec_id, array_to_string(list_transform([vec_id % 256, (vec_id * 7) % 256, (vec_id * 31) % 256], lambda v: {_MIX}), ',') AS light, coalesce(nullif(label, 0), 24000)::INTEGER AS rate FROM embeddings WHERE label >= 0")
def cover_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cover's lighter colour, and the first sample rate above 0, labels standing in for rates."""
    rgb = F.array(*((F.col("vec_id") * k) % 256 for k in (1, 7, 31)))
    return table(spark, sf_dir, "embeddings").where("label >= 0").select("vec_id", F.array_join(audio.mixed(rgb, 255, 0.4).cast("array<string>"), ",").alias("light"), audio.sample_rate("label").alias("rate"))
