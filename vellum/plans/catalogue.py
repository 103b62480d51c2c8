"""The queries over the Parquet tables of a data folder, and their SQL where SQL can express them.

Every query runs over its whole tables. A sound file, a container or a page is not among the tables; their readers are
tested on files of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.functions import audio, fields, predicates, text, udfs
from vellum.operators import chapters, cleaning, headings, lookups, manifest, progress, stats, timeline
from vellum.plans import pipeline
from vellum.session import spread, table
from vellum.streaming import boundaries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks with their pauses, summed up by document."""
    docs = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"), "doc_id")
    cut = udfs.chapter_chunks()("text", F.array().cast("array<string>"), F.create_map().cast("map<string,string>"))
    chunked = docs.select("doc_id", cut.alias("c")).select("doc_id", F.char_length("c.text").alias("chars"), "c.chunks")
    return chunk_sums(chunked, "doc_id")


def chunk_sums(df: DataFrame, key: str) -> DataFrame:
    sizes = F.transform("chunks", lambda c: c["end"] - c["start"])
    total = lambda f: F.aggregate(F.transform("chunks", f), F.lit(0), lambda a, x: a + x)
    return df.select(
        key, "chars", F.size("chunks").alias("chunks"), F.array_max(sizes).alias("longest"), F.array_min(sizes).alias("shortest"),
        total(lambda c: c["pause"]).alias("pauses"), total(lambda c: c["section_break"].cast("int")).alias("section_breaks"),
    )


# -- the boundary log ------------------------------------------------------------------------------------------------

KEPT = "trigger_kind = 'auto' AND preloaded AND playback_rate BETWEEN 0.95 AND 1.05 AND delta_ms BETWEEN -5000 AND 5000"
LATE = "CASE WHEN output_latency_ms BETWEEN 0 AND 5000 THEN output_latency_ms END"


def _series_sql(v: str) -> str:
    at = lambda q, zero: f"round(CASE WHEN l[CAST(floor((len(l) - 1) * {q}::DOUBLE) AS BIGINT) + 1] = 0 THEN {zero} ELSE l[CAST(floor((len(l) - 1) * {q}::DOUBLE) AS BIGINT) + 1] END, 3)"
    cells = "round(l[1], 3) AS min, " + ", ".join(f"{at(q, 'l[1]' if q <= 0.5 else 'l[len(l)]')} AS {k}" for k, q in stats.QUANTILES.items()) + ", round(l[len(l)], 3) AS max, round(list_sum(l) / len(l), 3) AS mean"
    return f"SELECT {{keys}} len(l)::BIGINT AS n, {cells} FROM (SELECT {{keys}} list_sort(list({v})) AS l FROM x WHERE {v} IS NOT NULL {{group}})"


def _report_columns(df: DataFrame, *keys: str) -> DataFrame:
    d, c = "delta_ms", "corrected_delta_ms"
    return df.select(
        *keys, "samples_total", F.col("samples_filtered").cast("long").alias("samples_filtered"), F.col("samples_with_output_latency").cast("long").alias("samples_with_output_latency"),
        "output_latency_coverage", F.array_join(F.col("pad_ms_values").cast("array<string>"), ",").alias("pads"), *(F.col(f"{d}.{k}").alias(f"d_{k}") for k in ("min", *stats.QUANTILES, "max", "mean")),
        *(F.col(f"{c}.{k}").alias(f"c_{k}") for k in stats.QUANTILES), F.col("recommended_pad_adjust_ms").alias("adjust"), "basis",
    )


def _report_sql(keys: str) -> str:
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    d, c = (_series_sql(v).format(keys=k, group=g) for v in ("delta_ms", "corrected_ms"))
    join = lambda t: f"LEFT JOIN {t} ON " + (f"a.{keys} = {t}.{keys}" if keys else "true")
    enough = "coalesce(f.n, 0) >= 200 AND coalesce(f.m, 0) >= 0.8::DOUBLE * coalesce(f.n, 0)"
    return (
        f"WITH x AS (SELECT *, {LATE} AS lat, delta_ms + {LATE} AS corrected_ms FROM boundary_log WHERE {KEPT}), "
        f"a AS (SELECT {k} count(*)::BIGINT AS samples_total FROM boundary_log {g}), "
        f"f AS (SELECT {k} count(*)::BIGINT AS n, count(corrected_ms)::BIGINT AS m, array_to_string(list_sort(list(DISTINCT pad_ms) FILTER (pad_ms IS NOT NULL)), ',') AS pads FROM x {g}), d AS ({d}), c AS ({c}) "
        f"SELECT {'a.' + k if k else ''} samples_total, coalesce(f.n, 0) AS samples_filtered, coalesce(f.m, 0) AS samples_with_output_latency, round(CASE WHEN coalesce(f.n, 0) > 0 THEN f.m::DOUBLE / f.n ELSE 0 END, 4) AS output_latency_coverage, "
        "coalesce(f.pads, '') AS pads, d.min AS d_min, " + ", ".join(f"d.{q} AS d_{q}" for q in stats.QUANTILES) + ", d.max AS d_max, d.mean AS d_mean, " + ", ".join(f"c.{q} AS c_{q}" for q in stats.QUANTILES)
        + f", CASE WHEN {enough} THEN round(c.p50)::INTEGER END AS adjust, CASE WHEN {enough} THEN 'p50(delta_ms + output_latency_ms)' ELSE 'insufficient_data' END AS basis "
        f"FROM a {join('f')} {join('d')} {join('c')}"
    )


@query(_report_sql(""))
def boundary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_columns(stats.boundary_report(table(spark, sf_dir, "boundary_log"), trigger="auto"))


@query(_report_sql("book_id"))
def boundary_report_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_columns(stats.boundary_report(table(spark, sf_dir, "boundary_log"), ["book_id"], trigger="auto"), "book_id")


@query(
    "WITH x AS (SELECT lower(trigger_kind) AS kind, delta_ms FROM boundary_log WHERE delta_ms IS NOT NULL AND trigger_kind IS NOT NULL), y AS (SELECT kind, list_sort(list(delta_ms)) AS l FROM x GROUP BY kind) "
    "SELECT kind, len(l)::BIGINT AS n, l[1] AS min, l[CAST(floor((len(l) - 1) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50, l[CAST(floor((len(l) - 1) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90, l[len(l)] AS max FROM y"
)
def series_by_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "boundary_log").where("trigger_kind IS NOT NULL").withColumn("kind", F.lower("trigger_kind"))
    return stats.exact_percentile(log, ["kind"], "delta_ms", {"p50": 0.5, "p90": 0.9}).select("kind", "n", "min", "p50", "p90", "max")


@query(
    "SELECT book_id, from_index, to_index, coalesce(nullif(trigger_kind, ''), 'auto') AS trigger_kind, coalesce(preloaded, false) AS preloaded, coalesce(chapter_switch, false) AS chapter_switch, round(delta_ms, 3) + 0.0::DOUBLE AS delta_ms, "
    "greatest(0, coalesce(pad_ms, 0)) AS pad_ms, round(greatest(0.25, least(4.0, coalesce(nullif(playback_rate, 0), 1.0))), 3)::DOUBLE AS playback_rate, round(CASE WHEN output_latency_ms BETWEEN 0 AND 5000 THEN output_latency_ms END, 3) AS output_latency_ms, "
    "round(CASE WHEN base_latency_ms BETWEEN 0 AND 2000 THEN base_latency_ms END, 3) AS base_latency_ms, nullif(left(trim(audio_context_state), 32), '') AS audio_context_state FROM boundary_log "
    "WHERE from_index >= 0 AND to_index >= 0 AND delta_ms BETWEEN -5000 AND 5000"
)
def log_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.cleaned(table(spark, sf_dir, "boundary_log")).drop("captured_unix", "logged_unix")


@query("SELECT book_id, count(*)::BIGINT AS entries, (SELECT count(*) FROM (SELECT DISTINCT * FROM boundary_log y) y WHERE y.book_id = x.book_id)::BIGINT AS different FROM boundary_log x GROUP BY book_id")
def log_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "boundary_log")
    return log.groupBy(*log.columns).agg(F.count("*").alias("n")).groupBy("book_id").agg(F.sum("n").alias("entries"), F.count("*").alias("different"))


@query(
    f"WITH x AS (SELECT *, delta_ms + {LATE} AS corrected_ms, {LATE} AS lat FROM boundary_log WHERE {KEPT}) SELECT book_id, (captured_unix // 3600) * 3600 AS start_unix, count(*)::BIGINT AS n, count(lat)::BIGINT AS with_latency, "
    "round(avg(delta_ms), 6) AS mean_delta_ms, round(avg(corrected_ms), 6) AS mean_corrected_ms FROM x WHERE captured_unix IS NOT NULL GROUP BY 1, 2"
)
def boundaries_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "boundary_log").where("captured_unix IS NOT NULL")
    w = boundaries.by_window(log, trigger="auto")
    return w.select("book_id", F.unix_timestamp(F.col("window.start")).alias("start_unix"), "n", "with_latency", F.round("mean_delta_ms", 6).alias("mean_delta_ms"), F.round("mean_corrected_ms", 6).alias("mean_corrected_ms"))


@query(
    "WITH x AS (SELECT book_id, captured_unix AS a, logged_unix AS b FROM boundary_log WHERE logged_unix > captured_unix), y AS (SELECT *, max(b) OVER (PARTITION BY book_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x), "
    "z AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM y) SELECT book_id, min(a)::BIGINT AS start, max(b)::BIGINT AS \"end\" FROM z GROUP BY book_id, g"
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "boundary_log").select("book_id", F.col("captured_unix").alias("start"), F.col("logged_unix").alias("end"))
    return lookups.merged_intervals(log.where("start IS NOT NULL AND end IS NOT NULL"), ["book_id"])


# -- chapters --------------------------------------------------------------------------------------------------------

WS = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{B}]"
HAN = "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}\\x{2CEB0}-\\x{2EBEF}\\x{30000}-\\x{3134F}"
ZH = HAN + "\\x{3005}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_fold(x: str) -> str:
    return f"translate({x}, 'ʼ‘’«»', '''''''\"\"')"


def sql_spaced(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


# The SQL spells out its own values.
DROPPED = "目录 目錄 封面 封底 扉页 扉頁 版权 版權 版权信息 版權資訊 版權信息 版权页 版權頁 作者简介 作者簡介 广告 廣告 内容简介 內容簡介 出版信息 出版資訊".split()
BARE = "'封面','封底','目录','目錄','版权','版權','版权页','版權頁','版权信息','版權資訊','版權信息','扉页','扉頁','contents','toc','cover','copyright'"
NUM, UNIT, ROMAN = "0-9０-９一二三四五六七八九十百千〇零两兩", "章節节話话部卷巻回篇編编集幕讲講", "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ"
TERMS = (
    "'prologue','epilogue','postscript','interlude','preface','afterword','introduction','序','序章','序言','序曲','自序','代序','前言','引言','引子','楔子','导言','導言','导读','導讀',"
    "'尾声','尾聲','终章','終章','结语','結語','结束语','結束語','后记','後記','跋','番外','附录','附錄'"
)

LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY created_unix DESC NULLS LAST, row_id DESC) AS rn FROM chapters_raw) WHERE rn = 1)"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters_raw")


@query("SELECT book_id, chapter_index, row_id FROM " + LATEST)
def latest_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.latest_delivery(raw(spark, sf_dir)).select("book_id", "chapter_index", "row_id")


@query(f"SELECT row_id, {sql_strip(chr(39).join(['regexp_replace(regexp_replace(regexp_replace(' + sql_fold('text') + ', ', chr(92) + 'r' + chr(92) + 'n?', ', chr(10), ', 'g', '), ', '[ ' + chr(92) + 't]+' + chr(92) + 'n', ', chr(10), ', 'g', '), ', '[ ' + chr(92) + 't]{2,}', ', ', ' ', ', ', 'g', ')']))} || chr(10) AS text FROM chapters_raw")
def clean_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(raw(spark, sf_dir).select("row_id", "text"), "row_id").select("row_id", text.clean_read("text").alias("text"))


@query("SELECT row_id, sha256(text) AS text_sha256 FROM chapters_raw")
def text_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("row_id", text.sha256("text").alias("text_sha256"))


def _first_match_sql(c: str, patterns: tuple[str, ...]) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(coalesce({c}, ''), '(?im){p.replace(chr(92) + 's', WS)}') THEN '{p}' END" for p in patterns)
    return f"coalesce({hits}, '')"


@query(f"SELECT row_id, {_first_match_sql('title', tuple(f'^{t}$' for t in DROPPED))} AS drop_reason FROM chapters_raw")
def drop_title_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("row_id", predicates.drop_reason("title").alias("drop_reason"))


#: Rules that meet what the tables hold: a notice line cuts, figures in a catalogue number are removed.
CUT = ("^.*(?:版权|违者必究).*$", "^.*[Rr]ights reserved.*$")
REMOVE = ("No\\. ?[0-9]+", "编号[A-Za-z]+-")


@query(
    f"WITH x AS (SELECT row_id, text, {_first_match_sql('text', CUT)} AS p FROM chapters_raw WHERE text IS NOT NULL) SELECT row_id, p AS cutoff_reason, CASE WHEN p = '' THEN text ELSE "
    + f"regexp_replace(substr(text, 1, position(regexp_extract(text, '(?im)' || p) IN text) - 1), '{WS}+$', '') END AS text FROM x"
)
def section_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, why = cleaning.cut_section(F.col("text"), list(CUT))
    x = spread(raw(spark, sf_dir).where("text IS NOT NULL").select("row_id", "text"), "row_id")
    return x.select("row_id", why.alias("cutoff_reason"), kept.alias("text"))


@query(
    f"WITH x AS (SELECT book_id, text AS t0, regexp_replace(text, '(?im){REMOVE[0]}', '', 'g') AS t1 FROM chapters_raw WHERE text IS NOT NULL), y AS (SELECT book_id, len(regexp_extract_all(t0, '(?im){REMOVE[0]}')) AS a, len(regexp_extract_all(t1, '(?im){REMOVE[1]}')) AS b FROM x) "
    f"SELECT book_id, '{REMOVE[0]}' AS pattern, sum(a)::BIGINT AS matches FROM y GROUP BY book_id HAVING sum(a) > 0 UNION ALL SELECT book_id, '{REMOVE[1]}', sum(b)::BIGINT FROM y GROUP BY book_id HAVING sum(b) > 0"
)
def removal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counts = cleaning.removed_native(F.col("text"), list(REMOVE))
    return cleaning.removal_totals(raw(spark, sf_dir).where("text IS NOT NULL").select("book_id", counts.alias("removed")))


@query(
    f"WITH x AS (SELECT row_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda v: {sql_strip('v')}), lambda v: v <> '')[1], '') AS l FROM chapters_raw WHERE text IS NOT NULL) "
    f"SELECT row_id, CASE WHEN length(l) > 40 THEN regexp_replace(substr(l, 1, 40), '{WS}+$', '') || '...' ELSE l END AS title FROM x"
)
def title_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).where("text IS NOT NULL").select("row_id", text.title_from_text("text").alias("title"))


@query("SELECT row_id, CASE WHEN s = '' THEN 'chapter' ELSE s END AS slug FROM (SELECT row_id, left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS s FROM chapters_raw WHERE title IS NOT NULL)")
def slug_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).where("title IS NOT NULL").select("row_id", text.slug_ascii("title").alias("slug"))


@query("SELECT row_id, regexp_replace(href, '#.*$', '') AS file, regexp_extract(href, '#(.*)$', 1) AS fragment FROM chapters_raw WHERE href IS NOT NULL")
def href_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).where("href IS NOT NULL").select("row_id", text.href_file("href").alias("file"), text.href_fragment("href").alias("fragment"))


@query(
    "SELECT row_id, f.drop OR t = '' OR t IN (" + BARE + ") AS non_content, regexp_matches(b, '^(第?[" + NUM + "]+[" + UNIT + "]?|[" + NUM + "]+[.)．、]?|[" + ROMAN + "]+[.)．、]?|[IVXLCDM]+[.)．、]?)$') AND length(t) BETWEEN 1 AND 40 AND length(b) <= 20 AS short_label "
    f"FROM (SELECT row_id, lower({sql_spaced('coalesce(title, chr(32))')}) AS t, regexp_replace(coalesce(title, ''), '{WS}', '', 'g') AS b, {{'drop': false}} AS f FROM chapters_raw)"
)
def title_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("title", F.lit(""))
    return raw(spark, sf_dir).select("row_id", predicates.non_content("title").alias("non_content"), predicates.short_structural(t).alias("short_label"))


DOTS = "[.)．、]"
STRUCTURAL_SQL = (
    "regexp_matches(b, '^(第?[" + NUM + "]+[" + UNIT + "]?|[" + NUM + "]+" + DOTS + "?|[" + ROMAN + "]+" + DOTS + "?|[IVXLCDM]+" + DOTS + "?)$') AND length(t) BETWEEN 1 AND 40 AND length(b) <= 20 "
    "OR lower(t) IN (" + TERMS + ") OR lower(b) IN (" + TERMS + ") "
    "OR length(b) BETWEEN 1 AND 80 AND regexp_matches(b, '^(第?[" + NUM + "]+[" + UNIT + "]|[" + NUM + "]+([" + UNIT + "]|" + DOTS + ")|[" + ROMAN + "IVXLCDM]+([" + UNIT + "]|" + DOTS + "))')"
)


@query(
    f"WITH x AS (SELECT row_id, {sql_spaced('coalesce(title, chr(32))')} AS t, regexp_replace(coalesce(title, ''), '{WS}', '', 'g') AS b, {sql_strip('coalesce(title, chr(32))')} AS s, coalesce(source, '') AS source, regexp_replace(coalesce(source, ''), '^.*/', '') AS name, "
    f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r]'), lambda v: {sql_strip('v')}), lambda v: v <> '') AS l FROM chapters_raw), y AS (SELECT *, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem FROM x) "
    f"SELECT row_id, {STRUCTURAL_SQL} AS structural, s = '' OR s = source OR s = name OR lower(s) = lower(stem) OR regexp_matches(lower(s), '\\.x?html$|^[a-z][0-9]+[a-z0-9]*$') AS filename, coalesce(len(l) = 1 AND length(l[1]) <= 80 AND {sql_spaced('l[1]')} = t, false) AS title_only FROM y"
)
def structural_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("title", F.lit(""))
    return raw(spark, sf_dir).select("row_id", predicates.structural_title(t).alias("structural"), predicates.filename_like("title", "source").alias("filename"), F.coalesce(predicates.title_only(t, F.coalesce("text", F.lit(""))), F.lit(False)).alias("title_only"))


@query(
    "WITH l AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM chapters_raw WHERE text IS NOT NULL) SELECT row_id, count(*)::BIGINT AS lines, count(*) FILTER (regexp_matches(line, '\\p{Lu}') AND NOT regexp_matches(line, '\\p{Ll}'))::BIGINT AS capitals, "
    f"count(*) FILTER (regexp_matches(line, '^[^\\p{{L}}\\p{{N}}\\p{{M}}\\x{{E000}}]+$') AND regexp_replace(line, '{WS}', '', 'g') <> '')::BIGINT AS symbols FROM l GROUP BY row_id"
)
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw(spark, sf_dir).where("text IS NOT NULL").select("row_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    one = lambda c: F.count(F.when(c, 1))
    return lines.groupBy("row_id").agg(F.count("*").alias("lines"), one(predicates.capitals("line")).alias("capitals"), one(predicates.symbol_line("line")).alias("symbols"))


LOW, UP = "\\p{Ll}ªº\\x{2B0}-\\x{2B8}\\x{2C0}\\x{2C1}\\x{2E0}-\\x{2E4}\\x{2170}-\\x{217F}", "\\p{Lu}\\x{2160}-\\x{216F}"


@query(
    "WITH w AS (SELECT book_id, row_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT book_id, row_id, regexp_extract_all(text, '[\\p{L}\\p{Nl}\\p{No}](?:[\\p{L}\\p{Nl}\\p{No}''’\\-]|\\x{300}-\\x{36F})*') AS ws FROM chapters_raw WHERE text IS NOT NULL)), "
    f"c AS (SELECT book_id, regexp_replace(lower(word), CASE WHEN regexp_matches(word, '\\p{{L}}Σ$') THEN 'σ$' ELSE '^$' END, 'ς') AS key, word, count(*) AS uses, min(row_id * 1000000000 + i) AS first FROM w WHERE regexp_matches(word, '[{LOW}]') GROUP BY ALL), r AS (SELECT *, CASE WHEN regexp_matches(word, '^[{UP}].*[{LOW}]') THEN 3 WHEN NOT regexp_matches(word, '[{UP}\\p{{Lt}}]') THEN 2 ELSE 1 END AS rank FROM c) "
    "SELECT book_id, key, word AS spelling, uses::BIGINT AS uses, rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id, key ORDER BY uses DESC, rank DESC, first) AS n FROM r) WHERE n = 1"
)
def dominant_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading spelling of every word of a book, with the words of every script that has small letters."""
    texts = spread(raw(spark, sf_dir).where("text IS NOT NULL").select("book_id", "row_id", "text"), "row_id")
    return headings.dominant_spelling(headings.words(texts, ["book_id"], "text", "row_id"), ["book_id"])


@query(
    f"WITH x AS (SELECT row_id, list_filter(list_transform(headings, lambda h: {sql_strip('h')}), lambda h: h <> '') AS h FROM chapters_raw WHERE headings IS NOT NULL), y AS (SELECT row_id, unnest(h) AS v, generate_subscripts(h, 1) AS i FROM x), "
    f"z AS (SELECT row_id, v, i, row_number() OVER (PARTITION BY row_id, lower({sql_spaced(sql_fold('v'))}) ORDER BY i) AS n FROM y), g AS (SELECT row_id, string_agg(v, '|' ORDER BY i) AS headings FROM z WHERE n = 1 GROUP BY row_id) SELECT x.row_id, coalesce(g.headings, '') AS headings FROM x LEFT JOIN g ON x.row_id = g.row_id"
)
def distinct_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).where("headings IS NOT NULL").select("row_id", F.array_join(headings.distinct_headings(F.col("headings")), "|").alias("headings"))


@query(
    f"WITH e AS (SELECT book_id, unnest(map_entries(heading_categories)) AS e FROM chapters_raw WHERE heading_categories IS NOT NULL), k AS (SELECT book_id, lower({sql_spaced(sql_fold('e.key'))}) AS heading_key, CASE WHEN lower({sql_strip('coalesce(e.value, chr(32))')}) = 'title' THEN 2 ELSE 1 END AS r FROM e) "
    "SELECT book_id, heading_key, CASE WHEN max(r) = 2 THEN 'title' ELSE 'section' END AS category FROM k WHERE heading_key <> '' GROUP BY book_id, heading_key"
)
def category_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = raw(spark, sf_dir).where("heading_categories IS NOT NULL").select("book_id", F.explode("heading_categories").alias("h", "v"))
    return headings.book_categories(entries.select("book_id", headings.heading_key(F.col("h")).alias("heading_key"), headings.category(F.col("v")).alias("category")), ["book_id"])


@query(
    f"WITH c AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, row_id) AS n FROM {LATEST}) SELECT book_id, row_id, n::INTEGER AS chapter_index FROM c"
)
def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.reindexed(pipeline.latest_delivery(raw(spark, sf_dir)), ["book_id"], ["chapter_index", "row_id"]).select("book_id", "row_id", "chapter_index")


@query(
    f"WITH s AS (SELECT book_id, sum(length(text)) AS n FROM {LATEST} GROUP BY book_id), t AS (SELECT c.book_id, sum(length(c.text)) AS n FROM {LATEST} c SEMI JOIN toc_entries e ON c.book_id = e.book_id AND c.href = e.href GROUP BY c.book_id) "
    "SELECT s.book_id, (s.n IS NULL OR s.n = 0 OR coalesce(t.n, 0)::DOUBLE / s.n >= 0.9::DOUBLE) AS by_toc FROM s LEFT JOIN t ON s.book_id = t.book_id"
)
def coverage_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = pipeline.latest_delivery(raw(spark, sf_dir))
    toc = spine.join(table(spark, sf_dir, "toc_entries").select("book_id", "href").distinct(), ["book_id", "href"], "left_semi")
    chosen = chapters.chosen_by_coverage(toc.withColumn("by_toc", F.lit(True)), spine.withColumn("by_toc", F.lit(False)), ["book_id"])
    return spine.select("book_id").distinct().join(chosen.select("book_id", "by_toc").distinct(), "book_id", "left").select("book_id", F.coalesce("by_toc", F.lit(True)).alias("by_toc"))


@query("SELECT book_id, regexp_replace(href, '#.*$', '') AS file, arg_max(title, row_id) AS title FROM toc_entries WHERE title IS NOT NULL AND href IS NOT NULL GROUP BY ALL")
def last_title_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = table(spark, sf_dir, "toc_entries").where("title IS NOT NULL AND href IS NOT NULL").withColumn("file", text.href_file("href"))
    return lookups.first_value(toc, ["book_id", "file"], "row_id", ["title"], last=True)


@query(
    "WITH s AS (SELECT book_id, source AS file, max(chapter_index) AS spine_pos FROM chapters_raw WHERE source IS NOT NULL GROUP BY ALL), d AS (SELECT book_id, 'c' || chapter_index AS file, max(chapter_index) AS spine_pos FROM chapters_raw WHERE source IS NOT NULL GROUP BY ALL), "
    "t AS (SELECT book_id, pos, row_id, CASE WHEN row_id % 7 = 0 THEN 'c' || pos ELSE regexp_replace(href, '#.*$', '') END AS file FROM toc_entries WHERE href IS NOT NULL) "
    "SELECT book_id, spine_pos, min(pos) AS pos FROM (SELECT t.book_id, t.pos, coalesce(s.spine_pos, d.spine_pos) AS spine_pos FROM t LEFT JOIN s ON t.book_id = s.book_id AND t.file = s.file LEFT JOIN d ON t.book_id = d.book_id AND t.file = d.file) WHERE spine_pos IS NOT NULL GROUP BY ALL"
)
def toc_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents entries in the spine, by file or, where every seventh names an item instead, by its id."""
    spine = raw(spark, sf_dir).where("source IS NOT NULL").select("book_id", F.col("chapter_index").alias("spine_pos"), F.col("source").alias("href"), F.concat(F.lit("c"), "chapter_index").alias("id"))
    href = F.when(F.col("row_id") % 7 == 0, F.concat(F.lit("c"), "pos")).otherwise(F.col("href"))
    toc = table(spark, sf_dir, "toc_entries").where("href IS NOT NULL").select("book_id", "pos", "title", href.alias("href"))
    return lookups.toc_spine(toc, spine).select("book_id", "spine_pos", "pos")


@query()
def sanitize_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = cleaning.Rules(cutoffs=list(CUT), removals=list(REMOVE))
    return cleaning.report(cleaning.cleaned_chapters(pipeline.latest_delivery(raw(spark, sf_dir)), table(spark, sf_dir, "books"), rules))


@query()
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = manifest.built(raw(spark, sf_dir).where("text IS NOT NULL").withColumn("path", F.lit(None).cast("string")))
    return chunk_sums(built.withColumn("chars", F.char_length("text")), "row_id")


@query()
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = pipeline.sanitized(raw(spark, sf_dir), table(spark, sf_dir, "books"))
    return pipeline.chunk_table(clean)


@query()
def repaired_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spread(raw(spark, sf_dir).where("text IS NOT NULL").select("row_id", "text", "title", "headings"), "row_id")
    return x.select("row_id", text.sha256(udfs.repaired_case("text", F.array("title"), F.coalesce("headings", F.array().cast("array<string>")))).alias("sha"))


# -- speech ----------------------------------------------------------------------------------------------------------


@query()
def speech_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = spread(table(spark, sf_dir, "tts_pipeline").where("simplified IS NOT NULL").select("row_id", "simplified"), "row_id")
    return chunks.select("row_id", udfs.speech_pipeline(udfs.hanzi_table(spark))("simplified").alias("p")).select("row_id", "p.*")


@query(
    "SELECT row_id, CASE WHEN regexp_matches(b, '^[…⋯]+$') THEN length(b) ELSE 0 END AS run FROM (SELECT row_id, regexp_replace(regexp_replace(prepared, '" + WS + "', '', 'g'), '[「『《〈【〔［｢〝」』》〉】〕］｣〞〟\"“”«»„‟❝❞＂''‘’‚‛＇]', '', 'g') AS b FROM tts_pipeline WHERE prepared IS NOT NULL)"
)
def ellipsis_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tts_pipeline").where("prepared IS NOT NULL").select("row_id", text.ellipsis_run("prepared").cast("long").alias("run"))


@query(
    "SELECT row_id, regexp_replace(regexp_replace(simplified, '[‐‑‒–—―─━]{2,}', ' ', 'g'), '[…⋯]{3,}', '⋯', 'g') AS dashes, regexp_replace(simplified, '[\"“”«»„‟❝❞＂]', '', 'g') AS unquoted FROM tts_pipeline WHERE simplified IS NOT NULL"
)
def marks_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "tts_pipeline").where("simplified IS NOT NULL")
    return x.select("row_id", text.ellipsis_fold(text.dash_runs("simplified")).alias("dashes"), text.without_double_quotes("simplified").alias("unquoted"))


@query(
    "WITH l AS (SELECT row_id, unnest(string_split(prepared, chr(10))) AS line FROM tts_pipeline WHERE prepared IS NOT NULL) SELECT row_id, count(*) FILTER (b <> '' AND NOT regexp_matches(b, '·$') AND NOT regexp_matches(b, '[。！？?!…、，,;；:：]$') AND NOT regexp_matches(b, '[。！？?!…、，,;；:：][」』）】\\]〉》”’\"'']+$'))::BIGINT AS open_lines "
    f"FROM (SELECT row_id, regexp_replace(line, '{WS}+$', '') AS b FROM l) GROUP BY row_id"
)
def open_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "tts_pipeline").where("prepared IS NOT NULL").select("row_id", F.explode(F.split("prepared", "\n", -1)).alias("line"))
    return lines.groupBy("row_id").agg(F.count(F.when(text.wants_mark(text.rstrip("line")), 1)).alias("open_lines"))


#: Chunks stand in for segments: a segment lasts 180 ms a character; null prepared text is a segment that is missing, empty text is silence.
SEGMENTS = "(SELECT book_id, chapter_id, chunk_idx, row_id, prepared IS NOT NULL AND prepared <> '' AS ok, CASE WHEN prepared IS NOT NULL THEN 180 * length(prepared) END AS duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, chunk_idx ORDER BY row_id) AS rn FROM tts_pipeline) WHERE rn = 1)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = lookups.first_by(table(spark, sf_dir, "tts_pipeline"), ["chapter_id", "chunk_idx"], ["row_id"])
    ok = F.col("prepared").isNotNull() & (F.col("prepared") != "")
    return chunks.select("book_id", "chapter_id", "chunk_idx", "row_id", ok.alias("exists"), (180 * F.char_length("prepared")).cast("long").alias("duration_ms"))


@query(f"SELECT book_id, chapter_id, count(*)::BIGINT AS segments, sum(coalesce(duration_ms, 0))::BIGINT AS duration_ms FROM {SEGMENTS} GROUP BY ALL")
def chapter_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.chapter_durations(segments(spark, sf_dir), ["book_id", "chapter_id"])


CHAPTER_MS = f"(SELECT book_id, chapter_id, sum(coalesce(duration_ms, 0))::BIGINT AS d FROM {SEGMENTS} GROUP BY ALL)"


@query(f"SELECT book_id, chapter_id, (e - greatest(d, 1))::BIGINT AS start_ms, e AS end_ms FROM (SELECT *, (sum(greatest(d, 1)) OVER (PARTITION BY book_id ORDER BY chapter_id ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM {CHAPTER_MS})")
def chapter_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = timeline.chapter_durations(segments(spark, sf_dir), ["book_id", "chapter_id"])
    return timeline.timeline(per, ["book_id"], ["chapter_id"], "duration_ms").select("book_id", "chapter_id", "start_ms", "end_ms")


@query(
    f"WITH x AS (SELECT *, sum(CASE WHEN NOT ok AND NOT coalesce(duration_ms <= 0, false) THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY chapter_id, chunk_idx ROWS UNBOUNDED PRECEDING) AS stops FROM {SEGMENTS}) SELECT book_id, chapter_id, chunk_idx FROM x WHERE stops = 0 AND ok"
)
def prefix_until_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.available_prefix(segments(spark, sf_dir), ["book_id"], ["chapter_id", "chunk_idx"]).select("book_id", "chapter_id", "chunk_idx")


HOURS = 0.02


@query(f"SELECT book_id, greatest(1, ceil(sum(d) / ({HOURS}::DOUBLE * 3600000))::INTEGER) AS parts FROM {CHAPTER_MS} GROUP BY book_id")
def auto_split_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = segments(spark, sf_dir).groupBy("book_id").agg(F.sum(F.coalesce("duration_ms", F.lit(0))).alias("d"))
    return totals.select("book_id", timeline.split_count(F.col("d"), HOURS).alias("parts"))


@query(
    f"WITH c AS (SELECT book_id, chapter_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_id) AS n, greatest(d, 1) AS d FROM {CHAPTER_MS}), e AS (SELECT *, sum(d) OVER (PARTITION BY book_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS e FROM c) "
    "SELECT book_id, ';FFMETADATA1' || chr(10) || string_agg(chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (e - d)::BIGINT || chr(10) || 'END=' || e::BIGINT || chr(10) || 'title=' || chapter_id || chr(10), '' ORDER BY n) AS metadata FROM e GROUP BY book_id"
)
def chapter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = timeline.chapter_durations(segments(spark, sf_dir), ["book_id", "chapter_id"])
    return timeline.metadata_text(per, ["book_id"], ["chapter_id"], "chapter_id", "duration_ms")


@query(f"SELECT book_id, string_agg('file ''' || chapter_id || '/' || lpad(chunk_idx::VARCHAR, 6, '0') || '.wav''' || chr(10), '' ORDER BY chapter_id, chunk_idx) AS concat FROM {SEGMENTS} WHERE ok GROUP BY book_id")
def concat_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = segments(spark, sf_dir).where("exists").withColumn("file", F.concat("chapter_id", F.lit("/"), F.format_string("%06d.wav", "chunk_idx")))
    return timeline.concat_list(own, ["book_id"], ["chapter_id", "chunk_idx"], "file")


@query(
    f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_id, chunk_idx) AS g FROM {SEGMENTS}) SELECT book_id, count(*)::BIGINT AS total, count(duration_ms)::BIGINT AS done, round(100.0::DOUBLE * count(duration_ms) / count(*), 2) AS percent, min(g) FILTER (duration_ms IS NULL)::INTEGER AS next_index FROM x GROUP BY book_id"
)
def playback_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = progress.progress(segments(spark, sf_dir), ["book_id"], ["chapter_id", "chunk_idx"])
    return p.select("book_id", "total", "done", "percent", F.col("current.global_index").alias("next_index"))


@query(
    f"WITH s AS (SELECT s.row_id, t.prepared, t.after_numbers, t.lang FROM {SEGMENTS} s JOIN tts_pipeline t ON s.row_id = t.row_id), v AS (SELECT DISTINCT lang FROM voices WHERE lang IS NOT NULL) SELECT row_id, CASE WHEN regexp_matches(regexp_replace(coalesce(prepared, ''), '[\\s\"“”「」]', '', 'g'), '^[…⋯]+$') THEN 'silence' WHEN after_numbers IS NULL THEN 'reuse' "
    f"WHEN {sql_strip('coalesce(prepared, chr(32))')} = '' THEN 'empty' WHEN v.lang IS NULL THEN 'no_voice' ELSE 'synth' END AS action FROM s LEFT JOIN v ON s.lang = v.lang"
)
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is next for each chunk: a voice is there where one speaks its language, and a recording where the figures were not read again."""
    t = table(spark, sf_dir, "tts_pipeline").select("row_id", F.col("prepared").alias("text"), "after_numbers", "lang")
    voices = table(spark, sf_dir, "voices").where("lang IS NOT NULL").select("lang").distinct().withColumn("has_voice", F.lit(True))
    s = segments(spark, sf_dir).select("row_id").join(t, "row_id").join(voices, "lang", "left")
    s = s.withColumns({"has_wav": F.col("after_numbers").isNull(), "has_voice": F.coalesce("has_voice", F.lit(False)), "pause_multiplier": F.lit(1)})
    return manifest.next_actions(s).select("row_id", "action")


# -- books, voices ---------------------------------------------------------------------------------------------------


@query(
    "WITH b AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY created_unix DESC NULLS LAST, title) AS r FROM books), c AS (SELECT book_id, count(DISTINCT chapter_index) AS n FROM chapters_raw GROUP BY book_id), p AS (SELECT book_id, max(to_index) AS furthest FROM boundary_log GROUP BY book_id) "
    f"SELECT b.book_id, coalesce(nullif(title, ''), b.book_id) AS title, coalesce(n, 0)::BIGINT AS chapters, furthest AS furthest_played, coalesce(furthest, -1) >= coalesce(n, 0) - 1 AS complete, lower(regexp_replace({sql_strip('coalesce(nullif(title, chr(0)), b.book_id)')}, '(?i)^(the|a|an)\\s+', '')) AS sort_key "
    "FROM b LEFT JOIN c ON b.book_id = c.book_id LEFT JOIN p ON b.book_id = p.book_id WHERE r = 1"
)
def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = table(spark, sf_dir, "boundary_log").groupBy("book_id").agg(F.max("to_index").alias("furthest_played"))
    return progress.library(table(spark, sf_dir, "books"), raw(spark, sf_dir), heard).drop("authors")


@query("SELECT book_id, created_unix, regexp_extract(coalesce(pub_year, ''), '((19|20)[0-9]{2})', 1) AS year, coalesce(array_to_string(authors, ', '), '') AS artist FROM books")
def book_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = fields.tags("title", "authors", "pub_year", "lang")
    return table(spark, sf_dir, "books").select("book_id", "created_unix", fields.year(F.array(F.coalesce("pub_year", F.lit("")))).alias("year"), F.coalesce(tags["artist"], F.lit("")).alias("artist"))


LANG = "CASE WHEN lower(x) IN ('chinese', 'zh', 'mandarin') THEN 'zh' WHEN lower(x) IN ('japanese', 'ja') THEN 'ja' WHEN lower(x) IN ('english', 'en') THEN 'en' WHEN lower(x) IN ('korean', 'ko') THEN 'ko' WHEN lower(x) IN ('french', 'fr') THEN 'fr' WHEN lower(x) IN ('german', 'de') THEN 'de' WHEN lower(x) IN ('spanish', 'es') THEN 'es' ELSE lower(x) END"


@query(f"SELECT row_id, {LANG} AS language, CASE WHEN g IN ('female', 'male') THEN g END AS gender FROM (SELECT row_id, nullif({sql_strip('lang')}, '') AS x, lower({sql_strip('gender')}) AS g FROM voices)")
def voice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "voices").select("row_id", fields.language("lang").alias("language"), fields.gender("gender").alias("gender"))


@query(
    "WITH d AS (SELECT lang, min(voice_name) AS v FROM voices WHERE lang IS NOT NULL GROUP BY lang), b AS (SELECT book_id, min(lang) AS lang FROM books GROUP BY book_id), o AS (SELECT chapter_id, book_id, max(lang) AS lang FROM chapter_inputs GROUP BY ALL) "
    "SELECT o.book_id, o.chapter_id, coalesce(w.v, d.v, '') AS voice FROM o LEFT JOIN d w ON o.lang = w.lang LEFT JOIN b ON o.book_id = b.book_id LEFT JOIN d ON b.lang = d.lang"
)
def voice_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter's voice: one of its own language, else one of its book's."""
    by_lang = table(spark, sf_dir, "voices").where("lang IS NOT NULL").groupBy("lang").agg(F.min("voice_name").alias("voice"))
    rows = table(spark, sf_dir, "chapter_inputs").groupBy("book_id", "chapter_id").agg(F.max("lang").alias("lang"))
    own = rows.join(by_lang, "lang").select("book_id", "chapter_id", "voice")
    shelf = table(spark, sf_dir, "books").groupBy("book_id").agg(F.min("lang").alias("lang")).join(by_lang.withColumnRenamed("voice", "default_voice"), "lang", "left")
    return lookups.resolved_voice(rows, own, shelf.withColumn("manifest_voice", F.lit(None).cast("string"))).select("book_id", "chapter_id", "voice")


@query("SELECT lang, max_by(row_id, length(ref_text) * 1000000 - row_id) AS row_id FROM voices WHERE lang IS NOT NULL AND ref_text IS NOT NULL GROUP BY lang")
def top_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "voices").where("lang IS NOT NULL AND ref_text IS NOT NULL")
    return v.groupBy("lang").agg(F.max_by("row_id", F.struct(F.char_length("ref_text"), -F.col("row_id"))).alias("row_id"))


# -- arrays of samples -----------------------------------------------------------------------------------------------

RATE = 800  # embeddings stand in for samples: 16 of them make a frame, 8 a hop


@query("SELECT vec_id, round(20 * log10(greatest(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding)), 1e-12)), 6) AS rms_db, round(20 * log10(greatest(list_max(list_transform(embedding, lambda v: abs(v::DOUBLE))), 1e-12)), 6) AS peak_db FROM embeddings")
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(audio.decibels(audio.rms(F.col("embedding"))), 6).alias("rms_db"), F.round(audio.peak_db("embedding"), 6).alias("peak_db"))


@query(
    "WITH f AS (SELECT vec_id, list_transform(range(0, len(embedding) - 15, 8), lambda s: list_slice(embedding, s + 1, s + 16)) AS w FROM embeddings), l AS (SELECT vec_id, list_transform(w, lambda x: least(0, greatest(-90, 20 * log10(greatest(sqrt(list_sum(list_transform(x, lambda v: v::DOUBLE * v::DOUBLE)) / 16), 1e-12))))) AS l FROM f) "
    "SELECT vec_id, len(l)::INTEGER AS frames, round(list_max(l), 6)::DOUBLE AS loudest, round(list_min(l), 6)::DOUBLE AS quietest FROM l"
)
def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", audio.frame_levels("embedding", RATE * 20 // 1000, RATE * 10 // 1000).alias("l"))
    return x.select("vec_id", F.size("l").alias("frames"), F.round(F.array_max("l"), 6).alias("loudest"), F.round(F.array_min("l"), 6).alias("quietest"))


from vellum.plans import folds, rows  # noqa: E402, F401  more queries, by the same decorator
