"""Queries whose SQL walks over a text or signal in order: sentence spans, section marks and speech levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.functions import audio, udfs
from vellum.operators import headings
from vellum.plans.catalogue import RATE, WS, ZH, query, raw, sql_strip
from vellum.session import spread, table

ENDS, SHUT, MIDDLE = "。！？?!…", "」』）】］〉》”’\"''", "、，,;；:："
CONTENT = f"[{ZH}\\p{{Nd}}A-Za-z²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐]"
VOID = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{B}\\x{1C}-\\x{1F}\\x{85}\\x{E000}]"
_PART = lambda a, b: f"substr(text, {a} + 1, {b} - {a})"
#: The span from s.start to {e} without blanks at its ends, added to s.out unless nothing is left.
_CLOSED = lambda e: f"CASE WHEN regexp_matches({_PART('s.start', e)}, '[^{VOID[1:]}') THEN list_append(s.out, [s.start + length(regexp_extract({_PART('s.start', e)}, '^{VOID}*')), s.start + length(regexp_replace({_PART('s.start', e)}, '{VOID}+$', ''))]) ELSE s.out END"
_SKIP = lambda a: f"({a} + length(regexp_extract(substr(text, {a} + 1), '^{VOID}*')))"


def _fold() -> str:
    """A line, a mark or a pause ends a span where there is enough since the last one; blanks after it are passed over."""
    after = "(CASE x.k WHEN 'E' THEN s.pos + length(x.t) ELSE s.pos + 1 END)"
    ends = "(CASE x.k WHEN 'E' THEN s.pos + length(x.t) ELSE s.pos END)"
    held = f"regexp_matches({_PART('s.start', ends)}, '{CONTENT}')"
    enough = f"({held} OR (x.k = 'L' AND regexp_matches({_PART('s.start', ends)}, '[\\p{{P}}\\p{{S}}]')) OR (x.k = 'E' AND substr(text, {ends} + 1, 1) IN (chr(10), chr(57344))))"
    event = "(x.k <> 'O' AND s.pos >= s.past)"
    return (
        f"{{'pos': s.pos + length(x.t), 'past': CASE WHEN {event} THEN {_SKIP(after)} ELSE s.past END, 'start': CASE WHEN {event} AND {enough} THEN {_SKIP(after)} ELSE s.start END, "
        f"'out': CASE WHEN {event} AND {enough} THEN {_CLOSED(ends)} ELSE s.out END}}"
    )


_PAUSED = f"NOT regexp_matches(l, '[{ENDS}{MIDDLE}A-Za-z]') AND len(regexp_extract_all(regexp_replace(l, '([{ZH}])', '\\1\\1', 'g'), '[{ZH}][ \\x{{3000}}][{ZH}]')) = 1"
_HALVES = f"[{{'k': 'O', 't': regexp_extract(l, '^(.*[{ZH}])[ \\x{{3000}}][{ZH}]', 1)}}, {{'k': 'P', 't': ' '}}, {{'k': 'O', 't': regexp_extract(l, '[{ZH}][ \\x{{3000}}]([{ZH}].*)$', 1)}}]"
_MARKED = f"list_transform(regexp_extract_all(l, '\\x{{E000}}|[{ENDS}]+[{SHUT}]*|[^\\x{{E000}}{ENDS}]+'), lambda t: {{'k': CASE WHEN t = chr(57344) THEN 'L' WHEN regexp_matches(t, '^[{ENDS}]') THEN 'E' ELSE 'O' END, 't': t}})"


@query(
    f"WITH t AS (SELECT row_id, text, list_slice(flatten(list_transform(string_split(text, chr(10)), lambda l: list_append(CASE WHEN {_PAUSED} THEN {_HALVES} ELSE {_MARKED} END, {{'k': 'L', 't': chr(10)}}))), 1, -2) AS toks FROM chapter_inputs WHERE text IS NOT NULL), "
    f"f AS (SELECT row_id, text, list_reduce(toks, lambda s, x: {_fold()}, {{'pos': 0::BIGINT, 'past': 0::BIGINT, 'start': 0::BIGINT, 'out': []::BIGINT[][]}}) AS s FROM t), "
    f"o AS (SELECT row_id, {_CLOSED('length(text)')} AS out FROM f) SELECT row_id, (generate_subscripts(out, 1) - 1)::INTEGER AS idx, unnest(out)[1]::INTEGER AS start, unnest(out)[2]::INTEGER AS \"end\" FROM o"
)
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = spread(table(spark, sf_dir, "chapter_inputs").where("text IS NOT NULL").select("row_id", "text"), "row_id").select("row_id", F.posexplode(udfs.sentence_spans("text")).alias("idx", "s"))
    return spans.select("row_id", "idx", "s.start", "s.end")


_VISIBLE = "regexp_matches(l, '^[^\\p{L}\\p{N}\\p{M}\\x{E000}]+$') AND regexp_replace(l, '" + WS + "', '', 'g') <> ''"


@query(
    f"WITH a AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY row_id, i) AS i, {sql_strip('line')} AS l FROM (SELECT book_id, row_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM (SELECT book_id, row_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM chapters_raw WHERE text IS NOT NULL))), "
    "b AS (SELECT *, i - row_number() OVER (PARTITION BY book_id, l ORDER BY i) AS run FROM a), r AS (SELECT book_id, l, min(i) AS first, count(*) AS n FROM b GROUP BY book_id, l, run), "
    f"c AS (SELECT *, coalesce(lag(l) OVER w, '') = '' AND coalesce(lead(l) OVER w, '') = '' AS alone, {_VISIBLE} AS symbol FROM r WINDOW w AS (PARTITION BY book_id ORDER BY first)), "
    "m AS (SELECT book_id, l AS mark, sum(n)::BIGINT AS n, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS isolated FROM c WHERE symbol GROUP BY book_id, l), "
    f"g AS (SELECT book_id, unnest(string_split(regexp_replace(l, '{WS}', '', 'g'), '')) AS g, n FROM c WHERE NOT symbol AND l <> ''), h AS (SELECT book_id, g, sum(n) AS inside FROM g WHERE g <> '' GROUP BY ALL), "
    f"s AS (SELECT *, unnest(list_filter(string_split(regexp_replace(mark, '{WS}', '', 'g'), ''), lambda v: v <> '')) AS g FROM m), j AS (SELECT s.book_id, mark, n, isolated, count(*) AS size, sum(coalesce(inside, 0)) AS within FROM s LEFT JOIN h ON s.book_id = h.book_id AND s.g = h.g GROUP BY ALL) "
    "SELECT book_id, mark, n, isolated FROM j WHERE NOT regexp_matches(mark, '[\\p{Ps}\\p{Pe}\\p{Pi}\\p{Pf}]') AND within <= 0.35::DOUBLE * n * size AND ((n > 1 AND isolated >= 0.8::DOUBLE * n) OR (n = 1 AND size = 1 AND within = 0))"
)
def section_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section marks of each book, every line taken as a paragraph of its own."""
    lines = raw(spark, sf_dir).where("text IS NOT NULL").select("book_id", "row_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit("\n\n")), "\n", -1)).alias("p", "line"))
    return headings.section_marks(lines.withColumn("line_no", F.col("row_id") * (1 << 24) + F.col("p")), ["book_id"])


_POWER = "list_sum(list_transform(w, lambda v: v::DOUBLE * v::DOUBLE)) / len(w)"


@query(
    "WITH f AS (SELECT vec_id, embedding AS e, list_transform(range(0, len(embedding) - 15, 8), lambda s: list_slice(embedding, s + 1, s + 16)) AS ws FROM embeddings), "
    f"p AS (SELECT vec_id, e, list_transform(ws, lambda w: {_POWER}) AS p, list_transform(ws, lambda w: least(0.0, greatest(-90.0, 10 * log10({_POWER} + 1e-12)))) AS l FROM f), "
    "b AS (SELECT *, list_min(l) AS low, list_max(l) AS high FROM p), d AS (SELECT *, list_transform(range(257), lambda i: low + i * ((high - low) / 256)) AS edge, list_transform(l, lambda x: least(255, floor((x - low) * (256 / (high - low)))::INTEGER)) AS rough FROM b), "
    "c AS (SELECT *, list_transform(list_zip(l, rough), lambda x: CASE WHEN x[1] < edge[x[2] + 1] THEN x[2] - 1 WHEN x[2] < 255 AND x[1] >= edge[x[2] + 2] THEN x[2] + 1 ELSE x[2] END) AS bin FROM d), "
    "k AS (SELECT *, list_transform(range(256), lambda i: (edge[i + 1] + edge[i + 2]) / 2) AS mid FROM c), "
    "q AS (SELECT vec_id, e, p, l, mid, list_transform(range(256), lambda t: {'t': t, 'n': len(list_filter(bin, lambda x: x <= t)), 'm': coalesce(list_sum(list_transform(list_filter(bin, lambda x: x <= t), lambda x: mid[x + 1])), 0), 'a': list_sum(list_transform(bin, lambda x: mid[x + 1]))}) AS z FROM k), "
    "o AS (SELECT *, list_transform(z, lambda s: CASE WHEN s.n > 0 AND s.n < len(l) THEN s.n * (len(l) - s.n) * pow(s.m / s.n - (s.a - s.m) / (len(l) - s.n), 2) ELSE -1 END) AS v FROM q), "
    "h AS (SELECT *, mid[list_position(list_transform(v, lambda y: y >= list_max(v) * (1 - 1e-9)), true)] AS threshold FROM o), s AS (SELECT vec_id, e, list_transform(list_filter(list_zip(p, l), lambda x: x[2] >= threshold), lambda x: x[1]) AS kept FROM h) "
    "SELECT vec_id, round(10 * log10(list_sum(kept) / len(kept) + 1e-12), 4) AS active_db, round(20 * log10(list_max(list_transform(e, lambda v: abs(v::DOUBLE))) + 1e-12), 4) AS peak_db FROM s"
)
def active_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of active speech by its own threshold, and the peak."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", audio.speech_level("embedding", F.lit(RATE)).alias("s"))
    return x.select("vec_id", F.round("s.active_db", 4).alias("active_db"), F.round("s.peak_db", 4).alias("peak_db"))


@query(
    "WITH f AS (SELECT vec_id, len(embedding) AS n, list_transform(range(0, len(embedding) - 15, 8), lambda s: list_slice(embedding, s + 1, s + 16)) AS ws FROM embeddings), "
    f"l AS (SELECT vec_id, n, list_transform(ws, lambda w: 20 * log10(sqrt({_POWER}) + 1e-12) > -45) AS loud FROM f), b AS (SELECT vec_id, n, list_position(loud, true) - 1 AS a, len(loud) - list_position(list_reverse(loud), true) AS z FROM l) "
    "SELECT vec_id, CASE WHEN a IS NULL THEN n ELSE least(n, z * 8 + 16 + 112) - greatest(0, a * 8 - 48) END::INTEGER AS kept FROM b"
)
def trimmed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What silence trimming leaves of each signal."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(audio.trimmed(F.col("embedding"), F.lit(RATE))).alias("kept"))


_FOUR = lambda g: f"rtrim(regexp_replace(array_to_string(list_transform(range(1, length({g}::VARCHAR) + 1), lambda i: CASE WHEN substr({g}::VARCHAR, i, 1) = '0' THEN '零' ELSE substr('零一二三四五六七八九', substr({g}::VARCHAR, i, 1)::INTEGER + 1, 1) || ['', '十', '百', '千'][length({g}::VARCHAR) - i + 1] END), ''), '零+', '零', 'g'), '零')"
_HEAD = lambda g: f"CASE WHEN {g} BETWEEN 10 AND 19 THEN substr({_FOUR(g)}, 2) ELSE {_FOUR(g)} END"


@query(
    "WITH x AS (SELECT row_id, (row_id * 7919 * (1 + row_id % 5) * power(10, row_id % 4)::BIGINT) % 100000000 AS n FROM chapters_raw), g AS (SELECT row_id, n, n // 10000 AS h, n % 10000 AS l FROM x) "
    f"SELECT row_id, CASE WHEN n = 0 THEN '零' WHEN h = 0 THEN {_HEAD('l')} ELSE {_HEAD('h')} || '万' || CASE WHEN l = 0 THEN '' WHEN l < 1000 THEN '零' || {_FOUR('l')} ELSE {_FOUR('l')} END END AS words FROM g"
)
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of up to eight figures in words, made from row numbers."""
    n = (F.col("row_id") * 7919 * (1 + F.col("row_id") % 5) * F.pow(F.lit(10), F.col("row_id") % 4).cast("long")) % 100_000_000
    return spread(raw(spark, sf_dir).select("row_id"), "row_id").select("row_id", udfs.numbers_to_words(n.cast("string")).alias("words"))
