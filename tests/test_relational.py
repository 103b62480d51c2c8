"""Operators on small tables, against hand-derived results or a plain Python version."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import audio, fields, predicates, text, udfs
from vellum.kernels import caps, chunker
from vellum.kernels.chars import SB
from vellum.operators import chapters, cleaning, headings, lookups, manifest, progress, stats, timeline
from vellum.plans import catalogue, pipeline


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# -- statistics --------------------------------------------------------------------------------------------------


def plain_series(values):
    v = sorted(values)
    at = lambda q, other: v[int((len(v) - 1) * q)] or other
    return [at(0.1, v[0]), at(0.25, v[0]), at(0.5, v[0]), at(0.75, v[-1]), at(0.9, v[-1])]


def test_percentiles(spark):
    rng = random.Random(1)
    data = [(k, rng.choice([0.0, float(rng.randrange(-50, 50)), rng.uniform(-5000, 5000)])) for k in "ab" for _ in range(500)] + [("c", 3.0), ("d", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r for r in stats.exact_percentile(df, ["k"], "v").collect()}
    assert set(got) == {"a", "b", "c"}
    for k in "abc":
        v = sorted(x for g, x in data if g == k)
        assert [got[k][q] for q in stats.QUANTILES] == [v[int((len(v) - 1) * q)] for q in stats.QUANTILES.values()]
    arrays = {r.k: r.s for r in df.groupBy("k").agg(stats.series(F.collect_list("v")).alias("s")).collect()}
    assert arrays["d"] is None and [arrays["a"][q] for q in stats.QUANTILES] == [round(x, 3) for x in plain_series([x for g, x in data if g == "a"])]


def log_row(**kw):
    base = {"book_id": "b", "from_index": 1, "to_index": 2, "trigger_kind": "gapless", "preloaded": True, "delta_ms": 0.0, "output_latency_ms": 5.0, "playback_rate": 1.0, "pad_ms": 350}
    return tuple((base | kw).values())


LOG = "book_id string, from_index int, to_index int, trigger_kind string, preloaded boolean, delta_ms double, output_latency_ms double, playback_rate double, pad_ms int"


@pytest.mark.parametrize("n,without,basis", [(199, 0, "insufficient_data"), (200, 40, "p50(delta_ms + output_latency_ms)"), (200, 41, "insufficient_data")])
def test_boundary_report(spark, n, without, basis):
    data = [log_row(delta_ms=float(i), output_latency_ms=None if i < without else 5.0) for i in range(n)]
    data += [log_row(playback_rate=r) for r in (0.94, 1.06, None)] + [log_row(preloaded=None), log_row(trigger_kind="seek"), log_row(delta_ms=6000.0)]
    r = stats.boundary_report(spark.createDataFrame(data, LOG)).first()
    assert (r.samples_total, r.samples_filtered, r.samples_with_output_latency, r.basis) == (n + 6, n, n - without, basis)
    assert r.pad_ms_values == [350] and (r.recommended_pad_adjust_ms is None) == (basis == "insufficient_data")
    empty = stats.boundary_report(spark.createDataFrame([log_row(preloaded=False)], LOG)).first()
    assert (empty.samples_filtered, empty.delta_ms, empty.pad_ms_values) == (0, None, [])


# -- time --------------------------------------------------------------------------------------------------------


def plain_plan(durations, parts):
    """The plan by its rules, one chapter after the other."""
    out, part, held, left_ms, left = [], 1, [], sum(durations), parts
    for i, d in enumerate(durations):
        for rule in ("must", "over"):
            ready = held and left > 1 and (len(durations) - i == left if rule == "must" else sum(held) + d > left_ms / left and len(durations) - i >= left)
            if ready:
                left_ms, left, held, part = left_ms - sum(held), left - 1, [], part + 1
        held.append(d)
        out.append(part)
    return out


def test_split_plan(spark):
    rng = random.Random(7)
    books = {"x": ([1000, 2000, 3000, 4000], 2)} | {f"b{i}": ([rng.randrange(0, 5000) for _ in range(rng.randrange(1, 14))], rng.randrange(1, 6)) for i in range(40)}
    df = spark.createDataFrame([(b, i, d, p) for b, (ds, p) in books.items() for i, d in enumerate(ds)], "book_id string, n int, duration_ms long, parts int")
    got = timeline.split_plan(df, ["book_id"], ["n"], "duration_ms", F.col("parts"))
    by = {}
    for r in got.orderBy("book_id", "n").collect():
        by.setdefault(r.book_id, []).append(r.part)
    assert by["x"] == [1, 1, 2, 2]
    assert by == {b: plain_plan(*v) for b, v in books.items()}


def test_split_count_and_names(spark):
    hours = 3_600_000
    df = spark.createDataFrame([(8 * hours,), (8 * hours + 1,), (0,)], "t long")
    assert [r.n for r in df.select(timeline.split_count(F.col("t"), 8.0).alias("n")).collect()] == [1, 2, 1]
    assert one(spark, timeline.part_name(F.lit("book"), F.lit(3), F.lit(120))) == "book.part003.m4b"


def test_prefix_timeline_and_metadata(spark):
    seg = [("b", 1, 1, True, 120), ("b", 1, 2, False, None), ("b", 1, 3, True, 90), ("b", 2, 1, True, 80), ("c", 1, 1, True, 120), ("c", 1, 2, False, 0), ("c", 1, 3, True, 120), ("c", 2, 1, True, 120), ("d", 1, 1, False, None)]
    df = spark.createDataFrame(seg, "book_id string, chapter int, chunk_idx int, exists boolean, duration_ms long")
    prefix = timeline.available_prefix(df, ["book_id"], ["chapter", "chunk_idx"])
    got = rows(timeline.chapter_durations(prefix, ["book_id", "chapter"]), "book_id", "chapter", "duration_ms")
    assert got == [("b", 1, 120), ("c", 1, 240), ("c", 2, 120)]
    t = timeline.timeline(spark.createDataFrame([("b", 1, 0), ("b", 2, None), ("b", 3, 50)], "book_id string, n int, d long"), ["book_id"], ["n"], "d")
    assert rows(t, "n", "start_ms", "end_ms") == [(1, 0, 1), (2, 1, 2), (3, 2, 52)]
    m = timeline.metadata_text(spark.createDataFrame([("b", 1, "a=b;c", 5)], "book_id string, n int, title string, d long"), ["book_id"], ["n"], "title", "d").first().metadata
    assert m == ";FFMETADATA1\n\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=5\ntitle=a\\=b\\;c\n"


def test_progress(spark):
    m = spark.createDataFrame([("b", "c1", "t", ["x", "y"], [10, None]), ("b", "c2", "t", ["z"], [])], "book_id string, chapter_id string, title string, chunks array<string>, durations_ms array<long>")
    r = progress.progress(progress.chunk_rows(m, "book_id"), ["book_id"], ["chapter_id", "chunk_idx"]).first()
    assert (r.total, r.done, r.percent, r.current.global_index, r.current.chunk_idx) == (3, 1, 33.33, 2, 2)
    assert one(spark, progress.title_sort_key(F.lit(" The Door"), F.lit("id"))) == "door" and one(spark, progress.title_sort_key(F.lit(""), F.lit("ID"))) == "id"
    full = m.withColumns({"chunk_spans": F.array().cast("array<int>"), "has_recording": F.lit(False)})
    assert rows(progress.audio_totals(full, ["book_id"]), "audio_total", "audio_done") == [(3, 1)]


# -- lookups -----------------------------------------------------------------------------------------------------


def test_lookups(spark):
    raw = spark.createDataFrame([("b", 1, "T/a.x", ["h"], {"h": "title"}), ("b", 1, "T/z.x", ["late"], None), ("b", 2, "T/c.x", [], None)], "book_id string, chapter_index int, source string, headings array<string>, heading_categories map<string,string>")
    clean = spark.createDataFrame([("b", 1, "q/none", [], None), ("b", 9, "clean/a.x", None, None), ("b", 2, "clean/none", ["own"], {"own": "section"})], "book_id string, source_index int, path string, headings array<string>, heading_categories map<string,string>")
    assert rows(lookups.with_raw_headings(clean, raw), "source_index", "headings") == [(1, ["h"]), (2, ["own"]), (9, ["h"])]
    iv = spark.createDataFrame([("b", 1, 4), ("b", 4, 6), ("b", 5, 5), ("b", 8, 9), ("c", 2, 3), ("c", 0, 9)], "k string, start long, end long")
    assert rows(lookups.merged_intervals(iv, ["k"]), "k", "start", "end") == [("b", 1, 6), ("b", 8, 9), ("c", 0, 9)]
    marks = F.expr("array(named_struct('start', 1, 'end', 3))")
    assert one(spark, lookups.highlighted(F.lit("a<b>c"), marks)) == "a<mark>&lt;b</mark>&gt;c"
    spans = spark.createDataFrame([(1, 2, 4), (1, 9, 10)], "id int, start int, end int")
    quotes = spark.createDataFrame([(1, 1, 5), (1, 0, 8), (1, 2, 3)], "id int, start int, end int")
    got = {(r.start): r.quote for r in lookups.enclosing(spans, quotes, ["id"]).collect()}
    assert (got[2].start, got[2].end) == (0, 8) and got[9] is None
    chunks = spark.createDataFrame([(1, 0, 2), (1, 4, 6)], "id int, start int, end int")
    texts = spark.createDataFrame([(1, f"ab{SB}\ncd")], "id int, text string")
    assert rows(lookups.breaks_by_position(chunks, texts, ["id"], SB), "start", "section_break") == [(0, True), (4, False)]


def test_contents_and_voices(spark):
    spine = spark.createDataFrame([("b", 0, "T/a.x", "i0"), ("b", 1, "T/b c.x", "i1")], "book_id string, spine_pos int, href string, id string")
    toc = spark.createDataFrame([("b", 0, "A", "T/a.x#1"), ("b", 1, "A2", "T/a.x#2"), ("b", 2, "B", "T/b%20c.x"), ("b", 3, "gone", "x")], "book_id string, pos int, title string, href string")
    assert rows(lookups.toc_spine(toc, spine), "spine_pos", "title") == [(0, "A"), (1, "B")]
    pages = spark.createDataFrame([("b", 0, "a", 0), ("b", 1, "b", 9), ("b", 2, "c", 9), ("b", 3, "d", 9)], "book_id string, spine_pos int, href string, text_chars int")
    links = spark.createDataFrame([("b", 0, i, t, f"L{t}") for i, t in enumerate("bcd")], "book_id string, page int, pos int, target string, label string")
    entries = spark.createDataFrame([("b", 0, "Part", "a"), ("b", 1, "Coda, first", "c"), ("b", 2, "Coda", "c")], "book_id string, pos int, title string, href string")
    assert rows(lookups.title_overrides(entries, links, pages), "href", "title") == [("a", "Part"), ("b", "Lb"), ("c", "Coda"), ("d", "Ld")]
    ch = spark.createDataFrame([("b", "1"), ("b", "2"), ("c", "1")], "book_id string, chapter_id string")
    own = spark.createDataFrame([("b", "1", " v1 "), ("b", "2", "Default")], "book_id string, chapter_id string, voice string")
    books = spark.createDataFrame([("b", None, "m"), ("c", " ", None)], "book_id string, default_voice string, manifest_voice string")
    assert rows(lookups.resolved_voice(ch, own, books), "book_id", "chapter_id", "voice") == [("b", "1", "v1"), ("b", "2", "m"), ("c", "1", "")]
    kept = lookups.stored_overrides(F.expr("map('1', 'a', '2', 'b', '3', ' ')"), F.lit("a"))
    assert one(spark, kept) == {"2": "b"}
    e = spark.createDataFrame([("b", 1, "c/x.txt", "T"), ("b", 2, "", "Dup")], "book_id string, entry_id int, path string, title string")
    r = spark.createDataFrame([("b", 0, "raw/x.txt", "Z"), ("b", 1, "q", "Dup"), ("b", 2, "r", "Dup")], "book_id string, pos int, path string, title string")
    assert rows(lookups.report_match(e, r), "entry_id", "report_pos") == [(1, 0), (2, 1)]
    c = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y")], "book_id string, chapter_index int, title string")
    assert [lookups.found_chapter(c, i, t).first().title for i, t in ((2, "x"), (9, "y"), (9, "q"))] == ["y", "y", "x"]
    notes = spark.createDataFrame([("b", ["n1"], ["r"]), ("b", ["n2", "n1"], [])], "book_id string, note_ids array<string>, note_targets array<string>")
    assert lookups.note_index(notes).first().note_ids == ["n1", "n2"]


# -- chapters ----------------------------------------------------------------------------------------------------

CH = "book_id string, chapter_index int, title string, href string, source string, text string, headings array<string>"


def test_continuations(spark):
    data = [("b", 1, "Dawn", "h1", "s1", "Dawn came.", ["Dawn"]), ("b", 2, "s2", "h2", "s2.x", "more", []), ("b", 3, "Then it went on", "h3", "s3", "Then it went on\nx", None), ("b", 4, "第二章", "h4", "s4", "第二章\ny", None), ("b", 5, "s5", "h5", "s5", "z", [])]
    df = spark.createDataFrame(data, CH)
    got = rows(chapters.merged_continuations(df, ["book_id"], "chapter_index"), "chapter_index", "text", "parts")
    assert got == [(1, "Dawn came.\n\nmore\n\nThen it went on\nx", 3), (4, "第二章\ny\n\nz", 2)]
    starts = spark.createDataFrame([("b", "s5")], "book_id string, source string")
    assert chapters.merged_continuations(df, ["book_id"], "chapter_index", starts).count() == 3


def test_title_pages(spark):
    body = "It was late\n" + "x" * 500
    pages = [("Part One", "Part One"), ("Part Two", "Part Two"), ("It was late", body), ("Part Three", "Part Three"), ("第一章", "第一章\n" + "y" * 500), ("End", "End")]
    df = spark.createDataFrame([("b", i, t, f"h{i}", f"s{i}", x, []) for i, (t, x) in enumerate(pages)], CH)
    got = rows(chapters.merged_title_pages(df, ["book_id"], "chapter_index"), "chapter_index", "title", "source")
    assert got == [(0, "Part One", "s0"), (1, "Part Two", "s2"), (3, "Part Three", "s3"), (4, "第一章", "s4"), (5, "End", "s5")]
    merged = chapters.merged_title_pages(df, ["book_id"], "chapter_index").where("chapter_index = 1").first()
    assert merged.text == "Part Two\n\n" + body and merged.headings == ["Part Two"]


def test_orders_and_choices(spark):
    df = spark.createDataFrame([("b", 1), ("b", 3), ("b", 5)], "book_id string, source_index int")
    dropped = spark.createDataFrame([("b", 3)], "book_id string, source_index int")
    assert rows(chapters.without_chapter(df, dropped, ["book_id"]), "source_index", "chapter_index") == [(1, 1), (5, 2)]
    assert rows(chapters.with_restored(df, dropped.withColumn("title", F.lit("r")), ["book_id"]), "chapter_index", "source_index") == [(1, 1), (2, 3), (3, 3), (4, 5)]
    toc = spark.createDataFrame([("b", "x" * 90), ("c", "x" * 89)], "book_id string, text string").withColumn("by", F.lit("toc"))
    spine = spark.createDataFrame([("b", "y" * 100), ("c", "y" * 100)], "book_id string, text string").withColumn("by", F.lit("spine"))
    assert rows(chapters.chosen_by_coverage(toc, spine, ["book_id"]), "book_id", "by") == [("b", "toc"), ("c", "spine")]
    sp = spark.createDataFrame([("b", 0, False, True, "front"), ("b", 1, True, False, "A"), ("b", 2, False, True, "a2"), ("b", 3, False, False, "stop"), ("b", 4, False, True, "no"), ("b", 5, True, False, "B")], "book_id string, spine_pos int, boundary boolean, goes_on boolean, text string")
    heads = sp.where("boundary").select("book_id", "spine_pos", "text")
    assert rows(chapters.with_followers(heads, sp, ["book_id"]), "spine_pos", "text", "items") == [(1, "A\n\na2", 2), (5, "B", 1)]
    ser = spark.createDataFrame([("b", 0, "c1_split_000.html", True), ("b", 1, "c1_split_001.html", False), ("b", 2, "x.html", True), ("b", 3, "c2_split_000.html", True), ("b", 4, "c2_split_001.html", True)], "book_id string, spine_pos int, href string, in_toc boolean")
    assert rows(chapters.series_groups(ser, ["book_id"]), "spine_pos", "series_id", "merges") == [(0, 1, True), (1, 1, True), (2, 2, False), (3, 3, False), (4, 3, False)]
    im = spark.createDataFrame([("b", 0, "i", "big.png", "image/png", "", 99, False), ("b", 1, "cov", "cover.png", "image/png", "", 5, False), ("c", 0, "i", "a.png", "x", "", 5, False), ("c", 1, "j", "b.png", "x", "", 9, False)], "book_id string, pos int, id string, href string, media_type string, properties string, size long, named boolean")
    assert rows(chapters.cover_choice(im, ["book_id"]), "book_id", "href") == [("b", "cover.png"), ("c", "b.png")]
    assert one(spark, chapters.chapter_title(F.lit("x.html"), F.lit("Dawn"), href=F.lit("x.html"), number=F.lit(3))) == "Dawn"


# -- headings ----------------------------------------------------------------------------------------------------


def test_headings(spark):
    h = F.array(*map(F.lit, ["A  b", "a B", " ", "C’s", "c's", "D"]))
    assert one(spark, headings.distinct_headings(h)) == ["A  b", "C’s", "D"]
    assert one(spark, headings.normal_categories(F.expr("map('A', 'note', ' a', 'TITLE', 'b', null)"))) == {"a": "title", "b": "section"}
    assert one(spark, headings.merged_categories(F.expr("map('a', 'section')"), F.expr("map('a', 'title', 'b', 'section')"))) == {"a": "title", "b": "section"}
    assert one(spark, headings.with_title_category(F.lit("Dawn "), F.array(F.lit("dawn")), F.expr("map('x', 'section')"))) == {"x": "section", "dawn": "title"}
    hits = spark.createDataFrame([("b", "t", 5, 4), ("b", "p", 50, 5), ("b", "u", 3, 3)], "book_id string, class string, uses int, hits int")
    assert rows(headings.heading_classes(hits), "class") == [("t",)]
    par = spark.createDataFrame([("p", "n")] * 10 + [("p", "rare")] * 2 + [("q", "z")], "page string, class string")
    assert rows(headings.usual_classes(par, ["page"]), "page", "class") == [("p", "n"), ("q", "z")]
    words = spark.createDataFrame([("b", w, i) for i, w in enumerate("the The the Oak oak OAK".split())], "book_id string, word string, pos int")
    assert rows(headings.dominant_spelling(words, ["book_id"]), "key", "spelling") == [("oak", "Oak"), ("the", "the")]


def test_spellings_are_of_whole_words(spark):
    data = [("b", 2, "Clémence wouldn’t. TRÈS tombée, Été été"), ("b", 1, "clémence très x² don't Àb-c ⅳ"), ("b", 3, "Clémence 1st _t 好a e\u0301t"), ("c", 1, None)]
    words = headings.words(spark.createDataFrame(data, "book_id string, row_id long, text string"), ["book_id"], "text", "row_id")
    got = rows(headings.dominant_spelling(words, ["book_id"]), "key", "spelling")
    assert got == sorted(caps.case_map("", [t for _, _, t in sorted(data[:3])]).items(), key=repr)
    assert {("clémence", "Clémence"), ("wouldn’t", "wouldn’t"), ("tombée", "tombée"), ("été", "Été")} <= set(got) and "tre" not in dict(got)


def test_dominant_spelling_agrees_with_the_kernel(spark, small):
    texts: dict = {}
    for r in spark.read.parquet(f"{small}/chapters_raw.parquet").where("text IS NOT NULL").orderBy("row_id").collect():
        texts.setdefault(r.book_id, []).append(r.text)
    expected = [(b, k, w) for b, t in texts.items() for k, w in caps.case_map("", t).items()]
    got = rows(catalogue.QUERIES["dominant_spelling"](spark, small), "book_id", "key", "spelling")
    assert got == sorted(expected, key=repr)


def test_section_marks_agree_with_the_kernel(spark):
    from vellum.kernels import sections

    rng = random.Random(11)
    texts = ["\n".join(rng.choice(["", "", "***", "❦", "(*)", "~", "a ~ b", "word"]) for _ in range(rng.randrange(3, 16))) for _ in range(60)]
    lines = spark.createDataFrame([(i, n, x) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))], "id int, line_no int, line string")
    got = {}
    for r in headings.section_marks(lines, ["id"]).collect():
        got.setdefault(r.id, set()).add(r.mark)
    assert got == {i: m for i, t in enumerate(texts) if (m := sections.section_marks(t))}


# -- cleaning, manifests -----------------------------------------------------------------------------------------


def test_rules():
    assert cleaning.Rules.of({"remove_patterns": ["x"]}).drop_titles[:1] == ["^目录$"] and cleaning.Rules.of({"replace_defaults": True}).drop_titles == []
    assert cleaning.Rules.of({"remove_patterns": ["x"], "section_cutoff_patterns": [predicates.CUTOFFS[0]]}).own() == {"drop_chapter_title_patterns": [], "section_cutoff_patterns": [], "remove_patterns": ["x"]}
    with pytest.raises(ValueError):
        cleaning.Rules.of({"remove_patterns": "x"})
    assert len(predicates.DROP_TITLES) == 21 and len(predicates.CUTOFFS) == 9


def test_cleaning(spark):
    raw = spark.createDataFrame(
        [(1, "b", 1, "目录", "x", None, None), (2, "b", 2, "Dawn", "THE OLD MAN went.\n\nthe old man\n参考文献\nrest [3]", [], None), (3, "b", 3, "Gone", None, None, None)],
        "row_id long, book_id string, chapter_index int, title string, text string, headings array<string>, heading_categories map<string,string>",
    )
    books = spark.createDataFrame([("b", "T", ["A"], 1)], "book_id string, title string, authors array<string>, created_unix long")
    out = {r.row_id: r for r in cleaning.cleaned_chapters(raw, books, cleaning.Rules.of({"remove_patterns": ["the"]})).collect()}
    assert out[1].drop_reason == "^目录$" and out[3].drop_reason == "missing_raw" and out[2].cutoff_reason == predicates.CUTOFFS[0]
    assert out[2].text == "Old man went.\n\n old man" and out[2].removed == {"the": 2}
    kept, why = cleaning.cut_section(F.lit("x\n b \ny\na\nz"), [r"^\s*a\s*$", r"^\s*b\s*$"])
    assert one(spark, kept).rstrip() == "x\n b \ny" and one(spark, why) == r"^\s*a\s*$"


def test_manifest(spark):
    text_ = f"第一章\n\n好吗？他来了。\n他说，\n「走吧」\n\n{SB}\n\n完了，还没有说完的话"
    df = spark.createDataFrame([("b", 1, text_, "t/0001-x.txt", ["第一章"], {"第一章": "title"}), ("b", 2, "尾声。", None, None, None), ("b", 3, " ", None, None, None)], "book_id string, chapter_index int, text string, path string, headings array<string>, heading_categories map<string,string>")
    built = manifest.built(df, 100, 0)
    assert rows(built, "chapter_id") == [("0001-x",), ("0002-chapter",)]
    chunks = manifest.with_chapter_pauses(manifest.exploded(built, "book_id", "chapter_index", "chapter_id"), ["book_id"], "chapter_index")
    last = {r.chapter_index: r.pause_multiplier for r in chunks.orderBy("chunk_idx").collect()}
    assert last == {1: 5, 2: 1}
    # the native windows agree with the kernel
    keyed = built.where("chapter_index = 1")
    c = manifest.exploded(keyed, "chapter_index").withColumns({"chapter_text": F.lit(keyed.first().text), "heading_pause": F.when(F.col("chunk_idx") == 1, 5)})
    spans = [(r.start, r.end) for r in c.orderBy("start").collect()]
    native = [r.pause_multiplier for r in manifest.window_pauses(c, ["chapter_index"]).orderBy("start").collect()]
    assert native == chunker.pauses(keyed.first().text, spans, ["第一章"], {"第一章": "title"})
    assert one(spark, manifest.checked_pauses(F.expr("array(3, -1)"), F.lit(2), F.expr("array(1, 5)"))) == [3, 5] and one(spark, manifest.checked_pauses(F.expr("array(3)"), F.lit(2), F.expr("array(-2, 5)"))) == [1, 5]
    assert one(spark, manifest.legacy_pauses(F.expr("array(true)"), F.lit(2))) == [3, 1]
    a = spark.createDataFrame([("c", "h1", 100, 15), ("d", "h2", 100, 15)], "chapter_id string, text_sha256 string, max_chars int, min_chars int")
    assert manifest.to_rebuild(a, a.where("chapter_id = 'c'"), ["chapter_id"]).first().chapter_id == "d"
    todo = spark.createDataFrame([("……", True, True), ("好", True, True), (" ", False, True), ("好", False, None), ("好", False, True)], "text string, has_wav boolean, has_voice boolean").withColumn("pause_multiplier", F.lit(3))
    assert [(r.action, r.silence_ms, r.pad_ms) for r in manifest.next_actions(todo).collect()] == [("silence", 500, 1050), ("reuse", 0, 1050), ("empty", 0, 1050), ("no_voice", 0, 1050), ("synth", 0, 1050)]


def test_pipeline(spark, small):
    from vellum.session import table

    clean = pipeline.sanitized(table(spark, small, "chapters_raw"), table(spark, small, "books"))
    chunks = pipeline.chunk_table(clean)
    assert chunks.where("pause_multiplier NOT IN (0, 1, 3, 5) OR end <= start").count() == 0 and chunks.count() > 100
    seg = chunks.select("book_id", "chapter_index", "chunk_idx", F.lit(True).alias("exists"), (F.char_length("text") * 180).cast("long").alias("duration_ms"))
    plan = pipeline.merge_plan(seg, 0.05)
    assert plan.groupBy("book_id").agg(F.min("part").alias("p")).where("p <> 1").count() == 0


# -- scalar fields -----------------------------------------------------------------------------------------------


def test_fields(spark):
    L = F.lit
    assert [one(spark, fields.language(L(x))) for x in ("Chinese", "Mandarin", "EN", "xx", " ", None)] == ["zh", "zh", "en", "xx", None, None]
    assert [one(spark, fields.model(L(x))) for x in ("turbo", "Small", "my/model", "")] == ["mlx-community/whisper-large-v3-turbo", "mlx-community/whisper-small-mlx", "my/model", "mlx-community/whisper-large-v3-turbo"]
    assert one(spark, fields.timecode_ms(L("01:02:03.5"))) == 3_723_500 and one(spark, fields.timecode_ms(L("1:2"))) == 0 and one(spark, fields.timecode_ms(L("a:1:2"))) == 0
    assert [one(spark, fields.seconds(L(x))) for x in ("90", "1:30", "1:00:01.5", "1:75", "x", "-1")] == [90.0, 90.0, 3601.5, None, None, None]
    assert one(spark, fields.seconds_text(L(1.5))) == "1.5" and one(spark, fields.seconds_text(L(0.0))) == "0"
    tags = one(spark, fields.tags(L("Book"), F.array(L("Alice"), L(" Bob ")), L("2001"), L("en")))
    assert tags == {"title": "Book", "album": "Book", "artist": "Alice, Bob", "album_artist": "Alice, Bob", "date": "2001", "language": "en"}
    assert one(spark, fields.authors(L("a, b\n ,c"))) == ["a", "b", "c"] and one(spark, fields.year(F.array(L("x"), L("c. 1987-2")))) == "1987"
    assert [one(spark, fields.gender(L(x))) for x in (" Female", "none")] == ["female", None]
    assert [one(spark, fields.voice_name(L(a), L(b))) for a, b in (("x/Lee.WAV", "s"), (None, "d/s.json"), ("", ""))] == ["Lee", "s", "voice"]
    assert [one(spark, fields.cover_extension(L(m), L(h))) for m, h in (("image/PNG", ""), ("", "a/b.JPEG"), ("", "x"))] == [".png", ".jpeg", ".jpg"]
    state = one(spark, fields.playback(F.from_json(L('{"last_played": -1, "furthest_played": 3, "bookmarks": [{"index": 2, "label": "x"}, {"index": -1}, {}]}'), "last_played int, furthest_played int, bookmarks array<struct<index:int,label:string,created_at:bigint>>")))
    assert (state.last_played, state.furthest_played, len(state.bookmarks), state.bookmarks[0].label) == (None, 3, 1, "x")
    assert one(spark, fields.job_stage(L(False), L(1), L(1), L(2))) == "failed" and one(spark, fields.job_stage(L(False), L(0), L(2), L(2))) == "done"
    assert [one(spark, predicates.as_float(L(x))) for x in ("1.5", "nan", "inf", "x")] == [1.5, None, None, None] and [one(spark, predicates.as_int(L(x))) for x in ("12", "12.7", " 3 ")] == [12, None, 3]


def test_text_functions(spark):
    L = F.lit
    assert one(spark, text.title_from_text(L("\n  " + "x" * 50))) == "x" * 40 + "..." and one(spark, text.title_from_text(L(" \n"))) == ""
    assert [one(spark, text.slug_ascii(L(x))) for x in ("The Old Mill!", "目录")] == ["the-old-mill", "chapter"] and one(spark.range(1) and spark, udfs.slug(L("Café Niño"))) == "cafe-nino"
    assert one(spark, text.path_title(L(' a/b: "c"  d. '))) == "a b c d" and one(spark, text.title_from_filename(L("x/01-my_book.txt"))) == "my book" and one(spark, text.markdown_title(L("\n## Head \nx"))) == "Head"
    assert one(spark, text.href_file(L("a%20b+c.x#y"))) == "a b+c.x" and one(spark, text.href_fragment(L("a#x%20y"))) == "x y"
    assert one(spark, text.is_http(L("HTTPS://x.y/z"))) and not one(spark, text.is_http(L("ftp://x"))) and one(spark, text.cache_key(L("http://x/y.mp3?z"))).endswith(".mp3")
    assert one(spark, text.spaces_to_pauses(L("他 走　　了 a b"))) == "他、走。了 a b" and one(spark, text.marked_lines(L("好\n好。 \nab」"))) == "好。\n好。 \nab」。"
    assert one(spark, text.joined_dialogue(L("他说：\n\n「走」\n\n好，\n\n“来”\n\n完"))) == "他说：\n「走」\n\n好，\n“来”\n\n完"
    assert one(spark, text.section_rules(L("a\n\n\n\nb"))) == f"a\n\n{SB}\n\nb" and one(spark, text.clean_normal(L("‘a’ [D]og x-\ny . . ."))) == "'a' Dog x-y ..."
    assert [one(spark, text.gap_pause(L(x))) for x in (f"\n{SB}", "\n" * 5, "\n" * 3, " ")] == [3, 5, 3, 1] and one(spark, text.symbol_gap(L("\n***\n")))
    assert one(spark, predicates.split_series(L("c_split_001.html"))).prefix == "c" and one(spark, predicates.note_marker(L("3a.")))
    assert [one(spark, predicates.structural_title(L(x))) for x in ("第三章 夜", "XIV.", "Preface", "a day", "")] == [True, True, True, False, False]


# -- audio -------------------------------------------------------------------------------------------------------


def test_audio(spark):
    import numpy as np

    rate = 24_000
    tone = np.concatenate([np.zeros(rate), 0.1 * np.sin(2 * np.pi * 220 * np.arange(rate) / rate)]).astype("float32")
    active, peak = audio.active_level(tone, rate)
    assert -25 < active < -21 and -20.5 < peak < -19.5
    a, b = audio.trim_bounds(tone, rate)
    assert abs(a - (rate - rate * 60 // 1000)) <= rate // 50 and b == len(tone) and audio.trim_bounds(np.zeros(5000), rate) == (0, 5000)
    gain = lambda x, y: one(spark, audio.gain_db(F.lit(x), F.lit(y)))
    assert gain(-20.0, -1.0) == -0.5 and abs(gain(-20.0, -4.0) - 1.29) < 0.01 and abs(gain(-18.70, -6.0)) < 0.05 and not one(spark, audio.needs_gain(F.lit(0.04)))
    assert audio.otsu(np.array([])) == -40.0 and audio.otsu(np.ones(3)) == 1.0 and 1 < audio.otsu(np.array([1.0] * 50 + [9.0] * 50)) < 9
    x = F.array(*(F.lit(float(i)) for i in range(5)))
    assert one(spark, audio.frames(x, 2, 2)) == [[0.0, 1.0], [2.0, 3.0]] and one(spark, audio.frames(x, 9, 2)) == [[0.0, 1.0, 2.0, 3.0, 4.0]]
    assert len(one(spark, audio.silence(F.lit(1), F.lit(100)))) == 1 and one(spark, audio.silence(F.lit(0), F.lit(100))) == [] and one(spark, audio.sample_rate(F.lit(0), F.lit(8000))) == 8000
    assert one(spark, audio.cover_gradient(F.array(F.lit(100.0), F.lit(0.0), F.lit(255.0)))).dark == [82, 0, 209]


def test_running_over_many_shares(spark):
    from vellum.operators.running import running

    rng = random.Random(9)
    data = [(None if i % 97 == 0 else "hot" if i % 3 else f"k{i % 7}", rng.randrange(10**9), rng.randrange(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, o long, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.o): (r.s, r.m, r._share) for r in _shares(running(df, ["k"], ["o"], {"s": F.col("v")}, {"m": F.col("v")})).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for key in {k for k, _, _ in data}:
        total, most = 0, None
        for _, o, v in sorted((x for x in data if x[0] == key), key=lambda x: x[1]):
            want[(key, o)] = (total, most)
            total, most = total + v, v if most is None else max(most, v)
    assert {k: v[:2] for k, v in got.items()} == want


def _shares(df):
    return df.withColumn("_share", F.lit(0)) if "_share" not in df.columns else df
