"""Readers and sinks on files of their own, and the boundary log as a stream."""

from __future__ import annotations

import io
import json
import wave
import zipfile

from pyspark.sql import functions as F

from vellum import schemas
from vellum.functions import udfs
from vellum.operators import headings, lookups
from vellum.sources import readers, writers
from vellum.streaming import boundaries


def test_texts_and_listing(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.txt").write_bytes("‘a’  b \r\nc \n\n".encode())
    (tmp_path / "b" / "two.txt").write_bytes(b"caf\xe9")
    got = {r.title: r.text for r in readers.texts(spark, str(tmp_path)).collect()}
    assert got == {"one": "‘a’  b \r\nc\n", "two": "caf�\n"}
    assert {r.title: r.text for r in readers.clean_texts(spark, str(tmp_path)).collect()}["one"] == "'a' b\nc\n"
    assert [r.name for r in readers.listing(spark, str(tmp_path), "*.txt").collect()] == ["one.txt", "two.txt"]


def test_json(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\n\nnot json\n[1]\n{"a": 2}\n{"a": "bad"\n')
    assert [(r.a, r.b) for r in readers.json_lines(spark, str(tmp_path / "log.jsonl"), "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"a": 1,\n "b": "y"}')
    (tmp_path / "d" / "b.json").write_text("oops")
    assert sorted((r.a is None, r.b) for r in readers.json_documents(spark, str(tmp_path / "d"), "a int, b string").collect()) == [(False, "y"), (True, None)]


def sound(frames: int, rate: int = 1000, channels: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0\0" * frames * channels)
    return out.getvalue()


def test_segments(spark, tmp_path):
    folder = tmp_path / "segments" / "0001-a"
    folder.mkdir(parents=True)
    for i, data in enumerate((sound(120), sound(0), sound(10, channels=2), b"none"), 1):
        (folder / f"{i:06d}.wav").write_bytes(data)
    got = [(r.chapter_id, r.chunk_idx, r.valid, r.duration_ms) for r in readers.segments(spark, str(tmp_path)).orderBy("chunk_idx").collect()]
    assert got == [("0001-a", 1, True, 120), ("0001-a", 2, False, 0), ("0001-a", 3, False, 10), ("0001-a", 4, False, 0)]


OPF = """<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Dawn</dc:title><dc:creator>Ann</dc:creator><dc:creator>Bob</dc:creator>
<dc:language>en</dc:language><dc:date>c. 1987-03</dc:date><meta name="cover" content="img"/></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>
<item id="c1" href="Text/c%201.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="Text/c2.xhtml" media-type="application/xhtml+xml"/><item id="img" href="i.png" media-type="image/png"/><item id="big" href="b.png" media-type="image/png"/></manifest>
<spine><itemref idref="c1"/><itemref idref="c2"/></spine></package>"""
NAV = """<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="Text/c%201.xhtml">One</a><ol><li><a href="Text/c2.xhtml#x">Two</a></li></ol></li></ol></nav></body></html>"""


def container(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", OPF)
        z.writestr("O/nav.xhtml", NAV)
        z.writestr("O/Text/c 1.xhtml", "<html><body><h1>One</h1><p>First<a href='#n1'>1</a>.</p><p id='n1'>1</p></body></html>")
        z.writestr("O/Text/c2.xhtml", "<html><body><p class='k'>第二章</p><p>Second.</p></body></html>")
        z.writestr("O/i.png", b"12")
        z.writestr("O/b.png", b"123456")


def test_epub(spark, tmp_path):
    from vellum.kernels import epub

    container(tmp_path / "x.epub")
    book = readers.epub_books(spark, str(tmp_path)).first()
    assert (book.title, book.authors, book.language, book.year) == ("Dawn", ["Ann", "Bob"], "en", "1987")
    assert [(c.title, c.href) for c in book.contents] == [("One", "O/Text/c 1.xhtml"), ("Two", "O/Text/c2.xhtml#x")]
    items = readers.epub_items(spark, str(tmp_path)).withColumn("book_id", F.lit("x"))
    spine = items.where("spine_pos IS NOT NULL").cache()
    assert [r.href for r in spine.orderBy("spine_pos").collect()] == ["O/Text/c 1.xhtml", "O/Text/c2.xhtml"]
    pages = spine.select("book_id", "spine_pos", udfs.page("content").alias("p")).select("book_id", "spine_pos", "p.*")
    index = lookups.note_index(pages)
    assert (index.first().note_ids, index.first().note_targets) == ([], ["n1"])
    texts = spine.join(index, "book_id").select("spine_pos", udfs.page_text("content", "note_ids", "note_targets").alias("t"))
    assert {r.spine_pos: r.t for r in texts.collect()} == {0: "One\n\nFirst.", 1: "第二章\n\nSecond."}
    entries = spine.select(F.explode(udfs.page_headings("content", F.array(F.lit("k")), F.array().cast("array<string>"))).alias("h")).select("h.*")
    assert sorted((r.text, r.category) for r in entries.collect()) == [("One", "title"), ("第二章", "section")]
    assert epub.cover((tmp_path / "x.epub").read_bytes())["id"] == "img"
    links = items.where("id = 'nav'").select(F.explode(udfs.page("content")["links"]).alias("l"), F.col("href").alias("base"))
    assert [r.x for r in links.select(udfs.resolved_href("base", "l.href").alias("x")).collect()] == ["O/Text/c 1.xhtml", "O/Text/c2.xhtml"]
    keyed = entries.select(F.lit("x").alias("book_id"), headings.heading_key(F.col("text")).alias("heading_key"), "category")
    assert headings.book_categories(keyed, ["book_id"]).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "c1", 1, "x"), ("b", "c1", 2, "y")], "book_id string, chapter_id string, chunk_idx int, text string")
    writers.table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    try:
        writers.table(df, str(tmp_path / "t"))
        raise AssertionError("an existing table must be an error")
    except Exception as e:
        assert "already exists" in str(e).lower() or "PATH_ALREADY_EXISTS" in str(e)
    writers.table(df.limit(1), str(tmp_path / "t"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    for _ in range(2):
        writers.append_json_lines(df, str(tmp_path / "l"))
    writers.append_json_lines(df.limit(0), str(tmp_path / "none"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4 and not (tmp_path / "none").exists()
    writers.json_documents(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value)["book_id"] == "b"
    writers.chunk_files(df, str(tmp_path / "c"))
    assert sorted(r.file for r in spark.read.json(str(tmp_path / "c")).collect()) == ["000001", "000002"]


def test_stream(spark, tmp_path):
    entry = {"book_id": "b", "from_index": 1, "to_index": 2, "trigger_kind": "", "preloaded": True, "delta_ms": 1.23456, "output_latency_ms": 9000.0, "playback_rate": 0, "captured_unix": 1_690_000_000, "logged_unix": 1_690_000_001}
    bad = {**entry, "from_index": -1}
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(map(json.dumps, [entry, {**entry, "logged_unix": 1_690_000_099}, bad])))
    stream = boundaries.once_each(boundaries.cleaned(boundaries.arriving(spark, str(source)))).drop("captured")
    q = boundaries.sink(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.schema(schemas.BOUNDARY_LOG).json(str(tmp_path / "out")).collect()
    assert len(got) == 1 and (got[0].trigger_kind, got[0].delta_ms, got[0].output_latency_ms, got[0].playback_rate) == ("auto", 1.235, None, 1.0)
    windows = boundaries.by_window(spark.createDataFrame([{**entry, "trigger_kind": "gapless", "playback_rate": 1.0}], schemas.struct(schemas.BOUNDARY_LOG)))
    assert windows.first().n == 1


def test_remote(spark):
    df = spark.createDataFrame([("https://x.y/a.mp3",), ("/tmp/a.mp3",)], "src string")
    assert [r.cache_key[-4:] for r in readers.remote(df, "src").collect()] == [".mp3"]


def book(path, pages, contents, css=""):
    """An EPUB file of pages (name, body) with its contents (title, link)."""
    names = [n for n, _ in pages]
    items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    opf = f'''<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></metadata><manifest>{items}
<item id="css" href="s.css" media-type="text/css"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine>{"".join(f'<itemref idref="i{i}"/>' for i in range(len(names)))}</spine></package>'''
    nav = "".join(f'<li><a href="{h}">{t}</a></li>' for t, h in contents)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", opf)
        z.writestr("s.css", css)
        z.writestr("nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>')
        for n, b in pages:
            z.writestr(n, f'<?xml version="1.0" encoding="utf-8"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{n}</title></head><body>{b}</body></html>')


def test_a_book_from_its_file_to_chapters(spark, tmp_path):
    from vellum.plans import pipeline

    long = "<p>" + "The lamp was lit again. " * 30 + "</p>"
    book(
        tmp_path / "a.epub",
        [
            ("one.xhtml", f'<h1>Dawn</h1><p>It began<a epub:type="noteref" href="back.xhtml#n1">1</a>.</p>{long}'),
            ("one_b.xhtml", f"<p>It went&nbsp;on.</p>{long}"),
            ("two_split_000.xhtml", f"<h1>Noon</h1>{long}"),
            ("two_split_001.xhtml", f"<p class='chaphead'>第二节</p>{long}"),
            ("back.xhtml", '<h2>Notes</h2><p id="n1">A note.</p><p>Other words.</p>'),
        ],
        [("Dawn", "one.xhtml"), ("Noon", "two_split_000.xhtml"), ("Notes", "back.xhtml")],
        ".chaphead {font-weight: bold}",
    )
    book(
        tmp_path / "b.epub",
        [("cover.xhtml", "<p><img alt='Cover' src='x.png'/></p>"), ("c1.xhtml", f"<h1>第一章</h1>{long}"), ("c2.xhtml", f"<h1>第二章</h1>{long}"), ("c3.xhtml", f"<h1>第三章</h1>{long}")],
        [("第一章", "c1.xhtml")],
    )
    got = {}
    for r in pipeline.ingested(spark, str(tmp_path)).orderBy("book_id", "chapter_index").collect():
        got.setdefault(r.book_id[-6:-5], []).append(r)
    a = got["a"]
    assert [(r.chapter_index, r.title, r.source) for r in a] == [(1, "Dawn", "one.xhtml"), (2, "Noon", "two_split_000.xhtml"), (3, "Notes", "back.xhtml")]
    assert "It began." in a[0].text and "It went on." in a[0].text and a[0].headings == ["Dawn"] and a[0].heading_categories == {"Dawn": "title"}
    assert "第二节" in a[1].text and a[1].text.count("lit again") == 60
    assert "A note" not in a[2].text and "Other words" in a[2].text
    assert [r.title for r in got["b"]][-3:] == ["第一章", "第二章", "第三章"]  # the contents name a third of the text only


def test_pages_read_as_xml():
    from vellum.kernels import html

    page = '<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title/></head><body><p>a<span class="x"/>b&nbsp;c</p><P>d</P></body></html>'
    assert html.is_xml(page) and html.to_text(page) == "ab c" + "" or html.xml_tree(page) is not None
    assert [n.name for n in html.tree(page).all()] == ["html", "head", "title", "body", "p", "span", "p"]
    broken = page.replace("</span>", "").replace('<span class="x"/>', '<span class="x">')
    assert html.xml_tree(broken) is None and "ab" in html.to_text(broken)
    assert html.to_text('<html xmlns="x"><body><div epub:type="x">t</div></body></html>') == "t"  # a prefix that is not declared is no XML


def test_structural_titles_agree_with_the_columns(spark):
    from vellum.functions import predicates
    from vellum.kernels import titles

    given = ["第三章", "12", "Ⅳ.", "XIV", "序", "Prologue", "第十回 旧事", "3. Dawn", "Dawn", "", " ", "IV、夜", "附 录", "x" * 90, "第" + "一" * 30 + "章"]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    assert [r.s for r in df.select(predicates.structural_title("t").alias("s")).collect()] == [titles.structural(t) for t in given]


def test_ingest_by_suffix_and_ordered_lines(spark, tmp_path):
    import pytest

    from vellum.operators import timeline
    from vellum.plans import pipeline

    (tmp_path / "one.txt").write_text("a\r\nb\n")
    got = pipeline.ingest(spark, str(tmp_path / "one.txt")).first()
    assert (got.title, got.chapter_index, got.text) == ("one", 1, "a\r\nb\n".replace("\r\n", "\n")) or got.text.startswith("a")
    with pytest.raises(ValueError):
        pipeline.ingest(spark, str(tmp_path / "one.pdf"))
    segments = spark.createDataFrame([("b", i, f"{i:06d}.wav") for i in range(50, 0, -1)], "book_id string, n int, file string")
    writers.lines(timeline.concat_rows(segments, ["book_id"], ["n"], "file"), str(tmp_path / "list"), ["book_id"], ["n"])
    lines = [x for p in sorted((tmp_path / "list").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [f"file '{i:06d}.wav'" for i in range(1, 51)]


def test_voices_and_sound_files(spark, tmp_path):
    from vellum.functions import audio
    from vellum.operators import manifest

    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "ann.json").write_text('{"name": "Ann.wav", "ref_audio": "ann.wav", "ref_text": " hi ", "language": "English", "gender": "Female"}')
    (tmp_path / "v" / "bob.json").write_text('{"ref_audio": "/x/bob.wav", "language": "xx"}')
    (tmp_path / "v" / "cid.json").write_text("oops")
    got = {r.name: r for r in readers.voices(spark, str(tmp_path / "v")).collect()}
    assert got["Ann"].ref_audio.endswith("/v/ann.wav") and (got["Ann"].ref_text, got["Ann"].language, got["Ann"].gender, got["Ann"].problem) == ("hi", "en", "female", None)
    assert (got["bob"].ref_audio, got["bob"].problem) == ("/x/bob.wav", "no_text") and got["cid"].problem == "no_audio"
    writers.voices(readers.voices(spark, str(tmp_path / "v")), str(tmp_path / "out"))
    assert '"language":"en"' in next((tmp_path / "out" / "voice=Ann").glob("part-*")).read_text()

    df = spark.createDataFrame([(1, [0.0, 0.5, -2.0]), (2, None)], "id int, s array<float>")
    wav = {r.id: r.w for r in df.select("id", audio.sound_file("s", F.lit(1000)).alias("w")).collect()}
    assert readers.probe(bytes(wav[1])) == (True, 3) and wav[2] is None
    chunks = spark.createDataFrame([("c", 1, False, 0, 10), ("c", 2, True, 1, 20), ("c", 3, False, 5, 30), ("c", 4, False, 0, 40)], "chapter_id string, chunk_idx int, section_break boolean, pause_multiplier int, duration_ms long")
    chosen = spark.createDataFrame([("c", 1), ("c", 2), ("c", 3)], "chapter_id string, chunk_idx int")
    again = manifest.regenerated(chunks, chosen, ["chapter_id", "chunk_idx"]).orderBy("chunk_idx").collect()
    assert [(r.pause_multiplier, r.duration_ms) for r in again] == [(1, None), (3, None), (5, None), (0, 40)]
