"""The pure kernels as Arrow functions. Each returns all that one pass over its text gives, as one struct or array."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession

from vellum.functions.arrow import arrow_udf
from vellum.kernels import caps, chunker, html, numbers, sections, speech, titles
from vellum.schemas import CHUNK, SPAN


def hanzi_table(spark: SparkSession) -> dict[int, int]:
    """Traditional to simplified, character by character, by the transliterator that ships with Spark (bounded by the script)."""
    icu = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    chars = "".join(map(chr, [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)]))
    return {ord(a): ord(b) for a, b in zip(chars, icu.transliterate(chars)) if a != b}


def over(schema: str, f):
    """A pandas UDF of a function of one value; null stays null."""
    
    @arrow_udf(schema)
    def g(s: pd.Series) -> pd.Series:
        return s.map(lambda v: f(v) if v is not None else None)

    return g


@arrow_udf(SPAN)
def sentence_spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": a, "end": b} for a, b in chunker.sentence_spans(t)] if t is not None else None)


def chunk_spans(most: int = 100, least: int = 15):
    """The chunks of a chapter as spans."""

    @arrow_udf(SPAN)
    def f(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"start": a, "end": b} for a, b in chunker.chunk_spans(t, most, least)] if t is not None else None)

    return f


def chunked(text: str | None, headings, categories, most: int, least: int) -> list[dict]:
    spans = chunker.chunk_spans(text, most, least)
    known = dict(categories) if categories is not None else {}
    rests = chunker.pauses(text or "", spans, list(headings) if headings is not None else (), known)
    breaks = chunker.section_breaks(text or "", spans)
    return [
        {"start": a, "end": b, "text": (sections.without_section_breaks(text[a:b]) or "").strip(), "section_break": s, "pause": p}
        for (a, b), p, s in zip(spans, rests, breaks)
    ]


def chapter_chunks(most: int = 100, least: int = 15):
    """A chapter in its speech form with its chunks, section breaks and pauses, from (text, headings, heading categories)."""

    @arrow_udf(f"text string, chunks {CHUNK}", once=True)
    def f(text: pd.Series, headings: pd.Series, categories: pd.Series) -> pd.DataFrame:
        forms = text.map(sections.speech_form)
        return pd.DataFrame({"text": forms, "chunks": [chunked(t, h, c, most, least) for t, h, c in zip(forms, headings, categories)]})

    return f


@arrow_udf("string")
def clean_form(text: pd.Series) -> pd.Series:
    return text.map(sections.clean_form)


@arrow_udf("string")
def page_form(text: pd.Series) -> pd.Series:
    return text.map(sections.page_form)


@arrow_udf("string")
def speech_form(text: pd.Series) -> pd.Series:
    return text.map(sections.speech_form)


@arrow_udf("string")
def section_breaks(text: pd.Series) -> pd.Series:
    return text.map(sections.with_section_breaks)


@arrow_udf("array<string>")
def section_marks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sorted(sections.section_marks(t)) if t is not None else None)


@arrow_udf("string")
def numbers_to_words(text: pd.Series) -> pd.Series:
    return text.map(numbers.numbers_to_words)


@arrow_udf("string")
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(speech.nfkc)


@arrow_udf("string")
def slug(text: pd.Series) -> pd.Series:
    """A slug with accents resolved (NFKD) before other characters go."""
    import unicodedata

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
        return re.sub("[^a-z0-9]+", "-", plain).strip("-")[:60] or "chapter"

    return text.map(one)


def simplified(table: dict[int, int]):
    return over("string", lambda t: speech.simplified(t, table))


def speech_pipeline(table: dict[int, int], add_marks: bool = True):
    """(simplified, after_numbers, prepared) of each chunk."""

    @arrow_udf("simplified string, after_numbers string, prepared string", once=True)
    def f(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([speech.pipeline(t, table, add_marks) for t in text], columns=["simplified", "after_numbers", "prepared"])

    return f


@arrow_udf("map<string,string>")
def case_map(text: pd.Series, context: pd.Series) -> pd.Series:
    return pd.Series([caps.case_map(t or "", [w for w in (c if c is not None else ()) if w]) for t, c in zip(text, context)], dtype=object)


@arrow_udf("string")
def repaired_case(text: pd.Series, context: pd.Series, headings: pd.Series) -> pd.Series:
    """Small capitals, then lines in capitals, in their usual case."""

    def one(t, c, h):
        c = [w for w in (c if c is not None else ()) if w]
        return caps.all_caps(caps.small_caps(t, c), c, list(h) if h is not None else ())

    return pd.Series([one(*x) for x in zip(text, context, headings)], dtype=object)


def cleaned(removals: list[str], cutoffs: list[str]):
    """One chapter through the cleaning steps: (text, cutoff reason, removals of each pattern) from (text, context, headings)."""

    @arrow_udf("text string, cutoff string, removed map<string,int>", once=True)
    def f(text: pd.Series, context: pd.Series, headings: pd.Series) -> pd.DataFrame:
        cut = [re.compile(p, re.I | re.M) for p in cutoffs]
        gone = [re.compile(p, re.I | re.M) for p in removals]
        out = []
        for t, c, h in zip(text, context, headings):
            if t is None:
                out.append((None, "", {}))
                continue
            kept, why = sections.cut_after(sections.clean_form(t), cut)
            kept, counts = sections.removed(kept, gone)
            words = [w for w in (c if c is not None else ()) if w]
            kept = caps.all_caps(caps.small_caps(sections.clean_form(kept), words), words, list(h) if h is not None else ())
            out.append((kept, why, counts))
        return pd.DataFrame(out, columns=["text", "cutoff", "removed"])

    return f


@arrow_udf("text string, title string, headings array<struct<text:string,category:string>>, links array<struct<href:string,label:string>>, note_ids array<string>, note_targets array<string>", once=True)
def page(content: pd.Series) -> pd.DataFrame:
    """All that is taken from a page by itself: parsed once for each part, none of them kept across rows."""
    out = []
    for data in content:
        notes, targets = html.note_ids(data)
        out.append((
            html.to_text(data), html.page_title(data), [{"text": t, "category": c} for t, c in html.headings(data)],
            [{"href": h, "label": t} for h, t in html.links(data)], notes, targets,
        ))
    return pd.DataFrame(out, columns=["text", "title", "headings", "links", "note_ids", "note_targets"])


PAGE_FACTS = "title string, links array<struct<href:string,label:string>>, note_ids array<string>, note_targets array<string>, hits array<struct<class:string,uses:int,hits:int>>"


@arrow_udf(PAGE_FACTS, once=True)
def page_facts(content: pd.Series) -> pd.DataFrame:
    """What a page tells of its book: its title, links, notes, and how often its classes are on headings."""
    out = []
    for data in content:
        notes, targets = html.note_ids(data)
        hits = [{"class": c, "uses": n, "hits": k} for c, n, k in html.class_heading_hits(data, titles.structural)]
        out.append((html.page_title(data), [{"href": h, "label": t} for h, t in html.links(data)], notes, targets, hits))
    return pd.DataFrame(out, columns=["title", "links", "note_ids", "note_targets", "hits"])


@arrow_udf("classes array<string>, ids array<string>", once=True)
def style_markers(content: pd.Series) -> pd.DataFrame:
    """Classes and ids of a style sheet that are named as headings are."""
    return pd.DataFrame([html.css_markers(bytes(b) if b is not None else None) for b in content], columns=["classes", "ids"])


@arrow_udf("string")
def page_text(content: pd.Series, notes: pd.Series, targets: pd.Series) -> pd.Series:
    """The text of a page given its book's note ids."""
    as_set = lambda x: set(x) if x is not None else set()
    return pd.Series([html.to_text(d, as_set(n), as_set(t)) if d is not None else None for d, n, t in zip(content, notes, targets)], dtype=object)


@arrow_udf("array<struct<text:string,category:string>>")
def page_headings(content: pd.Series, classes: pd.Series, ids: pd.Series) -> pd.Series:
    as_set = lambda x: set(x) if x is not None else set()
    return pd.Series([[{"text": t, "category": k} for t, k in html.headings(d, as_set(c), as_set(i))] for d, c, i in zip(content, classes, ids)], dtype=object)


@arrow_udf("string")
def resolved_href(base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([html.resolved(b, t) for b, t in zip(base, target)], dtype=object)


def json_object(c: Column | str, schema: str) -> Column:
    """A JSON document by schema; what is malformed or no object gives null."""
    from pyspark.sql import functions as F

    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def to_json_text(value) -> str:
    return json.dumps(value, ensure_ascii=False)
