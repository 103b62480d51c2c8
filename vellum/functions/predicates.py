"""Tests on titles, headings, lines and scalars as native Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from vellum.functions.text import BLANK, C, col, compact, re, rstrip, spaced, strip
from vellum.kernels.chars import JAVA_CHINESE, JAVA_HAN, SB

#: Java flags under which a pattern reads as its authors meant it: case, lines ended by LF alone, Unicode classes.
FLAGS = "(?iumdU)"

# Title patterns of chapters that are dropped, in order.
DROP_TITLES = (
    r"^目录$",
    r"^目錄$",
    r"^封面$",
    r"^封底$",
    r"^扉页$",
    r"^扉頁$",
    r"^版权$",
    r"^版權$",
    r"^版权信息$",
    r"^版權資訊$",
    r"^版權信息$",
    r"^版权页$",
    r"^版權頁$",
    r"^作者简介$",
    r"^作者簡介$",
    r"^广告$",
    r"^廣告$",
    r"^内容简介$",
    r"^內容簡介$",
    r"^出版信息$",
    r"^出版資訊$",
)
# Headings from which a chapter is cut off, in order.
CUTOFFS = (
    r"^\s*参考文献\s*$",
    r"^\s*參考文獻\s*$",
    r"^\s*索引\s*$",
    r"^\s*注释\s*$",
    r"^\s*注釋\s*$",
    r"^\s*脚注\s*$",
    r"^\s*腳註\s*$",
    r"^\s*引用文献\s*$",
    r"^\s*引用文獻\s*$",
)
# Titles of pages without content.
NON_CONTENT = [
    "封面", "封底", "目录", "目錄", "版权", "版權", "版权页", "版權頁", "版权信息", "版權資訊", "版權信息", "扉页", "扉頁", "contents", "toc", "cover",
    "copyright",
]
# Terms that are headings by themselves.
STRUCTURAL = [
    "prologue", "epilogue", "postscript", "interlude", "preface", "afterword", "introduction", "序", "序章", "序言", "序曲",
    "自序", "代序", "前言", "引言", "引子", "楔子", "导言", "導言", "导读", "導讀", "尾声", "尾聲", "终章", "終章", "结语", "結語", "结束语", "結束語", "后记",
    "後記", "跋", "番外", "附录", "附錄",
]
UNITS = "章節节話话部卷巻回篇編编集幕讲講"
NUMERALS = "0-9０-９一二三四五六七八九十百千〇零两兩"
ROMAN = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ"
DOT = "[.)．、]"


def first_match(c: C, patterns: list[str] | tuple[str, ...]) -> Column:
    """The first pattern in list order that is found in the text, or an empty string."""
    hits = (F.when(F.coalesce(col(c), F.lit("")).rlike(FLAGS + p), F.lit(p)) for p in patterns)
    return F.coalesce(*hits, F.lit(""))


def drop_reason(title: C, patterns: tuple[str, ...] = DROP_TITLES) -> Column:
    return first_match(title, patterns)


def non_content(title: C) -> Column:
    """A title of a page without content; an empty title is one."""
    t = F.lower(spaced(F.coalesce(col(title), F.lit(""))))
    return (t == "") | t.isin(*NON_CONTENT)


def filename_like(title: C, href: C) -> Column:
    """Whether a title is only its file's name."""
    t = strip(F.coalesce(col(title), F.lit("")))
    name = re(F.coalesce(col(href), F.lit("")), "^.*/", "")
    stem = re(name, r"(?<=.)\.[^.]*$", "")
    return (t == "") | (t == F.coalesce(col(href), F.lit(""))) | (t == name) | (F.lower(t) == F.lower(stem)) | F.lower(t).rlike(r"\.x?html$|^[a-z]\d+[a-z0-9]*$")


def short_structural(c: C) -> Column:
    """A short label such as 第三章, a bare number or a Roman numeral."""
    x, bare = spaced(c), compact(c)
    pattern = f"^(?:第?[{NUMERALS}]+[{UNITS}]?|[{NUMERALS}]+{DOT}?|[{ROMAN}]+{DOT}?|[IVXLCDM]+{DOT}?)$"
    return (x != "") & (F.char_length(x) <= 40) & (F.char_length(bare) <= 20) & bare.rlike(pattern)


def structural_term(c: C) -> Column:
    return F.lower(spaced(c)).isin(*STRUCTURAL) | F.lower(compact(c)).isin(*STRUCTURAL)


def structural_title(c: C) -> Column:
    """A title that begins as the headings of parts do."""
    bare = compact(c)
    head = f"^(?:第?[{NUMERALS}]+[{UNITS}]|[{NUMERALS}]+(?:[{UNITS}]|{DOT})|[{ROMAN}IVXLCDM]+(?:[{UNITS}]|{DOT}))"
    return short_structural(c) | structural_term(c) | ((bare != "") & (F.char_length(bare) <= 80) & bare.rlike(head))


def heading_marker(c: C) -> Column:
    """Whether a class or id names headings."""
    x = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    return x.rlike("title|chapter|section|headline|heading") | x.rlike("(^|[-_])(ttl|hd)([-_0-9]|$)")


def note_marker(c: C) -> Column:
    return strip(F.coalesce(col(c), F.lit(""))).rlike(r"(?i)^\d{1,4}[a-z]?[.)]?$")


def lines(c: C) -> Column:
    """The lines that are not blank, blanks off their ends."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "\r\n|[\n\r]", -1), strip), lambda x: x != "")


def title_only(title: C, text: C) -> Column:
    """Whether a chapter is its title alone: one line of at most 80 characters, equal to it."""
    found = lines(text)
    one = F.get(found, 0)
    return (F.size(found) == 1) & (F.char_length(one) <= 80) & (spaced(one) == spaced(title))


def has_chinese(c: C) -> Column:
    return col(c).rlike(f"[{JAVA_CHINESE}]")


def has_han(c: C) -> Column:
    return col(c).rlike(f"[{JAVA_HAN}]")


def span_content(c: C) -> Column:
    """Whether a span holds a Chinese character, a figure or an ASCII letter."""
    return col(c).rlike(rf"[{JAVA_CHINESE}\p{{Nd}}A-Za-z]")


def _unclosed(c: C) -> Column:
    """A text without blanks and closing quotes at its end."""
    return re(rstrip(c), "[」』）】\\]〉》”’\"']+\\z", "")


def ends_sentence(c: C) -> Column:
    return _unclosed(c).rlike(r"[。！？?!…]\z")


def ends_open(c: C) -> Column:
    return _unclosed(c).rlike(r"[、，,;；:：—―─━…⋯]\z")


def same_paragraph(gap: C) -> Column:
    return ~col(gap).rlike(f"[\n{SB}]")


def hard_boundary(gap: C, before: C) -> Column:
    """A gap no chunk reaches over: a line end or section break, or blanks after an unpunctuated span."""
    g = col(gap)
    return g.rlike(f"[\n{SB}]") | ((g != "") & g.rlike(f"^{BLANK}*$") & ~ends_sentence(before))


def capitals(c: C) -> Column:
    """Whether a line has capitals and no small letter."""
    return col(c).rlike(r"\p{Lu}") & ~col(c).rlike(r"\p{Ll}")


def symbol_line(c: C) -> Column:
    """A line of symbols alone."""
    return col(c).rlike(rf"^[^\p{{L}}\p{{N}}\p{{M}}{SB}]+$") & (compact(c) != "")


def bracketed(c: C) -> Column:
    return col(c).rlike(r"[\p{Ps}\p{Pe}\p{Pi}\p{Pf}]")


def as_float(c: C) -> Column:
    """A finite number, else null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def as_int(c: C) -> Column:
    """A whole number: the integer part of a JSON number; text must be whole already."""
    text = strip(col(c).cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))


def split_series(href: C) -> Column:
    """(prefix, extension) of a file that is one part of a series, else null."""
    pattern = r"(?i)^(.*)(?:_split_|-split-)\d+(\.[^.]+)$"
    prefix, ext = (F.regexp_extract(col(href), pattern, i) for i in (1, 2))
    return F.when(ext != "", F.struct(prefix.alias("prefix"), ext.alias("ext")))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
