"""Preparation of a chunk for a speech model: forms, figures, quotes, blanks and pauses. Pure functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

from vellum.kernels.chars import CLOSE, END, IS_CHINESE, IS_HAN, MID, SHIELD, is_chinese
from vellum.kernels.numbers import numbers_to_words

# Marks by their role.
DOUBLE = '"“”«»„‟❝❞＂'
SINGLE = "'‘’‚‛＇"
CJK_OPEN = "「『《〈【〔［｢〝"
CJK_CLOSE = "」』》〉】〕］｣〞〟"
TITLE_MARKS = "《》〈〉"
ELISIONS = ("tis", "twas", "twere", "twill", "til", "em", "cause", "bout", "round")
NUMERALS = "零〇一二三四五六七八九十百千万亿兆两"
ELLIPSIS_BASE_MS, ELLIPSIS_STEP_MS, ELLIPSIS_MOST_MS = 380, 120, 1200

DASH_RUN = re.compile("[‐‑‒–—―─━]{2,}")
CJK_QUOTE = re.compile(f"[{re.escape(CJK_OPEN + CJK_CLOSE)}]")
SINGLE_QUOTE = re.compile(f"[{SINGLE}]")
ELISION = re.compile(f"(?:{'|'.join(ELISIONS)})(?![A-Za-z])", re.IGNORECASE)
ANY_QUOTE = re.compile(f"[{re.escape(CJK_OPEN + CJK_CLOSE + DOUBLE + SINGLE)}]")


def nfkc(text: str | None) -> str | None:
    """NFKC, with the ellipsis left as it is."""
    return unicodedata.normalize("NFKC", text.replace("…", SHIELD)).replace(SHIELD, "…") if text else text


def simplified(text: str | None, table: Mapping[int, int]) -> str | None:
    """Traditional characters as simplified ones, by a character table; texts without Han characters stay."""
    return text.translate(table) if text and IS_HAN.search(text) else text


def without_format(text: str) -> str:
    return "".join(c for c in text if unicodedata.category(c) != "Cf")


def without_cjk_quotes(text: str) -> str:
    """Title marks vanish; another closing quote between two Chinese characters leaves a pause."""

    def mark(m: re.Match[str]) -> str:
        if m.group() in TITLE_MARKS or m.group() in CJK_OPEN:
            return ""
        k = m.end()
        while k < len(text) and CJK_QUOTE.match(text, k):
            k += 1
        return "、" if m.start() and is_chinese(text[m.start() - 1]) and is_chinese(text[k : k + 1]) else ""

    return CJK_QUOTE.sub(mark, text)


def without_double_quotes(text: str) -> str:
    return text.translate({ord(c): None for c in DOUBLE})


def without_single_quotes(text: str) -> str:
    """Apostrophes within words, between Chinese characters and before known elisions stay."""

    def mark(m: re.Match[str]) -> str:
        before, after = text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]
        inside = before.isascii() and after.isascii() and before.isalnum() and after.isalnum()
        han = is_chinese(before) and is_chinese(after)
        elided = not before.isalnum() and ELISION.match(text, m.end())
        return m.group() if inside or han or elided else ""

    return SINGLE_QUOTE.sub(mark, text)


def wants_mark(line: str) -> bool:
    """Whether a line ends without any pause mark, closing quotes aside."""
    if not line or line[-1] == "·":
        return False
    core = line.rstrip(CLOSE)
    if line[-1] in END + MID:
        return False
    return not (core and len(core) < len(line) and core[-1] in END + MID)


def marked_lines(text: str) -> str:
    """A full stop after every line of a Chinese text that has no pause mark at its end."""
    if not IS_CHINESE.search(text):
        return text
    out = []
    for line in text.split("\n"):
        body = line.rstrip()
        out.append(body + "。" + line[len(body) :] if body and wants_mark(body) else line)
    return "\n".join(out)


def marked_end(text: str) -> str:
    body = text.rstrip()
    return text + "。" if body and IS_CHINESE.search(text) and wants_mark(body) else text


def spaces_to_pauses(text: str, full_stop: bool = True) -> str:
    """Blanks between Chinese characters as a pause mark: one blank a 、, more a 。; elsewhere one space."""

    def blank(m: re.Match[str]) -> str:
        before, after = text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]
        if is_chinese(before) and is_chinese(after):
            return "。" if full_stop and m.end() - m.start() > 1 else "、"
        return " "

    return re.sub("[ 　]+", blank, text)


def waves(text: str) -> str:
    """Wave dashes: 到 between numerals, a pause where blanks stand beside them between Chinese, else nothing."""
    text = re.sub("[~～〜]+", "~", text)

    def wave(m: re.Match[str]) -> str:
        head, tail = text[: m.start()], text[m.end() :]
        left, right = head.rstrip()[-1:], tail.lstrip()[:1]
        if head[-1:].isspace() or tail[:1].isspace():
            return "、" if is_chinese(left) and is_chinese(right) else ""

        def numeral(c: str) -> bool:
            return bool(c) and (c.isdigit() or c in NUMERALS)

        return "到" if numeral(left) and numeral(right) else ""

    return re.sub("~", wave, text)


def prepared(text: str | None, add_marks: bool = False) -> str:
    """A chunk ready for speech; expects simplified text with its figures in words."""
    if not text:
        return ""
    dashes = DASH_RUN.search(text) is not None
    text = without_format(DASH_RUN.sub(" ", text))
    if add_marks:
        text = marked_lines(text)
    text = without_single_quotes(without_double_quotes(without_cjk_quotes(text)))
    text = waves(re.sub("[…⋯]{3,}", "⋯", text))
    text = spaces_to_pauses(" ".join(text.split()), not dashes)
    return marked_end(text) if add_marks else text


def pipeline(text: str | None, table: Mapping[int, int], add_marks: bool = True) -> tuple[str | None, str | None, str]:
    """(simplified, after numbers, prepared)."""
    plain = simplified(nfkc(text), table)
    words = numbers_to_words(plain)
    return plain, words, prepared(words, add_marks)


def ellipsis_run(text: str | None) -> int:
    """The number of dots of a text that is dots of omission alone, quotes and blanks aside; else 0."""
    bare = ANY_QUOTE.sub("", "".join((text or "").split()))
    return len(bare) if re.fullmatch("[…⋯]+", bare) else 0


def ellipsis_pause(run: int) -> int:
    """Milliseconds of silence for so many dots."""
    return min(ELLIPSIS_MOST_MS, ELLIPSIS_BASE_MS + ELLIPSIS_STEP_MS * (run - 1)) if run > 0 else 0
