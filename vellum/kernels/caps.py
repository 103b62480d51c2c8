"""Small capitals and all-capital lines in their usual case, guided by the text's own spellings. Pure functions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping

# A word: a letter, then letters, apostrophes and hyphens. Its last alternative is the literal three characters
# (combining grave, hyphen, combining ring), a fixed value of the format, so combining marks do not go on a word.
WORD = re.compile("[^\\W\\d_](?:[^\\W\\d_]|['’\\-]|̀-ͯ)*")
# Words that stay in capitals.
ACRONYMS = frozenset({
    "abc", "bbc", "cbs", "cia", "cnn", "dna", "eu", "fbi", "hiv", "irs", "mlb", "nba", "nfl", "nato", "nasa", "nhl",
    "rna", "uk", "un", "usa",
})
# Words that are small within a title.
STOPWORDS = frozenset({
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "before", "but", "by", "did", "do", "does", "for",
    "from", "had", "has", "have", "he", "her", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its",
    "me", "my", "no", "nor", "not", "of", "on", "or", "our", "ours", "she", "so", "that", "the", "their", "theirs",
    "them", "then", "there", "these", "they", "this", "those", "to", "us", "was", "we", "were", "what", "when", "where",
    "which", "who", "why", "with", "without", "you", "your", "yours",
})
VOWELS = frozenset("aeiouyāīūṛṝḷḹ")
FEWEST, MOST = 2, 6
BLOCK = re.compile(r"\n\s*\n")


def spelling_rank(word: str) -> int:
    """3 for a capital then small letters, 2 for small letters alone, 1 for the rest."""
    if word[:1].isupper() and any(c.islower() for c in word[1:]):
        return 3
    return 2 if word.islower() else 1


def case_map(text: str, context: Iterable[str] = ()) -> dict[str, str]:
    """The leading spelling of each word by its lower-case form; more uses win, then rank, then the first seen."""
    uses: Counter[str] = Counter()
    for source in (text, *context):
        uses.update(w for w in WORD.findall(source) if any(c.islower() for c in w))
    best: dict[str, tuple[tuple[int, int], str]] = {}
    for word, n in uses.items():  # in order of first use
        key, rank = word.lower(), (n, spelling_rank(word))
        if key not in best or rank > best[key][0]:
            best[key] = (rank, word)
    return {k: w for k, (_, w) in best.items()}


def titled(word: str) -> str:
    """Each part between hyphens and apostrophes with a capital first letter."""
    return re.sub(r"[^\-'’]+", lambda m: m.group()[0].upper() + m.group()[1:].lower(), word)


def keeps_capitals(word: str) -> bool:
    """A word of capitals that is no word in capitals: an abbreviation (known, short, or of four letters none of which is a vowel) or a Roman numeral."""
    low = word.lower()
    if low in ACRONYMS or not set(word) - set("IVXLCDM"):
        return True
    vowels = sum(c in VOWELS for c in low)
    return len(word) < 4 or (len(word) == 4 and vowels == 0)


def recased(word: str, known: Mapping[str, str], first: bool, as_title: bool, small: bool = False) -> str:
    """One word of a run in capitals. ``small`` is the small-capitals rule, whose stopwords take one capital only."""
    low = word.lower()
    if low in known:
        found = known[low]
        return found.capitalize() if first and found.islower() else found
    if low in STOPWORDS:
        return (low.capitalize() if small else titled(word)) if first else low
    if keeps_capitals(word):
        return word
    return titled(word) if first or as_title else low


def all_capitals(word: str) -> bool:
    letters = [c for c in word if c.isalpha()]
    return bool(letters) and all(c.isupper() for c in letters)


def small_caps(text: str | None, context: Iterable[str] = ()) -> str | None:
    """Paragraphs that begin with two to six words in capitals before running text, in their usual case."""
    if not text:
        return text
    known = case_map(text, context)

    def block(b: str) -> str:
        if not re.search("[a-z]", b):
            return b
        words = list(WORD.finditer(b))
        run = 0
        while run < min(MOST, len(words)) and all_capitals(words[run].group()):
            run += 1
        if run < FEWEST or run >= len(words) or not any(c.islower() for c in words[run].group()):
            return b
        if not any(w.group().lower() in known or w.group().lower() in STOPWORDS for w in words[:run]):
            return b
        count = iter(range(run))
        return WORD.sub(lambda m: recased(m.group(), known, next(count) == 0, False, True), b, count=run)

    return "\n\n".join(map(block, BLOCK.split(text)))


def heading_form(line: str) -> str:
    return " ".join(line.split()).casefold()


def all_caps(text: str | None, context: Iterable[str] = (), headings: Iterable[str] = ()) -> str | None:
    """Lines in capitals: title case for known headings, else sentence case that starts anew after . ! ?"""
    if not text:
        return text
    known = case_map(text, context)
    titles = {heading_form(h) for h in headings if h} - {""}

    def line(x: str) -> str:
        if any(c.islower() for c in x) or not any(c.isupper() for c in x):
            return x
        as_title = heading_form(x) in titles
        end, first = 0, True

        def word(m: re.Match[str]) -> str:
            nonlocal end, first
            if end:
                first = not as_title and re.search("[.!?]", x[end : m.start()]) is not None
            end = m.end()
            return recased(m.group(), known, first, as_title)

        return WORD.sub(word, x)

    return "\n\n".join("\n".join(map(line, b.split("\n"))) for b in BLOCK.split(text))
