"""Word tokens and shingles of texts as hashes, for whole Arrow batches at once.

A token is a run of letters and digits of a script that writes blanks, or a single character of one that does not.
Case, width, letter shape, accents, traditional against simplified form, marks, blanks and what cannot be seen do
not count. A shingle is five words; five words of a script without blanks are taken as eight of its characters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

from vellum.llm.look import ALIKE, SEVERAL

WORDS, CHARACTERS = 5, 8
DROP, PART = 0, 1
END = 0xFDD0  # a noncharacter between texts
B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEVERAL = {ord(x[0]): x[2:] for x in SEVERAL if x[2:].isalnum()}
_HAS_SEVERAL = re.compile("[" + "".join(map(chr, _SEVERAL)) + "]")


@cache
def _plain() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane its token letter (0: dropped, 1: parts), and whether it is a token alone."""
    alike = {x[0]: x[1] for x in ALIKE}
    out = np.ones(0x10000, "uint32")
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000 or code == END:
            continue
        c = chr(code)
        c = alike.get(c, c)
        first = unicodedata.normalize("NFKD", c)[0]
        first = alike.get(first, first).casefold()[0]
        kind = unicodedata.category(first)
        if kind[0] in "LN":
            out[code] = ord(first)
        elif kind in ("Mn", "Me", "Cf", "Cc", "Sk") and c not in "\t\n\r\x0b\x0c\x85" or c in "'’ʼ`´":
            out[code] = DROP
        elif kind == "Mc":
            out[code] = ord(first)
    alone = np.zeros(0x10000, bool)
    for a, b in ((0x0900, 0x10A0), (0x1780, 0x1800), (0x2E80, 0xFB00)):
        alone[a:b] = True
    return out, alone


def letters(simplify: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The tables of ``_plain`` with traditional characters mapped to simplified ones."""
    out, alone = _plain()
    out = out.copy()
    for a, b in simplify.items():
        out[out == a] = b
    return out, alone


def simplified(spark) -> dict[int, int]:
    """Traditional to simplified, character by character, by the transliterator that ships with Spark."""
    icu = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    chars = "".join(map(chr, [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)]))
    return {ord(a): ord(b) for a, b in zip(chars, icu.transliterate(chars)) if a != b}


def tokens(texts: list[str | None], tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, whether it is a character alone, the index of the text it is of), in order."""
    plain, alone = tables
    big = "﷐".join(t.replace("﷐", "") if t else "" for t in texts)
    big = _HAS_SEVERAL.sub(lambda m: _SEVERAL[ord(m.group())], big)
    raw = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = raw == END
    low = np.minimum(raw, 0xFFFF)
    code = plain[low]
    single = alone[low] & (code > 1)
    beyond = raw > 0xFFFF
    if beyond.any():
        code = np.where(beyond, raw, code)
        single |= beyond
    text = np.cumsum(ends)
    keep = (code != DROP) | ends
    code, single, ends, text = code[keep], single[keep], ends[keep], text[keep]
    word = (code > 1) & ~ends
    # a token starts at every single character, and at a word letter after none
    before = np.concatenate([[False], word[:-1] & ~single[:-1]])
    start = word & (single | ~before)
    first = np.flatnonzero(start)
    if not len(first):
        return np.zeros(0, "uint64"), np.zeros(0, bool), np.zeros(0, "int64")
    stop = word & (single | ~np.concatenate([(word[1:] & ~single[1:]), [False]]))
    last = np.flatnonzero(stop) + 1
    with np.errstate(over="ignore"):
        size = last - first
        # letters are weighted by their place in the word, up to any length, by a running sum over powers
        mixed = (code.astype("uint64") + np.uint64(1)) * C
        mixed ^= mixed >> np.uint64(29)
        at = np.zeros(len(code), "int64")
        at[first] = 1
        owner = np.cumsum(at) - 1
        place = (np.arange(len(code)) - first[np.maximum(owner, 0)]).astype("uint64")
        term = mixed * ((place * np.uint64(2) + np.uint64(1)) * B ^ (place << np.uint64(7)))
        term[~word] = 0
        total = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype="uint64")])
        token = total[last] - total[first]
        token = (token ^ (token >> np.uint64(31))) * B + size.astype("uint64")
    return token, single[first], text[first]


def shingles(token: np.ndarray, single: np.ndarray, text: np.ndarray, widths: tuple[tuple[int, bool], ...] = ((WORDS, False), (CHARACTERS, True))) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of its first token, size in tokens, index of its text) of every shingle; none crosses a text's end.

    ``widths`` names sizes, each with whether it is for shingles that begin with a character that is a token alone."""
    n = len(token)
    hashes, starts, sizes = [], [], []
    with np.errstate(over="ignore"):
        for k, of_single in widths:
            if n < k:
                continue
            at = np.flatnonzero((single[: n - k + 1] == of_single) & (text[: n - k + 1] == text[k - 1 :]))
            h = np.zeros(len(at), "uint64")
            for j in range(k):
                h = h * C + token[at + j]
                h ^= h >> np.uint64(32)
            hashes.append(h * B)
            starts.append(at)
            sizes.append(np.full(len(at), k))
    if not hashes:
        none = np.zeros(0, "int64")
        return np.zeros(0, "uint64"), none, none, none
    h, s, z = np.concatenate(hashes), np.concatenate(starts), np.concatenate(sizes)
    order = np.argsort(s, kind="stable")
    h, s, z = h[order], s[order], z[order]
    return h, s, z, text[s]
