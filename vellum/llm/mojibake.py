"""Problem 5: text that was decoded with the wrong character encoding.

A line is repaired by a round trip: its text is encoded again under a candidate encoding it may have been read
with, and strictly decoded as the encoding it may have been written in. What neither can express (replacement
marks, characters lost in between) parts the line into stretches that are tried one by one; a broken character at
a stretch's edge stays as it is. The repair is taken when a garbling cost falls far enough, and tried again on its
result until the cost falls no more, so that nested layers come off one after the other, however many.

The garbling cost of a text counts what sound text hardly holds: control and replacement characters, runs of
accented letters and symbols, mixed scripts' rarest letters, and Han characters outside the common levels of the
national character sets (the levels themselves come from the codecs). UTF-8 proves itself by its strictness. Nearly
any bytes are text of some legacy encoding, so there all candidates are compared by ``bits``: what their characters
would take to write down under plain letter frequencies of their scripts. Neither has statistics of the corpus, so
a row's result never depends on other rows.

Defined cases: null, empty and blank texts are sound; lines are judged alone, and a row is garbled when any of its
lines is; a garbled stretch within a sound line is judged by itself; a short quoted example (at most ``quoted``
characters, ``QUOTED`` unless given) within an otherwise sound line is no case; a line
with replacement characters that no round trip restores is garbled and keeps its text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.session import spread

#: Encodings a text may have been read with by mistake: one byte a character, then several bytes.
READ_ONE = ("latin-1", "cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp1250")
READ_MANY = ("gb18030", "big5hkscs", "cp950", "cp932", "cp949", "euc_jp")
#: Encodings a text may have been written in.
WRITTEN = ("utf-8", "gb18030", "big5hkscs", "cp932", "euc_jp", "cp949", "cp1251", "koi8_r", "cp874", "cp1253", "cp1252")
#: Of these those of one byte a character.
WRITTEN_ONE = ("cp1251", "koi8_r", "cp874", "cp1253", "cp1252")
#: A quoted example holds at most so many characters, unless the caller says otherwise.
QUOTED = 8
#: A reading as a one-byte encoding must take at most this part of the bits the text takes as it stands.
CHEAPER = 0.75
#: What the bits of a reading count for where a longer line of the text was read so.
HINTED = 0.7
LINE = re.compile("[^\n]+")
#: What one-byte encodings hold, within a line of a script that they do not; what may stand around it in sound text.
NARROW = re.compile("[\x00-\u08ff\u2000-\u27bf\uf8ff\ufb01\ufb02]+")
AROUND = " \t\r“”‘’—–…·"
#: Letters torn from their bytes; rows of symbols, currencies and the like have none, and are garbled only if a round trip gives text.
BROKEN = re.compile("[\x7f-\x9f]|[À-ÖØ-öø-ÿŒœŠšŽžŸЀ-џ][^\\w\\s,.;:!?'\")\\]’”—…]")
#: Odd characters of such a script with at most so many others between them are one stretch; so many may be added at its ends.
BETWEEN, BESIDE = 2, 2


@cache
def example(quoted: int) -> re.Pattern:
    """A short quotation."""
    return re.compile("[“\"‘「『«《][^“”\"‘’「」『』«»《》\n]{0,%d}[”\"’」』»》]" % quoted)


@cache
def common_han() -> frozenset[str]:
    """Han characters of the first levels of GB 2312, Big5 and JIS X 0208."""
    out = set()
    for codec, leads, trails in (
        ("gb2312", range(0xB0, 0xD8), range(0xA1, 0xFF)),
        ("big5", range(0xA4, 0xC7), [*range(0x40, 0x7F), *range(0xA1, 0xFF)]),
        ("cp932", range(0x88, 0x99), [*range(0x40, 0x7F), *range(0x80, 0xFD)]),
    ):
        for a in leads:
            for b in trails:
                try:
                    out.add(bytes((a, b)).decode(codec))
                except UnicodeDecodeError:
                    pass
    return frozenset(c for c in out if "一" <= c <= "鿿")


@cache
def second_han() -> frozenset[str]:
    """Han characters of any level of those sets."""
    out = set()
    for codec, leads in (("gb2312", range(0xD8, 0xF8)), ("big5", range(0xC9, 0xFA)), ("cp932", [*range(0x98, 0xA0), *range(0xE0, 0xEB)])):
        for a in leads:
            for b in range(0x40, 0xFF):
                try:
                    out.add(bytes((a, b)).decode(codec))
                except UnicodeDecodeError:
                    pass
    return frozenset(c for c in out if "一" <= c <= "鿿") - common_han()


def char_class(chars: set[int] | list[int]) -> str:
    """A character class of code points, as ranges."""
    out, run = [], []
    for code in [*sorted(chars), -1]:
        if run and code != run[-1] + 1:
            out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
            run = []
        run.append(code)
    return "".join(out)


# What one character adds to the garbling cost, by character class.
WEIGHTS = (
    ("[\ue000-\uf8ff\x00-\x08\x0e-\x1f\x7f-\x9f�]", 2.0),
    ("[¢-¦¨-ª¬®¯±´¶¸º¼-¾]", 1.0),
    ("[€‚ƒ„†‡ˆ‰‹›™˜•]", 0.7),
    ("[ЂЃЉЊЌЋЏђѓљњќћџЎўЈҐґЄєЇ]", 0.8),
    ("[⌐-⑟─-▟]", 1.5),
    ("[∀-⋿⁄ﬁﬂ◊₧]", 1.0),
    ("[｡-ﾟ]", 0.7),
    ("[ㄅ-ㄯ﹐-﹫㈠-㋿㌀-㏿]", 1.0),
)
#: Within a word in small Latin letters: an accented capital, or a letter of another alphabet that is drawn like none of them.
IN_WORD = re.compile("(?<=[a-z])(?:[À-ÖØ-Þ]|[ΓΔΘΛΞΠΣΦΨΩδθλμξπσφψωБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯбвгджзийлмнптфцчшщъыьэюя])(?=[a-z])")
#: What adds to it beside its neighbours only, looked at where such letters stand at all.
NEIGHBOURS = (
    (re.compile("[À-ÖØ-öø-ÿŒœŠšŽžŸ×÷¡-¿]{2,}"), 0.7),
    (re.compile("[¡¿](?![A-ZÀ-Þ])"), 1.0),
    (re.compile("(?<=[À-ÿΑ-ωА-яЂ-џ])[§°«»·±µ\xa0\xad“”‘’–—…•†‡]"), 0.5),
    (re.compile("(?<=[а-яё])[А-ЯЁ]"), 0.8),
    (re.compile("(?<=[^\x00-\x7fΆ-ώ’])[Ά-ώ]|[Ά-ώ](?=[^\x00-\x7fΆ-ώ’])"), 0.5),
    (re.compile("[가-힣](?=[^\x00-\x7f가-힣])|(?<=[^\x00-\x7f가-힣])[가-힣]"), 0.7),
    (re.compile("(?<=[一-鿿])[À-ÿ](?=[一-鿿])"), 0.7),
    (IN_WORD, 0.8),
)
HAN = re.compile("[㐀-鿿]+")
#: Letters that no one-byte encoding here holds.
WIDE = re.compile("[ऀ-\u1fff⺀-\ud7ff]")
NEAR = re.compile("[¡-ÿŒœŠšŽžŸΆ-ώЀ-џ가-힣]")

_weights: dict[str, float] = {}


def weight(c: str) -> float:
    """What one character adds, whatever stands beside it."""
    known = _weights.get(c)
    if known is None:
        known = next((w for k, w in WEIGHTS if re.match(k, c)), 0.0)
        if "一" <= c <= "鿿" or "㐀" <= c <= "䶿":
            known = 0.0 if c in common_han() else 0.7 if c in second_han() else 1.5
        _weights[c] = known
    return known


def cost(text: str) -> float:
    """The garbling cost."""
    if text.isascii():
        return 0.0
    total = 0.0
    known = _weights
    for c, n in Counter(text).items():
        w = known.get(c)
        total += n * (weight(c) if w is None else w)
    if NEAR.search(text):
        for pattern, w in NEIGHBOURS:
            for m in pattern.finditer(text):
                total += w * (m.end() - m.start())
    return total


@cache
def odd() -> re.Pattern:
    """A character that costs by itself."""
    common = common_han()
    rare = [c for c in [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)] if chr(c) not in common]
    return re.compile("[" + "".join(k[1:-1] for k, _ in WEIGHTS) + char_class(rare) + "]")


def suspicious(text: str) -> bool:
    """Whether anything in the text costs; all else is sound."""
    return odd().search(text) is not None or (NEAR.search(text) is not None and any(p.search(text) for p, _ in NEIGHBOURS))


# The most frequent Han characters, and letters from the most frequent on: Russian, Greek, Thai, and the three parts of a Hangul
# syllable in the order of Unicode with their bits.
OFTEN_HAN = frozenset(
    "的一是不了在人有我他这這来來个個们們到说說为為子和你地出道也时時年得就那要下以生会會自着著去之过過家学學对對可她里裡裏后後小么麼心多天而能好都然没沒日于於起还還发發成事只作当當想看文无無开開手用主行方又如前所本见見经經头頭面起"
    "公同三已老从從动動两兩长長知门門样樣今回书書声聲水话話走上中大国國点點问問"
)
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфёъ"
GREEK = "αοιετσνηυρπκμλςωγδχθφβξζψάέήίόύώϊϋ"
THAI = "ารนกเงอมย่้ลวดทิสตัะปีบคุหแจพชขใไ์โูผื็ซถณธำศึษฟญฐภฝๆ๊ฬฆฎฏฑฒฌฮ๋ฯ"
_PLACE = {c: first + 0.16 * i for letters, first in ((RUSSIAN, 3.0), (GREEK, 3.5), (THAI, 3.0)) for i, c in enumerate(letters)}
HANGUL_FIRST = (3.0, 7.0, 3.6, 3.3, 7.0, 3.8, 4.0, 4.2, 7.0, 3.3, 7.0, 2.2, 3.6, 7.0, 5.0, 6.0, 5.5, 5.5, 3.6)
HANGUL_MIDDLE = (2.2, 4.5, 6.0, 9.0, 3.2, 4.5, 4.0, 7.0, 3.2, 5.5, 8.0, 6.0, 6.0, 3.5, 6.5, 9.0, 6.5, 6.5, 3.0, 5.5, 2.7)
HANGUL_LAST = (1.2, 4.0, 8.0, 9.0, 2.8, 9.0, 7.5, 7.5, 3.8, 8.5, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 4.5, 5.0, 7.0, 5.5, 5.5, 3.3, 8.0, 8.0, 9.0, 7.0, 7.0, 7.5)
THAI_MARKS = frozenset("ัิีึืฺุู็่้๊๋์ํ๎")
PLAIN_MARKS = frozenset("，。、！？：；“”‘’「」『』（）《》…—·　")


def bits(text: str) -> float:
    """What the characters would take to write down, by the letter frequencies of their scripts; less is likelier to be text.

    Capitals within words, marks without a letter, letters of one alphabet beside another's and accents side by side take more."""
    total, last = 0.0, " "
    common = common_han()
    for c in text:
        if c < "\x80":
            total += 4.5 if c.isalnum() or c in " ,.\t'\"-" else 9.0
            if c.isalpha() and "\x80" < last < "⺀" and last.isalpha() and not "À" <= last <= "ɏ":
                total += 8.0
        elif "一" <= c <= "鿿":
            total += (7.5 if c in OFTEN_HAN else 12.8 if c in common else 17.0) + (6.0 if "가" <= last <= "힣" else 0.0)
        elif "가" <= c <= "힣":
            k = ord(c) - 0xAC00
            total += HANGUL_FIRST[k // 588] + HANGUL_MIDDLE[k // 28 % 21] + HANGUL_LAST[k % 28] + (6.0 if "一" <= last <= "鿿" else 0.0)
        elif "ぁ" <= c <= "ヿ":
            total += 6.0
        elif c in PLAIN_MARKS or "！" <= c <= "～":
            total += 6.0 if c in PLAIN_MARKS else 8.0
        elif "Ά" <= c <= "ώ" or "Ѐ" <= c <= "џ":
            low = c.lower()
            total += _PLACE.get(low, 10.0) + (2.0 if c != low else 0.0)
            if (c != low and last.isalpha() and last == last.lower() and last > "\x7f") or (last.isalpha() and (last < "Ά" or (last < "Ѐ") != (c < "Ѐ"))):
                total += 8.0
        elif "ก" <= c <= "๛":
            total += _PLACE.get(c, 11.0)
            if c in THAI_MARKS and not "ก" <= last <= "๎":
                total += 10.0
        elif "À" <= c <= "ɏ":
            total += 7.0 if c.islower() else 9.0
            if last > "\x7f" and last.isalpha() or (c.isupper() and last.islower()):
                total += 6.0
        else:
            total += 14.0
        last = c
    return total


@cache
def one_byte(codec: str) -> dict[int, int]:
    """Character to byte; bytes the codec leaves open stand for themselves, as decoders in the field have it."""
    out = {}
    for b in range(256):
        try:
            out[ord(bytes((b,)).decode(codec))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


@cache
def letters_of(codec: str) -> frozenset[str]:
    return frozenset(map(chr, one_byte(codec)))


@cache
def unfit(codec: str) -> re.Pattern:
    """What a one-byte codec cannot hold."""
    return re.compile("[^" + char_class(list(one_byte(codec))) + "]+")


def stretches(text: str, codec: str) -> Iterator[tuple[str, bytes | None]]:
    """``text`` as stretches with their bytes under ``codec``; None where it cannot hold them."""
    if codec in READ_ONE:
        at = 0
        table = one_byte(codec)
        for m in unfit(codec).finditer(text):
            if m.start() > at:
                yield text[at : m.start()], text[at : m.start()].translate(table).encode("latin-1")
            yield m.group(), None
            at = m.end()
        if at < len(text):
            yield text[at:], text[at:].translate(table).encode("latin-1")
        return
    for piece in re.split("(�+)", text):  # some encodings have a place for the replacement mark itself
        if "�" in piece:
            yield piece, None
            continue
        at = 0
        while at < len(piece):
            try:
                yield piece[at:], piece[at:].encode(codec)
                break
            except UnicodeEncodeError as e:
                if e.start:
                    yield piece[at : at + e.start], piece[at : at + e.start].encode(codec)
                yield piece[at + e.start : at + e.end], None
                at += e.end


def decoded(part: str, raw: bytes, read: str, wrote: str, torn: bool, head: bool, tail: bool) -> str | None:
    """``part``, whose bytes under ``read`` are ``raw``, strictly decoded; None where it cannot be.

    At a torn edge up to three bytes of a broken character may be left over. Where something was lost beside the edge (``head``, ``tail``)
    they belong to that and go with it; elsewhere their characters stay as they are, so nothing that may be sound is lost."""
    try:
        return raw.decode(wrote)
    except UnicodeDecodeError as e:
        if not torn:
            return None
        first = e
    if wrote == "utf-8":
        h = 0
        while h < min(3, len(raw)) and raw[h] & 0xC0 == 0x80:
            h += 1
        tries = [(h, t) for t in range(4)]
    else:
        tries = [(0, 1), (1, 0), (1, 1)]
        if 1 < first.start < len(raw) - 2:
            tries = tries[1:]
    for h, t in tries:
        if (h and not head) or (t and not tail):
            kept = edges_kept(part, raw, read, h if not head else 0, t if not tail else 0)
            if kept is None:
                continue
            (left, a), (right, b) = kept
        else:
            (left, a), (right, b) = ("", 0), ("", 0)
        try:
            return left + raw[max(a, h if head else 0) : len(raw) - max(b, t if tail else 0)].decode(wrote) + right
        except UnicodeDecodeError:
            continue
    return None


def edges_kept(part: str, raw: bytes, read: str, h: int, t: int) -> tuple[tuple[str, int], tuple[str, int]] | None:
    """The characters of ``part`` that hold its first ``h`` and last ``t`` bytes, with the bytes they take."""
    if read in READ_ONE:
        return (part[:h], h), (part[len(part) - t :], t)
    a, left = 0, 0
    while a < h and left < len(part):
        a += len(part[left].encode(read))
        left += 1
    b, right = 0, 0
    while b < t and right < len(part) - left:
        right += 1
        b += len(part[-right].encode(read))
    return ((part[:left], a), (part[len(part) - right :], b)) if a >= h and b >= t else None


def round_trip(parts: list[tuple[str, bytes | None]], read: str, wrote: str, edges: bool) -> str | None:
    """The stretches of a text read again as ``wrote``; None where any cannot be, or, at torn edges, where none can."""
    out, changed = [], False
    for k, (part, raw) in enumerate(parts):
        if raw is None or raw.isascii():
            out.append(part)
            continue
        head = k > 0 and parts[k - 1][0].endswith("�")
        tail = k + 1 < len(parts) and parts[k + 1][0].startswith("�")
        again = decoded(part, raw, read, wrote, edges, head, tail)
        if again is None:
            if not edges:
                return None
            out.append(part)
            continue
        changed = changed or again != part
        out.append(again)
    return "".join(out) if changed else None


#: Runs of bytes beyond ASCII, those that are UTF-8 from end to end, and what of it is a letter or mark in use.
BEYOND = re.compile(b"[\x80-\xff]+")
SEQUENCES = re.compile(b"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
IN_USE = re.compile("[\xa0-\u017fΆ-ώА-яЁё\u0900-\u097f\u0e01-\u0e5b‐-…‹›€™⺀-鿿가-힣\uff00-\uffef\U0001f300-\U0001faff]+")


def sequences(line: str, read: str, quoted: int) -> str:
    """``line`` with only those of its runs read again that are UTF-8 by themselves; quoted examples are left.

    A capital before a closing mark, as in «CAFÉ», is no run."""
    kept = [m.span() for m in example(quoted).finditer(line)]
    out, at = [], 0
    for part, raw in stretches(line, read):
        here = at
        at += len(part)
        last = 0
        for m in BEYOND.finditer(raw or b""):
            a, b = m.span()
            while a < b and part[a] in AROUND:
                a += 1
            while a < b and part[b - 1] in AROUND and not SEQUENCES.fullmatch(raw, a, b):
                b -= 1
            if a == b or not SEQUENCES.fullmatch(raw, a, b) or any(x < here + b and here + a < y for x, y in kept):
                continue
            before = line[here + a - 1 : here + a]
            if b - a == 2 and part[b - 1] in "»”’…–—" and (not before or before.isupper() or "«" in line[: here + a]):
                continue
            try:
                again = raw[a:b].decode("utf-8")
            except UnicodeDecodeError:
                continue
            if IN_USE.fullmatch(again):
                out += [part[last:a], again]
                last = b
        out.append(part[last:])
    return "".join(out)


def sensible(before: str, after: str, wrote: str) -> bool:
    """Whether what a round trip to a legacy encoding gains is text, not just other symbols."""
    gained = [c for c in after if ord(c) > 0x7F and c not in before]
    if not gained:
        return False
    if all(c in "±§×÷°·¨“”‘’—…　" for c in gained):
        return len(gained) > 1
    if wrote == "cp1252":
        return all(c.islower() or c == "’" for c in gained) and IN_WORD.search(before) is not None and cost(after) <= 0.3 * cost(before)
    letters = [c for c in gained if c.isalpha()]
    if len(letters) < (6 if wrote in WRITTEN_ONE else 2):  # few letters prove nothing
        return False
    common = common_han()
    sound = sum(c in common or "぀" <= c <= "ヿ" or "　" <= c <= "。" or "！" <= c <= "～" or c in "“”‘’—…「」『』" or "가" <= c <= "힣" or "ก" <= c <= "๛" or "Ά" <= c <= "ώ" or "А" <= c <= "я" or c in "Ёё" for c in gained)
    return sound >= 0.85 * len(gained) and bits(after) <= (CHEAPER if wrote in WRITTEN_ONE else 1.0) * bits(before)


def candidates(line: str) -> list[str]:
    """Encodings the line may have been read with: those that hold nearly all of its letters beyond ASCII."""
    beyond = {c for c in line if c > "\x7f" and c != "�"}
    if not beyond:
        return []
    some = [r for r in READ_ONE if len(beyond & letters_of(r)) >= 0.9 * len(beyond)]
    if any(c >= "⸀" for c in beyond):
        some += READ_MANY
    return some


def repair_once(line: str, quoted: int = QUOTED, hint: tuple[str, str] | None = None) -> tuple[str, float, float, tuple[str, str] | None, bool]:
    """(best text, its cost, the cost before, the encodings that gave it, whether at torn edges); ``hint`` is tried first."""
    before = cost(line)
    best, least, pair, torn = line, before, None, False
    if before < 0.7:
        return best, least, before, None, torn
    beyond = len(line) - len(line.encode("ascii", "ignore"))
    reads = candidates(line)
    # text of a legacy encoding is garbled through and through; a few rare characters are not worth a trip
    dense = before >= 0.15 * beyond
    if not dense:
        reads = [r for r in reads if r in READ_ONE]
    if hint and hint[0] in reads:
        reads = [hint[0], *(r for r in reads if r != hint[0])]
    cut: dict[str, list] = {}
    alone: tuple[float, str, str] | None = None
    for edges in (False, True):
        if edges and not ("�" in line or before >= 6) or best != line:
            break
        # UTF-8 proves itself by its strictness: other encodings are asked where it gives nothing
        for read in reads:
            if read not in cut:
                cut[read] = list(stretches(line, read))
            again = round_trip(cut[read], read, "utf-8", edges)
            if again is not None and cost(again) < least - 1e-9:
                best, least, pair, torn = again, cost(again), (read, "utf-8"), edges
                if least < 0.1 * before:
                    return best, least, before, pair, torn
        if best != line:
            break
        if not edges:
            tried = ((sequences(line, read, quoted), read) for read in reads if read in READ_ONE)
            alone = min(((cost(t), read, t) for t, read in tried if t != line), default=None)
            if alone and alone[0] < 0.4 * before:
                return alone[2], alone[0], before, (alone[1], "utf-8"), False
        written_in: list[tuple[float, int, str, str, str]] = []
        for place, wrote in enumerate(WRITTEN[1:]):
            narrow = wrote in WRITTEN_ONE
            for read in reads:
                if read == wrote or (narrow and wrote != "cp1252" and read in READ_MANY) or (wrote == "cp1252" and read in ("latin-1", "cp1252")) or not (dense or narrow):
                    continue
                again = round_trip(cut[read], read, wrote, edges)
                if again is not None and sensible(line, again, wrote) and cost(again) + (0.0 if narrow else 0.2) < before - 1e-9:
                    written_in.append((bits(again) * (HINTED if hint == (read, wrote) else 1.0), place, read, wrote, again))
        if written_in:
            _, _, read, wrote, best = min(written_in)
            return best, cost(best), before, (read, wrote), edges
    if best == line and alone and alone[0] < least - 1e-9:
        least, best, pair = alone[0], alone[2], (alone[1], "utf-8")
    return best, least, before, pair, torn


def repair_line(line: str, quoted: int = QUOTED, hint: tuple[str, str] | None = None) -> tuple[str, bool, tuple[str, str] | None]:
    """(restored line, garbled, the encodings of its outer layer)."""
    if not suspicious(line):
        return line, False, hint
    rest = example(quoted).sub("", line)
    if cost(rest) < 0.7:
        return line, False, hint
    found, now, outer = False, line, hint
    part, some = repair_within(line, quoted) if WIDE.search(line) else (line, False)
    lost = "�" in rest
    first = True
    while True:  # each turn lowers the cost
        again, after, before, pair, torn = repair_once(now, quoted, outer if first else None)
        proven = pair is not None and (pair[1] == "utf-8" or pair[1] in WRITTEN_ONE)
        if again == now or before - after < (0.59 if proven else 0.9 if before < 4 else 0.5 * before) or (not proven and after > 0.4 * before and not lost):
            break
        if torn and some and cost(part) <= 0.05 * cost(line):
            return part, True, hint
        if first:
            outer = pair
        now, found, first = again, True, False
    if some and cost(part) < cost(now):
        now, found = part, True
    if not found and not lost:
        # nothing gives the text back, but it is garbled through and through; rare Han characters alone are no proof of it
        whole, marks = cost(rest), cost(HAN.sub("", rest))
        lost = (whole >= 6 and whole >= 0.5 * len(rest)) or (marks >= 2.5 and marks >= 0.2 * len(rest))
        now, found = part, some
    return now, found or lost, outer


def strictly(part: str) -> str | None:
    """UTF-8 that was read with several bytes a character, read again; None where no encoding gives sound text."""
    before = cost(part)
    for read in READ_MANY:
        try:
            again = part.encode(read).decode("utf-8")
        except UnicodeError:
            continue
        if again != part and before - cost(again) >= 0.6 * before:
            return again
    return None


def repair_within(line: str, quoted: int = QUOTED) -> tuple[str, bool]:
    """(line with its garbled stretches restored, whether it has any): each stretch is judged by itself, quoted examples are left."""
    kept = [m.span() for m in example(quoted).finditer(line)]
    free = lambda a, b: not any(a < d and c < b for c, d in kept)
    edits: list[tuple[int, int, str]] = []
    for m in NARROW.finditer(line):
        part = m.group()
        bare = (m.start() + len(part) - len(part.lstrip(AROUND)), m.start() + len(part.rstrip(AROUND)))
        # marks that sound text has around it may be part of what is garbled
        for a, b in dict.fromkeys((m.span(), bare)):
            if a >= b or not free(a, b) or len({c for c in line[a:b] if c > "\x7f"}) < 3 or not suspicious(line[a:b]):
                continue
            if (a, b) != bare and repair_once(line[a:b], quoted)[4]:
                continue
            again, bad, _ = repair_line(line[a:b], quoted)
            if bad and (again != line[a:b] or len(BROKEN.findall(line, a, b)) >= 2):
                edits.append((a, b, again))
                break
    groups: list[list[int]] = []
    for m in odd().finditer(line):
        if m.group() >= "⺀":
            if groups and m.start() - groups[-1][1] <= BETWEEN:
                groups[-1][1] = m.end()
            else:
                groups.append([m.start(), m.end()])
    for a, b in groups:
        if not free(a, b) or b - a < 2 or cost(line[a:b]) < 1.4:
            continue
        for left, right in sorted(((x, y) for x in range(BESIDE + 1) for y in range(BESIDE + 1)), key=sum):
            if a < left or b + right > len(line) or b + right - a + left < 3:
                continue
            again = strictly(line[a - left : b + right])
            if again is not None:
                edits.append((a - left, b + right, again))
                break
    out, at = [], 0
    for a, b, again in sorted(edits):
        if a >= at:
            out += [line[at:a], again]
            at = b
    return "".join([*out, line[at:]]), bool(edits)


def repair(text: str | None, quoted: int = QUOTED) -> tuple[str | None, bool]:
    """(restored text, whether any line was garbled)."""
    if not text or not suspicious(text):
        return text, False
    spans = [m.span() for m in LINE.finditer(text)]
    lines: dict[int, str] = {}
    hint = None
    for a, b in sorted(spans, key=lambda x: x[0] - x[1]):  # the longest line tells most about its encodings
        again, bad, hint = repair_line(text[a:b], quoted, hint)
        if bad:
            lines[a] = again
    if not lines:
        return text, False
    out, at = [], 0
    for a, b in spans:
        if a in lines:
            out += [text[at:a], lines[a]]
            at = b
    return "".join([*out, text[at:]]), True


def repaired(df: DataFrame, keys: list[str], text: str, quoted: int = QUOTED) -> DataFrame:
    """``keys, restored``: the garbled rows with what their text was, as far as it can be restored."""
    kinds = dict(df.dtypes)
    n = len(keys)
    own = df.where(F.col(text).isNotNull()).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, texts = [], []
            for i, t in enumerate(batch.column(n).to_pylist()):
                again, bad = repair(t, quoted)
                if bad:
                    which.append(i)
                    texts.append(again)
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(n)), pa.array(texts, pa.string())], [*(f"k{i}" for i in range(n)), "restored"])

    schema = ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keys)) + ", restored string"
    return spread(own, *(f"k{i}" for i in range(n))).mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "restored")
