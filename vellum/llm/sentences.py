"""Problem 2: sentence units of texts in many scripts, by a semi-Markov choice of whole spans.

A line is a chain of places where a unit may end: runs of end marks with the closing quotes and brackets right
after them, and the end of the line. Dynamic programming picks the spans between those places whose scores add
up highest. The score of a span weighs its both ends and what is between them together: how it closes (mark,
abbreviation, initial, number, omission), how the text goes on after it (small letter, particle, words that tell who
spoke), how it opens, how long it is, and whether its quotes and brackets balance (a place within a pair is none).

What opening, length and content can add or take from a chain is bounded (``BOUND``), so a place whose own evidence is
above twice that ends a unit in every best chain and closes the search. Between such places the score of a span
depends on where it starts for a bounded length only (``FAR``), so the search is linear in the places of a line.

Defined cases: null, empty and blank texts have no unit; a span without letter or digit is none; a text without
any mark is one unit a line; positions are code points of the stored text; repeated rows give repeated units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm.look import one_to_one
from vellum.session import spread

LINE = re.compile("[^\n\r  ]+")
GHOST = "⁠"  # stands for every character that cannot be seen, so that positions stay
_UNSEEN = "\x00-\x08\x0e-\x1f\x7f-\x9f­͏؜᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻"
ODD = re.compile(f"[{_UNSEEN}Ａ-Ｚａ-ｚ０-９＂＇．｢｣､Ͱ-ϿЀ-ӿ]")

OMIT = ".…⋯‥"
FULL = "!?。।॥؟۔⁇⁈⁉‼！？｡።။។։།⸮﹒﹖﹗"
MARKS = re.compile(f"[{re.escape(OMIT + FULL)}]+(?:[    ]?[!?！？]+)*")
PAIRS = dict(zip("“‘«‹「『（([｛{《〈【〔［", "”’»›」』）)]｝}》〉】〕］"))
CLOSERS = {v: k for k, v in PAIRS.items()}
QUOTES = set("“‘«‹「『\"")
PLAIN_BRACKETS = set("（([［")
ENCLOSE = re.compile("[" + re.escape("".join(PAIRS) + "".join(CLOSERS)) + '"]')
AFTER = re.compile(f"(?:[    ]?[»›]|{GHOST}*[" + re.escape('"”’」』）)]｝}》〉】〕］') + "])+")
INTRO = " \t\u00a0\u3000" + GHOST  # blanks between words and the quotation they introduce
LETTER = re.compile(r"[^\W_]")
BLANKS = re.compile(rf"[\s{GHOST}]*")
WORD_CHARS = frozenset(".’'°-" + GHOST)
WORD = re.compile(r"\w+")
FIGURES = re.compile(r"(?:[ivxlcIVXLC]+\b|[一二三四五六七八九十百零〇]+\b)")

# Words whose dot belongs to them.
NEVER_LAST = set(
    "mr mrs ms dr prof st capt col gen lt sgt rev hon messrs mme mlle mm me mgr "
    "e.g i.e cf viz vs av ex env ca approx p "
    "डॉ पं श्री ई प्रो कु स्व सन्".split()
)
BEFORE_FIGURES = set("no nos nr vol vols pp p ch chap fig figs sec art t n° n par bd nos ed pt op".split())
MAYBE_LAST = set("etc yrs yr hrs hr ff inc ltd co corp jr sr al min a.m p.m j.-c apr aug dec feb jan oct sept nov".split())
OPENERS_OF_SENTENCES = set(
    "the a an he she it they we you i in on at but and so then when what nobody some after before for by this that these those "
    "il elle on le la les un une mais puis et au".split()
)

# Verbs and words that tell who spoke.
SPOKE_ZH = re.compile(
    r"(?:说|說|问|問|答|喊|叫|嚷|叹|嘆|骂|罵|吼|喝|念|唱|嘀咕|嘟囔|低语|低語|感慨|吩咐|催促|补充|補充|回应|回應|解释|解釋|嘱咐|囑咐|"
    r"(?<![知街味轨軌频頻渠通管跑铁鐵车車隧航河步楼樓人])道)(?:着|著|了|起来|起來)?\Z"
)
CLAUSE = re.compile(r"[^，,。.!?！？；;：:、…“”\"「」『』（）()।॥«»]*")
GOES_ON_ZH = re.compile("[时時的之等]")
GOES_ON_JA = re.compile("って|という|とか|と(?![うてもこりに])|を|[はがにのもへ](?=[一-鿿ァ-ヺ])")
SPOKE_LATIN = re.compile(
    r"\b(?:said|says|say|asked|asks|cried|cries|answered|replied|whispered|shouted|murmured|called|exclaimed|muttered|added|told|wrote|"
    r"demanda|dit|répondit|cria|murmura|lança|ajouta|souffla|reprit|déclara)\b"
)
SPOKE_HI = re.compile("पूछा|कहा|बोला|बोली|बोले|चिल्लाया|चिल्लाई|उत्तर|जवाब|पुकारा")

#: The evidence of a place that ends a unit whatever stands around it, and that of an end mark right after a quotation.
CERTAIN, AFTER_QUOTE = 10.0, 4.0
#: What a span gains or loses: below four characters, without a letter, for each character above LONG up to FAR, and by its first word.
SHORT, EMPTY, LONG, EACH, FAR, OPENING = 0.25, 1.0, 160, 0.01, 320, 0.75
#: The most that all these change in a chain when one place is added.
BOUND = SHORT + EMPTY + EACH * (FAR - LONG) + OPENING

_fold: dict[int, str] = {}


def folded(line: str) -> str:
    """``line`` with plain widths and Latin letters for their look-alikes, character for character."""
    if not ODD.search(line):
        return line
    if not _fold:
        _fold.update({ord(k): v for k, v in one_to_one().items() if k not in "［］｛｝"})
        for part in re.findall("(.)(?:-(.))?", _UNSEEN, re.S):
            for code in range(ord(part[0]), ord(part[1] or part[0]) + 1):
                _fold[code] = GHOST
    return line.translate(_fold)


def enclosed(s: str) -> list[tuple[int, int]]:
    """The outermost matched quotes and brackets of a line, as (open, close); what has no partner counts for nothing."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in ENCLOSE.finditer(s):
        c, at = m.group(), m.start()
        if c == '"':
            opener = '"' if any(o == '"' for o, _ in stack) else ""
        elif c in PAIRS:
            opener = ""
        else:
            opener = CLOSERS[c]
            if c == "’" and s[at - 1 : at].isalpha() and s[at + 1 : at + 2].isalpha() and s[at + 1 : at + 2].isascii():
                continue
        if not opener:
            stack.append((c, at))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == opener:
                found.append((stack[k][1], at))
                del stack[k:]
                break
    found.sort()
    outer: list[tuple[int, int]] = []
    for o, c in found:
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    return outer


def next_at(s: str, at: int) -> int:
    return BLANKS.match(s, at).end()


def word_before(s: str, a: int) -> str:
    """The word that ends at ``a``: in scripts without blanks a name may stand right before it, so it ends at theirs."""
    at = a
    while at and ((c := s[at - 1]) in WORD_CHARS or c.isalnum() or c == "_" or "ऀ" <= c <= "ॣ"):
        if "⺀" <= c <= "鿿" or "가" <= c <= "힣":
            break
        at -= 1
    return s[at:a].replace(GHOST, "")


def dot_evidence(s: str, a: int, e: int) -> tuple[float, bool] | None:
    """How much speaks for an end at the single dot at ``a``, the text going on at ``e``, and whether a number alone before it speaks against it.

    None where the dot belongs to a number or address."""
    nxt = s[a + 1 : a + 2]
    if nxt and e == a + 1 and (nxt.isascii() and (nxt.isalnum() or nxt in ",;:-/@_~")):
        return None
    word = word_before(s, a)
    low = word.lower().lstrip(".-'’")
    k = next_at(s, e)
    ahead = s[k : k + 1]
    blank = k > e
    if not word:
        return CERTAIN, False
    if low.isdigit():
        return (4.0, True) if blank or not ahead.isascii() else (-8.0, False)
    if ahead and ahead in ",;:，；：、":
        return -8.0, False
    opens = ahead.isupper() or (ahead != "" and ahead in "“‘«\"「『(（") or (ahead.isalpha() and not ahead.isascii() and not ahead.islower())
    if low in NEVER_LAST:
        return -8.0, False
    if low in BEFORE_FIGURES:
        return (-8.0 if ahead.isdigit() or not blank or FIGURES.match(s, k) else 3.0 if opens else -6.0), False
    if low in MAYBE_LAST:
        return (3.0 if opens else -6.0), False
    if len(word) == 1 and word.isalpha() and (word.isupper() or word == "p"):
        return -5.0, False
    if "." in low:  # an acronym with dots inside, or an address
        following = WORD.match(s, k)
        starts = opens and (ahead in "“‘«\"「『(（" or (following is not None and following.group().lower() in OPENERS_OF_SENTENCES))
        return (2.0 if starts else -1.0 if opens else -6.0), False
    if ahead.islower():
        return (-4.0 if len(low) <= 4 else 3.0), False
    return CERTAIN, False


def quote_evidence(s: str, alone: bool, o: int, e: int) -> float:
    """How much speaks for an end right after the quotation opened at ``o`` and closed before ``e``; ``alone`` if its unit starts with it."""
    k = next_at(s, e)
    ahead = s[k : k + 1]
    if (ahead and ahead in ",，、;；:：)）—–-") or ahead.islower() or GOES_ON_ZH.match(s, k) or GOES_ON_JA.match(s, k):
        return -8.0
    if not alone:
        # words that introduce it without a colon or comma hold on to what follows, in scripts without blanks
        last = s[:o].rstrip(INTRO)[-1:] if s[o - 1 : o].isspace() or s[o - 1 : o] == GHOST else s[o - 1 : o]
        return -8.0 if last.isalpha() and last >= "⺀" else AFTER_QUOTE
    m = CLAUSE.match(s, k)
    clause, stop = m.group().replace(GHOST, "").rstrip(), s[m.end() : m.end() + 1]
    if not clause or (stop and stop in ":：“「『«\""):
        return AFTER_QUOTE
    if stop and stop in ",，" and s[next_at(s, m.end() + 1) :][:1] in ("“", "«", '"', "「"):
        return AFTER_QUOTE
    if clause[0] >= "⺀":
        told = SPOKE_ZH.search(clause)
        return AFTER_QUOTE - (10.0 - 0.05 * len(clause) if told else 0.0)
    if "ऀ" <= clause[0] <= "ॿ":
        return AFTER_QUOTE - (12.0 if SPOKE_HI.search(clause) else 0.0)
    told = SPOKE_LATIN.search(clause)
    # the further the verb is from the quotation, the less it tells who spoke
    return AFTER_QUOTE - (8.0 - 0.85 * len(clause[: told.start()].split()) if told else 0.0)


class Place(NamedTuple):
    """Where a unit may end: how much speaks for it, and what that depends on."""

    end: int
    evidence: float = CERTAIN
    figures: bool = False  # a number alone before it is no unit
    quote: int = -1  # where the quotation that closes here opens
    bracket: int = -1  # the same for a bracket


def places(s: str) -> list[Place]:
    """The places of one line in order; its end is certain, whatever stands there."""
    out: list[Place] = []
    outer = None
    p = last = 0
    for m in MARKS.finditer(s):
        a, b = m.span()
        if a < last:
            continue
        run = m.group()
        if not run.strip(OMIT) and (b - a > 1 or run != "."):
            continue  # dots of omission
        if outer is None:
            outer = enclosed(s)
        while p < len(outer) and outer[p][1] < a:
            p += 1
        tail = AFTER.match(s, b)
        e = tail.end() if tail else b
        if p < len(outer) and outer[p][0] < a:
            o, c = outer[p]
            if e <= c:
                continue  # within a pair
            more = MARKS.match(s, e)
            if more and more.group().strip(OMIT):
                tail = AFTER.match(s, more.end())
                e = tail.end() if tail else more.end()
                found = Place(e)
            else:
                found = Place(e, AFTER_QUOTE, quote=o) if s[o] in QUOTES else Place(e, AFTER_QUOTE, bracket=o)
        else:
            if tail and p < len(outer) and outer[p][0] < e:
                e = max(b, outer[p][0])  # a straight quote that opens the next quotation
            if run == ".":
                evidence = dot_evidence(s, a, e)
                if evidence is None:
                    continue
                found = Place(e, evidence[0], evidence[1])
            else:
                nxt = s[e : e + 1]
                if (nxt and nxt in ",，、;；:：") or (nxt.isascii() and nxt.isalnum() and s[a - 1 : a].isascii() and s[a - 1 : a].isalnum()):
                    continue
                found = Place(e)
        last = e
        out.append(found)
    if out and out[-1].end >= len(s):
        out.pop()
    out.append(Place(len(s)))
    return out


def line_units(line: str) -> list[tuple[int, int]]:
    """The units of one line, as half-open spans."""
    s = folded(line)
    out = []
    at = 0
    for e in chosen(s, places(s)):
        while at < e and line[at].isspace():
            at += 1
        z = e
        while z > at and line[z - 1].isspace():
            z -= 1
        if z > at and LETTER.search(s, at, z):
            out.append((at, z))
        at = e
    return out


def closing(s: str, place: Place) -> tuple[float, float]:
    """The evidence of a place for a unit that starts anywhere, and for one that starts with the pair or number that closes here."""
    if place.quote >= 0:
        return quote_evidence(s, False, place.quote, place.end), quote_evidence(s, True, place.quote, place.end)
    if place.bracket >= 0:
        return -8.0, AFTER_QUOTE if s[place.bracket] in PLAIN_BRACKETS else -8.0
    return place.evidence, -8.0 if place.figures else place.evidence


def opening(s: str, at: int) -> float:
    """How well a unit opens at ``at``."""
    word = WORD.match(s, at)
    if word is None:
        return 0.0
    found = word.group()
    return OPENING if found.lower() in OPENERS_OF_SENTENCES and found[0].isupper() else -OPENING if found[0].islower() else 0.0


def chosen(s: str, nodes: list[Place]) -> list[int]:
    """The ends of the best chain of spans; a certain end closes the search before it."""
    out: list[int] = []
    base = 0  # where the open stretch starts
    soft: list[Place] = []
    last = len(nodes) - 1
    for n, node in enumerate(nodes):
        if n < last and not (node.evidence > 2 * BOUND and node.quote < 0 and node.bracket < 0):
            soft.append(node)
            continue
        if soft:
            out += searched(s, base, [*soft, node])
            soft = []
        else:
            out.append(node.end)
        base = node.end
    return out


def searched(s: str, base: int, nodes: list[Place]) -> list[int]:
    """The ends of the best chain from ``base`` over ``nodes``, the last of which is certain."""
    ends = [base, *(x.end for x in nodes)]
    starts = [next_at(s, e) for e in ends]
    opens = [0.0, *(opening(s, at) for at in starts[1:])]
    at_start = {at: i for i, at in enumerate(starts)}
    lettered = [0] * len(ends)  # the last place up to which there is a letter since the one before
    best, back = [0.0] * len(ends), [0] * len(ends)
    far, far_best, far_from = 0, float("-inf"), 0  # of the starts that are FAR behind only the best counts
    for j in range(1, len(ends)):
        lettered[j] = j if LETTER.search(s, starts[j - 1], ends[j]) else lettered[j - 1]
        node = nodes[j - 1]
        top, came = float("-inf"), 0
        usual, own = closing(s, node) if j < len(ends) - 1 else (0.0, 0.0)
        if node.figures:  # a number alone
            special = next((i for i in (j - 1, j - 2) if i >= 0 and s[starts[i] : ends[j]].replace(GHOST, "").strip(" .\t").isdigit()), j)
        else:
            special = at_start.get(node.quote if node.quote >= 0 else node.bracket, j)
        while far < j and ends[j] - starts[far] >= FAR:
            if best[far] + opens[far] > far_best:
                far_best, far_from = best[far] + opens[far], far
            far += 1
        tried = [*range(far, j)]
        if far:
            tried += [far_from, special] if special < far else [far_from]
        for i in tried:
            size = ends[j] - starts[i]
            score = best[i] + opens[i] + (own if i == special else usual)
            score -= SHORT * (size < 4) + EMPTY * (lettered[j] <= i) + EACH * min(max(0, size - LONG), FAR - LONG)
            if score > top or (score == top and i < came):
                top, came = score, i
        best[j], back[j] = top, came
    chain, j = [], len(ends) - 1
    while j:
        chain.append(ends[j])
        j = back[j]
    return chain[::-1]


def units(text: str | None) -> list[tuple[int, int]]:
    """The sentence units of a text."""
    if not text:
        return []
    out = []
    for m in LINE.finditer(text):
        at = m.start()
        out.extend((at + a, at + e) for a, e in line_units(m.group()))
    return out


def sentence_units(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, start_pos, end_pos``: one row for each unit of ``text``."""
    kinds = dict(df.dtypes)
    own = df.where(F.col(text).isNotNull()).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            which, starts, ends = [], [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                for a, e in units(t):
                    which.append(i)
                    starts.append(a)
                    ends.append(e)
            take = pa.array(np.array(which, dtype="int64"))
            columns = [batch.column(k).take(take) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [*(f"k{i}" for i in range(len(keys))), "start_pos", "end_pos"]
            )

    schema = ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keys)) + ", start_pos int, end_pos int"
    return spread(own, *(f"k{i}" for i in range(len(keys)))).mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "start_pos", "end_pos")
