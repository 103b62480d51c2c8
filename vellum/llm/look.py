"""Problem 1: texts that look alike but differ in their characters.

``fold_sql`` builds one embedded SQL expression that maps a text to the form that stands for its look:

* line ends of any kind become LF, blanks of any kind a space (one for one);
* characters that cannot be seen (zero-width, joiners, soft hyphen, controls, variation selectors) vanish;
* full-width, half-width and no-break forms, radicals and presentation ligatures become the plain form;
* letters drawn like a Latin letter (of other alphabets, and of the mathematical styles) become that letter;
* what is left is composed (NFC), which also unifies compatibility ideographs.

Case, simplified against traditional form, raised and circled figures and all other visible marks are kept.

Defined cases: a null text has a null look; an empty or blank text has a look but takes part in no pair;
equal strings are never a pair; rows with null ids take part in none; ties do not arise, since a pair is ordered by row id. Extra columns of the
input, whatever their names, are dropped before any work.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import DataFrame, functions as F

from vellum.llm.duck import map_sql
from vellum.session import spread, written

# Letters drawn alike, each followed by its Latin letter.
ALIKE = (
    # Cyrillic
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW ЁË ЇÏ "
    "аa еe ѕs іi јj оo рp сc уy хx үy ԁd ԛq ԝw һh ӏl ёë їï "
    # Greek
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ΆÁ ΈÉ ΌÓ ΊÍ ΎÝ "
    "αa γy ιi νv οo ρp υu ϲc ϳj άá ίí όó ύú "
    # Armenian
    "ՕO ՏS ԼL օo ոn սu հh ցg զq յj "
    # Cherokee
    "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏙV ᏚS ᏞL ᏟC ᏢP ᏴB ᏦK "
    # Lisu
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    # Coptic
    "ⲀA ⲂB ⲈE ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲨY ⲬX ⲭx "
    # Canadian syllabics
    "ᗅA ᗩA ᗷB ᑕC ᗪD ᕼH ᒍJ ᒪL ᗰM ᑭP ᖇR ᑌU ᐯV "
    # Latin letters of other blocks
    "ɑa ɡg ɩi ʏY ⅼl ⅽc ⅾd ⅿm ⅰi ⅴv ⅹx ⅠI ⅤV ⅩX ⅬL ⅭC ⅮD ⅯM"
).split()

# One character that is drawn as several, and those.
SEVERAL = (
    "ﬀ=ff ﬁ=fi ﬂ=fl ﬃ=ffi ﬄ=ffl ﬅ=st ﬆ=st …=... ‥=.. №=No ℡=TEL ǆ=dž ǉ=lj ǌ=nj Ǉ=LJ Ǌ=NJ Ǆ=DŽ ǈ=Lj ǋ=Nj "
    "Ⅱ=II Ⅲ=III Ⅳ=IV Ⅵ=VI Ⅶ=VII Ⅷ=VIII Ⅸ=IX Ⅺ=XI Ⅻ=XII ⅱ=ii ⅲ=iii ⅳ=iv ⅵ=vi ⅶ=vii ⅷ=viii ⅸ=ix ⅺ=xi ⅻ=xii ℃=°C ℉=°F"
).split()

#: What cannot be seen, as a character class both of RE2 and of Java.
UNSEEN = (
    r"[\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}"
    r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"
)
#: Different strings of one look that are paired in one task with all others of it.
PART = 500
LINE_ENDS = r"\r\n?|[\x{B}\x{C}\x{85}\x{2028}\x{2029}]"


#: Unicode's own marks of what is a character in another style, width or position, drawn like it otherwise. Raised, lowered, circled,
#: upright, small and squared forms are visible differences, and so are most of those without a mark of their own (the micro sign is not).
STYLES = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<final>", "<initial>", "<medial>")


#: Beyond the basic plane: the mathematical styles, and figures in segments.
STYLED = (*range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00), *range(0x1FBF0, 0x1FC00))


@cache
def one_to_one() -> dict[str, str]:
    """Character to character: widths, blanks, styles and radicals by Unicode's own rules, then the letters drawn alike."""
    alike = {pair[0]: pair[1] for pair in ALIKE}
    out = {}
    for code in [*range(0x80, 0x10000), *STYLED]:
        c = chr(code)
        tag = unicodedata.decomposition(c).partition(" ")[0]
        if unicodedata.category(c) == "Zs":
            out[c] = " "
        elif tag in STYLES or 0x2E80 <= code <= 0x2FDF:
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain != c:
                out[c] = alike.get(plain, plain)
    return out | {"\t": " ", "µ": "μ", "￣": "¯", "‐": "-", "‑": "-", "〜": "~", "～": "~"} | alike


@cache
def seldom() -> frozenset[str]:
    """Of these what hardly any text holds: looked for first, so that the usual ones stay few."""
    often = lambda c: c < "\u0530" or "\u2000" <= c < "\u2200" or "\u2e80" <= c < "\u3100" or c >= "\uff00" and c < "\U00010000"
    return frozenset(c for c in one_to_one() if not often(c))


def char_class(chars: frozenset[str]) -> str:
    """A character class of code points as ranges, both of RE2 and of Java."""
    out, run = [], []
    for code in [*sorted(map(ord, chars)), -1]:
        if run and code != run[-1] + 1:
            out.append(f"\\x{{{run[0]:X}}}-\\x{{{run[-1]:X}}}")
            run = []
        run.append(code)
    return "[" + "".join(out) + "]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@cache
def fold_sql(column: str) -> str:
    """The embedded SQL expression for the look of ``column``."""
    usual, rare = ({c: v for c, v in one_to_one().items() if (c in seldom()) == which} for which in (False, True))
    x = f"regexp_replace({column}, '{LINE_ENDS}', chr(10), 'g')"
    x = f"regexp_replace({x}, '{UNSEEN}', '', 'g')"
    x = f"translate({x}, {quoted(''.join(usual))}, {quoted(''.join(usual.values()))})"
    x = f"CASE WHEN regexp_matches({column}, '{char_class(seldom())}') THEN translate({x}, {quoted(''.join(rare))}, {quoted(''.join(rare.values()))}) ELSE {x} END"
    several = x
    for item in SEVERAL:
        one, many = item.split("=")
        several = f"replace({several}, '{one}', '{many}')"
    some = "[" + "".join(item[0] for item in SEVERAL) + "]"
    x = f"CASE WHEN regexp_matches({column}, '{some}') THEN {several} ELSE {x} END"
    return f"nfc_normalize({x})"


def canonical(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``look_text``: every text in its one consistent form (null stays null)."""
    kinds = dict(df.dtypes)
    own = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("t"))
    names = ", ".join(f"k{i}" for i in range(len(keys)))
    schema = ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keys)) + ", look_text string"
    out = map_sql(spread(own, "k0"), f"SELECT {names}, {fold_sql('t')} AS look_text FROM batch", schema)
    return out.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "look_text")


def look_keys(df: DataFrame, group: str, row: str, text: str) -> DataFrame:
    """``group_key, row_id, look, raw``: 128-bit digests of the look and of the string, without null and blank texts."""
    own = df.where(F.col(text).isNotNull() & F.col(row).isNotNull()).select(F.col(group).alias("group_key"), F.col(row).cast("long").alias("row_id"), F.col(text).alias("t"))
    sql = (
        "SELECT group_key, row_id, unhex(md5(f)) AS look, unhex(md5(t)) AS raw FROM "
        f"(SELECT group_key, row_id, t, {fold_sql('t')} AS f FROM batch) WHERE regexp_matches(f, '[^ \\n]')"
    )
    return map_sql(spread(own, "row_id"), sql, "group_key string, row_id long, look binary, raw binary")


def alike_pairs(df: DataFrame, group: str = "table_name", row: str = "row_id", text: str = "text") -> DataFrame:
    """Pairs ``(group, row_a, row_b)``, row_a < row_b, of one group whose texts look the same but are not the same string.

    Digests are written once. Classes with a single string fall out in an aggregation with partial sums; pairs are
    formed between the distinct strings of a class first and between their rows after, so that copies of one
    string, however many, meet only the rows they pair with.
    """
    digests = written(look_keys(df, group, row, text), "looks")
    several = digests.groupBy("group_key", "look").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low < high")
    rows = digests.join(several.select("group_key", "look"), ["group_key", "look"], "left_semi")
    strings = rows.select("group_key", "look", "raw").distinct()
    # a class of many strings is parted: each of its parts meets the whole class in a task of its own
    parts = strings.groupBy("group_key", "look").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    sized = strings.join(parts, ["group_key", "look"])
    a = sized.select("group_key", "look", F.pmod(F.xxhash64("raw"), F.col("parts")).cast("int").alias("part"), F.col("raw").alias("raw_a"))
    b = sized.select("group_key", "look", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("raw").alias("raw_b"))
    kinds = a.join(b, ["group_key", "look", "part"]).where("raw_a < raw_b").drop("part")
    of = lambda s: rows.select("group_key", "look", F.col("raw").alias(f"raw_{s}"), F.col("row_id").alias(f"row_{s}"))
    pairs = kinds.join(of("a"), ["group_key", "look", "raw_a"]).join(of("b"), ["group_key", "look", "raw_b"])
    return pairs.select(
        F.col("group_key").alias(group), F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b")
    )


def alike_classes(df: DataFrame, group: str = "table_name", row: str = "row_id", text: str = "text") -> DataFrame:
    """One row for each row of a class of at least two strings: its class (the least row id) and its number of links."""
    digests = written(look_keys(df, group, row, text), "looks")
    strings = digests.groupBy("group_key", "look", "raw").agg(F.count("*").alias("copies"), F.min("row_id").alias("least"))
    classes = strings.groupBy("group_key", "look").agg(F.sum("copies").alias("rows"), F.min("least").alias("class_id"), F.count("*").alias("n")).where("n > 1")
    linked = strings.join(classes, ["group_key", "look"]).select("group_key", "look", "raw", "class_id", (F.col("rows") - F.col("copies")).alias("links"))
    return digests.join(linked, ["group_key", "look", "raw"]).select(F.col("group_key").alias(group), "row_id", "class_id", "links")
