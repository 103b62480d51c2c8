"""SQL for those queries of the training-data operators that SQL can express on whole tables.

The look of a text is spelled out here by itself, from the statement of the problem and code point arithmetic, so that it checks the
operator's table and does not repeat it. It holds what the tables hold: mathematical styles and rarer alphabets are left to the tests.
"""

from __future__ import annotations

import unicodedata

TABLES = (("chapters_raw", "text"), ("chapter_inputs", "text"), ("voices", "ref_text"))

#: Kana of half width and what they stand for, in the order of their code points from U+FF61 on.
HALF_KANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\u3099\u309a"
#: Letters of Cyrillic, Greek and the phonetic alphabet, and under each the Latin letter it looks like.
DRAWN = "АВЕЅІЈКМНОРСТУХҮԌԚԜЁЇаеѕіјорсухүԁԛԝһӏёїΑΒΕΖΗΙΚΜΝΟΡΤΥΧΆΈΌΊΎαγινορυϲϳάίόύɑɡɩʏ"
LATIN = "ABESIJKMHOPCTYXYGQWËÏaesijopcyxydqwhlëïABEZHIKMNOPTYXÁÉÓÍÝayivopucjáíóúagiY"
#: Roman numerals from U+2160 and U+2170 on.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "L", "C", "D", "M")
SPELLED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "‥": "..", "№": "No", "℡": "TEL", "℃": "°C", "℉": "°F", "ǆ": "dž", "ǅ": "Dž", "Ǆ": "DŽ", "ǉ": "lj", "ǈ": "Lj", "Ǉ": "LJ", "ǌ": "nj", "ǋ": "Nj", "Ǌ": "NJ"}


def look(t: str) -> str:
    """SQL for the look of ``t``, character by character after line ends and what cannot be seen."""
    ends = f"translate(replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(11) || chr(12) || chr(133) || chr(8232) || chr(8233), repeat(chr(10), 5))"
    seen = f"regexp_replace({ends}, '[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x9f\\p{{Cf}}\\x{{34F}}\\x{{115F}}\\x{{1160}}\\x{{17B4}}\\x{{17B5}}\\x{{180B}}-\\x{{180F}}\\x{{3164}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FFA0}}]', '', 'g')"
    spaced = f"regexp_replace({seen}, '[\\t\\p{{Zs}}]', ' ', 'g')"
    drawn = f"translate({spaced}, '{DRAWN}', '{LATIN}')"
    radicals = [chr(c) for c in range(0x2E80, 0x2FE0) if len(unicodedata.normalize("NFKC", chr(c))) == 1]
    whole = f"translate({drawn}, '{''.join(radicals)}', '{''.join(unicodedata.normalize('NFKC', c) for c in radicals)}')"
    signs = f"translate({whole}, '￠￡￢￣￤￥￦‐‑〜～µ', '¢£¬¯¦¥₩--~~μ')"
    c = "unicode(c)"
    wide = (
        f"CASE WHEN {c} BETWEEN 65281 AND 65374 THEN chr({c} - 65248) WHEN {c} BETWEEN 65377 AND 65439 THEN substr('{HALF_KANA}', {c} - 65376, 1) "
        f"WHEN {c} BETWEEN 8544 AND 8575 THEN CASE WHEN {c} < 8560 THEN {list(ROMAN)}[{c} - 8543] ELSE lower({list(ROMAN)}[{c} - 8559]) END "
        + "".join(f"WHEN c = '{a}' THEN '{b}' " for a, b in SPELLED.items())
        + "ELSE c END"
    )
    return f"nfc_normalize(array_to_string(list_transform(string_split({signs}, ''), lambda c: {wide}), ''))"


def oracles() -> dict[str, str]:
    texts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, row_id, {f} AS t FROM {t}" for t, f in TABLES)
    looks = f"SELECT table_name, row_id, t, {look('t')} AS f FROM ({texts})"
    parted = "list_concat([title], CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END)"
    places = (
        f"SELECT site, row_id, (i - 1)::INTEGER AS line_no, trim({look('l')}, ' ' || chr(10)) AS f FROM "
        f"(SELECT site, row_id, unnest({parted}) AS l, generate_subscripts({parted}, 1) AS i FROM chapters_raw WHERE site IS NOT NULL) WHERE l IS NOT NULL"
    )
    return {
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p4_found": f"WITH p AS (SELECT * FROM ({places}) WHERE f <> ''), s AS (SELECT site, count(*) AS n FROM chapters_raw WHERE site IS NOT NULL GROUP BY site), "
        "c AS (SELECT p.site, f, count(DISTINCT row_id) AS k, any_value(n) AS n FROM p JOIN s ON p.site = s.site GROUP BY p.site, f) "
        "SELECT row_id, line_no FROM p JOIN c ON p.site = c.site AND p.f = c.f WHERE k >= 5 AND k >= 0.05::DOUBLE * n",
        "p1_found": f"WITH x AS (SELECT * FROM ({looks}) WHERE regexp_matches(f, '[^ \\n]')) SELECT a.table_name, a.row_id AS row_a, b.row_id AS row_b FROM x a JOIN x b ON a.table_name = b.table_name AND a.f = b.f AND a.row_id < b.row_id AND a.t <> b.t",
        "p1_classes": f"WITH x AS (SELECT *, md5(f) AS h FROM ({looks}) WHERE regexp_matches(f, '[^ \\n]')), c AS (SELECT table_name, h, count(*) AS n, count(DISTINCT t) AS k, min(row_id) AS class_id FROM x GROUP BY ALL), "
        "s AS (SELECT table_name, h, t, count(*) AS same FROM x GROUP BY ALL) SELECT x.table_name, x.row_id, c.class_id, c.n - s.same AS links FROM x JOIN c ON x.table_name = c.table_name AND x.h = c.h JOIN s ON x.table_name = s.table_name AND x.h = s.h AND x.t = s.t WHERE c.k > 1",
        "p1_canonical": f"SELECT table_name, row_id, f AS look_text FROM ({looks})",
    }
