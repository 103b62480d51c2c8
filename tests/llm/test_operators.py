"""Each operator on small cases: what it must find, what it must leave, and the defined edge cases."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings, strategies as st

from vellum.llm import leaks, look, mojibake, pieces, sentences, sitelines, subjects, tokens


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# -- look --------------------------------------------------------------------------------------------------------


def test_alike_pairs(spark):
    data = [
        ("a", 1, "Café №1，好\r\n了"), ("a", 2, "Café No1,好\n了"), ("a", 3, "Café №1，好\r\n了"), ("a", 4, "Саfé No1,好\n了​"),
        ("a", 5, "cafe"), ("a", 6, "Cafe"), ("a", 7, "x²"), ("a", 8, "x2"), ("a", 9, "门"), ("a", 10, "門"), ("a", 11, None), ("a", 12, " 　"), ("a", 13, "​"),
        ("b", 1, "ｶﾞ"), ("b", 2, "ガ"), ("b", 3, "⼭"), ("b", 4, "山"), ("b", 5, "豈"), ("b", 6, "豈"), (None, 1, "q"), ("a", None, "Cafe"),
    ]
    df = spark.createDataFrame([(g, r, t, "clash") for g, r, t in data], "table_name string, row_id long, text string, look string")
    got = rows(look.alike_pairs(df), "table_name", "row_a", "row_b")
    assert got == [("a", 1, 2), ("a", 1, 4), ("a", 2, 3), ("a", 2, 4), ("a", 3, 4), ("b", 1, 2), ("b", 3, 4), ("b", 5, 6)]
    links = {(r.table_name, r.row_id): (r.class_id, r.links) for r in look.alike_classes(df).collect()}
    assert links[("a", 1)] == (1, 2) and links[("a", 2)] == (1, 3) and links[("b", 2)] == (1, 1) and len(links) == 10


def test_alike_pairs_of_a_hot_class(spark):
    data = [("a", i, "same" if i % 50 else "ѕame") for i in range(400)]
    got = look.alike_pairs(spark.createDataFrame(data, "table_name string, row_id long, text string"))
    assert got.count() == 8 * 392


def test_a_class_of_many_strings_is_parted(spark, monkeypatch):
    monkeypatch.setattr(look, "PART", 10)
    blanks = " \u00a0\u2002\u2003\u2009\u3000"
    data = [("t", i, "a" + blanks[i % 6] + "b" + blanks[i // 6 % 6] + "c" + blanks[i // 36] + "d") for i in range(100)] + [("t", 100 + i, "a b c d") for i in range(3)]
    got = look.alike_pairs(spark.createDataFrame(data, "table_name string, row_id long, text string"))
    want = sum(data[i][2] != data[j][2] for i in range(103) for j in range(i))
    assert got.count() == got.distinct().count() == want


def test_looks_of_many_scripts(spark):
    pairs = [("Ꭺ", "A"), ("ꓢ", "S"), ("𝐀", "A"), ("𝖠", "A"), ("Օ", "O"), ("ᗅ", "A"), ("ⲟ", "o"), ("µ", "μ"), ("ﻋ", "ع"), ("𝛼", "a")]
    differ = [("²", "2"), ("①", "1"), ("ₐ", "a"), ("門", "门"), ("É", "E"), ("︽", "《"), ("㎝", "cm")]
    df = spark.createDataFrame([(str(i), k, c) for i, p in enumerate(pairs + differ) for k, c in enumerate(p)], "table_name string, row_id long, text string")
    assert sorted(int(r.table_name) for r in look.alike_pairs(df).collect()) == list(range(len(pairs)))


def test_canonical_keeps_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Ａ ﬁ…")], "k0 long, t string")
    assert rows(look.canonical(df, ["k0"], "t"), "k0", "look_text")[1:] == [(2, ""), (3, "A fi...")]
    assert look.canonical(df.limit(0), ["k0"], "t").count() == 0


# -- sentences and pieces ----------------------------------------------------------------------------------------

CASES = {
    "“天要变了！灯还亮着。”他问，走了。再来": ["“天要变了！灯还亮着。”他问，走了。", "再来"],
    "姑娘问“把信给我？”时，他在。清晨": ["姑娘问“把信给我？”时，他在。", "清晨"],
    "他说：“走。来！”端午前夕，下雨。": ["他说：“走。来！”", "端午前夕，下雨。"],
    "翻开《灯还亮着！》第6页（没有。），走。": ["翻开《灯还亮着！》第6页（没有。），走。"],
    "「行く。来た！」と彼は言った。次。": ["「行く。来た！」と彼は言った。", "次。"],
    "Dr. Vesk paid 3.50 at 1 p.m. “Not now.” was all. See vol. 2, pp. 5 ff., e.g. www.a.example/no.4 (cf. x). Then": [
        "Dr. Vesk paid 3.50 at 1 p.m.", "“Not now.” was all.", "See vol. 2, pp. 5 ff., e.g. www.a.example/no.4 (cf. x).", "Then",
    ],
    "« Où ? » demanda-t-il. M. Odilon hésita... puis vint ! Oui": ["« Où ? » demanda-t-il.", "M. Odilon hésita... puis vint !", "Oui"],
    "“रुक जाओ! कौन है?” नीरव ने पूछा, फिर गया। डॉ. राम ने 3 दिए॥": ["“रुक जाओ! कौन है?” नीरव ने पूछा, फिर गया।", "डॉ. राम ने 3 दिए॥"],
    "มาแล้ว ไปไหน": ["มาแล้ว ไปไหน"],
    "12. Title here\n\n  ***\r\n　好……？！\n……\n等等……然后走了": ["12. Title here", "好……？！", "等等……然后走了"],
    "“never closed. And on": ["“never closed.", "And on"],
}


@pytest.mark.parametrize("text", CASES)
def test_units(text):
    assert [text[a:b] for a, b in sentences.units(text)] == CASES[text]


def test_a_quotation_at_a_line_end_is_held_by_what_goes_on_after_the_ones_before():
    text = "“I don’t believe it. Wait for me.” said Tobin Dask, until her brother came back. “Not tonight. Close the door!”\nEnd"
    assert [text[a:b] for a, b in sentences.units(text)] == ["“I don’t believe it. Wait for me.” said Tobin Dask, until her brother came back.", "“Not tonight. Close the door!”", "End"]


def greedy(s):
    """Every place cut whose own evidence is above zero, from left to right."""
    start, out, nodes = 0, [], sentences.places(s)
    for node in nodes[:-1]:
        usual, own = sentences.closing(s, node)
        if (own if start == max(node.quote, node.bracket) or (node.figures and s[start : node.end].strip(" .").isdigit()) else usual) > 0:
            out.append(node.end)
            start = sentences.next_at(s, node.end)
    return [*out, len(s)]


def test_length_and_opening_decide_with_the_places():
    long = (
        "For many years nobody in the old ferry stage had spoken of the court of public opinion or of the garden wall beside the gate, and yet the clerk and her brother came back from the U.S. "
        "Tobin Dask had counted the letters in the wooden box by then, so that the older people kept talking about it until the rowing boat had left the harbour for the last time."
    )
    short = "He left the U.S. Tobin stayed."
    ends = lambda s: sentences.chosen(s, sentences.places(s))
    assert ends(short) == greedy(short) == [len(short)]
    assert ends(long) == [long.index(" Tobin"), len(long)] != greedy(long)


def chain_score(s, chain):
    nodes = {n.end: n for n in sentences.places(s)}
    start, score = 0, 0.0
    for k, end in enumerate(chain):
        node, last = nodes[end], end == chain[-1]
        usual, own = (0.0, 0.0) if last else sentences.closing(s, node)
        special = start == max(node.quote, node.bracket) or (node.figures and s[start : node.end].strip(" .").isdigit())
        size = end - start
        score += (own if special else usual) + (sentences.opening(s, start) if k else 0.0) - sentences.SHORT * (size < 4)
        score -= sentences.EMPTY * (sentences.LETTER.search(s, start, end) is None) + sentences.EACH * min(max(0, size - sentences.LONG), sentences.FAR - sentences.LONG)
        start = sentences.next_at(s, end)
    return score


def best_score(s):
    """The score of the best of all chains."""
    ends = [n.end for n in sentences.places(s)]
    chains = ([e for i, e in enumerate(ends[:-1]) if mask >> i & 1] + ends[-1:] for mask in range(1 << (len(ends) - 1)))
    return max(chain_score(s, c) for c in chains)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["U.S. ", "“Go now.” ", "said Tom. ", "(See it.) ", "The man ", "Inc. ", "12. ", "x" * 90 + " ", "A. ", "no. 5 ", "went on; ", "e.g. "]), min_size=1, max_size=9))
def test_the_search_finds_the_best_chain(parts):
    s = sentences.folded("".join(parts).rstrip())
    assert chain_score(s, sentences.chosen(s, sentences.places(s))) == pytest.approx(best_score(s))


def test_long_lines_take_seconds():
    import time

    for part, n in (("The man said so to me at 5 p.m. and left. ", 100_000), ("「あ。」と", 50_000), ("e.g. ", 50_000), ("U.S. Tobin ", 50_000)):
        began = time.process_time()
        found = len(sentences.units(part * n))
        assert time.process_time() - began < 60 and found in (n, 1)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 .。？!“”「」（）《》\n　​，…\"’说Ａ", max_size=60))
def test_units_are_ordered_spans_with_content(text):
    last = 0
    for a, b in sentences.units(text):
        assert last <= a < b <= len(text) and "\n" not in text[a:b] and not text[a].isspace() and not text[b - 1].isspace()
        assert any(c.isalnum() for c in text[a:b])
        last = b
    covered = {i for a, b in sentences.units(text) for i in range(a, b)}
    assert all(i in covered for i, c in enumerate(text) if c.isalnum() and c.isascii())


def test_sentence_units_of_nulls_empty_tables_and_long_texts(spark):
    df = spark.createDataFrame([("x", 1, None), ("x", 2, ""), ("x", 3, "好。" * 50_000), ("x", 4, "a" * 200_000)], "table_name string, row_id long, text string")
    got = sentences.sentence_units(df, ["table_name", "row_id"], "text")
    assert got.where("row_id = 3").count() == 50_000 and got.where("row_id = 4").count() == 1 and got.count() == 50_001
    assert sentences.sentence_units(df.limit(0), ["row_id"], "text").count() == 0


def brute_cut(text, limit, overlap):
    ends, p, out = {e for _, e in sentences.units(text)}, 0, []
    while len(text) - p > limit:
        end = None
        for good in (lambda x: x in ends, lambda x: text[x - 1] in "，、；：" or text[x - 1].isspace()):
            end = end or next((x for x in range(p + limit, p + overlap, -1) if good(x) and any(c.isalnum() for c in text[p:x])), None)
        end = end or p + limit
        out.append((p, end))
        p = end - overlap
    return [*out, (p, len(text))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab。，！ \n“”好", max_size=120), st.integers(4, 25), st.integers(0, 3))
def test_pieces_against_brute_force(text, limit, overlap):
    got = pieces.cut(text, limit, overlap)
    assert got == brute_cut(text, limit, overlap)
    even = pieces.cut(text, limit, overlap, "total")
    assert even[-1][1] == len(text) and all(b - a <= limit for a, b in even) and all(y[0] == x[1] - overlap for x, y in zip(even, even[1:]))


def test_pieces_limits(spark):
    limits = spark.createDataFrame([("t", "en", 10, 2), ("t", "*", 5, 0)], "table_name string, lang string, max_chars int, overlap_chars int")
    df = spark.createDataFrame([("t", 1, "en", "one two three four"), ("t", 2, None, "one two"), ("t", 3, "en", "short"), ("t", 4, "en", None), ("u", 5, "en", "x" * 99)], "table_name string, row_id long, lang string, text string")
    got = rows(pieces.pieces(pieces.with_limits(df, limits), ["table_name", "row_id"], "text", "max_chars", "overlap_chars"), "row_id", "start_pos", "end_pos")
    assert [g for g in got if g[0] == 2] == [(2, 0, 4), (2, 4, 7)] and {g[0] for g in got} == {1, 2}
    with pytest.raises(ValueError):
        pieces.cut("abcdef", 3, 3)


# -- lines of a site ---------------------------------------------------------------------------------------------


def test_site_lines(spark):
    data = []
    for i in range(60):
        body = f"line {i}\nother {i}"
        text = f"{body}\r\n Ｓubscribe now \r\nAll rights​ reserved" if i % 3 == 0 else f"{body}\n\n" if i % 3 == 1 else None
        data.append((i, "s", "Notice" if i < 4 else f"t{i}", text, "x"))
    data += [(100 + i, None, "Notice", "All rights reserved") for i in range(0)] + [(100, None, "Notice", "All rights reserved", "x"), (101, "t", "Notice", "All rights reserved\nAll rights reserved", "x")]
    df = spark.createDataFrame(data, "row_id long, site string, title string, text string, line string")
    got = rows(sitelines.occurrences(df), "row_id", "line_no")
    assert got == [(i, n) for i in range(0, 60, 3) for n in (3, 4)]
    *_, blocks = sitelines.boilerplate(df)
    assert blocks.count() == 2 and blocks.select("block").distinct().count() == 1
    clean = {r.row_id: (r.text, r.removed) for r in sitelines.removed(df).collect()}
    assert clean[0] == ("line 0\nother 0", 2) and clean[1] == ("line 1\nother 1\n\n", 0) and clean[2] == (None, 0) and len(clean) == 62
    assert sitelines.occurrences(df.limit(0)).count() == 0


def test_a_block_goes_with_the_blank_lines_between_its_own(spark):
    """Both lines stand in every row; only where they mostly follow each other is there an edge, and the blank line between them goes."""
    def run(linked):
        text = lambda i: f"body {i}\r\nShare this\r\n\r\nAll rights reserved\r\nend {i}" if i in linked else f"Share this\n\nbody {i}\n\nAll rights reserved\nend {i}"
        data = [(i, "s", None, text(i)) for i in range(20)]
        return {r.row_id: (r.text, r.removed) for r in sitelines.removed(spark.createDataFrame(data, "row_id long, site string, title string, text string")).collect()}

    often = run(set(range(10)))
    assert often[0] == ("body 0\r\nend 0", 3) and often[15] == ("\nbody 15\n\nend 15", 2)
    assert run({0, 1, 2})[0] == ("body 0\r\n\r\nend 0", 2)  # three rows are no edge


def test_site_lines_against_brute_force(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("ab"), rng.choice(["T", f"t{i}"]), "\n".join(rng.choice(["foo", "bar", "", f"l{i}", "foo "]) for _ in range(4))) for i in range(80)]
    want = []
    for s in "ab":
        own = [d for d in data if d[1] == s]
        seen = {}
        for r, _, t, x in own:
            for line in {v.strip() for v in [t, *x.split("\n")]} - {""}:
                seen[line] = seen.get(line, 0) + 1
        keep = {k for k, n in seen.items() if n >= 5 and n >= 0.05 * len(own)}
        want += [(r, i) for r, _, t, x in own for i, v in enumerate([t, *x.split("\n")]) if v.strip() in keep]
    df = spark.createDataFrame(data, "row_id long, site string, title string, text string")
    assert rows(sitelines.occurrences(df), "row_id", "line_no") == sorted(want)


# -- wrong encodings ---------------------------------------------------------------------------------------------

SOUND = ["温守拙喊道：“门没有锁。”", "The grey coat — it was late.", "Clémence a oublié l’île à Vaudrême.", "翌朝、灯子は木箱を思い出した。", "रुक जाओ! कौन है?", "มาแล้ว ไปไหน", "Старик молча закрыл дверь.", "Ο γέρος έκλεισε την πόρτα.", "舒若谷與聞臨川約在石鼓客棧"]
EXAMPLES = ["The label read “Ã©” until somebody changed the font.", "屏幕角落里有个“�”符号。", "他说网页上只剩“锟斤拷”几个怪字。", "Toleranz ± 0,5 µm, § 12, ½ Liter £ 3.", "Õlu ja jõgi, Žilvinas, Łódka, Čeněk, Þórunn.", "ÅÄÖ står på skylten vid bron."]


@pytest.mark.parametrize("text", SOUND + EXAMPLES)
def test_sound_text_stays(text):
    assert mojibake.repair(text) == (text, False)


@pytest.mark.parametrize("text", SOUND[:6])
@pytest.mark.parametrize("read", ["latin-1", "cp437", "mac_roman"])
def test_utf8_misread_comes_back(text, read):
    wrong = text.encode().decode(read)
    assert mojibake.repair(f"a sound line\n{wrong}") == (f"a sound line\n{text}", True)


def test_other_misreadings():
    zh = "温守拙喊道，门没有锁。乌篷渡口的船夫们再三认出照片。"
    assert mojibake.repair(zh.encode("gb18030").decode("latin-1")) == (zh, True)
    twice = zh.encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.repair(twice) == (zh, True)
    assert mojibake.repair("Cl�mence a cach� l��le") == ("Cl�mence a cach� l��le", True)
    assert mojibake.repair("翌朝、灯子は木箱を思い出した。".encode("cp932").decode("latin-1"))[1]
    assert mojibake.repair(None) == (None, False) and mojibake.repair("") == ("", False)


@pytest.mark.parametrize("wrote,read", [("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("gb18030", "latin-1"), ("utf-8", "gb18030")])
def test_a_short_garbled_stretch_in_a_long_sound_line(wrote, read):
    before, after = "雨停之后，乔知秋照旧把账本放在桌上，好在钱庄没有想象中容易，云梯渡口的人都说 Café Lorian 的灯还亮着。" * 2, "，姑娘们不声不响地走过枫桥头的车站，月亮升起时才发觉那封信值得再看一遍。" * 2
    assert mojibake.repair(f"{before}银票市价{after}".replace("银票市价", "银票市价".encode(wrote).decode(read))) == (f"{before}银票市价{after}", True)


def test_a_short_garbled_stretch_in_other_scripts():
    for line, word in (("เช้าวันนั้นเธอเดินไปตลาดกับน้องสาวและซื้อผลไม้หลายอย่างกลับบ้าน" * 2, "ตลาด"), ("उस सुबह वह अपनी बहन के साथ बाज़ार गई और बहुत से फल लेकर घर लौटी। " * 2, "बहन"), ("あの朝、彼女は妹と市場へ行って、たくさんの果物を買って家に帰りました。" * 2, "果物を")):
        wrong = line.replace(word, word.encode().decode("latin-1"), 1)
        assert mojibake.repair(wrong) == (line, True)
    for sound in ("公司名后常见™®©等标记，货币则写作€，各地不同，读者自会分辨。", "设x∈A，y≥x，且∑≤∞，则命题成立，证明从略，见前一章的第三节。", "他在 Café Été 读了 «Élégie» 和 Достоевский 的书，回来后久久不语。" * 2):
        assert mojibake.repair(sound) == (sound, False)


#: Sentences with the encodings they may have been written in.
WRITTEN = [
    ("Привет, старик молча закрыл дверь и вышел на улицу.", "utf-8 cp1251 koi8_r"), ("เช้าวันนั้นเธอเดินไปตลาดกับน้องสาว", "utf-8 cp874"), ("그날 아침 그녀는 여동생과 함께 시장에 갔다.", "utf-8 cp949"),
    ("温守拙喊道，门没有锁。乌篷渡口的船夫们再三认出照片。", "utf-8 gb18030"), ("版权信息", "utf-8 gb18030"), ("舒若谷與聞臨川約在石鼓客棧，門沒有鎖。", "utf-8 big5hkscs gb18030"),
    ("翌朝、灯子は木箱を思い出した。", "utf-8 cp932 euc_jp"), ("Ο γέρος έκλεισε την πόρτα και έφυγε.", "utf-8 cp1253"), ("Clémence a oublié l’île à Vaudrême, très tard.", "utf-8"), ("रुक जाओ! कौन है?", "utf-8"),
]


@pytest.mark.parametrize("read", ["latin-1", "cp1252", "mac_roman", "cp437", "koi8_r", "cp1251"])
def test_exact_restoration_of_every_script(read):
    back = {v: k for k, v in mojibake.one_byte(read).items()}
    for text, encodings in WRITTEN:
        for wrote in encodings.split():
            if wrote == read or (wrote, read) == ("cp1253", "cp1251"):  # Greek read as Cyrillic in small letters looks like text
                continue
            wrong = "".join(chr(back[b]) for b in text.encode(wrote))
            assert mojibake.repair(wrong) == (text, True), (wrote, read)


def test_any_number_of_layers_and_stretches_of_latin():
    wrong = "café"
    for _ in range(6):
        wrong = wrong.encode().decode("latin-1")
    assert mojibake.repair(wrong) == ("café", True)
    assert mojibake.repair("naïve cafÃ© déjà vu") == ("naïve café déjà vu", True)
    assert mojibake.repair("Clémence a oublié l’île".encode("cp1252").decode("mac_roman")) == ("Clémence a oublié l’île", True)
    for sound in ("Il dit «CAFÉ» et « ÉTÉ », puis BLÅ».", "At ﬁrst light, Tobin Késten gave the coat away.", "Саfé Lorian, МасEwan и Мария МакДональд."):
        assert mojibake.repair(sound) == (sound, False)


def test_nothing_sound_is_lost_at_torn_edges():
    assert mojibake.repair("他说“Ã©Ã¨Ã¼Ã¶Ã¤”。") == ("他说“éèüöä”。", True)
    got, bad = mojibake.repair("前面是好的句子，" + "银票市价".encode().decode("latin-1")[:-1] + "，后面也是好的。")
    assert bad and got.startswith("前面是好的句子，银票市") and got.endswith("，后面也是好的。")


def test_the_length_of_a_quoted_example_is_a_parameter():
    line = "The label read “Ã©Ã¨Ã¼Ã¶Ã¤” until somebody changed the font."
    assert mojibake.repair(line)[1] and mojibake.repair(line, 10) == (line, False)


def test_repaired_rows(spark):
    df = spark.createDataFrame([("t", 1, "CafÃ© Lorian"), ("t", 2, "Café Lorian"), ("t", 3, None), ("t", 1, "CafÃ© Lorian")], "table_name string, row_id long, text string")
    assert rows(mojibake.repaired(df, ["table_name", "row_id"], "text"), "row_id", "restored") == [(1, "Café Lorian")] * 2


# -- tokens ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.read_ranks(f"{tokens.FOLDER}/{tokens.BYTE_BPE_50K}"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_against_a_library(encoder, text):
    tokenizers = pytest.importorskip("tokenizers")
    global _library
    if "_library" not in globals():
        _library = tokenizers.Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
        _library.encode_special_tokens = True
    raw = encoder.ids(text)
    assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == _library.encode(text, add_special_tokens=False).ids


def test_ids_of_defined_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "<|endoftext|>"), (5, "裏覚醒\U0001f600" * 999), (None, "a")], "doc_id long, text string")
    ids = tokens.encoded(df, "doc_id", "text")
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got[1] == got[2] == [] and got[3] == [220] and 50256 not in got[4] and got[None] == [64]
    back = {r.doc_id: r.text for r in tokens.decoded(ids, "doc_id", "ids").collect()}
    assert back == {1: "", 2: "", 3: " ", 4: "<|endoftext|>", 5: "裏覚醒\U0001f600" * 999, None: "a"}


# -- leaks -------------------------------------------------------------------------------------------------------


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_leaks(spark):
    item, zh = words(1, 90), "".join(chr(0x4E00 + random.Random(2).randrange(k, k + 3000)) for k in range(100))
    filler = lambda s: words(s, 300)
    half = item[:45]
    docs = [
        (1, " ".join(filler(3) + item + filler(4))), (2, " ".join(filler(5)).upper() + "; " + ", ".join(half).upper()), (3, " ".join(filler(6) + item[:15])),
        (4, None), (5, ""), (6, "x " + zh[:60] + "！" + zh[60:]), (7, " ".join(filler(7))), (8, " ".join(filler(3) + item + filler(4))), (None, " ".join(item)),
        (9, " ".join(x if i % 20 else "changed" for i, x in enumerate(item))),
    ]
    items = [(10, " ".join(item)), (11, zh), (12, None), (13, "too short"), (14, " ".join(item))]
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, value string")
    t = spark.createDataFrame(items, "item_id long, text string")
    got = rows(leaks.leaks(d, t), "doc_id", "item_id")
    assert got == [(1, 10), (1, 14), (2, 10), (2, 14), (6, 11), (8, 10), (8, 14), (9, 10), (9, 14)]
    assert leaks.leaks(d.limit(0), t).count() == 0 and leaks.leaks(d, t.limit(0)).count() == 0


def test_short_items_are_held_whole(spark):
    docs = [(1, "before, Quince jelly; after it all"), (2, "jelly quince"), (3, "他说银票市价涨了"), (4, "quince"), (5, "银票"), (6, None)]
    items = [(1, "quince jelly"), (2, "银票市价"), (3, "…!"), (4, "")]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(leaks.leaks(d, t), "doc_id", "item_id") == [(1, 1), (3, 2)]


def test_recall_of_sampled_sketches(spark):
    """Items of 300 to 5,000 shingles, of which a sketch keeps a part: against the exact search, and against what was planted."""
    sizes = [300, 500, 800, 1300, 2100, 3400, 5000]
    items = [(k, words(1000 + k, n)) for k, n in enumerate(sizes * 6)]
    docs = []
    for k, item in items:
        a, b = len(item) // 10, len(item) // 10 + len(item) * 9 // 40  # two stretches of nine fortieths
        docs.append((k, " ".join(words(5000 + k, 200) + item[a:b] + words(7000 + k, 300) + item[-(b - a) :] + words(9000 + k, 50))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    simplify = tuple(leaks.S.simplified(spark).items())
    kept = {r.item_id: r.n for r in leaks.sketches(t, "item_id", "text", simplify).groupBy("item_id").count().withColumnRenamed("count", "n").collect()}
    assert all(kept[k] < len(x) - 4 for k, x in items if len(x) > 300) and max(kept.values()) < 350
    exact, sampled = (set(rows(leaks.leaks(d, t, most=m), "doc_id", "item_id")) for m in (None, leaks.SKETCH))
    assert exact == {(k, k) for k, _ in items} and len(sampled & exact) >= 0.95 * len(exact) and sampled <= exact


def test_sketches_joined_by_value(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BROADCAST_VALUES", 0)
    item = words(77, 60)
    d = spark.createDataFrame([(i, " ".join(words(i, 30) + item)) for i in range(40)], "doc_id long, text string")
    assert leaks.leaks(d, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).count() == 40


def test_leaks_across_scripts(spark):
    a, b = "那年冬天岑望舒独自部署备份好在缓存经得起细看陆衡远与尹云岫约在青石河湾", "那年冬天，岑望舒獨自部署備份；好在緩存經得起細看。陸衡遠與尹雲岫約在青石河灣"
    d = spark.createDataFrame([(1, b)], "doc_id long, text string")
    assert rows(leaks.leaks(d, spark.createDataFrame([(1, a)], "item_id long, text string")), "doc_id", "item_id") == [(1, 1)]


def test_leaks_in_a_few_stretches_and_with_changed_words(spark):
    item, zh = words(21, 63), "".join(chr(0x4E00 + random.Random(22).randrange(k, k + 3000)) for k in range(186))
    filler = lambda s: words(s, 60)
    docs = [
        (1, " ".join(filler(1) + item[30:43] + filler(2) + item[5:18] + filler(3))),  # two fifths in two stretches
        (2, zh[:25] + "。" + " ".join(filler(4)) + zh[60:85] + " ".join(filler(5)) + zh[120:145]),  # and in three
        (3, " ".join(filler(6) + [x if (i + 1) % 7 else "changed" for i, x in enumerate(item)] + filler(7))),
        (4, " ".join(y for k in range(0, 63, 7) for y in item[k : k + 7] + filler(100 + k))),  # phrases only
        (5, " ".join(filler(8) + item[:12] + filler(9) + item[40:52])),  # less than two fifths
    ]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item)), (2, zh)], "item_id long, text string")
    assert rows(leaks.leaks(d, t), "doc_id", "item_id") == [(1, 1), (2, 2), (3, 1)]


# -- subjects ----------------------------------------------------------------------------------------------------

TERMS = {"music": "violin chorus melody tempo anthem cello".split(), "law": "statute verdict appeal witness clause bailiff".split()}


def subject_docs(seed=3, n=240):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        main = [["music"], ["law"], ["music", "law"], []][i % 4]
        sents = []
        for j in range(12):
            s = main[j % len(main)] if main and j < 8 else None
            noun = rng.choice(TERMS[s]) if s else rng.choice(["door", "coat", "lamp", "river", "bread", "stair"])
            other = rng.choice(TERMS[s]) if s else rng.choice(["door", "coat", "lamp", "river", "bread", "stair"])
            sents.append(f"{rng.choice(['Ann', 'Bob', 'Eve'])} saw the {noun} and the {other} near the mill.")
        docs.append((i, " ".join(sents)))
        truth[i] = set(main)
    return docs, truth


def test_subjects(spark):
    docs, truth = subject_docs()
    labels = [(i, f" {s.upper()}", "a") for i in range(0, 240, 3) for s in truth[i]] + [(1, "nonsense", None), (None, "law", "b"), (2, None, "b")]
    d = spark.createDataFrame([*docs, (900, None), (901, "  "), (None, "x")], "doc_id long, text string")
    names = spark.createDataFrame([("music", ""), ("law", ""), ("astronomy", "")], "subject string, note string")
    found, _ = subjects.subject_shares(d, names, spark.createDataFrame(labels, "doc_id long, subject string, labeller string"))
    got = {i: set() for i in truth}
    for r in found.collect():
        assert 0 < r.share <= 1 and 0 <= r.probability <= 1
        got[r.doc_id].add(r.subject)
    assert sum(got[i] == truth[i] for i in truth) >= 0.97 * len(truth)


def test_subjects_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    names = spark.createDataFrame([("music",)], "subject string")
    labels = spark.createDataFrame([], "doc_id long, subject string, labeller string")
    assert subjects.subject_shares(d, names, labels)[0].count() == 0


# -- the queries -------------------------------------------------------------------------------------------------


def test_queries_run_and_keep_their_columns(spark, small):
    from vellum.llm import queries

    want = {
        "p1_found": {"table_name", "row_a", "row_b"}, "p2_found": {"table_name", "row_id", "start_pos", "end_pos"}, "p3_found": {"table_name", "row_id", "start_pos", "end_pos"},
        "p4_found": {"row_id", "line_no"}, "p5_found": {"table_name", "row_id"}, "p6_ids": {"doc_id", "ids"}, "p7_found": {"doc_id", "item_id"}, "p8_found": {"doc_id", "subject"},
    }
    all_queries = queries.queries()
    for name, columns in want.items():
        df = all_queries[name](spark, small)
        assert set(df.columns) == columns and df.count() > 0, name


@pytest.mark.parametrize("name", ["p1_found", "p1_classes", "p1_canonical", "p4_found", "p6_decoded"])
def test_queries_agree_with_their_sql(spark, small, name):
    from pathlib import Path

    from vellum.llm import queries

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert sorted(map(repr, df.select(columns).collect())) == sorted("Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(columns, r)) + ")" for r in want.select(*columns).fetchall())
