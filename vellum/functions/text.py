"""Text functions as native Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellum.kernels.chars import JAVA_CHINESE, SB

C = Column | str
# Fixed value: quotes folded for comparison and cleaning.
FOLDED, PLAIN = "ʼ‘’«»", "'''\"\""
BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def re(c: C, pattern: str, to: str) -> Column:
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(to))


def fold_quotes(c: C) -> Column:
    return F.translate(col(c), FOLDED, PLAIN)


def unix_lines(c: C) -> Column:
    return re(c, "\r\n?", "\n")


def strip(c: C) -> Column:
    """Blanks of every kind off both ends."""
    return re(c, rf"^{BLANK}+|{BLANK}+\z", "")


def rstrip(c: C) -> Column:
    return re(c, rf"{BLANK}+\z", "")


def spaced(c: C) -> Column:
    """Blanks of every kind collapsed to one space, none at the ends."""
    return strip(re(c, f"{BLANK}+", " "))


def compact(c: C) -> Column:
    """Without any blank."""
    return re(c, BLANK, "")


def clean_read(c: C) -> Column:
    """A cleaned chapter as it is read: quotes and line ends folded, runs of blanks one space, one line end at the end."""
    x = re(unix_lines(fold_quotes(c)), "[ \t]+\n", "\n")
    return F.concat(strip(re(x, "[ \t]{2,}", " ")), F.lit("\n"))


def section_rules(c: C) -> Column:
    """Runs of three line ends or more as a section break, each break a paragraph of its own, none repeated or at the ends.

    Marks that a text uses as section breaks are inferred by ``udfs.clean_form``; this is the part without inference."""
    x = re(c, "\n{3,}", f"\n\n{SB}\n\n")
    x = re(x, f"[ \t]*{SB}[ \t]*", f"\n\n{SB}\n\n")
    x = re(x, "\n{3,}", "\n\n")
    x = re(x, f"{SB}(?:\n\n{SB})+", SB)
    return re(x, rf"\A(?:\s*{SB}\s*)+|(?:\s*{SB}\s*)+\z", "")


def without_section_breaks(c: C) -> Column:
    return F.replace(col(c), F.lit(SB), F.lit(""))


def page_normal(c: C) -> Column:
    """The page form, without inferred section marks."""
    x = section_rules(re(unix_lines(fold_quotes(c)), "[ \t]+\n", "\n"))
    x = re(re(x, "\n{3,}", "\n\n"), "[ \t]{2,}", " ")
    return strip(re(x, r"\.[ \t]*\.[ \t]*\.", "..."))


def clean_normal(c: C) -> Column:
    """The clean form, without inferred section marks."""
    x = section_rules(re(unix_lines(fold_quotes(c)), "[ \t]+\n", "\n"))
    x = re(x, "\n{3,}", "\n\n")
    x = re(x, r'(?m)(\A|[\s“("])\[([A-Za-z])\](?=[a-z])', "$1$2")
    x = re(x, r"-\n(?=[\p{L}\p{N}_])", "-")
    x = re(re(x, "[ \t]{2,}", " "), r"\.[ \t]*\.[ \t]*\.", "...")
    return strip(joined_dialogue(x))


def speech_normal(c: C) -> Column:
    """The speech form, without inferred section marks; quotes stay."""
    return strip(re(re(section_rules(unix_lines(c)), "[ \t]+", " "), "\n{3,}", "\n\n"))


def joined_dialogue(c: C) -> Column:
    """Paragraphs that break off with a comma or colon joined with a following quotation, in a fold over the paragraphs."""
    opens = r"^[ \t\x{3000}]*[「『（(【［\[｢“‘〈《]"

    def step(acc: Column, block: Column) -> Column:
        head = rstrip(acc)
        goes_on = head.rlike("[、，,:：]$") & block.rlike(opens)
        return F.when(goes_on, F.concat(head, F.lit("\n"), re(block, rf"^{BLANK}+", ""))).otherwise(F.concat(acc, F.lit("\n\n"), block))

    blocks = F.split(col(c), "\n\n", -1)
    return F.aggregate(F.slice(blocks, 2, F.size(blocks)), blocks[0], step)


def title_from_text(c: C, most: int = 40) -> Column:
    """The first line that is not blank, cut at ``most`` characters with three dots."""
    line = F.coalesce(F.get(F.filter(F.transform(F.split(col(c), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1), strip), lambda x: x != ""), 0), F.lit(""))
    return F.when(F.char_length(line) > most, F.concat(rstrip(F.substring(line, 1, most)), F.lit("..."))).otherwise(line)


def stem(c: C) -> Column:
    """A file's name without folder and suffix."""
    return re(re(c, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def title_from_filename(c: C) -> Column:
    """A title from a file's name: a leading number off, marks between words as blanks."""
    name = strip(stem(c))
    plain = strip(F.translate(re(name, "^[0-9]+[-_ ]+", ""), "_-", "  "))
    return F.when(plain != "", plain).otherwise(name)


def markdown_title(c: C) -> Column:
    """The heading of a text whose first line that is not blank is a heading, else an empty string."""
    first = F.coalesce(F.get(F.filter(F.transform(F.split(col(c), "\n", -1), strip), lambda x: x != ""), 0), F.lit(""))
    return F.when(first.startswith("#"), strip(re(first, "^#+", ""))).otherwise(F.lit(""))


def slug_ascii(c: C) -> Column:
    """Lower ASCII letters and figures with hyphens, 60 characters at most, ``chapter`` when nothing is left."""
    x = re(F.lower(col(c)), "[^a-z0-9]+", "-")
    x = F.substring(re(x, "^-+|-+$", ""), 1, 60)
    return F.when(x == "", F.lit("chapter")).otherwise(x)


def path_title(c: C) -> Column:
    """A title fit for a path: reserved marks as blanks, unprintable ones dropped, 80 characters at most."""
    x = re(F.translate(col(c), "/\\:*?\"<>|", " " * 9), r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}]", "")
    return rstrip(F.substring(re(spaced(x), r"^\.+|\.+$", ""), 1, 80))


def href_file(c: C) -> Column:
    """A link without its fragment, percent escapes decoded; a plus stays a plus."""
    return F.try_url_decode(re(re(c, "#.*$", ""), r"\+", "%2B"))


def href_fragment(c: C) -> Column:
    return F.try_url_decode(re(F.regexp_extract(col(c), "#(.*)$", 1), r"\+", "%2B"))


def is_http(c: C) -> Column:
    """An http or https address with a host."""
    return col(c).rlike(r"(?i)^https?://[^/?#]+")


def cache_key(c: C) -> Column:
    """The name a fetched source is kept under: 24 hex digits of its digest and its suffix."""
    path = re(re(c, "[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    return F.concat(F.substring(F.sha2(col(c), 256), 1, 24), F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def ellipsis_fold(c: C) -> Column:
    return re(c, "[…⋯]{3,}", "⋯")


def dash_runs(c: C) -> Column:
    return re(c, "[‐‑‒–—―─━]{2,}", " ")


def without_format(c: C) -> Column:
    return re(c, r"\p{Cf}", "")


def without_double_quotes(c: C) -> Column:
    return F.translate(col(c), '"“”«»„‟❝❞＂', "")


def spaces_to_pauses(c: C, full_stop: bool = True) -> Column:
    """Blanks between Chinese characters as pause marks, elsewhere one space."""
    zh = f"[{JAVA_CHINESE}]"
    x = re(c, f"(?<={zh})[ \\x{{3000}}]{{2,}}(?={zh})", "。" if full_stop else "、")
    return re(re(x, f"(?<={zh})[ \\x{{3000}}](?={zh})", "、"), r"[ \x{3000}]+", " ")


def wants_mark(c: C) -> Column:
    """Whether a line ends without a pause mark, closing quotes aside."""
    closing, marks = "[」』）】\\]〉》”’\"']", "[。！？?!…、，,;；:：]"
    line = col(c)
    return (line != "") & ~line.rlike("·$") & ~line.rlike(f"{marks}$") & ~line.rlike(f"{marks}{closing}+$")


def marked_lines(c: C) -> Column:
    """A full stop after every line of a Chinese text without a pause mark at its end."""

    def line(x: Column) -> Column:
        body = rstrip(x)
        return F.when((body != "") & wants_mark(body), F.concat(body, F.lit("。"), F.substring(x, F.char_length(body) + 1, F.char_length(x)))).otherwise(x)

    return F.when(col(c).rlike(f"[{JAVA_CHINESE}]"), F.array_join(F.transform(F.split(col(c), "\n", -1), line), "\n")).otherwise(col(c))


def ellipsis_run(c: C) -> Column:
    """The dots of a text of omission dots alone, quotes and blanks aside; else 0."""
    bare = re(compact(c), "[「『《〈【〔［｢〝」』》〉】〕］｣〞〟\"“”«»„‟❝❞＂'‘’‚‛＇]", "")
    return F.when(bare.rlike("^[…⋯]+$"), F.char_length(bare)).otherwise(0)


def ellipsis_pause(run: C) -> Column:
    n = col(run)
    return F.when(n > 0, F.least(F.lit(1200), F.lit(380) + 120 * (n - 1))).otherwise(0)


def gap_pause(gap: C) -> Column:
    """The pause that the gap between two chunks asks for: 3 at a section break, 5 or 3 at many line ends, else 1."""
    longest = F.array_max(F.transform(F.regexp_extract_all(col(gap), F.lit("(\n+)"), F.lit(1)), F.char_length))
    return F.when(F.instr(col(gap), SB) > 0, 3).when(longest >= 5, 5).when(longest >= 3, 3).otherwise(1)


def symbol_gap(gap: C) -> Column:
    """Whether a line of the gap holds a section break or symbols alone."""
    return F.exists(F.split(col(gap), "\n", -1), lambda x: (strip(x) != "") & ((F.instr(x, SB) > 0) | ~x.rlike(r"[\p{L}\p{N}]")))


def sha256(c: C) -> Column:
    return F.sha2(col(c), 256)


def chapter_id(path: C, index: C) -> Column:
    """A chapter's id: the stem of its file, else its number."""
    stem = re(re(F.coalesce(col(path), F.lit("")), "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.when(stem != "", stem).otherwise(F.format_string("%04d-chapter", col(index)))
