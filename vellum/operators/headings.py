"""Headings, their categories, and what a book's pages tell of its heading classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions.text import compact, fold_quotes, spaced, strip

# The words of kernels.caps: what Python's \w has besides digits and _ are letters, letter numbers and other numbers.
WORD = r"[\p{L}\p{Nl}\p{No}](?:[\p{L}\p{Nl}\p{No}'’\-]|\u0300-\u036f)*"


def casefolded(c: Column) -> Column:
    """Without case as full case folding has it: capitals first, so that ß and ligatures become their letters."""
    return F.translate(F.lower(F.upper(c)), "ς", "σ")


def heading_key(c: Column, fold: bool = True) -> Column:
    """A heading for comparison: blanks collapsed, without case, quotes folded."""
    return casefolded(spaced(fold_quotes(c) if fold else c))


def distinct_headings(headings: Column, fold: bool = True) -> Column:
    """Headings without blank and repeated ones; of those with one key the first stays."""
    trimmed = F.filter(F.transform(headings, strip), lambda h: h != "")
    keys = F.transform(trimmed, lambda h: heading_key(h, fold))
    return F.filter(trimmed, lambda h, i: F.array_position(keys, heading_key(h, fold)) == i + 1)


def category(c: Column) -> Column:
    return F.when(F.lower(strip(F.coalesce(c, F.lit("")))) == "title", "title").otherwise("section")


def normal_categories(categories: Column) -> Column:
    """Heading key to category: a title wins over a section where keys meet."""
    pairs = F.transform(F.map_entries(categories), lambda e: F.struct(heading_key(e["key"]).alias("k"), category(e["value"]).alias("v")))
    named = F.filter(pairs, lambda e: e["k"] != "")
    titles = F.transform(F.filter(named, lambda e: e["v"] == "title"), lambda e: e["k"])
    keys = F.array_distinct(F.transform(named, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(F.array_contains(titles, k), "title").otherwise("section")))


def merged_categories(a: Column, b: Column) -> Column:
    """Two maps of heading categories as one: the greater category of each key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, y), F.coalesce(y, x)))  # "title" sorts after "section"


def with_title_category(title: Column, headings: Column, categories: Column) -> Column:
    """The chapter title's own heading is a title."""
    key = heading_key(F.coalesce(title, F.lit("")))
    known = (key != "") & F.exists(headings, lambda h: heading_key(h) == key)
    return F.when(known, F.map_from_entries(F.concat(F.filter(F.map_entries(categories), lambda e: e["key"] != key), F.array(F.struct(key.alias("key"), F.lit("title").alias("value")))))).otherwise(categories)


def book_categories(headings: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest category of each heading key of a book: sums of partial maxima."""
    rank = F.max(F.when(F.col("category") == "title", 2).otherwise(1))
    return headings.where("heading_key <> ''").groupBy(*keys, "heading_key").agg(F.when(rank == 2, "title").otherwise("section").alias("category"))


def heading_classes(hits: DataFrame, least: int = 4, share: float = 0.8) -> DataFrame:
    """Classes used for headings all over a book, from (book_id, class, uses, hits) of each page."""
    sums = hits.groupBy("book_id", "class").agg(F.sum("uses").alias("uses"), F.sum("hits").alias("hits"))
    return sums.where((F.col("hits") >= least) & (F.col("hits") >= share * F.col("uses"))).select("book_id", "class")


def usual_classes(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Classes of ordinary paragraphs of a page: all, or where one is used at least 8 times those used a fifth as much."""
    counts = paragraphs.where("class <> ''").groupBy(*keys, "class").agg(F.count("*").alias("uses"))
    most = F.max("uses").over(Window.partitionBy(*keys))
    least = F.when(most >= 8, F.greatest(F.lit(3), F.floor(most * F.lit(0.2)))).otherwise(0)
    return counts.withColumn("_least", least).where("uses >= _least").drop("_least")


def words(df: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """``keys, word, pos``: the words of each text as ``kernels.caps`` takes them, pos rising by ``order``, then by place."""
    found = F.posexplode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("p", "word")
    return df.select(*keys, F.col(order).alias("_o"), found).select(*keys, "word", (F.col("_o") * (1 << 24) + F.col("p")).alias("pos"))


def dominant_spelling(words: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The leading spelling of each word by its small letters: more uses, then better case, then the earlier one."""
    counted = words.where(F.col("word").rlike(r"\p{IsLowercase}")).groupBy(*keys, F.lower("word").alias("key"), "word").agg(F.count("*").alias("uses"), F.min(order).alias("first"))
    rank = F.when(F.col("word").rlike(r"^\p{IsUppercase}.*\p{IsLowercase}"), 3).when(~F.col("word").rlike(r"[\p{IsUppercase}\p{Lt}]"), 2).otherwise(1)
    best = F.max(F.struct("uses", rank.alias("rank"), (-F.col("first")).alias("early"), F.col("word").alias("spelling"))).alias("_b")
    return counted.groupBy(*keys, "key").agg(best).select(*keys, "key", "_b.spelling", "_b.uses", "_b.rank")


def section_marks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of symbols that mark sections, from (keys, line_no, line): the relational form of the inference.

    Runs of one mark between blank lines are isolated; marks whose symbols are common within the text are none."""
    from vellum.functions.predicates import bracketed, symbol_line

    w = Window.partitionBy(*keys).orderBy("line_no")
    x = lines.withColumn("l", strip("line"))
    x = x.withColumn("_run", F.sum(F.when(F.col("l").eqNullSafe(F.lag("l").over(w)), 0).otherwise(1)).over(w))
    runs = x.groupBy(*keys, "_run", "l").agg(F.min("line_no").alias("at"), F.count("*").alias("n"))
    r = Window.partitionBy(*keys).orderBy("at")
    alone = (F.coalesce(F.lag("l").over(r), F.lit("")) == "") & (F.coalesce(F.lead("l").over(r), F.lit("")) == "")
    marks = runs.withColumn("_alone", alone).where(symbol_line("l")).groupBy(*keys, F.col("l").alias("mark")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_alone"), F.col("n")).otherwise(0)).alias("isolated"))
    glyphs = lambda c: F.split(compact(c), "")
    inside = x.where((F.col("l") != "") & ~symbol_line("l")).select(*keys, F.explode(glyphs("l")).alias("g")).where("g <> ''").groupBy(*keys, "g").agg(F.count("*").alias("inside"))
    sizes = marks.select(*keys, "mark", "n", "isolated", F.posexplode(F.filter(glyphs("mark"), lambda g: g != "")).alias("_p", "g"))
    judged = sizes.join(inside, [*keys, "g"], "left").groupBy(*keys, "mark", "n", "isolated").agg(F.count("*").alias("size"), F.sum(F.coalesce("inside", F.lit(0))).alias("within"))
    rare = F.col("within") <= 0.35 * F.col("n") * F.col("size")
    several = (F.col("n") > 1) & (F.col("isolated") >= 0.8 * F.col("n"))
    single = (F.col("n") == 1) & (F.col("size") == 1) & (F.col("within") == 0)
    return judged.where(~bracketed("mark") & rare & (several | single)).select(*keys, "mark", "n", "isolated")
