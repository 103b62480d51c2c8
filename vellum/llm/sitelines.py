"""Problem 4: lines that one site puts into very many of its documents.

The lines of a site form a weighted graph: a node is a line by its look, weighted by the rows it stands in, and an
edge joins two lines that follow each other in a row, weighted by the rows where they do. Nodes and edges of high
support are kept; the connected components of what is left are the site's boilerplate blocks. A node is kept when
it stands in at least ``least`` rows and at least ``share`` of all rows of its site. Which lines are found thus follows from
their own support; the edges tell which of them belong together, and with them the blank lines between go when a block is deleted.

The nodes kept of a site number at most (mean lines of a row) / share, a bound by the threshold itself whatever
the size of the site, so the components are found site by site; everything before is sums and joins with partial
aggregation, keyed by site and line, so that a site with a third of all rows is spread over all tasks.

Defined cases: rows with null site or id take no part; null titles and texts have no line, but their rows count for the
site; blank lines are none; a line that returns within a row counts once for support and is reported each time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vellum.llm.duck import map_sql
from vellum.llm.look import fold_sql
from vellum.session import spread, written

PART = "\ufdd0"


def lines(df: DataFrame, row: str = "row_id", site: str = "site", title: str = "title", text: str = "text") -> DataFrame:
    """``site, row_id, line_no, rank, line``: the look digest of each line that is not blank, and its rank among those of its
    row; line 0 is the title.

    The blanks at both ends do not count. Lines are parted by LF or CR LF."""
    own = df.where(F.col(site).isNotNull() & F.col(row).isNotNull()).select(F.col(site).alias("site"), F.col(row).cast("long").alias("row_id"), F.col(title).alias("title"), F.col(text).alias("t"))
    # a whole text is folded at once: line ends become a noncharacter first, which the fold leaves alone
    whole = f"concat(replace(coalesce(title, ''), '{PART}', ''), '{PART}', regexp_replace(replace(coalesce(t, ''), '{PART}', ''), '\\r?\\n', '{PART}', 'g'))"
    sql = (
        "SELECT site, row_id, (i - 1)::INTEGER AS line_no, (row_number() OVER (PARTITION BY row_id ORDER BY i))::INTEGER AS rank, unhex(md5(f)) AS line FROM ("
        f"SELECT site, row_id, i, regexp_replace(l, '^[ \\n]+|[ \\n]+$', '', 'g') AS f FROM "
        f"(SELECT site, row_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT site, row_id, string_split({fold_sql('w')}, '{PART}') AS ls FROM (SELECT site, row_id, {whole} AS w FROM batch)))) WHERE f <> ''"
    )
    return map_sql(spread(own, "row_id"), sql, "site string, row_id long, line_no int, rank int, line binary")


def support(lines: DataFrame, rows: DataFrame, least: int = 5, share: float = 0.05) -> DataFrame:
    """``site, line, support, of``: the lines that stand in at least ``least`` rows and ``share`` of the rows of their site."""
    sites = rows.where("site IS NOT NULL").groupBy("site").agg(F.count("*").alias("of"))
    # places are at least as many as rows: most lines fall out before their rows are counted
    nodes = lines.groupBy("site", "line").agg(F.count("*").alias("places")).where(F.col("places") >= least)
    counted = (
        lines.join(nodes.join(sites, "site").where(F.col("places") >= share * F.col("of")).select("site", "line", "of"), ["site", "line"])
        .groupBy("site", "line", "of", "row_id").agg(F.count("*").alias("n"))
        .groupBy("site", "line", "of").agg(F.count("*").alias("support"))
    )
    return counted.where((F.col("support") >= least) & (F.col("support") >= share * F.col("of"))).select("site", "line", "support", "of")


def followers(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """``site, of, row_id, line_no, line, next_line, next_no``: kept lines and the kept line that follows with no other line between them."""
    kept = places.join(nodes.select("site", "line", "of"), ["site", "line"])
    w = Window.partitionBy("site", "row_id").orderBy("line_no")
    after = kept.withColumns({"next_line": F.lead("line").over(w), "next_no": F.lead("line_no").over(w), "_next": F.lead("rank").over(w)})
    return after.where("_next = rank + 1").select("site", "of", "row_id", "line_no", "line", "next_line", "next_no")


def edges(pairs: DataFrame, least: int = 5, share: float = 0.05) -> DataFrame:
    """``site, line, next_line, support``: lines that follow each other often enough."""
    counted = pairs.select("site", "line", "next_line", "of", "row_id").distinct().groupBy("site", "line", "next_line", "of").agg(F.count("*").alias("support"))
    return counted.where((F.col("support") >= least) & (F.col("support") >= share * F.col("of"))).drop("of")


def blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``site, line, support, block``: kept lines with their connected component, named by its least digest."""

    def components(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        parent = {x: x for x in n["line"]}

        def root(x: bytes) -> bytes:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(e["line"], e["next_line"]):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return n.assign(block=[root(x).hex() for x in n["line"]])[["site", "line", "support", "block"]]

    return nodes.select("site", "line", "support").groupBy("site").cogroup(edges.groupBy("site")).applyInPandas(components, "site string, line binary, support long, block string")


def boilerplate(df: DataFrame, least: int = 5, share: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(places, pairs, edges, blocks)``: all lines by place, the kept lines that follow each other, the kept edges, and the blocks of each site."""
    places = written(lines(df), "lines")
    nodes = written(support(places, df.select("site"), least, share), "nodes")
    pairs = followers(places, nodes)
    links = written(edges(pairs, least, share), "edges")
    return places, pairs, links, blocks(nodes, links)


def occurrences(df: DataFrame, least: int = 5, share: float = 0.05) -> DataFrame:
    """``row_id, line_no`` of every line of a boilerplate block."""
    places, _, _, found = boilerplate(df, least, share)
    return places.join(found.select("site", "line"), ["site", "line"], "left_semi").select("row_id", "line_no")


def removed(df: DataFrame, least: int = 5, share: float = 0.05) -> DataFrame:
    """``row_id, title, text, removed``: every document without its boilerplate blocks, the blank lines within a block included.

    Each line goes with its own line end, the last one with the end before it; all else stays as it is. A title that is boilerplate
    becomes null; a text of boilerplate alone becomes empty; null texts stay null."""
    places, pairs, links, found = boilerplate(df, least, share)
    own = places.join(found.select("site", "line"), ["site", "line"], "left_semi").select("row_id", "line_no")
    within = pairs.join(links, ["site", "line", "next_line"], "left_semi").where("next_no > line_no + 1")
    blank = within.select("row_id", F.explode(F.sequence(F.col("line_no") + 1, F.col("next_no") - 1)).alias("line_no"))
    gone = own.unionByName(blank).groupBy("row_id").agg(F.collect_set("line_no").alias("gone"))  # lines of one document
    out = df.select("row_id", "title", "text").join(gone, "row_id", "left")
    gone_or_none = F.coalesce("gone", F.array().cast("array<int>"))
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(gone_or_none, i + 1)), "\n")
    return out.select(
        "row_id",
        F.when(~F.array_contains(gone_or_none, 0), F.col("title")).alias("title"),
        F.when(F.array_contains(gone_or_none, F.size(parts)), F.regexp_replace(kept, "\r$", "")).otherwise(kept).alias("text"),
        F.size(gone_or_none).alias("removed"),
    )
