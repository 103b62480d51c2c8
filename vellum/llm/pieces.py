"""Problem 3: texts over a limit, cut into pieces at natural boundaries with a given overlap.

Boundaries have a class: 0 the end of a sentence unit, 1 after a pause mark or blank, 2 anywhere. From a piece's
start a class is open only where no earlier class gives an admissible cut, one that lies more than the overlap after
the start, within the limit, and leaves a letter or digit in the piece. Dynamic programming runs over all starts that
admissible cuts reach, from the end of the text to its beginning; each start keeps the cut that begins the cheapest
chain from there on. Two costs are offered:

* ``order="front"``: a piece costs (class, unused room), and chains are compared piece by piece from the front. No two
  cuts from one start cost the same, so the first piece decides between chains and the sums of the rest need not be kept;
* ``order="total"``: the sum of class penalties and squared deviations from the even size is least.

Defined cases: null texts and texts within the limit give no row; a text of blanks alone over the limit is cut at the limit;
the last piece is what remains once no more than the limit is left. A limit not above the overlap cannot advance
and raises an error. Positions are code points of the stored text, starts included in the overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm.sentences import LETTER, units
from vellum.session import spread

#: After these a piece may end where no unit ends.
PAUSE = re.compile(r"[，、；：\s]")
PENALTY = (0.0, 4.0, 25.0)


def admissible(text: str, marks: list[int], start: int, limit: int, overlap: int) -> list[int]:
    """All of ``marks`` that may close a piece from ``start``."""
    low, high = bisect_right(marks, start + overlap), bisect_right(marks, start + limit)
    if low == high:
        return []
    letter = LETTER.search(text, start, marks[high - 1])
    return marks[max(low, bisect_right(marks, letter.start())) : high] if letter else []


def reachable(text: str, limit: int, overlap: int) -> dict[int, tuple[int, list[int]]]:
    """(class, admissible cuts) of every start that a chain of them may come to; none of those where the rest is within the limit."""
    n = len(text)
    ends = [e for _, e in units(text)]
    pauses: list[int] | None = None
    found: dict[int, tuple[int, list[int]]] = {}
    todo = [0]
    while todo:
        start = todo.pop()
        if start in found:
            continue
        if n - start <= limit:
            found[start] = (0, [])
            continue
        kind, cuts = 0, admissible(text, ends, start, limit, overlap)
        if not cuts:
            if pauses is None:
                pauses = [m.end() for m in PAUSE.finditer(text)]
            kind, cuts = 1, admissible(text, pauses, start, limit, overlap)
        if not cuts:
            kind, cuts = 2, [start + limit]
        found[start] = (kind, cuts)
        todo += [end - overlap for end in cuts]
    return found


def cut(text: str, limit: int, overlap: int, order: str = "front") -> list[tuple[int, int]]:
    """The pieces of a text, as half-open spans that overlap by ``overlap``."""
    if limit <= overlap:
        raise ValueError(f"the limit {limit} must be above the overlap {overlap}")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    even = n / -(-(n - overlap) // (limit - overlap))
    starts = reachable(text, limit, overlap)
    value: dict[int, float] = {}  # of the cheapest chain from a start on
    chosen: dict[int, int] = {}
    for start in sorted(starts, reverse=True):
        kind, cuts = starts[start]
        if not cuts:
            value[start] = ((n - start - even) / limit) ** 2
        elif order == "front":
            _, chosen[start] = min(((kind, limit - (end - start)), end) for end in cuts)
        else:
            value[start], chosen[start] = min((PENALTY[kind] + ((end - start - even) / limit) ** 2 + value[end - overlap], end) for end in cuts)
    out, at = [], 0
    while at in chosen:
        out.append((at, chosen[at]))
        at = chosen[at] - overlap
    return [*out, (at, n)]


def pieces(df: DataFrame, keys: list[str], text: str, limit: str, overlap: str, order: str = "front") -> DataFrame:
    """``keys, start_pos, end_pos``: the pieces of every text longer than its ``limit``."""
    kinds = dict(df.dtypes)
    n = len(keys)
    own = df.where(F.char_length(text) > F.col(limit)).select(
        *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("t"), F.col(limit).cast("int").alias("l"), F.col(overlap).cast("int").alias("o")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, starts, ends = [], [], []
            for i, (t, size, over) in enumerate(zip(*(batch.column(n + k).to_pylist() for k in range(3)))):
                for a, e in cut(t, size, over, order):
                    which.append(i)
                    starts.append(a)
                    ends.append(e)
            take = pa.array(which, pa.int64())
            columns = [batch.column(k).take(take) for k in range(n)] + [pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*(f"k{i}" for i in range(n)), "start_pos", "end_pos"])

    schema = ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keys)) + ", start_pos int, end_pos int"
    return spread(own, *(f"k{i}" for i in range(n))).mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "start_pos", "end_pos")


def with_limits(df: DataFrame, limits: DataFrame) -> DataFrame:
    """``df`` (table_name, lang, ...) with max_chars and overlap_chars; the limit of lang ``*`` holds for any other and for null."""
    own = limits.where("lang <> '*'").select("table_name", "lang", "max_chars", "overlap_chars")
    rest = limits.where("lang = '*'").select("table_name", F.col("max_chars").alias("rest_chars"), F.col("overlap_chars").alias("rest_overlap"))
    found = df.join(own, ["table_name", "lang"], "left").join(rest, "table_name", "left")
    return found.withColumns({"max_chars": F.coalesce("max_chars", "rest_chars"), "overlap_chars": F.when(F.col("max_chars").isNotNull(), F.col("overlap_chars")).otherwise(F.col("rest_overlap"))}).drop("rest_chars", "rest_overlap")
