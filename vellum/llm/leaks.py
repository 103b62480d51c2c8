"""Problem 7: evaluation passages inside the texts of a corpus.

Containment search with MinHash, partitioned by size. The shingles of a test item are hashed; items fall into size
classes by powers of two, and a class keeps the hashes below a bound that its size sets, so that every item has a
sketch of about ``SKETCH`` to twice as many values, and all of its hashes where it has fewer. A corpus text,
however long, is asked for every one of those values at once: its whole shingle set is the other side, so an item
within it is found by containment, where a signature of the long text would drown it. Pairs that share enough of a
sketch are only candidates; they are decided by an alignment of the item's words with the text's: maximal equal runs
of words are chained over a few changed words into stretches, and the few longest stretches must cover two fifths of
the item. Stretches no longer than a phrase do not count. With ``sketch=None`` every hash is kept, and the search is exact.

The values of all sketches also set bits of a filter, sized by their number up to ``MOST_BITS``, the only thing sent to
every worker, so that corpus texts leave behind only values that some item has; those are joined with the sketches by
value and counted by (text, item), with partial sums before the exchange. Sketches too many to broadcast are spread over
``SALTS`` copies, so that a value that many texts hold is in no single task.

Defined cases: null, empty and blank texts and items match nothing, nor do rows with null ids; an item of fewer words than a shingle is
held where all of its words stand in a row; equal texts under several ids are each reported, as are equal items.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm import shingles as S
from vellum.session import spread, written

SKETCH = 128
#: Bits of the filter for each value, and how many it has at most (32 MB), in powers of two.
SPARSE, MOST_BITS = 9, 28
#: Bytes of the filter that are put together in one task.
BLOCK = 1 << 16
SALTS = 8
#: An item counts as held from this share of its words.
SHARE = 0.4
#: A pair is aligned from this share of its sketch: two fifths in three stretches with six changed words keep a tenth.
CANDIDATE = 0.06
#: Of words, and of characters that are words alone: the shortest equal run, the widest change within a stretch, and
#: how many a stretch must have in common to be more than a phrase.
RUN, CHANGED, PHRASE = (3, 4), (4, 8), (10, 12)
#: The part of a stretch that must be equal, and how many stretches are a few.
EQUAL, FEW = 0.75, 4
CHARS = 1_000_000
#: Sketch values up to this number (20 bytes each) are broadcast.
BROADCAST_VALUES = 1_000_000


USUAL = ((S.WORDS, False), (S.CHARACTERS, True))


@lru_cache(maxsize=2)
def _tables(simplify: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    return S.letters(dict(simplify))


def portions(texts: list[str | None], most: int = CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of at most ``most`` characters in sum, or one text."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def hashed(token: np.ndarray, single: np.ndarray, text: np.ndarray, widths: tuple[tuple[int, bool], ...] = USUAL) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of text) of the distinct shingles of each text, sorted by text."""
    h, _, _, t = S.shingles(token, single, text, widths)
    if not len(h):
        return h, t
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
    return h[new], t[new]


def width(single: np.ndarray) -> int:
    """The size of the shingle that begins with an item's first word."""
    return S.CHARACTERS if single[0] else S.WORDS


def sketches(items: DataFrame, key: str, text: str, simplify: tuple[tuple[int, int], ...], most: int | None = SKETCH) -> DataFrame:
    """``item_id, value, size, width``: the values of every item's sketch, how many they are, and the size of a short item that is one shingle."""
    own = items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for a, b in portions(texts):
                token, single, text = S.tokens(texts[a:b], _tables(simplify))
                h, t = hashed(token, single, text)
                n = np.bincount(t, minlength=b - a)
                if most is not None:
                    size_class = np.floor(np.log2(np.maximum(n, 1)))
                    rate = np.minimum(1.0, most / 2.0**size_class)
                    keep = (h >> np.uint64(11)).astype("float64") < rate[t] * 2.0**53
                    h, t = h[keep], t[keep]
                small = np.zeros(len(t), "int32")
                for i in np.flatnonzero(n == 0):  # the whole of a short item, if it has any word
                    x, y = np.searchsorted(text, [i, i + 1])
                    if y > x:
                        size = int(y - x) if single[x] else -int(y - x)
                        one, _, _, _ = S.shingles(token[x:y], single[x:y], text[x:y], ((abs(size), bool(single[x])),))
                        h, t, small = np.append(h, one), np.append(t, i), np.append(small, np.int32(size))
                kept = np.bincount(t, minlength=b - a)
                columns = [pa.array(ids[a:b][t]), pa.array(h.view("int64")), pa.array(kept[t].astype("int32")), pa.array(small.astype("int32"))]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "value", "size", "width"])

    return own.mapInArrow(run, "item_id long, value long, size int, width int")


def filter_of(sketch: DataFrame, count: int) -> tuple[bytes, int]:
    """The filter of all values and its size in powers of two. Blocks of it are put together by the executors."""
    power = min(MOST_BITS, max(19, int(np.ceil(np.log2(max(1, count)))) + SPARSE))
    shift = np.uint64(64 - power)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << power) // 8, "uint8")
        for batch in batches:
            at = batch.column(0).to_numpy().view("uint64") >> shift
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype("int64"), (np.uint8(128) >> (at & np.uint64(7)).astype("uint8")))
        blocks = bits.reshape(-1, BLOCK)
        full = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype("int32")), pa.array([blocks[i].tobytes() for i in full], pa.binary())], ["block", "bits"])

    def joined(table: pa.Table) -> pa.Table:
        out = np.zeros(BLOCK, "uint8")
        for x in table.column("bits").to_pylist():
            out |= np.frombuffer(x, "uint8")
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((1 << power) // 8, "uint8")
    for row in sketch.select("value").mapInArrow(parts, "block int, bits binary").groupBy("block").applyInArrow(joined, "block int, bits binary").collect():  # at most 32 MB
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.bits, "uint8")
    return out.tobytes(), power


def met(docs: DataFrame, key: str, text: str, bits, power: int, simplify: tuple[tuple[int, int], ...], widths: tuple[tuple[int, bool], ...] = USUAL) -> DataFrame:
    """``doc_id, value``: the shingle values of each text that the filter lets through."""
    own = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    shift = np.uint64(64 - power)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, "uint8")
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for a, b in portions(texts):
                h, _, _, t = S.shingles(*S.tokens(texts[a:b], _tables(simplify)), widths)
                at = h >> shift
                hit = (known[(at >> np.uint64(3)).astype("int64")] >> (np.uint64(7) - (at & np.uint64(7))).astype("uint8")) & 1 > 0
                h, t = h[hit], t[hit]
                order = np.lexsort((h, t))
                h, t = h[order], t[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][t[new]]), pa.array(h[new].view("int64"))], ["doc_id", "value"])

    return spread(own, "doc_id").mapInArrow(run, "doc_id long, value long")


def grams(token: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first token, size) of every run of ``RUN`` tokens, sorted by hash."""
    h, at, size, _ = S.shingles(token, single, np.zeros(len(token), "int64"), ((RUN[0], False), (RUN[1], True)))
    order = np.argsort(h, kind="stable")
    return h[order], at[order], size[order]


def runs(item: tuple[np.ndarray, np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """(start in the item, start in the text, length) of the maximal equal runs, by their start in the text."""
    low = np.searchsorted(doc[0], item[0], "left")
    n = np.searchsorted(doc[0], item[0], "right") - low
    if not n.sum():
        return []
    i, size = np.repeat(item[1], n), np.repeat(item[2], n)
    diagonal = doc[1][np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())] - i
    order = np.lexsort((i, diagonal))
    i, size, diagonal = i[order], size[order], diagonal[order]
    lane = (diagonal - diagonal.min()) << 32  # so that an end carries on within its diagonal only
    end = np.maximum.accumulate(lane + i + size) - lane
    new = np.ones(len(i), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (i[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    found = zip(i[first].tolist(), (i + diagonal)[first].tolist(), (end[last] - i[first]).tolist())
    return sorted(found, key=lambda r: (r[1], r[0]))


def stretches(found: list[tuple[int, int, int]], single: np.ndarray) -> list[tuple[int, int, int]]:
    """(equal tokens, start, end in the item) of the best chains of runs, each run in one; the longest come first."""
    best, back = [0] * len(found), [-1] * len(found)
    for x, (i, j, size) in enumerate(found):
        gap, y = CHANGED[int(single[i])], x - 1
        while y >= 0 and found[y][1] >= j - len(single) - gap:  # no run is longer than the item
            a, c, n = found[y]
            if a < i and c < j and i - a - n <= gap and j - c - n <= gap:
                gain = best[y] - max(0, a + n - i, c + n - j)  # what both hold counts once
                if gain > best[x] and a + n < i + size and c + n < j + size:
                    best[x], back[x] = gain, y
            y -= 1
        best[x] += size
    out, used = [], set()
    for x in sorted(range(len(found)), key=lambda x: -best[x]):
        if x in used:
            continue
        y, start = x, 0
        while y >= 0 and y not in used:
            used.add(y)
            start, y = found[y][0], back[y]
        out.append((best[x] - (best[y] if y >= 0 else 0), start, found[x][0] + found[x][2]))
    return sorted(out, key=lambda c: -c[0])


def covered(found: list[tuple[int, int, int]], single: np.ndarray) -> float:
    """The share of an item's tokens within the few longest stretches that are more than a phrase; a candidate that is one short shingle is held whole."""
    if 0 < len(single) < width(single):
        return 1.0
    held, few = np.zeros(len(single), bool), 0
    for equal, a, b in stretches(found, single):
        phrase = PHRASE[int(single[a:b].mean() > 0.5)]
        if equal >= min(phrase, EQUAL * len(single)) and equal >= EQUAL * (b - a) and not held[a:b].all():
            held[a:b] = True
            few += 1
            if few == FEW:
                break
    return float(held.mean()) if len(held) else 0.0


def verified(pairs: DataFrame, share: float, simplify: tuple[tuple[int, int], ...]) -> DataFrame:
    """``doc_id, item_id, share`` of the pairs (doc_id, text, item_id, passage) whose text holds enough of the passage."""

    def parts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        token, single, t = S.tokens(texts, _tables(simplify))
        at = np.searchsorted(t, np.arange(len(texts) + 1))
        return [(token[a:b], single[a:b]) for a, b in zip(at[:-1], at[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items = (batch.column(k).to_pylist() for k in ("text", "passage"))
            for a, b in portions(docs):
                own_docs, own_items = (list(dict.fromkeys(x[a:b])) for x in (docs, items))
                d = {t: grams(*x) for t, x in zip(own_docs, parts(own_docs))}
                i = {t: (grams(*x), x[1]) for t, x in zip(own_items, parts(own_items))}
                held = [covered(runs(i[p][0], d[t]), i[p][1]) for t, p in zip(docs[a:b], items[a:b])]
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("item_id"), pa.array(held, pa.float64())], ["doc_id", "item_id", "share"])

    return pairs.select("doc_id", "item_id", "text", "passage").mapInArrow(run, "doc_id long, item_id long, share double").where(F.col("share") >= share)


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", share: float = SHARE, most: int | None = SKETCH) -> DataFrame:
    """``doc_id, item_id, share``: every text that holds at least ``share`` of an item's words. ``most`` is the least size of a sketch, or None for all hashes."""
    spark = docs.sparkSession
    simplify = tuple(S.simplified(spark).items())
    sketch = written(sketches(items, item, text, simplify, most), "sketches")
    count = sketch.count()
    raw, power = filter_of(sketch, count)
    bits = spark.sparkContext.broadcast(raw)
    short = tuple((abs(r.width), r.width > 0) for r in sketch.where("width <> 0").select("width").distinct().orderBy("width").collect())  # at most eleven sizes
    values = met(docs, doc, text, bits, power, simplify, (*USUAL, *short))
    sketch = sketch.select("item_id", "value", "size")
    if count <= BROADCAST_VALUES:
        hits = values.join(F.broadcast(sketch), "value")
    else:
        salted = sketch.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = values.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["value", "salt"])
    shared = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    found = written(shared.where(F.col("n") >= F.lit(CANDIDATE) * F.col("size")).select("doc_id", "item_id"), "leak-pairs")
    passages = items.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("passage"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return verified(texts.join(found, "doc_id").join(passages, "item_id"), share, simplify)
