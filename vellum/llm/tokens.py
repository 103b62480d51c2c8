"""Problem 6: a corpus as token ids of a public byte-level BPE vocabulary.

A piece of text is a doubly linked list of byte symbols; a priority queue holds the neighbouring pairs that a merge
rank is known for. The best pair is merged in place, its neighbours get new queue entries, and entries whose
symbols have changed since are skipped. Text is parted into pieces by the vocabulary's pattern first, and pieces
further into atoms: between two characters no merge can reach across unless some vocabulary string holds
the last byte of the one followed by the first byte of the other, so atoms are exact and repeat far more often than
pieces do. Atoms and short pieces are kept with their ids in bounded tables, one of each a Python worker.

Defined cases: empty and null texts give an empty list; blank texts are encoded as any other; the strings of special
tokens are ordinary text; ids decode by joining vocabulary strings, and every text comes back byte for byte.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.session import spread

#: Where the public vocabularies are; a parameter of every function that reads one.
FOLDER = os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that parts text into pieces for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's tables; a full table starts anew.
KEPT = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte string to id of a rank file; an id is also the order of its merge."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def reach(ranks: dict[bytes, int]) -> str:
    """A pattern for atoms: a character and those after it that a merge might reach.

    Not parting is always exact: ASCII runs and characters beyond the basic plane stay together."""
    across: dict[int, set[int]] = {}
    for token in ranks:
        for x, y in zip(token, token[1:]):
            if not 0x80 <= y < 0xC0 and not (x < 0x80 and y < 0x80):
                across.setdefault(y, set()).add(x)

    def starts(y: int) -> str:
        if y < 0x80:
            return f"\\x{y:02x}"
        if y < 0xE0:
            return f"\\u{(y & 0x1F) << 6:04x}-\\u{((y & 0x1F) << 6) + 0x3F:04x}"
        if y < 0xF0:
            return f"\\u{max(0x800, (y & 0xF) << 12):04x}-\\u{((y & 0xF) << 12) + 0xFFF:04x}"
        return "\\U00010000-\\U0010ffff"

    def ends(x: int) -> str:
        if x < 0x80:
            return f"\\x{x:02x}"
        return "".join(f"\\u{c:04x}" for c in range(0x80 | (x & 0x3F), 0x10000, 0x40) if not 0xD800 <= c < 0xE000)

    parts = ["[\\x00-\\x7f](?<=[\\x00-\\x7f][\\x00-\\x7f])", "[\\U00010000-\\U0010ffff]", ".(?<=[\\U00010000-\\U0010ffff].)"]
    for y, before in sorted(across.items(), reverse=True):
        parts.append(f"[{starts(y)}](?<=[{''.join(map(ends, sorted(before)))}].)")
    return ".(?:" + "|".join(parts) + ")*"


class Encoder:
    """Ids of texts under one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.atoms = re.compile(reach(ranks), re.DOTALL).findall
        self.short: dict[str, bytes] = {}
        self.known = _Atoms(self.merged)

    def merged(self, atom: str) -> list[int]:
        """The ids of one atom by its merges, best rank first, leftmost first among equals."""
        data = atom.encode()
        ranks, n = self.ranks, len(data)
        symbols: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, bytes, bytes]] = []

        def push(i: int, j: int) -> None:
            a, b = symbols[i], symbols[j]
            rank = ranks.get(a + b)
            if rank is not None:
                heapq.heappush(queue, (rank, i, a, b))

        for i in range(n - 1):
            push(i, i + 1)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = a + b, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                push(i, right[i])
            if left[i] >= 0:
                push(left[i], i)
        return [ranks[s] for s in symbols if s is not None]

    def ids(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        short, known, atoms, out = self.short, self.known.__getitem__, self.atoms, []
        for piece in self.pieces(text):
            found = short.get(piece)
            if found is None:
                found = b"".join(map(known, atoms(piece)))
                if len(piece) <= 16:
                    if len(short) >= KEPT:
                        short.clear()
                    short[piece] = found
            out.append(found)
        return b"".join(out)


class _Atoms(dict):
    def __init__(self, merged) -> None:
        self.merged = merged

    def __missing__(self, atom: str) -> bytes:
        found = b"".join(i.to_bytes(4, "little") for i in self.merged(atom))
        if len(self) >= KEPT:
            self.clear()
        if len(atom) <= 64:
            self[atom] = found
        return found


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(read_ranks(path))


def encoded(df: DataFrame, key: str, text: str, path: str = f"{FOLDER}/{BYTE_BPE_50K}") -> DataFrame:
    """``key, ids``: the token ids of each text. ``path`` names the rank file, on every machine."""
    kind = dict(df.dtypes)[key]
    own = df.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = _encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = [encoder.ids(t) for t in batch.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, "int32")
                np.cumsum([len(x) // 4 for x in lists], out=offsets[1:])
                values = np.frombuffer(b"".join(lists), "<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["k", "ids"])

    return spread(own, "k").mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")


def decoded(df: DataFrame, key: str, ids: str, path: str = f"{FOLDER}/{BYTE_BPE_50K}") -> DataFrame:
    """``key, text``: the texts that lists of ids stand for, by joining vocabulary strings."""
    kind = dict(df.dtypes)[key]
    own = df.select(F.col(key).alias("k"), F.col(ids).alias("i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = {i: b for b, i in read_ranks(path).items()}
        for batch in batches:
            texts = [b"".join(map(strings.__getitem__, x)).decode("utf-8", "replace") if x is not None else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "text"])

    return own.mapInArrow(run, f"k {kind}, text string").select(F.col("k").alias(key), "text")
