"""Problem 8: the subject areas of each document, from the share of its sentences about each.

Every document becomes its sentences, and a sentence its features (words, or pairs of neighbouring characters in
scripts without blanks), hashed into a table of fixed size, one part for each kind of script. They are computed once
and written; what follows reads them.

1. Labelled documents, a bounded sample (``LABELLED``), give complement naive Bayes weights: how much more often
   a feature stands in documents of a subject than in all others of its script. Weak or chance weights are left out.
2. Expectation-maximization over the sentences of all documents, labelled or not: each sentence belongs to a subject
   or to none, and features are counted by these posteriors, so that words used in passing, or in a figure of
   speech that any document has, lose their weight. It stops after ``ROUNDS``: the likelihood goes on rising, but classes then
   drift away from what the labels mean.
3. Each subject is scored by itself: the lesser of its evidence against its complement and against no subject. On the labelled
   sample these scores are calibrated, subject by subject, to the posterior that a sentence is about the subject; labels are of
   documents, so their rate among sentences runs from a floor (sentences of other documents) to a ceiling (labels left out or wrong), and the
   posterior is where between them a score lies. A sentence is about every subject with a posterior of at least one half, and a
   document has a subject when at least ``SHARE`` of its sentences are about it.

What goes to the workers is the weight table, at most ``1 << BITS`` rows whatever the corpus.

Defined cases: null and blank texts, texts without any sentence and null ids give no row; labels are trimmed and compared
without case, unknown ones are dropped, repeated ones count once; a subject without label is found nowhere; equal
documents get equal subjects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from vellum.llm import shingles as S
from vellum.llm.leaks import _tables, portions
from vellum.llm.sentences import units
from vellum.session import spread, written

LABELLED = 20_000  # documents of the labelled sample at most
BITS = 20
PART_BITS = BITS - 2
SHARE = 1 / 6
ROUNDS = 2  # of expectation-maximization
CLIP = 12  # scores beyond this much evidence (natural logarithms) are as good as certain
SMOOTH = 0.05
KANA = re.compile("[぀-ヿ]+")
WIDE = re.compile("[Ａ-Ｚａ-ｚ０-９]+")


def kind(text: str) -> int:
    """0 for alphabets, 1 for Japanese, 2 for other scripts."""
    if len(text.encode("ascii", "ignore")) + sum(map(len, WIDE.findall(text))) > 0.6 * len(text):
        return 0
    return 1 if sum(map(len, KANA.findall(text))) > 0.15 * len(text) else 2


def features(docs: DataFrame, key: str, text: str, simplify: tuple[tuple[int, int], ...]) -> DataFrame:
    """``doc_id, features, sizes``: hashed features, sentence after sentence, and how many each sentence has."""
    own = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(simplify)
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for a, b in portions(texts):
                sentences, owner, kinds = [], [], []
                for i in range(a, b):
                    k = kind(texts[i])
                    for x, y in units(texts[i]):
                        sentences.append(texts[i][x:y])
                        owner.append(i - a)
                        kinds.append(k)
                n = b - a
                token, single, of = S.tokens(sentences, tables) if sentences else (np.zeros(0, "uint64"), np.zeros(0, bool), np.zeros(0, "int64"))
                with np.errstate(over="ignore"):
                    after = np.append(token[1:], np.uint64(0))
                    pair = single & np.append(single[1:], False) & np.append(of[1:] == of[:-1], False) if len(token) else single
                    h = np.where(pair, token * S.C ^ after * S.B, token * np.uint64(7919))
                    h = (h ^ (h >> np.uint64(29))) * S.B
                keep = pair | ~single
                of = of[keep]
                bucket = (np.array(kinds, "int64")[of] << PART_BITS) | (h[keep] >> np.uint64(64 - PART_BITS)).astype("int64") if len(of) else np.zeros(0, "int64")
                sizes = np.bincount(of, minlength=len(sentences))
                owner = np.array(owner, "int64")
                per_doc = np.bincount(owner, minlength=n)
                in_doc = np.bincount(owner, weights=sizes, minlength=n).astype("int64") if len(owner) else np.zeros(n, "int64")
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(c)]).astype("int32")), pa.array(v.astype("int32")))
                    for c, v in ((in_doc, bucket), (per_doc, sizes))
                ]
                yield pa.RecordBatch.from_arrays([ids.slice(a, n), *lists], ["doc_id", "features", "sizes"])

    return spread(own, "doc_id").mapInArrow(run, "doc_id long, features array<int>, sizes array<int>")


def unfolded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, sentence of each, document of each sentence, sentences of each document)."""
    f, s = batch.column("features"), batch.column("sizes")
    values, sizes = f.flatten().to_numpy(zero_copy_only=False), s.flatten().to_numpy(zero_copy_only=False)
    per_doc = s.value_lengths().to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(batch.num_rows), per_doc), per_doc


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def scores(weights: tuple[np.ndarray, np.ndarray], prior: np.ndarray, values: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """Sum of the weights of each sentence's features, and the prior of its kind of script."""
    place, table = weights
    out = np.zeros((n, len(table)))
    rows = place[values]
    for c, weight in enumerate(table):
        out[:, c] = np.bincount(sentence, weights=weight[rows], minlength=n)
    first = np.searchsorted(sentence, np.arange(n))
    has = np.bincount(sentence, minlength=n) > 0
    parts = np.full(n, 2)
    parts[has] = values[first[has]] >> PART_BITS
    return out + prior[parts], parts, has


def placed(model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sparse table as a place for each bucket, the last one (of zeros) for unknown ones, and its columns."""
    buckets, table = model
    place = np.full(1 << BITS, len(buckets), "int32")
    place[buckets] = np.arange(len(buckets))
    return place, np.ascontiguousarray(np.vstack([table, np.zeros((1, table.shape[1]), "float32")]).T, dtype="float32")


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def gathered(counted: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The summed table: (bucket, counts); at most 1 << BITS rows and four more."""
    table = counted.groupBy("bucket").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in range(k))).toPandas().sort_values("bucket")
    return table["bucket"].to_numpy("int64"), table[[f"n{c}" for c in range(k)]].to_numpy("float64")


def by_kind(bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The totals of each kind of script, zeros where a table is empty."""
    out = np.zeros((3, n.shape[1]))
    for b, row in zip(bucket[bucket < 0], n[bucket < 0]):
        out[-1 - b] = row
    return out


def counts_schema(k: int) -> str:
    return "bucket int, " + ", ".join(f"n{c} double" for c in range(k))


def counts_batch(acc: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    """Rows of a partition's counts; the totals of each kind of script stand at -1, -2, -3."""
    buckets = np.flatnonzero(acc.any(1))
    rows = np.vstack([acc[buckets], totals])
    names = np.concatenate([buckets, -1 - np.arange(len(totals))])
    return pa.RecordBatch.from_arrays([pa.array(names.astype("int32")), *(pa.array(rows[:, c].astype("float64")) for c in range(rows.shape[1]))], ["bucket", *(f"n{c}" for c in range(rows.shape[1]))])


def from_labels(featured: DataFrame, labels: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Complement naive Bayes of the labelled sample: (bucket, weight of each subject), weak and chance ones at 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, totals = np.zeros((1 << BITS, k + 1), "float32"), np.zeros((3, k + 1))
        for batch in sliced(batches):
            values, sentence, doc, _ = unfolded(batch)
            mask = batch.column("mask").to_numpy(zero_copy_only=False)
            named = ((mask[:, None] >> np.arange(k)) & 1).astype(bool)
            named = np.hstack([named, np.ones((len(mask), 1), bool)])
            of = doc[sentence]
            pairs = np.unique(of * (1 << BITS) + values)
            d, v = pairs >> BITS, pairs & ((1 << BITS) - 1)
            known, at = np.unique(v, return_inverse=True)
            acc[known] += np.stack([np.bincount(at[named[d, c]], minlength=len(known)) for c in range(k + 1)], 1)
            d, first = np.unique(of, return_index=True)
            np.add.at(totals, values[first] >> PART_BITS, named[d].astype(float))
        yield counts_batch(acc, totals)

    bucket, n = gathered(featured.join(F.broadcast(labels), "doc_id").select("features", "sizes", "mask").mapInArrow(run, counts_schema(k + 1)), k + 1)
    docs = by_kind(bucket, n)
    bucket, n = bucket[bucket >= 0], n[bucket >= 0]
    part = bucket >> PART_BITS
    held, total = n[:, :k], n[:, k:]
    of, all_docs = docs[part, :k], docs[part, k:]
    rest = all_docs - of
    ratio = np.log((held + 0.5) / (of + 1) / ((total - held + 0.5) / (rest + 1)))
    share = total / np.maximum(1, all_docs)
    sure = (held - of * share) / np.sqrt(np.maximum(of * share * (1 - share) * rest / np.maximum(1, all_docs), 1e-6))
    return bucket, np.where((ratio > 1.0) & (sure > 3.5), np.minimum(ratio, 4.0), 0.0).astype("float32")


def expected(featured: DataFrame, weights, k: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over all sentences: (bucket, expected counts by class, sentences of each kind of script by class).

    ``weights`` is a broadcast (model, prior). In the first round the weights are those of the labelled sample and a
    sentence without clear evidence is of no subject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, prior = weights.value
        table = placed(model)
        acc, totals = np.zeros((1 << BITS, k + 1), "float32"), np.zeros((3, k + 1))
        for batch in sliced(batches):
            values, sentence, _, _ = unfolded(batch)
            n = int(pa.compute.sum(batch.column("sizes").value_lengths()).as_py() or 0)
            if not n:
                continue
            s, parts, has = scores(table, prior, values, sentence, n)
            if first:
                post = np.zeros((n, k + 1))
                clear = s.max(1) > 2.5
                post[np.arange(n), np.where(clear, s.argmax(1), k)] = 1
            else:
                post = softmax(s)
            known, at = np.unique(values, return_inverse=True)  # sums over the features of the slice, not over the whole table
            acc[known] += np.stack([np.bincount(at, weights=post[sentence, c], minlength=len(known)) for c in range(k + 1)], 1)
            np.add.at(totals, parts[has], post[has])
        yield counts_batch(acc, totals)

    bucket, n = gathered(featured.select("features", "sizes").mapInArrow(run, counts_schema(k + 1)), k + 1)
    return bucket[bucket >= 0], n[bucket >= 0], by_kind(bucket, n)


def maximized(bucket: np.ndarray, n: np.ndarray, sentences: np.ndarray, k: int, complement: bool) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Weights and priors from expected counts: of all classes, or of each subject against its complement followed by all classes."""
    part = bucket >> PART_BITS
    size = np.maximum(1, np.bincount(part, minlength=3))[part][:, None]
    of_class = np.stack([n[part == p].sum(0) for p in range(3)])[part]
    log_p = np.log((n + SMOOTH) / (of_class + SMOOTH * size))
    prior = (sentences + 1e-6) / (sentences.sum(1, keepdims=True) + 1e-6 * (k + 1))
    if not complement:
        return (bucket, log_p.astype("float32")), np.log(prior)
    rest, of_rest = n.sum(1, keepdims=True) - n, of_class.sum(1, keepdims=True) - of_class
    weight = log_p - np.log((rest + SMOOTH) / (of_rest + SMOOTH * size))
    alone = np.clip(prior[:, :k], 1e-9, 1 - 1e-9)
    return (bucket, np.hstack([weight[:, :k], log_p]).astype("float32")), np.hstack([np.log(alone / (1 - alone)), np.log(prior)])


def evidence(s: np.ndarray, k: int) -> np.ndarray:
    """The score of each subject by itself: against its complement, and against no subject, whichever is less."""
    return np.minimum(s[:, :k], s[:, k : 2 * k] - s[:, 2 * k :])


def posterior(z: np.ndarray, slope: float, middle: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * (z - middle), -50, 50)))


def shares(featured: DataFrame, weights, calibrated, k: int, least: float) -> DataFrame:
    """``doc_id, subject_no, share, probability``: the share of a document's sentences that are about a subject, from ``least`` on, and the mean of their posteriors.

    ``calibrated`` is a broadcast (slope, middle of each subject)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, prior = weights.value
        slope, middle = calibrated.value
        table = placed(model)
        for batch in sliced(batches):
            values, sentence, doc, per_doc = unfolded(batch)
            n = len(doc)
            if not n:
                continue
            s, _, has = scores(table, prior, values, sentence, n)
            p = posterior(evidence(s, k), slope, middle) * has[:, None]
            size = np.maximum(1, per_doc)[:, None]
            share, mean = (np.stack([np.bincount(doc, weights=x[:, c], minlength=batch.num_rows) for c in range(k)], 1) / size for x in (p >= 0.5, p))
            d, c = np.nonzero((share >= least - 1e-9) & (share > 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array(c.astype("int32")), pa.array(share[d, c]), pa.array(mean[d, c])], ["doc_id", "subject_no", "share", "probability"])

    return featured.mapInArrow(run, "doc_id long, subject_no int, share double, probability double")


def label_sample(labels: DataFrame, subjects: list[str], doc: str, subject: str, most: int = LABELLED) -> DataFrame:
    """``doc_id, mask``: the known subjects of at most ``most`` labelled documents, chosen by hash."""
    number = F.create_map(*(F.lit(x) for i, s in enumerate(subjects) for x in (s.strip().lower(), i)))
    known = labels.select(F.col(doc).cast("long").alias("doc_id"), number[F.lower(F.trim(subject))].alias("no")).where("doc_id IS NOT NULL AND no IS NOT NULL").distinct()
    masks = known.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, no)")).alias("mask"))
    return masks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def score_counts(featured: DataFrame, sample: DataFrame, weights, k: int) -> np.ndarray:
    """(subject, score from -CLIP to CLIP, [sentences, those of documents labelled so]) of the labelled sample, k * (2 * CLIP + 1) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, prior = weights.value
        table = placed(model)
        out = np.zeros((k, 2 * CLIP + 1, 2), "int64")
        for batch in sliced(batches):
            values, sentence, doc, _ = unfolded(batch)
            if not len(doc):
                continue
            s, _, has = scores(table, prior, values, sentence, len(doc))
            z = np.clip(np.rint(evidence(s, k)[has]), -CLIP, CLIP).astype("int64") + CLIP
            named = (batch.column("mask").to_numpy(zero_copy_only=False)[doc[has]][:, None] >> np.arange(k)) & 1
            for c in range(k):
                out[c, :, 0] += np.bincount(z[:, c], minlength=2 * CLIP + 1)
                out[c, :, 1] += np.bincount(z[:, c], weights=named[:, c], minlength=2 * CLIP + 1).astype("int64")
        c, at = np.nonzero(out[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c.astype("int32"), at.astype("int32"), out[c, at, 0], out[c, at, 1])], ["c", "at", "n", "y"])

    counted = featured.join(F.broadcast(sample), "doc_id").select("features", "sizes", "mask").mapInArrow(run, "c int, at int, n long, y long")
    out = np.zeros((k, 2 * CLIP + 1, 2))
    for r in counted.groupBy("c", "at").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect():
        out[r["c"], r["at"]] = r["n"], r["y"]
    return out


def calibration(counts: np.ndarray) -> tuple[float, np.ndarray]:
    """(slope, middle of each subject) of the posterior, the likeliest on a grid under weak priors; (1, 0) where nothing is labelled.

    The floor and the ceiling of the labels are their rates among the scores beyond all doubt."""
    k = len(counts)
    z = np.arange(-CLIP, CLIP + 1.0)
    total = counts.sum(0)
    sure = total[-3:].sum(0)
    if not sure[0] or not total[:3, 0].sum():
        return 1.0, np.zeros(k)
    floor, ceiling = (total[:3, 1].sum() + 0.5) / (total[:3, 0].sum() + 1), (sure[1] + 0.5) / (sure[0] + 1)
    middles, slopes = np.linspace(-6, 8, 57), np.geomspace(0.1, 4, 25)

    def likelihood(c: np.ndarray, slope: float) -> np.ndarray:
        p = floor + (ceiling - floor) * posterior(z[None, :], slope, middles[:, None])
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return (c[:, 1] * np.log(p) + (c[:, 0] - c[:, 1]) * np.log(1 - p)).sum(1)

    together = np.stack([likelihood(total, a) - 0.5 * np.log(a) ** 2 - 0.5 * (middles / 3) ** 2 for a in slopes])
    i, j = np.unravel_index(together.argmax(), together.shape)
    slope, common = float(slopes[i]), float(middles[j])
    own = [middles[(likelihood(c, slope) - 0.5 * (middles - common) ** 2).argmax()] for c in counts]
    return slope, np.array(own)


def subject_shares(docs: DataFrame, subjects: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", subject: str = "subject", least: float = SHARE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, subject, share, probability)`` for every document and subject with at least ``least``, and the labelled sample."""
    spark = docs.sparkSession
    names = sorted({r[0] for r in subjects.select(subject).where(F.col(subject).isNotNull()).distinct().limit(65).collect()})
    if not 0 < len(names) <= 62:
        raise ValueError("between one and 62 subjects are needed")
    k = len(names)
    simplify = tuple(S.simplified(spark).items())
    featured = written(features(docs, doc, text, simplify), "features")
    sample = written(label_sample(labels, names, doc, subject), "labels")
    cast = spark.sparkContext.broadcast
    weights = cast((from_labels(featured, sample, k), np.zeros((3, k))))
    for turn in range(rounds):
        bucket, n, sentences = expected(featured, weights, k, turn == 0)
        weights = cast(maximized(bucket, n, sentences, k, turn == rounds - 1))
    found = shares(featured, weights, cast(calibration(score_counts(featured, sample, weights, k))), k, 0.0 if least <= 0 else least)
    name = reduce(lambda x, i: x.when(F.col("subject_no") == i, names[i]), range(1, k), F.when(F.col("subject_no") == 0, names[0]))
    return found.select("doc_id", name.alias("subject"), "share", "probability"), sample
