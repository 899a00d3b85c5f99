"""Quality grades by ordinal regression on hashed text.

A cumulative-link model: P(grade <= k) = logistic(threshold[k] - w.x), with one weight vector for all grades and
ascending thresholds. Features are hashed into ``BUCKETS``: presence of each lowered run of letters and of
its first bytes, the share of each
word shape (such as ``A!`` or ``a,``), and bins of length and repetition. Weights are fitted by proximal
steps with an L1 penalty, so words that tell nothing have none.

The model is fitted on the driver on at most ``max_labelled`` labelled documents, chosen by a hash of their ids (a documented bound
of the sample); every document is scored. It gives the expected grade and the probability of the top grade.

Inputs: null and empty texts have length and repetition bins only; very long texts are read whole. Labels that are null are left out, of several of a key the lowest
counts; rows that share a labelled key are all fitted on. Without any labelled document the fit is an error; an empty table is graded to no rows. Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import U64, frugal, row_chunks, slices, span_hashes, stream, text_buffers

BUCKETS = 1 << 18
PREFIXES = (7,)
CHUNK = 1 << 19

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256)
_LOW[65:91] += 32
_SHAPE = np.arange(256)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48
_BYTES = stream(31, 256)


def _spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owners of runs of True within each text."""
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[full]] = False
    after[offsets[full + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


def _bins(owner: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, bucket) with their counts."""
    key, count = np.unique(owner * BUCKETS + (hashes % U64(BUCKETS)).astype(np.int64), return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (owner, bucket, value), owners ascending."""
    owners, buckets, values = [], [], []
    for i, j in row_chunks(np.diff(offsets), CHUNK):
        d, o, rows = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], j - i
        start, end, owner = _spans(_LETTER[d], o)
        words = span_hashes(_BYTES[_LOW[d]], start, end)
        a, b, _ = _bins(owner, words, rows)
        parts = [(a, b, np.ones(len(a)))]
        for size in PREFIXES:  # words that only differ at the end
            long = end - start > size
            heads = span_hashes(_BYTES[_LOW[d]], start[long], start[long] + size) + U64(size)
            a, b, _ = _bins(owner[long], heads, rows)
            parts.append((a, b, np.ones(len(a))))
        inside = ~_SPACE[d]
        start, end, owner = _spans(inside, o)
        shape = _SHAPE[d]
        first = np.ones(len(d), bool)
        first[1:] = shape[1:] != shape[:-1]
        first[start] = True
        kept = np.concatenate([[0], np.cumsum(first)])
        shapes = span_hashes(_BYTES[shape[first]] + U64(7), kept[start], kept[end])
        n = np.bincount(owner, minlength=rows)
        a, b, c = _bins(owner, shapes, rows)
        parts.append((a, b, 4.0 * c / np.maximum(n, 1)[a]))
        whole = span_hashes(_BYTES[d], start, end)
        m = max(0, len(whole) - 2)
        three = whole[:m] + whole[1 : m + 1] * U64(3) + whole[2 : m + 2] * U64(7)
        same = owner[:m] == owner[2 : m + 2]
        at = owner[:m][same]
        grams = np.bincount(at, minlength=rows)
        by = np.lexsort((three[same], at))
        g, h = at[by], three[same][by]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        distinct = np.bincount(g[new], minlength=rows)
        repeat = 10 * (grams - distinct) // np.maximum(grams, 1)
        length = np.log2(np.maximum(n, 1)).astype(np.int64)
        for kind, value in ((1, repeat), (2, length)):
            parts.append((np.arange(rows), (stream(40 + kind, 64)[value] % U64(BUCKETS)).astype(np.int64), np.ones(rows)))
        a, b, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(a, kind="stable")
        owners.append(a[by] + i)
        buckets.append(b[by])
        values.append(c[by])
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(owners), np.concatenate(buckets), np.concatenate(values)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(owner, weights=self.weights[bucket] * value, minlength=rows)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -30, 30)))


def objective(w: np.ndarray, gaps: np.ndarray, edges: np.ndarray, column: np.ndarray, value: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood and its gradients by weights and gaps.

    Row i has the features edges[i] : edges[i + 1]; the first threshold is gaps[0], each further one exp(gaps[k]) above the one before.
    """
    rows, top = len(grades), len(gaps)
    theta = _thresholds(gaps)
    sizes = np.diff(edges)
    s = np.zeros(rows)
    if len(column):
        s[sizes > 0] = np.add.reduceat(w[column] * value, edges[:-1][sizes > 0])
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    with np.errstate(over="ignore"):
        up, down = 1 / (1 + np.exp(s - edge[grades + 1])), 1 / (1 + np.exp(s - edge[grades]))
    p = np.maximum(up - down, 1e-9)
    du, dd = up * (1 - up) / p, down * (1 - down) / p
    g = np.bincount(column, weights=np.repeat((du - dd) / rows, sizes) * value, minlength=len(w))
    gt = np.zeros(top + 2)
    np.add.at(gt, grades + 1, -du / rows)
    np.add.at(gt, grades, dd / rows)
    gt = gt[1:-1]
    return float(-np.log(p).mean()), g, np.concatenate([[gt.sum()], [np.exp(gaps[k]) * gt[k:].sum() for k in range(1, top)]])


def _thresholds(gaps: np.ndarray) -> np.ndarray:
    return np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))])


def fit(edges: np.ndarray, bucket: np.ndarray, value: np.ndarray, grades: np.ndarray, top: int, steps: int = 300, rate: float = 0.3, l1: float = 3e-4) -> Model:
    """Full-batch proximal Adagrad on the mean negative log likelihood."""
    used = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int64)
    place[used] = np.arange(len(used))
    column = place[bucket]
    w = np.zeros(len(used))
    shares = np.clip(np.cumsum(np.bincount(grades, minlength=top + 1))[:-1] / len(grades), 1e-3, 1 - 1e-3)
    theta = np.log(shares / (1 - shares))
    gaps = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    sq, sq_gaps = np.full(len(used), 1e-8), np.full(top, 1e-8)
    for _ in range(steps):
        _, g, gg = objective(w, gaps, edges, column, value, grades)
        sq += g * g
        sq_gaps += gg * gg
        pace = rate / np.sqrt(sq)
        w = w - pace * g
        w = np.sign(w) * np.maximum(np.abs(w) - pace * l1, 0)
        gaps = gaps - rate * gg / np.sqrt(sq_gaps)
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Model(weights, _thresholds(gaps))


def graded(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, grade): 0 toxic, 1 of low quality, 2 neither; one row a key, the lowest grade where they differ."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rows = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return rows.groupBy(key).agg(F.min(grade).alias("grade"))


def training_rows(docs: DataFrame, grades: DataFrame, key: str, text: str, max_labelled: int) -> tuple[np.ndarray, ...]:
    """Features of the sample (edges of the rows, buckets, values) and its grades, in order of the keys; at most ``max_labelled`` rows come to the driver."""
    sample = grades.orderBy(F.xxhash64(key, F.lit(5)), key).limit(max_labelled).withColumnRenamed(key, "k")
    rows = docs.select(F.col(key).alias("k"), text).join(F.broadcast(sample), "k").select("k", "grade", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, bucket, value = features(*text_buffers(batch.column(2)))
            edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            blob = [(bucket[a:b].astype("<i4").tobytes(), value[a:b].astype("<f4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in blob], pa.binary()), pa.array([x[1] for x in blob], pa.binary())], ["k", "grade", "b", "v"])

    got = rows.mapInArrow(frugal(run), "k bigint, grade int, b binary, v binary").toArrow().combine_chunks()
    if not got.num_rows:
        raise ValueError("no labelled document to fit on")
    order = pc.sort_indices(got.column("k")).to_pylist()
    grades = got.column("grade").to_numpy().astype(np.int64)[order]
    lists = {c: got.column(c).chunk(0) for c in ("b", "v")}
    sizes = np.array([len(lists["b"][k].as_buffer()) // 4 for k in order], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    bucket, value = np.empty(edges[-1], np.int32), np.empty(edges[-1], np.float32)
    for k, lo, hi in zip(order, edges[:-1], edges[1:], strict=True):
        bucket[lo:hi] = np.frombuffer(lists["b"][k].as_buffer(), "<i4")
        value[lo:hi] = np.frombuffer(lists["v"][k].as_buffer(), "<f4")
    return edges, bucket, value, grades


def fit_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = 20_000, top: int = 2) -> Model:
    edges, bucket, value, grades = training_rows(docs, graded(labels, key), key, text, max_labelled)
    return fit(edges, bucket, value, grades, top)


def grade(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, expected_grade, top_probability, kept) of every document; kept: the top grade is at least as likely as ``least``."""
    schema = T.StructType([docs.schema[key], T.StructField("expected_grade", T.DoubleType()), T.StructField("top_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, thresholds)
        for batch in slices(batches):
            scores = []
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_chunks(np.diff(offsets), CHUNK):
                owner, bucket, value = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                scores.append(own.score(owner, bucket, value, j - i))
            tails = own.tails(np.concatenate(scores)) if scores else np.zeros((0, len(thresholds)))
            top = tails[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(top), pa.array(top >= least)], schema.fieldNames())

    return docs.select(key, text).mapInArrow(frugal(run), schema)
