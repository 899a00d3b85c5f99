"""Near-duplicate documents by one-permutation MinHash with optimal densification, and exact checks.

Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a document's set is its distinct runs of ``width`` words (the whole sequence as one
with fewer words; nothing without words). One hash of each run gives all of the signature: its upper bits choose a
bin, the smallest in a bin is kept. An empty bin takes the value of the first full bin on a probe sequence of
its own, the same for every document, so that bins still agree with the likeness of the sets.

Bands of the signature name buckets. Documents with equal sets are one class from the start, so thousands of copies are
one member of a bucket. Each bucket gives star edges: its centre (the smallest id) to each member, so the number of
candidates grows with members, not their square. Candidates are checked on their full sets.

Stars may leave members of one bucket in different components. These are compared as well, without a loss: sets that reach the threshold
share one of their rarest shingles (a fifth of each set and one more, in any one order of all shingles), so members meet where they share one of
these and their components differ, not in the bucket: what a boilerplate passage has put together is kept apart. The order is by counts in ``SLOTS`` counters, a
table of fixed size; a poor order costs time and loses nothing. Pairs that meet are compared within the join by sizes and by sketches (``BITS`` bits, each the
parity of the hashes that fall on it): at least as many hashes differ as bits, so sketches that differ in more than the sets may rule a pair out for
certain. What remains comes out and is checked on full sets. A pair is missed only if it shares no bucket.

Inputs: null and empty texts and texts without words have no set and link with nothing. A null id links with nothing
and has a null component; it is kept. Rows that share an id are one document, its sets all lead to that id. Equal ids,
repeated rows: a row each. Very long texts are read whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import U64, cut, discard, fresh, frugal, list_array, mix, release, row_chunks, slices, span_hashes, stream, text_buffers, written
from .components import components

BINS, BANDS, BAND_ROWS = 128, 32, 4
BITS = 1024
#: Counters of shingles by which rare ones are told.
SLOTS = 1 << 17
CHUNK = 1 << 20
#: Ids that may be sent to all executors to pick their texts; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 200_000

_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES = stream(11, 256)[_LOWER]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_ORDER = stream(12, 64) | U64(1)


def _runs_of_words(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of each run of ``width`` words; owners ascend."""
    n, rows = len(data), len(offsets) - 1
    word = _IS_WORD[data]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[offsets[full]] = False
    after[offsets[full + 1] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    words = span_hashes(_BYTES[data], starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1
    many = np.bincount(owner, minlength=rows)
    hashes, owners = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    first = np.concatenate([[0], np.cumsum(many)])
    if len(words) >= width:
        m = len(words) - width + 1
        total = np.zeros(m, U64)
        for k in range(width):
            total += words[k : k + m] * _ORDER[k]
        same = owner[:m] == owner[width - 1 :]
        hashes.append(mix(total[same]))
        owners.append(owner[:m][same])
    for k in range(1, width):  # shorter documents: all their words
        short = np.flatnonzero(many == k)
        total = np.full(len(short), k, U64) * _ORDER[-1]
        for i in range(k):
            total += words[first[short] + i] * _ORDER[i]
        hashes.append(mix(total))
        owners.append(short)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    by = np.argsort(o, kind="stable")
    return h[by], o[by]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text one after another, and how many each has."""
    flat, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, j in row_chunks(np.diff(offsets), CHUNK):
        h, o = _runs_of_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        ends = np.cumsum(np.bincount(o, minlength=j - i))
        sets = [np.unique(h[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        flat += sets
        counts.append(np.fromiter(map(len, sets), np.int64, len(sets)))
    return np.concatenate(flat), np.concatenate(counts)


def _bins(flat: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` values for each non-empty set: the smallest hash in a bin, or that of the first full bin on the bin's probe sequence."""
    owner = np.repeat(np.arange(len(counts)), counts)
    slot = owner * bins + (flat >> U64(65 - bins.bit_length())).astype(np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    values = np.zeros(len(counts) * bins, U64)
    full = np.zeros(len(counts) * bins, bool)
    values[slot[firsts]], full[slot[firsts]] = flat[firsts], True
    values, full = values.reshape(-1, bins), full.reshape(-1, bins)
    todo = np.flatnonzero(~full.all(1) & full.any(1))
    open_ = ~full[todo]
    step = 0
    while len(todo) and step < 64 * bins:
        probe = (mix(np.arange(bins, dtype=U64) + U64(bins * (step + 1) + 13)) % U64(bins)).astype(np.int64)
        hit = open_ & full[todo][:, probe]
        r, c = np.nonzero(hit)
        values[todo[r], c] = values[todo[r], probe[c]]
        open_ &= ~hit
        more = open_.any(1)
        todo, open_ = todo[more], open_[more]
        step += 1
    for r, row in zip(todo, open_, strict=True):  # hardly ever: the next full bin
        at = np.flatnonzero(full[r])
        for c in np.flatnonzero(row):
            values[r, c] = values[r, at[np.searchsorted(at, c) % len(at)]]
    return values


def signatures(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return _bins(flat, counts, BINS)


def bit_sketches(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BITS // 64 numbers for each set: bit i is odd if an odd number of the set's hashes fall on it.

    Each hash that only one of two sets holds turns one bit, so no more bits differ than hashes do.
    """
    parts = [np.zeros((0, BITS // 64), U64)]
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i in range(0, len(counts), 128):
        j = min(i + 128, len(counts))
        slot = np.repeat(np.arange(j - i), counts[i:j]) * BITS + (mix(flat[ends[i] : ends[j]] + U64(3)) % U64(BITS)).astype(np.int64)
        bits = (np.bincount(slot, minlength=(j - i) * BITS) & 1).astype(np.uint8).reshape(-1, BITS)
        parts.append(np.packbits(bits, axis=1).view("<u8"))
    return np.concatenate(parts)


def band_keys(values: np.ndarray) -> np.ndarray:
    """BANDS bucket names a row, each from BAND_ROWS values."""
    parts = values.reshape(-1, BANDS, BAND_ROWS)
    total = np.broadcast_to(stream(14, BANDS), parts.shape[:2]).copy()
    for k in range(BAND_ROWS):
        total += parts[:, :, k] * _ORDER[k]
    return mix(total)


def sketch(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n, set_a, set_b, bands): size of the set, 128 bits that name it, and its bucket names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, counts = shingle_sets(*text_buffers(batch.column(1)), width)
            a, b = np.zeros(len(counts), U64), np.zeros(len(counts), U64)
            some = np.flatnonzero(counts)
            bands = np.zeros(0, np.int64)
            if len(some):
                at = (np.cumsum(counts) - counts)[some]
                a[some], b[some] = np.add.reduceat(mix(flat + U64(1)), at), np.add.reduceat(mix(flat ^ U64(0xA5A5A5A5)), at)
                parts = [band_keys(signatures(flat[at[i] : at[j - 1] + counts[some[j - 1]]], counts[some[i:j]])) for i, j in row_chunks(counts[some], 1 << 18)]
                bands = np.concatenate(parts).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), list_array(bands, np.where(counts > 0, BANDS, 0), pa.int64())],
                ["id", "n", "set_a", "set_b", "bands"],
            )

    return docs.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(frugal(run), "id bigint, n bigint, set_a bigint, set_b bigint, bands array<bigint>")


def full_sets(docs: DataFrame, key: str, text: str, width: int, ids: DataFrame) -> DataFrame:
    """(rep, set): the sets, as sorted 64-bit numbers, of the documents named in ``ids`` (rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, counts = shingle_sets(*text_buffers(batch.column(1)), width)
            ends = 8 * np.concatenate([[0], np.cumsum(counts)])
            sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["rep", "set"])

    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text)).join(wanted, "rep", "left_semi")
    return rows.mapInArrow(frugal(run), "rep bigint, set binary")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 200):
        each = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = len(y) - 1
            each.append(int(np.count_nonzero(y[at] == x)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(each, pa.int64())], ["a", "b", "both"])


_WORDS = [f"w{k}" for k in range(BITS // 64)]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 200):
        sets = [np.frombuffer(x.as_buffer(), U64) for x in batch.column(1)]
        out = bit_sketches(np.concatenate(sets), np.array([len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(out[:, k]).view(np.int64)) for k in range(len(_WORDS)))], ["rep", *_WORDS])


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """Rows of groups that hold more than one component."""
    mixed = rows.groupBy(key).agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select(key)
    return rows.join(mixed, key, "left_semi")


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(65 - SLOTS.bit_length())).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, c): one row for each counter that the task has met."""
    total = np.zeros(SLOTS, np.int64)
    for batch in slices(batches, 200):
        total += np.bincount(_slot(np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), U64)), minlength=SLOTS)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["slot", "c"])


def rarest(set_: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest hashes of a set: sets that reach the threshold have ceil(percent * n / 100) hashes in common or more, so these share one."""
    n = len(set_)
    return set_[np.lexsort((set_, counts[_slot(set_)]))[: n - -(-percent * n // 100) + 1]]


def _rarest(counts: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            each = [rarest(np.frombuffer(x.as_buffer(), U64), counts, percent) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(np.concatenate(each).view(np.int64), np.array(list(map(len, each))), pa.int64())], ["rep", "rare"])

    return run


def _beside(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of ``rest`` (rep, n, part) that share a rare hash, are of different components and whose sizes and sketches allow a link."""
    own = sets.join(rest.select("rep"), "rep", "left_semi")
    slots = own.mapInArrow(frugal(_slot_counts), "slot bigint, c bigint").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()  # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int32)
    counts[slots.column("slot").to_numpy()] = np.minimum(slots.column("c").to_numpy(), 2**31 - 1)
    rare = own.mapInArrow(frugal(_rarest(counts, percent)), "rep bigint, rare array<bigint>")
    rows = cut(rest.join(rare, "rep").select("rep", "n", "part", F.explode("rare").alias("h")))
    sketches = own.mapInArrow(frugal(_sketched), "rep bigint, " + ", ".join(f"{w} bigint" for w in _WORDS))
    rows = _mixed(rows, "h").join(sketches, "rep")
    side = lambda x: rows.select("h", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("part").alias(f"p{x}"), *(F.col(w).alias(f"{x}{w}") for w in _WORDS))
    differ = F.bit_count(F.col("aw0").bitwiseXOR(F.col("bw0")))
    for w in _WORDS[1:]:
        differ = differ + F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}")))
    near = (100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))  # holds for every pair that reaches the threshold
    return side("a").join(side("b"), "h").filter((F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb")) & _long_enough(percent) & near).select("a", "b", "na", "nb").distinct()


def _long_enough(percent: int) -> Column:
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose full sets reach the threshold."""
    sa, sb = sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), sets.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    both = pairs.select("a", "b").join(sa, "a").join(sb, "b").select("a", "b", "x", "y").mapInArrow(frugal(_shared), "a bigint, b bigint, both bigint")
    return both.join(pairs, ["a", "b"]).filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Checked links (a, b) between classes. ``members``: (bucket, rep, n) of buckets with two or more classes."""
    centres = cut(members.groupBy("bucket").agg(F.min(F.struct(F.col("rep").alias("a"), F.col("n").alias("na"))).alias("c")).select("bucket", "c.*"))
    other = members.select("bucket", F.col("rep").alias("b"), F.col("n").alias("nb"))
    stars = cut(other.join(centres, "bucket").filter((F.col("a") < F.col("b")) & _long_enough(percent)).select("a", "b", "na", "nb").distinct())
    edges = cut(_checked(stars, sets, percent))
    parts = components(edges)
    release(members.sparkSession)
    rest = members.join(centres.select("bucket", F.col("a").alias("rep")), ["bucket", "rep"], "left_anti")
    rest = rest.join(parts, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("part"))
    rest = cut(_mixed(rest, "bucket").select("rep", "n", "part").distinct())
    if rest.isEmpty():
        return edges
    release(members.sparkSession)
    pairs = cut(_beside(rest, sets, percent).join(stars.select("a", "b"), ["a", "b"], "left_anti"))
    release(members.sparkSession)
    return edges.union(_checked(pairs, sets, percent))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``."""
    rows = cut(sketch(docs, key, text, width))
    named = rows.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = cut(named.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")))
    every = classes.select(F.explode("bands").alias("bucket"), "rep", "n")
    shared = every.groupBy("bucket").agg(F.min("rep").alias("p"), F.max("rep").alias("q")).filter("p != q").select("bucket")
    members = cut(every.join(shared, "bucket", "left_semi").distinct())
    sets = written(full_sets(docs, key, text, width, members.select("rep").distinct()).dropDuplicates(["rep"]), compression="none")
    release(docs.sparkSession)
    edges = cut(links(members, sets, percent))
    discard(sets)
    by_set = named.select("id", "set_a", "set_b", "n").join(classes.select("set_a", "set_b", "n", "rep"), ["set_a", "set_b", "n"])
    copies = by_set.filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    twice = rows.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id")
    several = by_set.join(twice, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")).filter("a != b")
    direct = copies.join(several, ["a", "b"], "left_anti")
    parts = components(edges.union(several))
    of_rep = direct.select(F.col("a").alias("id"), F.col("b").alias("rep")).join(parts, F.col("rep") == F.col("node"), "left")
    of_rep = of_rep.select("id", F.coalesce("component", "rep").alias("component"))
    own = parts.join(direct.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("id"), "component")
    found = of_rep.union(own).groupBy("id").agg(F.min("component").alias("component"))
    out = rows.select("id", "n").join(found, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group; rows with a null key stay."""
    name = fresh(docs, "_gone")
    gone = cut(near_duplicates(docs, key=key, text=text, **options).filter(~F.col("kept")).select(F.col(key).alias(name)).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(key) == F.col(name), "left_anti")
