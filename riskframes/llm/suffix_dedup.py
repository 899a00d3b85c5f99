"""Removal of long repeated byte strings across documents, by suffix arrays of shards.

A byte goes if a string of ``LENGTH`` bytes that covers it (a window) also starts in a document with a smaller id. The steps:

1. Documents are dealt to shards by a hash of their id. Of equal texts only the one with the smallest id goes on; all
   of another copy is covered, so it is removed without a search.
2. Each window is named by the smallest hash of the ``GRAM``-byte strings within it: equal windows have equal names, and neighbours mostly
   share theirs. A shard sends its distinct names, four bytes each, to buckets, which find by binary search in their sorted
   lists how many shards hold each and answer with two bits: whether another does, and whether more than ``HOT`` do.
3. Each shard builds the suffix array of its whole text, by Larsson and Sadakane's refinement in numpy: ranks of 8 bytes first, then of 16, 32
   and 50 by the rank at an offset, only for suffixes that still tie. Kasai's common prefixes of neighbours tell equal windows. A window
   that a smaller document of the shard has is removed; of the others, those with names that another shard holds go to merges.
4. A merge has all windows of its names. Runs of windows that are equal as a whole are settled by their hash and a comparison of their bytes; the
   others are sorted by a suffix array for each block of shards, and the sorted lists are merged by binary search, two by two. Windows of
   names that more than ``HOT`` shards hold are merged for ``HOT`` shards at a time first, and only one of each distinct window goes on, so no name is
   a task of its own size.
5. Each shard cuts the covered bytes out of its documents.

What is exchanged: the texts once (the same exchange feeds the steps), names, and the windows that repeat. Nothing is collected but the total
number of bytes. Buckets and merges grow with the total, by ``bucket_bytes`` and ``merge_bytes`` of text each, not with the shards.

Inputs: null and empty texts have 0 bytes. Documents with a null id neither lose bytes nor cover others. Rows with equal ids never
cover each other. Very long texts are searched whole, by one worker with some 50 times their size. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import U64, cut, fresh, mix, row_chunks, span_hashes, stream, text_buffers, tidied

LENGTH, GRAM = 50, 20
SHARD_BYTES, BUCKET_BYTES, MERGE_BYTES = 2 << 20, 64 << 20, 12 << 20
HOT = 64
BLOCK = 256 << 10
CHUNK = 1 << 19
_M = stream(21, 8) | U64(1)
_BYTES = stream(22, 256)


def named_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of neighbouring windows of one name within a text: start in ``data``, number of windows, name."""
    starts, counts, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for i, j in row_chunks(np.diff(offsets), CHUNK):
        lo, hi = int(offsets[i]), int(offsets[j])
        n = hi - lo
        if n < LENGTH:
            continue
        block = np.concatenate([data[lo:hi], np.zeros(8, np.uint8)])
        eight = np.ndarray((n,), "<u8", block, 0, (1,))
        m = n - GRAM + 1
        h = eight[:m] * _M[0]
        h += eight[8 : m + 8] * _M[1]
        h += eight[GRAM - 8 : m + GRAM - 8] * _M[2]
        h ^= h >> U64(31)
        h *= _M[3]
        h ^= h >> U64(29)
        width, need = 1, LENGTH - GRAM + 1
        while width < need:
            step = min(width, need - width)
            h = np.minimum(h[: len(h) - step], h[step:])
            width += step
        edges = offsets[i : j + 1] - lo
        valid = np.zeros(n + 1, np.int8)  # windows that lie within one text
        long = np.flatnonzero(np.diff(edges) >= LENGTH)
        np.add.at(valid, edges[long], 1)
        np.add.at(valid, edges[long + 1] - LENGTH + 1, -1)
        inside = np.cumsum(valid[: len(h)]).astype(bool)
        change = np.ones(len(h), bool)
        change[1:] = (h[1:] != h[:-1]) | (inside[1:] != inside[:-1])
        change[edges[long]] = True
        at = np.flatnonzero(change)
        size = np.diff(np.append(at, len(h)))
        keep = inside[at]
        starts.append(at[keep] + lo)
        counts.append(size[keep])
        names.append(h[at[keep]])
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(names)


def sorted_suffixes(data: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """All suffix starts of ``data`` in order of their first ``depth`` bytes (as if zero bytes followed the end).

    Beside it, the slots whose suffix agrees with that of the slot before in the bytes that were known before the last turn, and how many these are.
    """
    n = len(data)
    block = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    first = np.ndarray((n,), ">u8", block, 0, (1,)).astype(U64)
    order = np.argsort(first).astype(np.int32)
    key = first[order]
    del first
    head = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=head[1:])
    del key
    slot = np.arange(n, dtype=np.int32)
    rank = np.zeros(n + depth + 16, np.int32)  # past the end: 0, and ranks of suffixes count from 1
    rank[order] = np.maximum.accumulate(np.where(head, slot, 0)) + 1
    known = 8
    slots, alike = _tied(head, slot), np.flatnonzero(~head)
    while known < depth and len(slots):
        hop = min(known, depth - known)
        at = order[slots]
        key = (rank[at].astype(np.int64) << 32) | rank[at + hop]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        if known + hop == depth:
            old = np.ones(len(slots), bool)
            np.not_equal(key[1:] >> 32, key[:-1] >> 32, out=old[1:])
            return order, slots[~old], known
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        known += hop
        slots = slots[_tied(new, np.arange(len(slots), dtype=np.int32))]
    return order, slots[:0] if known > 8 else alike, known


def _tied(head: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The slots whose group has two or more members."""
    alone = head.copy()
    alone[:-1] &= head[1:]
    return slots[~alone]


def common_prefixes(data: np.ndarray, order: np.ndarray, alike: np.ndarray, known: int, depth: int = LENGTH) -> np.ndarray:
    """For the slots ``alike`` of ``order``, whose suffixes share ``known`` bytes with the ones before them: how many they share, up to ``depth``.

    Kasai's way: if a suffix shares h < ``depth`` bytes with the one before it, the suffix d places on shares h - d or more with the one before
    that (suffixes that tie to ``depth`` are in no order beyond, so they carry nothing). Places at a multiple of eight are compared first, then those halfway
    between from what the place before them leaves known, and so on; eight bytes at a time for all places of a turn.
    """
    n = len(data)
    block = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    words = np.ndarray((n + depth + 8,), "<u8", block, 0, (1,))
    place, before = order[alike], order[alike - 1]
    shared = np.zeros(n, np.int16)
    kind = place & 7
    for turn, back in ((kind == 0, 0), (kind == 4, 4), ((kind & 3) == 2, 2), ((kind & 1) == 1, 1)):
        at, left = place[turn], before[turn]
        least = np.full(len(at), known, np.int32)
        if back:
            carried = shared[at - back].astype(np.int32)
            least = np.maximum(least, np.where(carried < depth, carried - back, 0))
        while len(at):
            differ = words[at + least] ^ words[left + least]
            same = differ == 0
            apart = ~same
            bits = differ[apart]
            low = bits & (~bits + U64(1))
            shared[at[apart]] = np.minimum(least[apart] + (np.log2(low.astype(np.float64)).astype(np.int32) >> 3), depth)
            at, left, least = at[same], left[same], least[same] + 8
            far = least >= depth
            if far.any():
                shared[at[far]] = depth
                at, left, least = at[~far], left[~far], least[~far]
    return shared[place]


def sorted_windows(data: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window starts of ``data`` (marked True in ``window``) in order of their bytes, and where each group of equal ones begins."""
    order, alike, known = sorted_suffixes(data)
    new = np.ones(len(order), bool)
    new[alike[common_prefixes(data, order, alike, known) >= LENGTH]] = False
    keep = window[order]
    if not keep.all():  # a group begins at the first of it that is a window
        group = np.cumsum(new, dtype=np.int32)[keep]
        order, new = order[keep], np.ones(len(group), bool)
        np.not_equal(group[1:], group[:-1], out=new[1:])
    return order, np.flatnonzero(new)


def _each(firsts: np.ndarray, n: int) -> np.ndarray:
    """How many members each group has."""
    return np.diff(np.append(firsts, n))


def merge_lists(lists: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of distinct keys with an owner each, merged two by two by binary search; equal keys keep the smallest owner.

    Lists of one generation are merged as soon as there are two, so no more than one of each is held.
    """
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    for keys, least in lists:
        held.append((0, keys, least))
        while len(held) > 1 and held[-1][0] == held[-2][0]:
            held[-2:] = [(held[-1][0] + 1, *_merged(*held[-2][1:], *held[-1][1:]))]
    while len(held) > 1:
        held[-2:] = [(0, *_merged(*held[-2][1:], *held[-1][1:]))]
    return held[0][1:]


def _merged(keys: np.ndarray, least: np.ndarray, more: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) < len(more):
        keys, least, more, other = more, other, keys, least
    place = np.searchsorted(keys, more)
    hit = place < len(keys)
    hit[hit] = keys[place[hit]] == more[hit]
    least = least.copy()
    least[place[hit]] = np.minimum(least[place[hit]], other[hit])
    return np.insert(keys, place[~hit], more[~hit]), np.insert(least, place[~hit], other[~hit])


def least_owners(text: np.ndarray, begins: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each window of runs (begin in ``text``, number, owner) the smallest owner of an equal one."""
    sizes = counts + LENGTH - 1
    blocks = list(row_chunks(sizes, BLOCK))
    where: list[tuple] = []

    def keys_of(i: int, j: int, at: np.ndarray) -> np.ndarray:
        part, _ = _gather(text, begins[i:j], sizes[i:j])
        return np.ndarray((len(part) - LENGTH + 1,), f"S{LENGTH}", part, 0, (1,))[at]

    def lists() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in blocks:
            part, at = _gather(text, begins[i:j], sizes[i:j])
            starts = _spread(at, counts[i:j])
            slot = np.full(len(part), -1, np.int32)
            slot[starts] = np.arange(len(starts), dtype=np.int32)
            order, firsts = sorted_windows(part, slot >= 0)
            which = slot[order]
            where.append((order[firsts], _each(firsts, len(order)), which))
            yield keys_of(i, j, order[firsts]), np.minimum.reduceat(np.repeat(owners[i:j], counts[i:j])[which], firsts)

    keys, least = merge_lists(lists())
    out = []
    for (i, j), (at, many, which) in zip(blocks, where, strict=True):
        each = np.empty(len(which), np.int64)
        each[which] = np.repeat(least[np.searchsorted(keys, keys_of(i, j, at))], many)
        out.append(each)
    return np.concatenate(out)


def covered(text: np.ndarray, begins: np.ndarray, counts: np.ndarray, names: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each window of runs that stand in ``text``, whether a smaller owner has an equal window.

    Equal runs (most of them: copies of a passage) are settled first: the one with the smallest owner stands for
    all. Only runs whose name two different runs have are sorted and merged.
    """
    n = len(begins)
    if not n:
        return np.zeros(0, bool)
    sizes = counts + LENGTH - 1
    same = np.empty(n, U64)
    for i, j in row_chunks(sizes, CHUNK):
        part, at = _gather(text, begins[i:j], sizes[i:j])
        same[i:j] = span_hashes(_BYTES[part], at, at + sizes[i:j])
    order = np.lexsort((owners, same, names))
    new = np.ones(n, bool)
    a, b = order[1:], order[:-1]
    new[1:] = (names[a] != names[b]) | (same[a] != same[b]) | (counts[a] != counts[b])
    rep = np.empty(n, np.int64)
    rep[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    copy = np.flatnonzero(rep != np.arange(n))
    for i, j in row_chunks(sizes[copy], CHUNK):  # the hash says equal; the bytes decide
        these = copy[i:j]
        (mine, at), (other, _) = (_gather(text, begins[x], sizes[these]) for x in (these, rep[these]))
        wrong = these[np.logical_or.reduceat(mine != other, at)]
        rep[wrong] = wrong
    chief = rep == np.arange(n)
    chiefs = np.flatnonzero(chief)
    held, number = np.unique(names[chiefs], return_counts=True)
    open_ = chiefs[np.isin(names[chiefs], held[number > 1])]
    windows = np.cumsum(counts) - counts
    gone = np.zeros(int(counts.sum()), bool)
    if len(open_):
        owner = np.repeat(owners[open_], counts[open_])
        gone[_spread(windows[open_], counts[open_])] = least_owners(text, begins[open_], counts[open_], owners[open_]) < owner
    copy = np.flatnonzero(~chief)
    for i, j in row_chunks(counts[copy], CHUNK):
        these = copy[i:j]
        to = _spread(windows[these], counts[these])
        later = np.repeat(owners[these] > owners[rep[these]], counts[these])
        gone[to] = later | gone[_spread(windows[rep[these]], counts[these])]
    return gone


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[start : start + size] of all, joined, and where each begins."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(starts - begins, sizes) + np.arange(total)], begins


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of all runs."""
    begins = np.cumsum(counts) - counts
    return np.repeat(starts - begins, counts) + np.arange(int(counts.sum()))


def _as_runs(values: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending values as runs of neighbours that agree in ``same``: index of the first, and number."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], np.diff(values) != 1])
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(values)))


class _Shard:
    """The documents of a shard that are searched, in order of their ids, and their named runs."""

    def __init__(self, docs: pa.Table, chosen: pa.Table) -> None:
        ids = docs.column("id").combine_chunks()
        reps = np.unique(chosen.column("rep").to_numpy())
        all_ids = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        keep = np.isin(all_ids, reps) & ~np.asarray(ids.is_null())
        keep = np.flatnonzero(keep)
        keep = keep[np.argsort(all_ids[keep], kind="stable")]
        text = docs.column("text").combine_chunks().take(pa.array(keep))
        self.ids = all_ids[keep]
        self.data, self.offsets = text_buffers(text)
        self.start, self.count, self.name = named_runs(self.data, self.offsets)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.names = np.unique(self.name)

    def removed(self) -> np.ndarray:
        """For each place, whether its window also starts in a document of the shard with a smaller id."""
        gone = np.zeros(len(self.data), bool)
        inside = np.zeros(len(self.data) + 1, np.int8)
        long = np.flatnonzero(np.diff(self.offsets) >= LENGTH)
        np.add.at(inside, self.offsets[long], 1)
        np.add.at(inside, self.offsets[long + 1] - LENGTH + 1, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        if not len(long):
            return gone
        order, firsts = sorted_windows(self.data, inside)
        rank = np.unique(self.ids, return_inverse=True)[1].astype(np.int32)  # rows with equal ids are one owner
        owner = np.repeat(rank, np.diff(self.offsets))[order]
        gone[order] = np.repeat(np.minimum.reduceat(owner, firsts), _each(firsts, len(order))) < owner
        return gone


def _deal(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> U64(32)) % U64(buckets)).astype(np.int64)


def _lists(names: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket with names, its sorted distinct lower halves."""
    for bucket, part in by_bucket(_deal(names, buckets)).items():
        yield bucket, np.unique((names[part] & U64(0xFFFFFFFF)).astype(np.uint32))


def _send_names(buckets: int):
    def run(docs: pa.Table, chosen: pa.Table) -> pa.Table:
        shard = _Shard(docs, chosen)
        rows = list(_lists(shard.names, buckets))
        number = docs.column("shard")[0].as_py() if len(docs) else 0
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "shard": pa.array([number] * len(rows), pa.int64()), "names": pa.array([x.tobytes() for _, x in rows], pa.binary())})

    return run


def _answer_names(most: int):
    def run(rows: pa.Table) -> pa.Table:
        """As bits, which names of each list another shard holds, and which more than ``most`` hold."""
        lists = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("names")]
        merged = np.sort(np.concatenate(lists))  # each list is distinct, so a name is there once for each shard
        bits, hot = [], []
        for x in lists:
            held = np.searchsorted(merged, x, "right") - np.searchsorted(merged, x)
            bits.append(np.packbits(held > 1).tobytes())
            hot.append(np.packbits(held > most).tobytes())
        return pa.table({"shard": rows.column("shard"), "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary()), "hot": pa.array(hot, pa.binary())})

    return run


def _search(buckets: int, merges: int, most: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        number = docs.column("shard")[0].as_py() if len(docs) else 0
        shard = _Shard(docs, told.filter(pc.is_valid(told.column("rep"))))
        answers = told.filter(pc.is_valid(told.column("bucket")))
        unpack = lambda x: np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))
        bits = {b.as_py(): (unpack(x), unpack(y)) for b, x, y in zip(*(answers.column(c) for c in ("bucket", "bits", "hot")), strict=True)}
        elsewhere, hot = np.zeros(len(shard.names), bool), np.zeros(len(shard.names), bool)
        to, low = _deal(shard.names, buckets), (shard.names & U64(0xFFFFFFFF)).astype(np.uint32)
        for bucket, mine in by_bucket(to).items():
            place = np.searchsorted(np.unique(low[mine]), low[mine])
            elsewhere[mine], hot[mine] = (x[place].astype(bool) for x in bits[bucket])
        gone = shard.removed()
        window = np.flatnonzero(gone)
        doc = np.searchsorted(shard.offsets, window, "right") - 1
        kinds: list[tuple] = [_removed(number, shard.ids, doc, window - shard.offsets[doc])]
        which = np.searchsorted(shard.names, shard.name)
        out_there = elsewhere[which]
        start, count, name, is_hot = shard.start[out_there], shard.count[out_there], shard.name[out_there], hot[which[out_there]]
        window = _spread(start, count)
        send = ~gone[window]
        name, is_hot = np.repeat(name, count)[send], np.repeat(is_hot, count)[send]
        window = window[send]
        doc = np.searchsorted(shard.offsets, window, "right") - 1
        for some, salt in ((~is_hot, 0), (is_hot, 1 + number // most)):
            kinds += _to_merge(number, merges, salt, shard.data, shard.ids, window[some], doc[some], (window - shard.offsets[doc])[some], name[some])
        return _table([k for k in kinds if k is not None])

    return run


def by_bucket(to: np.ndarray) -> dict[int, np.ndarray]:
    if not len(to):
        return {}
    order = np.argsort(to, kind="stable")
    values, first = np.unique(to[order], return_index=True)
    return dict(zip(values.tolist(), np.split(order, first[1:]), strict=True))


_COLUMNS = "merge bigint, hot boolean, shard bigint, ids binary, starts binary, counts binary, names binary, bytes binary"


def _row(merge: int, hot: bool, shard: int, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, names: bytes = b"", data: bytes = b"") -> tuple:
    return merge, hot, shard, ids.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), names, data


def _table(rows: list[tuple]) -> pa.Table:
    names = ["merge", "hot", "shard", "ids", "starts", "counts", "names", "bytes"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), *[pa.binary()] * 5]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})


def _removed(shard: int, ids: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple | None:
    """A row that tells a shard which runs of windows go; it passes by the merges (a negative number)."""
    if not len(at):
        return None
    first, many = _as_runs(at, doc)
    return _row(-1 - shard, False, shard, ids[doc[first]], at[first], many)


def _to_merge(number: int, merges: int, salt: int, text: np.ndarray, ids: np.ndarray, window: np.ndarray, doc: np.ndarray, at: np.ndarray, name: np.ndarray) -> list[tuple]:
    """Rows for merges: windows at places of ``text``, which are at ``at`` in their document. A salt other than 0 is of a merge before the last."""
    if not len(window):
        return []
    first, many = _as_runs(window, doc, name, at - window)
    merge = (mix(name[first] + U64(salt)) % U64(merges)).astype(np.int64)
    rows = []
    for m, part in by_bucket(merge).items():
        f = first[part]
        sent, _ = _gather(text, window[f], many[part] + LENGTH - 1)
        rows.append(_row(m, salt > 0, number, ids[doc[f]], at[f], many[part], name[f].tobytes(), sent.tobytes()))
    return rows


def _merge_as(merges: int):
    def run(rows: pa.Table) -> pa.Table:
        return _merge(rows, merges)

    return run


def _merge(rows: pa.Table, merges: int) -> pa.Table:
    """Which of the windows that shards sent a smaller document has; what is left of hot ones goes on to the last merge, rows for shards pass."""
    if rows.column("merge")[0].as_py() < 0:
        return rows
    rows = rows.sort_by("shard")
    column = lambda name: [np.frombuffer(x.as_buffer(), np.int64) for x in rows.column(name)]
    ids, starts, counts = column("ids"), column("starts"), column("counts")
    text = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("bytes")])
    all_counts = np.concatenate(counts)
    sizes = all_counts + LENGTH - 1
    begins = np.cumsum(sizes) - sizes
    names = np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in rows.column("names")])
    gone = covered(text, begins, all_counts, names, np.concatenate(ids))
    out, lo, first = [], 0, 0
    for shard, hot, c, s, i in zip(rows.column("shard").to_pylist(), rows.column("hot").to_pylist(), counts, starts, ids, strict=True):
        g, runs = gone[lo : lo + int(c.sum())], slice(first, first + len(c))
        lo, first = lo + len(g), runs.stop
        at, doc = _spread(s, c), np.repeat(np.arange(len(c)), c)
        if g.any():
            out.append(_removed(shard, i, doc[g], at[g]))
        if hot and not g.all():
            window, name = _spread(begins[runs], c), np.repeat(names[runs], c)
            out += _to_merge(shard, merges, 0, text, i, window[~g], doc[~g], at[~g], name[~g])
    return _table(out)


def _cut_out_as(whole_characters: bool):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        return _cut_out(docs, told, whole_characters)

    return run


def _cut_out(docs: pa.Table, told: pa.Table, whole_characters: bool) -> pa.Table:
    """The documents without their removed bytes, and if asked for without what is left of characters that were cut."""
    reps = np.unique(told.filter(pc.is_valid(told.column("rep"))).column("rep").to_numpy())
    runs = told.filter(pc.is_valid(told.column("starts")))
    column = lambda name: np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(x.as_buffer(), np.int64) for x in runs.column(name)])
    ids, starts, counts = column("ids"), column("starts"), column("counts")
    by = np.argsort(ids, kind="stable")
    ids, starts, counts = ids[by], starts[by], counts[by]
    own = docs.column("id").combine_chunks()
    data, offsets = text_buffers(docs.column("text").combine_chunks())
    rows: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "span_starts", "span_ends")}
    for k, doc in enumerate(own.to_pylist()):
        text = data[offsets[k] : offsets[k + 1]]
        begin = end = np.zeros(0, np.int64)
        if doc is not None and len(text) >= LENGTH:
            at = np.searchsorted(reps, doc)
            if at == len(reps) or reps[at] != doc:  # a copy of a text with a smaller id
                begin, end = np.zeros(1, np.int64), np.full(1, len(text))
            else:
                a, b = np.searchsorted(ids, doc), np.searchsorted(ids, doc, "right")
                if b > a:
                    s = np.sort(starts[a:b])
                    e = (starts[a:b] + counts[a:b] + LENGTH - 1)[np.argsort(starts[a:b], kind="stable")]
                    e = np.maximum.accumulate(e)
                    new = np.concatenate([[True], s[1:] > e[:-1]])
                    begin, end = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
        edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
        kept = b"".join([text[edges[i] : edges[i + 1]].tobytes() for i in range(0, len(edges), 2)])
        if whole_characters and len(begin):
            kept = kept.decode(errors="ignore").encode()
        for name, value in zip(rows, (len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept, begin.tolist(), end.tolist()), strict=True):
            rows[name].append(value)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table({"id": own.cast(pa.int64())} | {n: pa.array(v, t) for (n, v), t in zip(rows.items(), kinds, strict=True)} | {"row": docs.column("row")})


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    whole_characters: bool = False,
    shard_bytes: int = SHARD_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    merge_bytes: int = MERGE_BYTES,
    hot: int = HOT,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept, span_starts, span_ends, row) of every row.

    ``kept``: the remaining bytes; ``row``: a struct of the columns named in ``keep``, null without any.
    """
    more = F.struct(*keep) if keep else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), more.alias("row"))
    size = F.octet_length("text")
    narrow = cut(rows.select("id", F.when(size >= LENGTH, F.md5(F.col("text").cast("binary"))).alias("digest"), size.cast("bigint").alias("size")))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    shards, buckets, merges = max(1, -(-total // shard_bytes)), max(16, total // bucket_bytes), max(16, total // merge_bytes)
    place = F.pmod(F.xxhash64("id"), F.lit(shards))
    dealt = rows.withColumn("shard", place).groupBy("shard")
    reps = narrow.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    reps = cut(reps.select(F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("shard"), "rep"))
    sent = dealt.cogroup(reps.groupBy("shard")).applyInArrow(tidied(_send_names(buckets)), "bucket bigint, shard bigint, names binary")
    answers = sent.groupBy("bucket").applyInArrow(tidied(_answer_names(hot)), "shard bigint, bucket bigint, bits binary, hot binary")
    told = reps.select("shard", "rep").unionByName(answers, allowMissingColumns=True).select("shard", "rep", "bucket", "bits", "hot")
    found = dealt.cogroup(told.groupBy("shard")).applyInArrow(tidied(_search(buckets, merges, hot)), _COLUMNS)
    for _ in range(2):  # hot names in two steps; all else passes the second
        found = found.groupBy("merge").applyInArrow(tidied(_merge_as(merges)), _COLUMNS)
    runs = found.select("shard", "ids", "starts", "counts")
    last = reps.select("shard", "rep").unionByName(runs, allowMissingColumns=True)
    schema = T.StructType.fromDDL("id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, span_starts array<bigint>, span_ends array<bigint>")
    schema = T.StructType([*schema.fields, rows.schema["row"]])
    return dealt.cogroup(last.groupBy("shard")).applyInArrow(tidied(_cut_out_as(whole_characters)), schema)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with the remaining text, and its code points in ``size``; bytes of a character that was cut go. Null texts stay null."""
    null = fresh(docs, "_null")
    mark = docs.withColumn(null, F.col(text).isNull())
    rows = remove_repeats(mark, key, text, tuple(c for c in mark.columns if c != text), whole_characters=True)
    left = F.when(~F.col("row")[null], F.col("kept").cast("string"))
    rows = rows.select("row.*", left.alias(text)).drop(null)
    if size in docs.columns:
        rows = rows.withColumn(size, F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col(size)).cast(docs.schema[size].dataType))
    return rows.select(*docs.columns)
