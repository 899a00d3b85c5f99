"""Vectorised pre-tokenisation of many texts at once, and a memo of what each distinct piece encodes to.

Both public byte-pair vocabularies split a text into pieces by the class of its characters (letter, number,
space, other) and encode each piece by itself. Here the split runs over code points in numpy, and only pieces that the
worker hasn't met are encoded. A piece of up to 16 bytes is its first and last eight bytes and its size; a hash of these finds it in
sorted arrays, and it counts as found only if all three are equal. Longer pieces are found by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from ._common import U64, mix, row_chunks

SPACE, LETTER, NUMBER, OTHER = range(4)
APOSTROPHE = 39
CHUNK = 1 << 19
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point, by the library's own expressions, so that both follow one version of Unicode."""
    global _classes
    if _classes is None:
        from tokenizers import Regex, pre_tokenizers

        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for _, (lo, hi) in pre_tokenizers.Split(Regex(name), "removed", invert=True).pre_tokenize_str(text):
                out[points[lo:hi]] = kind
        _classes = out
    return _classes


def pieces(points: np.ndarray, firsts: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts that follow each other in ``points``; ``firsts``: where texts begin.

    spaced: a piece takes one blank before it, numbers are runs and white space makes pieces of its own.
    Otherwise white space is dropped and each number character stands alone.
    """
    n = len(points)
    kind = classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[firsts] = True
    cuts = begins.copy()
    cuts[1:n] |= kind[1:] != kind[:-1]
    cuts[n] = begins[n] = True
    tick = np.flatnonzero(points == APOSTROPHE)
    tick = tick[cuts[tick] & cuts[tick + 1] & ~begins[tick + 1]]  # a single one, within a text
    if spaced:
        after = np.flatnonzero(cuts[1:n] & (kind[:-1] == SPACE)) + 1
        after = after[~begins[after]]
        cuts[after - 1] = True
        cuts[after[points[after - 1] == 32]] = False
        tick = tick[cuts[tick]]
    else:
        cuts[:n] |= kind == NUMBER
    tick = tick[kind[tick + 1] == LETTER]
    one = points[tick + 1]
    inside = (tick + 2 < n) & ~begins[np.minimum(tick + 2, n)]
    two = np.where(inside, points[np.minimum(tick + 2, n - 1)], 0)
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for at, width in ((tick[short], 2), (tick[long & ~short], 3)):
        cuts[at + 1] = False
        cuts[at + width] = True
    starts = np.flatnonzero(cuts[:n])
    ends = np.append(starts[1:], n)
    if not spaced:
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def marks(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each piece raw[begin : begin + size], zero beyond its end, and its last eight where it has more."""
    view = np.ndarray((len(raw),), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))
    head = view[begins] & _MASKS[np.minimum(sizes, 8)]
    tail = np.where(sizes > 8, view[np.maximum(begins + sizes - 8, 0)], U64(0))
    return head, tail


def mark_hash(head: np.ndarray, tail: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(head ^ mix(tail + sizes.astype(U64) * U64(0x9E3779B97F4A7C15)))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
SHORT = 16  # bytes that two marks cover


class Memo:
    """Ids by piece. Short pieces: sorted arrays by hash, a young one that takes new pieces and a main one that it joins now and then. Long ones: a dictionary.

    It starts afresh when it holds more than ``most`` pieces or ``most_bytes`` bytes of long ones.
    """

    def __init__(self, encode: Callable[[list[str]], list], most: int = 400_000, most_bytes: int = 8 << 20) -> None:
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        empty = tuple(np.zeros(0, t) for t in (U64, U64, U64, np.uint8, np.int32, np.int32))
        self.main = self.young = empty  # hash, marks, size, begin and number of ids
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool, self.used, self.long_bytes = np.zeros(1 << 16, np.int32), 0, 0

    def trim(self) -> None:
        """Start afresh if it has grown too large; places given out before no longer hold."""
        if len(self.main[0]) + len(self.young[0]) + len(self.long) > self.most or self.long_bytes > self.most_bytes:
            self.clear()

    def lookup(self, keys: np.ndarray, heads: np.ndarray, tails: np.ndarray, sizes: np.ndarray, text_of: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of short pieces with the distinct, ascending ``keys`` begin in ``pool``, and their number; ``text_of`` gives the pieces that are new."""
        at, number, odd = np.full(len(keys), -1, np.int32), np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        for known, head, tail, size, begin, count in (self.main, self.young):
            place = np.searchsorted(known, keys)
            hit = place < len(known)
            hit[hit] = known[place[hit]] == keys[hit]
            hit = np.flatnonzero(hit)
            place = place[hit]
            same = (head[place] == heads[hit]) & (tail[place] == tails[hit]) & (size[place] == sizes[hit])
            odd[hit[~same]] = True
            at[hit[same]], number[hit[same]] = begin[place[same]], count[place[same]]
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new], number[new] = self.add(text_of(new))
            new = new[~odd[new]]  # the hash of an odd one belongs to another piece
            self.young = _joined(self.young, (keys[new], heads[new], tails[new], sizes[new], at[new], number[new]))
            if len(self.young[0]) > 20_000 + len(self.main[0]) // 8:
                self.main, self.young = _joined(self.main, self.young), tuple(x[:0] for x in self.young)
        return at, number

    def lookup_long(self, texts: list[bytes]) -> list[tuple[int, int]]:
        new = [t for t in dict.fromkeys(texts) if t not in self.long]
        if new:
            at, number = self.add([t.decode() for t in new])
            self.long.update(zip(new, zip(at.tolist(), number.tolist(), strict=True), strict=True))
            self.long_bytes += sum(map(len, new))
        return [self.long[t] for t in texts]

    def add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces and put their ids into ``pool``."""
        ids = self.encode(texts)
        number = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(number.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.int32)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        at = self.used + np.cumsum(number, dtype=np.int32) - number
        self.used += total
        return at, number


def _joined(into: tuple, more: tuple) -> tuple:
    place = np.searchsorted(into[0], more[0])
    return tuple(np.insert(a, place, b) for a, b in zip(into, more, strict=True))


def encode_texts(texts: list[str], memo: Memo, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts one after another, and how many each text has."""
    flat, counts = [np.zeros(0, np.int32)], []
    for i, j in row_chunks(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK):
        part = texts[i:j]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        joined = "".join(part)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if not len(points):
            counts.append(np.zeros(len(part), np.int64))
            continue
        starts, ends = pieces(points, offsets[:-1], spaced)
        raw = np.frombuffer(joined.encode(), np.uint8)
        if len(raw) > len(points):  # places in the bytes of UTF-8
            wide = np.concatenate([[0], np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int32)])
            begins, width = wide[starts], wide[ends] - wide[starts]
        else:
            begins, width = starts, ends - starts
        memo.trim()
        at, lengths = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
        short = np.flatnonzero(width <= SHORT)
        head, tail = marks(raw, begins[short], width[short])
        size = width[short].astype(np.uint8)
        distinct, first, back = np.unique(mark_hash(head, tail, size), return_index=True, return_inverse=True)
        text_of = lambda which: [joined[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]  # noqa: B023, E731
        a, n = memo.lookup(distinct, head[first], tail[first], size[first], lambda new: text_of(short[first[new]]))  # noqa: B023
        same = first[back]
        odd = np.flatnonzero((head != head[same]) | (tail != tail[same]) | (size != size[same]))
        at[short], lengths[short] = a[back], n[back]
        if len(odd):  # equal hashes, other pieces
            at[short[odd]], lengths[short[odd]] = memo.add(text_of(short[odd]))
        if len(short) < len(starts):
            long = np.flatnonzero(width > SHORT)
            block = raw.tobytes()
            places = memo.lookup_long([block[b : b + w] for b, w in zip(begins[long].tolist(), width[long].tolist(), strict=True)])
            at[long], lengths[long] = np.array(places, np.int32).T
        stops = np.cumsum(lengths, dtype=np.int32)
        total = int(stops[-1]) if len(stops) else 0
        flat.append(memo.pool[np.repeat(at - (stops - lengths), lengths) + np.arange(total, dtype=np.int32)])
        owner = np.searchsorted(starts, offsets)
        counts.append(np.diff(np.concatenate([[0], stops])[owner]).astype(np.int64))
    return np.concatenate(flat), np.concatenate(counts) if counts else np.zeros(0, np.int64)
