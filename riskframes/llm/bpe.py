"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over all tokens gives the longest token at each place of a piece. The encoder goes
left to right with the longest match, and steps back to the next shorter one where the token doesn't go with
the token before it. Two tokens go together if merging their joined text in rank order gives the same two
tokens; a table keeps what has been found out for a pair. As all neighbours of the true encoding go together and no
other sequence has that property, the result is exactly that of merging by rank, in linear time.

Decoding lays the text of all tokens into one block of bytes with an offset for each id, and gathers.

Inputs: null text has no tokens; empty text as well. Very long texts and pieces are encoded whole. An empty table gives no rows. Ids outside the vocabulary are an error. Extra columns are
passed through; one that has the name of an output gives way to it. Repeated rows are encoded alike.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import frugal, list_array, slices
from .pretoken import Memo, encode_texts

END = "</w>"
STOP = ""  # one character for the word end, so that it can't be taken for text
#: Latin, its signs and marks, Greek without the capital sigma (Python looks at its neighbours), Cyrillic, general punctuation.
_SETTLED = re.compile("[\u0000-\u024f\u0300-\u036f\u0370-\u0377\u037a-\u037f\u0384-\u03a1\u03a4-\u052f\u1e00-\u1eff\u2010-\u2027\u2030-\u205e\u20ac]*")
_loaded: dict[str, "WordBpe"] = {}
_tables: dict[str, "OffsetTable"] = {}


class WordBpe:
    """The vocabulary of a tokenizer file with word ends."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        if model.get("end_of_word_suffix") != END:
            raise ValueError("a vocabulary with word ends is needed")
        self.vocab: dict[str, int] = model["vocab"]
        inner = {self._inner(k): v for k, v in self.vocab.items()}
        self.inner = inner
        self.text = {v: k for k, v in inner.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = dict.fromkeys(inner.values(), -1)
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[left, right] = n
            if whole not in self.parts:
                self.parts[whole], self.order[whole] = (left, right), n
        self.automaton = ahocorasick.Automaton()
        for text, i in inner.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.width = {i: len(x) for i, x in self.text.items()}
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.bytes = byte_letters()
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.specials, key=len, reverse=True)) or r"(?!)")
        self.normalizer = None
        self.memo = Memo(lambda words: [self.encode_piece(w) for w in words], 600_000)

    @staticmethod
    def _inner(token: str) -> str:
        return token[: -len(END)] + STOP if token.endswith(END) else token

    def go_together(self, left: int, right: int) -> bool:
        """Whether merging the joined text of both tokens by rank gives these two again.

        Undo the later of both tokens' last merges, again and again. At each step the two tokens that touch at
        the border must not have a merge that comes before the one undone last, else it would have been made.
        A merge of equal rank goes to the left occurrence first, so it counts on the right side only.
        """
        a, b, before = left, right, 1 << 60
        while True:
            n = self.rank.get((a, b))
            if n is not None and n < before:
                return False
            ra, rb = self.order[a], self.order[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, self.parts[a][1]
            else:
                before, b = rb + 1, self.parts[b][0]

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1: none."""
        if token not in self.shorter:
            text = self.text[token]
            self.shorter[token] = next((self.inner[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.inner), -1)
        return self.shorter[token]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of normalised text."""
        letters = self.bytes
        text = "".join([letters[b] for b in piece.encode()]) + STOP
        whole = self.inner.get(text)
        if whole is not None and self.order[whole] < 0:
            return [whole]
        n = len(text)
        longest = [-1] * n
        best = [0] * n
        for end, (size, i) in self.automaton.iter(text):
            start = end - size + 1
            if size > best[start]:
                best[start], longest[start] = size, i
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        fits, width = self.fits, self.width
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                to = at + width[token]
                if open_[to]:
                    if last < 0:
                        break
                    ok = fits.get((last, token))
                    if ok is None:
                        ok = fits[last, token] = self.go_together(last, token)
                    if ok:
                        break
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                at = to
                token = longest[at] if at < n else -1
            else:  # nothing goes on from here: step back
                open_[at] = 0
                token = out.pop()
                at -= width[token]
                token = self.prefix(token)
        if len(fits) > 60_000:
            fits.clear()
        return out

    def normal(self, text: str) -> str:
        """Composed and lowered as the file says. Python does so for the scripts in ``_SETTLED``; other text goes through the library, whose version of Unicode counts."""
        if text.isascii():
            return text.lower()
        if _SETTLED.fullmatch(text):
            return unicodedata.normalize("NFC", text).lower()
        if self.normalizer is None:
            from tokenizers import normalizers

            self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        return self.normalizer.normalize_str(text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        parts: list[str] = []
        marks: list[tuple[int, int]] = []  # a special token before the part of that number
        first = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            text = text or ""
            if "<|" in text:
                at = 0
                for m in self.special.finditer(text):
                    parts.append(self.normal(text[at : m.start()]))
                    marks.append((len(parts), self.specials[m[0]]))
                    at = m.end()
                text = text[at:]
            parts.append(self.normal(text))
            first[k + 1] = len(parts)
        ids, counts = encode_texts(parts, self.memo, spaced=False)
        if marks:
            ends = np.concatenate([[0], np.cumsum(counts)])
            at = np.array([m[0] for m in marks])
            ids = np.insert(ids, ends[at], [m[1] for m in marks])
            np.add.at(counts, at, 1)
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[first[1:]] - total[first[:-1]]


class OffsetTable:
    """Bytes of all tokens in order of their ids, a blank after each, and the offsets."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        names = {v: k for k, v in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec.get("added_tokens", [])}
        blocks = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        self.block, self.offsets = np.frombuffer(b"".join(blocks), np.uint8), np.cumsum([0, *map(len, blocks)])

    def decode(self, ids: np.ndarray, counts: np.ndarray, step: int = 1 << 17) -> pa.Array:
        """The text of each row of ids: the file names no decoder, so tokens are joined by a blank."""
        block, offsets = self.block, self.offsets
        if len(ids) and (ids.min() < 0 or ids.max() >= len(offsets) - 1):
            raise ValueError("an id is outside the vocabulary")
        sizes = offsets[ids + 1] - offsets[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(ends[-1]), np.uint8)
        for i in range(0, len(ids), step):
            size = sizes[i : i + step]
            shift = offsets[ids[i : i + step]] - ends[i : i + len(size)]
            lo, hi = int(ends[i]), int(ends[i + len(size)])
            out[lo:hi] = block[np.repeat(shift, size) + np.arange(lo, hi)]
        rows = ends[np.concatenate([[0], np.cumsum(counts)])]
        if len(counts) and (counts > 0).any():  # no blank after the last token of a row
            keep = np.ones(len(out), bool)
            keep[rows[1:][counts > 0] - 1] = False
            out = out[keep]
            rows = rows - np.concatenate([[0], np.cumsum(counts > 0)])
        return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load(path: str) -> WordBpe:
    """The vocabulary of ``path``, read once a worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def load_table(path: str) -> OffsetTable:
    if path not in _tables:
        _tables[path] = OffsetTable(path)
    return _tables[path]


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column ``ids`` array<int> of the tokens of ``text`` in the text's place. Null and empty texts have none."""
    others = [c for c in df.columns if c.lower() not in (text.lower(), ids.lower())]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches):
            flat, counts = bpe.encode(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), list_array(flat, counts, pa.int32())], [*others, ids])

    return df.mapInArrow(frugal(run), schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with a column ``decoded`` of the text of ``ids``. Null and empty lists give an empty text."""
    others = [c for c in df.columns if c.lower() != decoded.lower()]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = load_table(path)
        for batch in slices(batches):
            column = batch.column(ids)
            counts = np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)
            out = decoder.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), out], [*others, decoded])

    return df.mapInArrow(frugal(run), schema)


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``bpe_encode`` and ``bpe_decode`` by one worker a task, which holds the vocabulary once."""
    others = [c for c in df.columns if c.lower() not in (text.lower(), ids.lower(), decoded.lower())]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, decoder = load(path), load_table(path)
        for batch in slices(batches):
            flat, counts = bpe.encode(batch.column(text).to_pylist())
            arrays = [*(batch.column(c) for c in others), list_array(flat, counts, pa.int32()), decoder.decode(flat.astype(np.int64), counts)]
            yield pa.RecordBatch.from_arrays(arrays, [*others, ids, decoded])

    return df.mapInArrow(frugal(run), schema)
