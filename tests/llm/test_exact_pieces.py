"""Ids are the library's for every piece: words that a polynomial hash can't tell apart, pieces whose hash is forced to clash, and all code points."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskframes.llm import bpe, minhash, pretoken, token_files
from riskframes.llm._common import text_buffers
from riskframes.llm.queries import tokenizer_path

VOCABULARIES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def thue_morse(n):
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def ours(name, texts):
    path = tokenizer_path(name)
    flat, counts = bpe.load(path).encode(texts) if name.startswith("word") else token_files.encode_rows(texts, path)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def library(name, texts):
    return [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_words_that_clash_modulo_a_power_of_two(name):
    one, two = thue_morse(1024)
    assert ours(name, [one, two]) == library(name, [one, two])
    assert ours(name, [f"{two} {one}"]) == library(name, [f"{two} {one}"])


def test_words_that_clash_are_different_shingles():
    import pyarrow as pa

    one, two = thue_morse(2048)
    flat, counts = minhash.shingle_sets(*text_buffers(pa.array([one, two])), 5)
    assert counts.tolist() == [1, 1] and flat[0] != flat[1]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_equal_hashes_of_other_pieces(name, monkeypatch):
    """Whatever the hash is, ids are those of the piece: here it tells pieces apart by length alone."""
    monkeypatch.setattr(pretoken, "mark_hash", lambda heads, tails, sizes: sizes.astype(np.uint64))
    texts = ["the cat sat on the mat", "dog pig été ünï 😀😀 99", "xyzzy plugh", "", "été pig cat", "x" * 40 + " eighteenlettersxyz " + "y" * 16 + " " + "y" * 15 + "z"]
    memo = bpe.load(tokenizer_path(name)).memo if name.startswith("word") else token_files._tokenizer(tokenizer_path(name))[1]
    memo.clear()
    assert ours(name, texts) == library(name, texts)
    assert ours(name, texts[::-1]) == library(name, texts[::-1])
    memo.clear()


def test_memo_starts_afresh():
    memo = pretoken.Memo(lambda words: [[len(w), ord(w[0])] for w in words], most=5, most_bytes=40)
    for turn in range(4):
        texts = [f"w{turn}{k} {'z' * (k + turn)}" for k in range(6)]
        flat, counts = pretoken.encode_texts(texts, memo, spaced=True)
        assert counts.sum() == len(flat)
        again, _ = pretoken.encode_texts(texts, memo, spaced=True)
        assert flat.tolist() == again.tolist()


@pytest.mark.parametrize("name", VOCABULARIES)
def test_all_code_points(name):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}B1{chr(c)} {chr(c)}́x" for c in points[i : i + 50_000]]
        assert ours(name, texts) == library(name, texts)
