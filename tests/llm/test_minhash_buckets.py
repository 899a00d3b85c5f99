"""Near-duplicates: short texts against brute force, and large buckets that are split."""

import random

import numpy as np

from riskframes.llm import minhash

from test_text_operators import brute_components


def test_short_texts_are_brute_force(spark):
    """Pairs of 3 to 40 shingles at and near 0.8, each with words of its own."""
    r = random.Random(8)
    rows, k = [], 0
    for trial in range(400):
        n = r.randint(3, 40)
        words = [f"t{trial}w{i}" for i in range(n + 3)]
        cut = r.choice([max(0, round(n / 5)), max(0, n // 5 - 1), n // 4 + 1])
        for text in (words, words[: len(words) - cut]):
            rows.append((k, " ".join(text)))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(df, 4).collect()}
    assert got == brute_components(rows, 4, 80)


def bucket(spark, sets):
    """One bucket with a centre of its own and these sets, as ``links`` takes them."""
    own = np.random.default_rng(3).integers(1, 2**63, 5, dtype=np.uint64)
    sets = [own, *sets]
    members = spark.createDataFrame([(1, k, len(s)) for k, s in enumerate(sets)], "bucket long, rep long, n long")
    return members, spark.createDataFrame([(k, np.sort(s).tobytes()) for k, s in enumerate(sets)], "rep long, set binary"), sets


def linked(sets):
    out = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                out.add((i, j))
    return out


def test_large_buckets_lose_no_link(spark):
    """Members with a common part of two thirds, some of them near each other, and sets made of common passages alone."""
    r = np.random.default_rng(4)
    common = r.integers(1, 2**63, 60, dtype=np.uint64)
    passages = r.integers(1, 2**63, (12, 10), dtype=np.uint64)
    sets = []
    for k in range(40):
        x = np.concatenate([common, r.integers(1, 2**63, 30, dtype=np.uint64)])
        sets.append(x)
        if k % 3 == 0:
            sets.append(np.concatenate([x[: -(k % 12) or None], r.integers(1, 2**63, k % 7, dtype=np.uint64)]))
    for _ in range(40):
        sets.append(np.unique(passages[r.choice(12, 6, replace=False)].ravel()[: r.integers(50, 60)]))
    members, rows, sets = bucket(spark, sets)
    got = {(x["a"], x["b"]) for x in minhash.links(members, rows, 80).collect()}
    want = linked(sets)
    assert got == want  # no star links here, so all pairs are of different components


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(7)
    counts = r.integers(0, 50, minhash.SLOTS)
    for _ in range(300):
        n = int(r.integers(4, 60))
        x = r.integers(1, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n - int(r.integers(0, n // 5 + 1))], r.integers(1, 2**63, int(r.integers(0, n // 6 + 1)), dtype=np.uint64)])
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        assert len(np.intersect1d(minhash.rarest(x, counts, 80), minhash.rarest(y, counts, 80))) >= 1
