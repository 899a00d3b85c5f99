"""The pipeline against a brute-force version of its stages."""

import random
from collections import Counter

import corpus_pipeline
from riskframes.llm import mixing
from riskframes.llm._common import relieve
from riskframes.llm.queries import tokenizer_path

from test_text_operators import brute_components, brute_quality, brute_repeats  # noqa: I001


def test_stages(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijk") for _ in range(5)) for _ in range(900)]
    body = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = body(30)
    rows = [(k, body(60) + "\n" + (passage if k % 4 == 0 else body(30)), "en", f"s{k % 3}") for k in range(40)]
    rows += [(100 + k, rows[k][1].replace(" ", "  ", 1), "en", "s0") for k in range(5)] + [(200, "short", "en", "s1"), (201, None, "de", "s1"), (202, rows[7][1], "en", None)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x[0] for x in brute_quality([(k, t or "", s) for k, t, _, s in rows], 20, 0.01, 70) if x[-1]}
    one = corpus_pipeline.quality(spark, docs, "")
    assert one.columns == docs.columns
    assert {x["doc_id"] for x in one.collect()} == kept and 200 not in kept
    left = [(k, t) for k, t, _, _ in rows if k in kept]
    single = {k for k, v in brute_components(left, 5, 80).items() if v[2]}
    two = corpus_pipeline.near_duplicates(spark, one, "")
    assert {x["doc_id"] for x in two.collect()} == single and 202 not in single
    three = corpus_pipeline.repeated_passages(spark, two, "")
    assert three.columns == docs.columns
    removed = brute_repeats([x for x in left if x[0] in single])
    got = {x["doc_id"]: x for x in three.collect()}
    assert all(len(got[k]["text"].encode()) == n - gone and got[k]["n_chars"] == len(got[k]["text"]) for k, (n, gone, _, _) in removed.items())
    assert sum(v[1] for v in removed.values()) > 0
    four = corpus_pipeline.mixture(spark, three, "")
    copies = {x["doc_id"]: x["copies"] for x in mixing.mix(three).collect()}
    assert Counter(x["doc_id"] for x in four.collect()) == Counter({k: c for k, c in copies.items() if c})
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for x in corpus_pipeline.tokens(spark, four, "").collect():
        assert x["ids"] == library.encode(got[x["doc_id"]]["text"], add_special_tokens=False).ids and x["n_tokens"] == len(x["ids"])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_odd_rows(spark):
    """Null ids, repeated rows, null and long texts, and columns with names that operators use inside pass all stages."""
    from pyspark.sql import functions as F

    body = lambda k, n=70: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(k, body(k), "en", f"s{k % 2}", 1) for k in range(8)] + [(3, body(3), "en", "s1", 1), (None, body(50), "en", None, 1), (None, body(51), "en", None, 1), (9, None, "en", "s0", 0), (10, body(10, 30_000), "en", "s0", 1), (11, "", None, "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("ids", "row", "n", "rep", "part", "size", "copies", "h", "above", "host", "line", "_above", "_gone", "_null"):
        docs = docs.withColumn(name, F.lit("own"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
    kept = {r["doc_id"] for r in now.filter("row = 'own' and _gone = 'own'").collect()}
    assert kept <= {*range(8), 10, None} and {0, 10, None} <= kept
    out = corpus_pipeline.tokens(spark, now, "").collect()
    assert len(out) == now.count() and all(r["n_tokens"] == len(r["ids"]) > 0 for r in out)


def test_python_stages_begin_with_a_small_heap(spark):
    """Before Python workers start, the executors (here the one JVM) collect their whole heap and give back what is free."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def collections() -> int:
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())

    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    before = collections()
    relieve(spark)
    assert collections() > before  # tasks that ask at once share one
    before = collections()
    corpus_pipeline.tokens(spark, docs, "")  # nothing runs but that
    assert collections() > before
