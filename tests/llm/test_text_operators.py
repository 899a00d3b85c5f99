"""Corpus operators against the libraries, brute force and small fixtures with nulls, ties, empty tables and odd names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframes.llm import bpe, html_text, minhash, mixing, ordinal, quality_rules, spotsigs, suffix_dedup, token_files, url_filter
from riskframes.llm.queries import tokenizer_path

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=3, n=60):
    r = random.Random(seed)
    words = ["the", "a", "of", "and", "is"] + ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(40)]
    out = [" ".join(r.choice(words) for _ in range(r.randint(0, 120))) for _ in range(n)]
    for k in range(0, n, 5):  # near copies and copies
        w = out[k].split(" ")
        if len(w) > 30:
            w[3] = "zzz"
        out[(k + 1) % n] = " ".join(w)
        out[(k + 2) % n] = out[k]
    return out + ["", None, " \n\t ", "one", "one", "x" * 3000, "😀 ünï\u0000code", "It's DON'T 'll x've\n\n\nend", "<|endoftext|> a <|startoftext|>"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, and columns with names that operators use inside."""
    rows = [(1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "x"), (None, "a b c d e f g h", None), (2, None, "x"), (3, "", None)]
    out = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("ids", "decoded", "row", "copies", "_null", "_gone", "_host", "digest", "n", "rep", "size", "lang"):
        out = out.withColumn(name, F.lit("own"))
    return out.withColumn("n_chars", F.lit(1).cast("long"))


def test_bpe_is_the_library(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = bpe.bpe_decode(bpe.bpe_encode(docs.withColumn("t", F.col("text")), path), path).collect()
    once = bpe.bpe_round_trip(docs.withColumn("t", F.col("text")), path).collect()
    assert sorted(once, key=lambda r: r["doc_id"]) == sorted(rows, key=lambda r: r["doc_id"])
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r["t"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_pairs_match_merging_by_rank():
    model = bpe.load(tokenizer_path("word_bpe_49k.json"))

    def by_rank(text):
        parts = [model.inner[c] for c in text[:-2]] + [model.inner[text[-2:]]]
        while True:
            ranked = [(model.rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in model.rank]
            if not ranked:
                return parts
            k = min(ranked)[1]
            parts[k : k + 2] = [model.inner[model.text[parts[k]] + model.text[parts[k + 1]]]]

    r = random.Random(5)
    for _ in range(400):
        word = "".join(r.choice("aeinrstolhé") for _ in range(r.randint(1, 14)))
        text = "".join(model.bytes[b] for b in word.encode()) + bpe.STOP
        assert model.encode_piece(word) == by_rank(text)


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    start = 0
    expected = {}
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        expected[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for encoding in ("dictionary", "delta"):
        to = str(tmp_path / encoding)
        token_files.write_token_files(token_files.tokenize(docs, path, 0), to, encoding)
        got = token_files.starts(token_files.checksums(token_files.read_token_files(spark, to)))
        assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()} == expected
    some = token_files.read_token_files(spark, to, ["doc_id", "n_tokens"], F.col("doc_id") < 3)
    assert some.count() == 3
    with pytest.raises(ValueError):
        token_files.write_token_files(docs, to, "plain")


def brute_quality(rows, max_docs, max_share, max_removed):
    lines, hosts = defaultdict(set), defaultdict(set)
    norm = lambda x: re.sub("[\t-\r ]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), x)).strip(" ")
    for k, t, host in rows:
        hosts[host].add(k)
        for x in t.split("\n"):
            if WORD.search(x):
                lines[host, norm(x)].add(k)
    out = []
    for k, t, host in rows:
        words = WORD.findall(t)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        own = [x for x in t.split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in own if len(s := lines[host, norm(x)]) > max_docs and len(s) > max_share * len(hosts[host]))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((k, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(covered), failed, gone, not failed and 100 * gone <= max_removed * len(words)))
    return out


def test_quality_rules_are_brute_force(spark):
    r = random.Random(1)
    body = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    rows = [(k, "Home | Menu\n" + body(60), "h") for k in range(8)] + [(20 + k, "  ".join(f"Ad{i}" for i in range(45)) + "\n" + body(9) + f"\n{k}", "h") for k in range(6)]
    rows += [(40, "x y z " * 40, "h"), (41, "", "g"), (42, body(70) + "\nline\nline\n#*|", "g"), (43, "a " * 49, None), (44, body(55), None)]
    df = spark.createDataFrame([*rows, (45, None, None)], "doc_id long, text string, source string")
    got = sorted(tuple(x) for x in quality_rules.judge(df, max_docs=3, max_share=0.2, max_removed=50).collect())
    assert got == sorted(brute_quality([*rows, (45, "", None)], 3, 0.2, 50))
    assert any(not x[-1] and not x[6] for x in got)
    kept = quality_rules.cleaned(df, max_docs=3, max_share=0.2, max_removed=50)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(x[0] for x in got if x[-1])


def test_documents_are_counted(spark):
    """Lines of many documents of one text are above the limits; rows of one id are one document, and so are all without an id."""
    text = " ".join(f"w{k}" for k in range(80))
    df = lambda ids: spark.createDataFrame([(k, text, "h") for k in ids], "doc_id long, text string, source string")
    assert quality_rules.judge(df(range(21))).filter("kept").count() == 0
    assert quality_rules.judge(df(range(20))).filter("kept").count() == 20
    assert quality_rules.judge(df([1] * 30 + [None] * 30)).filter("kept").count() == 60
    assert quality_rules.cleaned(df([*range(19), None, None])).count() == 21


def test_mixing_targets_and_copies(spark):
    r = random.Random(4)
    rows = [(k, "w " * r.randint(0, 9), s) for k, s in enumerate(r.choices(["a", "b", "c", "d", None], [50, 30, 10, 2, 8], k=4000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while True:  # by resharing the excess
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            free.remove(s)
    target |= share
    taken = Counter()
    for x in got:
        assert x["target"] == pytest.approx(target[x["source"]])
        assert x["copies"] <= 3
        taken[x["source"]] += x["size"] * x["copies"]
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] + 30 for s in order)
    again = mixing.mix(df.repartition(7)).collect()
    assert {x["doc_id"]: x["copies"] for x in got} == {x["doc_id"]: x["copies"] for x in again}
    assert mixing.repeated(df).count() == sum(x["copies"] for x in got)


def test_url_rules_and_words(spark):
    rows = [
        (1, "https://WWW.example.com/en/x?q", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
        (3, "http://b.com/fr/", "b.com", "/fr/", "com/", "allow"),
        (4, "http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        (5, "http://notnet/es/", "notnet", "/es/", None, "allow"),
        (6, "http://cheappills.org/", "cheappills.org", "/", None, "block"),
        (7, "http://my.freebets.example.org/en/1.html#t", "my.freebets.example.org", "/en/1.html", None, "block"),
        (8, "http://schoollibrary.org/news", "schoollibrary.org", "/news", None, "allow"),
        (9, None, "", "", None, "allow"),
        (10, "no address", "", "", None, "allow"),
        (11, "http://b.com", "b.com", "", None, "allow"),
    ]
    df = spark.createDataFrame([x[:2] for x in rows], "page_id long, url string")
    assert sorted(tuple(x) for x in url_filter.judge_urls(df).collect()) == [(x[0], *x[2:]) for x in rows]


def spot_set(text):
    import xxhash

    def h(*xs):
        v = 42
        for x in xs:
            v = xxhash.xxh64(x.encode(), seed=v).intdigest()
        return v

    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    c = [k for k, x in enumerate(w) if x not in set(spotsigs.COMMON)]
    out = {h(w[k], w[c[j]], w[c[j + 1]]) for j in range(len(c) - 1) for k in range(c[j - 1] + 1 if j else 0, c[j]) if w[k] in spotsigs.ANCHORS}
    return out or {h(" ".join(w)) if w else h(text)}


def test_spotsigs_is_brute_force(docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    sets = {k: spot_set(t) for k, t in rows}
    got = {r["doc_id"]: r for r in spotsigs.edited_pairs(docs).collect()}
    for i, (k, t) in enumerate(rows):
        n, after = rows[(i + 1) % len(rows)]
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + after[:quarter]
        e = spot_set(edited)
        r = got[k]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert {int(x, 16) for x in r["fingerprint"].split()} == sets[k]
        assert r["near_edited"] == len(sets[k] & e) / len(sets[k] | e)
        assert r["near_next"] == len(sets[k] & sets[n]) / len(sets[k] | sets[n])


@pytest.mark.parametrize(("percent", "most"), [(80, 256), (60, 256), (60, 1), (55, 3), (100, 2)])
def test_spotsigs_pairs(docs, percent, most):
    rows = {r["doc_id"]: spot_set(r["text"] or "") for r in docs.collect()}
    members, pairs = spotsigs.near_pairs(docs, percent, most=most)
    name = {r["doc_id"]: r["class"] for r in members.collect()}
    first = {}
    for k in sorted(rows):
        assert name[k] == first.setdefault(frozenset(rows[k]), k)
    # sets of a class or two share so few signatures that a second one isn't there; they can't be near and differ
    expected = {tuple(sorted((a, b))) for a in set(name.values()) for b in set(name.values()) if a < b and 100 * len(rows[a] & rows[b]) >= percent * len(rows[a] | rows[b])}
    assert {tuple(sorted((r["a"], r["b"]))) for r in pairs.collect()} == expected
    if percent == 80:
        links = Counter(x for p in expected for x in p)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in spotsigs.edited_pairs(docs).collect()}
        assert got == {k: (name[k], links[name[k]]) for k in rows}


@pytest.mark.parametrize("percent", [50, 55, 80, 99])
def test_spotsigs_bounds(percent):
    """Sizes that may reach the threshold are in one partition or in neighbours."""
    bounds = spotsigs.partition_bounds(percent)
    part = lambda n: sum(b <= n for b in bounds)
    for y in range(1, 400):
        for x in range(1, y + 1):
            if 100 * x >= percent * y:
                assert part(y) - part(x) in (0, 1)


def brute_components(rows, width, percent):
    sets = {}
    for k, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in keys}


def test_minhash_is_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for width in (4, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, width).collect()}
        assert got == brute_components(rows, width, 80)


def test_minhash_edited_copies_around_one_original(spark):
    """Copies with edits of their own link to the original and not to each other: stars and the pairs beside them find all links."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = [(500, " ".join(base))]
    for k in range(120):
        w = list(base)
        for _ in range(r.randint(1, 9)):
            w[r.randrange(len(w))] = f"e{k}x{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(df, 4).collect()}
    assert got == brute_components(rows, 4, 80)


def brute_repeats(rows):
    seen, out = {}, {}
    for k, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            if seen.setdefault(s, k) < k:
                gone[p : p + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[k] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 700, "hot": 3, "merge_bytes": 500, "bucket_bytes": 600}])
def test_suffix_dedup_is_brute_force(spark, sizes):
    r = random.Random(6)
    passage = ["".join(r.choice("abé \n") for _ in range(r.randint(40, 130))) for _ in range(6)]
    rows = []
    for k in range(80):
        parts = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 90))) for _ in range(3)]
        for _ in range(r.randint(0, 3)):
            parts.insert(r.randrange(4), r.choice(passage))
        rows.append((k * 3, "".join(parts)))
    rows += [(1000, rows[4][1]), (1001, "ab" * 200), (1002, "ab" * 150), (1003, None), (1004, ""), (1005, "\0" * 120), (1006, "\0" * 60 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(df, **sizes).collect()}
    assert got == brute_repeats(rows)


def test_suffix_arrays_and_prefixes():
    r = random.Random(2)
    blocks = [bytes(r.choice(b"ab\x00") for _ in range(n)) for n in (1, 7, 200)]
    blocks += [(bytes(r.choice(b"abc") for _ in range(n // 3)) * 4)[:n] + b"ab" * 60 for n in (60, 3000)]  # long repeats beside each other, so that places carry what others know
    blocks += [blocks[2] + blocks[2][:70], b"abcdefgh" * 3, bytes(range(256))]
    for block in blocks:
        data = np.frombuffer(block, np.uint8)
        order, alike, known = suffix_dedup.sorted_suffixes(data)
        padded = block + bytes(50)
        keys = [padded[i : i + 50] for i in order]
        assert keys == sorted(keys)
        true = [next((j for j in range(50) if keys[k][j] != keys[k - 1][j]), 50) for k in range(1, len(data))]
        shared = suffix_dedup.common_prefixes(data, order, alike, known)
        assert [true[k - 1] for k in alike] == shared.tolist()
        assert all(h < 50 for k, h in enumerate(true, 1) if k not in set(alike.tolist()))
        window = np.arange(len(data)) % 7 != 3
        places, firsts = suffix_dedup.sorted_windows(data, window)
        starts = [k for k, p in enumerate(places) if not k or padded[p : p + 50] != padded[places[k - 1] : places[k - 1] + 50]]
        assert sorted(places.tolist()) == np.flatnonzero(window).tolist() and firsts.tolist() == starts


def test_lists_merge_by_binary_search():
    r = np.random.default_rng(3)
    for most in (1, 2, 5, 8):
        lists, want = [], {}
        for _ in range(most):
            keys = np.unique(r.integers(0, 60, r.integers(1, 40)).astype("S50"))
            own = r.integers(0, 1000, len(keys))
            lists.append((keys, own))
            for k, o in zip(keys.tolist(), own.tolist(), strict=True):
                want[k] = min(o, want.get(k, o))
        keys, least = suffix_dedup.merge_lists(lists)
        assert dict(zip(keys.tolist(), least.tolist(), strict=True)) == want and keys.tolist() == sorted(want)


def test_ordinal_held_out(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = ordinal.fit_on(docs, labels.filter(half), max_labelled=1500)
    assert (np.diff(model.thresholds) > 0).all()
    scored = ordinal.grade(docs.join(labels.filter(~half).select("doc_id"), "doc_id"), model).join(labels, "doc_id")
    rate = {(r["quality"], r["toxic"]): r["k"] for r in scored.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1, 0] > 0.97 and rate[0, 0] < 0.2 and rate[1, 1] < 0.2


def test_ordinal_gradient_and_blank_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x y")], "doc_id long, text string")
    model = ordinal.Model(np.zeros(ordinal.BUCKETS), np.array([-1.0, 1.0]))
    got = ordinal.grade(df, model).collect()
    assert len(got) == 3 and all(0 < r["expected_grade"] < 2 for r in got)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b &amp; c<br>d<div>x <b>y</b>  z</div>", "a\n\nb & c\nd\n\nx y z"),
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", "- one\n- two\n  - in\n- three"),
        ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>10</table>", "Name   Qty\napple  10"),
        ("<table><tr><td colspan=2>whole<tr><td>a<td>bb</table>", "whole\na  bb"),
        ("a<script>x<p></script><style>p{}</style><span hidden>no</span><div style='display: none'>no</div>b", "ab"),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("<title>t</title><body>x<!-- <p>no --><noscript>n</noscript>", "x"),
        ("<dl><dt>T<dd>D</dl>", "T\n  D"),
        ("<p>un<b>closed <i>tags", "unclosed tags"),
        ("", ""),
        (None, None),
    ],
)
def test_html(page, text):
    assert html_text.visible_text(page) == text


def test_html_deep_and_long(spark):
    assert html_text.visible_text("<div>" * 20000 + "x") == "x"
    assert len(html_text.visible_text("<p>word " * 20000).split()) == 20000
    df = spark.createDataFrame([(1, "<p>é"), (1, "<p>é"), (2, None)], "page_id long, html string").withColumn("n_chars", F.lit("own"))
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [(1, "é", 1), (1, "é", 1), (2, None, 0)]


def test_odd_rows_and_names(odd):
    path = tokenizer_path("word_bpe_49k.json")
    assert bpe.bpe_decode(bpe.bpe_encode(odd, path), path).count() == 5
    assert quality_rules.judge(odd).filter("kept").count() == 0
    assert quality_rules.cleaned(odd).columns == odd.columns
    assert mixing.mix(odd).count() == 5
    assert mixing.repeated(odd).columns == odd.columns
    near = minhash.near_duplicates(odd).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near if r["doc_id"]) == [(1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True)]
    assert [r["component_id"] for r in near if r["doc_id"] is None] == [None]
    assert minhash.without_duplicates(odd).columns == odd.columns
    left = suffix_dedup.without_repeats(odd)
    assert left.columns == odd.columns and left.filter("_null = 'own' and row = 'own'").count() == 5
    assert spotsigs.edited_pairs(odd).count() == 5
    assert token_files.token_file_report(odd, tokenizer_path("byte_bpe_50k.json"), 0).count() == 5


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    path = tokenizer_path("word_bpe_49k.json")
    assert bpe.bpe_encode(none, path).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert spotsigs.edited_pairs(none).count() == 0
    assert token_files.token_file_report(none, tokenizer_path("byte_bpe_50k.json"), 0).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    with pytest.raises(ValueError):
        ordinal.fit_on(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))


def test_minhash_links_beside_a_star_are_all_found(spark):
    """Pairs of small sets at exactly 0.8 (4 of 5, 8 of 10, 16 of 20) in a bucket whose centre is like none of them."""
    r = np.random.default_rng(5)
    members, sets, want = [(1, 0, 5)], [(0, np.sort(r.integers(1, 2**63, 5, dtype=np.uint64)).tobytes())], set()
    for k, (both, n) in enumerate([(4, 5), (8, 10), (16, 20)] * 30):
        x = r.integers(1, 2**63, n, dtype=np.uint64)
        for rep, s in ((2 * k + 1, x), (2 * k + 2, x[:both])):
            members.append((1, rep, len(s)))
            sets.append((rep, np.sort(s).tobytes()))
        want.add((2 * k + 1, 2 * k + 2))
    got = minhash.links(spark.createDataFrame(members, "bucket long, rep long, n long"), spark.createDataFrame(sets, "rep long, set binary"), 80).collect()
    assert {(x["a"], x["b"]) for x in got} == want


def test_minhash_sketches_differ_in_no_more_bits_than_sets():
    r = np.random.default_rng(6)
    for n in (1, 5, 300, 5000):
        x, y = (np.unique(r.integers(1, 2**63, n, dtype=np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([x[: n // 2], y[: n // 2 + 1]]))
        a, b = minhash.bit_sketches(np.concatenate([x, y]), np.array([len(x), len(y)]))
        assert sum(int(v).bit_count() for v in a ^ b) <= len(np.setxor1d(x, y))


def test_quality_rules_take_lines_out(spark):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(k, f"Share  this PAGE\n{body(k)}\n\n share this page\nend {k}", "a", 7) for k in range(21)] + [(30, f"share this page\n{body(30)}", "b", 9), (31, None, "a", 0), (32, f"{body(32)}\nx", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = quality_rules.cleaned(df)
    assert out.columns == df.columns
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in out.collect()}
    want = {k: f"{body(k)}\n\nend {k}" for k in range(21)}
    assert got == {k: (t, len(t)) for k, t in want.items()} | {30: (rows[21][1], 9), 32: (rows[23][1], 5)}
