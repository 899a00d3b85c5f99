"""SpotSigs: fingerprints from chains of content words that follow common words.

A text is lowered and split into letters and digits. Each anchor (a very common word) together with the next
``CHAIN`` content words, skipping other common words, is a signature; the set of their hashes is the fingerprint. Text of
navigation and advertisement has few anchors, so it hardly counts. A text without a signature has one of its own: the hash
of its words, or of itself where it has none. So equal texts have equal sets, and no set is empty.

``near_pairs`` compares sets. Equal sets are one class; classes are compared, not copies. Classes are put into partitions by the size of the set,
such that sets in partitions that aren't neighbours can't reach the threshold, and within them only sets that share one of their rarest signatures
meet, with the sizes checked first (a set of n needs no more than its n - ceil(percent * n / 100) + 1 rarest). Where more than ``PAIRS`` classes
share a signature, they are split by a second rare signature, which sets that reach the threshold share as well. Rare is
what counters of a fixed number say, so the order of all signatures is a table of ``SLOTS`` bytes, whatever the input; a poor order costs time and loses nothing.
Classes that meet are compared within the join by sketches (``64 * WORDS`` bits, each the parity of the signatures that fall on it): at least as many
signatures differ as bits, so only pairs that may reach the threshold come out, and get their exact likeness.

Everything is DataFrame functions. Null and empty texts have the one signature of no words; very long texts are read whole. Repeated rows and ties of the key are in
order of their text. Documents without a key have neither class nor links; rows that share a key have its smallest class. Extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, let, release

#: Very common words of four languages. Anchors open a chain; no common word is a content word.
ANCHORS = ["the", "a", "is", "was", "der", "die", "ist", "ein", "le", "la", "est", "un", "el", "los", "es", "una"]
COMMON = ANCHORS + [
    "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "do", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "it", "its",
    "not", "of", "on", "or", "she", "that", "their", "they", "this", "to", "we", "were", "which", "will", "with", "you", "auf", "auch", "das", "dem", "den", "des", "eine", "für",
    "im", "mit", "nicht", "sich", "sie", "sind", "und", "von", "zu", "au", "aux", "avec", "ce", "dans", "de", "du", "en", "et", "les", "par", "pas", "pour", "que", "qui",
    "sur", "une", "al", "como", "con", "del", "las", "no", "para", "por", "se", "su", "y",
]
CHAIN = 2
PAIRS, SLOTS, WORDS = 256, 1 << 16, 4
RANGE_ROWS, MOST_RANGES = 4_000, 16_384


def signatures(text: Column) -> Column:
    """The sorted distinct signature hashes of a text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def chains(w: Column, c: Column) -> Column:
        def before(j: Column) -> Column:  # the common words just before content word j, and their chain
            after = F.coalesce(F.get(c, j - 1)["i"], F.lit(-1))
            gap = F.filter(F.slice(w, after + 2, F.get(c, j)["i"] - after - 1), lambda a: a.isin(ANCHORS))
            return F.transform(gap, lambda a: F.xxhash64(a, *(F.get(c, j + k)["x"] for k in range(CHAIN))))

        each = F.flatten(F.transform(F.sequence(F.lit(0), F.size(c) - CHAIN), before))
        return F.when(F.size(c) >= CHAIN, each).otherwise(F.array().cast("array<bigint>"))

    def found(w: Column) -> Column:
        content = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~s["x"].isin(COMMON))
        return let(content, lambda c: chains(w, c))

    alone = lambda w: F.array(F.when(F.size(w) > 0, F.xxhash64(F.array_join(w, " "))).otherwise(F.xxhash64(F.coalesce(text, F.lit("")))))
    both = let(words, lambda w: let(found(w), lambda s: F.when(F.size(s) > 0, s).otherwise(alone(w))))
    return F.sort_array(F.array_distinct(both))


def as_string(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, F.hex), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _numbers(values: list, kind: str) -> Column:
    """A constant array from one literal, however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _place(docs: DataFrame, key: str) -> Column:
    """The range of a key: cut at approximate quantiles into ranges of some ``RANGE_ROWS`` rows; null has one of its own."""
    ranges = max(1, min(MOST_RANGES, docs.count() // RANGE_ROWS))
    found = docs.select(F.percentile_approx(key, _numbers([k / ranges for k in range(1, ranges)], "double"), 20 * ranges)).first()[0] if ranges > 1 else None
    cuts = sorted(set(found or []))
    if not cuts:
        return F.when(F.col(key).isNull(), -1).otherwise(0)
    step = math.isqrt(len(cuts)) + 1  # two steps of about the root of their number, not one comparison for each
    tops = _numbers(cuts[::step], "bigint")
    inner = F.transform(F.split(F.lit(";".join(",".join(map(str, cuts[i : i + step])) for i in range(0, len(cuts), step))), ";"), lambda x: F.split(x, ",").cast("array<bigint>"))
    block = F.size(F.filter(tops, lambda m: m <= F.col(key)))
    within = let(block, lambda b: F.when(b > 0, (b - 1) * step + F.size(F.filter(F.get(inner, b - 1), lambda m: m <= F.col(key)))).otherwise(0))
    return F.when(F.col(key).isNull(), -1).otherwise(within)


def with_next(docs: DataFrame, key: str, text: str, derive, info: DataFrame | None = None) -> DataFrame:
    """``derive(docs)`` with ``next``, a struct of the text and derived columns of the next row by key (null first, then by text); the last has the first.

    Rows follow each other within a range of keys, and the last of a range gets the first row of the next. No task sees more than a range; the
    table of ranges has one row each. Texts and derived columns mustn't be null. ``info``: columns by key (one row each) that rows get along the way, without another exchange.
    """
    place = _place(docs, key)
    placed = docs.withColumn("_range", place)
    order = [F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first()]
    derived = derive(placed)
    rows = [text, *(c for c in derived.columns if c not in placed.columns)]
    if info is not None:  # a row without text before those of its key
        derived = derived.unionByName(info.withColumn("_range", place), allowMissingColumns=True)
        known = Window.partitionBy("_range", key).orderBy(order[1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        derived = derived.withColumns({c: F.last(c, ignorenulls=True).over(known) for c in info.columns if c != key})
    ahead = f"over (partition by _range order by `{key}` asc nulls first, `{text}` asc nulls first)"
    leads = {c: F.expr(f"lead(`{c}`) ignore nulls {ahead}").alias(f"_lead_{c}") for c in rows}  # columns, not a struct of them, which would be exchanged as well
    step_on = derived.select("*", *leads.values()).filter(F.col(text).isNotNull())
    firsts = placed.groupBy("_range").agg(F.min(key).alias("_first"))
    ahead = Window.orderBy("_range")
    wrap = F.first("_first").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wrap_range = F.first("_range").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select(F.col("_range").alias("_of"), F.when(F.lead("_range").over(ahead).isNull(), wrap).otherwise(F.lead("_first").over(ahead)).alias("_want"),
        F.coalesce(F.lead("_range").over(ahead), wrap_range).alias("_in"))
    heads = placed.join(F.broadcast(firsts), (F.col("_range") == F.col("_in")) & F.col(key).eqNullSafe(F.col("_want")))  # one key of each range
    heads = derive(heads.groupBy("_of").agg(F.min(text).alias(text))).select("_of", F.struct(*rows).alias("_head"))
    joined = step_on.join(heads, F.col("_range") == F.col("_of"), "left")
    after = F.struct(*[F.coalesce(F.col(f"_lead_{c}"), F.col("_head")[c]).alias(c) for c in rows])
    return joined.withColumn("next", after).drop("_head", "_of", "_range", *(f"_lead_{c}" for c in rows))


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Each document's fingerprint, that of its text with the last quarter replaced from the next document, and their likeness.

    ``class_id``: the smallest key with the same fingerprint; ``n_links``: how many other fingerprints of all documents reach the threshold with it.
    """
    members, pairs = near_pairs(docs, percent, key, text)
    ends = F.explode(F.array("a", "b")).alias("class")
    links = pairs.select(ends).groupBy("class").agg(F.count("*").alias("n_links"))
    info = cut(members.groupBy(key).agg(F.min("class").alias("class")).join(links, "class", "left").select(key, F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))
    release(docs.sparkSession)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = with_next(rows, key, "t", lambda df: df.withColumn("sigs", signatures(F.col("t"))), info)
    n = F.length("t")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.select(key, "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), n.cast("bigint").alias("n_chars"), "sigs", F.col("next.sigs").alias("next_sigs"),
        F.concat(F.substring("t", F.lit(1), n - quarter), F.substring(F.col("next.t"), F.lit(1), quarter)).alias("edited"))
    out = F.struct(
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_string(F.col("sigs")).alias("fingerprint"), let(
            signatures(F.col("edited")), lambda e: F.struct(as_string(e).alias("s"), likeness(F.col("sigs"), e).alias("near"))).alias("e"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
    rows = rows.select(key, "n_chars", "class_id", "n_links", out.alias("o"))
    return rows.select(key, "n_chars", "o.edited_sha256", "o.fingerprint", F.col("o.e.s").alias("edited_fingerprint"), F.col("o.e.near").alias("near_edited"), "o.near_next", "class_id", "n_links")


def partition_bounds(percent: int) -> list[int]:
    """Smallest sizes of the partitions: sizes x <= y with 100 * x >= percent * y are in one or in neighbours. ``percent`` is below 100."""
    bounds = [1]
    while bounds[-1] < 1 << 31:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return bounds


def _rarity(classes: DataFrame) -> Column:
    """One byte for each of ``SLOTS`` counters of signatures, higher for more, as a constant."""
    counts = classes.select(F.explode("sigs").alias("sig")).groupBy(F.pmod("sig", F.lit(SLOTS)).alias("slot")).agg(F.count("*").alias("c"))
    level = bytearray(SLOTS)
    for r in counts.collect():  # SLOTS rows at most
        level[r["slot"]] = min(255, int(4 * math.log2(r["c"])))
    return F.lit(bytes(level))


def _bits(sigs: Column) -> list[Column]:
    """WORDS numbers: bit i is odd if an odd number of signatures fall on it."""

    def word(k: int) -> Column:
        mine = F.filter(sigs, lambda s: F.shiftrightunsigned(s, 6).bitwiseAND(F.lit(WORDS - 1)) == k)
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, s: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), s.bitwiseAND(F.lit(63)).cast("int"))))

    return [word(k).alias(f"w{k}") for k in range(WORDS)]


def _meet(rows: DataFrame, on: list[str], percent: int) -> DataFrame:
    """Pairs (a, b) of classes that agree in ``on`` and are in one partition or in neighbours, the smaller set first, and whose sketches allow the threshold."""
    side = lambda x: rows.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), *on, F.col("part").alias(f"p{x}"), *(F.col(f"w{k}").alias(f"{x}{k}") for k in range(WORDS)))
    beside = (F.col("pb") - F.col("pa")).isin(0, 1)
    close = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    differ = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    near = (100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))
    return side("a").join(side("b"), on).filter(beside & close & (100 * F.col("na") >= percent * F.col("nb")) & near).select("a", "b").distinct()


def near_pairs(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text", most: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """(key, class) of every document, and (a, b, likeness) of classes whose likeness reaches ``percent`` / 100.

    A class is named by its smallest key; documents without a key are left out of both.
    """
    sets = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), signatures(F.col(text)).alias("sigs"))
    classes = cut(sets.groupBy("sigs").agg(F.min("id").alias("class")))
    name = [F.xxhash64("sigs").alias("d"), F.xxhash64(F.lit(1), "sigs").alias("e")]
    members = sets.select("id", *name).join(classes.select("class", *name), ["d", "e"]).select(F.col("id").alias(key), "class")
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0, and 100 at most")
    levels = _rarity(classes)
    ranked = F.sort_array(F.transform("sigs", lambda s: F.struct(F.substring(levels, F.pmod(s, F.lit(SLOTS)).cast("int") + 1, F.lit(1)).alias("r"), s.alias("s"))))
    n = F.size("sigs")
    prefix = (n - F.floor((percent * n + 99) / 100) + 1).cast("int")
    rare = F.transform(F.slice(ranked, 1, prefix + 1), lambda x: x["s"])
    part = F.size(F.filter(_numbers(partition_bounds(percent), "bigint"), lambda b: b <= n)) if percent < 100 else n
    heads = classes.select("class", n.alias("n"), part.alias("part"), F.explode(F.slice(rare, 1, prefix)).alias("sig"))
    several = heads.groupBy("sig").agg(F.count("*").alias("many")).filter("many > 1")
    met = cut(heads.join(several, "sig"))
    bits = cut(classes.join(met.select("class").distinct(), "class", "left_semi").select("class", *_bits(F.col("sigs"))))
    pairs = _meet(met.filter(F.col("many") <= most).drop("many").join(bits, "class"), ["sig"], percent)
    hot = met.filter(F.col("many") > most).drop("many")
    if not hot.isEmpty():
        again = hot.join(classes.select("class", rare.alias("rare")), "class").select("class", "n", "part", "sig", F.explode("rare").alias("other")).filter("sig != other")
        again = cut(again.select("class", "n", "part", F.least("sig", "other").alias("sig"), F.greatest("sig", "other").alias("other")).distinct())
        both = again.groupBy("sig", "other").agg(F.count("*").alias("many")).filter("many > 1").drop("many")
        pairs = pairs.union(_meet(again.join(both, ["sig", "other"], "left_semi").join(bits, "class"), ["sig", "other"], percent)).distinct()
    pairs = cut(pairs)
    a, b = classes.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), classes.select(F.col("class").alias("b"), F.col("sigs").alias("sb"))
    shared, sizes = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    found = cut(pairs.join(a, "a").join(b, "b").select("a", "b", shared.alias("both"), sizes.alias("all")).filter(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))))
    return members, found.select("a", "b", (F.col("both") / (F.col("all") - F.col("both"))).alias("likeness"))
