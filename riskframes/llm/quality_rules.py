"""Quality rules: line frequency across the documents of a host, beside measures of the text itself.

Lines are normalised (A-Z lowered, white space collapsed) and hashed. For each host the number of distinct documents (by their
key) that hold a line is counted. A line is above the limit if more than ``max_docs`` documents and more than ``max_share`` of the host's
documents hold it. Its words are taken out; a document of whose words more than ``max_removed`` percent go is depleted and rejected.

Everything is DataFrame functions. Rows are exchanged as (host, key, line hash), never as texts; counts are
combined before they are exchanged, so a line or host with a third of all rows is one small sum a task. The lines above the limits of
a host are one row: each is in more than ``max_share`` of its documents, so there are at most 1 / ``max_share`` times as many as a document has on average.

Inputs: null and empty texts have no words and fail the base rules; a null host is a host of its own, rows with a null key are one
document; repeated rows count once and get the same verdict each; very long texts are read whole; extra columns are left out but for
those in ``keep``, and never read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD_BREAKS, cut, fresh, let, words_of

#: Lines above the limits that may be sent to all executors; beyond, documents are joined with them by a shuffle.
BROADCAST_LINES = 200_000
HAS_WORD = r"[^\x09-\x0D\x20]"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def repeated_words(words: Column) -> Column:
    """Words within a window of three words that the text has twice or more, in time n log n.

    Hashes of all windows are compared first; only texts with equal ones sort (hash, place) and add up the
    places that equal neighbours cover, three words each, less where the next begins sooner.
    """

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def width(p: Column) -> Column:
            each = F.transform(p, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - v, F.lit(3))).cast("bigint"))
            return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(pairs, lambda s: let(places(s), width))

    def grams(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    none = F.lit(0).cast("bigint")
    found = let(grams(words), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(covered(g)))
    return F.when(F.size(words) < 4, none).otherwise(found)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), r"[\x09-\x0D\x20]+", " ")))


def text_lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(HAS_WORD))


def line_words(text: Column) -> Column:
    """Hash and number of words of each line with a word."""
    return F.transform(text_lines(text), lambda x: F.struct(line_hash(x).alias("line"), F.size(words_of(x)).alias("words")))


def base_measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    t = F.coalesce(text, F.lit(""))
    plain = F.length(F.translate(t, SYMBOLS, ""))
    dup = let(text_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(
        words_of(t),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.translate(t, WORD_BREAKS, "")).cast("bigint").alias("word_chars"),
            (F.length(t) - plain).cast("bigint").alias("n_symbols"),
            dup.cast("bigint").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def above_limits(rows: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """(h, above): for each host that has such lines, the hashes of those above the limits. ``rows``: (id, host, lines) with ``lines`` an array of hashes."""
    each = rows.select("id", "host", F.explode(F.array_distinct("lines")).alias("line")).distinct()
    hosts = rows.groupBy("host").agg(F.count_distinct(F.struct("id")).alias("host_docs"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > max_docs)
    lines = counts.withColumnRenamed("host", "h").join(hosts, F.col("h").eqNullSafe(F.col("host"))).filter(F.col("docs") > F.col("host_docs") * F.lit(max_share))
    found = cut(lines.groupBy("h").agg(F.collect_set("line").alias("above")))
    number = found.agg(F.sum(F.size("above"))).first()[0] or 0
    return F.broadcast(found) if number <= BROADCAST_LINES else found


def removed(lines: Column, above: Column) -> Column:
    """Words in lines above the limits, of an array of (line, words)."""
    gone = F.filter(lines, lambda x: F.array_contains(above, x["line"]))
    return F.when(F.size(above) > 0, F.aggregate(gone, F.lit(0).cast("bigint"), lambda a, x: a + x["words"])).otherwise(F.lit(0).cast("bigint"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def judge(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 20, max_share: float = 0.01, max_removed: int = 70, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, kept columns, the base measures, base_failed, removed_words, kept) of every document."""
    more = F.struct(*keep) if keep else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.col(key).alias("id"), F.col(host).alias("host"), more.alias("row"), base_measures(F.col(text)).alias("m"), line_words(F.col(text)).alias("lines"))
    rows = cut(rows)  # read twice
    above = above_limits(rows.select("id", "host", F.col("lines.line").alias("lines")), max_docs, max_share)
    rows = rows.join(above, F.col("host").eqNullSafe(F.col("h")), "left")
    gone = F.coalesce(removed(F.col("lines"), F.col("above")), F.lit(0).cast("bigint"))
    rows = rows.select(F.col("id").alias(key), *(F.col("row")[c].alias(c) for c in keep), "m.*", base_failed(F.col("m.n_words"), F.col("m.n_repeat_words")).alias("base_failed"), gone.alias("removed_words"))
    return rows.withColumn("kept", ~F.col("base_failed") & (100 * F.col("removed_words") <= max_removed * F.col("n_words")))


def cleaned(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 20, max_share: float = 0.01, max_removed: int = 70, size: str | None = "n_chars"
) -> DataFrame:
    """``docs`` without the rejected documents, and their texts without the lines above the limits; ``size`` is renewed where a text changes."""
    hashes = F.transform(text_lines(F.col(text)), line_hash)
    above = above_limits(docs.select(F.col(key).alias("id"), F.col(host).alias("host"), hashes.alias("lines")), max_docs, max_share)
    h, name, told = fresh(docs, "_host"), fresh(docs, "_above"), fresh(docs, "_told")
    rows = docs.join(above.withColumnsRenamed({"h": h, "above": name}), F.col(host).eqNullSafe(F.col(h)), "left")
    t, set_ = F.col(text), F.col(name)

    def verdict(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        gone = F.when(F.size(set_) > 0, removed(line_words(t), set_)).otherwise(F.lit(0).cast("bigint"))
        return F.when(n < 50, False).when(base_failed(n, repeated_words(w)), False).otherwise(100 * F.coalesce(gone, F.lit(0).cast("bigint")) <= max_removed * n)

    rows = rows.filter(let(words_of(t), verdict))
    found = F.when(F.size(set_) > 0, F.array_intersect(hashes, set_))
    stay = lambda gone: F.filter(F.split(t, "\n"), lambda x: ~(x.rlike(HAS_WORD) & F.array_contains(gone, line_hash(x))))
    rows = rows.withColumn(told, let(found, lambda gone: F.when(F.size(gone) > 0, F.array_join(stay(gone), "\n"))))
    new = {text: F.coalesce(F.col(told), t)}
    if size in docs.columns:
        new[size] = F.when(F.col(told).isNull(), F.col(size)).otherwise(F.length(told).cast(docs.schema[size].dataType))
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), l AS (
  SELECT rid, doc_id, source, unnest(string_split(t, chr(10))) AS raw FROM d
), ln AS (
  SELECT rid, doc_id, source, raw, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g')) AS line,
    len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT rid, count(*) - count(DISTINCT raw) AS n_dup_lines FROM ln GROUP BY rid
), p AS (
  SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid
), hosts AS (
  SELECT source, count(DISTINCT struct_pack(k := doc_id)) AS n FROM d GROUP BY source
), above AS (
  SELECT ln.source, line FROM ln JOIN hosts ON ln.source IS NOT DISTINCT FROM hosts.source
  GROUP BY ln.source, line, hosts.n HAVING count(DISTINCT struct_pack(k := doc_id)) > 20 AND count(DISTINCT struct_pack(k := doc_id)) > hosts.n * 0.01
), gone AS (
  SELECT rid, sum(ln.n) AS removed FROM ln JOIN above ON ln.source IS NOT DISTINCT FROM above.source AND ln.line = above.line GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND 100 * removed_words <= 70 * n_words AS kept FROM b
"""
