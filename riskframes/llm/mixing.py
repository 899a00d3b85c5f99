"""Mixing sources to target weights by repetition rates.

The sizes of all documents are summed by source. Targets share a total by weight; a source can't be asked for more than
``most`` times its size, and what it can't give is shared by weight among the others, until none is above. Its
rate is target / size; each document is taken floor(rate) times, and once more with a probability of the rest, by a hash of
its key and the seed. So a document is never taken more than ``most`` times, and reruns agree.

Inputs: a null text has size 0, a null source is a source of its own (last in order), repeated rows are drawn alike.
Sources whose size is 0 have target and rate 0; very long texts count whole. Extra columns are never read, whatever their names; ``repeated`` gives them back. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, words_of

#: Sources that may be sent to all executors; beyond, they are joined by salted keys.
BROADCAST_SOURCES = 100_000
SALTS = 64


def weight_cycle(rank: Column, cycle: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weights that repeat over the ranks 0, 1, 2, ..."""
    out = F.lit(cycle[-1])
    for k in range(len(cycle) - 1):
        out = F.when(rank % len(cycle) == k, cycle[k]).otherwise(out)
    return out


def targets(sources: DataFrame, most: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) with weight, target and rate.

    Sources by the level (most * size / weight) at which they are used up: with the first k used up, the others are at
    level (total - what the k give) / (their weights). The sources that are used up are those whose own level isn't above it.
    One row a source is all that is put in order here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", weight_cycle(F.row_number().over(by_name) - 1, cycle))
    full = (F.lit(most) * F.col("source_size")).cast("double")
    ranked = ranked.withColumn("full", full).withColumn("own_level", F.col("full") / F.col("weight"))
    order = Window.orderBy("own_level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumns(
        {
            "given": F.coalesce(F.sum("full").over(before), F.lit(0.0)),
            "gone": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "all_size": F.sum("source_size").over(whole),
            "all_weight": F.sum("weight").over(whole),
        }
    )
    ranked = ranked.withColumn("level", (F.col("all_size") - F.col("given")) / (F.col("all_weight") - F.col("gone")))
    ranked = ranked.withColumn("used_up", F.col("own_level") <= F.col("level"))
    level = F.min(F.when(~F.col("used_up"), F.struct("own_level", "level"))).over(whole)["level"]
    ranked = ranked.withColumn("target", F.when(F.col("used_up"), F.col("full")).otherwise(level * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return ranked.select("source", "source_size", "weight", "target", rate.alias("rate"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a hash of key and seed."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, source, size, source_size, target, copies) of every document; ``copies``: times it is taken."""
    sized = docs.select(F.col(key), *keep, F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("bigint").alias("size"))
    if not keep:
        sized = cut(sized)  # sizes are needed twice
    rates = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most, cycle))
    rates = rates.withColumnRenamed("source", "rate_source").drop("weight")
    if rates.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("rate_source")))
    else:  # a hot source is spread over all salts
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = sized.withColumn("doc_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        joined = sized.join(salted, F.col("source").eqNullSafe(F.col("rate_source")) & (F.col("doc_salt") == F.col("salt"))).drop("salt", "doc_salt")
    whole = F.floor("rate")
    copies = whole + F.when(draw(F.col(key), seed) < F.col("rate") - whole, 1).otherwise(0)
    return joined.select(key, *keep, "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    names = {k: options.pop(k, d) for k, d in (("key", "doc_id"), ("text", "text"), ("source", "source"))}
    rows = docs.select(*(F.col(c).alias(f"_{k}") for k, c in names.items()), F.struct(*(F.col(c) for c in docs.columns)).alias("_row"))
    taken = mix(rows, "_key", "_text", "_source", keep=("_row",), **options)
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return taken.filter("copies > 0").withColumn("_copy", copies).select("_row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), r AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER) AS weight FROM s
), f AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS fullsize, CAST(3 * source_size AS DOUBLE) / weight AS own_level FROM r
), g AS (
  SELECT *, coalesce(sum(fullsize) OVER (ORDER BY own_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    coalesce(sum(weight) OVER (ORDER BY own_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
    sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight FROM f
), h AS (
  SELECT *, (all_size - given) / (all_weight - gone) AS level FROM g
), lv AS (
  SELECT arg_min(level, own_level) AS level FROM h WHERE own_level > level
), t AS (
  SELECT source, source_size, CASE WHEN own_level <= h.level THEN fullsize ELSE lv.level * weight END AS target FROM h, lv
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
)
SELECT d.doc_id, d.size, q.source_size, q.target,
  CAST(d.size * (floor(rate) + CASE WHEN CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':7'), 1, 13)) AS BIGINT) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
