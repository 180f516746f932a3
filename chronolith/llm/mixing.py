"""Mixing sources to target weights, with DataFrame operations only.

Sources in code point order (null last) weigh ``weights``, repeating, and share
``share`` of all words. A target stops at ``cap`` times its source's size and the excess
goes to the others by weight until none is above: the fixed point is
``least(cap * size, level * weight)`` with one level for all. With sources ordered by
cap * size / weight, ``level`` is the largest of (budget - caps before k) / (weights from k
on), so windows over the one-row-a-source table find it.

A document comes out floor(rate) times, rate being target over size of its source, and
once more if a coin seeded by the hash of (seed, doc_id, text) falls below the fraction.

Defined cases: null text has no words; documents without words keep their rate; a null
source is a source of its own; repeated rows toss the same coin; a source without words
has target 0 and copies 0; an empty table gives an empty table; input columns named like
the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolith.llm.shared import WORD, kept, small_batches, spare, without

#: Sources up to which the rates are broadcast: about 100 bytes each.
BROADCAST_SOURCES = 20_000
#: Parts that a source's documents are dealt into beyond that.
SALTS = 32

ADDED = ["size", "source_size", "target", "rate", "copies"]


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    filled = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(share) * F.sum("source_size").over(every)
    per = per.withColumn("level_here", (budget - before) / onward).withColumn("level", F.max("level_here").over(every))
    per = per.withColumn("target", F.least("most", F.col("level") * F.col("weight")))
    return per.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def coin(seed: int) -> Column:
    """A number in [0, 1) from the md5 of seed, doc_id and text."""
    of = F.concat_ws("\x1f", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text"))
    return F.conv(F.substring(F.md5(of), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def plan_mix(spark: SparkSession, docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies."""
    small_batches(spark)
    sized = without(docs, ADDED).withColumn("size", word_count())
    rates, _ = kept(spark, source_rates(sized.select("source", "size"), weights, share, cap), "mix-rates")
    n = rates.count()
    named, none, salt = spare(sized, "source", "none", "salt")
    key = [F.coalesce("source", F.lit("")).alias(named), F.col("source").isNull().alias(none)]
    rates, on = rates.select(*key, "source_size", "target", "rate"), [named, none]
    sized = sized.select("*", *key)
    if n <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    else:
        rates = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized, on = sized.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), [*on, salt]
    out = sized.join(rates, on, "left").drop(*on)
    whole = F.floor("rate")
    return out.withColumn("copies", (whole + (coin(seed) < F.col("rate") - whole).cast("long")).cast("long"))


def mix(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The mixture: each document as often as its copies say, with the columns of ``docs``."""
    planned = plan_mix(spark, docs, **how)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(*spare(planned, "copy"))
    return planned.where(F.col("copies") > 0).select("*", each).select(*[f"`{c}`" for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan_mix(spark, docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS most FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_here
  FROM weighed
), rates AS (
  SELECT source, source_size, least(most, max(level_here) OVER () * weight) AS target FROM levels
), joined AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5(concat_ws(chr(31), '17', CAST(s.doc_id AS VARCHAR), s.text)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM joined
"""
