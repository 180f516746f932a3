"""Packing into optimal length buckets with token-budget batches.

A global histogram of lengths goes to the driver: one row a distinct length. It is bounded
by the corpus' size: n distinct lengths take n**2 / 2 words at least, so 10**12 words have
1.4 million of them at most. A dynamic program over it chooses at most ``buckets``
boundaries that minimise padding, exactly, in time linear in n. A bucket's
batches hold ``budget // boundary`` documents (one at least), so batch rows times the
padded length stay within the budget unless one document alone exceeds it.

A bucket may hold most of the corpus, so its documents are dealt by hash into parts of
about ``part_rows`` or, where they are long, ``part_tokens`` (16 batches at least),
numbered inside the part; only the last batch of a part can be short.

Defined cases: null text has length 0 and sits in the first bucket; repeated rows are
separate rows; an empty table gives an empty table; input columns named like the added
ones are replaced.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolith.llm.mixing import word_count
from chronolith.llm.shared import small_batches, spare, without

ADDED = ["n_tokens", "bucket", "bucket_length", "part", "batch", "row_in_batch", "batch_id"]


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper ends of at most ``buckets`` length ranges with the least total padding.

    lengths ascend. best[i] is the least padded total of the first i lengths; adding a
    bucket that ends at i costs lengths[i] times the documents since m, so the best m
    minimises best[m] - lengths[i] * before[m]: lines of falling slope asked at rising
    points, kept as a lower hull.
    """
    n = len(lengths)
    if not n:
        return []
    before = [0]
    for c in counts:
        before.append(before[-1] + c)
    best = [0] + [lengths[i] * before[i + 1] for i in range(n)]
    came = [array("q", bytes(8 * (n + 1)))]
    for _ in range(min(buckets, n) - 1):
        hull: list[int] = []
        at, now, back = 0, [0] * (n + 1), array("q", bytes(8 * (n + 1)))
        for i in range(1, n + 1):
            m = i - 1
            while len(hull) >= 2:
                a, b = hull[-2], hull[-1]
                if (best[m] - best[a]) * (before[b] - before[a]) <= (best[b] - best[a]) * (before[m] - before[a]):
                    hull.pop()
                else:
                    break
            hull.append(m)
            at = min(at, len(hull) - 1)
            x = lengths[i - 1]
            cost = lambda j: best[j] - x * before[j]  # noqa: B023, E731
            while at + 1 < len(hull) and cost(hull[at + 1]) <= cost(hull[at]):
                at += 1
            back[i] = hull[at]
            now[i] = cost(hull[at]) + x * before[i]
        came.append(back)
        best = now
    ends, i = [], n
    for back in reversed(came):
        if i == 0:
            break
        ends.append(lengths[i - 1])
        i = back[i]
    return ends[::-1]


def histogram(lengths: DataFrame) -> tuple[list[int], list[int]]:
    """(distinct lengths, documents of each) of column n_tokens."""
    rows = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toArrow()
    return rows.column("n_tokens").to_pylist(), rows.column("n").to_pylist()


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 16_384, part_rows: int = 8_192, part_tokens: int = 2_000_000) -> DataFrame:
    """``docs`` with n_tokens, bucket, bucket_length, part, batch, row_in_batch and batch_id."""
    small_batches(docs.sparkSession)
    sized = without(docs, ADDED).withColumn("n_tokens", (word_count() if length is None else length).cast("long"))
    lengths, counts = histogram(sized.select("n_tokens"))
    ends = boundaries(lengths, counts, buckets) or [0]
    room = [max(1, budget // max(1, e)) for e in ends]
    held = [0] * len(ends)
    for x, c in zip(lengths, counts):
        held[bisect_left(ends, x)] += c
    rows = [max(16 * r, min(part_rows, part_tokens // max(1, e))) for e, r in zip(ends, room)]
    parts = [max(1, h // n) for h, n in zip(held, rows)]
    number = F.size(F.filter(F.array(*[F.lit(e) for e in ends[:-1]]), lambda e: e < F.col("n_tokens"))) if len(ends) > 1 else F.lit(0)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1)
    key = F.xxhash64(*[f"`{c}`" for c in sized.columns if c in ("doc_id", "text")] or ["n_tokens"])
    hashed, number_in_part = spare(sized, "key", "row")
    dealt = sized.withColumn(hashed, key).withColumn("bucket", number.cast("int")).withColumn("bucket_length", pick(ends).cast("long"))
    dealt = dealt.withColumn("part", F.pmod(hashed, pick(parts)).cast("int"))
    row = F.row_number().over(Window.partitionBy("bucket", "part").orderBy(hashed)) - 1
    return (
        dealt.withColumn(number_in_part, row).withColumn("batch", F.floor(F.col(number_in_part) / pick(room)).cast("long")).withColumn("row_in_batch", (F.col(number_in_part) % pick(room)).cast("int"))
        .withColumn("batch_id", F.concat_ws("-", "bucket", "part", "batch")).drop(number_in_part, hashed)
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs.select("doc_id", word_count().alias("_n")), length=F.col("_n")).drop("_n")
