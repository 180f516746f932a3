"""Near-duplicate groups by min-max hashing.

A document's set holds the 64-bit hashes of its distinct n-word shingles; two shingles of
one text that share a hash, one chance in 10**10 for a text of 60,000, count as one.
Documents link when their sets' Jaccard similarity is at least ``percent`` / 100.

1. Under each of ``permutations`` hash functions both the minimum and the maximum of a set
   are kept: two signature values for one evaluation, each equal in two sets with the
   probability of their similarity. The minimum and the maximum of a function go to
   different bands, so the values in a band are independent; matches of the two are
   negatively correlated, so all bands miss a pair less often than with separate functions.
   With 120 functions, 5 values a band and 48 bands a pair of similarity 0.8 is missed once
   in 1.9 * 10**8, one of 0.9 never in practice; a pair of 0.3 is a candidate once in 9.
2. Documents with equal sets form a class and are never paired. Classes that share a band
   key are a list. A short list gives all its pairs; of a long list only the most
   central class, whose other lists are the longest, is paired with the others.
3. Candidates are verified on their full sets, which are made again from the texts of these
   classes alone, as the sets of all documents would be larger than the texts. Links make components. What a long list
   still holds across components is tested block against block (``ngram_join.tail_links``),
   so no candidate is left out: the star and the blocks only save tests whose answer could change nothing.

Defined cases: null, empty and blank texts have the empty set and link with nothing; texts
under n words have one shingle, the whole sequence; a null doc_id never names a component
unless all its documents lack one; kept holds where doc_id is the component's name, null
for null; rows that share a doc_id are documents of their own; an empty table gives
an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.components import components
from chronolith.llm.ngram_join import ORACLE_SQL as NGRAM_SQL
from chronolith.llm.ngram_join import SHORT_LIST, labelled, name, shingles, tail_links
from chronolith.llm.shared import kept, small_batches, spare, texts

#: Shingles whose hashes under all functions are held at once.
CHUNK = 1_024
#: Names of sets that a task holds, to sign a copy once.
HELD_NAMES = 200_000


class MinMax:
    """Seeded hash functions, signatures and their band keys."""

    def __init__(self, permutations: int = 120, band: int = 5, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mask = rng.integers(0, 1 << 64, (permutations, 1), np.uint64)
        self.odd = rng.integers(0, 1 << 64, (permutations, 1), np.uint64) | np.uint64(1)
        self.band = band
        order = rng.permutation(permutations)  # bands of minima, then of maxima, over one order
        self.bands = np.concatenate([order, order + permutations])[: 2 * permutations // band * band].reshape(-1, band)
        self.salt = rng.integers(0, 1 << 64, len(self.bands), np.uint64)

    def signature(self, tokens: np.ndarray) -> np.ndarray:
        """The minima under all functions, then the maxima."""
        low, high = np.full(len(self.odd), ~np.uint64(0)), np.zeros(len(self.odd), np.uint64)
        for start in range(0, len(tokens), CHUNK):
            hashed = (tokens[None, start : start + CHUNK] ^ self.mask) * self.odd
            np.minimum(low, hashed.min(axis=1), out=low)
            np.maximum(high, hashed.max(axis=1), out=high)
        return np.concatenate([low, high])

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit key a band."""
        out = self.salt.copy()
        for values in signature[self.bands].T:
            out = (out ^ (out >> np.uint64(29)) ^ values) * np.uint64(0x9E3779B97F4A7C15)
        return (out ^ (out >> np.uint64(32))).view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64())), ("mark", pa.int64())])


def _signed(batches: Iterator[pa.RecordBatch], n: int, how: dict) -> Iterator[pa.RecordBatch]:
    """A row a document; band keys with the first of its copies in the task."""
    hasher, seen = MinMax(**how), set()
    for batch in batches:
        sizes, names, bands = [], [], []
        for text in texts(batch):
            own = shingles(text, n)
            called = name(own)
            fresh = len(own) > 0 and called not in seen
            if fresh:
                if len(seen) >= HELD_NAMES:
                    seen.clear()  # a copy is then signed again and meets its class later
                seen.add(called)
            sizes.append(len(own))
            names.append(called)
            bands.append(hasher.keys(hasher.signature(own)) if fresh else None)
        hi_lo = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hi_lo[:, 0]), pa.array(hi_lo[:, 1]), pa.array(bands, pa.list_(pa.int64())), batch.column(2)], schema=_SIGNED)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(cls, size, tokens) of rows (cls, hi, lo, text) that hold their class's set; a row that comes again at once is passed over."""
    last = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["cls"] == last:
                continue
            own = shingles(row["text"], n)
            if name(own) == np.array([row["hi"], row["lo"]], np.int64).tobytes():  # two rows may share a mark, hardly ever
                out.append((row["cls"], len(own), own.tobytes()))
                last = row["cls"]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["cls", "size", "tokens"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in "ab")
        sets = [[np.frombuffer(x, np.uint64) for x in batch.column(batch.schema.get_field_index(f"{c}_tokens")).to_pylist()] for c in "ab"]
        link = []
        for x, y in zip(*sets):
            overlap = np.intersect1d(x, y, assume_unique=True).size
            link.append(100 * overlap >= percent * (len(x) + len(y) - overlap))
        if any(link):
            pairs = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            yield pairs.filter(pa.array(link))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) among pairs (a, b), by the full sets (cls, size, tokens)."""
    side = lambda s: sets.select(F.col("cls").alias(s), F.col("tokens").alias(f"{s}_tokens"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda it: _verified(it, percent), "u long, v long")


def candidates(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes to test first, from lists (token, cls, size, m, leader, leader_size): whole short lists, stars of long ones."""
    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    star = lists.where((F.col("m") > SHORT_LIST) & (F.col("cls") != F.col("leader")) & near(F.col("size"), F.col("leader_size"))).select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b"))
    short = lists.where(F.col("m") <= SHORT_LIST)
    left, right = (short.select("token", F.col("cls").alias(c), F.col("size").alias(f"{c}_size")) for c in "ab")
    square = left.join(right, "token").where((F.col("a") < F.col("b")) & near(F.col("a_size"), F.col("b_size"))).select("a", "b")
    return star.union(square).distinct()


def label(spark: SparkSession, docs: DataFrame, n: int = 4, percent: int = 80, permutations: int = 120, band: int = 5, seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    small_batches(spark)
    how = {"permutations": permutations, "band": band, "seed": seed}
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    docs = docs.withColumn("mark", F.xxhash64("doc_id", "text"))  # finds a row again
    made = docs.mapInArrow(lambda it: _signed(it, n, how), "doc_id long, n_shingles long, hi long, lo long, bands array<long>, mark long")
    made, _ = kept(spark, made.withColumn("row", F.monotonically_increasing_id()), "minmax-signed")
    signed = made.select("doc_id", "n_shingles", "hi", "lo")
    first = F.min(F.when(F.col("fresh"), F.struct("row", "mark")))
    classes = made.where("n_shingles > 0").select("doc_id", "n_shingles", "hi", "lo", "row", "mark", F.col("bands").isNotNull().alias("fresh")).groupBy("hi", "lo").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("size"), first.alias("first"))
    classes, _ = kept(spark, classes.select("hi", "lo", "first_id", "size", F.col("first.row").alias("cls"), F.col("first.mark").alias("mark")), "minmax-classes")

    fresh = made.where("bands IS NOT NULL").select(F.col("row").alias("cls"), "bands").join(classes.select("cls"), "cls", "left_semi")
    keys = fresh.select("cls", F.explode("bands").alias("token"))
    counts, _ = kept(spark, keys.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "minmax-counts")
    met = keys.join(counts, "token")
    shared, _ = kept(spark, met.join(classes.select("cls", "size"), "cls"), "minmax-shared")
    central, _ = kept(spark, shared.groupBy("cls").agg(F.sum(F.log2("m")).alias("central")), "minmax-central")
    heads = shared.join(central, "cls").groupBy("token").agg(F.max(F.struct("central", "cls", "size")).alias("top"))
    heads, _ = kept(spark, heads.select("token", F.col("top.cls").alias("leader"), F.col("top.size").alias("leader_size")), "minmax-heads")
    lists, _ = kept(spark, shared.join(heads, "token"), "minmax-lists")
    wanted = classes.join(central.select("cls"), "cls", "left_semi").select("cls", "hi", "lo", "mark")
    sets = docs.join(wanted, "mark").select("cls", "hi", "lo", "text").mapInArrow(lambda it: _sets(it, n), "cls long, size long, tokens binary")
    sets, _ = kept(spark, sets, "minmax-sets")

    pairs, _ = kept(spark, candidates(lists, percent), "minmax-pairs")
    links, _ = kept(spark, verify(pairs, sets, percent), "minmax-links")
    roots = components(spark, links)
    more, _ = kept(spark, tail_links(lists.where(F.col("m") > SHORT_LIST).drop("leader_size"), roots, sets, percent), "minmax-tail")
    if not more.isEmpty():
        roots = components(spark, roots.select(F.col("cls").alias("u"), F.col("root").alias("v")).union(more))
    out = labelled(signed, classes, roots)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id.

    Of rows that share this doc_id all stay; rows without doc_id stay.
    """
    (other,) = spare(docs, "gone")
    gone = label(spark, docs, **how).where(~F.col("kept")).select(F.col("doc_id").alias(other)).distinct()
    gone, _ = kept(spark, gone, "minmax-gone")
    return docs.join(gone, docs["doc_id"] == gone[other], "left_anti")


def op11_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same rule over shingles of four words, and whether a document names its group.
ORACLE_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({NGRAM_SQL.replace('list_slice(w, i, i + 4)', 'list_slice(w, i, i + 3)').replace('greatest(len(w) - 4,', 'greatest(len(w) - 3,')})"
