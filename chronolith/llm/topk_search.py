"""Exact top-k search by inner product over an impact-ordered index.

Components become integers, floor(``scale`` * x). Vectors are dealt by hash of vec_id into
shards of about ``shard_rows``. For each dimension a shard keeps its postings ordered by
the component's level (value // ``STEP``), one segment a level, and the vectors themselves.

A query goes score at a time: over all dimensions, the segments with the greatest quantised
impact (query component times the level's best value) come first, in bands of falling
impact. After a band, a vector's score is at most its sum so far plus the current impact
for each dimension not met yet. The exact scores of the leaders so far give a floor. The
walk stops when the vectors whose bound reaches the floor are few, or when all segments
are done; those vectors, ties included, are rescored exactly.

Queries are written in blocks of ``block_queries``. There are as many tasks as shards, whatever
the queries' number: a task loads its shard once and reads the blocks one after another, so
neither side is broadcast or joined. A shard answers with k rows a query, and a window with
a pre-limit on each task picks the best of all shards.

Defined cases: a vector that is null, holds a null or non-finite component, or has no
vec_id takes no part; only vectors of the query's length are candidates; rows with the
query's vec_id are its own and no candidates; repeated rows of other ids are candidates
each; a repeated query row is asked once; an empty table gives an empty table. Vectors with
a component so large that sums could leave 64 bits (from 2**24 on with up to 63 dimensions,
2**20 with up to 1023) are *wide*: they lie in shards of their own without postings, and
whatever involves one is scored with unbounded whole numbers. A score beyond a long shows as
the nearest long; its rank is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolith.llm.shared import kept, open_store

#: Values in a level of quantised impact.
STEP = 16
#: Impacts, as parts of the greatest, at which a band ends.
BANDS = (0.3, 0.1, 0.02, -0.05, -0.2)
#: Vectors left that a walk may stop with: this many times k, or this part of the shard.
FEW_K, FEW_PART = 8, 1 / 4


def narrow_limit(dims: int) -> int:
    """Components below this leave room for all sums of the walk in 64 bits."""
    return (1 << (62 - 2 * max(1, dims).bit_length()) // 2) - STEP


def integers(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """(vec_id, dims, wide, values) of the vectors that take part; values are packed 32-bit integers, or whole doubles if wide."""
    for batch in batches:
        ids, dims, wides, values = [], [], [], []
        for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if vec_id is None or x is None or any(c is None for c in x):
                continue
            x = np.array(x, np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                v = np.floor(scale * x)
            if not np.isfinite(v).all():
                v = np.nan_to_num(v)  # scale * x leaves the doubles: the greatest of them, as x is finite
            wide = bool(len(v) and np.abs(v).max() >= narrow_limit(len(v)))
            ids.append(vec_id)
            dims.append(len(v))
            wides.append(wide)
            values.append(v.astype(np.float64 if wide else np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(wides, pa.bool_()), pa.array(values, pa.binary())], names=["vec_id", "dims", "wide", "values"])


def wide_top(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """``Shard.top`` with unbounded whole numbers, and the whole scores."""
    q = [int(x) for x in query]
    scored = sorted((-sum(a * int(b) for a, b in zip(q, row) if a), i) for i, row in zip(ids.tolist(), vectors.tolist()) if i != query_id)[:k]
    return np.array([i for _, i in scored], np.int64), np.array([max(-(1 << 63), min((1 << 63) - 1, -s)) for s, _ in scored], np.int64), [-s for s, _ in scored]


class Shard:
    """The postings of a set of vectors by dimension and level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.held = ids, vectors, {}
        level = vectors // STEP
        self.docs = [np.argsort(level[:, d], kind="stable") for d in range(vectors.shape[1])]
        self.levels = [level[self.docs[d], d] for d in range(vectors.shape[1])]

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.vectors[rows].astype(np.int64) @ query

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the k best, by falling score and rising vec_id."""
        n, others = len(self.ids), self.ids != query_id
        used = np.flatnonzero(query)
        query = query.astype(np.int64)
        if len(used) and n > FEW_K * k:
            rows = self._possible(query, used, others, k)
        else:
            rows = np.flatnonzero(others)
        score = self.exact(rows, query)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]

    def segments(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(levels of dimension d, ascending, and where their postings begin), found once."""
        if d not in self.held:
            self.held[d] = np.unique(self.levels[d], return_index=True)
        return self.held[d]

    def _possible(self, query: np.ndarray, used: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
        n = len(self.ids)
        bits = len(used).bit_length()  # the low bits of a sum count the dimensions in it
        found = []
        for d in used.tolist():
            levels, begins = self.segments(d)
            q = int(query[d])
            found.append((d, q, q * (levels.astype(np.int64) * STEP + (STEP - 1 if q > 0 else 0)), np.r_[begins, n]))
        most = max(int(impact.max()) for _, _, impact, _ in found)
        limits = [int(most * part) for part in BANDS] + [-(1 << 62)]
        walks = []  # a dimension's postings, their gains, where each band ends and the impact behind it
        for d, q, impact, begins in found:
            falling = -impact[::-1] if q > 0 else -impact
            taken = np.searchsorted(falling, [-x for x in limits], "right")  # segments with at least the limit's impact
            ends = begins[len(impact) - taken] if q > 0 else begins[taken]
            behind = [int(-falling[t]) if t < len(falling) else None for t in taken.tolist()]
            walks.append((self.docs[d], np.repeat((impact << bits) + 1, np.diff(begins)), q > 0, ends.tolist(), behind))
        sums, floor = np.zeros(n, np.int64), None
        for band in range(len(limits)):
            rest = None
            for docs, gain, high, ends, behind in walks:
                start = ends[band - 1] if band else n if high else 0
                at = slice(ends[band], start) if high else slice(start, ends[band])
                if at.start < at.stop:
                    sums[docs[at]] += gain[at]
                if behind[band] is not None and (rest is None or behind[band] > rest):
                    rest = behind[band]
            bound = sums >> bits
            if rest is not None:
                bound += (len(used) - (sums & ((1 << bits) - 1))) * rest
            bound[~others] = -(1 << 62)
            lead = np.argpartition(bound, n - 2 * k)[n - 2 * k :]
            scores = np.sort(self.exact(lead[others[lead]], query))
            if len(scores) >= k and (floor is None or scores[-k] > floor):
                floor = int(scores[-k])
            if floor is not None:
                rows = np.flatnonzero(bound >= floor)
                if len(rows) <= max(FEW_K * k, int(n * FEW_PART)) or rest is None:
                    return rows[others[rows]]
        return np.flatnonzero(others)


def _numbers(raw: bytes, wide: bool, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64 if wide else np.int32).reshape(rows, -1) if rows else np.zeros((0, 0), np.int32)


def _built(table: pa.Table) -> pa.Table:
    ids, wide = np.array(table.column("vec_id").to_pylist(), np.int64), table.column("wide")[0].as_py()
    order = np.argsort(ids, kind="stable")
    vectors = _numbers(b"".join(table.column("values").to_pylist()), wide, len(ids))[order]
    shard = None if wide else Shard(ids[order], vectors)
    pack = lambda rows: pa.array([np.concatenate(rows).astype(np.int32).tobytes() if rows else b""], pa.binary())
    first = lambda c: table.column(c).slice(0, 1).combine_chunks()
    return pa.table([first("shard"), first("dims"), first("wide"), pa.array([ids[order].tobytes()]), pa.array([vectors.tobytes()]), pack(shard.docs if shard else []), pack(shard.levels if shard else [])], names=["shard", "dims", "wide", "ids", "vectors", "docs", "levels"])


def _loaded(row: dict) -> Shard:
    shard = Shard.__new__(Shard)
    shard.held = {}
    shard.ids = np.frombuffer(row["ids"], np.int64)
    n, dims = len(shard.ids), row["dims"]
    shard.vectors = _numbers(row["vectors"], row["wide"], n)
    shard.docs, shard.levels = ([], []) if row["wide"] else (np.frombuffer(row[c], np.int32).reshape(dims, n) for c in ("docs", "levels"))
    return shard


def _blocked(table: pa.Table) -> pa.Table:
    pack = lambda c: b"".join(table.column(c).to_pylist())
    first = lambda c: table.column(c).slice(0, 1).combine_chunks()
    return pa.table([first("block"), first("dims"), first("wide_query"), pa.array([np.array(table.column("vec_id").to_pylist(), np.int64).tobytes()]), pa.array([pack("values")])], names=["block", "dims", "wide_query", "query_ids", "queries"])


_ANSWER = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("tier", pa.int32()), ("exact", pa.string())])


def _read_blocks(path: str, dims: int) -> Iterator[tuple[bool, np.ndarray, bytes]]:
    """The blocks of queries of one length, read from the shared folder one at a time."""
    store, at = open_store(path)
    for file in sorted(f.path for f in store.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet")):
        with store.open_input_file(file) as source:
            for batch in pq.ParquetFile(source).iter_batches(1):
                for row in batch.to_pylist():
                    if row["dims"] == dims:
                        yield row["wide_query"], np.frombuffer(row["query_ids"], np.int64), row["queries"]


def _answered(batches: Iterator[pa.RecordBatch], k: int, blocks: str) -> Iterator[pa.RecordBatch]:
    """The k best of each shard, loaded once, for each query. Where a score leaves 64 bits, tier is its sign and ``exact`` holds its digits in an order that texts keep."""
    for row in (r for batch in batches for r in batch.to_pylist()):
        shard = _loaded(row)
        for wide_query, ids, packed in _read_blocks(blocks, row["dims"]):
            queries, wide = _numbers(packed, wide_query, len(ids)), row["wide"] or wide_query
            out = []
            for query_id, query in zip(ids.tolist(), queries):
                key = xxhash.xxh3_64_intdigest(query.astype(np.float64).tobytes()) - (1 << 63)  # two rows of one id may differ
                if wide:
                    best, score, whole = wide_top(shard.ids, shard.vectors, query_id, query, k)
                else:
                    best, score = shard.top(query_id, query, k)
                    whole = score.tolist()
                out += [(query_id, key, i, s, 0 if s == w else 1 if w > 0 else -1, sortable(w)) for i, s, w in zip(best.tolist(), score.tolist(), whole)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ANSWER)], schema=_ANSWER)


def sortable(number: int) -> str | None:
    """A text that sorts as its number among those that leave 64 bits; None for the others."""
    if -(1 << 63) <= number < 1 << 63:
        return None
    digits = str(abs(number))
    text = f"{len(digits):05d}{digits}"
    return "+" + text if number > 0 else "-" + text.translate(str.maketrans("0123456789", "9876543210"))


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, shard_rows: int = 8_192, block_queries: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` (vec_id, embedding) for each row of ``queries`` (same columns; others are not read).

    There are as many tasks as shards, up to 10,000.
    """
    made = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(lambda it: integers(it, scale), "vec_id long, dims int, wide boolean, values binary")
    rows, _ = kept(spark, made(vectors), "topk-vectors")
    asked, _ = kept(spark, made(queries).distinct(), "topk-queries")
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // block_queries))
    spread = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "values"), F.lit(shards)))
    index = dealt.groupBy("dims", "wide", "shard").applyInArrow(_built, "shard long, dims int, wide boolean, ids binary, vectors binary, docs binary, levels binary")
    index, _ = kept(spark, index, "topk-index")
    block = asked.withColumn("block", spread(asked, blocks)).withColumnRenamed("wide", "wide_query").groupBy("dims", "wide_query", "block").applyInArrow(_blocked, "block long, dims int, wide_query boolean, query_ids binary, queries binary")
    _, at = kept(spark, block, "topk-blocks")
    dealt = index.repartitionByRange(min(10_000, shards), "shard", "dims", "wide")
    answers = dealt.mapInArrow(lambda it: _answered(it, k, at), "query_id long, query_key long, vec_id long, score long, tier int, exact string")
    best = (F.col("tier").desc(), F.col("exact").desc_nulls_last(), F.col("score").desc(), F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(*best))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(spark, vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""
