"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at
least ``min_chars`` code points in at least ``min_docs`` documents are *repeated*: they
lose all their lines except in the largest doc_id that holds them.

1. One pass counts, for each 128-bit key hash, its documents and its largest doc_id;
   (hash, doc_id) pairs are made distinct first, so a line that a third of the corpus
   holds is spread by document and only partial counts meet.
2. Repeated keys are dealt by hash into shards of about ``shard_keys``. Each shard
   becomes a perfect hash over a mix of both hash halves, indexing arrays of fingerprints
   (one half), document counts and keepers; should two keys of a shard mix to one number,
   the shard takes another seed. Keys below ``min_docs`` can lose no line, so they are left
   out, and the fingerprint turns them away.
3. Documents are read again and their lines probe the shards. An index of at most
   ``INLINE_SHARDS`` is small by that bound: each task reads it from the shared folder as
   its documents ask for it. Of a larger one only the ``shard_keys`` keys of most documents
   are read so, and their lines go first: a line that a third of the corpus holds is never
   sent anywhere. The rest stays where it is: tasks send packed hashes of their lines to
   the shards, a shard streams them past its arrays, and only the places of lines that go
   come back to the documents. No text line is joined either way, and both ways give the
   same rows (held by a test).

Defined cases: null text is one empty line and stays null; a null doc_id counts as one
document and is never the keeper; rows that share a doc_id count as one document, and all
of them keep the line if theirs is the keeper; an empty table gives an empty table; input
columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.llm import perfect_hash
from chronolith.llm.shared import SPACE, kept, open_store, replaced, small_batches, spare, texts, widened, without

#: Shards that a task holds in memory at once, about 5 MB each; larger indexes are probed where they are.
INLINE_SHARDS = 16
INDEX_SCHEMA = "shard int, n_keys int, seed long, level_sizes binary, bits binary, fingerprints binary, counts binary, keepers binary"


def _keys(lines: list[str], min_chars: int) -> tuple[list[int], bytes]:
    """Positions and hashes (16 bytes each) of the lines whose keys are long enough."""
    at, out = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(SPACE)
            if len(key) >= min_chars:
                at.append(i)
                out.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))  # bytes.lower() touches A-Z only
    return at, b"".join(out)


def _hashed(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hi, lo, of = batch.column(0), [], [], []
        for row, text in enumerate(texts(batch)):
            if text:
                _, got = _keys(text.split("\n"), min_chars)
                if got:
                    pair = np.unique(np.frombuffer(got, "V16")).view(np.int64).reshape(-1, 2) if len(got) > 16 else np.frombuffer(got, np.int64).reshape(-1, 2)
                    hi.append(pair[:, 0])
                    lo.append(pair[:, 1])
                    of.append(np.full(len(pair), row))
        if hi:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hi)), pa.array(np.concatenate(lo)), ids.take(pa.array(np.concatenate(of)))], names=["hi", "lo", "doc_id"])


def line_counts(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(hi, lo, n_docs, keeper) for each distinct key hash."""
    pairs = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _hashed(it, min_chars), "hi long, lo long, doc_id long")
    return pairs.distinct().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """One number for each (hi, lo)."""
    with np.errstate(over="ignore"):
        x = hashes[:, 0].view(np.uint64) ^ (hashes[:, 1].view(np.uint64) + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def _shard(pdf):
    import pandas as pd

    pdf = pdf.sort_values(["hi", "lo"])  # reruns give the same bytes
    hashes, seed = pdf[["hi", "lo"]].to_numpy(np.int64), 0
    keys = _mixed(np.ascontiguousarray(hashes), seed)
    while len(np.unique(keys)) < len(keys):
        seed += 1
        keys = _mixed(np.ascontiguousarray(hashes), seed)
    sizes, bits, slot = perfect_hash.build(keys)
    back = np.empty(len(slot), np.int64)
    back[slot] = np.arange(len(slot))
    return pd.DataFrame([{
        "shard": int(pdf["shard"].iloc[0]), "n_keys": len(slot), "seed": seed, "level_sizes": sizes.tobytes(), "bits": bits.tobytes(), "fingerprints": hashes[back, 1].tobytes(),
        "counts": np.minimum(pdf["n_docs"].to_numpy()[back], 2**32 - 1).astype(np.uint32).tobytes(), "keepers": pdf["keeper"].to_numpy()[back].astype(np.int64).tobytes(),
    }])


def _write_index(spark: SparkSession, repeated: DataFrame, shards: int) -> str:
    index = repeated.withColumn("shard", F.expr(f"cast(pmod(hi, {shards}) as int)")).groupBy("shard").applyInPandas(_shard, INDEX_SCHEMA)
    return kept(spark, index, "line-index", by="shard")[1]


def build_index(spark: SparkSession, docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 1 << 17) -> tuple[str, int, str | None]:
    """Writes the index of repeated lines to the shared folder; (path, number of shards, path of a one-shard index of the most frequent keys beside a large one)."""
    repeated, _ = kept(spark, line_counts(docs, min_chars).where(F.col("n_docs") >= min_docs), "line-counts")
    shards = max(1, -(-repeated.count() // shard_keys))
    path = _write_index(spark, repeated, shards)
    if shards <= INLINE_SHARDS:
        return path, shards, None
    often = repeated.orderBy(F.col("n_docs").desc(), "hi", "lo").limit(shard_keys)
    return path, shards, _write_index(spark, often, 1)


def _arrays(row: dict) -> tuple:
    """(slots, fingerprints, document counts, keepers, seed) of a shard."""
    return perfect_hash.Slots(np.frombuffer(row["level_sizes"], np.int64), np.frombuffer(row["bits"], np.uint8)), np.frombuffer(row["fingerprints"], np.int64), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["keepers"], np.int64), row["seed"]


def _look_up(arrays: tuple, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the hashes that are repeated keys, their document counts, their keepers)."""
    slots, prints, counts, keepers, seed = arrays
    at = slots(_mixed(hashes, seed))
    rows = np.flatnonzero(at >= 0)
    rows = rows[prints[at[rows]] == hashes[rows, 1]]
    return rows, counts[at[rows]].astype(np.int64), keepers[at[rows]]


class Index:
    """Shards of the index, read as they are needed; at most ``room`` stay in memory."""

    def __init__(self, path: str, shards: int, room: int = INLINE_SHARDS):
        self.fs, self.path = open_store(path)
        self.shards, self.room, self.held = shards, room, OrderedDict()

    def _read(self, shard: int):
        if shard in self.held:
            self.held.move_to_end(shard)
            return self.held[shard]
        found = [f for f in self.fs.get_file_info(pafs.FileSelector(f"{self.path}/shard={shard}", allow_not_found=True)) if f.path.endswith(".parquet")]
        got = None
        if found:
            row = pq.ParquetFile(self.fs.open_input_file(found[0].path)).read().to_pylist()[0]
            got = _arrays(row)
        self.held[shard] = got
        while len(self.held) > self.room:
            self.held.popitem(last=False)
        return got

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold the key, 0 if it is not repeated; keeper) for (hi, lo) rows."""
        counts, keepers = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        shard = hashes[:, 0] % self.shards
        order = np.argsort(shard, kind="stable")
        for s, rows in zip(*_runs(shard[order], order)):
            if (got := self._read(int(s))) is not None:
                hit, n, keep = _look_up(got, hashes[rows])
                counts[rows[hit]], keepers[rows[hit]] = n, keep
        return counts, keepers


def _runs(sorted_keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys and, for each, its rows."""
    if not len(sorted_keys):
        return sorted_keys, []
    cut = np.flatnonzero(np.diff(sorted_keys)) + 1
    return sorted_keys[np.r_[0, cut]], np.split(order, cut)


def _cleaned(batches: Iterator[pa.RecordBatch], path: str, shards: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    index = Index(path, shards)
    for batch in batches:
        ids, was = batch.column(batch.schema.names.index("doc_id")).to_pylist(), texts(batch)
        lines = [(t or "").split("\n") for t in was]
        found = [_keys(x, min_chars) for x in lines]
        hashes = np.frombuffer(b"".join(h for _, h in found), np.int64).reshape(-1, 2)
        counts, keepers = index.probe(hashes)
        dropped, start = [0] * len(was), 0
        for row, (at, _) in enumerate(found):
            end = start + len(at)
            if at and counts[start:end].any():
                own = ids[row]
                gone = {i for i, n, k in zip(at, counts[start:end].tolist(), keepers[start:end].tolist()) if n and k != own}
                if gone:
                    was[row] = "\n".join(x for i, x in enumerate(lines[row]) if i not in gone)
                    dropped[row] = len(gone)
            start = end
        kind = batch.schema.field("text").type
        yield replaced(batch, {"text": pa.array(was, kind), "n_lines": pa.array([len(x) for x in lines], pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})


def _asked(batches: Iterator[pa.RecordBatch], shards: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Packed probes: a row for each batch and shard with (hash, document, line) arrays."""
    for batch in batches:
        hashes, rows, lines = [], [], []
        for row, text in enumerate(texts(batch)):
            if text:
                at, got = _keys(text.split("\n"), min_chars)
                hashes.append(got)
                rows += [row] * len(at)
                lines += at
        hashes = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        if not len(hashes):
            continue
        ids, prints = batch.column(0).to_pylist(), batch.column(2).to_numpy()
        known = np.array([i is not None for i in ids])
        own = np.array([i or 0 for i in ids], np.int64)
        rows, lines = np.array(rows), np.array(lines, np.int32)
        shard = hashes[:, 0] % shards
        order = np.argsort(shard, kind="stable")
        for s, at in zip(*_runs(shard[order], order)):
            of = rows[at]
            yield pa.RecordBatch.from_pylist([{"shard": int(s), "hashes": hashes[at].tobytes(), "doc_ids": own[of].tobytes(), "known": known[of].tobytes(), "prints": prints[of].tobytes(), "lines": lines[at].tobytes()}], _PROBES)


_PROBES = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("hashes", "doc_ids", "known", "prints", "lines"))])


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, its arrays first, its probes behind them; out go (doc_id, text hash, line) of lines that go."""
    shard, arrays = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["bits"] is not None:
                shard, arrays = row["shard"], _arrays(row)
            elif row["shard"] == shard:
                hit, _, keeper = _look_up(arrays, np.frombuffer(row["hashes"], np.int64).reshape(-1, 2))
                own, known = np.frombuffer(row["doc_ids"], np.int64)[hit], np.frombuffer(row["known"], bool)[hit]
                gone = ~known | (own != keeper)
                if gone.any():
                    take = lambda c, k: np.frombuffer(row[c], k)[hit][gone]  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(own[gone], mask=~known[gone]), pa.array(take("prints", np.int64)), pa.array(take("lines", np.int32))], names=["doc_id", "print", "line"])


def _cut(batches: Iterator[pa.RecordBatch], places: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        was, n_dropped = texts(batch), texts(batch, "n_dropped")
        for row, gone in enumerate(texts(batch, places)):
            if gone:
                drop = set(gone)
                was[row] = "\n".join(x for i, x in enumerate((was[row] or "").split("\n")) if i not in drop)
                n_dropped[row] += len(drop)
        out = replaced(batch, {"text": pa.array(was, batch.schema.field("text").type), "n_dropped": pa.array(n_dropped, pa.int64())})
        yield out.select([n for n in out.schema.names if n != places])


def _dedup_routed(spark: SparkSession, docs: DataFrame, path: str, shards: int, min_chars: int) -> DataFrame:
    """``docs``, which have n_dropped, without the lines of an index that stays where it is.

    What a document loses depends on its doc_id and text alone, so these two bring the places back to it.
    """
    probes = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("print")).mapInArrow(lambda it: _asked(it, shards, min_chars), "shard int, hashes binary, doc_ids binary, known binary, prints binary, lines binary")
    index = spark.read.schema(INDEX_SCHEMA).parquet(path)
    both = index.drop("n_keys").withColumn("_side", F.lit(0)).unionByName(probes.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    lines = both.repartition("shard").sortWithinPartitions("shard", "_side").drop("_side").mapInArrow(_routed, "doc_id long, print long, line int")
    own, known, places = spare(docs, "doc", "print", "gone")
    gone = lines.groupBy("doc_id", "print").agg(F.collect_set("line").alias(places))
    gone, _ = kept(spark, gone.select(F.col("doc_id").alias(own), F.col("print").alias(known), places), "line-places")
    met = docs.join(gone, docs["doc_id"].eqNullSafe(gone[own]) & (F.xxhash64(docs["text"]) == gone[known]), "left").drop(own, known)
    return met.mapInArrow(lambda it: _cut(it, places), docs.schema)


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 1 << 17) -> DataFrame:
    """``docs`` with repeated lines dropped from text, and columns n_lines and n_dropped."""
    small_batches(spark)
    docs = without(docs, ["n_lines", "n_dropped"])
    path, shards, often = build_index(spark, docs, min_chars, min_docs, shard_keys)
    schema = widened(docs, [("n_lines", T.LongType()), ("n_dropped", T.LongType())])
    if often is None:
        return docs.mapInArrow(lambda it: _cleaned(it, path, shards, min_chars), schema)
    first = docs.mapInArrow(lambda it: _cleaned(it, often, 1, min_chars), schema)
    return _dedup_routed(spark, first, path, shards, min_chars)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(spark, docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, t.i, t.line,
         translate(trim(t.line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), e'\n'), lambda x, i: {'line': x, 'i': i})) AS t FROM documents)
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.i, l.line, r.k IS NOT NULL AND r.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN repeated r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, e'\n' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
