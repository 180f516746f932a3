"""N-gram Jaccard join by vertical partitioning, down to connected components.

A document's set holds the 64-bit hashes of its distinct n-word shingles; two shingles of
one text that share a hash, one chance in 10**10 for a text of 60,000, count as one. Documents link
when their sets' Jaccard similarity is at least ``percent`` / 100.

1. Documents with equal sets form a class, known by a 128-bit hash of the sorted set and,
   once it may link, by a number of its own; from here on a class stands for all its
   copies. Exact copies are never paired.
2. Vertical partitioning: the order of shingle hashes is cut into fragments of about
   ``fragment_tokens``. Each fragment gets its piece of every set, finds the shingles that
   two classes or more share, and hands each class its shared shingles back, packed by
   buckets of classes. Shingles of more than a fiftieth of the texts would make one
   fragment as large as the corpus: they are found while texts are signed (at most 100
   times the mean set size, by their number), count as shared, and are dealt by class. A class
   whose shared shingles, summed over the fragments, are under ``percent`` of its set can
   link with nothing and is done.
3. Shingles are ordered by (documents that hold them, hash). Linked classes share a
   shingle among the rarest |x| - need + 1 of each (prefix filter), so the lists of prefix
   shingles hold all candidates. Short lists give all their pairs. Of a long list only the
   most central class, whose shingles are the most shared, is paired with the others: a
   star, not a square.
4. A pair's overlap is the sum of its partial overlaps in the fragments; counting stops
   when the rest can't reach the bound.
5. Classes that the links connect need no further test among themselves. What long lists
   still hold across components is tested block against block: classes go to blocks by
   the centre that they were tested with, their component and their size; pairs of blocks
   that share a prefix shingle, lie in different components and allow a link by size are
   multiplied fragment by fragment, and links alone come out, never the pairs.

Defined cases: null, empty and blank texts have the empty set and link with nothing; texts
under n words have one shingle, the whole sequence; a null doc_id never names a component
unless all its documents lack one; rows that share a doc_id are documents of their own; an
empty table gives an empty table; input columns named n_shingles or component_id are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.components import components
from chronolith.llm.shared import kept, small_batches, spare, texts

#: Lists up to this length give all their pairs.
SHORT_LIST = 6
#: Classes, and shingles, in a block of the last step.
BLOCK_CLASSES, BLOCK_TOKENS = 256, 400_000
#: Classes of one component that get blocks of their own there.
OWN_BLOCK = 32
#: Shingles of a fragment that the last step multiplies at once.
GEMM_TOKENS = 8_192
#: Shingles that a task gathers before it deals them to the fragments, or counts them.
BUFFER_TOKENS = 1_500_000
#: The part of the texts that must hold a shingle, by the counts of buffers where that part does, to be dealt by class.
HOT_PART = 0.01

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int = 5, seed: int = 0) -> np.ndarray:
    """The sorted distinct hashes of the text's n-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ (out >> np.uint64(29))) * _STEP + each[j : j + len(out)]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


def _unique(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct rows of (hi, lo), which of them each row is)."""
    order = np.lexsort((names[:, 1], names[:, 0]))
    ranked = names[order]
    first = np.r_[True, (ranked[1:] != ranked[:-1]).any(axis=1)] if len(names) else np.zeros(0, bool)
    which = np.empty(len(names), np.int64)
    which[order] = np.cumsum(first) - 1
    return ranked[first], which


def name(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("token", pa.int64()), ("hits", pa.int64())])


def _signed(batches: Iterator[pa.RecordBatch], n: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and (token, hits) rows for shingles that HOT_PART of the distinct texts of a buffer hold."""
    seen: set[bytes] = set()
    held: list[np.ndarray] = []
    tokens = 0

    def frequent() -> pa.RecordBatch:
        token, hits = np.unique(np.concatenate(held), return_counts=True)
        often = hits >= max(2, HOT_PART * len(held))
        none = pa.nulls(int(often.sum()), pa.int64())
        held.clear()
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(token[often].view(np.int64)), pa.array(hits[often])], schema=_SIGNED)

    for batch in batches:
        sizes, names = [], []
        for text in texts(batch):
            own = shingles(text, n, seed)
            called = name(own)
            sizes.append(len(own))
            names.append(called)
            if len(own) and called not in seen:
                seen.add(called)
                held.append(own)
                tokens += len(own)
        hi_lo = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        none = pa.nulls(len(sizes), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hi_lo[:, 0]), pa.array(hi_lo[:, 1]), none, none], schema=_SIGNED)
        if tokens >= BUFFER_TOKENS:
            yield frequent()
            tokens = 0
    if held:
        yield frequent()


def _dealt(batches: Iterator[pa.RecordBatch], n: int, seed: int, fragments: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(fragment, part, classes, set sizes, shingles of each class, shingles) in packed arrays; hot shingles by their number, in parts of classes."""
    seen: set[bytes] = set()
    sets: list[np.ndarray] = []
    classes: list[bytes] = []

    def flush() -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), sizes)
        names = np.frombuffer(b"".join(classes), np.int64).reshape(-1, 2)
        where = ((every >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        token = every.astype(np.uint32)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, every), len(hot) - 1)
            known = hot[at] == every
            where[known] = fragments + (names[:, 1].view(np.uint64) % np.uint64(fragments)).astype(np.int64)[of[known]]
            token[known] = at[known]
        order = np.argsort(where, kind="stable")
        where, of, token = where[order], of[order], token[order]
        size, rows = sizes.astype(np.uint32), []
        cut = np.flatnonzero(np.diff(where)) + 1
        for start, end in zip(np.r_[0, cut], np.r_[cut, len(where)]):
            own, count = np.unique(of[start:end], return_counts=True)
            rows.append((min(fragments, int(where[start])), max(0, int(where[start]) - fragments), names[own].tobytes(), size[own].tobytes(), count.astype(np.uint32).tobytes(), token[start:end].tobytes()))
        sets.clear()
        classes.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 2 + [pa.binary()] * 4)], names=["fragment", "part", "cls", "size", "count", "token"])

    held = 0
    for batch in batches:
        for text in texts(batch, "text"):
            own = shingles(text, n, seed)
            if not len(own):
                continue
            cls = name(own)
            if cls in seen:  # a copy's shingles have gone already
                continue
            seen.add(cls)
            sets.append(own)
            classes.append(cls)
            held += len(own)
            if held >= BUFFER_TOKENS:
                yield flush()
                held = 0
    if sets:
        yield flush()


def _read(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _shared(table: pa.Table, buckets: int, hot_hits: np.ndarray) -> pa.Table:
    """One fragment, or one part of the classes of hot shingles: each class's shingles that another class holds too, packed by bucket of classes."""
    fragment = table.column("fragment")[0].as_py()
    cls, size, count, token = (_read(table, c, k) for c, k in (("cls", np.int64), ("size", np.uint32), ("count", np.uint32), ("token", np.uint32)))
    names, which = _unique(cls.reshape(-1, 2))
    sizes = np.zeros(len(names), np.uint32)
    sizes[which] = size
    bucket = (names[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    rank = np.lexsort((names[:, 1], names[:, 0], bucket))  # classes by bucket
    place = np.empty(len(rank), np.uint32)
    place[rank] = np.arange(len(rank), dtype=np.uint32)
    names, sizes, bucket = names[rank], sizes[rank], bucket[rank]
    pair = np.unique((token.astype(np.uint64) << np.uint64(32)) | np.repeat(place[which], count))  # a class once, however many of its copies came
    token, of = (pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32)
    if fragment == buckets:
        held = hot_hits[token]
    else:
        first = np.r_[True, token[1:] != token[:-1]] if len(token) else np.zeros(0, bool)
        docs = np.diff(np.r_[np.flatnonzero(first), len(token)])
        held = np.repeat(docs, docs)
    keep = np.flatnonzero(held > 1)
    keep = keep[np.argsort(of[keep], kind="stable")]
    token, of, held = token[keep], of[keep], held[keep]
    rarity = np.minimum(255, np.log2(np.maximum(held, 1)) * 8).astype(np.uint8)
    own, start, count = np.unique(of, return_index=True, return_counts=True)
    cut = np.flatnonzero(np.diff(bucket[own])) + 1
    rows = []
    for i, j in zip(np.r_[0, cut], np.r_[cut, len(own)]) if len(own) else ():
        lo, hi = start[i], start[j - 1] + count[j - 1]
        rows.append((int(bucket[own[i]]), fragment, names[own[i:j]].tobytes(), sizes[own[i:j]].tobytes(), count[i:j].astype(np.uint32).tobytes(), token[lo:hi].tobytes(), rarity[lo:hi].tobytes()))
    return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate([pa.int32()] * 2 + [pa.binary()] * 5)], names=["bucket", "fragment", "cls", "size", "count", "token", "rarity"])


def _merged(table: pa.Table, percent: int) -> pa.Table:
    """One bucket of classes: the shared shingles of those that have enough of them, summed over the fragments."""
    each = [len(x) // 16 for x in table.column("cls").to_pylist()]
    fragment = np.repeat(np.array(table.column("fragment").to_pylist(), np.int32), each)
    cls, size, count, token, rarity = (_read(table, c, k) for c, k in (("cls", np.int64), ("size", np.uint32), ("count", np.uint32), ("token", np.uint32), ("rarity", np.uint8)))
    names, which = _unique(cls.reshape(-1, 2))
    sizes = np.zeros(len(names), np.int64)
    sizes[which] = size
    enough = np.bincount(which, count, len(names)) * 100 >= sizes * percent
    order = np.lexsort((fragment, which))
    order = order[enough[which[order]]]
    first = np.cumsum(count, dtype=np.int64) - count
    n = count[order].astype(np.int64)
    at = np.arange(n.sum()) + np.repeat(first[order] - (np.cumsum(n) - n), n)
    number = (np.cumsum(enough) - 1)[which[order]]
    names, sizes = names[enough], sizes[enough]
    pieces = np.bincount(number, minlength=len(names))
    shingles_of = np.bincount(number, n, len(names)).astype(np.int64)

    def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        offsets = np.r_[0, np.cumsum(lengths * values.itemsize)].astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())

    return pa.table(
        [pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(sizes), packed(fragment[order], pieces), packed(count[order], pieces), packed(token[at], shingles_of), packed(rarity[at], shingles_of)],
        names=["hi", "lo", "size", "fragment", "count", "token", "rarity"],
    )


def need(size, percent: int):
    """The least overlap that a set of this size has with a linked one."""
    return -(-percent * size // 100)


def _tokens(row: dict) -> np.ndarray:
    """A class's shared shingles, fragment and hash in one number, ascending."""
    fragments = np.repeat(np.frombuffer(row["fragment"], np.int32), np.frombuffer(row["count"], np.uint32))
    return (fragments.astype(np.int64) << 32) | np.frombuffer(row["token"], np.uint32).astype(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        token, cls, size, central = [], [], [], []
        for row in batch.to_pylist():
            own, rarity = _tokens(row), np.frombuffer(row["rarity"], np.uint8)
            n = row["size"]
            rarest = n - need(n, percent) + 1 - (n - len(own))  # shingles of this class alone come first
            at = np.lexsort((own, rarity))[:rarest]
            token.append(own[at])
            cls.append(np.full(len(at), row["cls"]))
            size.append(np.full(len(at), n))
            central.append(np.full(len(at), rarity.sum(dtype=np.int64) / n))
        if token:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, cls, size, central)], names=["token", "cls", "size", "central"])


def _pieces(row: dict, side: str) -> dict[int, np.ndarray]:
    """A set's shared shingles by fragment."""
    count = np.frombuffer(row[f"{side}_count"], np.uint32)
    return dict(zip(np.frombuffer(row[f"{side}_fragment"], np.int32).tolist(), np.split(np.frombuffer(row[f"{side}_token"], np.uint32), np.cumsum(count)[:-1])))


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose partial overlaps, fragment by fragment, add up to a link."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            both = row["a_size"] + row["b_size"]
            least = -(-percent * both // (100 + percent))
            mine, theirs = (_pieces(row, side) for side in "ab")
            common = [f for f in mine if f in theirs]
            left = [min(len(mine[f]), len(theirs[f])) for f in common]
            overlap, rest = 0, sum(left)
            for f, most in zip(common, left):
                if overlap + rest < least:
                    break
                overlap += np.intersect1d(mine[f], theirs[f], assume_unique=True).size
                rest -= most
            if overlap >= least:
                found.append((row["a"], row["b"]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])


def verify(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) among pairs (a, b)."""
    side = lambda s: classes.select(F.col("cls").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("size", "fragment", "count", "token")])
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda it: _verified(it, percent), "u long, v long")


def _packed(table: pa.Table) -> pa.Table:
    rows = sorted(table.drop_columns(["block"]).to_pylist(), key=lambda r: r["cls"])
    own = [np.frombuffer(r["tokens"], np.int64) if "tokens" in r else _tokens(r) for r in rows]
    pack = lambda values: pa.array([np.array(values, np.int64).tobytes()], pa.binary())
    return pa.table([table.column("block").slice(0, 1).combine_chunks(), *(pack([r[c] for r in rows]) for c in ("cls", "size", "root")), pack([len(x) for x in own]), pa.array([np.concatenate(own).tobytes()], pa.binary())], names=["block", "cls", "size", "root", "count", "token"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, summed over fragments of the shingle order."""
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (a, of_a), (b, of_b) = flat(left), flat(right)
    common = np.intersect1d(a, b)
    total = np.zeros((len(left), len(right)), np.float32)
    ends = []
    for tokens, of in ((a, of_a), (b, of_b)):
        at = np.searchsorted(common, tokens)
        hit = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == tokens) if len(common) else np.zeros(len(tokens), bool)
        at, of = at[hit], of[hit]
        order = np.argsort(at, kind="stable")
        ends.append((at[order], of[order]))
    for start in range(0, len(common), GEMM_TOKENS):
        dense = []
        for (at, of), sets in zip(ends, (left, right)):
            lo, hi = np.searchsorted(at, [start, start + GEMM_TOKENS])
            x = np.zeros((len(sets), GEMM_TOKENS), np.float32)
            x[of[lo:hi], at[lo:hi] - start] = 1
            dense.append(x)
        total += dense[0] @ dense[1].T
    return total.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            get = lambda s, c: np.frombuffer(row[f"{s}_{c}"], np.int64)  # noqa: B023, E731
            sets = {s: np.split(get(s, "token"), np.cumsum(get(s, "count"))[:-1]) for s in "ab"}
            overlap = overlaps(sets["a"], sets["b"])
            link = 100 * overlap >= percent * (get("a", "size")[:, None] + get("b", "size")[None, :] - overlap)
            link &= get("a", "root")[:, None] != get("b", "root")[None, :]
            i, j = np.nonzero(link)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(get("a", "cls")[i]), pa.array(get("b", "cls")[j])], names=["u", "v"])


def tail_links(lists: DataFrame, roots: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links across components among the members of long lists: (token, cls, size, m, leader).

    Classes go to blocks by the leader of their longest list, by their component where it
    has many of them, and by size, steps of the similarity apart. Two blocks of one component
    are never paired, nor blocks whose sizes forbid a link: a list of which one component holds
    all but a few costs its length times those few, not its square.
    """
    spark = lists.sparkSession
    rooted = lists.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    open_lists = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    open_lists, _ = kept(spark, open_lists, "ngram-open")  # written, so a long list's join can be split
    left = rooted.join(open_lists, "token", "left_semi")
    member = left.groupBy("cls").agg(F.max(F.struct("m", "leader"))["leader"].alias("home"), F.first("root").alias("root"), F.first("size").alias("size"))
    member = member.withColumn("step", F.floor(F.log("size") / (math.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("size"))
    alone = member.groupBy("home", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OWN_BLOCK).select("home", F.col("root"), F.col("root").alias("only"))
    member = member.join(alone, ["home", "root"], "left").withColumn("dealt", F.xxhash64("home", F.coalesce("only", F.lit(-1)), "step"))
    parts = member.groupBy("dealt").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_TOKENS)).alias("parts"))
    member = member.join(parts, "dealt").select("cls", "root", "only", "step", F.xxhash64("dealt", F.pmod(F.xxhash64("cls"), F.col("parts"))).alias("block"))
    member, _ = kept(spark, member, "ngram-blocks")
    at = left.select("token", "cls").join(member.select("cls", "block", "only", "step"), "cls").select("token", "block", "only", "step").distinct()
    other = at.select("token", F.col("block").alias("b"), F.col("only").alias("b_only"), F.col("step").alias("b_step"))
    may_link = (F.col("a") <= F.col("b")) & ~F.coalesce(F.col("only") == F.col("b_only"), F.lit(False)) & (F.abs(F.col("step") - F.col("b_step")) <= 1)
    pairs = at.withColumnRenamed("block", "a").join(other, "token").where(may_link).select("a", "b").distinct()
    own = [c for c in ("fragment", "count", "token", "tokens") if c in classes.columns]
    packed = classes.join(member.select("cls", "root", "block"), "cls").select("block", "cls", "size", "root", *own).groupBy("block").applyInArrow(_packed, "block long, cls binary, size binary, root binary, count binary, token binary")
    packed, _ = kept(spark, packed, "ngram-packed")
    side = lambda s: packed.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("cls", "size", "root", "count", "token")])
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda it: _blocks(it, percent), "u long, v long")


def labelled(signed: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows (doc_id, n_shingles, hi, lo), their classes (hi, lo, first_id, cls) and the classes' roots."""
    numbered = classes.select("hi", "lo", "first_id", "cls").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = numbered.where("root IS NOT NULL").groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = numbered.join(least, "root", "left").select("hi", "lo", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"))
    return signed.join(named, ["hi", "lo"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def label(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80, fragment_tokens: int = 4_000_000, hot_texts: int = 1_000, seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text); a shingle under ``hot_texts`` texts is never dealt by class."""
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    made, _ = kept(spark, docs.mapInArrow(lambda it: _signed(it, n, seed), "doc_id long, n_shingles long, hi long, lo long, token long, hits long"), "ngram-signed")
    signed = made.where("n_shingles IS NOT NULL").drop("token", "hits")
    classes, _ = kept(spark, signed.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("size")), "ngram-classes")
    number, tokens = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    fragments = max(1, -(-tokens // fragment_tokens))
    often = made.where("hits IS NOT NULL").groupBy("token").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= max(hot_texts, HOT_PART * number))
    found = sorted((r["token"] % (1 << 64), r["hits"]) for r in often.collect())  # at most 100 times the mean set size: their hits add up to no more than all shingles
    hot, hot_hits = np.array([t for t, _ in found], np.uint64), np.array([h for _, h in found], np.int64)

    dealt = docs.mapInArrow(lambda it: _dealt(it, n, seed, fragments, hot), "fragment int, part int, cls binary, size binary, count binary, token binary")
    shared = dealt.groupBy("fragment", "part").applyInArrow(lambda t: _shared(t, fragments, hot_hits), "bucket int, fragment int, cls binary, size binary, count binary, token binary, rarity binary")
    merged = shared.groupBy("bucket").applyInArrow(lambda t: _merged(t, percent), "hi long, lo long, size long, fragment binary, count binary, token binary, rarity binary")
    sets, _ = kept(spark, merged.withColumn("cls", F.monotonically_increasing_id()), "ngram-sets")  # written, so the numbers stay

    prefix, _ = kept(spark, sets.mapInArrow(lambda it: _prefixes(it, percent), "token long, cls long, size long, central double"), "ngram-prefix")
    lists = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("central", "cls", "size")).alias("top")).where("m > 1")
    heads, _ = kept(spark, lists.select("token", "m", F.col("top.cls").alias("leader"), F.col("top.size").alias("leader_size")), "ngram-heads")
    lists, _ = kept(spark, prefix.join(heads, "token"), "ngram-lists")
    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    star = lists.where((F.col("m") > SHORT_LIST) & (F.col("cls") != F.col("leader")) & near(F.col("size"), F.col("leader_size"))).select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b"))
    short = lists.where(F.col("m") <= SHORT_LIST)
    left, right = (short.select("token", F.col("cls").alias(c), F.col("size").alias(f"{c}_size")) for c in "ab")
    square = left.join(right, "token").where((F.col("a") < F.col("b")) & near(F.col("a_size"), F.col("b_size"))).select("a", "b")
    links, _ = kept(spark, verify(star.union(square).distinct(), sets, percent), "ngram-links")
    roots = components(spark, links)
    more, _ = kept(spark, tail_links(lists.where(F.col("m") > SHORT_LIST), roots, sets, percent), "ngram-tail")
    if not more.isEmpty():
        roots = components(spark, roots.select(F.col("cls").alias("u"), F.col("root").alias("v")).union(more))

    return labelled(signed, classes.join(sets.select("hi", "lo", "cls"), ["hi", "lo"], "left"), roots)


def keep_one(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id.

    Of rows that share this doc_id all stay; rows without doc_id stay.
    """
    (other,) = spare(docs, "gone")
    gone = label(spark, docs, **how).where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(other)).distinct()
    gone, _ = kept(spark, gone, "ngram-gone")
    return docs.join(gone, docs["doc_id"] == gone[other], "left_anti")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), edges AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT u AS doc_id, v AS other FROM edges UNION SELECT r.doc_id, e.v FROM reach r JOIN edges e ON r.other = e.u
), least_id AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id
FROM words d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_id l USING (doc_id)
"""
