"""Vector compression: product codes whose nearest entries come from metric trees.

Components become integers, floor(``scale`` * x). A vector is cut into ``parts`` equal
consecutive parts; each part position has a codebook of ``entries`` integer entries. It
starts as the parts of the smallest vec_ids; a round assigns every part to its nearest
entry and moves each entry to the componentwise floor of its parts' mean.

The nearest entry is found by branch and bound in a vantage-point tree over the entries of
the part position. A node's entry is tested by integer squared distance; a child holds the
entries whose distance from it lies between two radii, rounded outward, and is entered
unless the triangle inequality puts all of them strictly beyond the best so far. So ties
are always met, and the smaller index wins. A batch of vectors walks the tree together.

Spark deals the work: a task codes its vectors and adds up its own sums, which are
aggregated by entry and component. The driver holds codebooks only, which do not grow with
the rows (one set of codebooks for each length of vectors).

Defined cases: vectors that are null or hold a null or non-finite component are dropped;
a null vec_id comes after all others, and rows that share a vec_id are ordered by their
values; with fewer rows than entries a codebook has as many entries as rows; a length
that ``parts`` does not divide is cut as evenly as can be, longer parts first; vectors of
different lengths have codebooks of their own; an empty table gives an empty table;
input columns named like an added one are replaced. Components so large that distances
could leave 64 bits (2**26 with 64 dimensions) are coded with unbounded whole numbers by
testing every entry; an error beyond a long shows as the greatest long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chronolith.llm.shared import kept, spare, widened, without

#: Labels up to which the errors by label are broadcast: some 50 bytes each.
BROADCAST_LABELS = 20_000
#: Parts that a label's rows are dealt into beyond that.
SALTS = 32
#: How far a rounded root or sum may be from its value, with room.
SLACK = 2.0**-48
MOST = (1 << 63) - 1
ADDED = ["code", "error", "label_error", "codebooks_sha256"]


def narrow_limit(dims: int) -> int:
    """Components below this leave room for a vector's squared distances in 64 bits."""
    return 1 << (60 - max(1, dims).bit_length()) // 2


def cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    """Where each part begins and ends."""
    size, longer = divmod(dims, parts)
    ends = np.cumsum([size + (p < longer) for p in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def whole(x: float, scale: float) -> int:
    """floor(scale * x) without rounding, for powers of two also beyond the doubles."""
    v = scale * x
    return math.floor(v) if math.isfinite(v) else int(x) * int(scale)


def unpacked(values: bytes, wide: bool) -> np.ndarray:
    return np.array([int(d) for d in values.split(b",")], object) if wide else np.frombuffer(values, np.int32)


def integers(batches: Iterator[pa.RecordBatch], scale: float, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector (the last column) takes part, with its length, whether it is wide, and its packed integers instead of it."""
    for batch in batches:
        vectors = batch.column(batch.num_columns - 1)
        size = np.asarray(vectors.value_lengths().fill_null(-1))
        x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
        ends = np.cumsum(np.maximum(size, 0))
        bad = np.r_[0, np.cumsum(~np.isfinite(x))]
        good = (size >= 0) & (bad[ends] == bad[ends - np.maximum(size, 0)])
        with np.errstate(over="ignore", invalid="ignore"):
            v = np.floor(scale * x)
        values, wides = [], []
        for at in np.flatnonzero(good).tolist():
            start, end = int(ends[at] - size[at]), int(ends[at])
            wide = bool(end > start and np.abs(v[start:end]).max() >= narrow_limit(end - start))
            wides.append(wide)
            values.append(",".join(str(whole(c, scale)) for c in x[start:end].tolist()).encode() if wide else v[start:end].astype(np.int32).tobytes())
        rows = batch.select(batch.schema.names[:-1]).filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(size[good], pa.int32()), pa.array(wides, pa.bool_()), pa.array(values, pa.binary())], names=[*rows.schema.names, *names])


@dataclass
class Node:
    """An entry and its children: (least radius, greatest radius, node), radii rounded outward."""

    entry: int
    children: list[tuple[float, float, Node]] = field(default_factory=list)
    middle: float = 0.0


class MetricTree:
    """A vantage-point tree over integer entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._built(list(range(len(entries))))

    def _squared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = a - b
        return (gap * gap).sum(axis=-1)

    def _built(self, which: list[int]) -> Node:
        own = self.entries[which]
        spread = [self._squared(own, e).sum() for e in own]
        vantage = which[int(np.argmax(spread))]  # an entry at the rim parts the others best
        rest = sorted((int(self._squared(self.entries[i], self.entries[vantage])), i) for i in which if i != vantage)
        node, half = Node(vantage), (len(rest) + 1) // 2
        for side in (rest[:half], rest[half:]):
            if side:
                low, high = math.sqrt(side[0][0]) * (1 - SLACK), math.sqrt(side[-1][0]) * (1 + SLACK)
                node.children.append((low, high, self._built([i for _, i in side])))
        if len(node.children) == 2:
            node.middle = (node.children[0][1] + node.children[1][0]) / 2
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry, ties to the smaller index."""
        self.best = np.full(len(points), MOST)
        self.index = np.full(len(points), len(self.entries))
        every = np.arange(len(points))
        self._descend(self.root, points, every)
        self._visit(self.root, points, every)
        return self.index, self.best

    def _tested(self, entry: int, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        far = self._squared(points[rows], self.entries[entry])
        better = (far < self.best[rows]) | (far == self.best[rows]) & (entry < self.index[rows])
        self.best[rows[better]] = far[better]
        self.index[rows[better]] = entry
        return np.sqrt(far.astype(np.float64))

    def _descend(self, node: Node, points: np.ndarray, rows: np.ndarray) -> None:
        """To the leaf where the point lies, for a good first bound."""
        far = self._tested(node.entry, points, rows)
        inner = far <= node.middle if len(node.children) == 2 else np.full(len(rows), True)
        for child, mine in zip(node.children, (rows[inner], rows[~inner])):
            if len(mine):
                self._descend(child[2], points, mine)

    def _visit(self, node: Node, points: np.ndarray, rows: np.ndarray) -> None:
        far = self._tested(node.entry, points, rows)
        for low, high, child in node.children:
            least = np.maximum(far * (1 - SLACK) - high, low - far * (1 + SLACK)) - SLACK * (far + high)
            near = rows[least <= np.sqrt(self.best[rows].astype(np.float64)) * (1 + SLACK)]
            if len(near):
                self._visit(child, points, near)


def every_entry(entries: list[list[int]], point: list[int]) -> tuple[int, int]:
    """``MetricTree.nearest`` with unbounded whole numbers."""
    return min((sum((a - b) ** 2 for a, b in zip(e, point)), i) for i, e in enumerate(entries))[::-1]


class Coder:
    """Codebooks of one length of vectors: for each part the entries' components."""

    def __init__(self, books: list[list[list[int]]], dims: int):
        self.books, self.cuts = books, cuts(dims, len(books))
        limit = narrow_limit(dims)
        self.narrow = all(abs(c) < limit for book in books for e in book for c in e)
        self.trees = [MetricTree(np.array(book, np.int64).reshape(len(book), -1)) for book in books] if self.narrow else None

    def coded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), a column a part; ``vectors`` are int64, or objects if wide."""
        codes, errors = np.zeros((len(vectors), len(self.books)), np.int64), np.zeros((len(vectors), len(self.books)), object)
        for p, (start, end) in enumerate(self.cuts):
            if self.narrow and vectors.dtype != object:
                codes[:, p], errors[:, p] = self.trees[p].nearest(vectors[:, start:end])
            else:
                for row, point in enumerate(vectors[:, start:end].tolist()):
                    codes[row, p], errors[row, p] = every_entry(self.books[p], point)
        return codes, errors


def _groups(batch: pa.RecordBatch, dims: str, wide: str, values: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) of a batch, vectors of one length and kind at a time."""
    size, wides = (np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)) for c in (dims, wide))
    packed = batch.column(batch.schema.get_field_index(values)).to_pylist()
    for d, w in sorted(set(zip(size.tolist(), wides.tolist()))):
        rows = np.flatnonzero((size == d) & (wides == w))
        own = [packed[r] for r in rows.tolist()]
        yield d, rows, (np.array([unpacked(v, True) for v in own], object) if w else np.frombuffer(b"".join(own), np.int32).astype(np.int64)).reshape(len(rows), d)


_SUMS = pa.schema([("dims", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])


def _summed(batches: Iterator[pa.RecordBatch], books: dict[int, list], names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """A task's sums by (length, part, entry, component), in limbs of 32 bits; component -1 counts."""
    coders = {d: Coder(b, d) for d, b in books.items()}
    total: dict[tuple[int, int, int], np.ndarray] = {}
    for batch in batches:
        for dims, _, vectors in _groups(batch, *names):
            codes, _ = coders[dims].coded(vectors)
            for p, (start, end) in enumerate(coders[dims].cuts):
                order = np.argsort(codes[:, p], kind="stable")
                used, first, count = np.unique(codes[order, p], return_index=True, return_counts=True)
                sums = np.add.reduceat(vectors[order, start:end], first, axis=0).astype(object)
                for entry, n, own in zip(used.tolist(), count.tolist(), sums):
                    own = np.array([n, *own.tolist()], object)
                    key = (dims, p, entry)
                    total[key] = total[key] + own if key in total else own
    rows = []
    for key, own in total.items():
        for at, v in enumerate(own.tolist()):
            v, limb = int(v), 0
            while not -(1 << 31) <= v < 1 << 31:
                rows.append((*key, at - 1, limb, v & 0xFFFFFFFF))
                v, limb = v >> 32, limb + 1
            rows.append((*key, at - 1, limb, v))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMS)], schema=_SUMS)


def train(ints: DataFrame, names: tuple[str, str, str], order: str, parts: int = 8, entries: int = 16, rounds: int = 6) -> dict[int, list]:
    """Codebooks by length of vectors: books[length][part][entry] is a list of integers."""
    dims, wide, values = names
    rank = F.row_number().over(Window.partitionBy(dims).orderBy(F.col(order).asc_nulls_last(), wide, values))  # tasks send ``entries`` rows each
    first = ints.select(order, *names).withColumn("_rank", rank).where(F.col("_rank") <= entries).orderBy(dims, "_rank").collect()
    books: dict[int, list] = {}
    for r in first:
        vector = [int(c) for c in unpacked(r[values], r[wide]).tolist()]
        for book, (start, end) in zip(books.setdefault(r[dims], [[] for _ in range(parts)]), cuts(r[dims], parts)):
            book.append(vector[start:end])
    for _ in range(rounds if books else 0):
        sums = ints.select(*names).mapInArrow(lambda it, now=books: _summed(it, now, names), "dims int, part int, entry int, at int, limb int, value long")
        found = sums.groupBy("dims", "part", "entry", "at", "limb").agg(F.sum("value").alias("value")).collect()  # a row a component of the codebooks
        whole_sums: dict[tuple[int, int, int], dict[int, int]] = {}
        for r in found:
            own = whole_sums.setdefault((r["dims"], r["part"], r["entry"]), {})
            own[r["at"]] = own.get(r["at"], 0) + (r["value"] << 32 * r["limb"])
        moved = {d: [[list(e) for e in book] for book in b] for d, b in books.items()}
        for (d, p, e), own in whole_sums.items():
            moved[d][p][e] = [own[at] // own[-1] for at in range(len(own) - 1)]
        books = moved
    return books


def digest(books: list) -> str:
    """SHA-256 of all components by part, entry and place, in decimals joined by commas."""
    return hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()


def _encoded(batches: Iterator[pa.RecordBatch], books: dict[int, list], names: tuple[str, str, str], own: list[str], added: list[str]) -> Iterator[pa.RecordBatch]:
    coders, shas = {d: Coder(b, d) for d, b in books.items()}, {d: digest(b) for d, b in books.items()}
    for batch in batches:
        code, error, sha = ([None] * batch.num_rows for _ in range(3))
        for dims, rows, vectors in _groups(batch, *names):
            codes, errors = coders[dims].coded(vectors)
            for row, c, e in zip(rows.tolist(), codes.tolist(), errors.sum(axis=1).tolist()):
                code[row], error[row], sha[row] = "".join(f"{i:02x}" for i in c), min(MOST, int(e)), shas[dims]
        kept_columns = batch.select(own)
        yield pa.RecordBatch.from_arrays([*kept_columns.columns, pa.array(code, pa.string()), pa.array(error, pa.int64()), pa.array(sha, pa.string())], names=[*own, *added])


def decode(code: str, books: list) -> list[int]:
    """The integers that a code stands for: its entries in part order."""
    return [c for at, book in enumerate(books) for c in book[int(code[2 * at : 2 * at + 2], 16)]]


def with_label_error(spark: SparkSession, coded: DataFrame, label: str) -> DataFrame:
    """``coded`` with label_error: error summed over the rows with an equal label, nulls together."""
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST).cast("decimal(20,0)")).cast("long")
    per, _ = kept(spark, coded.groupBy(F.col(label).alias("_label")).agg(total.alias("label_error")), "codes-labels")
    same, (salt,) = coded[label].eqNullSafe(per["_label"]), spare(coded, "salt")
    if per.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(per), same).drop("_label")
    per = per.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn(salt, F.pmod(F.xxhash64("code", "error"), F.lit(SALTS)).cast("int"))
    return dealt.join(per, dealt[label].eqNullSafe(per["_label"]) & (dealt[salt] == per["_part"])).drop("_label", "_part", salt)


def compress(spark: SparkSession, vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> tuple[DataFrame, dict[int, list]]:
    """(rows, codebooks): ``vectors`` without the vector, with code, error, codebooks_sha256 and, if there is a label, label_error.

    A code has two hex digits a part, so ``entries`` is 256 at most.
    """
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("entries must be 1 to 256 and parts at least 1")
    rows = without(vectors, [n for n in ADDED if n not in (key, vector, label)])
    own = [c for c in rows.columns if c != vector]
    names = tuple(spare(rows, "dims", "wide", "values"))
    packed = [(names[0], T.IntegerType()), (names[1], T.BooleanType()), (names[2], T.BinaryType())]
    plain = rows.select(*[f"`{c}`" for c in own])
    ready = rows.select(*[f"`{c}`" for c in own], F.col(f"`{vector}`").cast("array<double>").alias(*spare(rows, "vector")))
    ints, _ = kept(spark, ready.mapInArrow(lambda it: integers(it, scale, names), widened(plain, packed)), "codes-integers")
    books = train(ints, names, key, parts, entries, rounds)
    added = ["code", "error", "codebooks_sha256"]
    schema = widened(plain, [("code", T.StringType()), ("error", T.LongType()), ("codebooks_sha256", T.StringType())])
    coded = ints.mapInArrow(lambda it: _encoded(it, books, names, own, added), schema)
    if label is None:
        return coded, books
    coded, _ = kept(spark, coded, "codes-rows")
    return with_label_error(spark, coded, label), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = compress(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written one after another: b0 the first codebooks, a1 the first assignment, and so on."""
    out = [
        "WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))",
    ]
    for r in range(1, rounds + 2):
        gap = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
        out.append(f"d{r} AS MATERIALIZED (SELECT vec_id, p.part, entry, p.x, CAST({gap} AS BIGINT) AS far FROM p JOIN b{r - 1} b ON p.part = b.part)")
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, entry, x, far FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1)")
        if r <= rounds:
            each = f"SELECT part, entry, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS c FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS i FROM a{r}) GROUP BY part, entry, i"
            out.append(f"m{r} AS MATERIALIZED (SELECT part, entry, list(c ORDER BY i) AS x FROM ({each}) GROUP BY part, entry)")
            out.append(f"b{r} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r - 1} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)")
    last = rounds + 1
    coded = f"SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{last} GROUP BY vec_id"
    sha = f"SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}"
    return ",\n".join(out) + (
        f"\nSELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, s.codebooks_sha256"
        f"\nFROM v JOIN ({coded}) c USING (vec_id), ({sha}) s"
    )


ORACLE_SQL = _oracle()
