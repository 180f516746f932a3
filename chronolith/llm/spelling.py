"""Groups of spelling variants: words one edit apart, found by an even-partition pigeonhole join.

Words come from the letter runs of whole texts; a task counts its own before they are
added up, so a common word is a row a task. Then all pairs of words within one inserted,
deleted or replaced code point are found:

1. A word of length m is indexed by two segments that depend on m alone: its first m // 2
   code points and the rest. One edit leaves one segment of the shorter word whole, so a
   word of the same or one more code point shares it, at its place or shifted by the
   difference in length: the words of length m and m + 1 probe with those substrings.
2. The words that share a segment differ by one edit in what is left between. A list of
   more than ``LONG_LIST`` words is not paired: the same partition is made of what is left,
   again and again, until the list is short or the shared parts leave one place open. A list of
   the last kind holds only true neighbours, as many as the alphabet has letters. So no
   list is cut, and the work grows with the words and their links.
3. Candidates of short lists are verified on what is left between; a pair that two lists
   name counts once.

A word's form is its near word of largest count, where that is ``ratio`` times its own;
roots follow forms by doubling, as counts grow tenfold a step.

Defined cases: a null text has no words; a null doc_id counts as an empty one where the
query slips letters; rows that repeat a document count again; words of any length are
taken whole; equal counts go to the smaller word in code-point order; an empty table gives
an empty table; columns of ``docs`` other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.shared import kept, small_batches, texts

#: A run of letters: ASCII and Latin-1.
RUN = "[A-Za-zÀ-ÿ]+"
#: Words in a list beyond which it is divided further.
LONG_LIST = 16
#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 300_000

_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def slipped(doc_id: int | None, run: str, every: int) -> str:
    """The run without one of its code points, for one in ``every`` of (document, run)."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch], slip: int | None, least: int) -> Iterator[pa.RecordBatch]:
    pattern, held = re.compile(RUN), Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=_COUNTED)
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch)):
            own = Counter(pattern.findall((text or "").encode().lower().decode()))  # of bytes: A-Z only
            for run, n in own.items():
                word = run if slip is None else slipped(doc_id, run, slip)
                if len(word) >= least:
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield flush()
    if held:
        yield flush()


def words(docs: DataFrame, least_length: int = 7, least_count: int = 2, slip: int | None = None) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) and their occurrences; ``slip`` as in ``slipped``."""
    small_batches(docs.sparkSession)
    each = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _counted(it, slip, least_length), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _middle() -> Column:
    """What is left of a word between the parts that its list shares."""
    return F.substring(F.col("word"), F.col("left") + 1, F.length("word") - F.col("left") - F.col("right"))


def divided(rows: DataFrame) -> DataFrame:
    """Each row (gap, side, m, left, right, word, n) in the lists of its two segments.

    ``left`` and ``right`` are how many code points at either end the list shares, m how many
    are left of its shorter words, gap how many more its longer words (side 1) have.
    """
    half = F.floor(F.col("m") / 2).cast("int")
    first, second = F.when(F.col("gap") == 0, half).otherwise(F.greatest(half, F.lit(1))), F.col("m") - half  # of one code point and another word's two, one is shared
    child = lambda at, left, right, taken: F.struct(F.lit(at).alias("which"), left.alias("left"), right.alias("right"), (F.col("m") - taken).alias("m"))
    both = F.array(child(0, F.col("left") + first, F.col("right"), first), child(1, F.col("left"), F.col("right") + second, second))
    out = rows.select("gap", "side", "word", "n", F.explode(both).alias("c")).select("gap", "side", "word", "n", "c.left", "c.right", "c.m")
    shared = F.concat_ws("|", "gap", "m", F.substring(F.col("word"), F.lit(1), F.col("left")), F.substring(F.col("word"), F.length("word") - F.col("right") + 1, F.col("right")))
    return out.withColumn("list", shared)


def _paired(rows: DataFrame) -> DataFrame:
    """The verified pairs (u, u_n, v, v_n) of short lists, v being the longer word or else the greater."""
    held = rows.groupBy("list", "gap").agg(F.collect_list(F.struct("side", "word", "n", _middle().alias("middle"))).alias("held"))
    one = held.select("gap", "held", F.explode("held").alias("a")).where("a.side = 0")
    two = one.select("gap", "a", F.explode("held").alias("b"))
    right_way = F.when(F.col("gap") == 0, F.col("a.word") < F.col("b.word")).otherwise(F.col("b.side") == 1)
    near = two.where(right_way).where(F.levenshtein(F.col("a.middle"), F.col("b.middle"), 1) == 1)
    return near.select(F.col("a.word").alias("u"), F.col("a.n").alias("u_n"), F.col("b.word").alias("v"), F.col("b.n").alias("v_n"))


def near_pairs(spark: SparkSession, counted: DataFrame) -> DataFrame:
    """(u, u_n, v, v_n): each pair of the words of ``counted`` (word, n; words distinct) that one edit parts, once; an empty word takes no part."""
    length = F.length("word")
    place = lambda gap, side, m: F.struct(F.lit(gap).alias("gap"), F.lit(side).alias("side"), m.alias("m"))
    start = F.array(place(0, 0, length), place(1, 0, length), place(1, 1, length - 1))
    whole = counted.where(length > 0).select("word", "n", F.explode(start).alias("p"), F.lit(0).alias("left"), F.lit(0).alias("right")).select("word", "n", "left", "right", "p.*")
    rows, found = divided(whole.where("m > 0")), []
    while True:
        rows, _ = kept(spark, rows, "spelling-lists")
        sides = rows.groupBy("list").agg(F.count(F.when(F.col("side") == 0, 1)).alias("a"), F.count(F.when(F.col("side") == 1, 1)).alias("b"), F.first("m").alias("_m"), F.first("gap").alias("_gap"))
        useful = sides.where(F.when(F.col("_gap") == 0, F.col("a") > 1).otherwise((F.col("a") > 0) & (F.col("b") > 0)))
        last = F.col("_m") == F.when(F.col("_gap") == 0, 1).otherwise(0)  # one place is open
        marked = useful.select("list", ((F.col("a") + F.col("b") > LONG_LIST) & ~last).alias("long"))
        marked, _ = kept(spark, marked, "spelling-marks")
        met = rows.join(marked, "list")
        pairs, _ = kept(spark, _paired(met.where(~F.col("long"))), "spelling-pairs")
        found.append(pairs)
        if marked.where("long").isEmpty():
            break
        rows = divided(met.where("long").drop("list", "long"))
    out = found[0]
    for pairs in found[1:]:
        out = out.union(pairs)
    return out.distinct()  # an insertion beside an equal letter is met in two lists


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) for rows of (word, form): where following forms ends."""
    now, _ = kept(spark, forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        jumped = now.join(onward, "root", "left")
        jumped, _ = kept(spark, jumped.select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "spelling-roots")
        now = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return now


def variants(spark: SparkSession, counted: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``counted`` (word, n)."""
    counted, _ = kept(spark, counted, "spelling-words")
    pairs, _ = kept(spark, near_pairs(spark, counted), "spelling-near")
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("near"), F.col("v_n").alias("near_n")).union(pairs.select("v", "u", "u_n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    table = counted.join(best, "word", "left").select(
        "word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n")
    )
    table, _ = kept(spark, table, "spelling-forms")
    ends = roots(spark, table.where("form IS NOT NULL").select("word", "form"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(spark, words(docs, slip=31))


def _crc_table() -> list[int]:
    """What four bits do to a CRC-32."""
    out = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def _oracle() -> str:
    table = f"{_crc_table()}::UBIGINT[]"
    step = lambda x: f"xor({x} >> 4, ({table})[1 + CAST({x} & 15 AS INT)])"
    each = step(step("xor(x, y)"))
    return rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), per AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))::UBIGINT[] AS b FROM per
), hashed AS MATERIALIZED (
  SELECT run, n, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda x, y: {each}), 4294967295) AS BIGINT) AS h FROM bytes
), slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS MATERIALIZED (
  SELECT DISTINCT word, other, other_n FROM (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word
  )
), counted AS (
  SELECT word, count(*) AS n_near FROM near GROUP BY word
), best AS (
  SELECT word, other, other_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) = 1
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
  FROM w LEFT JOIN counted c ON c.word = w.word LEFT JOIN best b ON b.word = w.word
), walk AS (
  SELECT word, word AS reached, 0 AS far FROM w UNION ALL SELECT k.word, f.form, k.far + 1 FROM walk k JOIN formed f ON f.word = k.reached WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(reached, far) AS root FROM walk GROUP BY word
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""


ORACLE_SQL = _oracle()
