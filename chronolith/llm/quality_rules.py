"""Quality rules as a short-circuit cascade.

Every rule is a sound test of one whole text. On a bounded sample each rule runs alone,
which gives its cost, and the sets of rules that reject the same documents. The cascade is
then ordered greedily: next comes the rule with the most rejections, among documents that
the rules before it pass, per second. A document is rejected at its first failing rule, so
the order changes the cost and never the verdict.

Signals (n_words and so on) are computed when a rule first asks for them and are kept for
the rules behind it. ``keep_good`` asks for nothing else; ``judge`` returns counts of every
document, so there the cascade saves only what no count needs.

Defined cases: null text has no words and fails ``few_words``; an empty table gives an
empty table; input columns named like the added ones are replaced; repeated rows get the
same verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.shared import SPACE, small_batches, spare, texts, without

SYMBOLS = "#*$%&|<>"
#: Documents, about, on which costs and selectivities are estimated.
SAMPLE_DOCS = 2_000
WINDOW = 5


class Signals:
    """What the rules ask of one text, each computed at most once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # of bytes: splits at space and \t-\r only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(*(w[k:] for k in range(WINDOW)))) if len(w) > WINDOW else []
        if len(set(windows)) == len(windows):
            return 0
        often, end, total = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if often[x] > 1:
                total += i + WINDOW - max(i, end)
                end = i + WINDOW
        return total

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        return sum(map(eq, self.words, self.words[1:]))


def few_words(s: Signals) -> bool:
    return s.n_words < 10


def repeated_words(s: Signals) -> bool:
    return 100 * s.n_repeat_words > 20 * s.n_words


def symbols(s: Signals) -> bool:
    return 10 * s.n_symbols > s.n_words


def word_length(s: Signals) -> bool:
    return not 2 * s.n_words <= s.word_chars <= 15 * s.n_words


def dup_lines(s: Signals) -> bool:
    return 100 * s.n_dup_lines > 30 * len(s.lines)


def stutters(s: Signals) -> bool:
    return 100 * s.n_stutters > 20 * s.n_words


def base_failed(s: Signals) -> bool:
    return few_words(s) or repeated_words(s)


Rule = Callable[[Signals], bool]
RULES: tuple[Rule, ...] = (few_words, repeated_words, symbols, word_length, dup_lines, stutters)
#: Signals that can be returned beside the verdict.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(cost: list[float], outcomes: dict[int, int]) -> list[int]:
    """Rule numbers by rejections per cost, given earlier rules; outcomes: documents by the bit set of rules that reject them."""
    left, order = list(range(len(cost))), []
    while left:
        best = max(left, key=lambda r: (sum(n for bits, n in outcomes.items() if bits >> r & 1) / max(cost[r], 1e-9), -cost[r], -r))
        order.append(best)
        left.remove(best)
        outcomes = {bits: n for bits, n in outcomes.items() if not bits >> best & 1}
    return order


def _measured(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    cost, outcomes = [0.0] * len(rules), Counter()
    for batch in batches:
        for text in texts(batch):
            bits = 0
            for r, rule in enumerate(rules):
                began = time.perf_counter()
                bits |= rule(Signals(text)) << r
                cost[r] += time.perf_counter() - began
            outcomes[bits] += 1
    yield pa.RecordBatch.from_pylist([{"bits": b, "docs": n, "cost": None} for b, n in outcomes.items()] + [{"bits": None, "docs": None, "cost": cost}], pa.schema([("bits", pa.int64()), ("docs", pa.int64()), ("cost", pa.list_(pa.float64()))]))


def calibrate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_docs: int = SAMPLE_DOCS, seed: int = 11) -> list[int]:
    """The cascade's order, from a sample of about ``sample_docs`` documents."""
    n = docs.count()
    sample = docs.select("text").sample(min(1.0, sample_docs / n), seed) if n else docs.select("text")
    got = sample.mapInArrow(lambda it: _measured(it, rules), "bits long, docs long, cost array<double>")
    sums = got.groupBy("bits").agg(F.sum("docs").alias("docs"), *[F.sum(F.col("cost")[r]).alias(f"c{r}") for r in range(len(rules))]).collect()  # a row for each set of rules at most
    outcomes = {x["bits"]: x["docs"] for x in sums if x["bits"] is not None}
    cost = next(([x[f"c{r}"] or 0.0 for r in range(len(rules))] for x in sums if x["bits"] is None), [0.0] * len(rules))
    return order_rules(cost, outcomes)


def _verdict(texts_: Iterator[pa.Array], cascade: tuple[Rule, ...]) -> Iterator[pa.Array]:
    for batch in texts_:
        yield pa.array([not any(rule(s) for rule in cascade) for s in map(Signals, batch.to_pylist())], pa.bool_())


def _counted(texts_: Iterator[pa.Array], cascade: tuple[Rule, ...], counts: tuple[str, ...]) -> Iterator[pa.Array]:
    kinds = [*[(c, pa.int64()) for c in counts], ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    for batch in texts_:
        rows = []
        for s in map(Signals, batch.to_pylist()):
            kept = not any(rule(s) for rule in cascade)  # later rules' signals are left out where an earlier one rejects
            rows.append([*[getattr(s, c) for c in counts], base_failed(s), kept])
        columns = zip(*rows) if rows else [[]] * len(kinds)
        yield pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, counts: tuple[str, ...] = COUNTS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with the counts, base_failed and kept; only texts go to Python, only numbers come back."""
    small_batches(docs.sparkSession)
    added = [*counts, "base_failed", "kept"]
    docs = without(docs, added)
    cascade = tuple(rules[r] for r in calibrate(docs, rules, sample_docs))
    kind = ", ".join([*[f"{c}: bigint" for c in counts], "base_failed: boolean", "kept: boolean"])

    @F.arrow_udf(f"struct<{kind}>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _counted(batches, cascade, counts)

    (judged,) = spare(docs, "judged")
    made = docs.withColumn(judged, counted(F.col("text")))
    return made.select(*[f"`{c}`" for c in docs.columns], *[F.col(judged)[c].alias(c) for c in added])


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents that no rule rejects; only verdicts come back from Python, and Spark filters by them."""
    small_batches(docs.sparkSession)
    cascade = tuple(rules[r] for r in calibrate(docs, rules, sample_docs))

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _verdict(batches, cascade)

    return docs.where(good(F.col("text")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).drop("text")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 4)) AS i, w FROM words WHERE len(w) > 5
), named AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM windows
), often AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM named
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM often WHERE n > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, e'\n')) AS l FROM words) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(generate_series(1, len(w) - 1), lambda i: w[i] = w[i + 1])) AS n_stutters
  FROM words d LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 10 * n_symbols > n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND NOT 100 * n_dup_lines > 30 * n_lines
       AND NOT 100 * n_stutters > 20 * n_words AS kept
FROM judged
"""
