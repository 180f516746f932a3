"""Min-max near duplicates against brute force over all pairs, and the signature's statistics."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import minmax_dedup, ngram_join

DOCS = "doc_id long, text string, lang string"


def gold(rows, n=4, percent=80):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None) for i, t in rows], DOCS).repartition(4)


def shown(df):
    return sorted(map(tuple, df.collect()))


def test_minima_and_maxima_estimate_the_similarity():
    rng, hasher = np.random.default_rng(2), minmax_dedup.MinMax(permutations=2_000, seed=5)
    for similarity in (0.3, 0.8, 0.95):
        union = rng.integers(0, 1 << 64, 400, np.uint64)
        own = int(400 * (1 - similarity) / 2)
        a, b = (hasher.signature(x) for x in (union[own:], union[: len(union) - own]))
        same = a == b
        true = (400 - 2 * own) / 400
        assert abs(same.mean() - true) < 0.03 and abs(same[:2000].mean() - true) < 0.05 and abs(same[2000:].mean() - true) < 0.05


def test_signatures_do_not_depend_on_chunks(monkeypatch):
    tokens = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 5_000, np.uint64))
    whole = minmax_dedup.MinMax().signature(tokens)
    monkeypatch.setattr(minmax_dedup, "CHUNK", 7)
    assert (minmax_dedup.MinMax().signature(tokens) == whole).all()


def test_a_band_has_each_function_once():
    hasher = minmax_dedup.MinMax(permutations=120, band=5)
    assert hasher.bands.shape == (48, 5) and sorted(hasher.bands.ravel().tolist()) == list(range(240))
    assert all(len({i % 120 for i in band}) == 5 for band in hasher.bands.tolist())


def mutants(rng, words=120, copies=60):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            own[rng.randrange(len(own))] = f"m{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("short_list, block", [(6, 256), (1, 8)])
def test_groups_equal_brute_force(spark, monkeypatch, short_list, block):
    """Copies, links at the bound, a long text, families that only blocks join; with short lists only, and with stars and small blocks."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short_list)
    monkeypatch.setattr(minmax_dedup, "SHORT_LIST", short_list)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    monkeypatch.setattr(ngram_join, "OWN_BLOCK", block // 4)
    rng = random.Random(12)
    many = mutants(rng) + mutants(rng, 9, 30) + mutants(rng, 40, 20)
    rows = [(i * 3, t) for i, t in enumerate(many)]
    rows += [(500 + i, many[i].upper()) for i in range(10)]
    base = [f"b{k}" for k in range(200)]
    for i in range(40):
        own = list(base)
        for k in range(7 + i % 3):
            own[(i * 5 + 13 * k) % 200] = f"m{i}x{k}"
        rows += [(1000 + i, " ".join(own)), (1100 + i, " ".join(own[:-1] + [f"end{i % 7}"]))]
    rows += [(700, "a b"), (701, "A  b"), (702, ""), (703, None), (704, " ".join(f"x{k}" for k in range(12))), (705, " ".join(f"x{k}" for k in range(14))), (706, "É a b c d"), (707, "é a b c d")]
    rows += [(710, " ".join(f"long{k}" for k in range(20_000))), (711, " ".join(f"long{k}" for k in range(19_000)))]
    rng.shuffle(rows)
    assert shown(minmax_dedup.label(spark, docs_of(spark, rows))) == gold(rows)


def test_odd_rows(spark):
    rows = [(1, "same text of five words"), (None, "same text of five words"), (2, "same text of five words"), (2, "same text of five words"), (None, "alone here without an id"), (3, None), (None, " \t\n\x0b"), (4, "")]
    df = docs_of(spark, rows).withColumn("kept", F.lit("x")).withColumn("row", F.lit(7)).withColumn("cls", F.lit(1))
    got = sorted(map(str, map(tuple, minmax_dedup.label(spark, df).collect())))
    want = [(1, 2, 1, True), (None, 2, 1, False), (2, 2, 1, False), (2, 2, 1, False), (None, 2, None, True), (3, 0, 3, True), (None, 0, None, True), (4, 0, 4, True)]
    assert got == sorted(map(str, want))
    one = minmax_dedup.keep_one(spark, df)
    assert one.columns == df.columns and sorted(map(str, (r["doc_id"] for r in one.collect()))) == sorted(map(str, [1, None, None, 3, None, 4]))


def test_empty_table(spark):
    assert minmax_dedup.label(spark, docs_of(spark, [(1, "x")]).where("false")).count() == 0


def test_copies_signed_twice_meet_their_class(spark, monkeypatch):
    monkeypatch.setattr(minmax_dedup, "HELD_NAMES", 1)
    rows = [(i, ["one text with some words", "two text with some words"][i % 2]) for i in range(20)]
    assert shown(minmax_dedup.label(spark, docs_of(spark, rows).coalesce(1))) == gold(rows)
