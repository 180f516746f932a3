"""Vector codes: metric trees against every entry, the whole query's rules against a plain program, odd rows."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import vector_codes

ROWS = "vec_id long, embedding array<double>, label int, note string"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The contract, row by row: {(vec_id, label): (code, error, label_error, sha)} for rows of one length."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v], s) for i, v, s in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = vector_codes.cuts(len(kept[0][1]), parts)
    first = sorted(kept, key=lambda r: (r[0] is None, r[0]))[:entries]
    books = [[v[a:b] for _, v, _ in first] for a, b in cut]
    near = lambda book, x: min((sum((p - q) ** 2 for p, q in zip(e, x)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for book, (a, b) in zip(books, cut):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[near(book, v[a:b])[1]].append(v[a:b])
            for k, own in held.items():
                book[k] = [sum(c) // len(own) for c in zip(*own)]
    coded = [(i, s, [near(book, v[a:b]) for book, (a, b) in zip(books, cut)]) for i, v, s in kept]
    by = defaultdict(int)
    for _, s, found in coded:
        by[s] += sum(far for far, _ in found)
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((i is None, i, "".join(f"{k:02x}" for _, k in found), sum(far for far, _ in found), by[s], sha) for i, s, found in coded)


def shown(df):
    return sorted((r["vec_id"] is None, r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_tree_finds_what_every_entry_says():
    rng = np.random.default_rng(3)
    for k, d, spread in ((1, 3, 5), (2, 1, 2), (16, 8, 3), (16, 2, 1), (100, 4, 10), (256, 8, 4000), (40, 1, 1 << 25)):
        entries, points = (rng.integers(-spread, spread + 1, (n, d)) for n in (k, 500))
        points[: min(k, 50)] = entries[: min(k, 50)]  # on an entry, and among repeated ones
        index, far = vector_codes.MetricTree(entries).nearest(points)
        gaps = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        assert (index == gaps.argmin(axis=1)).all() and (far == gaps.min(axis=1)).all()


def test_tree_leaves_branches_out(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (64, 4))
    points = centres[rng.integers(0, 64, 2000)] + rng.integers(-5, 6, (2000, 4))
    tested, real = [], vector_codes.MetricTree._tested
    monkeypatch.setattr(vector_codes.MetricTree, "_tested", lambda self, e, p, rows: tested.append(len(rows)) or real(self, e, p, rows))
    vector_codes.MetricTree(centres).nearest(points)
    assert sum(tested) < 2000 * 64 / 2


def test_codes_equal_a_plain_program(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.0, rng.gauss(0, 1)]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(120)]
    rows += [(7, rows[7][1], 1), (500, None, 1), (501, [0.5] * 15 + [None], 2), (502, [float("nan")] * 16, 2), (503, [float("inf")] * 16, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(5)
    got, books = vector_codes.compress(spark, df)
    assert got.columns == ["vec_id", "label", "note", "code", "error", "codebooks_sha256", "label_error"]
    assert shown(got) == plain(rows)
    r = got.where("vec_id = 3").first()
    near = vector_codes.decode(r["code"], books[16])
    assert sum((a - math.floor(4096 * b)) ** 2 for a, b in zip(near, rows[3][1])) == r["error"]


def test_wide_components_and_small_tables(spark):
    rows = [(i, [1e300 if i == 2 else -1e12, 0.5 * i, -0.1, 3e15 * i, 1e-300, -0.0, 7.25, 1e9], 1) for i in range(5)]
    got, _ = vector_codes.compress(spark, spark.createDataFrame([(*r, "x") for r in rows], ROWS), parts=4, entries=3, rounds=2)
    most = vector_codes.MOST
    assert shown(got) == [(n, i, c, min(e, most), min(b, most), s) for n, i, c, e, b, s in plain(rows, 4, 3, 2)]


def test_odd_rows(spark):
    rows = [(None, [1.0, 2.0, 3.0], 1, None), (1, [1.0, 2.0, 3.0], 1, None), (2, [], None, "a"), (3, [0.5], 2, "b"), (3, [0.5], 2, "b")]
    df = spark.createDataFrame(rows, ROWS).withColumn("CODE", F.lit("x")).withColumn("_dims", F.lit("y"))
    got, books = vector_codes.compress(spark, df)
    assert sorted(books) == [0, 1, 3] and got.count() == 5 and got.columns[:5] == ["vec_id", "label", "note", "_dims", "code"]
    assert {r["_dims"] for r in got.collect()} == {"y"} and {r["error"] for r in got.collect()} == {0}
    assert [r["code"] for r in got.where("vec_id = 2").collect()] == ["00" * 8]
    none, books = vector_codes.compress(spark, df.where("false"))
    assert none.count() == 0 and books == {} and none.columns == got.columns
    bare, _ = vector_codes.compress(spark, df.select("vec_id", "embedding"), label=None)
    assert bare.columns == ["vec_id", "code", "error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vector_codes.compress(spark, df, entries=257)


def test_many_labels_join_by_salt(spark, monkeypatch):
    rows = [(i, [i * 0.01, (i * i % 7) * 0.3], None if i % 5 == 0 else i % 5, None) for i in range(100)]
    df = spark.createDataFrame(rows, ROWS)
    broadcast = shown(vector_codes.compress(spark, df, parts=2, entries=4)[0])
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert shown(vector_codes.compress(spark, df, parts=2, entries=4)[0]) == broadcast
