"""Spelling variants against brute force: every pair of words, by the definition of one edit."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolith.llm import spelling

DOCS = "doc_id long, text string, lang string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_pairs(words):
    words = sorted(words)
    return {frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


def brute(counted):
    """{word: (form, root, n, n_near, form_n)}."""
    near = {w: [] for w in counted}
    for a, b in map(tuple, brute_pairs(counted)):
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counted[x], x), default=None)
        form[w] = best if best is not None and counted[best] >= 10 * counted[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), counted[form[w]] if form[w] else None) for w, n in counted.items()}


def shown(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("long_list", [16, 2])
def test_near_pairs_equal_brute_force(spark, monkeypatch, long_list):
    monkeypatch.setattr(spelling, "LONG_LIST", long_list)  # 2: every list is divided until one place is open
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(220)}
    words |= {"shared" + x + "suffix" for x in "abcdefghijklmnopqrstuvwxyzéñ"} | {"sharedsuffix", "a" * 40, "a" * 41, "a" * 39 + "b", "aa", "a", "b", "ba"}
    got = spelling.near_pairs(spark, spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")).collect()
    pairs = [frozenset((r["u"], r["v"])) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute_pairs(words)


def test_variants_follow_forms_to_their_root(spark):
    counted = {"baseword": 4000, "basewords": 400, "basewordsx": 40, "basewordsxy": 4, "basewort": 400, "lonely": 7, "tie": 1, "tia": 10, "tib": 10, "tim": 2, "tin": 19}
    got = shown(spelling.variants(spark, spark.createDataFrame(list(counted.items()), "word string, n long")))
    assert got == brute(counted)
    assert got["basewordsxy"][:2] == ("basewordsx", "baseword") and got["tie"][0] == "tin" and got["lonely"][:2] == (None, "lonely")


def test_query_rules_on_odd_documents(spark):
    rng = random.Random(8)
    stems = ["organise", "organize", "Organisée", "colour", "favourite", "favorite", "naïveté", "behaviour", "ab"]
    texts = [" ".join(rng.choice(stems) for _ in range(rng.choice([3, 60]))) for _ in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1, texts[1], None), (None, "organise ORGANISE xİorganise", "en"), (90, None, "en"), (91, "", "en"), (92, "colourful1colourful " * 5000, None), (93, "x" * 200_000, "en"), (94, "x" * 200_000, "en")]
    counted = Counter()
    for i, t, _ in rows:
        own, run = Counter(), ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                own[run] += 1
                run = ""
        for run, n in own.items():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counted[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += n
    gold = brute({w: n for w, n in counted.items() if len(w) >= 7 and n >= 2})
    docs = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    assert shown(spelling.variants(spark, spelling.words(docs, slip=31))) == gold and len(gold) > 8


def test_counts_handed_on_early_add_up(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common common w{'abcdefghij'[i % 10] * 7}", "en") for i in range(50)], DOCS)
    monkeypatch.setattr(spelling, "HELD_WORDS", 2)
    assert dict(spelling.words(docs, least_length=6).collect()) == {"common": 100} | {"w" + c * 7: 5 for c in "abcdefghij"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert spelling.words(docs).count() == 0
    assert spelling.variants(spark, spelling.words(docs)).count() == 0
    one = spelling.variants(spark, spark.createDataFrame([("only", 3)], "word string, n long"))
    assert shown(one) == {"only": (None, "only", 3, 0, None)}


def test_crc_table_is_that_of_the_library():
    def crc(data):
        x = 0xFFFFFFFF
        for b in data:
            x ^= b
            for _ in range(2):
                x = (x >> 4) ^ spelling._crc_table()[x & 15]
        return x ^ 0xFFFFFFFF

    assert crc(b"12:caf\xc3\xa9") == zlib.crc32("12:café".encode())
