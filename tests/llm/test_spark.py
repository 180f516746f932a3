"""The corpus operators on Spark: odd rows, empty tables, clashing names, brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronolith.llm import components, html_extract, license_scan, line_dedup, mixing, ngram_join, packing, quality_rules, token_files, topk_search, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


LINE = "this line is long enough to be a key of its own"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, an empty and a long text, ties and repeated rows."""
    rows = [(i, f"{LINE}\nword{i} and more words of document number {i} follow here", "s1") for i in range(7)]
    rows += [(None, "no id but some words of text in here", None), (20, None, "s2"), (21, "", None), (22, "x " * 30_000, "s2"), (23, "dup row", "s3"), (23, "dup row", "s3"), (24, " \t\n\x0b", "")]
    return docs_of(spark, rows)


def empty(df):
    return df.where("false")


@pytest.mark.parametrize("inline", [16, 0])
def test_line_dedup(spark, odd, monkeypatch, inline):
    monkeypatch.setattr(line_dedup, "INLINE_SHARDS", inline)
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(spark, odd).collect()}
    assert {(i, 2, 1) for i in range(6)} | {(6, 2, 0), (None, 1, 0), (20, 1, 0), (21, 1, 0), (24, 2, 0)} <= got
    again = line_dedup.dedup_lines(spark, odd.withColumn("N_dropped", F.lit("x")), shard_keys=1)
    assert again.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert {r["text"] for r in again.where("doc_id = 20").collect()} == {None}
    assert line_dedup.dedup_lines(spark, empty(odd)).count() == 0


@pytest.mark.parametrize("inline", [16, 0])
def test_line_dedup_equals_brute_force(spark, monkeypatch, inline):
    monkeypatch.setattr(line_dedup, "INLINE_SHARDS", inline)
    rng = random.Random(9)
    pool = [f"  {chr(97 + k) * rng.choice([38, 40, 44])}{k % 7}\t" for k in range(30)]
    rows = [(rng.randint(0, 40), "\n".join(rng.choice(pool).swapcase() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 12))), "s") for _ in range(60)]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = defaultdict(set)
    for i, t, _ in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    gold = sorted((i, "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i)) for i, t, _ in rows)
    got = line_dedup.dedup_lines(spark, docs_of(spark, rows), shard_keys=4)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == gold and gone


def test_line_index_survives_clashes_of_hash_halves():
    import numpy as np
    import pandas as pd

    hashes = np.array([(5, 7), (5, 8), (9, 7), (1, 2)], np.int64)
    row = line_dedup._shard(pd.DataFrame({"hi": hashes[:, 0], "lo": hashes[:, 1], "n_docs": [6, 7, 8, 9], "keeper": [1, 2, 3, 4], "shard": 0})).iloc[0].to_dict()
    rows, counts, keepers = line_dedup._look_up(line_dedup._arrays(row), np.array([*hashes.tolist(), (5, 9), (4, 4)], np.int64))
    assert (rows.tolist(), counts.tolist(), keepers.tolist()) == ([0, 1, 2, 3], [6, 7, 8, 9], [1, 2, 3, 4])


def test_line_dedup_keeps_columns_named_like_its_own(spark, odd, monkeypatch):
    monkeypatch.setattr(line_dedup, "INLINE_SHARDS", 0)
    more = odd.withColumn("_gone", F.lit("a")).withColumn("_doc", F.lit("b")).withColumn("_print", F.lit("c"))
    got = line_dedup.dedup_lines(spark, more)
    assert got.columns == [*more.columns, "n_lines", "n_dropped"] and {(r["_gone"], r["_doc"], r["_print"]) for r in got.collect()} == {("a", "b", "c")}


def test_mixing(spark, odd):
    rows = mixing.plan_mix(spark, odd.withColumn("rate", F.lit(1))).collect()
    assert len(rows) == 14
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert all(r["copies"] <= 2 and r["target"] <= 2 * r["source_size"] + 1e-9 for r in rows)
    assert [r["target"] for r in rows if r["source"] == ""] == [0.0]
    mixed = mixing.mix(spark, odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.plan_mix(spark, empty(odd)).count() == mixing.mix(spark, empty(odd)).count() == 0


def test_mixing_with_many_sources_joins_by_salt(spark, monkeypatch):
    docs = docs_of(spark, [(i, "a b c", None if i % 5 == 0 else f"s{i % 5}") for i in range(200)])
    plain = sorted(map(str, mixing.plan_mix(spark, docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.plan_mix(spark, docs).collect())) == plain


def test_targets_equal_the_stated_rounds(spark):
    rng = random.Random(6)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 5, 300, 10_000]) for _ in range(rng.randint(1, 9))]
        sources = [f"s{i}" for i in range(len(sizes))]
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), 1.5 * sum(sizes)
        while left > 1e-9 and open_:
            share = left / sum(weights[i] for i in open_)
            left = 0.0
            for i in sorted(open_):
                target[i] += share * weights[i]
            for i in sorted(open_):
                if target[i] >= 2 * sizes[i]:
                    left += target[i] - 2 * sizes[i]
                    target[i] = 2.0 * sizes[i]
                    open_.discard(i)
        got = mixing.source_rates(spark.createDataFrame(list(zip(sources, sizes)), "source string, size long")).collect()
        assert {r["source"]: r["target"] for r in got} == pytest.approx(dict(zip(sources, target)))


def test_quality_rules(spark, odd):
    judged = {(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in quality_rules.judge(odd.withColumn("KEPT", F.lit(1))).collect()}
    assert {(0, 22, False, True), (None, 9, True, False), (20, 0, True, False), (22, 30_000, True, False), (24, 0, True, False)} <= judged
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(7))
    assert quality_rules.judge(empty(odd)).count() == quality_rules.keep_good(empty(odd)).count() == 0


def jaccard_components(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("fragment_tokens, hot_texts", [(400, 2), (4_000_000, 2), (400, 1_000), (4_000_000, 1_000)])
def test_ngram_join_equals_brute_force(spark, fragment_tokens, hot_texts):
    """A long text's mutants: long lists, links at the bound, and members that link with none but share the rarest shingles."""
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            own[rng.randrange(len(own))] = f"m{rng.randint(0, 10**6)}"
        rows.append((i * 3, " ".join(own), "s"))
    rows += [(500 + i, rows[i][1], "s") for i in range(10)]
    rows += [(600 + i, " ".join(base[:40] + [f"u{i}x{k}" for k in range(60)]), "s") for i in range(10)]
    rows += [(700, "a b", "s"), (701, "A  b", "s"), (702, "", "s"), (703, None, "s"), (704, "a b c d e f g h i j", "s"), (705, "a b c d e f g h i j k", "s")]
    rng.shuffle(rows)
    got = ngram_join.label(spark, docs_of(spark, rows), fragment_tokens=fragment_tokens, hot_texts=hot_texts)
    assert sorted(map(tuple, got.collect())) == jaccard_components(rows)


def test_tail_links_find_what_stars_miss(spark, monkeypatch):
    """Two families that a star's centre does not join are joined block against block."""
    rng = random.Random(31)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(40):
        own = list(base)
        for k in range(7 + i % 3):
            own[(i * 5 + 13 * k) % 200] = f"m{i}x{k}"
        rows.append((i, " ".join(own), "s"))
        rows.append((100 + i, " ".join(own[:-1] + [f"end{rng.randint(0, 9)}"]), "s"))
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    assert sorted(map(tuple, ngram_join.label(spark, docs_of(spark, rows)).collect())) == jaccard_components(rows)


def test_ngram_join_odd_rows(spark, odd):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.label(spark, odd.withColumn("cls", F.lit(1))).collect()), key=str)
    assert (20, 0, 20) in got and (24, 0, 24) in got and got.count((23, 1, 23)) == 2 and (22, 1, 22) in got and (None, 5, None) in got
    assert ngram_join.label(spark, empty(odd)).count() == 0
    one = ngram_join.keep_one(spark, docs_of(spark, [(1, LINE, "a"), (2, LINE, "a"), (3, None, "a"), (None, LINE, "a")]))
    assert sorted((r["doc_id"] for r in one.collect()), key=str) == [1, 3, None]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (5, 5)]
    got = components.components(spark, spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(1, 31)] + [(95, 90), (100, 90)]
    assert components.components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_packing(spark, odd):
    rows = packing.pack(odd.withColumn("Batch", F.lit(1)), buckets=3, budget=64).collect()
    assert len(rows) == 14
    batches = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] <= r["bucket_length"]
        batches[r["batch_id"]].append(r)
    for own in batches.values():
        assert len({r["bucket_length"] for r in own}) == 1 and sorted(r["row_in_batch"] for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0]["bucket_length"] <= 64
    assert packing.pack(empty(odd)).count() == 0


def test_packing_splits_a_hot_bucket(spark):
    docs = docs_of(spark, [(i, "a " * (1 + i % 90), "s") for i in range(900)])
    out = packing.pack(docs, buckets=2, budget=100, part_rows=32)
    assert out.select("bucket", "part").distinct().count() > 2 and out.count() == 900
    assert packing.histogram(docs.select(mixing.word_count().alias("n_tokens"))) == (list(range(1, 91)), [10] * 90)
    clash = packing.pack(docs.withColumn("_key", F.lit("k")).withColumn("_row", F.lit("r")), buckets=2)
    assert {(r["_key"], r["_row"]) for r in clash.collect()} == {("k", "r")}


def test_packing_query_equals_brute_force(spark, tmp_path):
    """Every document once, batches within the budget, and no set of 16 boundaries that pads less."""
    rng = random.Random(7)
    sizes = [rng.choice([0, 1, 2, 3, 5, 40, rng.randint(6, 400), rng.randint(6, 400)]) for _ in range(700)]
    spark.createDataFrame([(i, " ".join("w" for _ in range(n)) if n else None) for i, n in enumerate(sizes)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op5_packing(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == list(enumerate(sizes))
    lengths = sorted(set(sizes))
    count = [sizes.count(x) for x in lengths]
    total = lambda i, j: lengths[j - 1] * sum(count[i:j])  # noqa: E731  padded words of a bucket
    best = [[0 if not j else float("inf") for j in range(len(lengths) + 1)]]
    for _ in range(16):
        best.append([0 if not j else min(best[-1][i] + total(i, j) for i in range(j)) for j in range(len(lengths) + 1)])
    assert sum(r["bucket_length"] for r in rows) == min(b[-1] for b in best[1:])
    batches = defaultdict(list)
    for r in rows:
        batches[r["batch_id"]].append(r)
    for own in batches.values():
        assert sorted(r["row_in_batch"] for r in own) == list(range(len(own))) and len({r["bucket_length"] for r in own}) == 1
        assert all(r["n_tokens"] <= r["bucket_length"] for r in own) and (len(own) == 1 or len(own) * own[0]["bucket_length"] <= 16_384)


def test_packing_takes_any_number_of_lengths():
    lengths = list(range(1, 150_001))
    ends = packing.boundaries(lengths, [1] * len(lengths), 3)
    assert ends[-1] == 150_000 and abs(ends[0] - 50_000) <= 1 and abs(ends[1] - 100_000) <= 1


def test_mixing_repeats_and_keeps_columns(spark):
    docs = docs_of(spark, [(i, "a b c", "s") for i in range(20)]).withColumn("_copy", F.lit("c")).withColumn("_source", F.lit("d"))
    mixed = mixing.mix(spark, docs, share=150.0, cap=200.0)
    assert mixed.columns == docs.columns and mixed.count() == 20 * 150 and mixing.mix(spark, docs, share=0.0).count() == 0


def test_license_scan(spark):
    mit = license_scan.LICENSES[0][1]
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;"), "s"), (2, mit + " extra", "s"), (3, None, "s"), (4, " \n", "s"), (5, "This work is licenced under the GNU General Public Licence, version 3", "s"), (5, mit, "s")]
    got = sorted(((r["doc_id"], r["license_id"]) for r in license_scan.scan(spark, docs_of(spark, rows).withColumn("license_id", F.lit("x"))).collect()), key=str)
    assert got == [(1, "MIT"), (2, None), (3, None), (4, None), (5, "GPL-3.0"), (5, "MIT")]
    assert license_scan.scan(spark, docs_of(spark, [])).count() == 0


def test_license_scan_of_long_and_clashing_rows(spark):
    mit = license_scan.LICENSES[0][1]
    docs = docs_of(spark, [(1, "word " * 400_000, "s"), (2, "Copyright 2020 A\n" * 20_000 + mit, "s"), (2, mit, "s")]).withColumn("_plain", F.lit("p")).withColumn("_shown", F.lit("q")).withColumn("LICENSE_DIGEST", F.lit("x"))
    got = license_scan.scan(spark, docs)
    assert got.columns == [c for c in docs.columns if c != "LICENSE_DIGEST"] + ["license_digest", "license_id"]
    assert sorted(((r["doc_id"], r["license_id"], r["_plain"], r["_shown"]) for r in got.collect()), key=str) == [(1, None, "p", "q"), (2, "MIT", "p", "q"), (2, "MIT", "p", "q")]


def test_scratch_tables_can_be_cleared(spark):
    import os

    from chronolith.llm import shared

    _, path = shared.kept(spark, spark.range(3), "some")
    assert os.path.isdir(path.removeprefix("file://")) and shared.clear(spark) > 0
    assert not os.path.exists(path.removeprefix("file://")) and shared.clear(spark) == 0


def test_every_license_is_found_at_every_width(spark):
    import re
    import textwrap

    stated = re.compile(r"(?i)^\s*(copyright\s*(\(c\)|\d{4}|\[|<)|all rights reserved)")
    known = [*license_scan.LICENSES, *license_scan.MORE, *license_scan.whole_texts()]
    rows = []
    for name, text in known:
        runs: list[list[str]] = [[]]
        for line in text.split("\n"):
            if not line.strip() or stated.match(line):
                runs += [[line], []]
            else:
                runs[-1].append(line.strip())
        for width in range(60, 101):
            rows.append((name, "\n".join(r[0] if len(r) == 1 and stated.match(r[0]) else "\n".join(textwrap.wrap(" ".join(r), width, break_long_words=False, break_on_hyphens=False)) for r in runs if r)))
    docs = spark.createDataFrame(rows, "name string, text string").repartition(8)
    assert docs.where("text RLIKE '(?m)^copyright notice and'").count() > 0
    assert [r.asDict() for r in license_scan.scan(spark, docs).where("license_id IS NULL OR license_id <> name").select("name", "license_id").distinct().collect()] == []


def test_license_scan_drops_statements_only_and_takes_a_table(spark, monkeypatch):
    mit = license_scan.LICENSES[0][1]
    heads = ["Copyright 2020 A", "Copyright (c) A", "(c) 2020 A", "(c) A Inc., 2020", "© A", "Copyright by A", "Copyright A Inc. 2020", "Copyright A\nAll rights reserved.", "Copyright A"]
    rows = [(i, f"{h}\n\n{mit}", "s") for i, h in enumerate(heads)] + [(50, "Licensed under CC BY-NC 4.0.", "s"), (51, "My own terms.", "s"), (52, "one two three four five six seven", "s")]
    docs = docs_of(spark, rows)
    gold = {**{i: "MIT" for i in range(len(heads))}, 50: "CC-BY-NC-4.0", 51: None, 52: None}
    assert {r["doc_id"]: r["license_id"] for r in license_scan.scan(spark, docs).collect()} == gold
    table = spark.createDataFrame([("Own", "MY OWN terms"), ("Own2", "my own terms"), ("X", None), (None, "x")], "license_id string, text string")
    for most in (20_000, 3):
        monkeypatch.setattr(license_scan, "MAX_BROADCAST", most)
        got = license_scan.scan(spark, docs, table).collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["license_id"] for r in got} == {**gold, 51: "Own"}


def test_token_files(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    shards = token_files.write_shards(spark, odd.withColumn("part", F.lit(9)), path, shard_tokens=50)
    got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in token_files.read_shards(shards).collect())
    sizes = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in odd.collect())
    assert sorted((d, n) for _, d, n in got) == sizes and [d for _, d, _ in got] == [d for d, _ in sizes]
    assert [s for s, _, _ in got] == [sum(n for _, n in sizes[:i]) for i in range(len(sizes))]
    assert token_files.read_shards(token_files.write_shards(spark, empty(odd), path)).count() == 0


def test_token_query_equals_the_library(spark, tmp_path):
    """Whole texts by the library itself: start, n_tokens and crc32 of every document."""
    import zlib

    import numpy as np
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    words = ["word", "straße", "été,", "x1%", "***", "\n", "日本", "don't", "naïve.", "WORD!", "<|endoftext|>", "12:30"]
    rng = random.Random(3)
    rows = [(i * 2, " ".join(rng.choice(words) + rng.choice(["", "", "a", "é"]) for _ in range(rng.randint(1, 60))).replace(" \n ", rng.choice(["\n", " \n", "\n\n"]))) for i in range(150)]
    rows += [(1, None), (3, ""), (5, " lead and  double\ttab "), (7, "long " * 20_000), (9, "a\u00a0b\u2003c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer, start, want = Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0, []
    for doc_id, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.op4_token_files(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == want


PAGES = "page_id long, url string, html string"


def test_warc(spark):
    big = "<p>" + "x" * 200
    rows = [(3, "http://b.example.com/z?q=1", big), (1, "http://www.example.com/a", big), (2, None, big), (4, "http://example.com", "small"), (5, "http://example.com", "small"), (6, "u", None), (None, "http://example.com/n", big), (1, "http://www.example.com/a", big)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("key", F.lit("k")).withColumn("payload_digest", F.lit("d")).withColumn("origin", F.lit(9))
    folder, index = warc.write_archives(spark, pages)
    keyed = lambda p: p.select(warc.capture_key(F.col("url")).alias("key"), "page_id")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.look_up(spark, folder, index, keyed(pages)).collect()), key=str)
    assert got == sorted([(3, 203, "revisit", 1), (1, 203, "response", None), (2, 203, "revisit", 1), (4, 5, "response", None), (5, 5, "response", None), (6, 0, "response", None), (None, 203, "revisit", 1), (1, 203, "response", None)], key=str)
    look = warc.CaptureIndex(folder, index)
    assert [x["page_id"] for x in look.find("com,example)")] == [4, 5] and look.find("com,example)/none") == []
    assert [x["payload"] for x in look.find("com,example,www)/a")] == [big.encode()] * 2
    none = spark.createDataFrame([], PAGES)
    folder, index = warc.write_archives(spark, none)
    assert warc.look_up(spark, folder, index, keyed(pages)).count() == warc.look_up(spark, folder, index, keyed(none)).count() == 0


def test_warc_of_very_long_pages(spark):
    rows = [(1, "http://a.com/1", "x" * 3_000_000), (2, "http://a.com/1", "x" * 3_000_000), (3, "http://a.com/1", "ü" * 2_000_000)]
    pages = spark.createDataFrame(rows, PAGES)
    folder, index = warc.write_archives(spark, pages)
    got = warc.look_up(spark, folder, index, pages.select(warc.capture_key(F.col("url")).alias("key"), "page_id")).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [(1, 3_000_000, "response", None), (2, 3_000_000, "revisit", 1), (3, 4_000_000, "response", None)]


def test_capture_index_over_many_blocks(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 9}.example.com/{i // 3}", f"page {i}") for i in range(300)], PAGES).coalesce(2)
    folder, index = warc.write_archives(spark, pages, block_records=7, archive_bytes=4_000)
    look = warc.CaptureIndex(folder, index)
    for i in range(0, 300, 23):
        assert i in [x["page_id"] for x in look.find(f"com,example,h{i % 9})/{i // 3}")]
    assert index.agg(F.sum("n_blocks")).first()[0] > 40
    wanted = pages.select(warc.capture_key(F.col("url")).alias("key"), "page_id")
    assert sorted(r["page_id"] for r in warc.look_up(spark, folder, index, wanted).collect()) == list(range(300))
    assert sorted(r["page_id"] for r in warc.look_up(spark, folder, index, wanted.where("page_id % 7 = 0").union(wanted.limit(0))).collect()) == list(range(0, 300, 7))
    assert warc.look_up(spark, folder, index, spark.createDataFrame([("none", 1), ("com,example,h1)/0", 999), ("~", None)], "key string, page_id long")).count() == 0


def test_html_style_tree_cuts_what_a_site_repeats(spark):
    menu = "<div><span>Home</span><span>About us</span></div><div><b>Subscribe now</b> to our letter</div>"
    rows = [(i, f"http://site.com/{i}", f"<body>{menu}<section><p>story {i} is told here</p><p>and it goes on with {i * 7}</p></section></body>") for i in range(30)]
    rows += [(100, "http://lone.org/", f"<body>{menu}<p>alone</p></body>"), (101, None, None), (102, "x", ""), (102, "x", "")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("n_chars", F.lit("x"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(spark, pages).collect()}
    for i in range(30):
        text = f"story {i} is told here\nand it goes on with {i * 7}"
        assert got[i] == (text, len(text))
    assert got[100][0].endswith("alone") and "Home" in got[100][0] and got[101] == got[102] == ("", 0)
    assert html_extract.extract(spark, pages.where("false")).count() == 0


def test_html_keeps_mirrors_of_one_page(spark):
    plain, inner = "<body><div>one story</div><div>told again</div></body>", "<body><article><p>a</p><ul><li>b</li></ul><div>c</div></article></body>"
    rows = [(i, f"http://{h}/{i}", page) for i in range(8) for h, page in (("plain.com", plain), ("inner.com", inner))]
    got = {(r["url"][7:12], r["text"]) for r in html_extract.extract(spark, spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {("plain", "one story\ntold again"), ("inner", "a\nb\nc")}


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (100, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 0.5, 2.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.0001]), (7, [-1.0, 0.0001]), (0, [1.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk_search.search(spark, vectors, vectors.where("vec_id % 100 = 0"), k=3).select("query_id", "rank", "vec_id", "score").collect())
    same = 1024 * 1024 + 512 * 512
    assert got == [(0, 1, 1, same), (0, 2, 100, same), (0, 3, 7, -1024 * 1024), (100, 1, 0, same), (100, 2, 0, same), (100, 3, 1, same)]
    assert topk_search.search(spark, vectors.where("false"), vectors.where("false")).count() == 0


def test_search_is_exact_for_all_finite_numbers(spark):
    import numpy as np

    rng = random.Random(8)
    big = [3e6, -3e6, 1e16, -7e15, 1e300, -1e300, 1.7e308, 2.5, -0.001, 0.0, 16_000.0, -16_000.0]
    rows = [(i, [float(np.float64(rng.choice(big) if i % 3 == 0 else rng.uniform(-20_000, 20_000))) for _ in range(4)]) for i in range(60)]
    rows += [(60 + i, [9e15, 9e15, float(i), 0.0]) for i in range(6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top = float(np.finfo(np.float64).max)
    whole = {i: [int(np.floor(1024 * x)) if abs(1024 * x) < float("inf") else int(top if x > 0 else -top) for x in v] for i, v in rows}
    want = []
    for q in (0, 20, 40, 60):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:7]
        want += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scored)]
    got = topk_search.search(spark, vectors, vectors.where("vec_id % 20 = 0"), k=7, shard_rows=16, block_queries=3)
    assert sorted(map(tuple, got.collect())) == want
    assert topk_search.narrow_limit(63) < 1 << 25 and (topk_search.narrow_limit(1023) + 16) ** 2 * 1023 << 10 < 1 << 63


def test_topk_deals_shards_over_tasks_whatever_the_broadcast(spark):
    rng = random.Random(3)
    vectors = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(400)], "vec_id long, embedding array<double>, label int")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    usual = sorted(map(tuple, topk_search.search(spark, vectors, vectors.where("vec_id % 20 = 0"), shard_rows=16, block_queries=4).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = topk_search.search(spark, vectors, vectors.where("vec_id % 20 = 0"), shard_rows=16, block_queries=4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == usual
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "rangepartitioning(shard" in plan and "25)" in plan and "Join" not in plan


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    shared = " ".join(word() for _ in range(12))
    rows = []
    for i in range(40):
        text = "\n".join(" ".join(word() for _ in range(15)) for _ in range(3))
        rows.append((i, text + ("\n" + shared if i % 4 == 0 else ""), f"s{i % 3}"))
    rows += [(50 + i, rows[i][1], "s0") for i in range(5)] + [(60, "too short", "s1"), (61, None, "s1"), (62, "spam " * 50, "s2")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    good = [r for r in rows if not quality_rules.base_failed(quality_rules.Signals(r[1]))]
    holders = [i for i, t, _ in good if t.endswith(shared)]
    lined = [(i, t.removesuffix("\n" + shared) if i != max(holders) and len(holders) >= 5 else t, s) for i, t, s in good]
    alone = {c for _, _, c in jaccard_components(lined)}
    left = [r for r in lined if r[0] in alone]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    planned = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.plan_mix(spark, docs_of(spark, left)).collect()}
    copies = defaultdict(int)
    for r in out:
        copies[r["doc_id"], r["text"]] += 1
        assert r["n_chars"] == len(r["text"]) and r["n_tokens"] == len(r["text"].split()) <= r["bucket_length"]
    assert copies == {k: n for k, n in planned.items() if n}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


def test_digest_of_kept_text(spark, tmp_path):
    docs_of(spark, [(1, None, "s"), (2, "a\nb", "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["kept_sha256"] for r in line_dedup.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(b"").hexdigest(), 2: hashlib.sha256(b"a\nb").hexdigest()}
