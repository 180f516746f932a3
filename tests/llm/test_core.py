"""The plain Python parts of the corpus operators against brute force."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from chronolith.llm import html_extract, line_dedup, ngram_join, packing, perfect_hash, quality_rules, token_files, topk_search, warc

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_perfect_hash_is_minimal_and_turns_strangers_away():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 77, 5_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sizes, bits, slot = perfect_hash.build(keys)
        assert sorted(slot.tolist()) == list(range(len(keys)))
        assert (perfect_hash.Slots(sizes, bits)(keys) == slot).all()


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(300):
        lengths = sorted(rng.sample(range(40), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 5)
        padded = lambda ends: sum(c * min(e for e in ends if e >= x) for x, c in zip(lengths, counts))  # noqa: B023, E731
        best = min(padded([*(lengths[i] for i in cut), lengths[-1]]) for r in range(min(k, len(lengths))) for cut in combinations(range(len(lengths) - 1), r))
        ends = packing.boundaries(lengths, counts, k)
        assert len(ends) <= k and padded(ends) == best
    assert packing.boundaries([], [], 4) == []


def test_search_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, d = rng.integers(1, 600), rng.integers(1, 20)
        vectors = (rng.integers(-40, 40, (n, d)) * rng.integers(1, 9)).astype(np.int32)
        ids = rng.permutation(n).astype(np.int64)
        shard = topk_search.Shard(ids, vectors)
        for _ in range(4):
            i = rng.integers(0, n)
            query = vectors[i] if rng.random() < 0.7 else rng.integers(-3, 3, d).astype(np.int32)
            score = vectors.astype(np.int64) @ query.astype(np.int64)
            others = np.flatnonzero(ids != ids[i])
            best = others[np.lexsort((ids[others], -score[others]))[:10]]
            found, scores = shard.top(int(ids[i]), query, 10)
            assert found.tolist() == ids[best].tolist() and scores.tolist() == score[best].tolist()


def test_encoder_equals_the_library_and_shards_round_trip():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(2)
    odd = ["a b", "a  b", "\nx", "x\n", "x\n\ny", " lead", "tr ", "", "it's 's 12ab", "x <|endoftext|> y", "a b", "a\tb", "don't\nwon't stop", "ab " * 3000]
    batch = odd + ["".join(rng.choice(" ab\n'1.é́½²") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    encoder, plain = token_files.Encoder(path), Tokenizer.from_file(path)
    gold = [e.ids for e in plain.encode_batch(batch, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode([*batch, None])] == [*gold, []]
    ids = [np.array([*g, 0], encoder.kind) for g in gold]
    shard = token_files.Shard(token_files.pack([None, *range(1, len(ids))], ids, encoder.vocabulary))
    assert len(shard.rules) > 0 and len(shard.symbols) < sum(map(len, ids)) and shard.doc_ids[0] is None
    for i, own in enumerate(ids):
        a = rng.randint(0, len(own))
        b = rng.randint(a, len(own))
        assert shard.ids(i).tolist() == own.tolist() and shard.ids(i, a, b).tolist() == own[a:b].tolist()
    assert zlib.crc32(shard.ids(0).astype("<u4").tobytes()) == zlib.crc32(np.array(gold[0] + [0], "<u4").tobytes())


def test_shards_replace_pairs_until_none_is_frequent():
    rng = np.random.default_rng(3)
    passage = rng.integers(1, 50_000, 64)
    docs = [np.r_[passage, rng.integers(1, 50_000, 5)].astype("<u2") for _ in range(2_000)]
    docs += [np.array(x, "<u2") for x in ([7] * 5_001, [7], [1, 2, 1, 2, 1], [3] * 15)]
    shard = token_files.Shard(token_files.pack(list(range(len(docs))), docs, 50_257))
    assert len(shard.ids(0)) == 69 and shard.ends[0] == 6  # the passage is one symbol
    assert all((shard.ids(i) == d).all() and (shard.ids(i, 3, 9) == d[3:9]).all() for i, d in enumerate(docs))
    last = set((shard.ends - 1).tolist())
    left: dict = {}
    symbols, before = shard.symbols.tolist(), -2
    for i, two in enumerate(zip(symbols, symbols[1:])):
        if i in last or two[0] == two[1] and before == i - 1 and symbols[i - 1] == two[0]:
            continue
        before = i if two[0] == two[1] else -2
        left[two] = left.get(two, 0) + 1
    assert max(left.values()) < token_files.MIN_PAIRS == 8


def test_shards_go_beyond_sixteen_bits():
    pairs = np.arange(2_000).reshape(-1, 2)
    docs = [np.array(p, "<u2") for p in pairs.tolist() * 8]
    shard = token_files.Shard(token_files.pack(list(range(len(docs))), docs, 65_000))
    assert len(shard.rules) == 1_000 and shard.symbols.max() == 65_999 and len(shard.symbols) == len(docs)
    assert all((shard.ids(i) == d).all() for i, d in enumerate(docs))


def test_html_keeps_the_article_and_nothing_else():
    page = (
        '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body><header>Site</header>'
        '<div class="cookie-notice">We use cookies</div><nav><ul><li><a href="/a">A</a></li></ul></nav><div id="main"><h1>T &amp; x</h1>'
        "<p>a<br>b <i>c</i>d<p>e&nbsp;f<ul><li>one<li>two</ul><table><tr><td>x<td>y</table><form><p>send</p></form>"
        '<div class="comments"><p>first!</p></div></div><aside>side</aside><!-- <p>no</p> --><footer>z</footer>'
    )
    assert html_extract.main_text(page) == "T & x\na b cd\ne f\none\ntwo\nx\ny"
    assert html_extract.main_text("<body><div>out</div><article><h2>in</h2><p>side</article>") == "in\nside"
    assert html_extract.main_text('<p>good <button>Share</button>text <span class="ad">buy</span></p><div class="post-header"><h1>T</h1></div><p>x <span class="ad">bad<p>next') == "good text\nT\nx\nnext"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p>") == ""
    assert html_extract.main_text("plain &lt;text&gt;\n\n here") == "plain <text> here"


def test_quality_signals():
    s = quality_rules.Signals("a b c d e x a b c d e\n#\n#\n \n")
    assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == (13, 13, 2, 1, 10)
    empty = quality_rules.Signals(None)
    assert (empty.n_words, empty.word_chars, empty.n_dup_lines, empty.n_repeat_words) == (0, 0, 0, 0) and quality_rules.base_failed(empty)
    assert quality_rules.Signals("a a a a a a a").n_repeat_words == 7
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
        assert quality_rules.Signals(" ".join(words)).n_repeat_words == len(covered)


def test_rules_are_ordered_by_rejections_per_cost():
    assert quality_rules.order_rules([1.0, 1.0, 5.0], {0b001: 10, 0b010: 20, 0b100: 60, 0b110: 1}) == [1, 2, 0]
    assert quality_rules.order_rules([1.0, 2.0], {}) == [0, 1]


def test_line_keys():
    at, keys = line_dedup._keys(["  " + "A" * 40 + "\t", "a" * 40, "a" * 39, ""], 40)
    assert at == [0, 1] and keys[:16] == keys[16:]


def test_shingles_and_overlaps():
    assert len(ngram_join.shingles(None)) == len(ngram_join.shingles(" \n")) == 0
    assert len(ngram_join.shingles("a b")) == 1 and len(ngram_join.shingles("a b c d e f")) == 2
    assert ngram_join.shingles("A b").tolist() == ngram_join.shingles("a\tB ").tolist()
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 30_000, rng.integers(0, 9_000))) for _ in range(9)]
    got = ngram_join.overlaps(sets[:4], sets[4:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_warc_records_round_trip():
    raw = warc.record(7, "http://a.b/c\r\nX: y", b"<p>\r\n\r\n</p>", __import__("hashlib").sha256(b"<p>\r\n\r\n</p>").hexdigest(), None)
    got = warc.parse(raw)
    assert (got["page_id"], got["record_type"], got["payload"], got["refers_to"], got["url"]) == (7, "response", b"<p>\r\n\r\n</p>", None, "http://a.b/c%0D%0AX: y")
    again = warc.parse(warc.record(None, None, b"x" * 100, "ab", 7))
    assert (again["page_id"], again["record_type"], again["payload_bytes"], again["payload_digest"], again["refers_to"]) == (None, "revisit", 100, "ab", 7)
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"<p>", b"<q>"))
