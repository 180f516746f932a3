"""Token-ID files under Re-Pair grammar compression.

Documents are range-partitioned and sorted by doc_id, encoded with a tokenizers file, and
gathered into shards of about ``shard_tokens`` ids. Within a shard frequent pairs of
symbols are replaced by nonterminals, a batch of the most frequent pairs a round, until no
pair comes MIN_PAIRS times, where a rule's 16 bytes are what its uses save; pairs never reach over a document's end, so each document stays a run of symbols
of its own. A shard keeps the rules, the expansion length of each rule, the symbols and a
document table: any document, or any range of its ids, is decoded alone.

A shard's bytes: ``RPID`` and version 2, then seven unsigned 32-bit numbers (2, vocabulary,
rules, symbols, documents, bits a symbol beyond 16, 0), then rules (pairs of 32-bit symbols),
expansion lengths (64 bits), document ids (signed 64 bits), a byte a document that is 1
where its id is null, ids of each document (64 bits), symbols of each document (64 bits),
the low 16 bits of each symbol, then for each further bit, from the 17th on, that bit of all
symbols, eight a byte, the first highest; all little-endian. Shards are rows of a Parquet folder, so their writing is
committed with Spark's tasks.

Defined cases: a null text is an empty one, only the end id; a null doc_id sorts first;
rows that share a doc_id follow each other in an order of their texts' hashes; an empty
table gives no shards and an empty result; columns other than doc_id and text are not kept.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolith.llm.shared import kept, small_batches, texts

#: Pairs tried in one round (and those as frequent as the last of them), and how often a pair must come to be worth a rule.
RULES_A_ROUND, MIN_PAIRS = 2_500, 8
#: Characters of text whose chunks a task makes distinct together.
BATCH_CHARS = 24_000_000
#: Chunks, those met twice in a batch, whose ids a worker keeps for its next texts: some 150 MB at most; then it begins anew.
KNOWN_CHUNKS = 1_000_000
#: White space, or pairs of it, that a text must not hold to be cut into chunks; it may hold single spaces and newlines.
UNSAFE = ("  ", "\n\n", " \n", "\n ", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Buckets in which a round counts pairs before it counts the frequent ones apart.
BUCKETS = 1 << 18
MAGIC = b"RPID\x02\x00\x00\x00"

SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, payload binary"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by a tokenizers file.

    A byte-level tokenizer without normalizer cuts text before it merges: a word with the
    single space or newline before it never merges with its neighbours. So the chunks of
    many texts are made distinct, each is encoded by the library once, and the ids are put
    together again. A word of letters goes straight to the library's model, without the
    cutting; texts with other white space, or with what may be a special token, are encoded
    whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in made.get("added_tokens") or []]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        self.chunked = made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and made["model"]["type"] == "BPE"
        self.unsafe = (*UNSAFE, *self.special)
        self.letters = _byte_letters()
        if self.chunked:
            self.known: dict[str, bytes] = {}
            self.line = self._whole(["\n"])[0]
            self.newline = len(self.line) // self.kind.itemsize
            self.marks = dict(zip(".,;:!?", self._whole(list(".,;:!?"))))
            self.spaced = np.zeros(self.vocabulary, bool)
            self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True

    def _whole(self, batch: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def _safe(self, text: str) -> bool:
        return self.chunked and not any(s in text for s in self.unsafe) and text[0] != " " and text[-1] != " "

    def _apart(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that follow a space, encoded in one text: a chunk begins where a token begins with the space."""
        flat = np.frombuffer(b"".join(self._whole([" " + " ".join(chunks[i : i + 4_096]) for i in range(0, len(chunks), 4_096)])), self.kind)
        begins = np.flatnonzero(self.spaced[flat]) * self.kind.itemsize
        raw = flat.tobytes()
        return [raw[i:j] for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(raw)])]

    def _chunks(self, chunks: list[str], often: list[bool]) -> list[bytes]:
        """Ids of distinct chunks: words that follow a space, and words with the newline before them; often: which to keep for the worker's next texts."""
        out: list[bytes | None] = [None] * len(chunks)
        merge, pack, letters, marks = self.tokenizer.model.tokenize, array("H" if self.kind.itemsize == 2 else "I"), self.letters, self.marks
        known, new, rest, lines = self.known, {}, [], []
        if len(known) > KNOWN_CHUNKS:
            known.clear()
        for i, c in enumerate(chunks):
            ids = known.get(c)
            if ids is not None:
                out[i] = ids
                continue
            mark = marks.get(c[-1:])
            word = c if mark is None else c[:-1]  # a word and the mark behind it never merge
            ids = new.get(word)
            if ids is None:
                bare = word[1:] if word[:1] == "\n" else word
                if not (bare.isalpha() and (bare.isascii() or max(bare) < "\u0250")):
                    (lines if c[:1] == "\n" else rest).append(i)
                    continue
                spelled = bare if bare.isascii() else bare.encode().decode("latin-1").translate(letters)
                ids = array(pack.typecode, [t.id for t in merge("\u0120" + spelled if bare is word else spelled)]).tobytes()
                new[word] = ids = ids if bare is word else self.line + ids
            out[i] = ids if mark is None else ids + mark
            if often[i]:
                known[c] = out[i]
        if rest:
            for i, ids in zip(rest, self._apart([chunks[i] for i in rest])):
                out[i] = ids
        if lines:
            for i, ids in zip(lines, self._whole([chunks[i] for i in lines])):
                out[i] = ids
        return out

    def encode(self, batch: list[str | None]) -> list[np.ndarray]:
        out = [np.zeros(0, self.kind)] * len(batch)
        safe, whole = [], []
        for i, text in enumerate(batch):
            if text:
                (safe if self._safe(text) else whole).append(i)
        for i, got in zip(whole, self._whole([batch[i] for i in whole]) if whole else []):
            out[i] = np.frombuffer(got, self.kind)
        if not safe:
            return out
        # The text's beginning is encoded as if behind a newline, which is cut off again.
        cut = pc.split_pattern(pa.array(["\n" + batch[i].replace("\n", " \n") for i in safe], pa.large_string()), " ")
        chunks = cut.values.dictionary_encode()
        which = chunks.indices.to_numpy()
        coded = self._chunks(chunks.dictionary.to_pylist(), (np.bincount(which) > 1).tolist())
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // self.kind.itemsize
        flat, first = np.frombuffer(b"".join(coded), self.kind), np.cumsum(size) - size
        bounds = cut.offsets.to_numpy()
        for start in range(0, len(safe), 512):
            some = safe[start : start + 512]
            lo, hi = bounds[start], bounds[start + len(some)]
            own = which[lo:hi]
            n = size[own]
            ends = np.cumsum(n)
            ids = flat[np.repeat(first[own] - (ends - n), n) + np.arange(ends[-1])]
            at = np.r_[0, ends][bounds[start : start + len(some) + 1] - lo]
            for k, i in enumerate(some):
                out[i] = ids[at[k] + self.newline : at[k + 1]]
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """A Python worker's encoder for a tokenizers file, read once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def repair(ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols of each document, rules) for documents that end before ``ends``.

    Of frequent pairs that overlap the more frequent one is replaced, whatever stands around
    them, so copies of a passage are always cut alike. A pair found rare is not counted again
    until a neighbour changes; a last count of all pairs ends the loop.
    """
    last = np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    symbols, rules, rule_of = ids.astype(np.uint32), [], {}
    at, whole, turn = np.flatnonzero(~last), True, 0
    while True:
        left, right = symbols[at], symbols[at + 1]
        turn += 1
        factor = np.uint32(0x9E3779B1 * (2 * turn + 1) & 0xFFFFFFFF)  # other buckets each round, so no clash lasts
        bucket = ((left * factor ^ right) * np.uint32(0x85EBCA6B) >> np.uint32(14)).astype(np.intp)
        often = np.flatnonzero((np.bincount(bucket, minlength=BUCKETS) >= MIN_PAIRS)[bucket])  # a pair comes no more often than its bucket
        at, left, right, bucket = at[often], left[often], right[often], bucket[often]
        pair = left.astype(np.uint64) << np.uint64(32) | right
        free = np.ones(len(at), bool)  # of equal pairs that overlap in a row, every other one
        twin = np.flatnonzero(left == right)
        if len(twin):
            begins = np.r_[True, np.diff(at[twin]) != 1]
            free[twin] = (at[twin] - at[twin][np.maximum.accumulate(np.where(begins, np.arange(len(twin)), 0))]) % 2 == 0
        ordered = np.sort(pair[free] if len(twin) else pair)
        start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        count = np.diff(np.r_[start, len(ordered)])
        found = count >= MIN_PAIRS
        chosen, count = ordered[start[found]], count[found]
        if not len(chosen):
            if whole:
                break
            at, whole = np.flatnonzero(~last), True
            continue
        if len(chosen) > RULES_A_ROUND:
            held = count >= np.partition(count, -RULES_A_ROUND)[-RULES_A_ROUND]
            chosen, count = chosen[held], count[held]
        left, right = (chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32)
        mixed = (left * factor ^ right) * np.uint32(0x85EBCA6B)
        best = np.lexsort((chosen, mixed, count))  # the most frequent last, so that it keeps its bucket
        chosen = chosen[best]
        rank_of = np.zeros(BUCKETS, np.int32)
        rank_of[(mixed[best] >> np.uint32(14)).astype(np.intp)] = np.arange(1, len(chosen) + 1)
        rank = rank_of[bucket]
        hit = np.flatnonzero((rank > 0) & free)
        hit = hit[chosen[rank[hit] - 1] == pair[hit]]
        where, rank = at[hit], rank[hit] - 1
        beside = np.diff(where) == 1
        wins = np.ones(len(where), bool)
        wins[1:] &= ~beside | (rank[1:] > rank[:-1])
        wins[:-1] &= ~beside | (rank[:-1] > rank[1:])
        where, rank = where[wins], rank[wins]
        worth = np.bincount(rank, minlength=len(chosen)) >= MIN_PAIRS
        wins = worth[rank]
        where, rank = where[wins], rank[wins]
        name = np.zeros(len(chosen), np.uint32)
        for k in np.flatnonzero(worth).tolist():
            key = int(chosen[k])
            if key not in rule_of:
                rule_of[key] = vocabulary + len(rules)
                rules.append((key >> 32, key & 0xFFFFFFFF))
            name[k] = rule_of[key]
        symbols[where] = name[rank]
        last[where] |= last[where + 1]
        open_ = np.zeros(len(symbols), bool)
        open_[at] = open_[where] = open_[np.maximum(where - 1, 0)] = True
        stay = np.ones(len(symbols), bool)
        stay[where + 1] = False
        symbols, last, open_ = symbols[stay], last[stay], open_[stay]
        at, whole = np.flatnonzero(open_ & ~last), False
    each = np.diff(np.r_[0, np.flatnonzero(last) + 1])
    return symbols, each, np.array(rules, np.uint32).reshape(-1, 2)


def pack(doc_ids: list[int | None], ids: list[np.ndarray], vocabulary: int) -> bytes:
    """A shard of documents, none of them empty."""
    sizes = np.array([len(x) for x in ids], np.uint64)
    symbols, each, rules = repair(np.concatenate(ids), np.cumsum(sizes).astype(np.int64), vocabulary)
    lengths = [1] * vocabulary
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    high = max(0, (vocabulary + len(rules) - 1).bit_length() - 16)
    planes = [np.packbits((symbols >> (16 + k) & 1).astype("u1")) for k in range(high)]
    head = struct.pack("<7I", 2, vocabulary, len(rules), len(symbols), len(ids), high, 0)
    parts = [rules.astype("<u4"), np.array(lengths[vocabulary:], "<u8"), np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), sizes.astype("<u8"), each.astype("<u8"), (symbols & 0xFFFF).astype("<u2"), *planes]
    return MAGIC + head + b"".join(p.tobytes() for p in parts)


class Shard:
    """Random access into a shard's bytes."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a token shard")
        _, self.vocabulary, rules, symbols, docs, high, _ = struct.unpack_from("<7I", payload, 8)
        at = 36

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, n, at)
            at += got.nbytes
            return got

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        lengths, ids, null = take("<u8", rules), take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else d for d, n in zip(ids.tolist(), null.tolist())]
        self.sizes, each = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        self.symbols = take("<u2", symbols)
        for k in range(high):
            plane = np.unpackbits(take("u1", (symbols + 7) // 8), count=symbols)
            self.symbols = self.symbols.astype(np.uint32) | plane.astype(np.uint32) << np.uint32(16 + k)
        self.ends = np.cumsum(each)
        self.lengths = np.r_[np.ones(self.vocabulary, np.int64), lengths.astype(np.int64)]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        symbols = symbols.astype(np.int64)
        lengths = self.lengths[symbols]
        at = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.uint32)
        while len(symbols):
            plain = symbols < self.vocabulary
            out[at[plain]] = symbols[plain]
            symbols, at = symbols[~plain], at[~plain]
            pairs = self.rules[symbols - self.vocabulary].astype(np.int64)
            symbols, at = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[at, at + self.lengths[pairs[:, 0]]]
        return out

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the doc-th document, from the symbols that cover them alone."""
        own = self.symbols[self.ends[doc - 1] if doc else 0 : self.ends[doc]]
        stop = int(self.sizes[doc]) if stop is None else min(stop, int(self.sizes[doc]))
        if start == 0 and stop == self.sizes[doc]:
            return self.expand(own)
        reach = np.cumsum(self.lengths[own])
        a, b = np.searchsorted(reach, start, "right"), np.searchsorted(reach, stop, "left") + 1
        before = int(reach[a - 1]) if a else 0
        return self.expand(own[a:b])[start - before : max(start, stop) - before]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    encoder, part, seq = encoder_of(path), TaskContext.get().partitionId(), 0
    doc_ids, ids, held = [], [], 0

    def shard() -> pa.RecordBatch:
        nonlocal seq
        row = {"part": part, "seq": seq, "n_docs": len(ids), "n_tokens": held, "payload": pack(doc_ids, ids, encoder.vocabulary)}
        seq += 1
        return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]))

    end = np.array([end_id], encoder.kind)
    for names, batch in _gathered(batches):
        for doc_id, own in zip(names, encoder.encode(batch)):
            if ids and held + len(own) + 1 > shard_tokens:
                yield shard()
                doc_ids, ids, held = [], [], 0
            doc_ids.append(doc_id)
            ids.append(np.concatenate([own, end]))
            held += len(own) + 1
    if ids:
        yield shard()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """doc_ids and texts of enough rows to share their chunks."""
    names, held, chars = [], [], 0
    for batch in batches:
        names += batch.column(0).to_pylist()
        held += (own := texts(batch))
        chars += sum(len(t) for t in own if t)
        if chars >= BATCH_CHARS:
            yield names, held
            names, held, chars = [], [], 0
    if names:
        yield names, held


def write_shards(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 0, shard_tokens: int = 1_000_000) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into shards in the shared folder; the shards, in order of (part, seq)."""
    small_batches(spark)
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    made = dealt.select("doc_id", "text").mapInArrow(lambda it: _encoded(it, path, end_id, shard_tokens), SHARD_SCHEMA)
    return kept(spark, made, "token-shards")[0]


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            shard = Shard(payload)
            n = shard.sizes
            raw, ends = memoryview(shard.expand(shard.symbols).astype("<u4").tobytes()), (np.cumsum(n) * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), seq, np.int32)), pa.array(shard.doc_ids, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document from its shard: doc_id, start, n_tokens, ids_crc32."""
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each writing task
    parts = parts.withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    starts = sizes.withColumn("before", before).join(parts, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("at"))
    docs = shards.select("part", "seq", "payload").mapInArrow(_decoded, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_shards(write_shards(spark, docs, public_tokenizers.path("byte_bpe_50k.json")))
