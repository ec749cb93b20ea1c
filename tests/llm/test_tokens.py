"""Operators 1, 5 and 6: token files, byte-level BPE, token counts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import by_id, documents, rows
from tracelab.llm import byte_bpe, rans, token_counts, token_store
from tracelab.llm.common import scratch_path
from tracelab.llm.perfect_hash import PerfectHash

PATTERN = public_tokenizers.PATTERN


def content(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content("byte_bpe_50k.tiktoken").splitlines())}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = [str(i * i).encode() for i in range(3000)]
    found = PerfectHash(keys)
    assert sorted(found.find(keys).tolist()) == list(range(3000))
    assert (found.find([b"-1", b"x", b""]) == -1).all()
    assert PerfectHash([]).find([b"a"]).tolist() == [-1]
    with pytest.raises(ValueError):
        PerfectHash([b"a", b"a"])


def test_bpe_equals_tiktoken_on_random_unicode(ranks):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.ByteCoder(ranks, PATTERN).ready()
    rng = random.Random(3)
    pool = [chr(c) for c in [*range(0x250), *range(0x300, 0x400), *range(0x600, 0x680), *range(0x2000, 0x2070), 0x3000, 0x6771, 0x1F600, 0x1C, 0x85, 0xFEFF]]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(rng.choices(" \n\tab's1", k=30)) for _ in range(1000)] + ["a" * 5000, " " * 999]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text), repr(text)
        assert coder.decode(ids) == text.encode()


def test_bpe_round_trip(spark, ranks):
    data = rows()
    docs = documents(spark, data + data[:2])
    out = byte_bpe.decode(byte_bpe.encode(docs, content("byte_bpe_50k.tiktoken"), PATTERN), content("byte_bpe_50k.tiktoken"), PATTERN)
    assert out.columns[-2:] == ["ids", "decoded"] and "grp" in out.columns
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in data + data[:2])
    assert [(a, bytes(b), bytes(c)) for a, b, c in by_id(out, "doc_id", "ids", "decoded")] == want
    assert byte_bpe.encode(documents(spark, []), content("byte_bpe_50k.tiktoken"), PATTERN).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 512, 513, 5000])
def test_rans_blocks_and_segments(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 900
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=901)))
    block = rans.encode(ids, table, lanes=64, every=8)
    assert (rans.decode(block, table) == ids).all()
    for k in reversed(range(len(block.crcs))):
        assert (rans.decode_segment(block, k, table) == ids[k * 512 : (k + 1) * 512]).all()
    if n > 512:
        block.crcs[0] ^= 1
        with pytest.raises(ValueError):
            rans.decode(block, table)


def test_rans_frequencies_keep_rare_ids():
    counts = np.ones(60_000, np.int64)
    counts[5] = 10**12
    freq = rans.scaled(counts)
    assert freq.min() == 1 and int(freq.sum()) == 1 << rans.BITS


def test_crc_of_joined_parts():
    assert rans.joined_crc(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


@pytest.mark.parametrize("block", [50, rans.BLOCK])
def test_token_files(spark, library, block):
    data = sorted(rows(), key=lambda r: r[0])
    path = scratch_path(spark)
    token_store.write_store(documents(spark, data), path, content("byte_bpe_50k.json"), 0, PATTERN, block)
    want, at = [], 0
    for i, t, *_ in data:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert by_id(token_store.document_sums(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_token_files_of_no_and_of_repeated_documents(spark):
    for data, n in (([], 0), ([(None, "a", "", "", 1), (1, "b", "", "", 1), (1, "b", "", "", 1)], 3)):
        path = scratch_path(spark)
        token_store.write_store(documents(spark, data), path, content("byte_bpe_50k.json"), 0, PATTERN)
        assert token_store.document_sums(spark, path).count() == n


def test_library_coder_cuts_like_the_library(library):
    coder = token_store.LibraryCoder(content("byte_bpe_50k.json"), PATTERN)
    rng = random.Random(5)
    texts = ["".join(rng.choices([" ", "\n", "\n\n", "a", "b's", "é", ",", "12", "\t", "\x85", "<|endoftext|>", "’", "ſ", "¡"], k=rng.randint(0, 20))) for _ in range(3000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want


def test_library_coder_asks_for_a_common_word_once(library, monkeypatch):
    monkeypatch.setattr(token_store, "MEMO_WORDS", 3)  # far fewer than the words
    coder = token_store.LibraryCoder(content("byte_bpe_50k.json"), PATTERN)
    asked = []
    ask = coder.model_ids
    monkeypatch.setattr(coder, "model_ids", lambda words: asked.extend(words) or ask(words))
    texts = [f"in zygotic{chr(97 + i)} ebullience, ebullience the{chr(97 + i)}. ebullience." for i in range(20)]
    for text in texts:
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked.count(" ebullience") == 1
    long = "x" * 5000
    for _ in range(2):
        assert np.frombuffer(coder.encode([f"in {long}"])[0], "<u4").tolist() == library.encode(f"in {long}", add_special_tokens=False).ids
    assert not any(len(w) > 100 for w in (*coder.words, *coder.older))


def test_token_counts_and_cache(spark, library):
    data = rows() + [(9001, "see <|endoftext|> here", "en", "s", 22)]
    cache = scratch_path(spark)
    tokenizer = content("byte_bpe_50k.json")
    docs = documents(spark, data + data[:1])
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in data + data[:1])
    assert by_id(token_counts.token_counts(docs, "json", tokenizer, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    stored = token_counts.read_cache(spark, cache)
    distinct = len({t or "" for _, t, *_ in data})
    assert stored.count() == distinct
    # a second run finds all; a changed count in the cache shows that it is used
    more = [(1, "new text", "en", "s", 8), data[0]]
    again = token_counts.token_counts(documents(spark, more), "json", tokenizer, cache)
    assert again.count() == 2 and stored.sparkSession.read.parquet(cache).count() == distinct + 1
    # another tokenizer has its own counts
    other = token_counts.token_counts(docs, "model", content("piece_bpe_32k.model"), cache)
    assert other.where("n_tokens is null").count() == 0
    assert spark.read.parquet(cache).groupBy("tokenizer").agg(F.count("*")).count() == 2
    assert token_counts.token_counts(documents(spark, []), "json", tokenizer, scratch_path(spark)).count() == 0


def test_counts_come_from_the_cache(spark):
    tokenizer, cache = content("byte_bpe_50k.json"), scratch_path(spark)
    row = [(hashlib.sha256(tokenizer).hexdigest(), hashlib.sha256(b"abc").hexdigest(), 77)]
    spark.createDataFrame(row, token_counts.CACHE).write.parquet(cache)
    out = token_counts.token_counts(documents(spark, [(1, "abc", "", "", 3)]), "json", tokenizer, cache)
    assert by_id(out, "doc_id", "n_tokens") == [(1, 77)]
