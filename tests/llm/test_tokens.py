"""Pretokenizer, both encoders, packing and shards against the libraries themselves."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from forumlens.llm import bpe, packing, pretokens, shards
from tests.llm.odd import ROWS, no_docs, odd_docs

PATTERN = regex.compile(public_tokenizers.PATTERN)
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def tokens(texts):
    joined, starts, ends, first = pretokens.token_ranges(texts)
    return [[joined[starts[k]:ends[k]].decode() for k in range(i, j)] for i, j in zip(first[:-1], first[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'stremvld \t\n\r  Äß漢1²!#🙂̈"), max_size=30), max_size=5))
def test_token_rules_match_the_pattern(texts):
    assert tokens([t.encode() for t in texts]) == [PATTERN.findall(t) for t in texts]


def test_duckdb_bpe_matches_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aabcdeghinorst '-.!12\nÄß漢🙂") for _ in range(rng.randrange(200))) for _ in range(200)]
    texts += ["a" * 500, "ab" * 200, "", "<|endoftext|>"]
    coder = bpe.duck_bpe(RANKS)
    ids, at = pretokens.encoded([t.encode() for t in texts], coder.ids_of)
    for text, i, j in zip(texts, at[:-1], at[1:]):
        assert ids[i:j].tolist() == library.encode_ordinary(text)
    part = np.searchsorted(at, np.arange(len(ids)), "right") - 1
    decoded = coder.decoded(ids, part)
    assert [decoded.get(k, b"").decode() for k in range(len(texts))] == texts


def test_bpe_rows(spark, library):
    found = sorted((tuple(r) for r in bpe.encode_decode(odd_docs(spark)).collect()), key=repr)
    wanted = []
    for doc_id, text, _, _ in ROWS:
        ids = library.encode_ordinary(text or "")
        wanted.append((doc_id, len(ids), bytearray(np.array(ids, "<u4").tobytes()), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(wanted, key=repr)
    assert bpe.encode_decode(no_docs(spark)).count() == 0


def test_packing_keeps_every_id_once(spark, tokenizer):
    capacity = 64
    rows = [tuple(r) for r in packing.pack(odd_docs(spark), capacity=capacity).collect()]
    whole = defaultdict(list)
    for doc_id, text, _, _ in ROWS:
        whole[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    wanted = sorted((
        (doc_id, start, len(ids[start:start + capacity]), zlib.crc32(np.array(ids[start:start + capacity], "<u4").tobytes()), len(ids))
        for doc_id, texts in whole.items() for ids in texts for start in range(0, len(ids), capacity)), key=repr)
    assert sorted((r[:5] for r in rows), key=repr) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r[5]].append((r[6], r[2], r[7]))
    for pieces in sequences.values():
        at = 0
        for offset, length, total in sorted(pieces):
            assert offset == at
            at += length
        assert at == total <= capacity
    assert packing.pack(no_docs(spark)).count() == 0


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(3.5, 0.8, 20_000).astype(int) + 1, 256)
    counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    plan = packing.cutting_stock(counts, 256)
    held = defaultdict(int)
    for p in plan:
        assert sum(s * n for s, n in p.pieces.items()) <= 256 and p.times > 0
        for s, n in p.pieces.items():
            held[s] += n * p.times
    assert all(held[s] >= n for s, n in counts.items())
    assert sum(p.times for p in plan) <= 1.01 * sizes.sum() / 256 + len(counts)
    assert packing.cutting_stock({}, 256) == []


@pytest.mark.parametrize("count", [1, 2, 3, 97, 1000, 4097])
def test_order_is_a_permutation(count):
    order = shards.Order(count, key=99)
    slots = order.slots(np.arange(count))
    assert sorted(slots.tolist()) == list(range(count))
    assert order.sequences(slots).tolist() == list(range(count))
    if count >= 97:
        assert slots.tolist() != shards.Order(count, key=100).slots(np.arange(count)).tolist()


def test_shards_hold_the_stream(spark, tokenizer, tmp_path):
    docs = odd_docs(spark).coalesce(1)
    out = shards.write_shards(docs, str(tmp_path / "s"), key=4, length=32, per_shard=16)
    stream = [i for r in docs.collect() for i in tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]]
    rows = {r["slot"]: r for r in out.manifest.collect()}
    read = {r["slot"]: np.frombuffer(bytes(r["ids"]), "<u2").tolist() for r in shards.read_slots(spark, out).collect()}
    count = -(-len(stream) // 32)
    assert out.count == count and sorted(rows) == sorted(read) == list(range(count))
    for slot, row in rows.items():
        own = stream[row["sequence"] * 32:(row["sequence"] + 1) * 32]
        assert row["n_tokens"] == len(own) and read[slot][:len(own)] == own
        assert (row["shard"], row["byte_offset"]) == (slot // 16, slot % 16 * 64)
    part = shards.read_slots(spark, out, 5, 40).collect()
    assert sorted(r["slot"] for r in part) == list(range(5, min(40, count)))
    assert shards.write_shards(no_docs(spark), str(tmp_path / "none"), length=32).count == 0
    assert shards.training_order(no_docs(spark)).count() == 0


def test_words_that_share_a_hash_keep_their_own_ids(monkeypatch, tokenizer):
    monkeypatch.setattr(pretokens, "word_hashes", lambda joined, starts, ends: np.zeros(len(starts), np.uint64))
    coder = pretokens.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    for texts in (["one two three", "two  one\n"], ["three two", "four 'll"]):
        ids, at = pretokens.encoded([t.encode() for t in texts], coder)
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [tokenizer.encode(t).ids for t in texts]


def test_words_are_forgotten_and_learned_again(tokenizer):
    coder = pretokens.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    coder.known.size = 20
    rng = random.Random(3)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(40))) for _ in range(3)]
        ids, at = pretokens.encoded([t.encode() for t in texts], coder)
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [tokenizer.encode(t).ids for t in texts]
        assert len(coder.known.hashes) <= 20


@pytest.mark.parametrize("letters, size", [
    ("abcdefghijklmnopqrstuvwxyz", 60_000), ("a", 100_000), ("ACGT", 40_000), ("étranger漢字кот", 30_000), ("-=_*", 30_000), ("the inand".replace(" ", ""), 50_000)])
def test_a_long_word(library, letters, size):
    rng = random.Random(size)
    word = "".join(rng.choice(letters) for _ in range(size))
    coder = bpe.duck_bpe(RANKS)
    ids, _ = pretokens.encoded([word.encode()], coder.ids_of)
    assert ids.tolist() == library.encode_ordinary(word)


def test_a_word_of_a_megabyte(library):
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    began = time.monotonic()
    ids, _ = pretokens.encoded([word.encode()], bpe.duck_bpe(RANKS).ids_of)
    assert time.monotonic() - began < 180 and ids.tolist() == library.encode_ordinary(word)


def test_capacity_must_hold_whole_units(spark):
    with pytest.raises(ValueError):
        packing.pack(no_docs(spark), capacity=100)


def test_known_words_learn_from_bytes_and_forget(tokenizer):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 50, 500).astype(np.uint64) << np.uint64(58)
    for got, want in zip(pretokens._numbered(values), np.unique(values, return_index=True, return_inverse=True), strict=True):
        assert np.array_equal(got, want)
    words = pretokens.word_ids(public_tokenizers.path("byte_bpe_50k.json"))
    learned = []

    def learn(data, sizes):
        learned.append(sizes.sum() == len(data))
        return words.learn(data, sizes)

    known = pretokens.KnownWords(learn, 40)
    texts = [" ".join("".join(rng.choice(list("abcÄß1.'"), rng.integers(1, 7))) for _ in range(30)) for _ in range(40)]
    for first in [0, 10, 0, 20, 30, 0]:
        own = texts[first:first + 10]
        ids, at = pretokens.encoded([t.encode() for t in own], known)
        for text, i, j in zip(own, at[:-1], at[1:], strict=True):
            assert ids[i:j].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(known.hashes) <= 40 == known.size and len(known.ids) == known.words[4].sum()
    assert learned and all(learned)
