"""Alignment against both libraries on whole texts and a search of groups token by token."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from forumlens.llm import align
from forumlens.llm.queries import op13_token_alignment
from tests.llm.odd import ROWS, no_docs, odd_docs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EMPTY = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def both():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    # The byte of each character of a byte-level token.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of_char = {chr(c): c for c in plain}
    of_char |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(of_char[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        return list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))

    return tokens


def wanted(both, rows):
    held, counts = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a, b = both(text)
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
                cuts = sorted(ends[0] & ends[1])
                groups = [([], []) for _ in cuts]
                for k, side in enumerate((a, b)):
                    at = 0
                    for i, x in side:
                        at += len(x)
                        groups[bisect_left(cuts, at)][k].append(i)
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        held.append((doc_id, groups, links))
        counts.update(links.keys())
    highest = Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for doc_id, groups, links in held:
        told = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in groups)
        out.append((
            doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in links.items()),
            hashlib.sha256(told.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def hard_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabcdeghinorst  '-.!12\n\tÄß漢🙂 　éx́") for _ in range(rng.randrange(120))) for _ in range(300)]
    return texts + [
        " ", "  ", "a ", " a", "\n", "x▁y", "▁", "a ▁b", "<s></s><unk><0x41><|endoftext|>", "nul\x00l", "      many      spaces   ",
        "a" * 3000, "の" * 500, "🙂" * 200, "don't I'll  'quoted'", "\r\n\r\n"]


@pytest.mark.parametrize("hot", [0, 50, align.HOT])
def test_texts_of_all_kinds(spark, both, hot):
    rows = list(enumerate(hard_texts()))
    found = align.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == wanted(both, rows)


def test_every_row(spark, both, monkeypatch):
    rows = [(doc_id, text) for doc_id, text, _, _ in ROWS]
    found = sorted((tuple(r) for r in align.align(odd_docs(spark)).collect()), key=repr)
    assert found == wanted(both, rows)
    assert (4, *EMPTY) in found and (3, *EMPTY) in found
    assert align.align(no_docs(spark)).count() == 0


def test_counts_are_handed_on_in_parts(both):
    texts = [t.encode() for t in hard_texts()]
    aligner = align.Aligner(A, B)
    whole = aligner(texts)[1].to_pydict()
    parts = Counter()
    for i in range(0, len(texts), 40):
        part = aligner(texts[i:i + 40])[1].to_pydict()
        parts.update(dict(zip(part["pair"], part["documents"])))
    assert parts == Counter(dict(zip(whole["pair"], whole["documents"])))


def test_op13_on_the_given_table(spark, both):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted((tuple(r) for r in op13_token_alignment(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert rows == wanted(both, docs)
