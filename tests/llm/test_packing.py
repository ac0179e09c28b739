"""Packing: every id in one piece, no limit broken, no padding, against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm import packing
from brindle.llm.packing import Example, Limits, Packer
from brindle.llm.wordends import WordEnds

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(words, texts):
    assert [x.tolist() for x in words.encode(texts)] == [x.tolist() for x in words.whole(texts)]


def test_ids_as_the_library(library):
    words = WordEnds(PATH)
    same(words, ["", " ", "it's don't WE'LL I'd x's''t ''s \"'s 'st 're's", "12 x² ½ ３ ٣٤", "İx Σς ΑΣ ſ K Å", "J̌ ǰ é é", "<|startoftext|>hi <|endoftext|>", "a\U0010ffffb", "가 가", "\x00\x01\x1c\x1f\x85  ​﻿", "漢字かなﬁ", "\U0001f642\U0001f44d\U0001f3fd", "'S 'T 'RE'VE", "क़ ̈́", "x͸y", "'ſ", "ǅ"])
    draw = random.Random(1)
    for _ in range(100):
        same(words, ["".join(draw.choice("aA'sStTrReEvVlLmMdD 1٣ \t\n!.,-é́ÀßİΣ漢\U0001f642<|>  _") for _ in range(draw.randint(0, 40))) for _ in range(20)])
    same(words, ["a" + chr(c) + "B1" + chr(c) + "'" + chr(c) for c in range(0, 0x3000)])


def test_a_small_cache_is_right(library):
    words, draw = WordEnds(PATH, bits=4, most=300), random.Random(2)
    for _ in range(30):
        same(words, [" ".join("".join(draw.choice("abcé") for _ in range(draw.randint(1, 20))) for _ in range(30))])


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="lower-casing"):
        WordEnds(public_tokenizers.path("byte_bpe_50k.json"))


def packed(examples, limits, cut=True):
    packer, out = Packer(limits, cut), []
    for i in range(0, len(examples), 50):
        out += packer.add(examples[i : i + 50])
        if len(packer.waiting) > 100:
            out += packer.pack(50)
    out += packer.pack(0)
    assert not packer.waiting
    return out


@pytest.mark.parametrize("limits", [Limits(64, 8, 64), Limits(64, 3, 20), Limits(50, 2, 7), Limits(1, 1, 1), Limits(2048, 256, 100)])
@pytest.mark.parametrize("cut", [True, False])
def test_no_limit_is_broken(limits, cut):
    draw = random.Random(3)
    examples = [Example(i, np.arange(n, dtype=np.uint32), draw.choice([0, 0, n // 2, n, n + 5]), 0, n) for i, n in enumerate(draw.choice([1, 1, 2, 5, 30, 63, 64, 65, 200]) for _ in range(400))]
    found, at = packed(examples, limits, cut), defaultdict(list)
    for sequence in found:
        length = sum(x.end - x.start for x in sequence)
        assert 0 < length <= limits.tokens and 0 < len(sequence) <= limits.segments and sum(x.loss for x in sequence) <= limits.loss
        assert not cut or length == limits.tokens or length & (length - 1) == 0
        for x in sequence:
            at[x.id].append((x.start, x.end))
    for x in examples:
        spans = sorted(at[x.id])
        assert spans[0][0] == 0 and spans[-1][1] == len(x.ids) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert cut or len(spans) == 1 or len(x.ids) > limits.tokens or x.loss > limits.loss


def test_the_dot_product_decides():
    """With half of the loss-bearing room taken, a prompt fits the rest better than a text that is as long."""
    half, text, prompt = Example(0, np.zeros(6, np.uint32), 0, 0, 6), Example(1, np.zeros(4, np.uint32), 0, 0, 4), Example(2, np.zeros(5, np.uint32), 5, 0, 5)
    packer = Packer(Limits(12, 4, 6), cut=False)
    assert not list(packer.add([text, half, prompt]))
    assert [[x.id for x in s] for s in packer.pack(0)] == [[0, 2], [1]]


ROWS = [(1, None, None, 1), (2, "", "Say it's so:", 1), (3, "Hello World! " * 900, None, 1), (3, "Hello World! " * 900, None, 1), (None, "It's 12 o'clock", "Q", 1), (5, "a" * 1_200_000, None, 1), (6, "word " * 260_000, "long prompt " * 2000, 1)]


def test_rows_of_any_kind(spark, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, prompt string, ids int").selectExpr("*", "1 AS _id", "2 AS _text", "3 AS start", "4 AS sequence_id").repartition(2)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    for prompt in (None, "prompt"):
        pieces = packing.pack(docs, tokenizer=PATH, end_id=1, prompt=prompt, limits=Limits(2048, 16, 1024 if prompt else 2048))
        found = packing.sequences(pieces, limits=Limits(2048)).collect()
        of = defaultdict(list)
        for r in found:
            assert r.padding == 0 and r.n_tokens * 4 == len(r.ids) and len(r.segments) <= 16 and r.loss_tokens <= (1024 if prompt else 2048)
            assert [s.offset for s in r.segments] == [sum(s.length for s in r.segments[:i]) for i in range(len(r.segments))]
            for s in r.segments:
                of[s.doc_id].append((s.start, s.loss_start, np.frombuffer(r.ids, "<u4")[s.offset : s.offset + s.length].tolist()))
        for doc_id, text, own, _ in {r[0]: r for r in ROWS}.values():
            first = ids(own) if prompt else []
            want = [*first, *ids(text), 1]
            for start, loss, got in of[doc_id]:
                assert want[start : start + len(got)] == got and loss == min(len(got), max(0, len(first) - start))
            assert sum(len(x[2]) for x in of[doc_id]) == len(want) * (2 if doc_id == 3 else 1)
    assert packing.pack(docs.where("false"), tokenizer=PATH, end_id=1).count() == 0
    assert packing.pack(docs.where("doc_id = 1"), tokenizer=PATH).count() == 0


def test_query(spark, library):
    import os

    from brindle.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the driver's tables")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op12_packing"](spark, folder).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
