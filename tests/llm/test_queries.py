"""Every registered query over the smallest tables: against its SQL, a brute-force version, an exact round trip, or held-out labels."""

import hashlib
import os
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm import simhash
from brindle.llm.queries import ORACLES, QUERIES

from ..compare import connect, same

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def rows_of(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, FOLDER).collect()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(spark, name):
    same(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name])


def test_op5(spark, texts, tokenizer):
    got, start = rows_of(spark, "op5_token_binary"), 0
    assert sorted(got) == sorted(texts)
    for doc_id, text in sorted(texts.items()):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_op6(spark, texts):
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    low = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            least = min(low[j] for j in texts if (prints[i] ^ prints[j]).bit_count() <= 3)
            changed |= least < low[i]
            low[i] = min(least, low[i])
    got = rows_of(spark, "op6_simhash_golay")
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", low[i]) for i in texts}


def folded(text):
    mark = lambda c: c < "\x80" and not c.isalnum() or "\u2000" <= c <= "\u206f" or "\u00a0" <= c <= "\u00bf" and c not in "\u00aa\u00b5\u00ba"
    return [w for w in "".join(" " if mark(c) else c for c in text.lower()).split(" ") if w]


def tiled(item, doc, least):
    """Words of the item in greedy tiles, by trying all pairs of places for the longest match again and again."""
    places = {}
    for j, w in enumerate(doc):
        places.setdefault(w, []).append(j)
    gone_item, gone_doc = set(), set()
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in places.get(item[i], ()):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in gone_item and j + n not in gone_doc:
                    n += 1
                if n > best[0]:
                    best = n, i, j
        n, i, j = best
        if n < least:
            return len(gone_item)
        gone_item |= {*range(i, i + n)}
        gone_doc |= {*range(j, j + n)}


def test_op7(spark, texts):
    items = {r.item_id: folded(r.text or "") for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    docs, wanted = {i: folded(t) for i, t in texts.items()}, set()
    grams = lambda words, n: {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    for doc_id, doc in docs.items():
        own = {}
        for item_id, item in items.items():
            least = min(5, len(item))
            if least and own.setdefault(least, grams(doc, least)) & grams(item, least):
                covered = tiled(item, doc, least)
                if covered >= 0.8 * len(item):
                    wanted.add((doc_id, item_id, len(item), covered))
    got = QUERIES["op7_decontamination"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.item_id, r.item_words, r.covered) for r in got) == sorted(wanted) and wanted


def test_op8(spark, texts, tokenizer):
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for doc_id, r in rows_of(spark, "op8_edit_token_counts").items():
        text = texts[doc_id]
        n = len(text)
        assert r.n_tokens_before == count(text)
        for pos, gone, new in ((n // 3, 5, "an edited passage"), (n // 2, 0, "\n\n  it's new "), (n * 3 // 4, 40, "")):
            text = text[:pos] + new + text[pos + gone :]
        assert (r.n_tokens, r.n_chars) == (count(text), len(text))
        assert n < 20_000 or r.encoded_chars < n / 4


def test_op10(spark, texts):
    first, wanted = {}, {}
    for doc_id, text in sorted(texts.items()):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first.setdefault(data[i : i + 50], doc_id) < doc_id:
                gone[i : i + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        wanted[doc_id] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    got = rows_of(spark, "op10_suffix_dedup")
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == wanted


@pytest.mark.parametrize("name, label, held", [("op4_toxicity", "toxic", lambda i: zlib.crc32(str(i).encode()) % 5 == 0), ("op9_quality_mil", "quality", lambda i: zlib.crc32(str(i).encode()) % 3 == 1)])
def test_held_out_labels(spark, name, label, held):
    got = {r.doc_id: r for r in QUERIES[name](spark, FOLDER.replace("0.001", "0.01")).collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    labels = spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/labels.parquet").collect()
    right = [got[r.doc_id].predicted == r[label] for r in labels if held(r.doc_id)]
    assert len(right) > 30 and sum(right) >= 0.95 * len(right)
