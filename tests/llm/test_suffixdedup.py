import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import suffixdedup as sd


def brute(rows, window):
    """Doc, bytes, removed, spans and hash by comparing all windows."""
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - window + 1):
            key = b[i : i + window]
            first[key] = min(first.get(key, float("inf")), float("inf") if doc is None else doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < (float("inf") if doc is None else doc):
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(0)
    for text in [b"a", b"banana", b"a" * 300, bytes(rng.choice(b"ab") for _ in range(500)), b"abcab" * 60 + b"x" + b"abcab" * 60]:
        t = np.frombuffer(text, np.uint8)
        order = sd.suffix_array(t)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        got = sd.common_prefixes(t, order, np.array([0, len(t) // 2]), np.array([len(t) // 2, len(t)]), 50)
        for a, b in zip(order[:-1], order[1:]):
            n = 0
            while n < 50 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert got[b] == n


def test_binary_search():
    rng = np.random.default_rng(1)
    rows = np.unique(rng.integers(0, 4, (200, 3)).astype(np.uint64), axis=0)
    asked = rng.integers(0, 5, (300, 3)).astype(np.uint64)
    want = {tuple(r): i for i, r in enumerate(rows.tolist())}
    assert sd.find(rows, asked).tolist() == [want.get(tuple(r), -1) for r in asked.tolist()]
    assert sd.find(rows[:0], asked).tolist() == [-1] * 300


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = []
    for doc in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 5))]
        rows.append((doc * 3, " ".join(parts)))
    whole = max((t for _, t in rows), key=len)
    rows += [(1, whole), (2, whole), (400, whole + "x"), (400, whole), (None, whole), (None, None), (7, ""), (8, "x" * 49), (10, "y" * 3000), (11, "y" * 500), (13, "z" * 50), (14, "z" * 50)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window, gram, member", [(50, 16, 8 << 20), (50, 16, 2000), (20, 8, 500)])
def test_as_brute_force(spark, window, gram, member):
    rows = corpus(window + member)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as slice", "2 as key").repartition(5)
    got = sd.repeated_passages(docs, window=window, gram=gram, member=member).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=str) == brute(rows, window)


def test_text_longer_than_a_slice(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(180_000))
    rows = [(2, long), (1, long[400_000:400_900]), (3, "x" + long[-700:] + "y"), (4, long[:60])]
    assert len(long) > 1 << 20
    got = sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=str) == brute(rows, 50)


def test_empty(spark):
    assert sd.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_key_is_dealt_to_many_shards(spark):
    """A phrase of low hash stands in ever different contexts, and in some equal ones; rules of signs are long runs of one key."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrases = [word(16) for _ in range(20_000)]
    key = sd.runs(np.frombuffer("".join(phrases).encode(), np.uint8), np.arange(0, 16 * 20_001, 16), 16, 16)[0].view(np.uint64)
    phrase = phrases[int(np.argmin(key))]
    rows = [(doc, word(60) + phrase + word(60)) for doc in range(500)]
    rows += [(600 + k, word(20) + rows[k * 7][1][40:100] + word(20)) for k in range(60)]
    rows += [(700, "-" * 4000), (701, "x" + "-" * 3000 + "y"), (702, "-=" * 900), (None, "=-" * 700), (703, rows[3][1])]
    rng.shuffle(rows)
    docs, member = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 4000
    _, dealt = sd._dealt(docs, 50, 16, member)
    sizes = [r[0] for r in dealt.where("shard >= 0").groupBy("shard").agg(F.sum(F.length("run_text"))).collect()]
    assert max(sizes) < 3 * member
    got = sd.repeated_passages(docs, member=member).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=str) == brute(rows, 50)


def test_what_slices_do_with_their_runs():
    """_shared() against a look at all rows of a key, with batches cut anywhere."""
    import pyarrow as pa

    rng = random.Random(12)
    for trial in range(300):
        rows = sorted({(rng.randrange(1, 9), rng.choice([0, 5, 5, 5, 6]), rng.randrange(6), rng.randrange(1000)) for _ in range(rng.randint(0, 30))})
        rows = [(*r, 2 * rng.randrange(3) + (rng.random() < 0.2)) for r in rows]
        cuts = sorted(rng.sample(range(len(rows) + 1), min(len(rows), 5)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        names, kinds = ["key", "only", "doc", "slice", "code"], [pa.int64()] * 4 + [pa.int8()]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(kinds)], names) for part in parts]
        got = [tuple(r.values()) for b in sd._shared(600)(iter(batches)) for r in b.to_pylist()]
        want, hot = [], []
        for key in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == key]
            shipped = 0
            for r in own:
                group = [x for x in own if x[1] == r[1]]
                if r[1] and r[2] > group[0][2]:
                    kind = sd.LOST
                elif r[1] and r == group[0] and len(group) == len(own):
                    kind = sd.OWN
                else:
                    kind = sd.SHIP
                    shipped += 256 << (r[4] >> 1)
                if (len(own) > 1 or r[4] & 1) and (kind != sd.OWN or r[4] & 1):
                    want.append((key, r[3], kind))
            hot += [(key, -shipped, sd.SHIP)] if shipped > 600 else []
        assert sorted(got) == sorted(want + hot), trial


def test_rows_are_of_many_slices(spark):
    """A task deals its slices' keys and runs together: their rows are tasks by shards, not slices by shards."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    rows = [(doc, " ".join([rng.choice(texts)[rng.randrange(100) :], rng.choice(texts)])) for doc in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    packed, dealt = sd._dealt(docs, 50, 16, 4000)
    slices, buckets, runs = packed.count(), 4, dealt.where("shard >= 0").cache()
    shards = runs.select("shard").distinct().count()
    assert slices == 40 and shards > 10
    assert runs.count() <= buckets * shards
    got = sd.repeated_passages(docs, member=4000).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=str) == brute(rows, 50)


def test_suffix_array_of_some_positions():
    """Only windows are sorted, by their own bytes: of text with zeros, periods and copies."""
    rng = random.Random(4)
    for text in [b"ab" * 100, b"\0" * 120, bytes(rng.choice(b"ab\0") for _ in range(700)), b"abcab" * 60 + b"x" + b"abcab" * 60, b"z" * 50]:
        t = np.frombuffer(text, np.uint8)
        assert sd.suffix_array(t).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        for depth in (50, 20, 8, 5):
            at = np.array(sorted(rng.sample(range(len(text) - depth + 1), (len(text) - depth) // 2 + 1)))
            got = sd.suffix_array(t, at, depth)
            assert sorted(got.tolist()) == at.tolist()
            heads = [text[i : i + depth] for i in got.tolist()]
            assert heads == sorted(heads)
            shared = sd.common_prefixes(t, got, at, at + 1, depth)
            for i, j, a, b in zip(got, got[1:], heads, heads[1:]):
                n = next((k for k in range(depth) if a[k] != b[k]), depth)
                assert shared[j] == n
            assert shared[np.setdiff1d(np.arange(len(t)), at)].sum() == 0


def test_spans_are_of_their_text(spark):
    """Stretches that touch where texts meet stay two; texts that are empty or go whole between them."""
    whole = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = [(1, whole), (2, whole), (3, ""), (4, whole), (5, None), (6, "-" + whole + "-" + whole[:50]), (7, "x" * 20)]
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {1: [], 2: [(0, 62)], 3: [], 4: [(0, 62)], 5: [], 6: [(1, 63), (64, 114)], 7: []}
