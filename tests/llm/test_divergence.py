"""The tournament of sources, against all pairs of groups in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=lambda t: t.encode())
        of = {s: [counts[lang, s][t] for t in kept] for s in sources}
        share = lambda n: [1 + 10**9 * (c + 2) // (sum(n) + 2 * len(kept)) for c in n]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        p, q = {s: share(n) for s, n in of.items()}, share([sum(x) for x in zip(*of.values())])
        for s in sources:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in sources - {s}]
            terms = [(f(a, b), t) for t, n, a, b in zip(kept, of[s], p[s], q) if n and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "text string, lang string, source string, n int, item string, range int, cell int")
    found = divergence.audit(docs, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, found.collect()))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    words = ["Alpha", "alpha", "été", "ÉTÉ", "x", "don't", "漢字", "\U0001f642", "a1b", "zz_z", *(f"w{chr(97 + i)}" for i in range(26))]
    out = [(" ".join(draw.choices(words, k=draw.randint(0, 12))), draw.choice(["en", "en", "de", None]), draw.choice([f"s{i}" for i in range(7)] + [None])) for _ in range(400)]
    out += [(None, "en", "s0"), ("", "", "s1"), ("tie one", "lone", "only")] + [("same words same", "tie", s) for s in ("a", "b", "c")] * 10 + [("\x00 \t", "blank", "a"), ("7", "blank", "b"), ("rare", "blank", "c")]
    return out + [("Long text " * 300_000 + "end", "en", "s3")]


@pytest.mark.parametrize("terms, cell, top, least", [(4, 2, 3, 10), (5, 3, 10, 1), (1 << 15, 1, 10, 10), (3, 100, 1, 30)])
def test_as_brute_force(spark, rows, terms, cell, top, least):
    """Ranges of a few terms, and cells in even and odd numbers."""
    assert got(spark, rows, terms=terms, cell=cell, top=top, least=least) == brute(rows, least, top)


def test_no_rows_and_no_terms(spark):
    assert got(spark, []) == []
    assert got(spark, [("a", None, "y"), (None, "", "x")]) == [("", "x", "pair", "y", 0, 1), ("", "y", "pair", "x", 0, 1)]


def test_counts_in_parts_are_added_up(spark, rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "ROWS", 50)
    batch = pa.table({c: [r[i] or "" for r in rows] for i, c in enumerate(("text", "lang", "source"))})
    found = Counter()
    for b in divergence._counted(iter([*batch.slice(0, 100).to_batches(), *batch.slice(100).to_batches()])):
        for r in b.to_pylist():
            found[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter()
    for text, lang, source in rows:
        want.update((lang or "", source or "", t) for t in TERM.findall((text or "").translate(LOWER)))
    assert found == want


def test_vectors_and_shares_at_any_size():
    at, n = np.array([0, 3, 70_000]), np.array([1, 1 << 40, (1 << 32) - 1])
    out = divergence.unpacked(divergence.packed(at, n), 70_001)
    assert out[at].tolist() == n.tolist() and out.sum() == n.sum()
    for total in (10, 10**12, 8 * 10**15, 10**17):
        c = np.array([0, 1, total // 3, total - 5])
        assert divergence.shares(c, total, 7).tolist() == [1 + 10**9 * (x + 2) // (total + 14) for x in c.tolist()]
