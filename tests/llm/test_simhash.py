import random

import numpy as np
import pytest

from brindle.llm import simhash
from brindle.llm.components import components, forest


def brute(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    groups = {}
    for p in prints:
        groups.setdefault(find(p), set()).add(p)
    return sorted(map(sorted, groups.values()))


def test_golay_words_at_distance_one_share_a_key():
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    keys = [set(x[x >= 0]) for x in simhash.golay_keys(words)]
    for bit in range(23):
        assert all(a & set(b[b >= 0]) for a, b in zip(keys, simhash.golay_keys(words ^ (1 << bit))))


def test_links_within_three_bits_share_a_key():
    rng = random.Random(1)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        x, _ = simhash.keys(np.array([a], np.uint64))
        y, _ = simhash.keys(np.array([b], np.uint64))
        assert set(x.tolist()) & set(y.tolist())


def test_forest():
    a, b = forest(np.array([5, 7, 9, 3]), np.array([7, 9, 11, 4]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(4, 3), (7, 5), (9, 5), (11, 5)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90, 200: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    from brindle.llm import components as C

    monkeypatch.setattr(C, "HUB", 3)
    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 60)] + [(500, i) for i in range(501, 540)] + [(530, 59), *((rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60))]
    root = {}
    for a, b in edges * 60:
        low = min(root.get(a, a), root.get(b, b))
        root[a] = root[b] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}


@pytest.mark.parametrize("hot", [2048, 8])
def test_near_duplicates(spark, hot):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(8)]
    texts = [None, "", " \t", "One", "one", "two words", "x" * 40000]
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "One"), (None, "nobody else")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fingerprint", "2 as low"), hot).collect()
    assert len(got) == len(rows)
    prints = {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in got}
    assert prints == {i: simhash.fingerprint(t) for i, t in rows}
    group = {p: g for g in map(tuple, brute(set(prints.values()))) for p in g}
    low = {}
    for i, p in prints.items():
        if i is not None:
            low[group[p]] = min(i, low.get(group[p], i))
    assert {r.doc_id: r.component_id for r in got} == {i: low.get(group[p]) for i, p in prints.items()}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_text_of_many_copies(spark):
    """More copies than one task should get: they meet their component in a broadcast, all others in a join."""
    rows = [(i, "one text that very many rows share with each other") for i in range(300, 700)] + [(i, None) for i in range(1000, 1300)] + [(i, f"text {i} of its own, with words {i * 7} and {i * 13}") for i in range(20)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and {got[i] for i in range(300, 700)} == {300} and {got[i] for i in range(1000, 1300)} == {1000} and all(got[i] <= i for i in range(20))
