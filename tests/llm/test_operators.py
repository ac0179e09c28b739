import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brindle.llm import chatformat, decontaminate, editcount, mixing, quality, topk, toxicity


def test_perspectives(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, " ", "who"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (1, 1, "ann", "hi <|end|>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as segment", "2 as own")
    got = chatformat.perspectives(turns).collect()
    assert len(got) == 5 * 3 + 1
    ann = sorted((r for r in got if r.conv_id == 1 and r.perspective == "ann"), key=lambda r: r.turn)
    assert [r.role for r in ann] == ["system", "assistant", "assistant", "user", "user"]
    assert ann[1].segment == "<|assistant|>\nhi < |end|><|end|>\n" and ann[1].segment[ann[1].mask_begin : ann[1].mask_end] == "hi < |end|><|end|>"
    assert ann[3].segment == "<|user bob|>\n<|end|>\n" and (ann[3].mask_begin, ann[3].mask_end) == (0, 0)
    assert {r.perspective for r in got if r.conv_id == 1} == {"ann", "bob", "unknown"}
    assert chatformat.perspectives(turns.where("false")).count() == 0


def brute_top_k(rows, queries, k):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None}
    out = []
    for q, x in {r for r in rows if queries(r[0])}:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("piece, block, strip", [(16384, 2048, 1 << 20), (16, 4, 1 << 20), (1, 1, 8)])
def test_top_k(spark, piece, block, strip):
    rng = random.Random(piece)
    rows = [(i, [rng.randint(-3, 3) for _ in range(6)]) for i in range(90)] + [(200, [0] * 6), (201, [1, 2]), (None, [1] * 6), (202, None), (3, None), (21, [9] * 6)]
    rows += rows[:5]
    table = spark.createDataFrame(rows, "id long, vector array<long>")
    table = table.selectExpr("*", "1 as cell", "2 as rank", "3 as score")
    found = topk.top_k(table.where("id % 20 = 0"), table, 7, piece=piece, block=block, strip=strip).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute_top_k(rows, lambda i: i % 20 == 0, 7)
    assert topk.top_k(table.where("false"), table, 3).count() == 0 and topk.top_k(table, table.where("false"), 3).count() == 0


def test_scaled(spark):
    rows = [([0.5, -0.01],), ([float("nan"), 1.0],), ([float("inf")],), ([None, 1.0],), (None,), ([],)]
    assert [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(topk.scaled("v")).collect()] == [[32, -1], None, None, None, None, []]


def best_of(rows, ids, query, own, k):
    return sorted((-sum(int(a) * int(b) for a, b in zip(r, query)), int(i)) for i, r in zip(ids, rows) if i != own)[:k]


def test_threshold_stops_early_and_carries_its_kth_score():
    rng = np.random.default_rng(0)
    rows = rng.normal(0, 1, (400, 3))[rng.integers(0, 400, 30_000)] + rng.normal(0, 0.02, (30_000, 3))
    rows = np.floor(512 * rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.int64)
    ids = rng.permutation(30_000)
    block = topk.Block(ids[:50], rows[:50], 20)
    read = []
    for i in range(0, 30_000, 10_000):
        order = np.argsort(ids[i : i + 10_000])
        before = block.scored
        block.read(ids[i : i + 10_000][order], rows[i : i + 10_000][order])
        read.append((block.scored - before) / (50 * 10_000))
    for q in range(50):
        assert list(zip((-block.best[q]).tolist(), block.best_id[q].tolist())) == best_of(rows, ids, rows[q], ids[q], 20)
    assert max(read[1:]) < 0.6


@pytest.mark.parametrize("large", [1 << 27, 1 << 30, 1 << 31])
def test_scores_beyond_doubles_are_exact(large):
    rng = np.random.default_rng(1)
    rows = rng.integers(-large, large, (300, 1 if large == 1 << 31 else 4))
    block = topk.Block(np.arange(5), rows[:5], 7)
    for i in (0, 150):
        block.read(np.arange(i, i + 150), rows[i : i + 150])
    for q in range(5):
        assert list(zip((-block.best[q]).tolist(), block.best_id[q].tolist())) == best_of(rows, range(300), rows[q], q, 7)
    with pytest.raises(OverflowError):
        topk.product(np.array([[1 << 40]]), np.array([[1 << 40]]))


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_ = 1.5 * sum(sizes.values()), set(sizes)
    target = {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", "c", "c", None, "é"]), " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 30)))) for i in range(900)]
    rows += [(1000, "z", None), (1001, "a", " \t\n\x0b"), (None, "a", "x y"), (5, "a", "twice here"), (5, "a", "twice here"), (1002, "b", "long " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as target", "3 as bucket")
    got = mixing.mix(docs.repartition(7)).collect()
    again = mixing.mix(docs.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert sum(sizes.values()) == sum(len((t or "").split()) for _, _, t in rows)
    for s, t in brute_targets(sizes).items():
        assert taken[s] == pytest.approx(t, abs=1)
        assert all(r.target == pytest.approx(t) for r in got if r.source == s)
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixing_in_groups_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 4)
    monkeypatch.setattr(mixing, "GROUP", 3)
    rows = [(i % 150 if i % 3 else None, "ab"[i % 5 == 0], " ".join(["w"] * (i % 13))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=1) and len({r.taken - r.size for r in own if r.size}) > 2
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("taken", F.lit(1)), carry=("taken",))


def test_mixed_keeps_rows_of_any_kind_apart(spark):
    rows = [(None, "a", None), (None, "a", " "), (1, "a", "x y"), (1, "a", "x y"), (2, None, "z " * 300), (3, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as taken", "3 as _row")
    got = mixing.mixed(docs).collect()
    assert got and got[0].__fields__ == docs.columns and all(r.text.strip() for r in got)
    assert sum(len(r.text.split()) for r in got) == pytest.approx(1.5 * 304, abs=2)
    assert mixing.mixed(docs.where("false")).count() == 0


def test_mixed_rows(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"one two three {i} five", 9, "en") for i in range(40)], "doc_id long, source string, text string, n_chars long, lang string")
    got = mixing.mixed(docs).collect()
    words = {s: sum(len(r.text.split()) for r in got if r.source == s) for s in "ab"}
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    assert words == want and sorted(got[0].asDict()) == sorted(docs.columns)


def test_tiles_are_greedy():
    word = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert sorted(decontaminate.tiles(word("abcdefghijkl"), word("xghijklxabcdefx"), 5)) == [(0, 8, 6), (6, 1, 6)]
    assert decontaminate.tiles(word("aaaaaa"), word("aaaaaaaaaaaa"), 5) == [(0, 0, 6)]
    assert decontaminate.tiles(word("abcd"), word("abcdabcd"), 5) == []


def test_tiles_of_repetitive_texts_are_the_same_length_by_length():
    rng = np.random.default_rng(2)
    for trial in range(300):
        letters = int(rng.integers(1, 4))
        item, doc = (rng.integers(0, letters, int(rng.integers(0, n))).astype(np.uint64) for n in (25, 60))
        if trial % 3 == 0 and len(item):
            doc = np.concatenate([doc, item[len(item) // 2 :], doc[:3], item[: len(item) // 2 + 2]])
        least = int(rng.integers(1, 6))
        assert decontaminate.tiles(item, doc, least) == decontaminate.tiles(item, doc, least, places=0)


def test_passes_are_bounded(spark):
    items = spark.createDataFrame([(i, "word " * (i % 9)) for i in range(200)] + [(500, "long " * 400), (None, None)], "item_id long, text string")
    parts = list(decontaminate._parts(items, 300))
    assert sorted(str(r.item_id) for p in parts for r in p) == sorted(str(r.item_id) for r in items.collect())
    assert all(sum(len(r.text) + 16 for r in p[1:]) <= 300 + max(len(r.text) + 16 for r in p) for p in parts) and len(parts) > 10


def test_decontamination(spark):
    a, b, c = ("The quick, brown fox jumps over lazy dogs", "alpha beta gamma delta epsilon zeta eta theta iota kappa", "two words")
    items = spark.createDataFrame([(1, a), (2, b), (3, c), (4, None), (5, "?!"), (1, a)], "item_id long, text string")
    texts = {10: f"x {a.upper()} y", 11: "zeta eta theta iota kappa and alpha beta gamma delta epsilon", 12: "alpha beta gamma delta epsilon only", 13: "here are Two “words” indeed", 14: None, 15: "", 16: "clean " * 40000, 17: "two more words", 18: f"{a} {b}"}
    docs = spark.createDataFrame([*texts.items(), (10, texts[10])], "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as tiles")
    for limit in (1 << 20, 60):
        got = sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items, pass_bytes=limit).collect())
        assert got == [(10, 1), (10, 1), (11, 2), (13, 3), (18, 1), (18, 2)]
        assert sorted(r.doc_id for r in decontaminate.clean(docs, items, pass_bytes=limit).collect()) == [12, 14, 15, 16, 17]
    assert decontaminate.matches(docs.where("false"), items).count() == 0 and decontaminate.matches(docs, items.where("false")).count() == 0


def distance(a, b):
    """Optimal string alignment."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d


def test_trie_as_brute_force():
    rng = random.Random(4)
    terms, stems, reach = ["abcab", "bca", "abccba", "aacc", "é1bca"], [False, False, True, False, True], [1, 0, 2, 1, 1]
    trie = toxicity.Trie(terms, stems, reach)
    words = ["".join(rng.choice("abcé1") for _ in range(rng.randint(0, 11))) for _ in range(3000)] + terms + ["x" * 400, "abccba" + "x" * 90]
    found, far = trie.find(words)
    for w, t, d in zip(words, found, far):
        best = {}
        for i, term in enumerate(terms):
            rows = distance(term, w)[-1]
            n = min(rows) if stems[i] else rows[-1]
            if n <= reach[i]:
                best[i] = n
        assert (t == -1) == (not best or not w), w
        if t >= 0:
            assert d == min(best.values()) and best[int(t)] == d


def labelled(spark, n=160):
    rng = random.Random(5)
    clean = ["garden", "river", "music", "window", "paper", "train", "cloud"]
    rows, labels = [], []
    for i in range(n):
        toxic, bad = i % 3 == 0, i % 4 == 0
        words = [rng.choice(clean) + rng.choice("abcdef") for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["dimwit", "blockhead", "dmiwit"]))
        if bad:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, ""), (1001, None), (1002, " \n"), (1003, "word " * 30000), (None, "no id"), (1, rows[1][1])]
    labels += [(None, 1, 1), (5, None, None), (2000, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as label"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label, rule", [(quality, "quality", lambda i: i % 4 != 0), (toxicity, "toxic", lambda i: i % 3 == 0)])
def test_held_out_accuracy(spark, module, label, rule):
    docs, labels = labelled(spark)
    model = module.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    got = module.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 160 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.5) == rule(r.doc_id) for r in held) >= 0.95 * len(held) and len(held) > 30
    assert module.score(docs.where("false"), model).count() == 0


def test_one_label_or_none(spark):
    docs, labels = labelled(spark, 20)
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for some in (labels.where(f"{label} = 1"), labels.where("false")):
            scores = {r.score for r in module.score(docs, module.fit(docs, some)).collect()}
            assert len(scores) == 1 and 0 <= scores.pop() <= 1


def found_in(lexicon, texts):
    data, offsets = toxicity.utf8(pa_array(texts))
    x, h, abuse = toxicity.features(lexicon, data, offsets)
    return [(int(r), texts[int(r)].encode()[b:e].decode(), lexicon.terms[t], int(d), float(a)) for r, b, e, t, d, a in zip(h.row, h.begin, h.end, h.term, h.distance, abuse)]


def test_hits_as_a_slow_scan():
    rng = random.Random(11)
    lexicon = toxicity.Lexicon(["dimwit", "cur", "blockhe"], [False, False, True], [1, 0, 1], np.array([3.0, 2.0, 2.0]))
    pool = ["dimwit", "dimwti", "dimwiit", "cur", "cut", "curs", "blockhead", "bolckheads", "river", "“cur”", "é", "$cur", "xdimwitx", "DIMWIT,"]
    texts = ["", " ", *(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    want = []
    for r, text in enumerate(texts):
        for word in re.findall(r"[0-9a-z*@$!'\u0080-\uffff]+", re.sub("[“”]", " ", text.lower())):
            word = word.strip("*@$!'")
            best = None
            for term, stem, reach in zip(lexicon.terms, lexicon.stems, lexicon.reach):
                row = distance(term, word)[-1]
                d = min(row) if stem else row[-1]
                if d <= reach and (best is None or d < best[3]):
                    best = (r, word, term, d)
            want += [best] if best else []
    assert [(r, w.lower(), t, d) for r, w, t, d, _ in found_in(lexicon, texts)] == want and len(want) > 100


def test_quotation_is_told_from_abuse_by_learned_contexts(spark):
    rng = random.Random(6)
    other = ["garden", "river", "music", "window", "paper", "train", "cloud", "stone", "bread", "light"]
    some = lambda: [rng.choice(other) + rng.choice("abcdefghij") for _ in range(rng.randint(12, 30))]
    rows = []
    for i in range(360):
        abuse, report = ["you", "are", "a", *some()[:1], "dimwit", "indeed"], ["critics", "reported", "the", "word", '"dimwit"', "yesterday"]
        words = some() + (abuse if i % 3 == 0 else report if i % 18 == 1 else []) + some()
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(docs, docs.select("doc_id", F.col("label").alias("toxic")))
    assert "dimwit" in model.lexicon.terms
    asked = [(1, "stonea breadb you are a breadc dimwit indeed musicc"), (2, 'papera critics reported the word "dimwit" yesterday lightd'), (3, "trainb critics reported the word dimwit yesterday"), (4, "rivera you are a stonej dmiwit indeed")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    abuse = {i: next(h.abuse for h in r.hits if h.term == "dimwit") for i, r in got.items()}
    assert min(abuse[1], abuse[4]) > 0.9 and abuse[2] < 0.3 and abuse[3] < abuse[1]
    assert got[1].score >= 0.5 > got[2].score and got[4].score >= 0.5


def test_terms_of_any_number_and_length(spark):
    rng = random.Random(7)
    bad = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "ptkmnl"] + ["q" + "z" * 30]
    fine = lambda n: [rng.choice("rstvw") + rng.choice("aeiou") * 2 + rng.choice("lmn") + rng.choice("aeiouy") for _ in range(n)]
    rows = [(i, " ".join(fine(8) + [w for b in rng.sample(bad, 60) for w in (b, *fine(1))])) for i in range(60)] + [(100 + i, " ".join(fine(60))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn_terms(toxicity.sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", 3000))
    assert {b for b in bad if len(b) == 3} <= set(lexicon.terms) and ("q" + "z" * 15) in lexicon.terms
    many = toxicity.Lexicon([f"w{i:05d}" for i in range(3000)], [False] * 3000, [1] * 3000, np.ones(3000))
    assert [t for _, _, t, _, _ in found_in(many, ["w00017 w02999 x"])] == ["w00017", "w02999"]


def test_terms_inside_scripts_without_spaces(spark):
    rng = random.Random(8)
    letters = [[chr(c) for c in range(a, a + 90)] for a in (0x4E10, 0x3042, 0x0E01 - 40)]
    letters[2] = [chr(c) for c in range(0x0E01, 0x0E2F)]
    planted = ["\u9a6c\u9e7f\u864e", "\u304b\u3070\u306e\u3082\u306e", "\u0e04\u0e27\u0e32\u0e22\u0e42\u0e07\u0e48"]
    rows = []
    for i in range(400):
        own = letters[i % 3]
        run = lambda: "".join(rng.choice(own) for _ in range(rng.randint(40, 120)))  # noqa: E731, B023
        rows.append((i, run() + (planted[i % 3] if i % 2 else "") + run() + "\u3002abc " + run(), i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.where("doc_id % 4 < 2"))
    for p in planted:
        assert any(t in p for t in model.lexicon.terms), p
    got = toxicity.score(docs.where("doc_id % 4 > 1"), model).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got) >= 0.95 * len(got) and len(got) == 200
    text = {r[0]: r[1].encode() for r in rows}
    for r in got:
        assert all(text[r.doc_id][h.begin : h.end].decode() == h.term for h in r.hits if not h.distance)


def test_hits_without_spaces_as_a_slow_scan():
    rng = random.Random(12)
    a, b, c, d = "\u4e00\u4e01\u3042\U00020000"
    terms = [a + b, c + a + b + d, "dimwit"]
    lexicon = toxicity.Lexicon(terms, [True, True, False], [0, 1, 1], np.array([2.0, 3.0, 3.0]))
    texts = ["", a, "".join([a, b])] + ["".join(rng.choice([a, b, c, d, " ", "dimwit", "dimwt", "\u3002"]) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    want = []
    for r, text in enumerate(texts):
        for run in re.finditer(f"[{a}{b}{c}{d}]+|[a-z]+", text):
            word, found = run[0], {}
            for i in range(len(word) if word[0] >= a or word[0] == c else 1):
                for term, stem, reach in zip(terms, lexicon.stems, lexicon.reach):
                    row = distance(term, word[i:])[-1]
                    far = min(row) if stem else row[-1]
                    if far <= reach and far < found.get(i, ("", 9))[1]:
                        found[i] = term, far
            kept = {i: (t, f) for i, (t, f) in found.items() if not f or not (i - 1 in found and found[i - 1][1] <= f) and not (i + 1 in found and found[i + 1][1] < f)}
            want += [(r, len(text[: run.start() + i].encode()), t, f) for i, (t, f) in sorted(kept.items())]
    data, offsets = toxicity.utf8(pa_array(texts))
    h, _ = toxicity.hits(lexicon, data, offsets)
    assert [(int(r), int(s), terms[t], int(f)) for r, s, t, f in zip(h.row, h.begin, h.term, h.distance)] == want and len(want) > 200
    assert {f for *_, f in want} == {0, 1} and {t for _, _, t, _ in want} == set(terms)


def test_long_words_and_equal_hashes_are_compared():
    lexicon = toxicity.Lexicon(["dimwit"], [False], [1], np.ones(1))
    words = ["dimwit", "river", "dimwit" + "x" * 80, "x" * 5000, "dmiwit"]
    part = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    for _ in range(2):  # one hash for all of them: the second time finds the cache full of another word
        term, far = lexicon.lookup(part, starts, ends, np.zeros(len(words), np.uint64))
        assert term.tolist() == [0, -1, -1, -1, 0] and far.tolist() == [0, 0, 0, 0, 1]


def test_kept_columns_cannot_be_made_here(spark):
    docs = spark.createDataFrame([(1, "some words", 1.0)], "doc_id long, text string, score double").selectExpr("*", "1L as n_tokens", "'x' as Tiles")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    calls = [
        lambda: toxicity.score(docs, toxicity.Model(toxicity.Lexicon([], [], [], np.zeros(0)), np.zeros(6), 0.0), keep=("score",)),
        lambda: quality.score(docs, quality.train(lambda: iter([])), keep=("doc_id", "Score")),
        lambda: editcount.counted(docs, tokenizer=tokenizer, keep=("n_tokens",)),
        lambda: editcount.edited(docs, tokenizer=tokenizer, keep=("doc_id", "text")),
        lambda: decontaminate.matches(docs, docs, keep=("Tiles",)),
    ]
    for call in calls:
        with pytest.raises(ValueError, match="can't be kept"):
            call()


def pa_array(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())


def bags_of(x, bag, y):
    return lambda: iter([(x.astype(np.float32), bag, y)])


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(1)
    x, bag = rng.normal(size=(40, 5)), np.repeat(np.arange(10), 4)
    y = (np.maximum.reduceat(x[:, 0], np.arange(0, 40, 4)) > 1).astype(float)
    model = quality.train(bags_of(x, bag, y), steps=300)
    s, attention = model.score(x, bag, 10)
    assert ((s > 0.5) == y).mean() >= 0.9 and np.allclose(np.add.reduceat(attention, np.arange(0, 40, 4)), 1)
    assert math.isclose(float(quality.train(bags_of(x, bag, np.ones(10))).score(x, bag, 10)[0][0]), 1.0)


def test_forward_as_a_loop_and_slopes_as_differences():
    rng = np.random.default_rng(3)
    sizes = [1, 4, 2, 5]
    x, bag, y = rng.normal(size=(12, 5)), np.repeat(np.arange(4), sizes), np.array([1.0, 0, 1, 0])
    model = quality.train(bags_of(x, bag, y), steps=5)
    w, sigmoid = model.weights, lambda v: 1 / (1 + math.exp(-v))
    scores = []
    for b in range(4):
        hidden = [np.tanh(np.clip((r - model.mean) / model.scale, -6, 6) @ w["encode"] + w["encode_bias"]) for r in x[bag == b]]
        raw = [sum(math.tanh(float(h @ w["content"][:, g])) * sigmoid(float(h @ w["gate"][:, g])) * w["attend"][g] for g in range(8)) for h in hidden]
        share = [math.exp(r) / sum(map(math.exp, raw)) for r in raw]
        scores.append(sigmoid(float(sum(a * h for a, h in zip(share, hidden)) @ w["out"]) + w["bias"][0]))
    assert np.allclose(model.score(x, bag, 4)[0], scores)
    loss = lambda: float(-(y * np.log(model.score(x, bag, 4)[0]) + (1 - y) * np.log(1 - model.score(x, bag, 4)[0])).sum())
    for name, slope in quality.slopes(model, x, bag, y, np.ones(4)).items():
        at = tuple(rng.integers(0, n) for n in w[name].shape)
        kept = w[name][at]
        w[name][at] = kept + 1e-5
        up = loss()
        w[name][at] = kept - 1e-5
        assert math.isclose((up - loss()) / 2e-5, slope[at], rel_tol=1e-3, abs_tol=1e-7), name
        w[name][at] = kept


def test_all_passages_of_long_documents_train_and_batches_may_be_read_again(spark):
    rng = random.Random(9)
    fine = lambda n: " ".join(rng.choice(["garden", "river", "music", "paper"]) for _ in range(n))
    rows = [(i, fine(64 * 300) + (" %%% ### $$$ !!!" * 16 if i % 2 else "") + " " + fine(64 * 40)) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    kept, read = quality.fit(docs, labels), quality.fit(docs, labels, kept=0)
    assert all(np.array_equal(kept.weights[k], read.weights[k]) for k in kept.weights)
    got = quality.score(docs, kept).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in got) >= 22 and {r.passages for r in got} <= {340, 341}


@pytest.mark.parametrize("places", [1, 50, 1 << 20])
def test_a_phrase_of_all_items_is_no_candidate(places):
    """Only pairs whose shared seeds stand on enough of the item are tiled, and none that reaches the threshold is lost."""
    import random

    import pyarrow as pa

    from brindle.llm import decontaminate as D

    draw = random.Random(3)
    some = lambda n: " ".join("".join(draw.choices("abcdefghij", k=4)) for _ in range(n))
    items = [f"{some(8)} one two three four five {some(8)}" for _ in range(40)] + ["one two three four five six", "tiny item", ""]
    halves = items[5].split(" ")
    docs = [f"{some(50)} one two three four five {some(50)}" for _ in range(20)] + [items[3], "", " ".join([*halves[10:], "x", *halves[:10]]), "one two three four five six", "a tiny item", f"{items[7]} {items[8]}"]
    index = D.Index.of(items, 5)
    words, row = D.word_hashes(pa.array(docs))
    found = index.candidates(words, row, 0.8, places)
    wanted, first = [], np.searchsorted(row, np.arange(len(docs) + 1))
    for r in range(len(docs)):
        for i, item in enumerate(index.words):
            if len(item) and sum(t[2] for t in D.tiles(item, words[first[r] : first[r + 1]], index.least[i])) >= 0.8 * len(item):
                wanted.append((r, i))
    assert set(wanted) <= set(found) and len(found) <= len(wanted) + 2
    assert [x[:2] for x in D._compared(index, pa.array(docs), 0.8)] == wanted and len(wanted) >= 6


def test_names_that_decontamination_makes_cant_be_kept(spark):
    from brindle.llm import decontaminate as D

    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, tiles int")
    with pytest.raises(ValueError, match="tiles"):
        D.matches(docs, spark.createDataFrame([(1, "a")], "item_id long, text string"), keep=("doc_id", "tiles"))
