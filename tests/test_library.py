import io
import math
import random
import zipfile
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from brindle.functions import formula
from brindle.functions import text as T
from brindle.functions import vectors as V
from brindle.operators import audit, evaluation, lexical, literal, retrieval
from brindle.plans import QUERIES
from brindle.sources import readers
from brindle.streaming import events


def test_bm25_by_hand(spark, tmp_path):
    docs = spark.createDataFrame([(1, "nasa nasa moon"), (2, "moon base"), (3, "other")], "chunk_id long, text string")
    got = {r.chunk_id: r.score for r in lexical.build(docs, str(tmp_path / "i")).top_k("nasa moon", 5).collect()}
    assert got == pytest.approx({1: 4.351484419, 2: 2.772588722})


def test_bm25_ties_scope_and_reuse(spark, tmp_path, monkeypatch):
    rows = [(7, "nasa"), (3, "ＮＡＳＡ"), (5, None), (9, "moon moon nasa")]
    docs = spark.createDataFrame(rows, "chunk_id long, text string")
    index = lexical.index_of(docs, str(tmp_path))
    assert [r.chunk_id for r in index.top_k("NASA", 5).orderBy("rank").collect()] == [3, 7, 9]
    assert index.top_k("nasa", 5, ids=[5]).count() == 0
    # A scope counts for itself: n is 2, the frequency of nasa 2.
    got = {r.chunk_id: r.score for r in index.top_k("nasa unknown", 5, ids=[7, 9]).collect()}
    part = lambda tf, dl: math.log(3 / 2) * (1 + tf * 2.5 / (1.5 * (0.25 + 0.75 * dl / 2) + tf))
    assert got == pytest.approx({7: part(1, 1), 9: part(1, 3)})
    with pytest.raises(ValueError):
        retrieval.scope([])
    with pytest.raises(ValueError):
        index.top_k(" !! ", 5)
    built = []
    monkeypatch.setattr(lexical, "build", lambda *a, **k: built.append(a))
    assert lexical.index_of(docs.repartition(3), str(tmp_path)).path == index.path and not built
    lexical.index_of(spark.createDataFrame([*rows[:3], (9, "moon nasa moon")], docs.schema), str(tmp_path))
    assert len(built) == 1


def test_tokens_fold_compatibility_forms(spark):
    texts = {"ＮＡＳＡ Straße ﬁne": "nasa strasse fine", "全文检索": "全 文 检 索 全文 文检 检索", "A 中": "a 中", "RX-7800-XT BGE-M3 1,234.50 12.5% -10 .5 802.11ax": "rx-7800-xt bge-m3 1234.50 12.5% -10 .5 802.11ax", "100 1000 100A": "100 1000 100a", "٣٤ ①": "٣٤ 1", "": ""}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_join(T.tokens(F.col("t")), " ").alias("k")).collect()
    assert {r.t: r.k for r in rows} == texts
    with pytest.raises(Exception, match="over 2 tokens"):
        spark.createDataFrame([("a b c",)], "t string").select(T.tokens(F.col("t"), 2)).collect()


def test_headings_contents_and_languages(spark):
    level = lambda text, title=False: (text, title)
    cases = {level("# A"): 1, level("### Deep one"): 3, level("1. Scope"): 1, level("1.2.3 Terms"): 3, level("2.1 Is this a heading; no"): None, level("Plain title", True): 1, level("text without"): None, level("3."): None, level("第三章 检索"): 1, level("第十二节 索引"): 2, level("一、总则"): 1, level("（二）范围"): 2, level("1、引言"): 1, level("1. Scope ..... 3"): None}
    rows = spark.createDataFrame(list(cases), "t string, title boolean").select("t", "title", T.heading_level(F.col("t"), F.col("title")).alias("n")).collect()
    assert {(r.t, r.title): r.n for r in rows} == cases
    lines = {"1. Scope ..... 3": ("1. Scope ", "3"), "Annex\tiv": ("Annex", "iv"), "第一章 总则……12": ("第一章 总则", "12"), "Index ···· 90": ("Index ", "90"), "no entry 4": None}
    rows = spark.createDataFrame([(t,) for t in lines], "t string").select("t", T.contents_line(F.col("t")).alias("c")).collect()
    assert {r.t: tuple(r.c) if r.c else None for r in rows} == lines
    keys = {"## 1.2 The  Scope": "thescope", "第一章 总则": "总则", "（二）范围": "范围", "Annex": "annex"}
    rows = spark.createDataFrame([(t,) for t in keys], "t string").select("t", T.title_key(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == keys
    languages = {"<p>全文检索系统的设计与实现方法研究报告中文文本内容说明书第一版本</p>": "zh", "an english text of some length here": "en", "short": "unknown", "中文中文中文 and some english words": "mixed", "&#20013;" * 30: "zh"}
    rows = spark.createDataFrame([(t,) for t in languages], "t string").select("t", T.language(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == languages


def test_contained_passages_of_any_letters_and_length(spark):
    docs = [(1, "the contribution of many small hands"), (2, "数字 12 34 和 文字"), (3, None), (4, "e\u0301tude  in\n two"), (5, "")]
    items = [(10, "ribution of"), (11, "12 34"), (12, "和"), (13, "étude in two"), (14, None), (15, "absent"), (16, ""), (17, "12 34")]
    found = lambda **how: {tuple(r) for r in literal.contained(spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(items, "i long, text string"), by="d", item="i", **how).collect()}
    want = {(1, 10), (2, 11), (2, 12), (2, 17), *((d, 16) for d in (1, 2, 4, 5))}
    assert found() == want == found(limit=20) and found(flatten=True) == want | {(4, 13)}


def test_order_statistics_of_skewed_groups(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.choice([0, 1, 1, 1, 2, 50]) if g == "few" else rng.random())) for g, n in (("few", 400), ("many", 3000), ("one", 1)) for _ in range(n)] + [("few", None)]
    table, shares = spark.createDataFrame(rows, "g string, v double"), {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    for found, rule in ((evaluation.nearest_rank, lambda v, p: v[max(1, math.ceil(len(v) * p)) - 1]), (evaluation.interpolated, lambda v, p: v[math.floor((len(v) - 1) * p)] + (v[math.ceil((len(v) - 1) * p)] - v[math.floor((len(v) - 1) * p)]) * ((len(v) - 1) * p % 1))):
        for r in found(table, ["g"], "v", shares).collect():
            own = sorted(v for g, v in rows if g == r.g and v is not None)
            assert {n: getattr(r, n) for n in shares} == pytest.approx({n: rule(own, p) for n, p in shares.items()})


def test_fingerprint_in_levels(spark, monkeypatch):
    monkeypatch.setattr(audit, "FAN", 4)
    rows = [("ab"[i % 2], i, str(i)) for i in range(300)]
    of = lambda rows: {r.g: (r.fingerprint, r.rows) for r in audit.fingerprint(spark.createDataFrame(rows, "g string, o long, t string"), ["g"], F.col("t"), F.col("o")).collect()}
    first, again, other = of(rows), of(rows[::-1]), of([*rows[:-1], ("b", 299, "x")])
    assert first == again and first["a"] == other["a"] and first["b"][0] != other["b"][0] and first["a"][1] == 150


def test_hybrid_with_an_empty_branch(spark):
    one = spark.createDataFrame([(4, 0.9, 1)], "chunk_id long, score double, rank int")
    got = retrieval.hybrid(one, one.where("false")).collect()
    assert [(r.chunk_id, r.dense_rank, r.lexical_rank) for r in got] == [(4, 1, None)] and got[0].fusion_score == pytest.approx(1 / 61)


def test_dense_ignores_null_and_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "chunk_id long, embedding array<float>")
    assert [r.chunk_id for r in retrieval.dense_top_k(rows, [1, 0], 5).orderBy("rank").collect()] == [1, 4]


@pytest.mark.parametrize("text, want", [("a+b*c", "(a + (b * c))"), ("a/(b/c)", "(a / (b / c))"), ("-(a+b)/2.00", "((-(a + b)) / 2)")])
def test_canonical(text, want):
    assert formula.canonical(text) == want


def test_formula_limits():
    assert formula.display(Fraction(1, 2 * 10**12)) == "0" and formula.display(Fraction(3, 2 * 10**12)) == "0.000000000002"
    for bad in ("a=b", "A", "f(a)", "a**2", "1e5", "", "a" * 2000, "+".join("a" * 200)):
        with pytest.raises(formula.FormulaError):
            formula.canonical(bad)
    for zero in ("0*(1/a)", "a/a"):
        with pytest.raises(formula.FormulaError):
            formula.evaluate(zero, {"a": "0"})


def test_a_formula_is_parsed_once(monkeypatch):
    """Rows of one expression share its tree; errors are those of the first thing wrong from the left, limits those of lowest terms."""
    calls, parsed = [], formula.parsed
    monkeypatch.setattr(formula, "parsed", lambda e: calls.append(e) or parsed(e))
    for i in range(50):
        assert formula.evaluate("(c+d)/2 - -c", {"c": str(i), "d": "-0.5"}) == Fraction(3 * i, 2) - Fraction(1, 4)
    assert len(calls) == 1
    for expression, error in (("x+1e5", "symbols"), ("1e5+x", "node"), ("a/(b-b)", "zero division"), ("a/0+x", "zero division"), ("1+", "syntax"), ("*".join("h" * 9), "limit")):
        with pytest.raises(formula.FormulaError, match=error):
            formula.evaluate(expression, {"a": "1", "b": "2", "h": str(1 << 512)})
    assert formula.evaluate("*".join("h" * 8) + "/h" * 8 + "*a", {"a": "7", "h": str((1 << 500) + 1)}) == 7


def test_formulas_of_rows(spark):
    from pyspark.sql import functions as F

    rows = [("a/b", {"a": "1", "b": "3"}), ("a", None), (None, {"a": "1"}), ("a", {"a": "x"}), ("-a/b", {"a": "0.50", "b": "-4"})]
    out = spark.createDataFrame(rows, "e string, m map<string,string>").coalesce(1).select(formula.evaluated(F.col("e"), F.col("m")).alias("r")).select("r.*").collect()
    assert [(r.exact, r.decimal) for r in out] == [("1/3", "0.333333333333"), (None, None), (None, None), (None, None), ("1/8", "0.125")]
    assert [r.error for r in out[:3]] == [None, "symbols", "characters"] and out[3].error


def test_markdown():
    text = "# A\n\npara\nmore\n\n## B\n```\n# no\n```\nUnder\n-----\nend\n# C\n"
    assert readers.markdown_blocks(text) == [("title", "A", "A"), ("text", "A", "para\nmore"), ("title", "A / B", "B"), ("text", "A / B", "```\n# no\n```"), ("title", "A / Under", "Under"), ("text", "A / Under", "end"), ("title", "C", "C")]


def test_content_checks():
    def package(name):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, "x")
        return out.getvalue()

    good = {"pdf": b"%PDF-1.7", "png": b"\x89PNG\r\n\x1a\n..", "docx": package("word/document.xml"), "txt": "é".encode(), "md": "中文".encode("gb18030"), "csv": "﻿a".encode("utf-16")}
    assert {k: readers.content_reason(c, k) for k, c in good.items()} == dict.fromkeys(good)
    assert readers.content_reason(package("other"), "xlsx") == "main part missing"
    assert readers.content_reason(b"a\x00b", "txt") == "not text" and readers.content_reason(b"", "md") == "empty" and readers.content_reason(b"x", "exe") == "unknown format"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "b.md").write_text("# T\nbody")
    (tmp_path / "c.bin").write_text("x")
    found = readers.files(spark, str(tmp_path))
    assert sorted((r.kind, r.reason) for r in readers.checked(found).select("kind", "reason").collect()) == [("md", None), ("txt", None)]
    assert sorted((r.block_index, r.text) for r in readers.paragraphs(found.where("kind = 'txt'")).collect()) == [(1, "one"), (2, "two")]
    assert [(r.block_type, r.section, r.text) for r in readers.markdown(found).orderBy("block_index").collect()] == [("title", "T", "T"), ("text", "T", "body")]


def test_strict_readers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,y\n")
    assert readers.strict_csv(spark, str(tmp_path / "x.csv"), "a int, b string").count() == 2
    (tmp_path / "y.csv").write_text("a,b\n1,x\nz,y\n")
    with pytest.raises(Exception):
        readers.strict_csv(spark, str(tmp_path / "y.csv"), "a int, b string").collect()


def test_replace_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    readers.replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string"), path, "doc_id")
    readers.replace_partition(spark.createDataFrame([(2, "c")], "doc_id int, text string"), path, "doc_id")
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_language_labels(spark):
    rows = [("一二三四五六七八九十一二三四五六七八九十一二三四",), ("plain english text that goes on and on",), ("short",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(T.language(F.coalesce("t", F.lit("")))).collect()] == ["zh", "en", "unknown", "unknown"]


def test_audit_helpers(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, s string")
    assert sorted((r.k, r.v, r.s) for r in audit.latest(rows, "k", ["v"], ["v", "s"]).collect()) == [(1, 2, "b"), (2, 1, "c")]
    assert {(r.k, r.v) for r in audit.unique_lookup(rows.select("k").distinct(), rows, "k", "v").collect()} == {(1, None), (2, 1)}
    small, large = (audit.hash_sample(rows, [], "v", n, "x").select("k", "v").collect() for n in (1, 2))
    assert set(small) <= set(large)


def test_stream_windows(spark, tmp_path):
    rows = spark.sql("select id event_id, id % 3 user_id, if(id % 2 = 0, 'a', 'b') event_type, cast(id as double) value, timestamp'2024-01-01' + make_interval(0,0,0,0,id,0,0) ts from range(60)")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    stream = events.tumbling(events.read_events(spark, str(tmp_path)))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("tumbling_test").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r.start)[:10], r.event_type): r.n for r in spark.table("tumbling_test").collect()}
    assert sum(got.values()) == 60 and got[("2024-01-01", "a")] == 12


def test_edit_distance_of_whole_turns(spark, tmp_path):
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    rng = random.Random(0)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    head = word(200)
    turns = {1: [head, head + word(130), "é" + word(450), "", word(9)], 2: ["a" * 1500, "b" * 1500, "a", "b" * 10_001], 3: [None, "a"], 4: ["alone"]}
    rows = [(c, i, "user", x) for c, texts in turns.items() for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for c, texts in turns.items():
        for i, (a, b) in enumerate(zip(texts, texts[1:])):
            want[c, i] = None if a is None or max(len(a), len(b)) > 10_000 or len(a) * len(b) > 2_000_000 else brute(a, b)
    got = QUERIES["edit_distance"](spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.turn): r.distance for r in got} == want and want[1, 0] == 130 and want[2, 0] is None
    assert {(r.conv_id, r.turn): (r.normalized, r.cer) for r in got}[1, 0] == (round(130 / 330, 6), round(130 / 200, 6))


def test_dense_batch_in_shards_and_blocks(spark, tmp_path):
    rng = random.Random(0)
    vectors = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] for _ in range(120)]
    rows = [*enumerate(vectors), (500, None), (520, [1.0, None, 1.0, 1.0]), (540, [0.0] * 4), (560, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = table.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query")
    pairs = table.join(queries).select("query_id", "vec_id", V.cosine(F.col("embedding"), F.col("query")).alias("score")).where("score is not null").collect()
    want = set()
    for q in {r.query_id for r in pairs}:
        best = sorted((-r.score, r.vec_id) for r in pairs if r.query_id == q)[:7]
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(best, 1)}
    got = retrieval.dense_batch_top_k(table, queries, 7, id="vec_id", shard=30, block=3)
    assert {tuple(r) for r in got.select("query_id", "vec_id", "score", "rank").collect()} == want
    table.where("embedding is not null and vec_id <> 520 and vec_id <> 540").write.parquet(str(tmp_path / "embeddings.parquet"))
    asked = QUERIES["dense_batch_topk"](spark, str(tmp_path)).select("query_id").distinct().collect()
    assert {r.query_id for r in asked} == {0, 20, 40, 60, 80, 100, 560}
