"""Budgets, claims, variables, splits and fallbacks by hand."""

from pyspark.sql import functions as F

from brindle.operators import binding, documents, pages


def test_what_fits_is_taken(spark):
    rows = [(1, 1, 5), (1, 2, 6), (1, 3, 4), (1, 4, 1), (1, 5, None), (2, 1, 100), (None, 1, 3)]
    df = spark.createDataFrame(rows, "q int, place int, n int")
    got = {(r.q, r.place): r.taken for r in binding.within_budget(df, "q", "place", F.col("n"), 10).collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): True, (1, 4): True, (1, 5): False, (2, 1): False, (None, 1): True}
    few = binding.within_budget(df.where("q = 1"), "q", "place", F.col("n"), 10, most=1).where("taken").collect()
    assert [r.place for r in few] == [1] and binding.within_budget(df.where("false"), "q", "place", F.col("n"), 10).count() == 0


def test_claims_fail_as_a_whole(spark):
    rows = [(1, 1, "a", ["x", "y"]), (1, 2, "b", ["y"]), (2, 1, "a", ["x"]), (2, 2, "see [1]", ["x"]), (3, 1, "a", ["z"]), (4, 1, "", ["x"]), (5, 1, "a", ["x", "x"]), (6, 1, "a\x07", ["x"]), (7, 1, "no source", []), (8, 1, None, None)]
    claims = spark.createDataFrame(rows, "answer_id int, place int, text string, evidence_ids array<string>")
    evidence = spark.createDataFrame([(i, e) for i in range(1, 9) for e in ("x", "y")] * 2, "answer_id int, evidence_id string")
    got = {r.answer_id: (r.status, r.answer, r.citations) for r in binding.bound_claims(claims, evidence).collect()}
    assert got[1] == ("success", "a [1][2]\n\nb [2]", ["x", "y"]) and got[7] == ("success", "no source ", [])
    assert {i for i, x in got.items() if x == ("failed", None, None)} == {2, 3, 4, 5, 6, 8}


def test_variables_are_bound_by_single_quotes(spark):
    formulas = spark.createDataFrame([(i, ["a", "b"]) for i in range(1, 9)], "formula_id int, variables array<string>")
    user = lambda i, n, v: (i, n, v, None, None)
    rows = [user(1, "a", "1,000.50"), (1, "b", "7", 5, "is 7 m"), user(2, "a", "1"), user(3, "z", "1"), user(4, "a", "1"), user(4, "a", "2"), user(5, "a", "one"), (6, "a", "7", 5, "7 "), (7, "a", "7", 9, "is 7 m"), (8, "a", "7", 6, "aa7"), user(99, "a", "1")]
    inputs = spark.createDataFrame(rows, "formula_id int, name string, value string, block_id int, quote string")
    blocks = spark.createDataFrame([(5, "b is 7 m or 7 ft"), (6, "aaa7 aa7"), (9, "is 7 m"), (9, "is 7 m")], "block_id int, text string")
    got = {r.formula_id: r for r in binding.bound_variables(formulas, inputs, blocks).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "success", 2: "need_variables", 3: "unknown", 4: "conflict", 5: "input", 6: "source", 7: "source", 8: "source"}
    assert [tuple(v) for v in got[1].variables] == [("a", "1000.5", None, None), ("b", "7", 5, 6)] or got[1].variables[1].begin == 5
    assert got[2].missing == ["b"] and got[1].missing == [] and got[3].variables is None


def test_splits(spark):
    sizes = {1: [5] * 7, 2: [3, 9, 1, 1, 8, 2], 3: [11], 4: [1] * 30, 6: [2, None], 7: [0]}
    rows = [(d, i, n) for d, own in sizes.items() for i, n in enumerate(own, 1)] + [(5, 2, 1), (8, 1, 1), (8, 1, 1)]
    found = pages.split_plan(spark.createDataFrame(rows, "doc_id long, page int, bytes long").repartition(3), 3, 10, 5).collect()
    got = {}
    for r in sorted(found):
        got.setdefault(r.doc_id, []).append((r.first, r.last, r.bytes) if r.reason is None else r.reason)
    assert got == {1: [(1, 2, 10), (3, 4, 10), (5, 6, 10), (7, 7, 5)], 2: [(1, 1, 3), (2, 3, 10), (4, 5, 9), (6, 6, 2)], 3: ["a page is too large"], 4: ["too many parts"], 5: ["pages out of order"], 6: ["pages out of order"], 7: ["pages out of order"], 8: ["pages out of order"]}
    assert pages.split_plan(spark.createDataFrame([], "doc_id long, page int, bytes long")).count() == 0


def test_routes_of_workbooks_and_fallback(spark):
    rows = [("xlsx", "auto", ["XLSX_HAS_EXTERNAL_LINK"], False, 0), ("xlsx", "auto", ["XLSX_HAS_EXTERNAL_LINK"], False, 2), ("xlsx", "mineru", [], False, 1), ("xlsx", "native", ["XLSX_EXTERNAL_ASSET_MISSING"], False, 0), ("pdf", "auto", [], True, 0), ("pdf", "auto", ["HAS_IMAGE"], None, 0), ("pdf", "auto", None, False, None), ("txt", "auto", [], False, 0)]
    df = spark.createDataFrame(rows, "kind string, mode string, risks array<string>, unsure boolean, saved int").coalesce(1)
    r = documents.route(F.col("kind"), F.col("mode"), F.col("risks"), F.col("unsure"), F.col("saved"))
    got = [(x.r.strategy, x.r.reasons, x.again and x.again.reasons) for x in df.select(r.alias("r"), documents.fallback(F.col("kind"), F.col("mode"), r, F.lit(0)).alias("again")).collect()]
    assert got == [
        ("failed", ["XLSX_HAS_EXTERNAL_LINK", "XLSX_EXTERNAL_ASSET_MISSING"], None), ("mineru_whole", ["XLSX_WHOLE_WITH_NATIVE_PRIMARY", "XLSX_HAS_EXTERNAL_LINK"], None),
        ("mineru_whole", ["EXPLICIT_MINERU"], None), ("native", ["EXPLICIT_NATIVE", "XLSX_EXTERNAL_ASSET_MISSING"], None), ("failed", ["PREFLIGHT_UNCERTAIN"], None), ("failed", ["HAS_IMAGE"], None),
        ("native", ["NATIVE_COVERAGE_SUPPORTED"], ["NATIVE_COVERAGE_SUPPORTED", "NATIVE_COMPLETENESS_FALLBACK"]), ("native", ["NATIVE_COVERAGE_SUPPORTED"], None),
    ]
    hybrid = documents.route(F.col("kind"), F.col("mode"), F.array(F.lit("HAS_IMAGE")), hybrid=False)
    assert df.limit(1).select(hybrid.alias("r")).first().r.reasons == ["HAS_IMAGE", "XLSX_WHOLE_WITH_NATIVE_PRIMARY"]
