"""Limits and races that are an error or a reason, never a part."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import retrieval, selection
from brindle.sources import readers, sinks


def test_two_writers_of_one_recipe(spark, tmp_path, monkeypatch):
    rows = lambda *x: spark.createDataFrame(list(x), "file_hash string, payload string")
    one, two = (sinks.ParseCache(spark, str(tmp_path), {"v": 1}) for _ in range(2))
    one.put(rows(("a", "1"), ("a", "0")))
    manifest, calls = two.table.manifest, []

    def behind(number=None):
        calls.append(number)
        found = manifest(number)
        if len(calls) == 2:  # between reading and committing another writer commits
            one.put(rows(("b", "other"), ("c", "3")))
        return found

    monkeypatch.setattr(two.table, "manifest", behind)
    two.put(rows(("a", "9"), ("b", "2"), ("d", "4")))
    asked = spark.createDataFrame([(x,) for x in "abcde"], "file_hash string")
    assert sorted((r.file_hash, r.state, r.payload) for r in one.get(asked).collect()) == [("a", "hit", "0"), ("b", "hit", "other"), ("c", "hit", "3"), ("d", "hit", "4"), ("e", "miss", None)]


def test_benchmark_bytes(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"q": "a"}\n{"q": "bcd"}\n')
    read = lambda most: readers.benchmark_rows(spark, str(tmp_path / "q.jsonl"), "jsonl", "q string", most_bytes=most)
    assert read(22).count() == 2
    with pytest.raises(ValueError, match="bytes"):
        read(21)
    spark.createDataFrame([("a",), ("bcd",), (None,)], "q string").write.parquet(str(tmp_path / "q.parquet"))
    assert readers.benchmark_rows(spark, str(tmp_path / "q.parquet"), "parquet", "q string", most_bytes=4).count() == 3
    with pytest.raises(ValueError, match="bytes"):
        readers.benchmark_rows(spark, str(tmp_path / "q.parquet"), "parquet", "q string", most_bytes=3)


def test_branches_that_disagree(spark):
    dense = spark.createDataFrame([(1, "x", 1), (2, "y", None), (3, "z", 1), (3, "z", 1)], "chunk_id int, text string, page int")
    lexical = spark.createDataFrame([(1, "x", 2), (2, "y", None), (4, "w", 1)], "chunk_id int, text string, page int")
    assert sorted(map(tuple, retrieval.branch_conflicts(dense, lexical, ["text", "page"]).collect())) == [(1, "page"), (3, "chunk_id")]


@pytest.mark.parametrize("limits", [{"pairs": 2}, {"chars": 5}])
def test_rerank_over_its_budget(spark, limits):
    hits = spark.createDataFrame([(i, "ab") for i in range(3)], "chunk_id int, text string")
    scorer = lambda text: F.length(text).cast("double")
    assert retrieval.rerank(hits, scorer, pairs=3, chars=6).count() == 3
    with pytest.raises(Exception, match="over"):
        retrieval.rerank(hits, scorer, **limits).count()


def test_members_of_archives(spark):
    members = spark.createDataFrame([("a/x.pdf", 10, 5), ("b/x.pdf", 10, 5), ("b/y.pdf", 10, 5), ("z.pdf", 900, 1), ("big.pdf", 10**9, 10**8), ("../e.pdf", 1, 1), ("c/my.pdf", 1, 1)], "path string, size long, packed long")
    asked = spark.createDataFrame([(x,) for x in ("x.pdf", "b/x.pdf", "y.pdf", "z.pdf", "big.pdf", "e.pdf", "none.pdf")], "wanted string")
    got = {r.wanted: (r.path, r.reason) for r in selection.safe_members(asked, members).collect()}
    assert got == {"x.pdf": (None, "several"), "b/x.pdf": ("b/x.pdf", None), "y.pdf": ("b/y.pdf", None), "z.pdf": (None, "packed too tightly"), "big.pdf": (None, "too large"), "e.pdf": (None, "unsafe path"), "none.pdf": (None, "none")}


def test_vectors_of_one_model(spark):
    parts = {"name": "m", "fingerprint": "0" * 64, "dimension": 2, "normalized": True, "version": 1, "max_length": 8192, "precision": "fp16"}
    own = retrieval.model_identity(**parts)
    assert own == retrieval.model_identity(**dict(reversed(parts.items()))) != retrieval.model_identity(**{**parts, "precision": "fp32"})
    with pytest.raises(ValueError, match="identity"):
        retrieval.model_identity(name="m")
    rows = spark.createDataFrame([(1, own), (2, own)], "id int, model string")
    assert retrieval.of_model(rows, own).count() == 2
    for bad in ("x", None):
        with pytest.raises(Exception, match="another model"):
            retrieval.of_model(rows.unionByName(spark.createDataFrame([(3, bad)], rows.schema)), own).collect()


def test_tables_are_cut_between_rows(spark):
    html = "<table>" + "".join(f"<tr><td>{i} and more</td></tr>" for i in range(9)) + "</table>"
    tsv = "".join(f"{i} x\t{i} y\n" for i in range(9))
    rows = [(1, html, True), (2, tsv, True), (3, "word " * 30, True), (4, html, False), (5, None, True)]
    parts = {}
    for r in retrieval.refined(spark.createDataFrame(rows, "chunk_id int, text string, is_table boolean"), len, 70, table="is_table").collect():
        parts.setdefault(r.chunk_id, []).append((r.start, r.end, r.tokens))
    for i, text, _ in rows[:4]:
        own = sorted(parts[i])
        assert own[0][0] == 0 and own[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(own, own[1:])) and all(n <= 70 for *_, n in own)
    assert all(html[:e].endswith("</tr>") for _, e, _ in sorted(parts[1])[:-1]) and all(tsv[e - 1] == "\n" for _, e, _ in parts[2]) and parts[5] == [(0, 0, 0)]
    assert not all(html[:e].endswith("</tr>") for _, e, _ in sorted(parts[4])[:-1])
