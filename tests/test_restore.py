"""Paragraphs, tables and block orders by hand, and merged texts that are cut where their parts meet."""

import random

from brindle.operators import restore


def test_offset_map():
    plain, at = restore.offset_map(r"a\*b \\ c\d \ ")
    assert plain == "a*b \\ c\\d \\ " and [r"a\*b \\ c\d \ "[i] for i in at[:-1]] == list(plain) and at[-1] == 14
    assert restore.offset_map("")[0] == "" and restore.offset_map("\\")[0] == "\\"


def test_slices():
    cut = restore.slices
    assert cut("one two  three", ["one two", "three"]) == ["one two  ", "three"]
    assert cut(r"a\*b c\_d ", [" a*b", "c_d"]) == [r"a\*b ", r"c\_d "]
    assert cut("inter national", ["inter-", "national"], True) is None
    assert cut("international law", ["inter-", "national law"], True) == ["inter", "national law"] and cut("international", ["inter-", "national"]) is None
    assert cut("inter-national", ["inter-", "national"], True) == ["inter-", "national"] and cut("12 3", ["1-", "23"], True) is None
    assert cut("one two", ["one"]) is None and cut("one", ["one", "two"]) is None and cut("one", ["one", " "]) is None and cut("x", []) is None
    assert cut("*", ["\\*"]) is None and cut("\\*", ["\\*"]) == ["\\*"] and cut("  ", [""]) is None
    draw = random.Random(1)
    for _ in range(300):
        parts = ["".join(draw.choice("ab*_ .é日") for _ in range(draw.randint(1, 9))).strip() or "x" for _ in range(draw.randint(1, 5))]
        dressed = ["".join("\\" + c if c in restore.ESCAPED and draw.random() < 0.5 else c for c in p) + draw.choice([" ", "\n", "  "]) for p in parts]
        assert cut("".join(dressed), parts) == dressed


FIELDS = "doc_id int, place int, page int, type string, text string, deleted boolean, source string"


def restored(spark, rows):
    return {(r.doc_id, r.place): (r.restored, r.reason) for r in restore.restored_paragraphs(spark.createDataFrame(rows, FIELDS)).collect()}


def test_paragraphs_over_pages(spark):
    text = lambda d, p, page, t, source=None: (d, p, page, "text", t, False, source)
    hole = lambda d, p, page, source: (d, p, page, "text", "", True, source)
    other = lambda d, p, page, kind: (d, p, page, kind, "x", False, None)
    rows = [text(1, 1, 1, "begin", "begin"), text(1, 2, 1, "one two three", "one"), other(1, 3, 1, "footer"), other(1, 4, 2, "header"), hole(1, 5, 2, "two"), other(1, 6, 2, "image"), hole(1, 7, 3, "three"), other(1, 8, 3, "footer"), text(1, 9, 3, "end", "end")]
    rows += [hole(2, 1, 1, "a"), text(2, 2, 1, "b", "b"), other(2, 3, 1, "title"), hole(2, 4, 1, "c")]
    rows += [text(3, 1, 2, "one two", "one"), hole(3, 2, 1, "two"), text(4, 1, 1, "one two", "one"), hole(4, 2, 1, "other"), text(5, 1, 1, "", None), text(5, 2, 1, "  ", "x"), hole(5, 3, 1, "y"), text(6, 1, 1, "a b", "a"), hole(6, 2, 1, None)]
    rows += [text(7, 1, 1, " ".join("ab" for _ in range(66)), "ab"), *(hole(7, i, 1, "ab") for i in range(2, 67))] + [text(8, 1, 1, "a b", "a"), *(other(8, i, 1, "image") for i in range(2, 67)), hole(8, 67, 2, "b")]
    got = restored(spark, rows)
    assert [got[1, i] for i in range(1, 10)] == [("begin", None), ("one ", None), ("x", None), ("x", None), ("two ", None), ("x", None), ("three", None), ("x", None), ("end", None)]
    assert got[2, 1] == ("", "no target") and got[2, 2] == ("b", None) and got[2, 4] == ("", "target without text") and got[2, 3][1] == "target without text"
    assert got[3, 2] == ("", "pages out of order") and got[4, 1] == ("one two", "text differs") and got[4, 2] == ("", "text differs") and got[6, 2] == ("", "text differs")
    assert got[5, 1] == ("", None) and got[5, 3] == ("", "target without text") and got[7, 66] == ("", "too many parts") and got[8, 67] == ("", "too many between") and got[8, 30] == ("x", None)
    assert restored(spark, []) == {}


def test_tables_over_pages(spark):
    def table(place, page, rows, first=True, last=True, doc=1):
        return [(doc, place, page, first, last, r, c, span, t) for r, row in enumerate(rows) for c, span, t in row]

    head, body = [(0, 1, "Name"), (1, 2, "Sum")], [(0, 1, "a"), (1, 2, "1")]
    rows = table(1, 1, [head, body, body]) + table(2, 2, [[(0, 1, " Name "), (1, 2, "Sum")], body]) + table(3, 3, [body, body]) + table(4, 5, [head]) + table(5, 6, [[(0, 3, "wide")]]) + table(6, 7, [[(0, 3, "more")]], first=False)
    got = {r.place: (r.chain, r.row_offset, r.dropped) for r in restore.continued_tables(spark.createDataFrame(rows, "doc_id int, place int, page int, first boolean, last boolean, row int, col int, span int, text string")).collect()}
    assert got == {1: (1, 0, 0), 2: (1, 2, 1), 3: (1, 4, 0), 4: (4, 0, 0), 5: (5, 0, 0), 6: (6, 0, 0)}


def test_two_parsers_in_one_order(spark):
    fields = "doc_id int, sheet string, place int, anchor int, text string"
    native = spark.createDataFrame([(1, "a", 1, 1, "top"), (1, "a", 2, 10, "mid"), (1, "a", 3, 10, "mid two"), (1, "b", 4, 1, "b")], fields)
    other = spark.createDataFrame([(1, "a", 1, 0, "before"), (1, "a", 2, 12, "mid  two"), (1, "a", 3, 10, "pic"), (1, "a", 4, None, "?"), (1, "c", 5, 1, "c"), (1, "a", 6, 5, "five")], fields)
    got = sorted((r.sheet, r.place_in_sheet or 0, r.origin, r.place, r.conflict) for r in restore.ordered_union(native, other).collect())
    assert got == [("a", 1, "other", 1, None), ("a", 2, "native", 1, None), ("a", 3, "other", 6, None), ("a", 4, "native", 2, None), ("a", 5, "native", 3, None), ("a", 6, "other", 3, None), ("a", 7, "other", 2, "same text"), ("a", 8, "other", 4, "no anchor"), ("b", 1, "native", 4, None), ("c", 0, "other", 5, "no sheet")]


def test_merged_texts_stay_in_arrow(monkeypatch):
    """Few texts of a batch are Python's at once; nulls and texts that aren't of their parts have none."""
    import pyarrow as pa

    monkeypatch.setattr(restore, "TEXTS", 2)
    rows = [("one two", ["one", "two"]), (None, ["x"]), ("x", None), ("x", ["x", None]), ("x", []), ("other", ["one"]), ("日 b", ["日", "b"])]
    texts, parts = (pa.array([r[i] for r in rows], kind) for i, kind in ((0, pa.string()), (1, pa.list_(pa.string()))))
    want = [["one ", "two"], None, None, None, None, None, ["日 ", "b"]]
    assert restore.merged_slices.func(texts, parts).to_pylist() == want
    assert restore.merged_slices.func(texts.slice(0, 0), parts.slice(0, 0)).to_pylist() == []
