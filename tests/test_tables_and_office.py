import io
import uuid
import zipfile

from pyspark.sql import functions as F

from brindle.functions import strings
from brindle.operators import tables
from brindle.sources import office


def test_row_groups(spark):
    cell = lambda n: f'<td rowspan="{n}">x</td>'
    rows = [f"<tr>{cell(2)}{cell(1)}</tr>", f"<tr>{cell(3)}</tr>", f"<tr>{cell(1)}</tr>", f"<tr>{cell(1)}</tr>", f"<tr>{cell(1)}{cell(1)}</tr>"]
    html = f"<table>\n{''.join(rows)}</table>"
    got = tables.html_groups(html)
    assert [g[:3] for g in got] == [(1, 1, 4), (2, 5, 5)]
    assert html[got[0][3] : got[0][4]] == "".join(rows[:4]) and html[got[1][3] : got[1][4]] == rows[4]
    assert tables.html_groups("<table><tr><td rowspan=9>x</td></tr><tr><td>y</td></tr></table>")[0][:3] == (1, 1, 2)
    assert [g[:3] for g in tables.text_groups('a\tb\n"c\nd"\te\n')] == [(1, 1, 1), (2, 2, 2)]
    assert tables.text_groups("a\tb\nc\n") == [(1, 1, 2, 0, 6)]
    frame = spark.createDataFrame([(1, html), (2, "a\tb\nc\td"), (3, None), (4, "")], "table_id long, text string")
    assert sorted((r.table_id, r.group) for r in tables.row_groups(frame).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    cells = lambda *t: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in t) + "</w:tr>"
    body = p("Head", '<w:pStyle w:val="H1"/>') + p("one") + p("Sub", '<w:outlineLvl w:val="1"/>') + f"<w:tbl>{cells('a', 'b')}{cells('c', 'd')}</w:tbl>"
    docx = package({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/styles.xml": f'<w:styles {w}><w:style w:styleId="H1"><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>'})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><f>A1+1</f><v>2</v></c></row><row r="2"><c r="B2"><v></v></c></row></sheetData></worksheet>'
    xlsx = package({"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": sheet, "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>"})
    found = spark.createDataFrame([("a", "docx", docx), ("b", "xlsx", xlsx), ("c", "docx", b"no"), ("d", "txt", b"x")], "path string, kind string, content binary")
    got = {}
    for r in office.office(found).orderBy("path", "block_index").collect():
        got.setdefault(r.path, []).append((r.block_type, r.section, r.text) if r.reason is None else r.reason.split(":")[0])
    assert got["a"] == [("title", "Head", "Head"), ("text", "Head", "one"), ("title", "Head / Sub", "Sub"), ("table", "Head / Sub", "a\tb\nc\td")]
    assert got["b"] == [("table", "Data", "name\t\t=A1+1")] and got["c"] == ["BadZipFile"] and "d" not in got


def test_strings(spark):
    frame = spark.createDataFrame([("a",), ("é\x01",), ("",), (None,)], "t string")
    got = frame.select("t", strings.name_uuid(uuid.NAMESPACE_URL, F.col("t")).alias("u"), strings.query_reason(F.col("t")).alias("q")).collect()
    assert [r.u for r in got] == [None if r.t is None else str(uuid.uuid5(uuid.NAMESPACE_URL, r.t)) for r in got]
    assert [r.q for r in got] == [None, "control characters", "empty", "empty"]
    texts = ['{"a": 1}', '{"a": 1, "a": 2}', "[NaN]", "[1e999]", "{", '"\\ud800"', None]
    reasons = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strings.json_reason("t")).collect()]
    assert reasons == [None, "repeated key", "not finite", "not finite", "not JSON", "not JSON", "null"]
    one = spark.range(1).select(strings.bounded_distance(F.lit("abc"), F.lit("abd")), strings.bounded_distance(F.lit("a" * 11_000), F.lit("")), strings.bare_latex(F.lit("$$ a + b $$")), strings.allowed_fields(F.create_map(F.lit("x"), F.lit("long value"), F.lit("y"), F.lit("z")), {"x": 4})).first()
    assert tuple(one) == (1, None, "a+b", {"x": "long"})
