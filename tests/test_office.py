"""Workbooks, documents, PDFs and sketches: containers that the tests write, damaged ones among them."""

import zipfile
import zlib

from pyspark.sql import functions as F

from quillgraph.operators import sketches as SK
from quillgraph.sources import office as O

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def pack(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_workbooks(spark, tmp_path):
    sheet = '<worksheet xmlns="{m}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2"><v>3.25</v></c></row><row><c t="b"><v>1</v></c><c><f>A1</f></c><c t="str"><v>x</v></c></row></sheetData></worksheet>'.format(m=MAIN)
    pack(tmp_path / "a.xlsx", **{
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}"><si><t>no</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>',
        "xl/worksheets/s1.xml": sheet, "xl/worksheets/s2.xml": f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>',
    })
    (tmp_path / "broken.xlsx").write_bytes((tmp_path / "a.xlsx").read_bytes()[:200])
    pack(tmp_path / "other.xlsx", hello="x")
    got = O.workbook_rows(O.files(spark, str(tmp_path), "*.xlsx")).withColumn("path", F.element_at(F.split("path", "/"), -1)).collect()
    assert sorted(tuple(r)[1:5] for r in got if not r.error) == [("One", 2, 2, "rich"), ("One", 2, 27, "3.25"), ("One", 3, 1, "TRUE"), ("One", 3, 3, "x")]
    assert {r.path: r.error for r in got if r.error} == {"broken.xlsx": "BadZipFile", "other.xlsx": "KeyError"}


def test_documents(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = '<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>One</w:t><w:tab/><w:t>two &amp; é</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>x</w:t><w:br/><w:t>y</w:t></w:r></w:p>'
    pack(tmp_path / "a.docx", **{"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'})
    pack(tmp_path / "b.docx", **{"word/document.xml": "<w:document"})
    got = O.paragraph_rows(O.files(spark, str(tmp_path), "*.docx")).collect()
    assert sorted(tuple(r)[1:4] for r in got if not r.error) == [(1, "Title", "One\ttwo & é"), (2, "", ""), (3, "", "x\ny")]
    assert [r.error for r in got if r.error] == ["ParseError"]


def test_pdfs(spark, tmp_path):
    text = rb"BT /F1 9 Tf (Hel\(lo\)) Tj 0 -12 Td [(wor) -20 (ld\041)] TJ T* <C3A4> Tj ET q Q BT <FEFF00e94e2d> Tj ET"
    head = lambda data, extra: b"%PDF-1.4\n1 0 obj\n<<" + extra + b">>\nstream\n" + data + b"\nendstream\nendobj\n"
    (tmp_path / "a.pdf").write_bytes(head(text, b""))
    (tmp_path / "b.pdf").write_bytes(head(zlib.compress(text), b"/Filter /FlateDecode"))
    (tmp_path / "c.pdf").write_bytes(head(b"not deflated", b"/Filter /FlateDecode"))
    (tmp_path / "d.pdf").write_bytes(b"x")
    got = O.pdf_rows(O.files(spark, str(tmp_path), "*.pdf")).withColumn("path", F.element_at(F.split("path", "/"), -1)).collect()
    want = [(1, "Hel(lo)"), (2, "world!"), (3, "Ã¤"), (4, "é中")]
    assert all(sorted((r.n, r.text) for r in got if r.path == p and not r.error) == want for p in ("a.pdf", "b.pdf"))
    assert {r.path: r.error for r in got if r.error} == {"c.pdf": "error", "d.pdf": "ValueError"}
    none = spark.createDataFrame([("x", None)], "path string, content binary")
    assert [r.error for r in O.pdf_rows(none).collect()] and O.pdf_rows(none.limit(0)).count() == 0


def test_sketches_merge(spark, tmp_path):
    df = spark.range(60_000).selectExpr("id % 10 as part", "if(id % 3 = 0, 'a', 'b') as g", "id % 20000 as k", "if(id % 50 = 0, null, cast(id as double)) as v")
    path = str(tmp_path / "s")
    for p in range(10):
        SK.keep(df.filter(F.col("part") == p), path, [F.col("part")], ["g"], "k", "v", mode="append")
    for parts in ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (2, 5)):
        base = df.filter(F.col("part").isin(*parts)).toPandas()
        for r in SK.answer(spark, path, ["g"], F.col("part").isin(*parts), (0.1, 0.5, 0.9)).collect():
            x = base[base.g == r.g]
            assert (r.rows, r.held, r.least, r.greatest) == (len(x), x.v.count(), x.v.min(), x.v.max())
            assert abs(r.distinct - x.k.nunique()) <= SK.DISTINCT * x.k.nunique()
            for q, v in zip((0.1, 0.5, 0.9), r.quantiles):
                assert abs((x.v.dropna() <= v).mean() - q) <= SK.RANK + 1 / len(x)
    empty = spark.createDataFrame([(1, "a", None, None)], "part int, g string, k long, v double")
    SK.keep(empty, str(tmp_path / "e"), [F.col("part")], ["g"], "k", "v")
    one = SK.answer(spark, str(tmp_path / "e"), ["g"]).first()
    assert (one.rows, one.held, one.distinct, one.quantiles) == (1, 0, 0, [None])
