"""Workbooks: cells of every kind against values that the format fixes, and what is written against what is read."""

import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, sheet, shared="", styles="", properties=""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="x"><workbookPr {properties}/><sheets><sheet name="One" sheetId="1" r:id="rId7"/><sheet name="Two" sheetId="2" r:id="rId8"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="worksheets/sheet1.xml"/><Relationship Id="rId8" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{sheet}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{shared}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")


SHARED = "<si><t>Visa Class</t></si><si><r><t>Em</t></r><r><rPr><b/></rPr><t>ployer FEIN</t></r><rPh sb='0' eb='1'><t>no</t></rPh></si><si><t xml:space='preserve'> a &amp; b </t></si>"
STYLES = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="[Red]0.00&quot;days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'


def test_kinds_of_cells(spark, tmp_path):
    sheet = (
        '<row r="1"/><row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="inlineStr"><is><t>Visa  class</t></is></c></row>'
        '<row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4"><v>12.50</v></c><c r="C4"><v>3</v></c></row>'
        '<row r="5"><c r="A5" s="1"><v>45296</v></c><c r="B5" s="2"><v>45296.75</v></c><c r="D5" s="3"><v>0.10000000000000001</v></c></row>'
        '<row r="6"><c r="A6" t="b"><v>1</v></c><c r="B6" t="e"><v>#N/A</v></c><c r="C6" t="str"><f>1+1</f><v>two</v></c><c r="D6"><v>1E+3</v></c></row>'
        '<row r="7"><c r="A7"/></row><row><c t="b"><v>0</v></c><c s="1"><v>59</v></c></row>'
    )
    book(tmp_path / "a.xlsx", sheet, SHARED, STYLES)
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    df = xlsx.read_workbooks(spark, str(tmp_path), required=["VISA_CLASS"])
    assert df.columns == ["VISA_CLASS", "EMPLOYER_FEIN", "VISA_CLASS_2"]
    assert [tuple(r) for r in df.collect()] == [(" a & b ", "12.5", None), ("2024-01-05", "2024-01-05 18:00:00", "0.1"), ("true", None, "1000"), ("false", "1900-02-28", None)]
    assert xlsx.read_workbooks(spark, f"file://{tmp_path}/a.xlsx", sheet="Two").count() == 4
    with pytest.raises(ValueError, match="FEIN_X"):
        xlsx.read_workbooks(spark, str(tmp_path), required=["FEIN_X"])
    with pytest.raises(Exception, match="no sheet"):
        xlsx.read_workbooks(spark, str(tmp_path), sheet="Three").collect()


def test_days_of_the_other_calendar(spark, tmp_path):
    book(tmp_path / "b.xlsx", '<row r="1"><c r="A1" t="str"><v>Day</v></c></row><row r="2"><c r="A2" s="1"><v>43834</v></c></row>', styles=STYLES, properties='date1904="1"')
    assert xlsx.read_workbooks(spark, str(tmp_path)).collect()[0][0] == "2024-01-05"


def test_files_match_by_names(spark, tmp_path):
    row = lambda r, *v: f'<row r="{r}">' + "".join(f'<c t="str"><v>{x}</v></c>' for x in v) + "</row>"
    book(tmp_path / "a.xlsx", row(1, "x", "y") + row(2, 1, 2))
    book(tmp_path / "b.xlsx", row(1, "y", "z") + row(2, 3, 4))
    book(tmp_path / "c.xlsx", "")
    assert sorted(map(tuple, xlsx.read_workbooks(spark, str(tmp_path)).collect()), key=str) == [("1", "2"), (None, "3")]


def test_round_trip_over_tasks_and_files(spark, tmp_path):
    odd = F.element_at(F.array(*map(F.lit, ("<a> & \"b\"\r\n", " x ", "\ttab", "é漢😀"))), (F.col("id") % 4 + 1).cast("int"))
    rows = spark.range(0, 30000, 1, 3).select(F.col("id").cast("string").alias("ID"), F.when(F.col("id") % 3 != 0, odd).alias("TEXT"))
    path = str(tmp_path / "out")
    assert len(xlsx.write_workbooks(rows, path, most_rows=9001)) == 6
    assert len(xlsx.write_workbooks(rows, path, most_rows=9001)) == 6
    back = xlsx.read_workbooks(spark, path, taskBytes="100000")
    assert back.rdd.getNumPartitions() > 6
    assert back.count() == 30000 and back.exceptAll(rows).count() == 0


def test_rows_across_reads(spark, tmp_path, monkeypatch):
    book(tmp_path / "a.xlsx", "".join(f'<row r="{k}" spans="1:2"><c r="A{k}" t="str"><v>{"v" * (k % 50)}{k}</v></c></row>' for k in range(1, 400)))
    for size in (7, 64, 1000):
        monkeypatch.setattr(xlsx, "CHUNK", size)
        with open(tmp_path / "a.xlsx", "rb") as f:
            assert [(n, c[0]) for n, c in xlsx.Workbook(f).rows()] == [(k, "v" * (k % 50) + str(k)) for k in range(1, 400)]


def test_a_folder_without_workbooks(spark, tmp_path):
    with pytest.raises(Exception, match="no workbook"):
        xlsx.read_workbooks(spark, str(tmp_path))


def test_a_part_looks_at_its_own_stretches_only(spark, tmp_path, monkeypatch):
    """Rows and tags across the ends of stretches are one part's each; of other parts' rows none is cut out."""
    values = [f"{k} <&> {'v' * (k % 90)}" if k % 3 else f"{k}" for k in range(300)]
    xlsx.write_workbooks(spark.createDataFrame([(v,) for v in values], "v string").coalesce(1), str(tmp_path))
    for chunk in (64, 257, 5000):
        monkeypatch.setattr(xlsx, "CHUNK", chunk)
        got = []
        for part in range(3):
            with open(next(tmp_path.glob("*.xlsx")), "rb") as f:
                own = list(xlsx.Workbook(f).cells(part, 3))
            assert all(start // chunk % 3 == part for start, _, _ in own)
            got += own
        assert [(n, c[0]) for _, n, c in sorted(got, key=lambda x: x[0])] == list(enumerate(["v", *values], 1))
