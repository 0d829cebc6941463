"""Archives and workbooks read member by member (SRC7, SRC10)."""

import csv
import io
import zipfile

import pytest

from tessel.plans.staging import workbook_bytes
from tessel.sources import archives


def write_zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, rows in members.items():
            text = io.StringIO()
            csv.writer(text, lineterminator="\n").writerows(rows)
            z.writestr(name, text.getvalue())


def test_eight_members_are_eight_partitions(spark, tmp_path):
    members = {f"data/m{i}.csv": [["id", "note"], *[[100 * i + k, f"a,\n\"{k}\""] for k in range(5)]] for i in range(8)}
    write_zip(tmp_path / "one.zip", members | {"readme.txt": [["no"]], "data/": []})
    df = archives.read_zip_members(spark, str(tmp_path), "note string, id bigint")
    assert df.rdd.getNumPartitions() == 8
    assert sorted(map(tuple, df.collect())) == sorted((f"a,\n\"{k}\"", 100 * i + k) for i in range(8) for k in range(5))


def test_cells_headers_and_empty_members(spark, tmp_path):
    write_zip(tmp_path / "a.zip", {"x.csv": [["b", "a"], ["x", "1"], ["", "bad"], ["short"], ["NaN", "3"]], "none.csv": [], "head.csv": [["a", "b"]]})
    (tmp_path / "_hidden").mkdir()
    write_zip(tmp_path / "_hidden" / "h.zip", {"x.csv": [["a", "b"], ["9", "9"]]})
    got = archives.read_zip_members(spark, str(tmp_path / "a.zip"), "a int, b string").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "x"), (None, None), (None, "short"), (3, "NaN")]))
    assert archives.read_zip_members(spark, str(tmp_path), "a int", members="head*").count() == 0
    lost = archives.read_zip_members(spark, str(tmp_path / "a.zip"), "zz int", members="x.csv")
    with pytest.raises(Exception, match="columns not in the header"):
        lost.collect()
    with pytest.raises(Exception):
        archives.read_zip_members(spark, str(tmp_path / "nowhere"), "a int").collect()


def test_a_member_is_streamed_in_bounded_batches(tmp_path, monkeypatch):
    rows = [["id", "t"], *[[i, "x" * 50] for i in range(60_000)]]
    write_zip(tmp_path / "big.zip", {"big.csv": rows})
    options = dict(path=str(tmp_path), glob="*.zip", members="*.csv", header=True, sep=",", null_value=None, encoding="utf-8", strict=True, columns=["id"])
    reader = archives.MemberReader(options, archives.csv_members, archives.csv_records)
    part, = reader.partitions()
    asked = []
    plain = zipfile.ZipExtFile.read
    monkeypatch.setattr(zipfile.ZipExtFile, "read", lambda self, n=-1: asked.append(n) or plain(self, n))
    batches = reader.read(part)
    first = next(batches)
    assert first.num_rows == archives.BATCH_RECORDS
    assert sum(b.num_rows for b in batches) == 50_000
    assert -1 not in asked  # never the whole member


def test_every_sheet_is_a_partition(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"w{i}.xlsx").write_bytes(workbook_bytes(["zip", "n"], [(f"0{i}{k}", str(k)) for k in range(4)] + [(None, "7")]))
    df = archives.read_workbook_sheets(spark, str(tmp_path), "n int, zip string, other string")
    assert df.rdd.getNumPartitions() == 3
    want = [(k, f"0{i}{k}", None) for i in range(3) for k in range(4)] + [(7, None, None)] * 3
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    assert archives.read_workbook_sheets(spark, str(tmp_path), "n int", sheet="None*").count() == 0


def test_two_sheets_and_shared_strings(spark, tmp_path):
    raw = workbook_bytes(["a"], [("one",)])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w") as w:
        for name in z.namelist():
            text = z.read(name).decode()
            if name == "xl/workbook.xml":
                text = text.replace("</sheets>", '<sheet name="Second" sheetId="2" r:id="rId2"/></sheets>')
            if name == "xl/_rels/workbook.xml.rels":
                text = text.replace("</Relationships>", '<Relationship Id="rId2" Type="t" Target="/xl/worksheets/other.xml"/></Relationships>')
            w.writestr(name, text)
        ns = archives.NS["m"]
        w.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row>'
                   '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>')
        w.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>a</t></si><si><r><t>tw</t></r><r><t>o</t></r></si></sst>')
    (tmp_path / "w.xlsx").write_bytes(out.getvalue())
    got = archives.read_workbook_sheets(spark, str(tmp_path), "a string")
    assert sorted(r["a"] for r in got.collect()) == ["one", "two"]
    got = archives.read_workbook_sheets(spark, str(tmp_path), "x string, y string, z string", header=False, sheet="Sec*").collect()
    assert [tuple(r) for r in got] == [("a", None, None), ("two", None, "True")]
