"""SRC1-SRC11 and SNK1-SNK6 on files staged in a scratch folder."""

import os
import tempfile
import zipfile

import pytest

from conftest import rows
from tessel.plans import staging
from tessel.session import shared_dir
from tessel.sources import files, sinks, workbook, zipped

AIRPORTS_DAT = (
    '3411,"Barter Island LRRS Airport","Barter Island","United States","BTI","PABA",'
    '70.1340026855,-143.582000732,2,-9,"A","America/Anchorage","airport","OurAirports"\n'
    '3415,"Hilo ""International"" Airport","Hilo, Big Island","United States","ITO","PHTO",'
    '19.721399307250977,-155.04800415039062,38,-10,"N","Pacific/Honolulu","airport","OurAirports"\n'
    '9999,"No Code",Nowhere,"Atlantis",\\N,\\N,north,1.5,\\N,\\N,\\N,\\N,"airport","OurAirports"\n'
)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tessel-test-")


def test_read_airports_null_token_quotes_and_bad_numbers(spark, scratch):
    path = os.path.join(scratch, "airport_list.csv")
    with open(path, "w") as fh:
        fh.write(AIRPORTS_DAT)
    df = files.read_airports(spark, path).orderBy("AirportID")
    got = df.collect()
    assert df.columns == files.AIRPORT_COLUMNS
    assert got[1].Name == 'Hilo "International" Airport' and got[1].City == "Hilo, Big Island"
    assert got[0].Latitude == 70.1340026855 and got[0].Altitude == 2
    assert got[2].IATA is None and got[2].Latitude is None and got[2].Longitude == 1.5
    keep = files.read_airports(spark, path, null_value=None).orderBy("AirportID").collect()
    assert keep[2].IATA == "\\N"  # SRC3: the token stays text


def test_read_csv_schema_glob_and_extra_null_tokens(spark, scratch):
    for m in (1, 2):
        with open(os.path.join(scratch, f"On_Time_(1987_present)_2024_{m}.csv"), "w") as fh:
            fh.write("FlightDate,Origin,zip\n")
            fh.write(f"2024-0{m}-01,JFK,01001\n2024-0{m}-02,NA,00002\n")
    df = files.read_csv(spark, os.path.join(scratch, "On_Time_(1987_present)_*.csv"),
                        "FlightDate string, Origin string, zip string",
                        extra_null_tokens=["NA"])
    got = rows(df)
    assert len(got) == 4 and ("2024-01-01", "JFK", "01001") in got
    assert ("2024-02-02", None, "00002") in got


def test_csv_sink_and_json_records_round_trip(spark, scratch):
    df = spark.createDataFrame([(1, "00123", None), (2, "x,y", 2.5)], "id long, s string, v double")
    out = os.path.join(scratch, "csv")
    sinks.write_csv(df, out, single_file=True)
    assert len([f for f in os.listdir(out) if f.endswith(".csv")]) == 1
    back = files.read_csv(spark, out, "id long, s string, v double")
    assert rows(back) == rows(df)
    jdir = os.path.join(scratch, "json")
    staging.write_json_records(df, jdir)
    jb = files.read_json_records(spark, jdir, "id long, s string, v double")
    assert rows(jb) == rows(df)


def test_workbook_round_trip_keeps_text_codes(spark, scratch):
    df = spark.createDataFrame([(1, "01001", "São Paulo & <Rio>"), (2, "00007", None)],
                               "customer_id long, zip string, city string")
    n = staging.write_workbooks(df.repartition(2), scratch)
    assert n >= 1
    back = workbook.read_workbooks(spark, scratch, "customer_id bigint, zip string, city string")
    assert rows(back) == rows(df)
    by_pos = workbook.read_workbooks(spark, scratch, "a bigint, b string, c string", header=False)
    assert by_pos.where("a IS NULL").count() == n  # header rows, read as data, do not cast


def test_workbook_parser_shared_strings():
    import io

    sheet = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
             '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
             '<row r="2"><c r="A2"><v>12</v></c><c r="B2" t="b"><v>1</v></c>'
             '<c r="C2" t="str"><v>x</v></c></row></sheetData></worksheet>')
    sst = ('<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
           '<si><t>zip</t></si><si><r><t>ci</t></r><r><t>ty</t></r></si></sst>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", sst)
    assert workbook.parse_workbook(buf.getvalue()) == [["zip", None, "city"], ["12", "True", "x"]]


def test_a_sheet_is_parsed_as_a_stream(spark, scratch, monkeypatch):
    import io
    import itertools

    cells = [(f"{i:06d}", None if i % 3 else f"<{i}>") for i in range(30_000)]
    raw = staging.workbook_bytes(["zip", "city"], cells)
    asked = []
    plain = zipfile.ZipExtFile.read
    monkeypatch.setattr(zipfile.ZipExtFile, "read", lambda self, n=-1: asked.append(n) or plain(self, n))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        records = workbook.sheet_rows(z, "xl/worksheets/sheet1.xml")
        assert next(records) == ["zip", "city"] and next(records) == ["000000", "<0>"]
        assert len(asked) < 10  # of a sheet of a few megabytes
        batches = list(workbook.text_batches((r + [None] * (2 - len(r)) for r in itertools.chain([["000000", "<0>"]], records)), ["zip", "city"]))
    assert not {-1, None} & set(asked)  # never the whole sheet
    assert max(b.num_rows for b in batches) <= workbook.BATCH_RECORDS
    assert [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))] == cells
    for k in range(2):
        with open(os.path.join(scratch, f"w{k}.xlsx"), "wb") as fh:
            fh.write(raw)
    back = workbook.read_workbooks(spark, scratch, "city string, zip string, other int")
    assert sorted(map(str, back.collect())) == sorted(f"Row(city={c!r}, zip={z!r}, other=None)" for z, c in cells * 2)


def test_workbooks_are_written_row_by_row(spark, scratch, monkeypatch):
    import tracemalloc

    with open(os.path.join(scratch, "one.xlsx"), "wb") as fh:
        tracemalloc.start()
        n = staging.write_workbook(fh, ["id", "t"], ((str(i), "x" * 40) for i in range(40_000)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert n == 40_000 and peak < 2_000_000  # its sheet has 6 MB
    monkeypatch.setattr(staging, "SHEET_ROWS", 11)  # the header's row and ten more
    df = spark.range(0, 25, 1, 1).selectExpr("id", "concat('0', id) zip")
    folder = os.path.join(scratch, "cut")
    assert staging.write_workbooks(df, folder) == 3
    sizes = [len(workbook.parse_workbook(open(os.path.join(folder, f), "rb").read())) for f in os.listdir(folder) if f.endswith(".xlsx")]
    assert sorted(sizes) == [6, 11, 11]
    assert rows(workbook.read_workbooks(spark, folder, "id bigint, zip string")) == rows(df)
    assert staging.write_workbooks(df.limit(0), os.path.join(scratch, "none")) == 0


def test_zip_members_take_rows_in_turn(spark, scratch):
    df = spark.range(0, 8, 1, 1).selectExpr("id", "if(id = 3, null, concat('a,\n\"', id, 'é')) t")
    assert staging.write_zipped_csv(df, scratch, members=3) == 1
    with zipfile.ZipFile(os.path.join(scratch, "part-00000.zip")) as z:
        assert z.namelist() == ["data/part.csv", "data/part1.csv", "data/part2.csv"]
        assert [z.read(n).decode().count("é") for n in z.namelist()] == [2, 3, 2]
    assert rows(zipped.read_zipped_csv(spark, scratch, "id bigint, t string")) == rows(df)


def test_zipped_csv_members_and_directories(spark, scratch):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(25)], "id long, name string")
    n = staging.write_zipped_csv(df.repartition(3), scratch)
    assert n == 3
    with zipfile.ZipFile(os.path.join(scratch, "extra.zip"), "w") as z:
        z.writestr("nested/dir/more.csv", "id,name\n100,deep\n")
        z.writestr("readme.txt", "not a csv\n")
    back = zipped.read_zipped_csv(spark, scratch, "id long, name string")
    assert back.count() == 26 and back.where("name = 'deep'").count() == 1
    with zipfile.ZipFile(os.path.join(scratch, "more.zip"), "w") as z:
        z.writestr("a.csv", 'name,extra,id\n"two\nlines, ""q""",NaN,9007199254740993\n"",x,bad\nshort\n')
    back = zipped.read_zipped_csv(spark, scratch, "id long, name string", glob="more.zip")
    assert rows(back) == rows(spark.createDataFrame([(9007199254740993, 'two\nlines, "q"'), (None, None), (None, "short")], "id long, name string"))
    assert rows(zipped.read_zipped_csv(spark, scratch, "extra double", glob="more.zip")) == [(None,)] * 3


def test_driver_hand_off_is_bounded(spark):
    df = spark.range(10)
    assert len(sinks.to_pandas_small(df, 10)) == 10
    with pytest.raises(ValueError):
        sinks.to_pandas_small(df, 9)
    assert sinks.scalar(df.selectExpr("max(id)")) == 9
    assert sinks.distinct_list(spark.createDataFrame([(3,), (1,), (3,)], "x int"), "x", 5) == [1, 3]


def test_keep_and_shared_dir(spark, scratch):
    df = spark.range(5)
    kept = sinks.keep(df, os.path.join(scratch, "kept"))
    assert kept.count() == 5
    assert sinks.keep(df).count() == 5
    d1, d2 = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert d1 != d2



def test_nan_text_is_missing_after_load(spark, scratch):
    path = os.path.join(scratch, "nan.csv")
    with open(path, "w") as fh:
        fh.write("x,y\n1.5,a\nNaN,b\n")
    got = rows(files.read_csv(spark, path, "x double, y string"))
    assert got == [(1.5, "a"), (None, "b")]
    kept = files.read_csv(spark, path, "x double, y string", nan_as_null=False).collect()
    assert kept[1].x != kept[1].x  # NaN kept when asked


def test_json_lines_mode(spark, scratch):
    path = os.path.join(scratch, "rows.jsonl")
    with open(path, "w") as fh:
        fh.write('{"id": 1, "s": "a"}\n{"id": 2, "s": null}\n')
    assert rows(files.read_json_records(spark, path, "id long, s string", lines=True)) == [
        (1, "a"), (2, None)]


def test_staged_integers_survive_nulls_and_size(spark, scratch):
    df = spark.createDataFrame([(1, "a"), (None, None), (9007199254740993, "b")], "id long, s string").coalesce(1)
    staging.write_json_records(df, os.path.join(scratch, "j"))
    staging.write_workbooks(df, os.path.join(scratch, "x"))
    staging.write_zipped_csv(df, os.path.join(scratch, "z"))
    for got in (files.read_json_records(spark, os.path.join(scratch, "j"), "id long, s string"),
                workbook.read_workbooks(spark, os.path.join(scratch, "x"), "id bigint, s string"),
                zipped.read_zipped_csv(spark, os.path.join(scratch, "z"), "id bigint, s string")):
        assert rows(got) == rows(df)
    with pytest.raises(ValueError):
        staging.write_workbooks(df, "hdfs://host/x")


def test_read_csv_by_name_over_files_with_other_headers(spark, scratch):
    for name, text in (("a", "FlightDate,Origin,T\n2024-01-01,AAA,05/02/2024 10:00\n"), ("b", "Origin,T,FlightDate\nBBB,x,2024-02-01\n")):
        with open(os.path.join(scratch, f"{name}.csv"), "w") as fh:
            fh.write(text)
    got = files.read_csv(spark, os.path.join(scratch, "*.csv"), "FlightDate string, Origin string, T timestamp", by_name=True, timestamp_format="dd/MM/yyyy HH:mm")
    assert sorted((r.FlightDate, r.Origin, str(r["T"])) for r in got.collect()) == [("2024-01-01", "AAA", "2024-02-05 10:00:00"), ("2024-02-01", "BBB", "None")]
    with open(os.path.join(scratch, "c.csv"), "w") as fh:
        fh.write("Other\n1\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, os.path.join(scratch, "*.csv"), "FlightDate string", by_name=True)


def test_read_csv_by_name_from_a_wide_header(spark, scratch):
    path = os.path.join(scratch, "wide.csv")
    with open(path, "w") as fh:
        fh.write("a,Origin,b,FlightDate,Distance\n1,JFK,x,2024-01-01,12.5\n2,LAX,y,2024-01-02,bad\n")
    df = files.read_csv(spark, path, "FlightDate string, Origin string, Distance double",
                        by_name=True)
    assert df.columns == ["FlightDate", "Origin", "Distance"]
    assert rows(df) == [("2024-01-01", "JFK", 12.5), ("2024-01-02", "LAX", None)]
