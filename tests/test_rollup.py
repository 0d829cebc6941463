"""The monthly route table refreshed file by file, and results kept for their inputs (SNK6)."""

import os

import pytest

from tessel.plans import flights as fl
from tessel.plans import rollup
from tessel.sources import files, manifest

SCHEMA = "FlightDate string, Reporting_Airline string, Origin string, Dest string"


@pytest.fixture()
def airports(spark):
    return spark.createDataFrame([("A", 1.0, 2.0), ("B", 3.0, 4.0), ("C", None, 1.0)], "IATA string, Latitude double, Longitude double")


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write("FlightDate,Reporting_Airline,Origin,Dest\n" + "".join(",".join(r) + "\n" for r in rows))


def flights(month, n, carrier="X"):
    return [(f"{month}-{1 + i % 28:02d}", carrier, "AB"[i % 2], "BAC"[i % 3]) for i in range(n)]


def stat(out):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(os.path.join(out, "routes")) for f in names if f.startswith("part-")}


def test_only_changed_months_are_replaced(spark, airports, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    read = lambda paths: files.read_csv(spark, paths, SCHEMA)

    def full():
        paths = sorted(manifest.list_inputs(spark, folder))
        rows = fl.route_counts(fl.enrich_flights(read(paths), airports)) if paths else rollup.routes(spark, str(tmp_path / "none"))
        return sorted(map(str, rows.select(rollup.routes(spark, out).columns).collect()))

    def now():
        return sorted(map(str, rollup.routes(spark, out).collect()))

    assert rollup.refresh(spark, folder, out, airports, read) == {"fresh": 0, "gone": 0, "months": []}
    assert now() == []
    put(folder, "a b.csv", flights("2024-01", 30) + [("bad", "X", "A", "B")])
    put(folder, "2.csv", flights("2024-02", 20))
    put(folder, "3.csv", flights("2024-02", 9, "Y") + flights("2024-03", 8))
    assert rollup.refresh(spark, folder, out, airports, read) == {"fresh": 3, "gone": 0, "months": [(2024, 1), (2024, 2), (2024, 3)]}
    assert now() == full() and len(now()) > 0
    before = stat(out)
    assert rollup.refresh(spark, folder, out, airports, read)["months"] == [] and stat(out) == before
    # a new month, and one that shares a month with another file
    put(folder, "4.csv", flights("2024-04", 5) + flights("2024-03", 2))
    assert rollup.refresh(spark, folder, out, airports, read)["months"] == [(2024, 3), (2024, 4)]
    after = stat(out)
    assert now() == full()
    for month in (1, 2):
        kept = {p: t for p, t in before.items() if f"Month={month}/" in p}
        assert kept and kept == {p: t for p, t in after.items() if f"Month={month}/" in p}
    # a changed file leaves one of its months, a vanished one empties a month
    put(folder, "3.csv", flights("2024-03", 3, "Z"))
    os.remove(os.path.join(folder, "a b.csv"))
    assert rollup.refresh(spark, folder, out, airports, read) == {"fresh": 1, "gone": 1, "months": [(2024, 1), (2024, 2), (2024, 3)]}
    assert now() == full() and not any("Month=1/" in p for p in stat(out))
    # another version of what else decides the result
    assert rollup.refresh(spark, folder, out, airports, read, key="v2")["fresh"] == 3
    assert rollup.routes(spark, out, 2024, 4).count() == len([r for r in now() if "Month=4," in r]) > 0


def test_an_interrupted_refresh_is_done_again(spark, airports, tmp_path, monkeypatch):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    read = lambda paths: files.read_csv(spark, paths, SCHEMA)
    put(folder, "1.csv", flights("2024-01", 30))
    monkeypatch.setattr(manifest, "store", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        rollup.refresh(spark, folder, out, airports, read)
    monkeypatch.undo()
    once = sorted(map(str, rollup.routes(spark, out).collect()))
    assert rollup.refresh(spark, folder, out, airports, read)["months"] == [(2024, 1)]
    assert sorted(map(str, rollup.routes(spark, out).collect())) == once


def test_kept_for_the_same_inputs(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    path = str(tmp_path / "kept")
    assert manifest.keep_for(spark, {"a": [1, 2]}, path, build).count() == 1
    assert manifest.keep_for(spark, {"a": [1, 2]}, path, build).count() == 1 and len(built) == 1
    assert manifest.keep_for(spark, {"a": [1, 3]}, path, build).count() == 2 and len(built) == 2
