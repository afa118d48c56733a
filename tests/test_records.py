"""Files cut into records by many tasks, against the csv module and the engine's whole-file reader."""

import csv
import random

import pytest

from tablecraft.sources.files import read_csv, read_delimited
from tablecraft.sources.records import records
from tests.conftest import rows_of


def table(n, seed):
    rng = random.Random(seed)
    cells = ["plain", "two\nlines", 'a, "quoted"\n\nword', "x" * 90 + "\n" + "y" * 90, "", "é", "\n", "z\n" * 30]
    return [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(n)]


def write(path, rows, encoding="utf-8", end="\n"):
    with open(path, "w", newline="", encoding=encoding) as f:
        csv.writer(f, lineterminator=end).writerows(rows)


@pytest.fixture(params=["200", "1500", "134217728"])
def splits(spark, request):
    """Files of many splits: cells and records lie over their borders."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def test_records_are_those_of_the_file(spark, tmp_path, splits):
    files = {"a b.csv": table(60, 1), "c.csv": table(50, 2), "empty.csv": []}
    for i, (name, rows) in enumerate(files.items()):
        write(tmp_path / name, rows, end="\r\n" if i else "\n")
    found = records(spark, str(tmp_path))
    if splits == "200":
        assert found.rdd.getNumPartitions() > 20
    by_file = {}
    for r in sorted(found.collect(), key=lambda r: (r["file"], r["block"], r["seq"])):
        by_file.setdefault(r["file"].rsplit("/", 1)[1].replace("%20", " "), []).append(next(csv.reader(r["value"].splitlines(True))))
    assert by_file == {name: rows for name, rows in files.items() if rows}


def test_read_csv_equals_the_whole_file_reader(spark, tmp_path, splits):
    write(tmp_path / "f.csv", [["id", "a", "b"], *table(80, 3)])
    got = read_csv(spark, str(tmp_path))
    assert got.dtypes == [("id", "int"), ("a", "string"), ("b", "string")]
    whole = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"', inferSchema=True)
    assert rows_of(got) == rows_of(whole)


def test_an_open_quote_takes_the_rest(spark, tmp_path, splits):
    (tmp_path / "f.csv").write_text("a,b\n1,x\n2,\"open\n3,y\n" + "4,z\n" * 100)
    values = [r["value"] for r in sorted(records(spark, str(tmp_path)).collect(), key=lambda r: (r["block"], r["seq"]))]
    assert values == ["a,b", "1,x", '2,"open\n3,y\n' + "\n".join(["4,z"] * 100)]


def test_files_of_other_headers_kinds_and_encodings(spark, tmp_path):
    """Merged by name: missing cells null, int and double become double, a broken file leaves the others as they are."""
    write(tmp_path / "one.csv", [["id", "price"], ["1", "5"], ["2", "6"]])
    write(tmp_path / "two.csv", [["price", "note"], ["1.5", "café"]], encoding="latin-1")
    write(tmp_path / "three.csv", [["note", "id"], ["a\nb", "7"]])
    write(tmp_path / "four.csv", [["id", "extra"], ["8", "x\ny"]])
    got = read_csv(spark, str(tmp_path))
    assert dict(got.dtypes) == {"id": "int", "price": "double", "note": "string", "extra": "string"}
    rows = sorted(got.select("id", "price", "note", "extra").collect(), key=str)
    assert sorted(map(tuple, rows), key=str) == sorted(
        [(1, 5.0, None, None), (2, 6.0, None, None), (None, 1.5, "café", None), (7, None, "a\nb", None), (8, None, None, "x\ny")], key=str)


def test_read_delimited_reads_its_encoding_and_breaks(spark, tmp_path):
    write(tmp_path / "one.csv", [["name", "v"], ["café", "n/a"], [" x ", "1"]], encoding="latin-1")
    write(tmp_path / "two.csv", [["name", "v"], ["line\nbreak", "2"]])
    got = sorted(map(tuple, read_delimited(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("café", None), ("x", "1"), ("line\nbreak", "2")], key=str)
