"""CSV with quoted line breaks, split by split, against the reader that takes a file whole."""

import random

import pytest
from pyspark.sql import functions as F

import tablelens as tl
from tablelens.sources import csv_splits as C

CELLS = ["", "x", "plain text", 'say ""hi""', "a,b", "line\nbreak", "two\n\nbreaks", '""', '"" ', "\n", '5"" pipe', "e\r\nf", " lead",
         "trail ", "é☃", '"",""', ',""\n""', "\r\n\r\n"]
PLAIN = ['5" pipe', 'a"b"c', "x", "", "it's", ' "q"', 'end"']


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "6000")
    spark.conf.set(names[1], "10")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def write(path, newline, rows, seed, long=False):
    rng = random.Random(seed)

    def cell():
        t = rng.choice(CELLS)
        return f'"{t}"' if any(c in t for c in ',\n"') or rng.random() < 0.2 else t

    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write("id,b,c,d" + newline)
        for i in range(rows):
            b = '"' + "line of a long cell\n" * 1200 + '"' if long and i == rows // 2 else cell()
            f.write(",".join([str(i), b, cell() if rng.random() < 0.9 else rng.choice(PLAIN), cell()]) + newline)
            if rng.random() < 0.02:
                f.write(newline)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2])
def test_one_file_many_splits(spark, tmp_path, small_splits, newline, seed):
    path = str(tmp_path / "t.csv")
    write(path, newline, 2500, seed, long=seed == 2)        # a cell that covers several splits
    want = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    got = C.csv_records(spark, path, want.columns)
    assert C.csv_lines(spark, path).rdd.getNumPartitions() > 8
    rows = [tuple(r) for r in want.collect()]
    assert [tuple(r) for r in got.orderBy("place").drop("place").collect()] == rows
    assert len({r.place.block for r in got.select("place").distinct().collect()}) > 8
    # the loader finds the breaks by itself, types the columns and keeps the file's order
    table = tl.load_table(spark, path)
    assert tl.data_columns(table) == ["id", "b", "c", "d"] and table.schema["id"].dataType.simpleString() == "bigint"
    assert [r["id"] for r in table.orderBy(*tl.functions.types.order_columns(table)).collect()] == [int(r[0]) for r in rows]
    assert tl.read_csv_table(spark, path).columns == ["id", "b", "c", "d"]


def test_several_files_and_clean_ones(spark, tmp_path, small_splits):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    write(str(folder / "a.csv"), "\n", 300, 3)
    write(str(folder / "b.csv"), "\r\n", 300, 4)
    (folder / "c.csv").write_text("id,b,c,d\n" + "\n".join(f"{i},x,y,z" for i in range(500)))
    (folder / "d.csv").write_text("id,b,c,d\n")
    want = spark.read.options(header=True, multiLine=True, escape='"').csv(str(folder))
    table = tl.load_table(spark, str(folder))
    key = [str(tuple(None if v is None else str(v) for v in r)) for r in table.select("id", "b", "c", "d").collect()]
    assert sorted(key) == sorted(str(tuple(r)) for r in want.collect())
    assert not C.has_quoted_breaks(spark, str(folder / "c.csv"))
    assert "MapInArrow" not in tl.load_table(spark, str(folder / "c.csv"))._jdf.queryExecution().executedPlan().toString()


def test_lines_and_files_without_end(spark, tmp_path):
    path = str(tmp_path / "u.csv")
    open(path, "w").write('a,b,_pos\n1,"x\ny",5\n2,"open\nto the end')
    table = tl.load_table(spark, path)
    assert tl.data_columns(table) == ["a", "b", "_pos"]
    rows = table.orderBy("_file", "_block", "_pos_").select("a", "b", "_pos").collect()
    assert [r["a"] for r in rows] == [1, 2] and rows[0]["b"] == "x\ny" and rows[0]["_pos"] == 5
    assert tl.read_csv_table(spark, path, multi_line=False).count() == 4
    semi = str(tmp_path / "s.csv")
    open(semi, "w").write('a;b\n1;"x;\n""y"""\n')
    assert [tuple(r) for r in tl.read_csv_table(spark, semi, sep=";").collect()] == [(1, 'x;\n"y"')]
