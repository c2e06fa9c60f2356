"""SQLite files as a source: ranges, pushed filters, and the same rows as Spark's own filters."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not, StringContains, StringStartsWith
from pyspark.sql.types import StructType

from stepweave.sources import sqlite

ROWS = [(k, f"Part {k % 7}" if k % 5 else None, k * 0.5, k % 3) for k in range(1, 1_001)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("db")
    for n, part in (("a", ROWS[:600]), ("b", ROWS[600:]), ("c", [])):
        with sqlite3.connect(path / f"{n}.db") as con:
            con.execute('CREATE TABLE "my parts" (id INTEGER PRIMARY KEY, name VARCHAR(20) COLLATE NOCASE, price REAL, "odd ""col" INT)')
            con.executemany('INSERT INTO "my parts" VALUES (?, ?, ?, ?)', part)
            con.execute('CREATE VIEW cheap AS SELECT id, price FROM "my parts" WHERE price < 100')
        con.close()
    (path / "note.txt").write_text("no table")
    return str(path)


def test_rows_types_and_ranges(spark, folder):
    whole = sqlite.sqlite_table(spark, folder, "my parts", rows=150)
    assert whole.dtypes == [("id", "bigint"), ("name", "string"), ("price", "double"), ('odd "col', "bigint")]
    assert sorted(map(tuple, whole.collect())) == ROWS
    assert whole.rdd.getNumPartitions() == 4 + 3  # the empty file has none
    some = sqlite.sqlite_table(spark, f"{folder}/b.db", "my parts", "price double, id int")
    assert sorted(map(tuple, some.collect())) == [(r[2], r[0]) for r in ROWS[600:]]
    assert sqlite.sqlite_table(spark, folder, "cheap", "id long, price double").count() == 199


@pytest.mark.parametrize("when", ["id = 7", "id > 990 OR name IS NULL", "name = 'part 3'", "name = 'Part 3' AND price >= 100", "name LIKE 'Part%' AND id IN (1, 2, 5, 700)", "name > 'Part 4'", "NOT name <= 'Part 4'", "name LIKE '%3' AND id < 100", "price = 2", "id = 99999999999999999999", "name IS NOT NULL AND id <=> 3"])
def test_filters_give_the_same_rows(spark, folder, when):
    plain = spark.createDataFrame(ROWS, "id long, name string, price double, k long")
    got = sqlite.sqlite_table(spark, folder, "my parts", "id long, name string, price double").filter(when)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.filter(when).select("id", "name", "price").collect()))


def test_what_is_pushed(spark, folder):
    reader = sqlite.SqliteReader(StructType(), {"table": "my parts", "path": folder})
    filters = [GreaterThan(("id",), 5), EqualTo(("name",), "x"), In(("id",), (1, 2)), IsNull(("name",)), StringStartsWith(("name",), "P"), StringContains(("name",), "a"), Not(EqualTo(("id",), 3)), EqualTo(("flag",), True)]
    assert list(reader.pushFilters(filters)) == filters[5:] and len(reader.where) == 5
    plan = sqlite.sqlite_table(spark, folder, "my parts").filter(F.col("id") > 990)._jdf.queryExecution().executedPlan().toString()
    assert "990" not in plan.split("BatchScan")[0]  # no Filter is left above the scan


def test_errors(spark, folder):
    with pytest.raises(Exception, match="no table nothing"):
        sqlite.sqlite_table(spark, folder, "nothing").count()
    with pytest.raises(Exception, match="Part"):
        sqlite.sqlite_table(spark, folder, "my parts", "name long").collect()
