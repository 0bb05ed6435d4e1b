"""Parallel reads and the export from a database: the embedded one that comes with Spark."""

from __future__ import annotations

import uuid
from collections import Counter

import pytest

from tidemark.sources import database

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


@pytest.fixture(scope="module")
def url(spark):
    name = f"jdbc:derby:memory:t{uuid.uuid4().hex}"
    spark._jvm.java.lang.Class.forName(DRIVER)
    connection = spark._jvm.java.sql.DriverManager.getConnection(f"{name};create=true")
    statement = connection.createStatement()
    statement.execute("CREATE TABLE bouts (id INT, name VARCHAR(20), score DOUBLE)")
    statement.execute("CREATE TABLE aliases (alias VARCHAR(20), id INT)")
    statement.execute("CREATE TABLE nothing (id INT)")
    for i in range(60):
        key = "NULL" if i % 20 == 7 else str(i * i - 50)
        statement.execute(f"INSERT INTO bouts VALUES ({key}, 'bout {i}', {i / 4})")
        statement.execute(f"INSERT INTO aliases VALUES ({'NULL' if i % 25 == 3 else chr(39) + 'o' + chr(39) * 2 + 'n' + str(i % 40) + chr(39)}, {i})")
    yield name
    connection.close()


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_ranges_hold_every_row_once(spark, url):
    for table, key in (("bouts", "id"), ("aliases", "alias"), ("nothing", "id"), ("bouts", "score")):
        whole = spark.read.format("jdbc").options(url=url, dbtable=table, driver=DRIVER).load()
        for partitions in (1, 5, 100):
            got = database.read_table(spark, url, table, key=key, partitions=partitions, driver=DRIVER)
            assert rows(got) == rows(whole), (table, key, partitions)
        assert table == "nothing" or got.rdd.getNumPartitions() > 5


def test_export_is_whole_or_not_at_all(spark, url, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/out"
    run = lambda: database.export(spark, url, folder, ("bouts", "aliases", "nothing"), keys={"aliases": "alias"}, partitions=4, driver=DRIVER)
    assert run() == {"bouts": 60, "aliases": 60, "nothing": 0}
    first = rows(spark.read.parquet(f"{folder}/aliases.parquet"))
    assert sum(first.values()) == 60 and spark.read.parquet(f"{folder}/nothing.parquet").count() == 0
    read = database.read_table

    def late(spark_, url_, table, **k):
        df = read(spark_, url_, table, **k)
        if table == "aliases":  # a row comes while the table is read
            c = spark._jvm.java.sql.DriverManager.getConnection(url)
            c.createStatement().execute("INSERT INTO bouts VALUES (-1, 'late', 0)")
            c.close()
        return df

    monkeypatch.setattr(database, "read_table", late)
    with pytest.raises(database.Changed):
        run()
    assert rows(spark.read.parquet(f"{folder}/aliases.parquet")) == first and spark.read.parquet(f"{folder}/bouts.parquet").count() == 60
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["aliases.parquet", "bouts.parquet", "nothing.parquet"]
    monkeypatch.setattr(database, "read_table", read)
    assert run()["bouts"] == 61


def test_sessions_share_a_snapshot_where_they_can():
    begin, name, join = database.SNAPSHOTS["postgresql"]
    assert "REPEATABLE READ" in begin and join.format("0001-1").endswith("SET TRANSACTION SNAPSHOT '0001-1'")
