"""Tables of a database, read in parallel ranges of a key and exported as Parquet all from one state.

Every reader opens a connection of its own. Where the database can hand a snapshot to other sessions (SNAPSHOTS), one connection holds a
repeatable-read transaction open and all readers join its snapshot. Elsewhere, and in any case, the tables' row counts are taken before
the first row is read and after the last, and both must equal what was read; if not, the export fails and the folder stays as it was.

Ranges: a whole-number key is cut evenly between its ends, any other at the values that stand at even places of its order; rows without
a key are a range of their own. An empty table is read as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The tables of a snapshot.
TABLES = ("fighters", "events", "bouts", "bout_stats", "fighter_aliases", "odds_snapshots")
#: For databases whose sessions can share a snapshot: what opens the holding transaction, what names its snapshot, what a reader runs.
SNAPSHOTS = {"postgresql": ("BEGIN ISOLATION LEVEL REPEATABLE READ", "SELECT pg_export_snapshot()", "BEGIN ISOLATION LEVEL REPEATABLE READ; SET TRANSACTION SNAPSHOT '{}'")}


class Changed(RuntimeError):
    """A table changed while it was exported."""


@contextmanager
def _connection(spark: SparkSession, url: str, options: dict[str, str]) -> Iterator[object]:
    jvm = spark._jvm
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"])
    own = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            own.setProperty(k, options[k])
    held = jvm.java.sql.DriverManager.getConnection(url, own)
    try:
        yield held
    finally:
        held.close()


def _rows(connection, sql: str) -> list[object]:
    """The first column of a small result."""
    statement = connection.createStatement()
    try:
        found, out = statement.executeQuery(sql), []
        while found.next():
            out.append(found.getObject(1))
        return out
    finally:
        statement.close()


def _literal(value) -> str:
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def ranges(connection, table: str, key: str, partitions: int) -> list[str]:
    """Conditions that every row of the table meets one of."""
    n = _rows(connection, f"SELECT count({key}) FROM {table}")[0]
    ends: list = []
    if n:
        low, high = _rows(connection, f"SELECT min({key}) FROM {table}")[0], _rows(connection, f"SELECT max({key}) FROM {table}")[0]
        if isinstance(low, int):
            ends = sorted({low + (high - low + 1) * i // partitions for i in range(1, partitions)} - {low})
        else:
            places = sorted({n * i // partitions for i in range(1, partitions)} - {0})
            found = [_rows(connection, f"SELECT {key} FROM {table} WHERE {key} IS NOT NULL ORDER BY {key} OFFSET {p} ROWS FETCH NEXT 1 ROWS ONLY")[0] for p in places]
            ends = sorted(set(found) - {low})
    marks = [_literal(e) for e in ends]
    between = [" AND ".join(x for x in (a and f"{key} >= {a}", b and f"{key} < {b}") if x) for a, b in zip(["", *marks], [*marks, ""])]
    return [c or f"{key} IS NOT NULL" for c in between] + [f"{key} IS NULL"]


def read_table(spark: SparkSession, url: str, table: str, *, key: str = "id", partitions: int = 16, **options: str) -> DataFrame:
    """A table in parallel ranges of its key."""
    with _connection(spark, url, options) as connection:
        conditions = ranges(connection, table, key, partitions)
    return spark.read.jdbc(url, table, predicates=conditions, properties=options)


def export(spark: SparkSession, url: str, folder: str, tables: Sequence[str] = TABLES, *, keys: dict[str, str] | None = None, partitions: int = 16, **options: str) -> dict[str, int]:
    """Writes each table as folder/<name>.parquet, all or none, and returns their numbers of rows. keys: the key of a table, `id` if it
    isn't named."""
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    counted = lambda c: {t: int(_rows(c, f"SELECT count(*) FROM {t}")[0]) for t in tables}
    try:
        with _connection(spark, url, options) as connection:
            before, own = counted(connection), dict(options)
            kind = url.removeprefix("jdbc:").split(":")[0]
            if kind in SNAPSHOTS:
                begin, name, join = SNAPSHOTS[kind]
                connection.createStatement().execute(begin)
                own["sessionInitStatement"] = join.format(_rows(connection, name)[0])
                before = counted(connection)
            for t in tables:
                read_table(spark, url, t, key=(keys or {}).get(t, "id"), partitions=partitions, **own).write.parquet(f"{staged}/{t}.parquet")
            after = counted(connection)
        got = {t: spark.read.parquet(f"{staged}/{t}.parquet").count() for t in tables}
        if not before == got == after:
            raise Changed(f"rows before {before}, read {got}, after {after}")
        for t in tables:
            fs.delete(fs_path(f"{folder}/{t}.parquet"), True)
            fs.rename(fs_path(f"{staged}/{t}.parquet"), fs_path(f"{folder}/{t}.parquet"))
        return got
    finally:
        fs.delete(fs_path(staged), True)
