"""The registered queries: against their SQL, and the pipeline against brute force, on the smallest tables."""

from __future__ import annotations

import glob
import os
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    want = duck.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "near_duplicates":
            check_near(before.collect(), docs.collect())
        if name == "benchmark_decontamination":
            assert docs.count() == before.count() - contaminated(before.collect(), spark.read.parquet(f"{SMALL}/benchmark.parquet").collect())
        if name == "source_mix":
            n = lambda df: sum(len(r["text"].encode().split()) for r in df.collect())
            assert abs(n(docs) - 1.5 * n(before)) <= 20
    assert docs.count() == before.count()
    sizes = Counter(r["shard"] for r in docs.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def shingles(text):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def check_near(before, after):
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and (c := len(sets[i] & sets[j])) and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in after) == sorted({find(i) for i in ids})


def contaminated(docs, items):
    def tokens(t):
        low = t.encode().lower()
        return bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in low).split()

    windows = defaultdict(set)
    for r in items:
        w = tokens(r["text"])
        k = min(10, len(w))
        windows[k] |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return sum(any(tuple(w[i : i + k]) in s for k, s in windows.items() for i in range(len(w) - k + 1)) for w in (tokens(r["text"]) for r in docs))
