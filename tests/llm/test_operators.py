"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import base64
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import decontamination, exact_dedup, language, mixing, near_dedup, quality, sharding, token_counts, url_filters, warc, words
from tidemark.llm.components import components

random.seed(5)
VOCAB = [f"{a}{b}{c}" for a in "ktrmsl" for b in "aeiou" for c in "nrstx"]
DDL = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, shard int, keep_id string"


def sentence(n: int) -> str:
    return " ".join(random.choice(VOCAB) for _ in range(n))


def texts() -> list[str | None]:
    base = sentence(120)
    edited = base.split()
    edited[60] = "zzz"
    far = base.split()
    for i in range(0, 120, 10):
        far[i] = f"q{i}"
    family = []
    for i in range(40):  # a family larger than a small region: some linked with the base, some with nobody
        w = base.split()
        for k in range(i % 8):
            w[(13 * i + 17 * k) % 120] = f"e{i}x{k}"
        family.append(" ".join(w))
    return [base, base, base.upper().lower(), " ".join(edited), " ".join(far), None, "", "  \t ", "one", "one two", "one  two", "One\nTwo", " one two", "IT ÉÀ the", *family, sentence(5000), sentence(30), *[sentence(60) for _ in range(20)], base + " tail"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), True, 1, 1, "x") for i, t in enumerate(texts())]
    rows += [rows[3], (None, "no id here at all", "en", "s0", 3, True, 1, 1, "x"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DDL).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def norm(t):
    return "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in t or "")


def squeeze(t):
    out = norm(t)
    while "  " in out:
        out = out.replace("  ", " ")
    return out


# Words --------------------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBz09 \t\n\x0b\x1c\x85éß,-", max_size=80))
def test_words_are_those_of_bytes_split(text):
    data = text.encode()
    starts, got = words.hashes(data, words.SPACED)
    want = data.lower().split()
    assert len(got) == len(want)
    alone = [words.hashes(w, words.SPACED)[1][0] for w in want]
    assert list(got) == alone


def test_words_do_not_depend_on_spans(monkeypatch):
    data = (sentence(400) + "  " + "x" * 300 + " " + sentence(50)).encode()
    want = words.hashes(data, words.SPACED)
    monkeypatch.setattr(words, "SPAN", 97)
    got = words.hashes(data, words.SPACED)
    assert list(got[0]) == list(want[0]) and list(got[1]) == list(want[1])


# 1 ------------------------------------------------------------------------------------------------------------------------------


def fill(sizes, weights, share, most):
    total, target, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] >= most * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        n = len((r["text"] or "").encode().split())
        assert r["_words"] == n and 0 <= r["_taken"] <= 2 * n
        sizes[r["source"]] += n
        taken[r["source"]] += r["_taken"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    for r in got:
        assert r["_source_size"] == sizes[r["source"]] and r["_target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    for s in sizes:  # complete epochs precede the fraction
        epochs = {r["_epochs"] for r in got if r["source"] == s}
        assert len(epochs) == 1 and sum(1 for r in got if r["source"] == s and 0 < r["_cut"] < r["_words"]) <= 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["_taken"]) for r in got) == Counter((r["doc_id"], r["_taken"]) for r in again)
    slim = mixing.mix(docs, keep_text=False)
    assert "text" not in slim.columns
    assert Counter((r["doc_id"], r["_words"], r["_taken"]) for r in got) == Counter((r["doc_id"], r["_words"], r["_taken"]) for r in slim.collect())


def test_mix_rows(docs, empty):
    rows = mixing.materialize(mixing.mix(docs)).collect()
    words_of = Counter()
    for r in rows:
        n = len((r["text"] or "").encode().split())
        assert n == r["_take"]
        words_of[r["source"]] += n
    target = {r["source"]: r["_target"] for r in rows}
    assert all(abs(words_of[s] - t) <= 1 for s, t in target.items())
    assert mixing.materialize(mixing.mix(empty)).count() == 0


def test_heavier_documents_are_taken_more_often(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 2000, "x").otherwise("x").alias("source"))
    mixed = mixing.mix(rows, quality=F.when(F.col("doc_id") < 2000, 4.0).otherwise(1.0), share=0.5).groupBy((F.col("doc_id") < 2000).alias("heavy")).agg(F.sum("_taken").alias("n"))
    n = {r["heavy"]: r["n"] for r in mixed.collect()}
    assert n[True] > 2 * n[False]


# 2 ------------------------------------------------------------------------------------------------------------------------------


def dedup_truth(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[squeeze(r["text"])].append(r["doc_id"])
    out = []
    for r in rows:
        own = groups[squeeze(r["text"])]
        keep = min((x for x in own if x is not None), default=None)
        out.append((r["doc_id"], keep, len(own), r["doc_id"] == keep, hashlib.sha256(squeeze(r["text"]).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, empty, weak):
    hash_ = {"content_hash": lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 4), 8, "0"))} if weak else {}
    got = exact_dedup.exact_dedup(docs, **hash_)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == dedup_truth(docs.collect())
    assert exact_dedup.exact_dedup(empty, **hash_).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    bodies = ["<p>a</p>", "", None, "x\r\ny\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "é" * 5000, "\r", "\n\r", "\r\n" * 50, "<p>a</p>", "é" * 5000, "".join(random.choice("\r\nab") for _ in range(999))]
    rows = [(i, f"http://h.example/{i}\r\nX: y", b, "clash") for i, b in enumerate(bodies)] + [(11, "http://again", bodies[11], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, segment=64)
    got = warc.read_archives(spark, path).collect()
    last = {}
    for r in rows:
        last[r[2] or ""] = max(last.get(r[2] or "", -1), r[0])
    want = []
    for i, _, b, _ in rows:
        data = (b or "").encode()
        first = last[b or ""] == i
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else str(last[b or ""])))
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert max(r["segments"] for r in got) == -(-10000 // 64)
    warc.write_archives(pages, path, segment=64, least=100)
    short = {r["source_id"]: r["record_type"] for r in warc.read_archives(spark, path).collect()}
    assert short["0"] == short["9"] == "response" and short["5"] == "revisit"
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_warc_reader_notices_damage():
    reader = warc._Reader()
    lines = b"WARC/1.1|WARC-Type: response|WARC-Record-ID: <a>|WARC-Target-URI: u|WARC-Payload-Digest: sha1:AAAA|X-Source-ID: 1|X-Payload-Length: 2|Content-Length: 21||HTTP/1.1 200 OK||hi||".split(b"|")
    with pytest.raises(ValueError, match="isn't what its header says"):
        list(reader.lines(lines))


def test_warc_writing_takes_time_in_proportion(spark, tmp_path):
    took = []
    for megabytes in (2, 2, 16):
        page = spark.createDataFrame([(1, "u", "é<p> " * (megabytes << 18))], "page_id long, url string, html string")
        began = time.perf_counter()
        warc.write_archives(page, str(tmp_path / "long"))
        took.append(time.perf_counter() - began)
    assert took[2] < 16 * max(took[1], 0.25)
    row = warc.read_archives(spark, str(tmp_path / "long")).first()
    assert row["payload_bytes"] == 6 * (16 << 18) and row["segments"] == -(-row["payload_bytes"] // warc.SEGMENT)


def test_warc_segments_keep_characters():
    text = "aé日🙂" * 9
    data = text.encode()
    for size in (1, 2, 3, 5, 8):
        parts = [data[a:b] for a, b in warc.segments(memoryview(data), size)]
        assert b"".join(parts) == data and (size < 4 or "".join(p.decode() for p in parts) == text)
    assert warc.segments(memoryview(b""), 4) == [(0, 0)]


def test_warc_revisit_without_its_response(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>"), (2, "u", "<p>")], "page_id long, url string, html string")
    plan = warc.planned(pages, id="page_id", url="url", payload="html", least=0).where("_id = 1")
    warc.records(warc.chunks(plan), "2020-01-01T00:00:00Z").write.option("lineSep", warc.CRLF).option("compression", "gzip").text(str(tmp_path / "half"))
    with pytest.raises(Exception, match="no response with the payload of revisit 1"):
        warc.read_archives(spark, str(tmp_path / "half")).collect()


# 4 ------------------------------------------------------------------------------------------------------------------------------


def test_hosts(spark):
    hosts = {"http://good.example@bad.example/x": "bad.example", "http://u:p@bad.example/": "bad.example", "http://bad.example./x": "bad.example", "http://[::1]:80/x": "[::1]", "HTTPS://WWW.Bad.Example:8080?q=a@b": "bad.example", "http:///x": None, "bad.example": None, "http://a@b@c.example": "c.example", "http://x" + "y" * 5000 + ".example/": "x" + "y" * 5000 + ".example"}
    rows = spark.createDataFrame([(u,) for u in hosts], "u string").select("u", url_filters.host_of("u").alias("h")).collect()
    assert {r["u"]: r["h"] for r in rows} == hosts


def test_names_that_clash(spark, docs):
    odd = {c: F.lit(7) for c in ("_source", "_last", "_epochs", "_key", "_bucket", "_doc", "_host", "_url", "_text", "_language", "_declared", "_words", "_of", "in0", "in3", "_best", "_n")}
    rows = docs.withColumns(odd)
    mixed = mixing.mix(rows)
    assert mixed.count() == rows.count() and mixed.where("_key = 7 and _source = 7 and _last = 7 and in3 = 7").count() == rows.count() and len(set(mixed.columns)) == len(mixed.columns)
    assert mixing.mix(rows, keep_text=False).where("_epochs < 7").count() == rows.count()
    clean = decontamination.clean_rows(rows, spark.createDataFrame([(1, "nowhere to be found")], "item_id long, text string"))
    assert clean.columns == rows.columns and clean.where("_doc = 7").count() == rows.count()
    found = language.identify(rows)
    assert len(set(found.columns)) == len(found.columns) and found.where("_host = 7 and _text = 7").count() == rows.count()
    captures = rows.withColumns({"url": F.lit("http://a.example/x"), "day": F.lit(3)})
    judged = url_filters.evaluate(captures, spark.createDataFrame([("l", "block", "domain", "a.example", 1, "add")], "list string, action string, kind string, pattern string, day int, change string"))
    assert judged.where("_blocked and _host = 'a.example' and _best = 7").count() == rows.count()


def test_url_filters(spark):
    entries = spark.createDataFrame([
        ("a", "block", "domain", "bad.example", 10, "add"), ("a", "block", "domain", "bad.example", 20, "remove"), ("a", "block", "domain", "bad.example", 20, "remove"), ("a", "block", "domain", "bad.example", 30, "add"), ("a", "block", "domain", "bad.example", 35, "add"),
        ("b", "allow", "prefix", "bad.example/ok", 15, "add"), ("b", "block", "domain", None, 1, "add"), ("b", "block", "domain", "late.example", None, "add"), ("c", "block", "domain", "never.example", 5, "remove"),
    ], "list string, action string, kind string, pattern string, day int, change string")
    asked = [("http://www.bad.example/x", 9, False), ("http://www.bad.example/x", 10, True), ("HTTP://sub.BAD.example:80/x?y#z", 19, True), ("http://bad.example/", 20, False), ("http://bad.example", 30, True), ("https://bad.example/ok/page", 40, False), ("https://bad.example/okay", 40, True), ("https://notbad.example/", 40, False), (None, 40, False), ("no url", 40, False), ("http://bad.example", None, False), ("http://never.example", 9, False), ("http://late.example", 9, False), ("http://bad.example", 30, True)]
    captures = spark.createDataFrame([(i, *a[:2], "clash", a[2]) for i, a in enumerate(asked)], "page_id int, url string, day int, pattern string, want boolean")
    got = url_filters.evaluate(captures, entries).collect()
    assert len(got) == len(asked) and all(r["_blocked"] == r["want"] for r in got)
    assert url_filters.evaluate(captures.limit(0), entries).count() == 0
    assert not any(r["_blocked"] for r in url_filters.evaluate(captures, entries.limit(0)).collect())


# 5 ------------------------------------------------------------------------------------------------------------------------------


def near_truth(rows, n, percent):
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return Counter((r["doc_id"], len(sets[i]), least.get(find(i)) if sets[i] else r["doc_id"]) for i, r in enumerate(rows))


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_groups(docs, empty, n, percent):
    got = near_dedup.near_groups(docs, shingle=n, percent=percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == near_truth(docs.collect(), n, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_groups(empty, shingle=n, percent=percent).count() == 0


def test_kept_rows(docs):
    kept = near_dedup.kept_rows(docs, shingle=5, percent=80)
    assert kept.columns == docs.columns
    groups = near_dedup.near_groups(docs, shingle=5, percent=80)
    want = {r["doc_id"] for r in groups.where("kept").collect()}
    got = [r["doc_id"] for r in kept.collect()]
    assert set(got) == want and Counter(got)[3] <= 1 and got.count(None) == 2


def test_kept_rows_are_known_by_id_and_text(spark):
    a, b = sentence(60), sentence(60)
    rows = [(1, a, 0), (2, a, 0), (2, b, 0), (None, a, 0), (3, None, 0), (3, None, 0), (4, "", 1)]
    data = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, _node int, _digest int, in0 string")
    kept = near_dedup.kept_rows(data)
    assert kept.columns == data.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (2, b), (3, None), (3, None), (4, "")])


def test_near_groups_equal_the_exact_join(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = near_dedup.near_groups(rows, shingle=3, percent=85).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == near_truth(rows.collect(), 3, 85)


@pytest.mark.parametrize("width,near,lane", [(2, 1, 3), (3, 2, 1000)])
def test_dense_regions_lose_no_link(docs, monkeypatch, width, near, lane):
    monkeypatch.setattr(near_dedup, "WIDTH", width)
    monkeypatch.setattr(near_dedup, "NEAR", near)
    monkeypatch.setattr(near_dedup, "LANE", lane)
    got = near_dedup.near_groups(docs, shingle=3, percent=85).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == near_truth(docs.collect(), 3, 85)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60) if i % 10 != 9] + [(100, 3), (5, 100), (7, 7)]
    got = {r["_node"]: r["_root"] for r in components(spark.createDataFrame(links, "_a long, _b long")).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(60) if i in got) and got[100] == 0 and len(got) == 61


# 6 ------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding(spark, docs, empty, law):
    many = docs.unionByName(spark.range(500).select(*[(F.col("id") + 1000).alias("doc_id") if c == "doc_id" else F.concat(F.lit("text "), F.col("id") % 40).alias(c) if c == "text" else F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    got = sharding.shard_documents(many, 3, law=law).collect()
    assert len(got) == many.count()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(3))
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        sums = [sum(r["size"] for r in rows) for rows in by.values()]
        assert max(sums) - min(sums) <= 2 * max(r["size"] for r in got)
    together = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] >= 1000:
            together[r["text_crc32"]].add(r["shard"])
    assert len(together) == 40 and sum(len(s) for s in together.values()) < 60  # dealt at random it would be 120: a group has 12 or 13 rows
    assert sharding.shard_documents(empty, 7, law=law).count() == 0


def test_sharding_keeps_groups_that_fit(spark):
    """Groups of 2 to 25 rows among 24 shards of 20: only one that outgrows a shard is dealt."""
    rows, sizes = [], [25, 20, 19, 12, 9, *[5] * 6, *[2] * 20]
    for g, n in enumerate(sizes):
        rows += [(1000 * g + i, f"group {g}") for i in range(n)]
    rows += [(-1 - i, f"alone {i}") for i in range(480 - len(rows))]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    assert Counter(Counter(r["shard"] for r in got).values()) == {20: 24}
    shards = defaultdict(set)
    for r in got:
        if r["doc_id"] >= 0:
            shards[r["doc_id"] // 1000].add(r["shard"])
    assert [len(shards[g]) for g in range(1, len(sizes))] == [1] * (len(sizes) - 1) and len(shards[0]) <= 3


def test_propagation_settles(spark):
    """No link is left between labels where room is plenty, in stars and in a star of stars."""
    links = [(1000 * g + i, 1000 * g, 1) for g in range(1, 9) for i in range(1, 60)]
    links += [(10000 + 100 * s + i, 10000 + 100 * s, 1) for s in range(1, 6) for i in range(1, 40)] + [(10000 + 100 * s, 10000, 40) for s in range(1, 6)]
    nodes = sorted({n for a, b, _ in links for n in (a, b)})
    table = spark.createDataFrame(links, "_a long, _b long, _weight long")
    labels = sharding.propagate(spark.createDataFrame([(n, n // 1000, 1) for n in nodes], "_node long, _piece long, _load long"), table, [1000] * 24)
    at = {r["_node"]: r["_label"] for r in labels.collect()}
    assert set(at) == set(nodes)
    assert not [1 for a, b, _ in links if at[a] != at[b]]


@pytest.mark.parametrize("room", [100, 14])
def test_propagation_replayed(spark, room):
    """The rounds once more in plain Python, with Spark's hashes: the same labels after each number of rounds, in stars that want in
    where there is room (100) and where there is little (14 for 4 labels and 50 nodes)."""
    links = [(10 * g + i, 10 * g, 1) for g in range(1, 6) for i in range(1, 9)] + [(10, 20, 9), (30, 20, 2)]
    nodes = sorted({n for a, b, _ in links for n in (a, b)})
    table = spark.createDataFrame([(n, n // 10, 1 + n % 2) for n in nodes], "_node long, _piece long, _load long")
    rooms = [room] * 4
    hashed = {r["_node"]: r for r in table.select("*", F.pmod(F.xxhash64("_node", F.lit(0)), F.lit(sum(rooms))).alias("start"), F.xxhash64("_node", F.lit("turn")).alias("turn"), *[(F.pmod(F.xxhash64("_piece", F.lit(-1 - r)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias(f"draw{r}") for r in range(6)]).collect()}
    about = defaultdict(list)
    for a, b, w in links:
        about[a].append((b, w))
        about[b].append((a, w))
    label = {n: min(sum(hashed[n]["start"] >= e for e in np.cumsum(rooms)), 3) for n in nodes}
    turn = {n: (len(about[n]), hashed[n]["turn"], n) for n in nodes}
    load = {n: hashed[n]["_load"] for n in nodes}
    tables = spark.createDataFrame(links, "_a long, _b long, _weight long")
    for rounds in range(1, 6):
        r = rounds - 1
        want = {}
        for n in nodes:
            votes = Counter()
            for m, w in about[n]:
                votes[label[m]] += w
            best = max(votes, key=lambda x: (votes[x], x))
            if 2 * votes[best] > sum(votes.values()) and best != label[n]:
                want[n] = best
        go = {n: x for n, x in want.items() if all(turn[n] < turn[m] for m, _ in about[n] if m in want)}
        held, flows = [0.0] * 4, Counter()
        for n in nodes:
            held[label[n]] += load[n]
        for n, x in go.items():
            flows[label[n], x] += load[n]
        chance = sharding.accepted(held, flows, [x * 1.05 for x in rooms])
        label |= {n: x for n, x in go.items() if hashed[n][f"draw{r}"] < chance[x]}
        got = {x["_node"]: x["_label"] for x in sharding.propagate(table, tables, rooms, rounds=rounds).collect()}
        assert got == label, rounds


def test_pieces_stay_whole_and_links_are_counted(spark):
    docs = spark.createDataFrame([(1000 * g + i, f"group {g}") for g, n in enumerate([17, 9, 9, 8, 6, 5, 3, 3]) for i in range(n)], "doc_id long, text string")
    nodes, links, total = sharding.text_nodes(docs, 3)
    got = sharding.shard_documents(docs, 3)
    assert Counter(Counter(r["shard"] for r in got.collect()).values()) == {20: 3}
    placed = nodes.join(got, "doc_id").select("_node", "shard")
    row, at = sharding.cut_links(links, placed).first(), {r["_node"]: r["shard"] for r in placed.collect()}
    apart = [r["_weight"] for r in links.collect() if at[r["_a"]] != at[r["_b"]]]
    assert (row["links"], row["cut"], row["weight_cut"]) == (links.count(), len(apart), sum(apart)) and len(apart) <= 6


def test_sharding_links_parts_of_a_group(spark):
    """A group of three quotas is dealt into parts, and its links still make one component, with stars of bounded size."""
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 900, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    nodes, links, total = sharding.text_nodes(docs, 4)
    assert total == 1200 and nodes.where("_linked").select("_piece").distinct().count() == 3
    roots = components(links).collect()
    assert len(roots) == 900 and len({r["_root"] for r in roots}) == 1
    assert links.groupBy("_b").count().agg(F.max("count")).first()[0] < 100


# 7 ------------------------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, docs, empty, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a\x1cb\x85c d", "<|endoftext|>x <|startoftext|>", "It's we'LL '\n's", "İstanbul ΑΣ", "　 x", "word " * 3000, "日本語 テスト 1234"]
    rows = docs.select("doc_id", "text", F.lit(1).alias("n_tokens")).unionByName(spark.createDataFrame([(900 + i, t, 1) for i, t in enumerate(odd)], "doc_id long, text string, n_tokens int"))
    tokenizer = Tokenizer.from_file(path)
    cache = str(tmp_path / "cache")
    got = token_counts.token_counts(rows, path, cache, limit=100).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids), n > 100) for r in rows.collect())
    assert Counter(map(tuple, got)) == want
    stored = spark.read.parquet(cache).count()
    again = token_counts.token_counts(rows, path, cache, limit=100).collect()
    assert Counter(map(tuple, again)) == want and spark.read.parquet(cache).count() == stored
    assert token_counts.token_counts(empty, path, str(tmp_path / "none")).count() == 0
    piece = str(public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece)
    counts = token_counts.token_counts(rows, piece, cache).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in counts) == Counter((r["doc_id"], len(model.encode(r["text"] or ""))) for r in rows.collect())


def test_long_texts_are_counted_in_spans(monkeypatch):
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    data = [sentence(300).encode()]
    want = token_counts.count_whole([d.decode() for d in data], path)
    monkeypatch.setattr(words, "SPAN", 50)
    assert list(token_counts.count_by_word(data, path)) == want


def test_memo_starts_anew(monkeypatch):
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 60)
    monkeypatch.setattr(token_counts, "_memos", {})
    for _ in range(5):
        data = [sentence(50), "x" * 100 + " y", "", "é" * 40 + "'s"]
        assert list(token_counts.count_by_word([d.encode() for d in data], path)) == token_counts.count_whole(data, path)
    assert len(token_counts._memos[path][0]) <= 60


# 8 ------------------------------------------------------------------------------------------------------------------------------


def leak_truth(docs, items, window=10):
    def tokens(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c >= "\x80" or c.isdigit() and c < "\x80" or "a" <= c <= "z" else " " for c in low).split(" ")

    of = lambda t: [w for w in tokens(t) if w]
    windows, often = defaultdict(set), Counter(x for r in docs for x in of(r["text"]))
    for r in items:
        w = of(r["text"])
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(r["item_id"])
    anchors = {x: sorted((often[t], o, t) for o, t in enumerate(x) if often[t])[:2] for x in windows if len(x) == window}
    out = []
    for r in docs:
        w, hit, names, near = of(r["text"]), set(), set(), set()
        held = lambda x, p: len(set(x) - set(w[max(0, p - window + 1) : p + window])) <= 2  # noqa: B023, E731
        for x, (a, *b) in ((x, a) for x, a in anchors.items() if len(a) > 1):
            starts = [[p - o for p, t in enumerate(w) if t == term and held(x, p)] for _, o, term in (a, *b)]
            if any(abs(s - e) <= 2 for s in starts[0] for e in starts[1]):
                near |= windows[x] - {None}
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    names |= windows[x]
        listed = sorted(str(x) for x in names if x is not None)
        out.append((r["doc_id"], len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit), len(near)))
    return Counter(out)


def loose_copies(text):
    """Passages of a text with a word left out, put in, replaced or exchanged every few words, so that no whole window is left."""
    w = text.split()[20:45]
    yield " ".join(x for i, x in enumerate(w) if i % 7 != 3)
    yield " ".join(x + " between" * (i % 6 == 2) for i, x in enumerate(w))
    yield " ".join("other" if i % 8 == 4 else x for i, x in enumerate(w))
    yield " ".join(w[i ^ 1] if i % 6 < 2 and (i ^ 1) < len(w) else x for i, x in enumerate(w))
    yield " ".join("other" if i % 2 else x for i, x in enumerate(w))


@pytest.mark.parametrize("blocks", [False, True])
def test_decontamination(spark, docs, empty, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 7)
    base = docs.first()["text"]
    items = [(1, " ".join(base.split()[20:45])), (10, " ".join(base.split()[40:52]).upper()), (2, "One, two!"), (3, None), (4, "  ..."), (None, " ".join(base.split()[80:95])), (5, sentence(30)), (1, "the é"), (6, "x x x x x x x x x x x"), (7, "ab")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = spark.createDataFrame([(500, "x " * 30), (501, "y " + "X-x. " * 11 + "z"), (502, "ab AB ab-cd"), (503, "one 2 two"), *((600 + i, t) for i, t in enumerate(loose_copies(base)))], "doc_id long, text string")
    rows = docs.select("doc_id", "text", F.lit("c").alias("item_id")).unionByName(extra.withColumn("item_id", F.lit("c")))
    got = decontamination.decontaminate(rows, bench).collect()
    assert Counter(map(tuple, got)) == leak_truth(rows.collect(), bench.collect())
    assert sum(r["n_near_items"] > 0 and not r["contaminated"] for r in got) > 3
    clean = decontamination.clean_rows(rows, bench)
    assert clean.columns == rows.columns and clean.count() == sum(not r["contaminated"] for r in got)
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.clean_rows(rows, bench.limit(0)).count() == rows.count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha one two three beta"), (2, "alpha one extra two three beta"), (3, "alpha " + "pad " * 30 + "beta")], "doc_id long, text string")
    windows = decontamination.windows_of(spark.createDataFrame([(1, "alpha one two three beta")], "item_id long, text string"))
    terms = decontamination._sorted_terms(windows)
    plan = decontamination.anchored(windows, spark.createDataFrame([(int(t), 1) for t in terms.view("int64")], "_term long, _count long")).cache()
    row = plan.first()
    assert row["_offset1"] == 0 and row["_offset2"] == 1
    plan = plan.withColumns({"_term2": F.col("_words")[4], "_offset2": F.lit(4)})
    index = decontamination.postings(docs, decontamination._sorted_terms(plan, "_term1", "_term2"))
    shifts = lambda n: sorted(r["_shift"] for r in decontamination.proximity(index, plan, n, 5).collect())
    assert shifts(0) == [0] and shifts(2) == [0, 1] and shifts(40) == [0, 1, 27]
    assert [r["_shift"] for r in decontamination.proximity(index, plan, 40, 0).orderBy("_shift").collect()] == [0, 1]


# 9 ------------------------------------------------------------------------------------------------------------------------------


def speech(letters: str, n: int) -> str:
    return " ".join("".join(random.choice(letters) for _ in range(random.randint(2, 6))) for _ in range(n))


def test_language(spark, empty):
    rows = [(i, speech("abcde", 40), "aa", "h1") for i in range(40)] + [(100 + i, speech("vwxyz", 40), "zz", "h2") for i in range(40)]
    wrong = [(200, speech("vwxyz", 200), "aa", "h2"), (201, "ab" * 2, None, "h1"), (202, "12 34 !!", "aa", "h1"), (203, None, "zz", "h2"), (204, "", None, None), (205, speech("éèàñö", 60), None, "h1"), (206, "ax", "aa", None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + wrong], "doc_id long, text string, lang string, source string, _n string")
    found = language.identify(docs)
    assert found.columns[:5] == docs.columns
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(rows) + len(wrong)
    assert all(got[r[0]]["_language"] == r[2] and got[r[0]]["_accepted"] for r in rows)
    assert got[200]["_language"] == "zz" and got[201]["_language"] == "aa"
    assert not any(got[i]["_accepted"] for i in (202, 203, 204)) and got[205]["_language"] == "und"
    urls = docs.withColumn("url", F.when(F.col("doc_id") < 100, "http://x.aa/p").otherwise("http://y.zz/p"))
    by_url = {r["doc_id"]: r for r in language.identify(urls, declared="lang", host=None, url="url").collect()}
    assert by_url[0]["_language"] == "aa" and by_url[139]["_language"] == "zz"
    assert language.identify(empty).count() == 0
    nothing = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert not any(r["_accepted"] for r in nothing)


def test_language_learns_address_suffixes(spark):
    """What a suffix says follows from the texts that come with it, whatever it is called; a missing one says nothing."""
    looks = [(f"h{i}", suffix, look, n) for i, (suffix, look, n) in enumerate([("uk", "aa", 900), ("uk", "bb", 100), ("at", "bb", 800), ("at", "aa", 200), ("com", "aa", 500), ("com", "bb", 500), (None, "aa", 400), (None, "bb", 500), ("io", "und", 3)])]
    priors = language.host_priors(spark.createDataFrame(looks, "_host string, _suffix string, _look string, _n long"), ["aa", "bb"])
    says = {r["_of_suffix"]: r["_address"] for r in priors.collect()}
    assert says["uk"][0] - says["uk"][1] > 0.7 and says["at"][1] - says["at"][0] > 0.5
    assert abs(says["com"][0] - says["com"][1]) < 0.1 and says[None] == [0.0, 0.0] and abs(says["io"][0] - says["io"][1]) < 0.5


def test_language_of_rows_held_out(spark):
    """The declared values of every fifth document are hidden; their texts and the rest must tell them."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    hidden = rows.withColumn("told", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    got = language.identify(hidden, declared="told").where("told is null").select("lang", "_language", "_accepted").collect()
    assert np.mean([r["lang"] == r["_language"] and r["_accepted"] for r in got]) > 0.97


def test_language_keeps_rare_ones(spark):
    """A language of 20 in 40,000 rows is identified; one of 3 rows has no model and is kept as declared."""
    rows = [(i, speech("abcde", 40), "aa", "h1") for i in range(60)] + [(100 + i, speech("vwxyz", 40), "zz", "h2") for i in range(20)] + [(200 + i, speech("éèàñö", 60), "qq", None) for i in range(3)]
    rows += [(300, speech("vwxyz", 40), None, None), (301, "12 34 !!", "qq", None), (302, speech("éèàñö", 60), "und", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    none = F.lit(None).cast("string")
    docs = docs.unionByName(spark.range(1000, 40000).select(F.col("id").alias("doc_id"), none.alias("text"), none.alias("lang"), none.alias("source")))
    got = {r["doc_id"]: (r["_language"], r["_accepted"]) for r in language.identify(docs).where("doc_id < 1000").collect()}
    assert all(got[i] == ("zz", True) for i in range(100, 120)) and got[300] == ("zz", True)
    assert all(got[i] == ("qq", True) for i in range(200, 203))
    assert not got[301][1] and not got[302][1]


# 10 -----------------------------------------------------------------------------------------------------------------------------


def test_em_finds_accuracies():
    import numpy as np

    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8])
    votes = np.where(rng.random((20000, 4)) < right, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, table, prior = quality.em(patterns, counts.astype(float))
    assert prior == pytest.approx(0.8, abs=0.02)
    assert ((posterior[inverse] > 0.5) == good).mean() > 0.95
    assert np.allclose(table[:, 1, 2] / (table[:, 1, 2] + table[:, 1, 1]), right, atol=0.03)


def test_quality(spark, docs, empty):
    good = [(i, sentence(40).capitalize() + ". " + sentence(30).capitalize() + ".\n" + sentence(20) + ".") for i in range(150)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in sentence(60).split())) for i in range(15)] + [(1100 + i, " ".join(w + "***" for w in sentence(60).split())) for i in range(15)]
    rows = spark.createDataFrame([(*r, 0.0) for r in good + bad + [(2000, None), (2001, ""), (2002, " \n")]], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in quality.classify(rows).collect()}
    assert len(got) == 183
    assert sum(got[i]["_kept"] for i in range(150)) == 150
    assert sum(got[r[0]]["_kept"] for r in bad) <= 3
    assert all(got[i]["_score"] == 0 and not got[i]["_kept"] for i in (2000, 2001, 2002))
    assert quality.classify(empty).count() == 0
    assert quality.classify(docs).count() == docs.count()


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    scored = quality.classify(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    rows = spark.read.parquet(f"{folder}/labels.parquet").join(scored, "doc_id").select("quality", "_score").collect()
    good, bad = ([r["_score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.98
    assert np.mean([(r["_score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.96


def test_quality_run_by_text(monkeypatch):
    parts = [t.encode() for t in ("One two two.\nONE!! TWO!!\n\nx | y $$", "", "a", "é à " * 40 + "end.")]
    whole = quality.Run(parts)
    for i, part in enumerate(parts):
        alone = quality.Run([part])
        for name in ("words", "sentences", "marked", "shouted", "barred", "repeated", "kinds", "lines", "line_kinds", "marks", "bars", "upper", "lower"):
            assert getattr(whole, name)[i] == getattr(alone, name)[0], name
        assert list(whole.votes()[i]) == list(alone.votes()[0])
        assert np.allclose(whole.trigrams()[i], alone.trigrams()[0])
    long = sentence(500).encode()
    want = quality.Run([long])
    monkeypatch.setattr(words, "SPAN", 64)
    got = quality.Run([long])
    assert (got.words[0], got.kinds[0], got.lines[0]) == (want.words[0], want.kinds[0], want.lines[0]) and np.allclose(got.trigrams(), want.trigrams())


def test_quality_names_that_clash(spark):
    rows = spark.createDataFrame([(1, "One two.", 1, "a", 2, True, "x"), (1, "One two.", 1, "a", 2, True, "x"), (None, None, 1, "a", 2, False, "y")], "doc_id long, text string, _votes int, _words string, _code int, _fit boolean, in0 string")
    got = quality.classify(rows)
    assert sorted(got.columns) == sorted([*rows.columns, "_posterior", "_score", "_kept"]) and dict(got.dtypes)["_votes"] == "array<int>"
    assert sorted((r["_words"], r["_code"], r["in0"]) for r in got.collect()) == [("a", 2, "x"), ("a", 2, "x"), ("a", 2, "y")]


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="ab \n", max_size=40), st.integers(0, 12))
def test_spans_keep_words(text, size):
    old = words.SPAN
    words.SPAN = size
    try:
        parts = list(token_counts.spans(text.encode()))
    finally:
        words.SPAN = old
    assert b" ".join(parts).split() == text.encode().split()


# Long addresses, junk languages, pages -------------------------------------------------------------------------------------------


def test_long_paths_take_time_in_proportion(spark):
    entries = spark.createDataFrame([("l", "block", "prefix", "h.example/a/a", 1, "add"), ("l", "block", "domain", "example", 1, "add"), ("l", "allow", "prefix", "h.example/a/a/a/a", 1, "add")], "list string, action string, kind string, pattern string, day int, change string")

    def seconds(parts: int) -> float:
        urls = spark.createDataFrame([(i, f"http://h.example/{i}" + "/a" * parts, 5) for i in range(3)] + [(9, "http://h.example" + "/a" * parts + "/", 5)], "i int, url string, day int")
        began = time.time()
        got = {r["i"]: (r["_active"], r["_rule"], r["_blocked"]) for r in url_filters.evaluate(urls, entries).collect()}
        assert got == {0: (1, "example", True), 1: (1, "example", True), 2: (1, "example", True), 9: (3, "h.example/a/a/a/a", False)}
        return time.time() - began

    seconds(10)
    assert seconds(40_000) < 20


def test_junk_codes_make_no_language(spark):
    real = [(i, " ".join(random.choice(VOCAB) for _ in range(40)), "en-US" if i % 2 else "EN", "h") for i in range(60)]
    real += [(100 + i, " ".join(random.choice(["der", "und", "nicht", "schön", "über"]) for _ in range(40)), "de", "h") for i in range(40)]
    junk = [(1000 + i, " ".join(random.choice(VOCAB) for _ in range(40)), f"{c}", "h") for i, c in enumerate([f"x{j}y" for j in range(30)] * 12 + ["zxx"] * 12 + ["n/a"] * 12 + ["mul"] * 12 + ["qaa"] * 12)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    looks = lambda rows: {r["doc_id"]: (r["_language"], r["_look"], r["_accepted"]) for r in language.identify(df(rows)).collect()}
    alone, among = looks(real), looks(real + junk)
    assert {v[0] for v in among.values()} == {"en", "de"} and all(among[i] == alone[i] for i in alone)
    assert {r["c"] for r in df([(1, "", "en-US", ""), (2, "", "zxx", ""), (3, "", "n/a", ""), (4, "", " PT_br ", ""), (5, "", "tlh", ""), (6, "", None, "")]).select(language.code("lang").alias("c")).collect()} == {"en", "pt", "tlh", None}


def test_pages_have_all_evidence(spark):
    page = lambda lang, words: f"<!DOCTYPE html><HTML class='x' lang=\"{lang}\"><head><style>p {{}}</style><script>var der = 'und nicht';</script></head><body><!-- der und --><p>{words}</p></body></html>"
    en, de = (lambda: " ".join(random.choice(VOCAB) for _ in range(30))), (lambda: " ".join(random.choice(["der", "und", "nicht", "schön", "über"]) for _ in range(30)))
    rows = [(i, f"http://a{i % 3}.example.uk/x", page("en-GB", en())) for i in range(40)] + [(100 + i, f"http://u@b{i % 3}.example.de:80/x", page("de", de())) for i in range(40)]
    rows += [(200, "http://b0.example.de/y", page("de", "der und")), (201, None, page("", de())), (202, "http://a0.example.uk", None), (203, "no url", "")]
    got = {r["page_id"]: r for r in language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(got[i]["_language"] == ("en" if i < 100 else "de") for i in got if i < 202)
    assert not got[202]["_accepted"] and got[203]["_language"] == "und"
    assert got[0]["declared"] == "en-GB" and got[201]["declared"] is None
    # Each piece of evidence moves the posterior of a short text.
    df = spark.createDataFrame(rows + [(300 + i, f"http://b1.example.de/{i}", page("de", "x1 q")) for i in range(3)], "page_id long, url string, html string")
    read = df.select("page_id", "url", language.page_text("html").alias("body"), language.markup_language("html").alias("declared"), language.page_host("url").alias("site")).cache()
    of = lambda **k: language.identify(read, id="page_id", text="body", **({"declared": "declared", "host": "site", "url": "url"} | k)).where("page_id = 300").first()["_posterior"]
    whole = of()
    assert len({round(x, 9) for x in (whole, of(host=None), of(url=None))}) == 3


@pytest.mark.parametrize("buckets, edge_rows", [(4096, 1000), (4, 2), (2, 1)])
def test_which_documents_are_taken(spark, docs, monkeypatch, buckets, edge_rows):
    """Keys, order, cut and taken words of each document once more in plain Python, with one bucket or many."""
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge_rows)
    monkeypatch.setattr(mixing, "LEVELS", 12)
    hot = docs.unionByName(spark.range(300).select(F.col("id").cast("long").alias("doc_id"), F.concat(F.lit("word #$ "), F.col("id") % 7, F.repeat(F.lit(" w"), (F.col("id") % 5).cast("int"))).alias("text"), F.lit("en").alias("lang"), F.lit("s0").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("size"), F.lit(1).alias("shard"), F.lit("").alias("keep_id")))
    rows = hot.select("doc_id", "text", "source", F.pmod(F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text")), F.lit(1 << 52)).alias("h"), mixing.quality_weight("text").alias("w")).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    want = Counter()
    for s in sizes:
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        left = int(np.floor(target[s] - epochs * sizes[s] + 0.5))
        mine = [(-np.log((r["h"] + 0.5) / 2**52) / r["w"], len((r["text"] or "").encode().split()), r["doc_id"]) for r in rows if r["source"] == s]
        for _, n, i in sorted(mine, key=lambda m: m[0]):
            take = max(0, min(n, left))
            left -= take
            want[i, epochs * n + take] += 1
    for keep_text in (True, False):
        got = mixing.mix(hot, keep_text=keep_text)
        assert Counter((r["doc_id"], r["_taken"]) for r in got.collect()) == want


# Wide rows and many keys ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most, bits", [(100_000, 28), (0, 28), (0, 15)])
def test_wide_rows_meet_keys(spark, monkeypatch, most, bits):
    from tidemark.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = spark.range(3000).select(F.sha1((F.col("id") % 2500).cast("string").cast("binary")).alias("k"), F.col("id").alias("i")).unionByName(spark.createDataFrame([(None, -1)], "k string, i long")).cache()
    keys = common.cut(rows.where("i % 3 = 0 and i < 2500").select("k", F.lit(7).alias("v")))
    inside = {r["k"] for r in keys.collect()}
    of = lambda df: Counter(map(tuple, df.select("k", "i").collect()))
    every = rows.collect()
    assert of(common.rows_with(rows, keys, "k")) == Counter((r["k"], r["i"]) for r in every if r["k"] in inside)
    assert of(common.rows_without(rows, rows.select("k"), keys, "k")) == Counter((r["k"], r["i"]) for r in every if r["k"] not in inside)
    joined = common.rows_left_join(rows, keys, "k").select("k", "i", "v").collect()
    assert Counter(map(tuple, joined)) == Counter((r["k"], r["i"], 7 if r["k"] in inside else None) for r in every)
    none = keys.limit(0)
    assert common.rows_with(rows, none, "k").count() == 0 and common.rows_without(rows, rows.select("k"), none, "k").count() == 3001


def test_few_texts_move(spark, docs, tmp_path, monkeypatch):
    """With no key table broadcast, the exchanges under a semi join hold likely rows alone, and operators give the same results."""
    from tidemark.llm import common

    rows = lambda df: Counter(map(str, df.collect()))
    path = "/opt/tokenizers/word_bpe_49k.json"
    run = lambda at: (rows(exact_dedup.exact_dedup(docs)), rows(near_dedup.near_groups(docs, shingle=3, percent=85).drop("_node")), rows(token_counts.token_counts(docs, path, f"{tmp_path}/{at}")))
    before = run("a")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert run("b") == before
    many = spark.range(20_000).select("id", F.sha1(F.col("id").cast("string").cast("binary")).alias("k"), F.repeat(F.lit("text"), 10).alias("_text"))
    keys = common.cut(many.where("id % 50 = 0").select("k"))
    plan = common.rows_with(many, keys, "k")
    assert common.flagged(many, keys, "k").where("_likely").count() < 400 + 300 and plan.count() == 400


def test_words_are_counted_as_the_library_counts_texts():
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    assert token_counts.splits_at_space(path) and not token_counts.splits_at_space(str(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(1)
    marks = ["a", "B", "'s", "'", " ", "  ", "\n", "é", "é", "́", "1", "9", "-", "<|endoftext|>", "<|", " ", "　", "ß", "İ", "日", "\U0001f642", "\x85", "\x1c"]
    some = ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 30))) for _ in range(3000)] + ["ΑΣ ΑΣ.", "ᄀ ᅡᆨ", "<| endoftext|>", ""]
    assert list(token_counts.count_by_word([t.encode() for t in some], path)) == token_counts.count_whole(some, path)


def test_sharding_writes_few_files_a_round(spark):
    """The tables of the rounds are small here, so each is written as one file, whatever the number of shuffle partitions."""
    from tidemark.llm import sharding

    nodes = spark.createDataFrame([(i, i // 10, 1) for i in range(200)], "_node long, _piece long, _load long")
    links = spark.createDataFrame([(i, i // 10 * 10, 1, i // 10) for i in range(200) if i % 10], "_a long, _b long, _weight long, _piece long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        labels = sharding.propagate(nodes, links, sharding.quotas(200, 4))
        assert labels.rdd.getNumPartitions() == 1 and labels.count() == 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
