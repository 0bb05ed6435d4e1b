"""Phrases, personal data and spelling variants against brute force, with nulls, empty and long texts, ties, repeated rows and clashes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import personal, phrases, spelling, words

DDL = "doc_id long, text string, lang string, n long, word string, phrase string, _spans string, `key` long, spans string"


def rows(texts, langs=None):
    return [(i if i % 9 else None, t, langs[i % len(langs)] if langs else "en", 1, "w", "p", "x", 2, "s") for i, t in enumerate(texts)]


# 11 -----------------------------------------------------------------------------------------------------------------------------


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_phrases(docs, least, longest, share, top):
    count, size = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            size[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    count[lang, tuple(w[i : i + n])] += 1
    found = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if any(lg == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (lg, q), b in found.items()):
            continue
        score, _, left, right = min((2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, r, p.decode(), -a, left, right, size[lang], -s) for lang, x in out.items() for r, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1)}


def texts_of_phrases():
    rng = random.Random(3)
    vocab = ["the", "of", "Éa", "new", "york", "city", "x1", "\x1cq", "b\x85c"]
    made = []
    for _ in range(60):
        made.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40))).replace("x1", "x1,", 1))
    return [*made, None, "", " \t ", ".,;", "New  York\tCITY" + "\r\nnew york city" * 40, "one hot line here\n" * 300, "tie pair. " * 35 + "eit pair! " * 35, made[0], made[0]]


@pytest.mark.parametrize("bits", [None, 8])
def test_phrases(spark, monkeypatch, bits):
    if bits:  # a bitmap that is nearly full changes nothing
        monkeypatch.setattr(phrases, "MOST_BITS", bits)
    docs = rows(texts_of_phrases(), ["en", None, "und", "fr"])
    df = spark.createDataFrame(docs, DDL).repartition(3)
    for least, longest, share, top in ((30, 4, 80, 2000), (5, 4, 80, 7), (2, 3, 50, 2000)):
        got = phrases.collocations(df, least=least, longest=longest, share=share, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert set(map(tuple, got.collect())) == brute_phrases(docs, least, longest, share, top)


def test_phrases_of_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(words, "SPAN", 1000)
    docs = [(1, "a b c d e f g " * 3000, "en", 1, "w", "p", "x", 2, "s"), (2, "z" * 20000 + " q", "en", 1, "w", "p", "x", 2, "s")]
    got = phrases.collocations(spark.createDataFrame(docs, DDL))
    assert set(map(tuple, got.collect())) == brute_phrases(docs, 30, 4, 80, 2000)
    assert phrases.collocations(spark.createDataFrame([], DDL)).count() == 0
    assert phrases.collocations(spark.createDataFrame(rows([None, "", ". ."]), DDL)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 1 << 61
    expr = F.expr(f"cast(2000000 as decimal(10,0)) * cast({big}L as decimal(20,0)) div (cast({big}L as decimal(20,0)) + {big}L)")
    assert spark.range(1).select(expr).first()[0] == 1000000


# 12 -----------------------------------------------------------------------------------------------------------------------------


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x if x < 10 else x - 9
    return total % 10 == 0


def base_spans(text):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return [f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def found(texts):
    return personal.find([t.encode() for t in texts])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aZ0159@@..+-- ()%_é\U0001f600", max_size=60), min_size=1, max_size=4))
def test_base_spans_are_those_of_the_patterns(texts):
    for text, spans in zip(texts, found(texts)):
        assert [f"{k}:{a}:{b}" for k, a, b, _, base, *_ in spans if base] == base_spans(text)


CASES = {
    "mail a.b+c@x-y.example.com!": [("email", "a.b+c@x-y.example.com")],
    "a@b.c@d.e%f@g.h": [("email", "a@b.c"), ("email", "d.e%f@g.h")],
    "é 10.0.0.1.2.3.4 256.1.1.1 0001.2.3.4": [("ip", "10.0.0.1"), ("ip", "0001.2.3.4")],
    "4539 1488 0343 6467, 4539 1488 0343 6468": [("card", "4539 1488 0343 6467")],
    "+1 (017) 555-7713": [("phone", "+1 (017) 555-7713")],
    "pay GB82 WEST 1234 5698 7654 32 NOW": [("iban", "GB82 WEST 1234 5698 7654 32")],
    "pay DE89370400440532013000.": [("iban", "DE89370400440532013000")],
    "pay GB82 WEST 1234 5698 7654 33": [],
    "tel: 030 1234 5678": [("local_phone", "030 1234 5678")],
    "room 030 1234 5678": [],
    "SSN 078-05-1120": [("ssn", "078-05-1120")],
    "part 078-05-1120": [],
    "call or SSN 078-05-1120": [("local_phone", "078-05-1120")],
    "tel +44 20 7946 0958": [("phone", "+44 20 7946 0958")],
}


def test_planted_spans():
    for text, spans in zip(CASES, found(list(CASES))):
        assert [(k, text[a:b]) for k, a, b, *_ in spans] == CASES[text], text
        assert [(k, text.encode()[a:b].decode()) for k, *_, a, b in spans] == CASES[text], text


def test_words_nearby_raise_the_score():
    (far,), (near,) = found(["xx 4539148803436467", "visa 4539148803436467"])
    assert near[3] > far[3]
    text = "phone" + " " * 60 + "030 1234 5678"
    assert found([text]) == [[]]
    assert found(["my phone", "030 1234 5678"]) == [[], []]  # another text's words don't count


def test_long_digits_and_addresses_take_linear_time():
    import time

    began = time.time()
    found(["1" * 400_000, "a" * 400_000, "1." * 200_000, "a@" * 200_000, "+1(" + "(" * 400_000, "AB12" + "A" * 400_000])
    assert time.time() - began < 20


def test_personal_data(spark):
    texts = [None, "", *CASES, "ä" * 50 + " x@y.zz " + "+49 30 1234567", " ".join(CASES) * 30, "no data"]
    docs = rows(texts) + rows(texts)[3:5]
    df = spark.createDataFrame(docs, DDL)
    got = personal.personal_data(df)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = Counter()
    for r in docs:
        base = base_spans(r[1] or "")
        n = Counter(s.split(":")[0] for s in base)
        want[r[0], n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(base).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    for r in got.where("spans <> ''").collect():
        starts = [(int(s.split(":")[1]), personal.KINDS.index(s.split(":")[0])) for s in r["spans"].split(",")]
        assert starts == sorted(starts)
    whole = personal.personal_spans(df)
    assert set(df.columns) <= set(whole.columns) and whole.count() == len(docs)
    assert personal.personal_data(spark.createDataFrame([], DDL)).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame(rows([None, "é a@b.cc und +1 (017) 555-7713!", "nothing"]), DDL)
    got = personal.redact(df)
    assert got.columns == df.columns
    assert [r["text"] for r in got.collect()] == [None, "é [email] und [phone]!", "nothing"]
    assert personal.redact(spark.createDataFrame([], DDL)).count() == 0


# 13 -----------------------------------------------------------------------------------------------------------------------------


def brute_words(docs, least=5):
    count = Counter()
    for doc, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(docs):
    count = brute_words(docs)
    about = {w: [v for v in count if near(w, v)] for w in count}
    best = {w: min(vs, key=lambda v: (-count[v], v)) for w, vs in about.items() if vs}
    form = {w: v for w, v in best.items() if count[v] >= 5 * count[w]}
    out = set()
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(about[w]), count[form[w]] if w in form else None))
    return out


def texts_of_words():
    rng = random.Random(11)
    chain = "colours " * 5000 + "colour " * 900 + "collour " * 160 + "coollour " * 30 + "cooollour " * 5  # forms lead on to a last one
    tied = "gardens " * 100 + "gartens " * 100 + "garens " * 8 + "gardans " * 7
    letters = ["abcabc", "aabbcc", "äbcabc", "ÿabcabc", "aaaaaa", "aaaaaaa", "aaaaaaaa", "ÉCOLEs", "école×s", "écoles"]
    mixed = " ".join(rng.choice(letters) for _ in range(900))
    edits = []
    for _ in range(400):
        w = list("understanding")
        w[rng.randrange(13)] = rng.choice("abcé")
        edits.append("".join(w))
    return [chain, tied, mixed, " ".join(edits), None, "", "12 ab", "Straße Straße straße straße straßen straße", ("x" * 3000 + " ") * 6 + ("x" * 2999 + " ") * 40, mixed, mixed]


def test_variants(spark):
    docs = rows(texts_of_words()) + rows(texts_of_words())[2:4]
    got = spelling.variants(spark.createDataFrame(docs, DDL).repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(docs)
    rows_ = got.collect()
    assert len(rows_) == len(want) and set(map(tuple, rows_)) == want
    assert {r["root"] for r in rows_ if r["word"] == "cooollour"} == {"colours"}
    assert {r["form"] for r in rows_ if r["word"] == "garens"} == {"gardens"}
    assert spelling.variants(spark.createDataFrame([], DDL)).count() == 0
    assert spelling.variants(spark.createDataFrame(rows([None, "one"]), DDL)).count() == 0


def test_words_do_not_depend_on_parts(spark, monkeypatch):
    docs = rows(texts_of_words())
    monkeypatch.setattr(words, "SPAN", 500)
    counted = Counter()
    for doc, text, *_ in docs:
        for part in spelling.parts((text or "").encode()):
            for w, n in zip(*spelling._counted([str("" if doc is None else doc).encode()], [part])):
                counted[w.decode()] += int(n)
    assert {w: n for w, n in counted.items() if n >= 5} == brute_words(docs)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=7), min_size=2, max_size=12, unique=True))
def test_deletion_keys_meet_for_near_words_alone(some):
    keys = list(zip(*spelling.deletion_keys(np.arange(len(some)), [w.encode("latin-1") for w in some])))
    met = Counter()
    for k, a, lo, hi in keys:
        for k2, b, lo2, hi2 in keys:
            if k == k2 and a < b and max(lo, lo2) <= min(hi, hi2):
                met[int(a), int(b)] += 1
    assert met == Counter((i, j) for i in range(len(some)) for j in range(i + 1, len(some)) if near(some[i], some[j]))


@given(st.lists(st.binary(min_size=1, max_size=90), min_size=1, max_size=8), st.integers(0, 2**32 - 1))
def test_checksums_go_on(runs, before):
    data = b"".join(runs)
    ends = np.cumsum([len(r) for r in runs])
    got = spelling.checksums(np.full(len(runs), before, dtype=np.uint32), data, ends - [len(r) for r in runs], ends)
    assert got.tolist() == [zlib.crc32(r, before) for r in runs]


def test_personal_data_twin_on_planted_texts():
    """The SQL of the query against the operator where accounts, national numbers and words nearby stand side by side."""
    import duckdb

    from tidemark.llm.queries import OP12_SQL

    rng = random.Random(17)
    tokens = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "AT611904300234573201", "GB82 WEST 1234 5698 7654 33", "NOW", "tel", "Téléphone:", "étel", "call", "SSN", "social security", "078-05-1120", "030 1234 5678", "(030) 123-4567", "1-2", "a@b.cc", "x.y@z-1.example.com", "10.0.0.1", "300.1.1.1", "4539 1488 0343 6467", "4539148803436467", "+49 30 1234567", "+1 (017) 555-7713", "visa", "é", "\U0001f600", "x", "-", ",", "\n", "IBAN"]
    texts = [*CASES, None, "", *["".join(rng.choice(tokens) + rng.choice([" ", "", "  ", ". "]) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = {r[0]: r[1:] for r in con.execute(OP12_SQL).fetchall()}
    assert len(got) == len(texts)
    kinds = Counter()
    for i, spans in enumerate(found([t or "" for t in texts])):
        line = lambda some: ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in some)
        base = [s for s in spans if s[4]]
        n = Counter(s[0] for s in base)
        kinds.update(s[0] for s in spans)
        assert got[i] == (n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(line(base).encode()).hexdigest(), line(spans)), texts[i]
    assert min(kinds[k] for k in personal.KINDS) >= 10
