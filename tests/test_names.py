"""Similar names over a whole roster against brute force, and what is resolved through them."""

from __future__ import annotations

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import similarity
from tidemark.operators import names, quality, resolve

FIRST = ["john", "jon", "ana", "maria", "li", "a", "jose", "joao", "x", "muhammad", "khalil"]
LAST = ["smith", "smyth", "silva", "da silva", "souza", "santos jr", "jr", "wei", "b c", "o", "nurmagomedov", "rountree", "aldo aldo"]


def roster() -> list[str]:
    rng = random.Random(21)
    out = {f"{f} {g}" for f in FIRST for g in LAST} | {"silva", "jr", "a", "ab", "a b c d", "li li li", "john james smith", "smith john", "kmith john", "jonathan q smith the third", "", "nurmagomedov khabib abdulmanapovich"}
    for name in sorted(out)[::3]:  # swapped words, misspelt first letters of last words, lost and doubled letters
        w = name.split()
        if not w:
            continue
        out |= {" ".join(w[::-1]), " ".join([*w[:-1], rng.choice("qz") + w[-1][1:]]), name[: len(name) // 2] + name[len(name) // 2 + 1 :], name + name[-1], name + " " + rng.choice(LAST)}
    return sorted(out)


def brute(asked, held, threshold):
    return {(a, b) for a in asked if a for b in held if b and similarity.weighted_ratio(a, b) >= threshold}


@pytest.mark.parametrize("threshold", [96.0, 90.0, 86.0, 80.0, 70.0])
def test_no_pair_is_lost(spark, threshold):
    held = roster()
    asked = held[::4] + ["jon smjth", "silva da john", "nobody at all", "nurmagomedow", "jr santos", "muhammad"]
    df = lambda x: spark.createDataFrame([(n,) for n in x] + [(None,)], "name string")
    got = names.similar(df(asked), df(held), threshold).collect()
    assert len(got) == len({(r["asked"], r["found"]) for r in got})
    assert {(r["asked"], r["found"]) for r in got} == brute(asked, held, threshold)


def test_pairs_left_to_score_are_few(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9)))
    held = [f"{word()} {word()}" for _ in range(1500)]
    asked = [h[1:] for h in held[:100]]
    df = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    pairs = names.candidates(df(asked), df(held), 90.0)
    assert {(a, h) for a, h in zip(asked, held) if similarity.weighted_ratio(a, h) >= 90} <= {tuple(r) for r in pairs.collect()}
    assert pairs.count() < len(asked) * len(held) / 20


def test_few_letters_leave_few_pairs(spark):
    """Of names over sixteen letters nearly all share some letter pair; few share as many as a score of 80 needs."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(8))
    held = [f"{word()} {word()}" for _ in range(800)]
    asked = [h[:7] + h[8:] for h in held[:80]]
    df = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    pairs = {tuple(r) for r in names.candidates(df(asked), df(held), 80.0).collect()}
    assert set(zip(asked, held)) <= pairs and len(pairs) < len(asked) * len(held) / 100


def test_segments_leave_hardly_a_pair_too_many(spark):
    """Among names over sixteen letters, few but those within a score's edits share two segments at places that the score allows for."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(8))
    held = [f"{word()} {word()}" for _ in range(2000)]
    asked = [h[:7] + h[8:] for h in held[:200]] + [f"nobody zz{i}" for i in range(200)]
    df = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    pairs = {tuple(r) for r in names.candidates(df(asked), df(held), 80.0).collect()}
    assert set(zip(asked, held[:200])) <= pairs and len(pairs) < 300


def test_cuts_are_few_and_inside():
    """Names of 16 and 17 letters out of sixteen meet in fewer than one of a thousand pairs by chance."""
    assert sum(16.0 ** -(found[5] + found[7]) for found, _ in names._cuts(16, 17, 0.8)) < 1e-3
    for n in range(1, 30):
        for m in range(1, 30):
            for (*_, p, x, q, y), (*_, r, _, t, _) in names._cuts(n, m, 0.8):
                assert 1 <= p and p + x - 1 <= m and q + y - 1 <= m and 1 <= r and r + x - 1 <= n and t + y - 1 <= n


def test_low_thresholds_and_empty_rosters(spark):
    none = spark.createDataFrame([], "name string")
    some = spark.createDataFrame([("a b",)], "name string")
    assert names.similar(some, none).count() == names.similar(none, some).count() == 0
    with pytest.raises(ValueError):
        names.similar(some, some, 60.0)


def test_last_words_swapped_or_misspelt(spark):
    held = spark.createDataFrame([(1, "Charles Oliveira"), (2, "Carlos Prates Jr."), (3, "Zhang Weili"), (4, "José Aldo")], "id long, name string")
    asked = spark.createDataFrame([("Charles Pliveira",), ("Oliveira Charles",), ("Carlos Prates",), ("Weili Zhang",), ("jose  ALDO",), ("Charles Dickens",)], "name string")
    aliases = spark.createDataFrame([], "alias string, fighter_id long")
    got = {r["name"]: (r["fighter_id"], r["match_type"]) for r in resolve.resolve_names(asked, held, aliases).collect()}
    assert got == {"Charles Pliveira": (1, "fuzzy"), "Oliveira Charles": (1, "fuzzy"), "Carlos Prates": (2, "fuzzy"), "Weili Zhang": (3, "fuzzy"), "jose  ALDO": (4, "exact"), "Charles Dickens": (None, "unresolved")}


def test_event_names(spark):
    pairs = [
        ("UFC 330", "UFC 330: Abe vs. Bo", True), ("UFC330", "ufc 331: Abe vs. Bo", False), ("UFC 330", "UFC Fight Night: Abe vs. Bo", False),
        ("UFC Fight Night 7", "UFC Fight Night: Abe vs. Bo", True), ("UFC on ESPN 60", "UFC on ESPN 61", True), ("Gála: Àbe", "gala: abe", True), ("Gala: Abe", "Fair: Zed vs. Yu", False),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    for r in df.withColumn("got", resolve.names_compatible(F.col("a"), F.col("b"))).collect():
        assert r["got"] == r["want"], r
    other = spark.createDataFrame([("PRIDE 3", 3), ("UFC 3", None)], "n string, want int")
    assert all(r["got"] == r["want"] for r in other.withColumn("got", S.event_number("n", "pride")).collect())


def test_titles_and_winners(spark):
    rows = [("Middleweight Championship Bout", True, "W/NC", "red"), ("UFC TITLE", True, "NC/W", "blue"), ("Lightweight Bout", False, "D/D", None), (None, False, None, None), ("x", False, "W/W", "red"), ("x", False, "L/W", "blue"), ("x", False, "NC", None)]
    df = spark.createDataFrame(rows, "c string, t boolean, o string, w string")
    for r in df.withColumns({"title": S.is_title("c"), "side": S.winner_side("o")}).collect():
        assert (r["title"], r["side"]) == (r["t"], r["w"]), r


def test_duplicate_events(spark):
    day = datetime.date(2024, 5, 4)
    near, far = day + datetime.timedelta(days=1), day + datetime.timedelta(days=2)
    events = spark.createDataFrame([
        (1, "Night: Abe vs. Bo", day, None, 10), (2, "Night: Abe vs. Bo 2", near, "u2", None), (3, "Night: Abe vs. Bo", far, "u3", None),
        (4, "Night: Abe vs. Bo", day, None, 11), (5, "Night: Abe vs. Bo", day, "u5", 12), (6, "Night: Abe vs. Bo", day, None, None), (7, "Quite another", day, "u7", None),
    ], "event_id long, name string, day date, source_url string, page_id long")
    got = {(r["announced_id"], r["held_id"]): r["score"] for r in quality.duplicate_events(events).collect()}
    assert set(got) == {(1, 2), (1, 5), (4, 2), (4, 5)}
    assert got[1, 5] == 100.0 and got[1, 2] == round(similarity.weighted_ratio("Night: Abe vs. Bo", "Night: Abe vs. Bo 2"), 1)


def test_claims_of_crowded_days(spark):
    """Rows that share a day and a name are compared once, as a group; ids that occur twice count all their partners."""
    day = lambda i: datetime.date(2024, 5, 1) + datetime.timedelta(days=i)
    left = [(i, day(0), "Gala: Abe vs. Bo") for i in range(400)] + [(900, day(9), "UFC 7"), (901, day(9), "Fair of Yu"), (902, day(20), "Open Night"), (902, day(40), "Open Night"), (903, day(60), "Lone Night"), (904, day(70), None)]
    right = [(2000 + i, day(1), "gala abe vs bo") for i in range(400)] + [(3000, day(10), "ufc7: Cy"), (3001, day(9), "UFC 8"), (3002, day(20), "open night"), (3003, day(40), "open night"), (3004, day(61), "LONE night"), (3005, day(70), None)]
    df = lambda rows: spark.createDataFrame(rows, "id long, day date, name string")
    assert {tuple(r) for r in resolve.compatible_claims(df(left), df(right)).collect()} == {(900, 3000), (903, 3004)}
    near = {(r["l_name"], r["r_name"]): (r["l_n"], r["r_n"]) for r in resolve.near_names(df(left[:400]), df(right[:400])).collect()}
    assert near == {("Gala: Abe vs. Bo", "gala abe vs bo"): (400, 400)}


def test_crowds_of_one_name_move_few_pairs(spark):
    """Of names that share all but their last word, only those move whose letters allow for the score, and none of the score is lost."""
    last = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(160)]
    held = sorted(f"ana da silva {x}" for x in last)
    asked = sorted({f"silva {x} ana" for x in last[80:]} | {f"ana ana silva {x}" for x in last[:40]} | set(held[::3]))
    df = lambda names_: spark.createDataFrame([(n,) for n in names_], "name string")
    want = {(x, y) for x in asked for y in held if similarity.weighted_ratio(x, y) >= 88}
    found = names.candidates(df(asked), df(held), 88.0)
    moved = {tuple(r) for r in found.collect()}
    assert want <= moved and 150 < len(want) and len(moved) < len(asked) * len(held) / 8


def test_resolution_of_a_crowd_moves_few_pairs(spark, monkeypatch):
    """Names that share all but their last word are resolved as by brute force, and few pairs of them move."""
    last = [hashlib.md5(str(i).encode()).hexdigest()[:4] for i in range(200)]
    held = {f"khalil souza santos {x}": i for i, x in enumerate(dict.fromkeys(last))}
    asked = sorted({f"khalil souza qantos {x}" for x in last[::4]} | {f"souza khalil santos {x}" for x in last[1::4]})
    best = {x: max(((similarity.weighted_ratio(x, y), -i) for y, i in held.items()), default=(0, 0)) for x in asked}
    moved, candidates = [], names.candidates

    def counted(a, b, threshold):
        moved.append(candidates(a, b, threshold))
        return moved[0]

    monkeypatch.setattr(names, "candidates", counted)
    roster_ = spark.createDataFrame([(i, n) for n, i in held.items()], "id long, name string")
    got = resolve.resolve_names(spark.createDataFrame([(n,) for n in asked], "name string"), roster_, spark.createDataFrame([], "alias string, fighter_id long"))
    assert {r["name"]: r["fighter_id"] for r in got.collect()} == {x: -i if score >= 90 else None for x, (score, i) in best.items()}
    assert moved[0].count() < len(asked) * len(held) / 4
