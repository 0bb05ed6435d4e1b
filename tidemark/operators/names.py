"""Similar names over a whole roster: indexes of parts of names whose filters keep every pair of a score.

The score is similarity.weighted. It compares names as they are, with sorted words, with sorted distinct words, and with common words
first; pairs are looked up in four ways, and those that are found are scored once:

  - names as they are and, at the higher score that they need, their sorted words (views), up to LONG letters: by segments. A score needs c
    letters in common, so of a view of n letters at most n - c have no partner, and of one of m letters at most m - c. The found view is
    cut into two segments more than that makes together; read from the left, there is a first segment that as many of these letters
    precede as segments, and a later one that is behind by one, and both are whole. So they stand in the asked view, and the number of
    letters without partner before them says where. Lookups are equalities of both segments, their places and lengths; what they find by
    chance shrinks with four to six letters.
  - names that share a word: by the word together with the rarest letter pairs of the rest, if so many can't all be lost.
  - words of which nearly all, by length, are words of the other name, by the rarest words of the contained name.
  - longer names, and names inside a longer one: by letter pairs inside words, which no order changes. An edit that removes a letter
    destroys two of them at most, one that adds a letter one. So a name of which all comparisons of at least the threshold leave `loss`
    pairs or fewer destroyed shares a pair with such a partner among any loss + 1 of its own: the rarest in the roster are looked up (a
    prefix). Names so short or so broken up that they could lose all of their pairs look up single letters instead. Only names that
    have a partner of such a length on the other side take part.

Below a threshold of 85.5 a common word suffices for names of different length, and all words are looked up for these. Lookups are joins
dealt over a fixed number of tasks; the tables of segments' places have rows for pairs of lengths, and lengths alone go to the driver.

Entries carry their name's letters, and those of letter pairs its letter pairs too, as bitmaps of hashes. In the join itself, a partner
that lacks more of the looked-up name's pairs than its edits can destroy, or more of its letters than they can remove, is passed over,
and so no pair is moved that only shares words with many others; two that share a bit only hide a lack, so no pair is lost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import similarity
from tidemark.session import cut, lanes

#: Fixed values of the score: length ratios from which a name counts as longer, and as far longer; factors for sorted words, for parts.
LONGER, FAR_LONGER, SORTED, PART = 1.5, 8.0, 0.95, 0.9
#: Least threshold for which the filters hold.
LEAST = 67.0
#: Most letters of names that are looked up by segments, and the most letters without partner for which two segments are asked for.
LONG, PAIRED = 40, 10
#: Longs of a name's bitmaps of letter pairs and of letters.
PAIR_BITS, LETTER_BITS = tuple(f"_p{i}" for i in range(4)), tuple(f"_l{i}" for i in range(2))
#: What an entry of an index carries.
CARRIED = ("_s", "_n", "_u", "_v", *PAIR_BITS, *LETTER_BITS)


def prepared(names: DataFrame) -> DataFrame:
    """Distinct names with their words and lengths: _s, _n, _w (distinct words), _u (their length with single spaces), _all (all words),
    _v (their length)."""
    spread = lanes(names.sparkSession)
    own = names.select(F.trim(F.regexp_replace("name", r"\s+", " ")).alias("_t"), F.col("name").alias("_s")).where("_t <> ''").repartition(spread, "_t", "_s").distinct()
    words = own.select("_s", F.length("_s").alias("_n"), F.array_distinct(F.split("_t", " ")).alias("_w"), F.split("_t", " ").alias("_all"), F.length("_t").alias("_v"))
    return cut(words.withColumn("_u", F.length(F.array_join("_w", " "))))


def _numbered(words: list[str], q: int) -> list[str]:
    """The runs of q letters inside words, with the number of their occurrence: 'ab#1', 'ab#2'."""
    seen: dict[str, int] = {}
    out = []
    for w in words:
        for i in range(len(w) - q + 1):
            g = w[i : i + q]
            seen[g] = seen.get(g, 0) + 1
            out.append(f"{g}#{seen[g]}")
    return out


def numbered(words: str | Column, q: int) -> Column:
    """As _numbered, of a column with an array of words."""

    @F.pandas_udf("array<string>")
    def apply(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: _numbered(list(x), q))

    return apply(words)


def _marked(words: DataFrame) -> DataFrame:
    """Names with bitmaps of the letter pairs and letters of the distinct words (_mine_p0, ...) and of all words (_held_p0, ...)."""
    kinds = ((2, PAIR_BITS), (1, LETTER_BITS))

    @F.pandas_udf(", ".join(f"{c} long" for _, bits in kinds for c in bits))
    def marks(lists: pd.Series) -> pd.DataFrame:
        rows = []
        for x in lists:
            row: list[int] = []
            for q, bits in kinds:
                own = [0] * len(bits)
                for g in _numbered(list(x), q):
                    at = zlib.crc32(g.encode()) % (64 * len(bits))
                    own[at // 64] |= 1 << at % 64
                row += [v - (1 << 64) if v >> 63 else v for v in own]
            rows.append(row)
        return pd.DataFrame(rows, columns=[c for _, bits in kinds for c in bits], dtype="int64")

    both = words.withColumns({"_mine": marks("_w"), "_held": marks("_all")})
    return cut(both.select(*words.columns, *[F.col(f"_{kind}.{c}").alias(f"_{kind}{c}") for kind in ("mine", "held") for _, bits in kinds for c in bits]))


def _lacking(bits: tuple[str, ...], of: str, other: str) -> Column:
    """How many bits of the name `of` (a or f) the other one lacks; no more than it lacks runs of letters."""
    return sum((F.bit_count(F.col(f"{c}{of}").bitwiseAND(F.bitwise_not(f"{c}{other}"))) for c in bits[1:]), F.bit_count(F.col(f"{bits[0]}{of}").bitwiseAND(F.bitwise_not(f"{bits[0]}{other}"))))


def _within(of: str, other: str, gone: Column, destroyed: Column) -> Column:
    """Whether the name lacks at most so many letters and letter pairs in the other one."""
    return (_lacking(LETTER_BITS, of, other) <= gone) & (_lacking(PAIR_BITS, of, other) <= destroyed)


def _like(threshold: float) -> Column:
    """Whether the asked name's lack allows for a score with a partner of similar length: the names as they are, or their sorted words or
    sorted distinct words, whose scores count less."""
    gone, destroyed = [], []
    for kind, score in (("_n", threshold), *((k, threshold / SORTED) for k in ("_v", "_u") if threshold <= SORTED)):
        n, m = F.col(f"{kind}a"), F.col(f"{kind}f")
        g = F.floor((2 - score) / 2 * n - score / 2 * m + 1e-9)
        gone.append(g)
        destroyed.append(3 * g - n + m)
    most = lambda x: F.greatest(*x) if len(x) > 1 else x[0]
    return _within("a", "f", most(gone), most(destroyed))


def _inside(of: str, other: str, score: float) -> Column:
    """Whether the shorter name's lack allows for a score with a stretch of the longer one of at most its length."""
    n = F.col(f"_n{of}")
    return _within(of, other, F.floor(n * ((2 - 2 * score) / (2 - score)) + 1e-9), _loss(n, score, _shortest(n, score), n, 2))


def _loss(n: Column, score: float, shortest: Column, longest: Column, q: int) -> Column:
    """How many of the q-letter runs of a name of length n can be destroyed, at most, if it reaches the score (a fraction) with a partner
    of a length between shortest and longest. Of the d = (1 - score) * (n + m) edits, (d + n - m) / 2 remove a letter of the name."""

    def at(m: Column) -> Column:
        d = (1 - score) * (n + m)
        gone, added = (d + n - m) / 2, (d - n + m) / 2
        return q * gone + (q - 1) * added

    # A partner can't be reached beyond (1 - d) on either side; the loss is linear in m, so it is greatest at an end.
    return F.floor(F.greatest(at(shortest), at(longest)) + 1e-9)


def _shortest(n: Column, score: float) -> Column:
    return n * (score / (2 - score))


def _longest(n: Column, score: float) -> Column:
    return n * ((2 - score) / score)


def _alike(n: Column, m: Column, score: float) -> Column:
    """Whether names of lengths n and m can reach the score."""
    return (m >= _shortest(n, score) - 1e-6) & (m <= _longest(n, score) + 1e-6)


def _carried(rows: DataFrame, kind: str) -> DataFrame:
    """rows whose bitmaps are those of the distinct words (mine) or of all words (held)."""
    return rows.withColumns({c: F.col(f"_{kind}{c}") for c in (*PAIR_BITS, *LETTER_BITS)})


def _letters(kind: str) -> list[Column]:
    """The bitmaps of letters of the distinct words (mine) or of all words (held)."""
    return [F.col(f"_{kind}{c}").alias(c) for c in LETTER_BITS]


def _lettered(n: Column, m: Column, score: float) -> Column:
    """Whether two strings of n and m letters, whose bitmaps are those of a and f, can have as many letters in common as the score needs:
    each lacks no more of the other's than that leaves without partner."""
    common = F.ceil(score * (n + m) / 2 - 1e-9)
    return (_lacking(LETTER_BITS, "a", "f") <= n - common) & (_lacking(LETTER_BITS, "f", "a") <= m - common)


def _rarest(rows: DataFrame, list_: str, frequency: DataFrame, count: Column) -> DataFrame:
    """rows exploded over the `count` entries of list_ that are rarest in the roster, with CARRIED and _g."""
    each = _carried(rows, "mine").select(*CARRIED, count.alias("_k"), F.explode(list_).alias("_g"))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy(F.coalesce("_f", F.lit(0)), "_g"))
    return each.join(frequency, "_g", "left").withColumn("_r", rank).where("_r <= _k").select(*CARRIED, "_g")


def _met(left: DataFrame, right: DataFrame, condition: Column, *, looked: str = "asked") -> DataFrame:
    """(asked, found) of lookups and lists (_s, ..., _g); left holds asked names. looked: the side that looks up, of which there is less."""
    spread = lanes(left.sparkSession)
    named = lambda x, end: x.withColumnsRenamed({c: f"{c}{end}" for c in x.columns if c != "_g"}).repartition(spread, "_g")
    a, f = named(left, "a"), named(right, "f")
    a, f = (a.hint("shuffle_hash"), f) if looked == "asked" else (a, f.hint("shuffle_hash"))
    return a.join(f, "_g").where(condition).select(F.col("_sa").alias("asked"), F.col("_sf").alias("found"))


def _frequency(lists: DataFrame) -> DataFrame:
    return lists.groupBy("_g").agg(F.count("*").alias("_f"))


def _cuts(n: int, m: int, score: float) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Lookups of views of n letters among those of m: of each the segments' ((m, segments, first, second), place and length of both) in
    the found view, and the same in the asked one. Places count from 1; a second segment of no letters stands for none."""
    least = math.ceil(score * (n + m) / 2 - 1e-9)
    gone, added = n - least, m - least
    if gone < 0 or added < 0:
        return
    two = m >= gone + added + 2 and gone + added <= PAIRED
    k = gone + added + (2 if two else 1)
    at = [i * m // k for i in range(k + 1)]
    ways = lambda edits, g0=0, a0=0: ((g0 + g, a0 + edits - g) for g in range(edits + 1) if g0 + g <= gone and a0 + edits - g <= added)
    for i in range(k):
        for g, a in ways(i):
            p, long = at[i] + g - a, at[i + 1] - at[i]
            if p < 0 or p + long > n:
                continue
            if not two:
                yield (m, k, i, -1, at[i] + 1, long, 1, 0), (m, k, i, -1, p + 1, long, 1, 0)
                continue
            for j in range(i + 1, k):
                for h, b in ways(j - i - 1, g, a):
                    q, wide = at[j] + h - b, at[j + 1] - at[j]
                    if 0 <= q <= n - wide:
                        yield (m, k, i, j, at[i] + 1, long, at[j] + 1, wide), (m, k, i, j, p + 1, long, q + 1, wide)


def _lengths(rows: DataFrame, c: str = "_n") -> list[int]:
    return sorted(r[0] for r in rows.select(c).distinct().collect())


def _placed(a: DataFrame, b: DataFrame, score: float, *, sorted_: bool) -> DataFrame:
    """(asked, found) of names of up to LONG letters of which the names as they are, or their sorted words or sorted distinct words, share
    segments at places that a score allows for, and have the letters in common that it needs."""
    spark = a.sparkSession
    view = lambda v, kind: F.struct(v.alias("_view"), *_letters(kind))
    words = lambda w: F.array_join(F.array_sort(w), " ")
    own_views = F.array(view(words("_all"), "held"), view(words("_w"), "mine")) if sorted_ else F.array(view(F.col("_s"), "held"))
    views = lambda x: x.where(F.col("_n") <= LONG).select("_s", F.inline(F.array_distinct(own_views))).withColumn("_of", F.length("_view"))
    own, other = views(a), views(b)
    pairs = [(n, *cut_) for n in _lengths(own, "_of") for m in _lengths(other, "_of") for cut_ in _cuts(n, m, score)]
    kind = "_of int, _m int, _k int, _i int, _j int, _p int, _x int, _q int, _y int"
    asking = spark.createDataFrame(sorted({(n, *asked) for n, _, asked in pairs}), kind)
    held = spark.createDataFrame(sorted({(found[0], *found) for _, found, _ in pairs}), kind)

    def keyed(x: DataFrame, places: DataFrame, name: str) -> DataFrame:
        parts = [F.substring("_view", F.col(p), F.col(n)) for p, n in (("_p", "_x"), ("_q", "_y"))]
        carried = [F.col("_s").alias(name), *([F.col("_view").alias(f"_{name}")] if sorted_ else []), *[F.col(c).alias(f"{c}{name[0]}") for c in ("_of", *LETTER_BITS)]]
        return x.join(F.broadcast(places), "_of").select(*carried, F.xxhash64("_m", "_k", "_i", "_j", *parts).alias("_key")).repartition(lanes(spark), "_key")

    n, m = F.col("_ofa"), F.col("_off")
    edits = (n + m - 2 * F.ceil(score * (n + m) / 2 - 1e-9)).cast("int")
    x, y = ("_asked", "_found") if sorted_ else ("asked", "found")
    near = F.call_function("levenshtein", F.col(x), F.col(y), edits) >= 0  # a letter without partner is an edit, two may be one
    met = keyed(own, asking, "asked").distinct().hint("shuffle_hash").join(keyed(other, held, "found"), "_key")
    return met.where(_lettered(n, m, score) & near).select("asked", "found")


def _sharing(a: DataFrame, b: DataFrame, score: float) -> DataFrame:
    """(asked, found) of names with a common word that share one of the rarest letter pairs of their other words too, or whose other words
    are so few that all of theirs could be lost."""
    words = lambda x: x.select("_s", "_u", "_w", *_letters("mine"), F.explode("_w").alias("_word"))
    own, other = words(a), words(b)
    own = own.join(other.select("_word").distinct(), "_word", "left_semi")
    other = other.join(own.select("_word").distinct(), "_word", "left_semi")
    rest = lambda x: x.withColumn("_pairs", numbered(F.filter("_w", lambda w: w != F.col("_word")), 2))
    n = F.col("_u")
    own = rest(own).withColumn("_k", _loss(n, score, _shortest(n, score), _longest(n, score), 2) + 1)
    each = rest(other).select("_s", "_u", *LETTER_BITS, "_word", F.explode(F.array_append("_pairs", F.lit(""))).alias("_pair"))
    frequency = each.where("_pair <> ''").groupBy("_pair").agg(F.count("*").alias("_f"))
    rank = F.row_number().over(Window.partitionBy("_s", "_word").orderBy(F.coalesce("_f", F.lit(0)), "_pair"))
    rarest = own.where(F.size("_pairs") >= F.col("_k")).select("_s", "_u", *LETTER_BITS, "_word", "_k", F.explode("_pairs").alias("_pair")).join(frequency, "_pair", "left").withColumn("_r", rank).where("_r <= _k")
    asked = rarest.select("_s", "_u", *LETTER_BITS, "_word", "_pair").unionByName(own.where(F.size("_pairs") < F.col("_k")).select("_s", "_u", *LETTER_BITS, "_word", F.lit("").alias("_pair")))
    key = lambda x, end: x.select(*[F.col(c).alias(f"{c}{end}") for c in ("_s", "_u", *LETTER_BITS)], F.xxhash64("_word", "_pair").alias("_key")).repartition(lanes(x.sparkSession), "_key")
    return key(asked, "a").hint("shuffle_hash").join(key(each, "f"), "_key").where(_lettered(F.col("_ua"), F.col("_uf"), score)).select(F.col("_sa").alias("asked"), F.col("_sf").alias("found"))


def _by_pairs(a: DataFrame, b: DataFrame, score: float, condition: Column, *, alike: bool, looked: str = "asked") -> list[DataFrame]:
    """(asked, found) by letter pairs, and by letters where pairs could all be lost, of marked names. alike: names of similar length, else
    those of the looked side stand in a longer one."""
    n, out = F.col("_n"), []
    for q in (2, 1):
        pairs = F.aggregate("_w", F.lit(0), lambda n, w: n + F.greatest(F.length(w) - 1, F.lit(0)))
        own_a, own_b = (x.withColumns({"_mine": numbered("_w", q), "_held": numbered("_all", q), "_pairs": pairs}) for x in (a, b))
        lists = lambda x: _carried(x, "held").select(*CARRIED, F.explode("_held").alias("_g"))
        frequency = _frequency(lists(own_b))
        low, high = _shortest(n, score), _longest(n, score) if alike else n
        enough = F.col("_pairs") > _loss(n, score, low, high, 2)
        rows = (own_a if looked == "asked" else own_b).where(enough if q == 2 else ~enough)
        rarest = _rarest(rows, "_mine", frequency, F.least(_loss(n, score, low, high, q) + 1, F.size("_mine")))
        out.append(_met(rarest, lists(own_b), condition) if looked == "asked" else _met(lists(own_a), rarest, condition, looked="found"))
    return out


def candidates(asked: DataFrame, roster: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (asked, found) of names (name) that hold every pair with a weighted score of at least the threshold."""
    if threshold < LEAST:
        raise ValueError(f"a threshold below {LEAST} can't be looked up")
    t, part = threshold / 100, threshold / 100 / PART
    a, b = _marked(prepared(asked)), _marked(prepared(roster))
    na, nf = F.col("_na"), F.col("_nf")
    ratio = F.greatest(na, nf) / F.least(na, nf)
    out = [_placed(a, b, t, sorted_=False), *([_placed(a, b, t / SORTED, sorted_=True)] if t <= SORTED else [])]
    of = {"a": _lengths(a), "b": _lengths(b)}
    # Names of the lengths that have a longer partner on the other side, and the longer ones.
    short = lambda x, y: [n for n in of[x] if any(LONGER * n <= m <= FAR_LONGER * n for m in of[y])]
    wide = lambda x, y: [m for m in of[x] if any(LONGER * n <= m <= FAR_LONGER * n for n in of[y])]
    some = lambda x, lengths: x.where(F.col("_n").isin(lengths))
    if max(of["a"] + of["b"], default=0) > LONG:
        # A score needs at least half of the longer name's letters.
        x, y = (z.where(F.col("_n") > LONG / 2) for z in (a, b))
        out += _by_pairs(x, y, t, (F.greatest(na, nf) > LONG) & (_alike(na, nf, t) | _alike(F.col("_ua"), F.col("_uf"), t)) & _like(t), alike=True)
    if part <= 1 and short("a", "b"):
        out += _by_pairs(some(a, short("a", "b")), some(b, wide("b", "a")), part, (nf >= LONGER * na) & (nf <= FAR_LONGER * na) & _inside("a", "f", part), alike=False)
    if part <= 1 and short("b", "a"):
        out += _by_pairs(some(a, wide("a", "b")), some(b, short("b", "a")), part, (na >= LONGER * nf) & (na <= FAR_LONGER * nf) & _inside("f", "a", part), alike=False, looked="found")
    u = t / SORTED
    if u <= 1:
        out.append(_sharing(a, b, u))
        # Words that may be missing from the other name make up this share of the sorted words, their separators counted.
        slack = 2 * (1 - u) / (2 - u)
        listed = lambda x: x.select("_s", "_n", "_u", F.explode("_w").alias("_g"))
        frequency = _frequency(listed(b))

        def heads(x: DataFrame) -> DataFrame:
            each = x.select("_s", "_n", "_u", F.explode("_w").alias("_g")).join(frequency, "_g", "left")
            order = Window.partitionBy("_s").orderBy(F.coalesce("_f", F.lit(0)), "_g").rowsBetween(Window.unboundedPreceding, -1)
            before = F.coalesce(F.sum(F.length("_g") + 1).over(order), F.lit(0))
            return each.withColumn("_before", before).where(F.col("_before") <= F.floor(slack * F.col("_u") + 1e-9)).select("_s", "_n", "_u", "_g")

        out.append(_met(heads(a), listed(b), ratio < LONGER))
        out.append(_met(listed(a), heads(b), ratio < LONGER, looked="found"))
        if t <= SORTED * PART and (short("a", "b") or short("b", "a")):
            lengths = lambda x, y: [*short(x, y), *wide(x, y)]
            out.append(_met(some(listed(a), lengths("a", "b")), some(listed(b), lengths("b", "a")), (ratio >= LONGER) & (ratio <= FAR_LONGER)))
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.unionByName(more)
    return pairs.repartition(lanes(pairs.sparkSession), "asked", "found").distinct()


def similar(asked: DataFrame, roster: DataFrame, threshold: float = 90.0) -> DataFrame:
    """All pairs (asked, found, score) of distinct names (name) whose weighted score is at least the threshold. Empty and null names have
    no partner."""
    return candidates(asked, roster, threshold).withColumn("score", similarity.weighted(F.col("asked"), F.col("found"), once=True)).where(F.col("score") >= threshold)
