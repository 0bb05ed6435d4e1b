"""Point-in-time history: what was known about a competitor strictly before a day.

Everything that is summed over earlier bouts goes through `strictly_before`. It first sums by (competitor, day), so that the ordered
part works on at most one row per competitor and day however many bouts a competitor has, and then takes the running sums of the days
before. Rows of the same day therefore never see each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def two_sides(bouts: DataFrame) -> DataFrame:
    """One row per bout and corner: self, opp, corner, won (null without a winner), with the bout's own columns."""
    rest = [c for c in bouts.columns if c not in ("red", "blue", "winner")]
    side = lambda me, other: F.struct(F.col(me).alias("self"), F.col(other).alias("opp"), F.lit(me).alias("corner"), (F.col("winner") == F.col(me)).cast("int").alias("won"))
    return bouts.select(*rest, F.inline(F.array(side("red", "blue"), side("blue", "red"))))


def strictly_before(facts: DataFrame, key: str, day: str, sums: dict[str, Column], last: Sequence[str] = (), *, only: Column | None = None) -> DataFrame:
    """facts with one column per entry of `sums`, the sum of that expression over the rows of the same key on earlier days, and with
    last_<c> for the columns in `last`, their largest value on earlier days. Sums over nothing are null. only: rows that count."""
    counts = (lambda c: c) if only is None else (lambda c: F.when(only, c))
    daily = facts.groupBy(key, day).agg(*[F.sum(counts(e)).alias(f"_{n}") for n, e in sums.items()], *[F.max(counts(F.col(c))).alias(f"_max_{c}") for c in last])
    before = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    known = daily.select(key, day, *[F.sum(f"_{n}").over(before).alias(n) for n in sums], *[F.max(f"_max_{c}").over(before).alias(f"last_{c}") for c in last])
    return facts.join(known, [key, day])


def asof_lookup(asked: DataFrame, facts: DataFrame, key: str, day: str, sums: dict[str, Column], last: Sequence[str] = (), *, only: Column | None = None) -> DataFrame:
    """asked (any rows with the key and a day, which needn't occur in facts) with one column per entry of `sums`, the sum of that
    expression over the facts of the key on earlier days, and with last_<c>, the largest earlier value, for the columns in `last`.
    Sums over nothing, of an unknown or null key and before a null day are null. only: facts that count.

    Facts are summed by day first. The daily sums and the distinct (key, day) pairs asked for then lie in one table, pairs before the
    sums of their day, and running sums over that table are read off at the pairs: one shuffle by key and no range join. A key's part
    of it holds its days and the days asked for, so it is bounded by the calendar, not by the number of rows."""
    counted = facts if only is None else facts.where(only)
    daily = counted.groupBy(F.col(key).alias("_key"), F.col(day).alias("_day")).agg(*[F.sum(e).alias(f"_s{i}") for i, e in enumerate(sums.values())], *[F.max(c).alias(f"_l{i}") for i, c in enumerate(last)])
    pairs = asked.select(F.col(key).alias("_key"), F.col(day).alias("_day")).where(F.col("_key").isNotNull() & F.col("_day").isNotNull()).distinct()
    both = daily.withColumn("_fact", F.lit(True)).unionByName(pairs.withColumn("_fact", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy("_key").orderBy("_day", "_fact").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = both.select("_key", "_day", "_fact", *[F.sum(f"_s{i}").over(before).alias(n) for i, n in enumerate(sums)], *[F.max(f"_l{i}").over(before).alias(f"last_{c}") for i, c in enumerate(last)]).where("not _fact").drop("_fact")
    return asked.join(known.withColumnsRenamed({"_key": key, "_day": day}), [key, day], "left").select(*asked.columns, *sums, *[f"last_{c}" for c in last])


#: Round statistics that are summed for both sides.
STATS = ("sig_landed", "sig_attempted", "total_landed", "td_landed", "td_attempted", "sub_attempts", "knockdowns", "control")


def round_totals(rounds: DataFrame) -> DataFrame:
    """Per (bout, fighter): sums of the own and the opponent's statistics over the rounds in which both have a row, and the early and
    late sums and counts. Two corners make a pair, so the opponent's value is the round's total minus the own one."""
    pair = rounds.groupBy("bout_id", "round").agg(F.collect_list(F.struct("fighter", *STATS)).alias("rows")).where(F.size("rows") == 2)
    both = F.array(F.struct(F.col("rows")[0].alias("me"), F.col("rows")[1].alias("other")), F.struct(F.col("rows")[1].alias("me"), F.col("rows")[0].alias("other")))
    sides = pair.select("bout_id", "round", F.inline(both))
    late = F.col("round") >= 3
    sums = [F.sum(f"{w}.{s}").alias(f"{p}_{s}") for w, p in (("me", "own"), ("other", "opp")) for s in STATS]
    for s in ("sig_landed", "td_landed"):
        sums += [F.sum(F.when(late, F.col(f"me.{s}"))).alias(f"late_{s}"), F.sum(F.when(~late, F.col(f"me.{s}"))).alias(f"early_{s}")]
    sums += [F.sum(late.cast("long")).alias("late_rounds"), F.sum((~late).cast("long")).alias("early_rounds")]
    return sides.groupBy("bout_id", F.col("me.fighter").alias("self")).agg(*sums)


def bout_facts(bouts: DataFrame, rounds: DataFrame | None = None) -> DataFrame:
    """two_sides with the duration and, given rounds, the round totals (null where a bout has none)."""
    facts = two_sides(bouts).withColumn("duration", S.duration_seconds("method", "scheduled_rounds", "ending_round", "ending_time"))
    return facts if rounds is None else facts.join(round_totals(rounds), ["bout_id", "self"], "left")


def _n(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def outcome_sums() -> dict[str, Column]:
    """What is summed over earlier bouts from the results. A missing method counts as a finish and not as a disqualification."""
    won, lost, dq = F.col("won") == 1, F.col("won") == 0, F.col("method").eqNullSafe("DQ")
    method = F.coalesce(F.lower("method"), F.lit(""))
    return {
        "bouts": F.lit(1),
        "decided": _n(F.col("won").isNotNull()),
        "wins": _n(won),
        "decision_wins": _n(won & S.is_decision("method")),
        "decision_losses": _n(lost & S.is_decision("method")),
        "submission_wins": _n(won & (F.col("method") == "Submission")),
        "finishes": _n(won & ~S.is_decision("method") & ~dq),
        "losses": _n(lost & ~dq),
        "ko_losses": _n(lost & method.startswith("ko")),
        "submission_losses": _n(lost & method.startswith("submission")),
        "titles": _n(F.col("is_title")),
        "seconds": F.col("duration"),
        "timed": _n(F.col("duration").isNotNull()),
    }


def stat_sums() -> dict[str, Column]:
    names = [f"{p}_{s}" for p in ("own", "opp") for s in STATS]
    names += [f"{p}_{s}" for p in ("late", "early") for s in ("sig_landed", "td_landed")] + ["late_rounds", "early_rounds"]
    return {n: F.col(n) for n in names}


def asof(facts: DataFrame, *, stats: bool = True) -> DataFrame:
    """facts with all sums over earlier completed bouts, prefixed with h_, and last_day."""
    return strictly_before(facts, "self", "day", all_sums(stats), last=("day",), only=F.col("status") == "completed")


def asof_any(asked: DataFrame, facts: DataFrame, *, stats: bool = True) -> DataFrame:
    """asked (rows with self and day) with all sums over the completed bouts of `facts` before that day, prefixed with h_, and last_day."""
    return asof_lookup(asked, facts, "self", "day", all_sums(stats), last=("day",), only=F.col("status") == "completed")


def all_sums(stats: bool = True) -> dict[str, Column]:
    return {f"h_{n}": e for n, e in {**outcome_sums(), **(stat_sums() if stats else {})}.items()}
