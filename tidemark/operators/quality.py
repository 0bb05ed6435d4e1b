"""Data quality: each check is a function of the tables that returns its violations; `run` makes one report of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import similarity
from tidemark.operators.resolve import near_names, pair_key
from tidemark.session import cut, lanes

Tables = dict[str, DataFrame]


def duplicate_bouts(bouts: DataFrame) -> DataFrame:
    """Unordered pairs with several bouts on a day: pair, day, ids and statuses in id order."""
    groups = bouts.groupBy(*pair_key("red", "blue"), "day").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("bout_id", "status"))).alias("_rows")).where("n > 1")
    return groups.select("_low", "_high", "day", "n", F.col("_rows.bout_id").alias("bout_ids"), F.col("_rows.status").alias("statuses"))


def duplicate_events(events: DataFrame, *, days: int = 1, floor: float = 70.0) -> DataFrame:
    """Announced events that look like events with results under another name. Of events (event_id, name, day, source_url, page_id),
    announced ones have a page and no source, held ones a source. Returns announced_id, announced_name, announced_day, held_id,
    held_name, held_day and the score of pairs at most `days` apart whose weighted score of the names, as they are, is at least floor.
    Each distinct pair of names is scored once, and only names are compared day by day: events meet when their names are known to match."""
    announced = events.where(F.col("source_url").isNull() & F.col("page_id").isNotNull()).select("event_id", "name", "day")
    held = events.where(F.col("source_url").isNotNull()).select("event_id", "name", "day")
    near, n = near_names(announced, held, days=days), lanes(events.sparkSession)
    pairs = near.select("l_name", "r_name").distinct().repartition(n, "l_name", "r_name")
    scored = pairs.withColumn("score", F.round(similarity.weighted(F.col("l_name"), F.col("r_name"), once=True), 1)).where(F.col("score") >= floor)
    met = cut(near.join(scored, ["l_name", "r_name"]))
    # All rows of a group meet all of another one, so the result is far larger than what is joined: the groups' ids move in packs, and pairs
    # of packs are dealt over many tasks and expanded there.
    packs = lambda c: F.explode(F.sequence(F.lit(0), _packs(F.col(c)) - 1))
    each = met.withColumn("l_pack", packs("l_n")).withColumn("r_pack", packs("r_n")).drop("l_n", "r_n")
    for rows, side in ((announced, "l"), (held, "r")):
        keys = [f"{side}_{c}" for c in ("day", "name", "pack")]
        each = each.repartition(n, *keys).join(_packed(rows, side).repartition(n, *keys), keys)
    half = each.select(F.explode("l_ids").alias("announced_id"), F.col("l_name").alias("announced_name"), F.col("l_day").alias("announced_day"), "r_ids", F.col("r_name").alias("held_name"), F.col("r_day").alias("held_day"), "score")
    return half.select("announced_id", "announced_name", "announced_day", F.explode("r_ids").alias("held_id"), "held_name", "held_day", "score")


#: Ids of a pack, about: what a task holds at once of the result follows its square.
PACK = 256


def _packs(n: Column) -> Column:
    return F.ceil(n / PACK).cast("int")


def _packed(rows: DataFrame, side: str) -> DataFrame:
    """The ids of rows (event_id, name, day) that share a day and a name, in packs: day, name, pack and ids, with the side before each."""
    n = rows.groupBy("day", "name").agg(F.count("*").alias("_n"))
    dealt = rows.join(n, ["day", "name"]).withColumn("pack", F.pmod(F.xxhash64("event_id"), _packs(F.col("_n"))).cast("int"))
    return dealt.groupBy(*[F.col(c).alias(f"{side}_{c}") for c in ("day", "name", "pack")]).agg(F.collect_list("event_id").alias(f"{side}_ids"))


def broken_references(child: DataFrame, id: str, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(id, column, value) of non-null references that point nowhere. references: column -> (parent, its key)."""
    out = None
    for column, (parent, key) in references.items():
        bad = child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(F.col(id).cast("string").alias("id"), F.lit(column).alias("column"), F.col(column).cast("string").alias("value"))
        out = bad if out is None else out.unionByName(bad)
    return out


def leaked_results(bouts: DataFrame) -> DataFrame:
    """Scheduled bouts that carry a result."""
    return bouts.where((F.col("status") == "scheduled") & (F.col("winner").isNotNull() | F.col("method").isNotNull() | F.col("ending_round").isNotNull() | F.col("ending_time").isNotNull()))


def title_rounds(bouts: DataFrame) -> DataFrame:
    """Title fights without five rounds, unless the rounds are confirmed."""
    confirmed = F.coalesce(F.col("rounds_confirmed"), F.lit(False)) if "rounds_confirmed" in bouts.columns else F.lit(False)
    return bouts.where(F.col("is_title") & (F.col("scheduled_rounds") != 5) & ~confirmed)


def orphans(child: DataFrame, parent: DataFrame, on: str, key: str) -> DataFrame:
    return child.join(parent.select(F.col(key).alias(on)), on, "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """keys with change added, removed or changed, and the changed columns. Two nulls are equal."""
    rest = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.lit(1).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in rest])
    b = after.select(*keys, F.lit(1).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in rest])
    differ = F.filter(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in rest]), lambda x: x.isNotNull())
    both = a.join(b, list(keys), "full").withColumn("columns", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), differ))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size("columns") > 0, "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", "columns")


def idempotent(load: Callable[[DataFrame | None], DataFrame], *keys: str) -> DataFrame:
    """What a second run of `load` on its own result changes; empty for an idempotent one."""
    once = load(None)
    return snapshot_diff(once, load(once), *keys)


def null_rates(df: DataFrame) -> DataFrame:
    """(column, null_rate) from one pass."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return rates.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in df.columns])))


def profile(df: DataFrame) -> DataFrame:
    """(column_name, n, null_rate, least, most, mean) of every column, from one pass; least and most as text, mean of numbers alone."""
    number = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    found = df.agg(F.count("*").alias("_n"), *[f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k, f in (("z", lambda x: F.avg(x.isNull().cast("double"))), ("l", F.min), ("m", F.max))], *[F.avg(c).alias(f"a{i}") for i, c in enumerate(df.columns) if c in number])
    row = lambda i, c: F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("n"), F.col(f"z{i}").alias("null_rate"), F.col(f"l{i}").cast("string").alias("least"), F.col(f"m{i}").cast("string").alias("most"), (F.col(f"a{i}") if c in number else F.lit(None)).cast("double").alias("mean"))
    return found.select(F.inline(F.array(*[row(i, c) for i, c in enumerate(df.columns)])))


CHECKS: dict[str, Callable[[Tables], DataFrame]] = {
    "duplicate_bouts": lambda t: duplicate_bouts(t["bouts"]),
    "bout_references": lambda t: broken_references(t["bouts"], "bout_id", {c: (t["fighters"], "fighter") for c in ("red", "blue", "winner")}),
    "leaked_results": lambda t: leaked_results(t["bouts"]),
    "title_rounds": lambda t: title_rounds(t["bouts"]),
}


def run(tables: Tables, checks: dict[str, Callable[[Tables], DataFrame]] | None = None) -> DataFrame:
    """One row per check: check_name, violations, passed."""
    out = None
    for name, check in (checks or CHECKS).items():
        row = check(tables).agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations", (F.col("violations") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def require(report: DataFrame) -> None:
    """Raises if a check of a report failed (a report has one row per check)."""
    if failed := [r["check_name"] for r in report.where("not passed").collect()]:
        raise ValueError(f"failed: {', '.join(failed)}")
