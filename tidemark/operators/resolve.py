"""Entity resolution: from names and pairs to ids, with ambiguity kept visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import similarity
from tidemark.operators import names as names_index
from tidemark.session import cut


def name_lookup(names: DataFrame, *, name: str = "name", id: str = "id", overrides: DataFrame | None = None) -> DataFrame:
    """(name, id): the id of a name that one id has; null for a shared name. Overrides (name, id) come first."""
    by_name = names.groupBy(name).agg(F.when(F.countDistinct(id) == 1, F.min(id)).alias(id))
    if overrides is None:
        return by_name
    fixed = overrides.select(name, F.col(id).alias("_fixed"), F.lit(True).alias("_is"))
    return by_name.join(fixed, name, "full").select(name, F.when(F.col("_is"), F.col("_fixed")).otherwise(F.col(id)).alias(id))


def collisions(rows: DataFrame, table: DataFrame, *, name: str = "name", key: str = "weight_class") -> DataFrame:
    """rows with resolved_id from a small table (name, key, id): the entry of the row's key, or the name's entry without a key."""
    exact = table.where(F.col(key).isNotNull()).select(name, key, F.col("id").alias("_exact"))
    default = table.where(F.col(key).isNull()).select(name, F.col("id").alias("_default"))
    return rows.join(exact, [name, key], "left").join(default, name, "left").withColumn("resolved_id", F.coalesce("_exact", "_default")).drop("_exact", "_default")


def resolve_names(names: DataFrame, roster: DataFrame, aliases: DataFrame, *, threshold: float = 90.0, fold: bool = True) -> DataFrame:
    """names (name, [link]) with fighter_id, match_type and candidates.

    In order: alias of the link, alias of the name, the only roster entry of that name (exact), several entries (collision, no id), the
    best weighted score of at least `threshold` among all roster names (fuzzy; ties to the smaller id; if several entries have the name
    found, fuzzy_collision, no id), or unresolved. fold: compare names without accents and case, else as they are. Each distinct pair
    is resolved once, and only pairs that the index of names.similar lets through are scored."""
    link = F.col("link") if "link" in names.columns else F.lit(None).cast("string")
    plain = similarity.folded if fold else F.trim
    asked = names.select(F.col("name"), link.alias("link")).distinct().withColumns({"_name": plain(F.col("name")), "_link": plain(link)})
    known = roster.select(F.col("id"), plain(F.col("name")).alias("_n"))
    alias = aliases.select(plain(F.col("alias")).alias("_a"), F.col("fighter_id").alias("_aid")).groupBy("_a").agg(F.min("_aid").alias("_aid"))
    exact = known.groupBy("_n").agg(F.sort_array(F.collect_set("id")).alias("_ids"))
    staged = asked.join(alias.select(F.col("_a").alias("_link"), F.col("_aid").alias("_by_link")), "_link", "left").join(alias.select(F.col("_a").alias("_name"), F.col("_aid").alias("_by_name")), "_name", "left").join(exact.withColumnRenamed("_n", "_name"), "_name", "left")
    staged = staged.withColumn("_alias", F.coalesce("_by_link", "_by_name"))
    open_ = staged.where("_alias is null and _ids is null").select("_name").distinct()
    near = names_index.similar(open_.select(F.col("_name").alias("name")), exact.select(F.col("_n").alias("name")), threshold)
    scored = near.select(F.col("asked").alias("_name"), F.col("found").alias("_n"), F.col("score").alias("_score")).join(exact, "_n")
    best = scored.where(F.col("_score") >= threshold).groupBy("_name").agg(F.max_by("_ids", F.struct("_score", -F.col("_ids")[0])).alias("_near"))
    out = staged.join(best, "_name", "left")
    one, near_one = F.size("_ids") == 1, F.size("_near") == 1
    out = out.withColumns({
        "fighter_id": F.coalesce("_alias", F.when(one, F.col("_ids")[0]), F.when(F.col("_ids").isNull() & near_one, F.col("_near")[0])),
        "match_type": F.when(F.col("_alias").isNotNull(), "alias").when(one, "exact").when(F.col("_ids").isNotNull(), "collision").when(near_one, "fuzzy").when(F.col("_near").isNotNull(), "fuzzy_collision").otherwise("unresolved"),
        "candidates": F.coalesce("_ids", "_near", F.array().cast("array<bigint>")),
    }).select("name", "link", "fighter_id", "match_type", "candidates")
    keyed = names if "link" in names.columns else names.withColumn("link", F.lit(None).cast("string"))
    back = keyed.join(out.withColumnsRenamed({"name": "_name", "link": "_link"}), F.col("name").eqNullSafe(F.col("_name")) & F.col("link").eqNullSafe(F.col("_link")), "left")
    return back.drop("_name", "_link")


def pair_key(a: str, b: str) -> list[Column]:
    """Two columns that are equal for both orders of a pair."""
    return [F.least(a, b).alias("_low"), F.greatest(a, b).alias("_high")]


def nearest_bout(asked: DataFrame, bouts: DataFrame, *, days: int = 2) -> DataFrame:
    """asked (ask_id, a, b, day) with bout_id: of the bouts of the same unordered pair, the nearest in days, at most `days` away; the
    earlier day and the smaller id win ties. Days are matched through the 2 * days + 1 possible ones, by equality."""
    left = asked.select("ask_id", *pair_key("a", "b"), F.col("day").alias("_asked")).withColumn("_day", F.explode(F.sequence(F.date_sub("_asked", days), F.date_add("_asked", days))))
    right = bouts.select("bout_id", *pair_key("red", "blue"), F.col("day").alias("_day"))
    near = left.join(right, ["_low", "_high", "_day"]).groupBy("ask_id").agg(F.min_by("bout_id", F.struct(F.abs(F.datediff("_day", "_asked")), F.col("_day"), F.col("bout_id"))).alias("bout_id"))
    return asked.join(near, "ask_id", "left")


def candidate_pairs(asked: DataFrame, bouts: DataFrame, *, days: int = 2) -> DataFrame:
    """asked (ask_id, a_ids, b_ids arrays in order of preference, day) with bout_id, a and b: the first pair of candidates, in that order,
    that has a bout within `days`."""
    pairs = asked.select("ask_id", "day", F.posexplode("a_ids").alias("_i", "a"), "b_ids").select("ask_id", "day", "_i", "a", F.posexplode("b_ids").alias("_j", "b"))
    keyed = pairs.withColumn("ask_id", F.struct("ask_id", "_i", "_j"))
    found = nearest_bout(keyed.select("ask_id", "a", "b", "day"), bouts, days=days).where("bout_id is not null")
    first = found.groupBy(F.col("ask_id.ask_id").alias("ask_id")).agg(F.min(F.struct("ask_id._i", "ask_id._j", "bout_id")).alias("_first"))
    found = {"bout_id": F.col("_first.bout_id"), "a": F.get("a_ids", F.col("_first._i")), "b": F.get("b_ids", F.col("_first._j"))}
    return asked.join(first, "ask_id", "left").withColumns(found).drop("_first")


def names_compatible(a: Column, b: Column, floor: float = 55.0, series: str = S.SERIES) -> Column:
    """Two event names can mean one event, compared without accents and case: equal numbers of the numbered series if both have one,
    never if one has, else a token-set score from floor on. The floor is low, as days have been matched before."""
    x, y = similarity.folded(a), similarity.folded(b)
    m, n = S.event_number(x, series), S.event_number(y, series)
    return F.when(m.isNotNull() & n.isNotNull(), m == n).when(m.isNotNull() | n.isNotNull(), False).otherwise(similarity.token_set(x, y) >= floor)


def near_days(left: DataFrame, right: DataFrame, *, days: int = 1) -> DataFrame:
    """Pairs (l_*, r_*) whose days are at most `days` apart, by equality on the possible days."""
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("_day", F.explode(F.sequence(F.date_sub("l_day", days), F.date_add("l_day", days))))
    return a.join(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), F.col("_day") == F.col("r_day")).drop("_day")


def near_names(left: DataFrame, right: DataFrame, *, days: int = 1) -> DataFrame:
    """Pairs (l_day, l_name, l_n, r_day, r_name, r_n) of near days' distinct names, with how many rows have them: rows that share a day
    and a name are one group, so what is paired follows the names of a day and not its rows."""
    groups = lambda rows: rows.groupBy("day", "name").agg(F.count("*").alias("n"))
    return near_days(groups(left), groups(right), days=days)


def compatible_claims(left: DataFrame, right: DataFrame, *, days: int = 1) -> DataFrame:
    """(l_id, r_id) of rows (id, day, name) on near days with compatible names in which both sides have no other partner. Partners are
    counted by groups of a day and a name, and only rows with a single one are paired."""
    near = near_names(left, right, days=days)
    same = near.select("l_name", "r_name").distinct().where(names_compatible(F.col("l_name"), F.col("r_name")))
    met = cut(near.join(same, ["l_name", "r_name"]))

    def lone(rows: DataFrame, own: str, other: str) -> DataFrame:
        partners = met.groupBy(f"{own}_day", f"{own}_name").agg(F.sum(f"{other}_n").alias("_k"))
        named = rows.select(*[F.col(c).alias(f"{own}_{c}") for c in ("id", "day", "name")]).join(partners, [f"{own}_day", f"{own}_name"])
        return named.withColumn("_all", F.sum("_k").over(Window.partitionBy(f"{own}_id"))).where("_all = 1").drop("_k", "_all")

    alone = met.where("l_n = 1 and r_n = 1").drop("l_n", "r_n")
    return alone.join(lone(left, "l", "r"), ["l_day", "l_name"]).join(lone(right, "r", "l"), ["r_day", "r_name"]).select("l_id", "r_id")


def unique_claims(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs in which both sides have no other partner."""
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    return pairs.withColumns({"_l": n(left), "_r": n(right)}).where("_l = 1 and _r = 1").drop("_l", "_r")
