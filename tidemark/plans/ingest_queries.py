"""Queries over the building of tables from raw rows and over offers resolved to bouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation, ingest, odds, quality
from tidemark.plans import projection as P
from tidemark.plans.evaluation_queries import _metrics_sql
from tidemark.plans.registry import query
from tidemark.sources import schemas

WITH = f"WITH {P.SQL}"
table = P.table


# Tables from raw rows -----------------------------------------------------------------------------------------------------------
#
# Fighters 10k and 10k + 1 have one name; a spelling "Mis k" stands for some; names of even tens are told apart by class.

BUILT = f"""{WITH}, who AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 < 2 THEN 'Twin ' || (s_suppkey // 10) ELSE 'Name ' || s_suppkey END AS name FROM supplier),
alone AS (SELECT name, min(id) AS id FROM who GROUP BY 1 HAVING count(*) = 1),
names AS (SELECT * FROM alone UNION ALL SELECT 'Mis ' || who.id, alone.id FROM who JOIN alone USING (name) WHERE who.id % 7 = 3),
tens AS (SELECT DISTINCT s_suppkey // 10 AS k FROM supplier),
shared AS (SELECT 'Twin ' || k AS name, 'Lightweight' AS cls, 10 * k AS id FROM tens WHERE k % 2 = 0 UNION ALL SELECT 'Twin ' || k, NULL, 10 * k + 1 FROM tens WHERE k % 3 = 0),
raw AS (SELECT *, bout_id AS n, bout_id % 100 AS e, CASE WHEN bout_id % 3 = 0 THEN 'Lightweight' ELSE 'Heavyweight' END AS cls FROM bout),
mine AS (SELECT n, side, k, cls, CASE WHEN k % 7 = 3 AND n % 2 = 0 THEN 'Mis ' || k WHEN k % 10 < 2 THEN 'Twin ' || (k // 10) ELSE 'Name ' || k END AS called FROM (SELECT n, cls, 'red' AS side, red AS k FROM raw UNION ALL SELECT n, cls, 'blue', blue FROM raw)),
ids AS (SELECT n, side, k, called, coalesce((SELECT id FROM shared s WHERE s.name = called AND s.cls = mine.cls), (SELECT id FROM shared s WHERE s.name = called AND s.cls IS NULL), (SELECT id FROM names WHERE names.name = called)) AS id FROM mine),
corners AS (SELECT n, max(id) FILTER (side = 'red') AS red_id, max(id) FILTER (side = 'blue') AS blue_id FROM ids GROUP BY 1),
event AS (SELECT e, max(id) AS event_id FROM (SELECT o_orderkey % 100 AS e, o_orderkey % 100 AS id FROM orders UNION ALL SELECT o_orderkey % 100, o_orderkey % 100 + 1000 FROM orders WHERE o_orderkey % 10 = 0) WHERE e < 95 GROUP BY 1),
built AS (SELECT n, cls, red, blue, winner, corners.red_id, corners.blue_id, event_id, red_id IS NOT NULL AND blue_id IS NOT NULL AND event_id IS NOT NULL AS whole FROM raw JOIN corners USING (n) LEFT JOIN event USING (e)),
numbered AS (SELECT *, row_number() OVER (ORDER BY n) AS bout_id FROM built WHERE whole)"""


def _called(k: Column, n: Column) -> Column:
    own = F.when(k % 10 < 2, F.concat(F.lit("Twin "), F.floor(k / 10).cast("long"))).otherwise(F.concat(F.lit("Name "), k))
    return F.when((k % 7 == 3) & (n % 2 == 0), F.concat(F.lit("Mis "), k)).otherwise(own)


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parsed results and events, names of fighters, shared names."""
    b, n = P.bouts(spark, sf_dir), F.col("bout_id")
    winner = F.when(F.col("winner") == F.col("red"), "red").when(F.col("winner") == F.col("blue"), "blue")
    results = b.select(F.concat(F.lit("Event "), n % 100).alias("event"), F.concat(F.lit("Bout "), n).alias("bout"), _called(F.col("red"), n).alias("red"), _called(F.col("blue"), n).alias("blue"), winner.alias("winner_side"), F.when(n % 3 == 0, "Lightweight").otherwise("Heavyweight").alias("weight_class"), F.lpad(n.cast("string"), 12, "0").alias("source_url"))
    e = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("e")).distinct().where("e < 95")
    event = lambda rows, more: rows.select(F.concat(F.lit("Event "), "e").alias("name"), (F.col("e") + more).alias("event_id"))
    k = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    fighters = suppliers.select(k.alias("fighter_id"), _called(k, F.lit(1)).alias("real_name"))
    corrections = suppliers.where(k % 7 == 3).select(_called(k, F.lit(0)).alias("wrong"), _called(k, F.lit(1)).alias("right"))
    tens = suppliers.select(F.floor(k / 10).cast("long").alias("k")).distinct()
    shared = lambda every, cls, more: tens.where(F.col("k") % every == 0).select(F.concat(F.lit("Twin "), "k").alias("name"), F.lit(cls).cast("string").alias("weight_class"), (10 * F.col("k") + more).alias("id"))
    return results, event(e, 0).unionByName(event(e.where("e % 10 = 0"), 1000)), ingest.fighter_names(fighters, corrections), shared(2, "Lightweight", 0).unionByName(shared(3, None, 1))


@query(f"{BUILT} SELECT bout_id, lpad(CAST(n AS VARCHAR), 12, '0') AS source_url, event_id, red_id, blue_id, CASE winner WHEN red THEN red_id WHEN blue THEN blue_id END AS winner_id, cls AS weight_class FROM numbered")
def built_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, events, names, shared = _raw(spark, sf_dir)
    return ingest.build_bouts(results, events, names, shared)[0].select("bout_id", "source_url", "event_id", "red_id", "blue_id", "winner_id", "weight_class")


@query(f"{BUILT} SELECT lpad(CAST(n AS VARCHAR), 12, '0') AS source_url, event_id, red_id, blue_id FROM built WHERE NOT whole")
def rejected_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, events, names, shared = _raw(spark, sf_dir)
    return ingest.build_bouts(results, events, names, shared)[1].select("source_url", "event_id", "red_id", "blue_id")


@query(f"{BUILT} SELECT numbered.bout_id, ids.id AS fighter_id, CAST(r.round AS INT) AS round_number, r.knockdowns FROM numbered JOIN ids USING (n) JOIN rounds r ON r.bout_id = n AND r.fighter = k")
def built_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, events, names, shared = _raw(spark, sf_dir)
    n = F.col("bout_id")
    stats = P.rounds(spark, sf_dir).select(F.concat(F.lit("Event "), n % 100).alias("event"), F.concat(F.lit("Bout "), n).alias("bout"), _called(F.col("fighter"), n).alias("fighter"), F.col("round").cast("int").alias("round_number"), "knockdowns")
    return ingest.build_stats(stats, ingest.build_bouts(results, events, names, shared)[0], names, shared)[0].select("bout_id", "fighter_id", "round_number", "knockdowns")


@query("SELECT o_orderkey, o_custkey, c_nationkey AS id, CASE WHEN c_nationkey IS NULL THEN 'no id for ' || o_custkey END AS error FROM orders LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 4 <> 1) ON c_custkey = o_custkey")
def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("id"))
    return ingest.attach_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-06-06' ORDER BY day DESC, o_orderkey LIMIT 25")
def target_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return ingest.since(days, "1997-06-06", id="o_orderkey", limit=25)


# Offers -------------------------------------------------------------------------------------------------------------------------
#
# Names are hashes; a fighter's last digit says how offers call it: 2 misspelt, 3 by an alias, 4 unknown, 0 and 1 by a shared name, which
# is misspelt for 0 in odd bouts.


def _hash_sql(k: str) -> str:
    m = f"md5('f' || CASE WHEN {k} % 10 < 2 THEN {k} // 10 * 10 ELSE {k} END)"
    return f"(substr({m}, 1, 8) || ' ' || substr({m}, 9, 8))"


def _offered_sql(k: str, n: str) -> str:
    return f"CASE WHEN {k} % 10 = 2 OR ({k} % 10 = 0 AND {n} % 2 = 1) THEN substr({_hash_sql(k)}, 2) WHEN {k} % 10 = 3 THEN 'Alias ' || {k} WHEN {k} % 10 = 4 THEN 'Nobody zz ' || {k} ELSE {_hash_sql(k)} END"


OFFERS = f"""{WITH}, ask AS (SELECT bout_id AS n, day + CAST(bout_id % 7 AS INT) - 3 AS d, blue AS h, red AS a, {_offered_sql("blue", "bout_id")} AS home, {_offered_sql("red", "bout_id")} AS away FROM bout),
cand AS (SELECT s.s_suppkey AS k, t.s_suppkey AS id, row_number() OVER (PARTITION BY s.s_suppkey ORDER BY t.s_suppkey) AS i FROM supplier s JOIN supplier t ON s.s_suppkey = t.s_suppkey OR (s.s_suppkey % 10 < 2 AND t.s_suppkey % 10 < 2 AND s.s_suppkey // 10 = t.s_suppkey // 10) WHERE s.s_suppkey % 10 <> 4),
met AS (SELECT ask.n, x.i, y.i AS j, x.id AS hid, y.id AS aid, arg_min(b.bout_id, (abs(b.day - d), b.day, b.bout_id)) AS bid FROM ask JOIN cand x ON x.k = h JOIN cand y ON y.k = a JOIN bout b ON least(b.red, b.blue) = least(x.id, y.id) AND greatest(b.red, b.blue) = greatest(x.id, y.id) AND abs(b.day - d) <= 2 GROUP BY 1, 2, 3, 4, 5),
hit AS (SELECT n, hid, aid, bid FROM met QUALIFY row_number() OVER (PARTITION BY n ORDER BY i, j) = 1),
ready AS (SELECT ask.*, hid, aid, bid FROM ask LEFT JOIN hit USING (n))"""


def _offers(spark: SparkSession, sf_dir: str):
    b, n = P.bouts(spark, sf_dir), F.col("bout_id")

    def name(k: Column) -> Column:
        m = F.md5(F.concat(F.lit("f"), F.when(k % 10 < 2, F.floor(k / 10).cast("long") * 10).otherwise(k)).cast("binary"))
        return F.concat(F.substring(m, 1, 8), F.lit(" "), F.substring(m, 9, 8))

    def offered(k: Column) -> Column:
        return F.when((k % 10 == 2) | ((k % 10 == 0) & (n % 2 == 1)), F.substring(name(k), 2, 99)).when(k % 10 == 3, F.concat(F.lit("Alias "), k)).when(k % 10 == 4, F.concat(F.lit("Nobody zz "), k)).otherwise(name(k))

    at = F.concat(F.date_add("day", (n % 7 - 3).cast("int")).cast("string"), F.lit("T20:00:00Z"))
    home, away = offered(F.col("blue")), offered(F.col("red"))
    outcomes = F.array(F.struct(home.alias("name"), (n % 300 + 100).cast("double").alias("price")), F.struct(away.alias("name"), (-(n % 300) - 100).cast("double").alias("price")), F.struct(F.lit("Draw").alias("name"), F.lit(900.0).alias("price")))
    market = F.struct(F.lit("h2h").alias("key"), F.concat(F.lit("t"), n).alias("last_update"), outcomes.alias("outcomes"))
    entry = F.struct(at.alias("commence_time"), home.alias("home_team"), away.alias("away_team"), F.array(F.struct(F.lit("Book").alias("title"), F.array(market).alias("markets"))).alias("bookmakers"))
    docs = b.select(F.to_json(F.struct(F.array(entry).alias("data"))).alias("j")).select(F.from_json("j", schemas.ODDS).alias("d")).select("d.data")
    k = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    aliases = suppliers.where(k % 10 == 3).select(F.concat(F.lit("Alias "), k).alias("alias"), k.alias("fighter_id"))
    return odds.resolve_prices(docs, suppliers.select(k.alias("id"), name(k).alias("name")), aliases, b)


@query(f"""{OFFERS}, offered AS (SELECT *, home AS name, n % 300 + 100 AS moneyline FROM ready UNION ALL SELECT *, away, -(n % 300) - 100 FROM ready)
    SELECT bid AS bout_id, CASE WHEN name = away THEN aid ELSE hid END AS fighter, 'Book' AS book, CAST(moneyline AS INT) AS moneyline, round(CASE WHEN moneyline < 0 THEN -moneyline / (100.0 - moneyline) ELSE 100.0 / (100.0 + moneyline) END, 6) AS implied_prob, 't' || n AS collected_at FROM offered WHERE bid IS NOT NULL""")
def offers_to_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(_offers(spark, sf_dir)[0])


@query(f"{OFFERS} SELECT DISTINCT hid AS fighter_id, home AS alias FROM ready WHERE bid IS NOT NULL AND h % 10 = 2 UNION SELECT DISTINCT aid, away FROM ready WHERE bid IS NOT NULL AND a % 10 = 2")
def offer_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir)[1]


@query(f"{OFFERS} SELECT DISTINCT CAST(d AS VARCHAR) || 'T20:00:00Z' AS commence_time, home, away, h % 10 <> 4 AS home_resolved, a % 10 <> 4 AS away_resolved FROM ready WHERE bid IS NULL")
def offers_without_bout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir)[2]


# Checks and baselines -----------------------------------------------------------------------------------------------------------


@query(f"""{WITH}, rates AS (SELECT corner, avg(y) AS rate FROM pred WHERE day < DATE '1996-01-01' GROUP BY 1), held AS (SELECT y, rate FROM pred JOIN rates USING (corner) WHERE day >= DATE '1996-01-01'), {_metrics_sql("held", "y", "rate")}""")
def corner_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.predictions(spark, sf_dir)
    return P.rounded(evaluation.corner_baseline(p.where("day < '1996-01-01'"), p.where("day >= '1996-01-01'"), "y"))


@query("""WITH g AS (SELECT p_size % 5 AS k_new, p_partkey % 4 AS scale, round(avg(p_retailprice), 6) AS log_loss FROM part GROUP BY 1, 2)
    SELECT *, k_new IN (0, 4) AS k_new_on_edge, scale IN (0, 3) AS scale_on_edge FROM g ORDER BY log_loss, k_new, scale LIMIT 10""")
def top_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 5).alias("k_new"), (F.col("p_partkey") % 4).alias("scale")).agg(F.round(F.avg("p_retailprice"), 6).alias("log_loss"))
    return evaluation.top_configs(scores, "log_loss", ["k_new", "scale"])
