"""Queries over quality checks, mutations, resolution and text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import mutation, quality, ranged, resolve, results
from tidemark.plans import projection as P
from tidemark.plans.registry import query
from tidemark.session import lanes, shared_dir
from tidemark.sources import readers, schemas, wikitext
from tidemark.streaming import upserts

WITH = f"WITH {P.SQL}"
table = P.table


# Quality ------------------------------------------------------------------------------------------------------------------------


@query(f"""{WITH} SELECT least(red, blue) AS _low, greatest(red, blue) AS _high, day, count(*) AS n, array_to_string(list(bout_id ORDER BY bout_id), ',') AS bout_ids, array_to_string(list(status ORDER BY bout_id), ',') AS statuses FROM bout GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def dq_duplicate_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.duplicate_bouts(P.bouts(spark, sf_dir))
    return found.withColumns({"bout_ids": F.array_join(F.transform("bout_ids", lambda x: x.cast("string")), ","), "statuses": F.array_join("statuses", ",")})


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS id, 'l_orderkey' AS "column", CAST(l_orderkey AS VARCHAR) AS value FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 3) ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 7) ON s_suppkey = l_suppkey WHERE s_suppkey IS NULL""")
def dq_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = {"l_orderkey": (table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 3"), "o_orderkey"), "l_suppkey": (table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 7"), "s_suppkey")}
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return quality.broken_references(lines.withColumn("_id", F.col("l_orderkey")), "_id", references)


LEAK = "status = 'scheduled' AND (winner IS NOT NULL OR method IS NOT NULL OR ending_round IS NOT NULL OR ending_time IS NOT NULL)"


@query(f"{WITH} SELECT bout_id, method FROM bout WHERE {LEAK}")
def dq_leaked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.leaked_results(P.bouts(spark, sf_dir)).select("bout_id", "method")


@query(f"{WITH} SELECT bout_id, is_title, CAST(3 AS INT) AS scheduled_rounds FROM bout WHERE is_title AND bout_id % 16 = 0")
def dq_title_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.bouts(spark, sf_dir).withColumn("scheduled_rounds", F.when(F.col("bout_id") % 16 == 0, 3).otherwise(F.col("scheduled_rounds")))
    return quality.title_rounds(b).select("bout_id", "is_title", "scheduled_rounds")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0) ON s_suppkey = l_suppkey WHERE s_suppkey IS NULL GROUP BY 1")
def dq_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = quality.orphans(table(spark, sf_dir, "lineitem").select("l_suppkey"), table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0"), "l_suppkey", "s_suppkey")
    return lost.groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query(f"""{WITH}, c AS (SELECT 'duplicate_bouts' AS check_name, count(*) AS violations FROM (SELECT 1 FROM bout GROUP BY least(red, blue), greatest(red, blue), day HAVING count(*) > 1)
    UNION ALL SELECT 'bout_references', count(*) FROM (SELECT red AS f FROM bout UNION ALL SELECT blue FROM bout UNION ALL SELECT winner FROM bout) WHERE f % 9 = 4 UNION ALL SELECT 'leaked_results', count(*) FROM bout WHERE {LEAK} UNION ALL SELECT 'title_rounds', count(*) FROM bout WHERE is_title AND scheduled_rounds <> 5) SELECT *, violations = 0 AS passed FROM c""")
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.run({"bouts": P.bouts(spark, sf_dir), "fighters": P.fighters(spark, sf_dir).where("fighter % 9 <> 4")})


@query("""WITH a AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS bal FROM supplier WHERE s_suppkey % 11 <> 0), b AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS bal FROM supplier WHERE s_suppkey % 13 <> 0)
    SELECT s_suppkey, CASE WHEN a.s_name IS NULL THEN 'added' WHEN b.s_name IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN a.s_name IS NOT NULL AND b.s_name IS NOT NULL THEN 'bal' END AS columns
    FROM a FULL JOIN b USING (s_suppkey) WHERE a.s_name IS NULL OR b.s_name IS NULL OR a.bal IS DISTINCT FROM b.bal""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    one = lambda out, null: s.where(F.col("s_suppkey") % out != 0).select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % null != 0, F.col("s_acctbal")).alias("bal"))
    return quality.snapshot_diff(one(11, 7), one(13, 3), "s_suppkey").withColumn("columns", F.array_join("columns", ","))


@query("SELECT unnest(['dob', 'height_cm', 'stance']) AS \"column\", unnest([round(avg((dob IS NULL)::INT), 6), round(avg((height_cm IS NULL)::INT), 6), round(avg((stance IS NULL)::INT), 6)]) AS null_rate FROM (" + f"{WITH} SELECT * FROM fighter)")
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rounded(quality.null_rates(P.fighters(spark, sf_dir).select("dob", "height_cm", "stance")))


# Mutation -----------------------------------------------------------------------------------------------------------------------


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    new = c.where("c_custkey % 3 <> 0").select((F.col("c_custkey") + 100).alias("c_custkey"), "c_name", (-F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("c_nationkey") + 100).alias("c_nationkey"))
    return c, new


@query("""WITH o AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer), n AS (SELECT c_custkey + 100 AS c_custkey, c_name, -c_acctbal AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment, c_nationkey + 100 AS c_nationkey FROM customer WHERE c_custkey % 3 <> 0)
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment,
    CASE WHEN n.c_custkey IS NULL OR (o.c_custkey IS NOT NULL AND o.c_nationkey < 5) THEN o.c_nationkey ELSE n.c_nationkey END AS c_nationkey FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return mutation.upsert(old, new, ["c_custkey"], preserve=["c_name"], fill=["c_mktsegment"], guarded={"c_nationkey": F.col("old_c_nationkey") < 5})


@query("SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT c_custkey + 100, -c_acctbal FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey + 100 NOT IN (SELECT c_custkey FROM customer)")
def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return mutation.insert_missing(old.select("c_custkey", "c_acctbal"), new.select("c_custkey", "c_acctbal"), ["c_custkey"])


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(value, ts) AS value, count(*) AS n_rows, count(DISTINCT value) AS n_versions FROM events GROUP BY 1, 2")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.dedupe_last(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value"), ["user_id", "event_type"], ["ts"])


@query("SELECT p_name, min(p_partkey) AS p_partkey, 5000 + row_number() OVER (ORDER BY p_name) AS id FROM part GROUP BY p_name")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    old = spark.range(1).select(F.lit(5000).cast("long").alias("id"))
    return mutation.assign_ids(old, new, order=["p_name"]).select("p_name", "p_partkey", "id")


@query(f"{WITH}, d AS (SELECT f, min(day) AS day FROM (SELECT red AS f, day FROM bout WHERE status = 'completed' UNION ALL SELECT blue, day FROM bout WHERE status = 'completed') GROUP BY 1) SELECT fighter, CASE WHEN fighter % 2 = 0 THEN least(DATE '1992-03-01', day) ELSE day END AS debut FROM fighter LEFT JOIN d ON f = fighter")
def debut_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = P.fighters(spark, sf_dir).select("fighter", F.when(F.col("fighter") % 2 == 0, F.lit("1992-03-01").cast("date")).alias("debut"))
    return mutation.backfill_first_day(own, P.bouts(spark, sf_dir))


@query(f"""{WITH}, old AS (SELECT bout_id, bout_id // 32 AS event_id, red, blue, status FROM bout WHERE status = 'scheduled'), card AS (SELECT event_id, red, CASE WHEN bout_id % 3 = 0 THEN blue + 1000 ELSE blue END AS blue FROM old WHERE bout_id % 2 = 0),
    fresh AS (SELECT DISTINCT event_id, red, blue FROM card c WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.event_id = c.event_id AND least(o.red, o.blue) = least(c.red, c.blue) AND greatest(o.red, o.blue) = greatest(c.red, c.blue)))
    SELECT bout_id, event_id, red, blue, CASE WHEN NOT EXISTS (SELECT 1 FROM card c WHERE o.event_id = c.event_id AND least(o.red, o.blue) = least(c.red, c.blue) AND greatest(o.red, o.blue) = greatest(c.red, c.blue))
        AND EXISTS (SELECT 1 FROM fresh c WHERE c.event_id = o.event_id AND (c.red IN (o.red, o.blue) OR c.blue IN (o.red, o.blue))) THEN 'cancelled' ELSE status END AS status FROM old o
    UNION ALL SELECT NULL, event_id, red, blue, 'scheduled' FROM fresh""")
def swap_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = P.bouts(spark, sf_dir).where("status = 'scheduled'").select("bout_id", F.floor(F.col("bout_id") / 32).cast("long").alias("event_id"), "red", "blue", "status")
    card = old.where("bout_id % 2 = 0").select("event_id", "red", F.when(F.col("bout_id") % 3 == 0, F.col("blue") + 1000).otherwise(F.col("blue")).alias("blue"))
    return mutation.swap_cancel(old, card.distinct())


@query("""WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS u FROM orders), c AS (SELECT o_orderkey AS k, o_custkey * 2 AS u FROM orders WHERE o_orderkey % 2 = 0)
    SELECT r.k, coalesce(r.u, c2.u) AS u FROM r LEFT JOIN (SELECT k, min(u) AS u FROM c WHERE u NOT IN (SELECT u FROM r WHERE u IS NOT NULL) GROUP BY k) c2 ON r.k = c2.k""")
def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("u"))
    return mutation.claim(rows, o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") * 2).alias("u")), key="k", column="u")


@query("""SELECT user_id // 2 AS bout_id, user_id AS fighter, event_type AS book, max(ts) AS collected_at, arg_max(CAST(CASE WHEN event_id % 2 = 0 THEN -(100 + floor(value)) ELSE 100 + floor(value) END AS INT), (ts, event_id)) AS moneyline, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2, 3""")
def stream_dedupe_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price of each fighter and book, whole, from a stream that is merged into a table in key ranges."""
    source = f"{sf_dir}/events.parquet"
    select = lambda events: P.priced(events, "event_id").withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    merged = upserts.merged_prices(spark, f"{sf_dir}/events.parque?", spark.read.parquet(source).schema, ["bout_id", "fighter", "book"], select, order="collected_at")
    return merged.select("bout_id", "fighter", "book", F.col("collected_at").cast("timestamp_ntz").alias("collected_at"), "moneyline", "event_id")


@query("""WITH n AS (SELECT c_custkey, c_name, -c_acctbal AS c_acctbal FROM customer WHERE c_custkey BETWEEN 40 AND 60 OR c_custkey % 97 = 3 UNION ALL SELECT c_custkey + 1000000, 'new ' || c_custkey, 1.5 FROM customer WHERE c_custkey % 50 = 7)
    SELECT c_custkey, coalesce(n.c_name, c.c_name) AS c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM (SELECT c_custkey, c_name, c_acctbal FROM customer) c FULL JOIN n USING (c_custkey)""")
def ranged_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in key ranges after two merges, the second of which is the first once more."""
    path = f"{shared_dir(spark)}/ranged-{uuid.uuid4().hex}"
    c, k = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), F.col("c_custkey")
    new = c.where(k.between(40, 60) | (k % 97 == 3)).withColumn("c_acctbal", -F.col("c_acctbal")).unionByName(c.where(k % 50 == 7).select((k + 1_000_000).alias("c_custkey"), F.concat(F.lit("new "), k).alias("c_name"), F.lit(1.5).alias("c_acctbal")))
    ranged.merge(c, path, ["c_custkey"], rows=200)
    if ranged.merge(new, path, ["c_custkey"], rows=200) != ranged.merge(new, path, ["c_custkey"], rows=200):
        raise ValueError("a merge that changes nothing wrote a version")
    return ranged.read(spark, path)


@query(f"{WITH}, " + ", ".join(f"{m} AS (SELECT '{m}' AS config, CAST(CAST(year(day) AS INT) AS VARCHAR) AS fold, bout_id, self, y, round({m}{' / 2' if m == 'q' else ''}, 6) AS prob FROM pred WHERE year(day) BETWEEN 1996 AND 1998)" for m in "pqr") + " SELECT 'oof' AS run, * FROM (FROM p UNION ALL FROM q UNION ALL FROM r)")
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' predictions by year, stored part by part; the parts of one are written twice, of which the later count."""
    path, rows = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}", P.predictions(spark, sf_dir)
    for name, factor in (("p", 1.0), ("q", 1.0), ("r", 1.0), ("q", 0.5)):
        for year in (1996, 1997, 1998):
            results.put(rows.where(F.year("day") == year).select("bout_id", "self", "y", (F.col(name) * factor).alias("prob")), path, run="oof", fold=str(year), config=name)
    return P.rounded(results.get(spark, path, "oof"))


# Resolution ---------------------------------------------------------------------------------------------------------------------


@query("SELECT p_name AS name, CASE WHEN p_name = (SELECT min(p_name) FROM part) THEN -1 WHEN count(DISTINCT p_partkey) = 1 THEN min(p_partkey) END AS id FROM part GROUP BY p_name")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return resolve.name_lookup(names, overrides=names.agg(F.min("name").alias("name")).withColumn("id", F.lit(-1).cast("long")))


@query("""WITH t AS (SELECT min(p_partkey) AS id, p_name AS name, p_brand AS brand FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name, p_brand UNION ALL SELECT min(p_partkey), p_name, NULL FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name)
    SELECT p_partkey, coalesce(e.id, d.id) AS resolved_id FROM part LEFT JOIN t e ON e.name = p_name AND e.brand = p_brand LEFT JOIN t d ON d.name = p_name AND d.brand IS NULL""")
def collision_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    exact = p.where("p_partkey % 2 = 0").groupBy("name", "brand").agg(F.min("p_partkey").alias("id"))
    default = p.where("p_partkey % 3 = 0").groupBy("name").agg(F.min("p_partkey").alias("id")).withColumn("brand", F.lit(None).cast("string"))
    return resolve.collisions(p, exact.unionByName(default), key="brand").select("p_partkey", "resolved_id")


NEAR = """a AS (SELECT bout_id AS ask_id, blue AS a, red AS b, day + CAST(bout_id % 5 AS INT) - 2 AS day FROM bout)"""


@query(f"""{WITH}, {NEAR} SELECT ask_id, (SELECT arg_min(bout_id, (abs(b.day - a.day), b.day, b.bout_id)) FROM bout b WHERE least(b.red, b.blue) = least(a.a, a.b) AND greatest(b.red, b.blue) = greatest(a.a, a.b) AND abs(b.day - a.day) <= 1) AS bout_id FROM a""")
def pair_nearest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.bouts(spark, sf_dir)
    asked = b.select(F.col("bout_id").alias("ask_id"), F.col("blue").alias("a"), F.col("red").alias("b"), F.date_add("day", (F.col("bout_id") % 5 - 2).cast("int")).alias("day"))
    return resolve.nearest_bout(asked, b, days=1).select("ask_id", "bout_id")


@query(f"""{WITH}, ask AS (SELECT bout_id AS ask_id, [red + 1, red] AS x, [blue, blue + 1] AS y, day FROM bout),
    c AS (SELECT ask_id, i, j, x[i] AS a, y[j] AS b, day FROM ask, range(1, 3) t(i), range(1, 3) u(j)),
    m AS (SELECT c.ask_id, i, j, arg_min(bout.bout_id, (abs(bout.day - c.day), bout.day, bout.bout_id)) AS bout_id FROM c JOIN bout ON least(red, blue) = least(a, b) AND greatest(red, blue) = greatest(a, b) AND abs(bout.day - c.day) <= 2 GROUP BY 1, 2, 3)
    SELECT ask_id, (SELECT arg_min(bout_id, (i, j)) FROM m WHERE m.ask_id = ask.ask_id) AS bout_id FROM ask""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.bouts(spark, sf_dir)
    asked = b.select(F.col("bout_id").alias("ask_id"), F.array(F.col("red") + 1, F.col("red")).alias("a_ids"), F.array(F.col("blue"), F.col("blue") + 1).alias("b_ids"), "day")
    return resolve.candidate_pairs(asked, b).select("ask_id", "bout_id")


@query("""SELECT CASE WHEN k % 50 = 1 THEN upper(substr(m, 1, 7)) || '  ' || substr(m, 9, 8) WHEN k % 50 = 2 THEN 'Alias No ' || k WHEN k % 50 = 3 THEN 'nobody zz' || k ELSE substr(m, 1, 8) || ' ' || substr(m, 9, 8) END AS name,
    CASE WHEN k % 50 <> 3 THEN k END AS fighter_id, CASE k % 50 WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'alias' WHEN 3 THEN 'unresolved' ELSE 'exact' END AS match_type FROM (SELECT c_custkey AS k, md5(c_name) AS m FROM customer)""")
def fuzzy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("c_custkey"), F.md5(F.col("c_name").cast("binary"))
    name = F.concat(F.substring(m, 1, 8), F.lit(" "), F.substring(m, 9, 8))
    c = table(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name"))
    worn = F.concat(F.upper(F.substring("name", 1, 7)), F.lit("  "), F.substring("name", 10, 8))
    asked = c.select(F.when(F.col("id") % 50 == 1, worn).when(F.col("id") % 50 == 2, F.concat(F.lit("Alias No "), F.col("id"))).when(F.col("id") % 50 == 3, F.concat(F.lit("nobody zz"), F.col("id"))).otherwise(F.col("name")).alias("name"))
    aliases = c.select(F.concat(F.lit("alias no "), F.col("id")).alias("alias"), F.col("id").alias("fighter_id"))
    return resolve.resolve_names(asked, c, aliases, threshold=80.0).select("name", F.col("fighter_id").cast("long").alias("fighter_id"), "match_type")


# Text ---------------------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, round((p_size % 7 + 1) * 30.48 + (p_size % 12) * 2.54, 1) AS height, round(p_size * 2.54, 1) AS reach, CAST(p_size AS INT) AS landed, CAST(p_size + 3 AS INT) AS attempted, CAST((p_size % 6) * 60 + p_size AS INT) AS clock, CAST(p_size AS INT) AS round, CAST(5 AS INT) AS rounds, 'red' AS side, lower(substr(p_name, 1, 3)) AS stance FROM part""")
def parse_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size")
    text = table(spark, sf_dir, "part").select("p_partkey", F.concat(z % 7 + 1, F.lit("' "), z % 12, F.lit('"')).alias("h"), F.concat(z, F.lit('"')).alias("r"), F.concat(z, F.lit(" of "), z + 3).alias("x"), F.concat(z % 6, F.lit(":"), F.lpad(z.cast("string"), 2, "0")).alias("c"), F.concat(F.lit("Round "), z).alias("n"), F.substring("p_name", 1, 3).alias("s"))
    return text.select("p_partkey", S.height_cm("h").alias("height"), S.reach_cm("r").alias("reach"), S.landed("x").alias("landed"), S.attempted("x").alias("attempted"), S.clock_seconds("c").alias("clock"), S.round_number("n").alias("round"), S.scheduled_rounds(F.lit("5 Rnd (5-5-5-5-5)")).alias("rounds"), S.winner_side(F.lit("W/L")).alias("side"), S.stance("s").alias("stance"))


@query("""SELECT 'at ' || event_id AS commence_time, 'home ' || user_id AS home, 'away ' || (user_id + i) AS away, event_type AS book, CAST(event_id * 3 AS VARCHAR) AS last_update, 'fighter ' || (user_id + j) AS name, CAST(event_id % 900 + 100 * j AS INT) AS moneyline
    FROM events, range(2) t(i), range(2) u(j) WHERE event_type <> 'click'""")
def json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, user = F.col("event_id"), F.col("user_id")
    text = lambda prefix, c: F.concat(F.lit(prefix), c)
    outcome = lambda j: F.struct(text("fighter ", user + j).alias("name"), (e % 900 + 100 * j).cast("double").alias("price"))
    market = lambda key: F.struct(key.alias("key"), (e * 3).cast("string").alias("last_update"), F.array(outcome(0), outcome(1)).alias("outcomes"))
    kind = F.when(F.col("event_type") == "click", "totals").otherwise("h2h")
    offer = lambda i: F.struct(text("at ", e).alias("commence_time"), text("home ", user).alias("home_team"), text("away ", user + i).alias("away_team"), F.array(F.struct(F.col("event_type").alias("title"), F.array(market(kind), market(F.lit("spreads"))).alias("markets"))).alias("bookmakers"))
    documents = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.array(offer(0), offer(1)).alias("data"))).alias("j"))
    return readers.flatten_odds(documents.select(F.from_json("j", schemas.ODDS).alias("d")).select("d.data"))


@query("""SELECT o_orderkey AS page_id, CAST(i * 2 + 1 AS INT) AS position, ['Main card', 'Early prelims'][i + 1] AS card_tier, ['Lightweight', 'Women''s Flyweight'][i + 1] AS weight_class, ['Ann ' || o_orderkey, 'Cho'][i + 1] AS red, ['Ann (fighter ' || o_orderkey || ')', NULL][i + 1] AS red_link,
    i = 0 AND o_orderkey % 2 = 0 AS red_champion, ['def.', 'vs.'][i + 1] AS connector, ['Bo', 'Dee ' || o_custkey][i + 1] AS blue, [NULL, 'Dee ' || o_custkey][i + 1] AS blue_link, ['Decision', ''][i + 1] AS method FROM orders, range(2) t(i)""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts of wiki cards, each under the tier of the last header before it."""
    k = F.col("o_orderkey")
    champion = F.when(k % 2 == 0, " (c)").otherwise("")
    text = F.concat(F.lit("Intro.\n{{MMAevent card|Main card}}\n{{MMAevent bout|Lightweight|[[Ann (fighter "), k, F.lit(")|Ann "), k, F.lit("]]"), champion, F.lit("|def.|Bo|Decision|3|5:00|}}\n{{MMAevent card|''Early'' prelims}}\n{{MMAevent bout|Women's Flyweight|Cho|vs.|[[Dee "), F.col("o_custkey"), F.lit("]]||||}}\n{{End}}"))
    cards = wikitext.fight_cards(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(lanes(spark)).select(k.alias("page_id"), text.alias("text")))
    return cards.select("page_id", "position", "card_tier", "weight_class", "red", "red_link", "red_champion", "connector", "blue", "blue_link", "method")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]*lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a href=')) AS links FROM pages""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '(?i)<html[^>]*lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%#00000001%' OR c_mktsegment IN ('BUILDING') ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def find_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.where(F.col("c_name").ilike("%#00000001%") | F.col("c_mktsegment").isin("BUILDING")).orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_name")


# Raw files ----------------------------------------------------------------------------------------------------------------------


def _text(df: DataFrame, ddl: str, **values) -> DataFrame:
    """A raw table: the named columns of the layout, all others null."""
    names = [x.rsplit(" ", 1)[0].strip("`") for x in ddl.split(", ")]
    return df.select(*[values.get(n, F.lit(None)).cast("string").alias(n) for n in names])


@query("""SELECT 'Event ' || o_orderkey AS name, 'http://e/' || o_orderkey AS source_url, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS event_date, 'Town ' || o_orderstatus AS location FROM orders""")
def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.when(k % 7 == 0, "--").when(k % 7 == 1, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "MMMM dd, yyyy"))
    return readers.parse_events(_text(table(spark, sf_dir, "orders"), readers.EVENTS, EVENT=F.concat(F.lit(" Event "), k, F.lit(" ")), URL=F.concat(F.lit("http://e/"), k), DATE=day, LOCATION=F.concat(F.lit("Town "), "o_orderstatus")))


@query("""SELECT c_mktsegment || ' ' || c_name AS real_name, CASE WHEN c_custkey % 3 <> 0 THEN 'Nick' || c_custkey END AS nickname, 'http://f/' || c_custkey AS source_url FROM customer""")
def raw_fighters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return readers.parse_fighter_details(_text(table(spark, sf_dir, "customer"), readers.DETAILS, FIRST=F.concat("c_mktsegment", F.lit(" ")), LAST=F.col("c_name"), NICKNAME=F.when(k % 3 == 0, "--").otherwise(F.concat(F.lit(" Nick"), k)), URL=F.concat(F.lit("http://f/"), k)))


@query("""SELECT 'http://f/' || o_orderkey AS source_url, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(round(((o_orderkey % 3 + 4) * 12 + o_orderkey % 12) * 2.54, 1) AS DECIMAL(4, 1)) END AS height_cm, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(round((o_orderkey % 30 + 55) * 2.54, 1) AS DECIMAL(4, 1)) END AS reach_cm,
    CASE WHEN o_orderkey % 6 <> 0 THEN 'southpaw' END AS stance, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS dob FROM orders""")
def raw_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    known = lambda n, c: F.when(k % n == 0, "--").otherwise(c)
    return readers.parse_tale_of_the_tape(_text(table(spark, sf_dir, "orders"), readers.TOTT, URL=F.concat(F.lit("http://f/"), k), HEIGHT=known(4, F.concat(k % 3 + 4, F.lit("' "), k % 12, F.lit('"'))), REACH=known(5, F.concat(k % 30 + 55, F.lit('"'))), STANCE=known(6, F.lit("Southpaw")), DOB=known(7, F.date_format("o_orderdate", "MMM d, yyyy"))))


#: Pairs of a raw statistics row, and what is added to its landed number in each.
_PAIRS = {c: (n, i) for i, (c, n) in enumerate(readers.PAIRS.items()) if c != "TD"}
_PAIR_SQL = ", ".join(f"CAST(l_partkey % 50 + {i} AS INT) AS {readers.PAIRS[c]}_landed, CAST(l_partkey % 50 + {i} + 4 AS INT) AS {readers.PAIRS[c]}_attempted" for c, (_, i) in _PAIRS.items())


@query(f"""SELECT 'E' || l_orderkey AS event, 'x' AS bout, 'S' || l_suppkey AS fighter, CAST(l_linenumber AS INT) AS round_number, CAST(l_partkey % 3 AS INT) AS knockdowns, {_PAIR_SQL}, CAST(NULL AS INT) AS {readers.PAIRS["TD"]}_landed, CAST(NULL AS INT) AS {readers.PAIRS["TD"]}_attempted,
    CASE WHEN l_partkey % 6 <> 0 THEN CAST(l_partkey % 7 AS INT) END AS sub_attempts, CAST(l_partkey % 2 AS INT) AS reversals, CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_partkey % 5 * 60 + l_partkey % 60 AS INT) END AS control_time_seconds FROM lineitem WHERE l_suppkey % 9 <> 0""")
def raw_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    clock = F.when(p % 4 == 0, "--").otherwise(F.concat(p % 5, F.lit(":"), F.lpad((p % 60).cast("string"), 2, "0")))
    pairs = {c: F.concat(p % 50 + i, F.lit(" of "), p % 50 + i + 4) for c, (_, i) in _PAIRS.items()}
    raw = _text(table(spark, sf_dir, "lineitem"), readers.STATS, EVENT=F.concat(F.lit("E"), "l_orderkey"), BOUT=F.lit("x"), ROUND=F.concat(F.lit("Round "), "l_linenumber"), FIGHTER=F.when(F.col("l_suppkey") % 9 != 0, F.concat(F.lit("S"), "l_suppkey")), KD=F.concat(p % 3, F.lit(".0")), TD=F.lit("---"), CTRL=clock, **{"SUB.ATT": F.when(p % 6 != 0, p % 7), "REV.": F.concat(p % 2, F.lit(".0"))}, **pairs)
    return readers.parse_fight_stats(raw)


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, round(avg(({x} IS NULL)::INT), 6) AS null_rate, CAST(min({x}) AS VARCHAR) AS least, CAST(max({x}) AS VARCHAR) AS most, {f'round(avg({x}), 4)' if m else 'NULL::DOUBLE'} AS mean FROM customer" for c, x, m in (("c_custkey", "c_custkey", True), ("c_name", "c_name", False), ("c_nationkey", "nullif(c_nationkey, 3)", True), ("c_mktsegment", "nullif(c_mktsegment, 'BUILDING')", False))))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table's columns are like, from one pass."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return P.rounded(quality.profile(c)).withColumn("mean", F.round("mean", 4))


SHOWS = ("Contender Series 9", "ROAD to UFC 3", "Road to Glory", "Fight Night 7", "The Ultimate Fighter Finale")
FORMATS = ("3 Rnd (5-5-5)", "5 Rnd (5-5-5-5-5)", "2 Rnd (5-5)", "No Time Limit")


@query(f"""WITH r AS (SELECT o_orderkey AS k, {list(SHOWS)}[o_orderkey % 5 + 1] AS event, o_orderkey // 5 % 4 AS f, o_orderkey % 6 AS w FROM orders)
    SELECT event, 'A' || k || ' vs. B' || k AS bout, 'A' || k AS red, 'B' || k AS blue, ['red', 'blue', NULL, 'red', 'blue', NULL][w + 1] AS winner_side, k % 4 < 2 AS is_title_fight, CAST(CASE f WHEN 0 THEN 3 ELSE 5 END AS INT) AS scheduled_rounds, 'KO/TKO' AS method, CAST(k % 3 + 1 AS INT) AS ending_round
    FROM r WHERE f < 2 AND event NOT ILIKE '%road to ufc%'""")
def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    values = {"EVENT": P.pick(k % 5, SHOWS), "BOUT": F.concat(F.lit("A"), k, F.lit(" vs. B"), k), "OUTCOME": P.pick(k % 6, ("W/L", " L/W ", "NC/NC", "W/NC", "NC/W", "D/D")), "WEIGHTCLASS": P.pick(k % 4, ("UFC Lightweight Title Bout", "Lightweight CHAMPIONSHIP Bout", "Lightweight Bout", "Interim Lightweight")), "METHOD": F.lit("KO/TKO "), "ROUND": k % 3 + 1, "TIME": F.lit("1:05"), "TIME FORMAT": P.pick(F.floor(k / 5) % 4, FORMATS)}
    return readers.parse_fight_results(_text(table(spark, sf_dir, "orders"), readers.RESULTS, **values)).select("event", "bout", "red", "blue", "winner_side", "is_title_fight", "scheduled_rounds", "method", "ending_round")
