"""Queries over names: scores, similar names, resolution over a whole roster, events of two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import similarity
from tidemark.operators import names, quality, resolve
from tidemark.plans import name_sql
from tidemark.plans import projection as P
from tidemark.plans.registry import query

_FOLD = r"trim(regexp_replace(lower(strip_accents({})), '\s+', ' ', 'g'))"

#: Event names, the number's place marked; some are of the numbered series, others hold numbers too.
EVENT_NAMES = ("UFC #", "UFC#: Abe vs. Bo", "UFC Fight Night #", "UFC on ESPN #: Abe vs. Bo", "Gála: Àbe vs. Bô", "gala:  abe vs. bo #", "Fair of Yu", "Ufc Fight Night: Cy vs. Di")


@query(rf"""WITH RECURSIVE e AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, replace({list(EVENT_NAMES)}[o_orderkey // 2 % 8 + 1], '#', CAST(o_orderkey // 16 % 3 AS VARCHAR)) AS name FROM orders WHERE o_custkey % 3 <> 0),
    f AS (SELECT *, {_FOLD.format("name")} AS t FROM e), g AS (SELECT *, regexp_extract(t, '\bufc\s*([0-9]{{1,4}})\b', 1) AS n FROM f),
    near AS (SELECT l.id AS l_id, r.id AS r_id, l.t AS x, r.t AS y, l.n AS m, r.n AS n FROM g l JOIN g r ON l.id % 2 = 0 AND r.id % 2 = 1 AND abs(l.day - r.day) <= 1), pairs AS (SELECT DISTINCT x, y FROM near WHERE m = '' AND n = ''), {name_sql.scored("pairs")},
    p AS (SELECT l_id, r_id FROM near LEFT JOIN scored USING (x, y) WHERE CASE WHEN m <> '' AND n <> '' THEN m = n WHEN m <> '' OR n <> '' THEN false ELSE common >= 55 END),
    lone AS (SELECT l_id FROM p GROUP BY 1 HAVING count(*) = 1), lonely AS (SELECT r_id FROM p GROUP BY 1 HAVING count(*) = 1) SELECT * FROM p WHERE l_id IN (FROM lone) AND r_id IN (FROM lonely)""")
def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two sources that claim each other alone: numbered events, nights with numbers, accents and case. The name of an order's
    event follows from its key; orders of some customers have none."""
    k = F.col("o_orderkey")
    name = F.replace(P.pick(F.floor(k / 2) % 8, EVENT_NAMES), F.lit("#"), (F.floor(k / 16) % 3).cast("string"))
    e = P.table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select(k.alias("id"), F.col("o_orderdate").cast("date").alias("day"), name.alias("name"))
    return resolve.compatible_claims(e.where("id % 2 = 0"), e.where("id % 2 = 1"))


#: Suppliers' made-up names.
FIRST, LAST = ("Ana", "João", "Li", "Khalil", "Muhammad", "Jo"), ("Silva", "da Silva", "Rountree Jr.", "Nurmagomedov", "Souza Santos", "Weili", "Jonathan Jo")
#: What offers make of them: as it is, words swapped, a wrong initial of the second word, a letter less, the second word alone, more words.
SUPPLIERS = f"""roster AS (SELECT k AS id, {list(FIRST)}[k % 6 + 1] || ' ' || {list(LAST)}[k // 6 % 7 + 1] || CASE WHEN k >= 42 THEN ' ' || substr(md5(CAST(k AS VARCHAR)), 1, 4) ELSE '' END AS name FROM (SELECT s_suppkey AS k FROM supplier)),
    offer AS (SELECT id, CASE id % 6 WHEN 0 THEN name WHEN 1 THEN split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1) WHEN 2 THEN regexp_replace(name, '^([^ ]*) .', '\\1 Q') WHEN 3 THEN substr(name, 1, 4) || substr(name, 6) WHEN 4 THEN split_part(name, ' ', 2) ELSE upper(name) || ' 2' END AS name FROM roster)"""


def _offers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(roster, offers) of (id, name), as SUPPLIERS says."""
    k, n = F.col("id"), F.col("name")
    name = F.concat(P.pick(k % 6, FIRST), F.lit(" "), P.pick(F.floor(k / 6) % 7, LAST), F.when(k >= 42, F.concat(F.lit(" "), F.substring(F.md5(k.cast("string").cast("binary")), 1, 4))).otherwise(""))
    roster = P.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).withColumn("name", name)
    word = lambda i: F.split_part(n, F.lit(" "), F.lit(i))
    spelt = F.when(k % 6 == 0, n).when(k % 6 == 1, F.concat(word(2), F.lit(" "), word(1))).when(k % 6 == 2, F.regexp_replace(n, "^([^ ]*) .", "$1 Q")).when(k % 6 == 3, F.concat(F.substring(n, 1, 4), F.substring(n, 6, 99))).when(k % 6 == 4, word(2)).otherwise(F.concat(F.upper(n), F.lit(" 2")))
    return roster, roster.select("id", spelt.alias("name"))


@query(f"""WITH RECURSIVE {SUPPLIERS}, a AS (SELECT DISTINCT {_FOLD.format("name")} AS x FROM offer), b AS (SELECT DISTINCT {_FOLD.format("name")} AS y FROM roster), pairs AS (SELECT x, y FROM a, b), {name_sql.scored("pairs")}
    SELECT x AS asked, y AS found, round(weighted, 6) AS score FROM scored WHERE weighted >= 86""")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of offers' and roster names with a score of at least 86, found through the index over the whole roster."""
    roster, offer = _offers(spark, sf_dir)
    folded = lambda df: df.select(similarity.folded(F.col("name")).alias("name"))
    return P.rounded(names.similar(folded(offer), folded(roster), 86.0))


@query(f"""WITH RECURSIVE {SUPPLIERS}, a AS (SELECT name, {_FOLD.format("name")} AS x FROM offer), b AS (SELECT y, list(id ORDER BY id) AS ids FROM (SELECT id, {_FOLD.format("name")} AS y FROM roster) GROUP BY y),
    open_ AS (SELECT DISTINCT x FROM a WHERE x NOT IN (SELECT y FROM b)), pairs AS (SELECT x, y FROM open_, b), {name_sql.scored("pairs")},
    best AS (SELECT x, arg_max(ids, (weighted, -ids[1])) AS near FROM scored JOIN b USING (y) WHERE weighted >= 90 GROUP BY x), r AS (SELECT a.name, b.ids, best.near FROM a LEFT JOIN b ON b.y = a.x LEFT JOIN best ON best.x = a.x)
    SELECT name, CASE WHEN len(coalesce(ids, near)) = 1 THEN coalesce(ids, near)[1] END AS fighter_id, CASE WHEN len(ids) = 1 THEN 'exact' WHEN ids IS NOT NULL THEN 'collision' WHEN len(near) = 1 THEN 'fuzzy' WHEN near IS NOT NULL THEN 'fuzzy_collision' ELSE 'unresolved' END AS match_type FROM r""")
def roster_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers' names resolved at the usual threshold of 90 over the whole roster."""
    roster, offer = _offers(spark, sf_dir)
    none = spark.createDataFrame([], "alias string, fighter_id long")
    return resolve.resolve_names(offer.select("name"), roster, none).select("name", F.col("fighter_id").cast("long").alias("fighter_id"), "match_type")


#: How announced events are called, and those with results.
ANNOUNCED, HELD = ("Night: Abe vs. Bo", "Night: Cy vs. Di", "Open 7", "Night in Rio"), ("Night: Abe vs. Bo 2", "Night: Di vs. Cy", "NIGHT: ABE VS. BO", "Open 70: Abe", "Grand Night: Cy vs. Di in Rio")


@query(f"""WITH RECURSIVE e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN {list(ANNOUNCED)}[o_custkey % 4 + 1] ELSE {list(HELD)}[o_custkey % 5 + 1] END AS name, CAST(o_orderdate AS DATE) AS day, o_orderkey % 2 = 1 OR o_custkey % 7 = 1 AS held, o_custkey % 10 <> 3 AS paged FROM orders),
    near AS (SELECT a.id AS announced_id, a.name AS x, a.day AS announced_day, b.id AS held_id, b.name AS y, b.day AS held_day FROM e a JOIN e b ON NOT a.held AND a.paged AND b.held AND abs(a.day - b.day) <= 1), pairs AS (SELECT DISTINCT x, y FROM near), {name_sql.scored("pairs")}
    SELECT announced_id, x AS announced_name, announced_day, held_id, y AS held_name, held_day, round(weighted, 1) AS score FROM near JOIN scored USING (x, y) WHERE round(weighted, 1) >= 70""")
def dq_duplicate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced events near events with results whose names score at least 70; some even orders have results too, some have no page."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k % 2 == 0, P.pick(c % 4, ANNOUNCED)).otherwise(P.pick(c % 5, HELD))
    source = F.when((k % 2 == 1) | (c % 7 == 1), F.concat(F.lit("u"), k))
    events = P.table(spark, sf_dir, "orders").select(k.alias("event_id"), name.alias("name"), F.col("o_orderdate").cast("date").alias("day"), source.alias("source_url"), F.when(c % 10 != 3, k).alias("page_id"))
    return quality.duplicate_events(events)
