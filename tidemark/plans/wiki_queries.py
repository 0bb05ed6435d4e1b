"""Queries over wikitext that nests templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.projection import table
from tidemark.plans.registry import query
from tidemark.session import lanes
from tidemark.sources import wikitext


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("""SELECT o_orderkey AS page_id, CAST(i * 2 + 1 AS INT) AS position, ['Main card', 'Prelims'][i + 1] AS card_tier, ['Ann ' || o_orderkey, ''][i + 1] AS red, ['Ann (fighter ' || o_orderkey || ')', 'Cho ' || o_orderkey][i + 1] AS red_link, i = 0 AND o_orderkey % 3 = 0 AS red_champion,
    ['Bo Ray', 'Dee'][i + 1] AS blue, [NULL, 'Dee'][i + 1] AS blue_link, ['KO (punch)', 'Decision'][i + 1] AS method, [CASE o_orderkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN '' ELSE 'for the belt' END, 'see b c'][i + 1] AS notes FROM orders, range(2) t(i)""")
def nested_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts of cards whose fields hold templates three deep, links with bars, references, comments and named fields; a card that stands
    in a template, one that never ends, and other templates between."""
    k = F.col("o_orderkey")
    notes = F.when(k % 3 == 0, "title{{small|{{efn|one {{abbr|two|three}}|x}}}}").when(k % 3 == 1, "{{small|a{{b|c{{d|e|f}}}}}}").otherwise("''for'' the <small>belt</small><ref name=x>not {{this}}</ref>")
    text = _text(
        "{{short|{{x}}}}\n{{hidden|y|{{MMAevent card|'''Main card'''}}\n{{MMAevent bout\n|Lightweight|[[Ann (fighter ", k, ")|Ann ", k, "]]", F.when(k % 3 == 0, " (c)").otherwise(" {{small|(c)}}"),
        "|def.|{{flag|X|{{y|z}}}} Bo Ray<!-- no |bar -->|KO ([[Knockout|punch]])|3|5:00|", notes, "}}}}\n{{MMAevent card|Prelims{{n|{{m|{{o}}}}}}}}\n",
        "{{MMAevent bout|colour={{c|d}}|Flyweight|{{nowrap|[[Cho ", k, "]]}}|vs.|[[Dee]]|8=see [[a|b]] c|Decision}}\n{{MMAevent bout|Never|ends{{|x",
    )
    cards = wikitext.fight_cards(table(spark, sf_dir, "orders").select("o_orderkey").repartition(lanes(spark)).select(k.alias("page_id"), text.alias("text")))
    return cards.select("page_id", "position", "card_tier", "red", "red_link", "red_champion", "blue", "blue_link", "method", "notes")


@query("""SELECT o_orderkey AS page_id, CAST(1 AS INT) AS position, 'Night ' || o_orderkey AS event_title, 'N ' || o_orderkey AS event_display_name, CAST(o_orderdate AS DATE) AS date, 'Hall ' || o_custkey AS venue, 'Town, Land' AS location FROM orders WHERE o_orderkey % 4 <> 0""")
def schedule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table of events, with templates three deep in their cells; rows without a link or with fewer cells are left out."""
    k = F.col("o_orderkey")
    head = 'Intro\n{| class="wikitable"\n! scope="col" | Event\n! scope="col" | Date\n! scope="col" | Venue\n! scope="col" | Location\n|-\n|Short\n|row\n'
    event = F.when(k % 4 == 0, "Unlinked").otherwise(_text("[[Night ", k, "|N ", k, "]]"))
    text = _text(head + "|-\n|", event, "\n|{{dts|", F.date_format("o_orderdate", "yyyy|M|d"), "}}\n|[[Hall|Hall ", F.col("o_custkey"), "]]{{a|{{b|{{c}}|d}}}}\n|{{flag|x|{{y}}}} Town, [[Land]]\n|}\nEnd")
    return wikitext.scheduled_events(table(spark, sf_dir, "orders").select(k.alias("page_id"), text.alias("text")))
