"""Fight cards and event tables out of wikitext, as DataFrame expressions over pages (page_id, text)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

#: The templates' names and the table's header.
CARD, BOUT = "MMAevent card", "MMAevent bout"
HEADERS = ("Event", "Date", "Venue", "Location")
#: Marks of wikitext, and the beginning of a template of ours.
MARK = re.compile(r"\{\{(?:\s*MMAevent\s+(?:card|bout)\b)?|\}\}|\[\[|\]\]|\|", re.ASCII)
#: White space, as strip takes it.
SPACES = " \t\n\x0b\f\r"
#: What isn't text: comments and references.
UNSEEN = r"(?s)<!--.*?-->|<ref\b[^>]*/>|<ref\b.*?</ref\s*>"


def strip(c: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _depth(c: Column) -> Column:
    """How deep templates are nested in a text, at most."""
    marks = F.regexp_extract_all(c, F.lit(r"\{\{|\}\}"), F.lit(0))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, m: F.struct((s["now"] + F.when(m == "{{", 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(m == "{{", 1).otherwise(-1)).alias("most")))["most"]


def without_templates(c: Column) -> Column:
    """A text without its templates, nested to whatever depth: the innermost go first, as often as the text is deep."""
    rounds = F.when(_depth(c) > 0, F.sequence(F.lit(1), F.greatest(_depth(c), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, c, lambda t, _: F.regexp_replace(t, r"\{\{[^{}]*\}\}", ""))


def linked(c: Column) -> Column:
    """A text with links shown as they are read (the last part of a link), without quotes and tags, trimmed."""
    shown = F.regexp_replace(c, r"\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]", "$1")
    return strip(F.regexp_replace(F.regexp_replace(shown, "<[^<>]*>", ""), "'{2,}", ""))


def plain(c: Column) -> Column:
    """Text as it is shown: links become their text; quotes, tags, comments, references and templates go."""
    return linked(without_templates(F.regexp_replace(c, UNSEEN, "")))


def _fields(text: str | None) -> list[tuple[str, str | None, list[int], list[str], list[str]]]:
    """(name, card, fields' numbers, raw, shown) of the templates of a page, in one pass over its marks: see templates."""
    found, level, at, card = [], 0, None, None

    def numbered(fields: list[tuple[str, str]]) -> tuple[dict[int, str], dict[int, str]]:
        raw, shown, place = {}, {}, 0
        for i, (r, s) in enumerate(fields):
            if i and "=" in s:
                name = s.split("=", 1)[0].strip(SPACES)
                if not re.fullmatch("[1-9][0-9]{0,3}", name):
                    continue
                n, r, s = int(name), r.split("=", 1)[1], s.split("=", 1)[1]
            else:
                n = place
                place += 1
            raw[n], shown[n] = r, s  # of fields of one number the last holds
        return raw, shown

    for m in MARK.finditer(text or ""):
        t, here = m.group(), m.start()
        if t[0] == "{":
            level += 1
            if len(t) > 2:
                at, links, fields, seen, start, since = level, 0, [], "", here, here
            elif level - 1 == at:
                seen += text[since:here]
        elif t == "}}":
            level -= 1
            if level == at:
                since = m.end()
            elif at is not None and level < at:
                raw, shown = numbered([*fields, (text[start:here], seen + text[since:here])])
                name = re.sub(r"^\{\{\s*MMAevent\s+", "MMAevent ", raw[0], flags=re.ASCII).strip(SPACES)
                card = shown.get(1, "") if name == CARD else card
                found.append((name, card, list(raw), list(raw.values()), list(shown.values())))
                at = None
        elif at is None:
            continue
        elif t != "|":
            links += 1 if t == "[[" else -1
        elif level == at and links <= 0:
            fields.append((text[start:here], seen + text[since:here]))
            seen, start, since = "", m.end(), m.end()
    return found


def templates(pages: DataFrame) -> DataFrame:
    """The card and bout templates of pages (page_id, text), wherever they stand: page_id, position (from 0, in document order), name, card
    (the first field, as shown, of the last card header up to here), and their positional fields by number as two maps, `raw` with the markup and `shown` without what stands in nested templates.

    Marks are told apart from text once; a running depth over the marks of a page says where a template ends and which bars are its own,
    whatever is nested in it: bars in links and in inner templates aren't. Fields with a name are left out, those named by a number
    have that number. A template that never ends, or in which another of ours begins, is left out. A page is read in its row, so nothing
    is shuffled."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("card", pa.string()), ("at", pa.list_(pa.int32())), ("raw", pa.list_(pa.string())), ("shown", pa.list_(pa.string()))]))

    @F.arrow_udf("array<struct<name: string, card: string, at: array<int>, raw: array<string>, shown: array<string>>>")
    def fields(texts: pa.Array) -> pa.Array:
        return pa.array([_fields(x) for x in texts.to_pylist()], kind)

    # Otherwise a filter on the number of templates would be moved before whatever deals pages, and a page read twice.
    found = pages.select("page_id", fields.asNondeterministic()(F.regexp_replace("text", UNSEEN, "")).alias("_t")).select("page_id", F.posexplode("_t").alias("position", "_t"))
    return found.select("page_id", "position", "_t.name", "_t.card", *[F.map_from_arrays("_t.at", f"_t.{c}").alias(c) for c in ("raw", "shown")])


def fight_cards(pages: DataFrame) -> DataFrame:
    """One row per bout in document order, with the tier of the last card header before it. Texts are as they are shown; a link may also
    stand in a nested template."""
    raw = lambda i: F.coalesce(F.element_at("raw", F.lit(i)), F.lit(""))
    shown = lambda i: linked(F.coalesce(F.element_at("shown", F.lit(i)), F.lit("")))
    tiers = templates(pages).withColumn("card_tier", linked(F.col("card"))).where(F.col("name") == BOUT)
    fighter = lambda i: strip(F.replace(shown(i), F.lit("(c)"), F.lit("")))
    return tiers.select(
        "page_id", "position", "card_tier", shown(1).alias("weight_class"),
        fighter(2).alias("red"), S.link_target(raw(2)).alias("red_link"), shown(2).contains("(c)").alias("red_champion"), shown(3).alias("connector"),
        fighter(4).alias("blue"), S.link_target(raw(4)).alias("blue_link"), shown(4).contains("(c)").alias("blue_champion"),
        shown(5).alias("method"), shown(6).alias("round"), shown(7).alias("time"), shown(8).alias("notes"),
    )


def with_main_event(bouts: DataFrame) -> DataFrame:
    """The first bout of a card is its main event; titles follow from champions and notes, rounds from both."""
    order = Window.partitionBy("page_id").orderBy("position")
    main = F.row_number().over(order) == 1
    title = F.col("red_champion") | F.col("blue_champion") | F.coalesce(F.col("notes").rlike("(?i)title|championship"), F.lit(False))
    return bouts.withColumn("is_main_event", main).withColumn("is_title", title).withColumn("scheduled_rounds", S.bout_rounds("is_title", "is_main_event"))


def scheduled_events(pages: DataFrame) -> DataFrame:
    """Rows of the first table of each page that link an event: title, shown name, date, venue, location. Another header than HEADERS
    fails when it is read; rows with fewer than four cells or without a link are left out."""
    table = pages.select("page_id", F.regexp_extract("text", r"(?s)\{\|.*?\|\}", 0).alias("_t"))
    blocks = table.withColumn("_b", F.split("_t", r"\n\|-[^\n]*\n?"))
    names = F.transform(F.regexp_extract_all(F.col("_b")[0], F.lit(r"(?m)^!\s*(?:scope=\"col\"\s*\|\s*)?(.+)$"), F.lit(1)), lambda h: F.trim(h))
    checked = blocks.where(F.assert_true(names == F.array(*map(F.lit, HEADERS)), F.lit("unexpected table columns")).isNull())
    rows = checked.select("page_id", F.posexplode(F.slice("_b", F.lit(2), F.greatest(F.size("_b") - 1, F.lit(0)))).alias("position", "_r"))
    cells = rows.withColumn("_c", F.transform(F.regexp_extract_all("_r", F.lit(r"(?m)^\|(?!\})(.*)$"), F.lit(1)), lambda c: F.trim(c))).where(F.size("_c") >= 4)
    at = lambda i: F.col("_c")[i]
    out = cells.select("page_id", "position", S.link_target(at(0)).alias("event_title"), S.link_text(at(0)).alias("event_display_name"), S.template_date(at(1)).alias("date"), plain(at(2)).alias("venue"), plain(at(3)).alias("location"))
    return out.where("event_title is not null")
