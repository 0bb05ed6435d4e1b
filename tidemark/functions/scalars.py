"""Scalar functions as column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight classes from light to heavy, by ladder, and classes that have no place on one. Longer names come first when
#: text is searched.
LADDERS = {
    "men": ("flyweight", "bantamweight", "featherweight", "lightweight", "welterweight", "middleweight", "light heavyweight", "heavyweight"),
    "women": ("women's strawweight", "women's flyweight", "women's bantamweight", "women's featherweight"),
}
NO_LADDER = ("catch weight", "catchweight", "open weight", "super heavyweight")
#: Centimetres of an inch, seconds of a round, days of a year.
CM, ROUND_SECONDS, YEAR_DAYS = 2.54, 300, 365.25


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text; blanks and dashes alone are missing."""
    t = F.trim(col(c))
    return F.when(~t.rlike(r"^-*$"), t)


def group(c: Column | str, pattern: str, i: int = 1) -> Column:
    """Group i of the pattern, null if it isn't there."""
    return F.nullif(F.regexp_extract(col(c), pattern, i), F.lit(""))


def height_cm(c) -> Column:
    feet, inches = group(c, r"(\d+)'\s*(\d+)\"", 1).cast("int"), group(c, r"(\d+)'\s*(\d+)\"", 2).cast("int")
    return F.round((feet * 12 + inches) * CM, 1)


def reach_cm(c) -> Column:
    return F.round(group(c, r"^\s*(\d+(?:\.\d+)?)\"?\s*$", 1).cast("double") * CM, 1)


def stance(c) -> Column:
    return F.lower(blank_to_null(c))


def landed(c) -> Column:
    return group(c, r"(\d+)\s+of\s+(\d+)", 1).cast("int")


def attempted(c) -> Column:
    return group(c, r"(\d+)\s+of\s+(\d+)", 2).cast("int")


def clock_seconds(c) -> Column:
    return group(c, r"^\s*(\d+):(\d{2})\s*$", 1).cast("int") * 60 + group(c, r"^\s*(\d+):(\d{2})\s*$", 2).cast("int")


def round_number(c) -> Column:
    return group(c, r"Round\s+(\d+)", 1).cast("int")


def scheduled_rounds(c) -> Column:
    return group(c, r"^\s*(\d+)\s+Rnd", 1).cast("int")


def is_title(c) -> Column:
    """Bouts for a title are named so, or a championship."""
    return F.coalesce(col(c).rlike(r"(?i)title|championship"), F.lit(False))


def winner_side(outcome) -> Column:
    """Red if the side before the slash has won, else blue if the one after it has; each side is read alone ('W/NC' is red, 'NC/W' blue),
    and draws and no contests are nobody's."""
    sides = F.split(F.trim(col(outcome)), "/")
    return F.when(F.get(sides, F.lit(0)) == "W", "red").when(F.get(sides, F.lit(1)) == "W", "blue")


def corner(bout, i: int) -> Column:
    """Name i of 'A vs. B', split once."""
    return F.trim(F.get(F.split(col(bout), r" vs\. ", 2), F.lit(i)))


def blocking_key(name) -> Column:
    """First letter of the last word."""
    return F.substring(F.element_at(F.split(F.trim(col(name)), r"\s+"), -1), 1, 1)


#: Fixed value: the word before the number of a numbered event.
SERIES = "ufc"


def event_number(name, series: str = SERIES) -> Column:
    """The number of an event of the numbered series, which follows the series' word directly; other numbers in a name ('UFC Fight
    Night 7', 'UFC on ESPN 60') are not one."""
    return group(F.lower(col(name)), rf"\b{series}\s*(\d{{1,4}})\b", 1).cast("int")


def is_decision(method) -> Column:
    return F.coalesce(F.lower(F.trim(col(method))).startswith("decision"), F.lit(False))


def duration_seconds(method, scheduled, ending_round, ending_time) -> Column:
    """A decision takes all rounds; else the full rounds before the last and the time in it. Null if the finish isn't known."""
    return F.when(is_decision(method), col(scheduled) * ROUND_SECONDS).otherwise((col(ending_round) - 1) * ROUND_SECONDS + col(ending_time))


def age_years(day, born) -> Column:
    return F.datediff(col(day), col(born)) / YEAR_DAYS


def ratio(a, b) -> Column:
    """a / b, null where b is 0 or missing."""
    return F.when(col(b) != 0, col(a) / col(b))


def stance_matchup(mine, other) -> Column:
    return F.concat(col(mine), F.lit(" vs "), col(other))


def open_stance(mine, other) -> Column:
    """Whether one is orthodox and the other southpaw; any other pair is False, a missing stance too."""
    pair = F.array_sort(F.array(col(mine), col(other)))
    return F.coalesce(pair == F.array(F.lit("orthodox"), F.lit("southpaw")), F.lit(False))


def weight_class(c) -> Column:
    """The class named inside a free text, the longest name first; classes without a ladder are named too."""
    names = sorted((*NO_LADDER, *(n for names in LADDERS.values() for n in names)), key=lambda n: (-len(n), n))
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.lower(col(c)).contains(n), n).otherwise(out)
    return out


def ladder_step(before, now) -> Column:
    """-1, 0 or 1 for a move down, none or up; null across ladders or off them."""
    out = F.lit(None).cast("int")
    for names in LADDERS.values():
        at = lambda c: F.array_position(F.array(*map(F.lit, names)), col(c))  # noqa: B023, E731
        out = F.when(col(before).isin(*names) & col(now).isin(*names), F.signum(at(now) - at(before)).cast("int")).otherwise(out)
    return out


def implied_probability(moneyline) -> Column:
    """American odds to the raw probability."""
    m = col(moneyline)
    return F.when(m < 0, -m / (-m + F.lit(100.0))).otherwise(F.lit(100.0) / (m + F.lit(100.0)))


def elo_expectation(a, b) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (col(b) - col(a)) / 400.0))


def k_by_experience(n, new: float, veteran: float, scale: float) -> Column:
    return F.lit(veteran) + F.lit(new - veteran) * F.exp(-col(n) / F.lit(scale))


def clip(p, eps: float) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), col(p)))


def logit(p) -> Column:
    c = clip(p, 1e-6)
    return F.ln(c / (1 - c))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def log_loss(y, p) -> Column:
    c = clip(p, 1e-15)
    return -F.when(col(y) == 1, F.ln(c)).otherwise(F.ln(1 - c))


def symmetric(g, p) -> Column:
    """(g(p) + 1 - g(1 - p)) / 2 for a function g of columns."""
    return (g(col(p)) + 1 - g(1 - col(p))) / 2


def blend(ps: Sequence, weights: Sequence, space: str = "prob") -> Column:
    total = sum(weights)
    if space == "prob":
        return sum((col(p) * w for p, w in zip(ps, weights)), F.lit(0.0)) / total
    return sigmoid(sum((logit(p) * w for p, w in zip(ps, weights)), F.lit(0.0)) / total)


def bout_rounds(title, main_event) -> Column:
    """Title fights and main events have five rounds, others three."""
    return F.when(col(title) | col(main_event), 5).otherwise(3)


def in_event_window(at, day) -> Column:
    """Within 6 hours before and 36 hours after the start of a day, both inclusive."""
    start = col(day).cast("timestamp_ntz")
    return col(at).cast("timestamp_ntz").between(start - F.expr("INTERVAL 6 HOURS"), start + F.expr("INTERVAL 36 HOURS"))


def snapshot_time(day) -> Column:
    return F.concat(F.date_format(col(day), "yyyy-MM-dd"), F.lit("T12:00:00Z"))


def template_date(c) -> Column:
    """The date in {{dts|year|month|day}}; the month is a short name, a name or a number."""
    at = lambda i: F.trim(group(c, r"(?i)\{\{\s*dts\s*\|([^|}]+)\|([^|}]+)\|([^|}]+)", i))
    t = F.concat_ws(" ", at(1), at(2), at(3))
    return F.coalesce(*[F.try_to_date(t, f) for f in ("yyyy MMM d", "yyyy MMMM d", "yyyy M d")])


def link_target(c) -> Column:
    return F.trim(group(c, r"\[\[([^\]|#]+)", 1))


def link_text(c) -> Column:
    """What a wikilink shows: the part after the bar, or the target; text without a link is itself."""
    return F.trim(F.coalesce(group(c, r"\[\[[^\]|]*\|([^\]]*)\]\]", 1), group(c, r"\[\[([^\]|]+)\]\]", 1), col(c)))


def edges_below(p, n: int) -> Column:
    """Index of the right-closed bin of p among n equal bins of [0, 1]: how many inner edges lie below p, by the literal edges."""
    return sum((F.when(F.lit(i / n) < col(p), 1).otherwise(0) for i in range(1, n)), F.lit(0))
