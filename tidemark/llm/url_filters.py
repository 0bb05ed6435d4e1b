"""URL filters whose lists change over time.

A list is a table of dated entries: on a day a pattern was added or removed. Entries become validity intervals [from, to), one per
stretch in which the pattern was on the list. A capture has the keys under which it could be listed (its host and parent domains, and
its host with path prefixes, of those lengths that the lists have); keys meet patterns by equality, and the as-of condition from <= day < to keeps the entries that
were active when the capture was fetched. The longest active pattern decides, and between equal ones a block does.

Captures are evaluated once per distinct (url, day); the list is broadcast while it is small, else a key that many captures share is
split by adaptive execution.

Defined cases: a null or malformed url has no host, matches nothing and is not blocked; a capture without a day likewise; an entry
without a day or a pattern is ignored; an entry added twice stays one stretch; a removal that nothing precedes is ignored; equal days
of one pattern: the removal comes first; urls of any length are read whole; repeated captures each get their row; an empty list blocks nothing; an empty table gives an
empty table; other columns are kept, but one with the name of an added column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, join_small, shield, unshield


def host_of(url: str) -> Column:
    """The host of a url in lower case, without user, port, www. and final dots; null if there is none. An IPv6 host keeps its brackets."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]*)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", ""), F.lit(""))


def path_of(url: str) -> Column:
    return F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, action, kind, pattern, day, change add|remove) as (list, action, kind, pattern, _from, _to); _to is null while listed."""
    valid = entries.where("day is not null and pattern is not null").withColumn("_add", (F.col("change") == "add").cast("int"))
    own = Window.partitionBy("list", "action", "kind", "pattern").orderBy("day", "_add")
    turns = valid.withColumn("_was", F.coalesce(F.lag("_add").over(own), F.lit(0))).where("_add <> _was")
    return turns.withColumn("_to", F.lead("day").over(own)).where("_add = 1").select("list", "action", "kind", "pattern", F.col("day").alias("_from"), "_to")


def parts_of(pattern: Column) -> Column:
    """How many parts a pattern has that are parted by slashes."""
    return F.length(pattern) - F.length(F.replace(pattern, F.lit("/"), F.lit(""))) + 1


def labels_of(pattern: Column) -> Column:
    return F.length(pattern) - F.length(F.replace(pattern, F.lit("."), F.lit(""))) + 1


def keys(host: str, path: str, labels: list[int], parts: list[int]) -> Column:
    """The (kind, pattern) pairs under which a capture may be listed: its domains of as many labels, and its prefixes of as many parts,
    as patterns of the lists have. Each is cut out of the address once, so the work follows the length of the address times the
    number of lengths that the lists have, not the square of the address."""
    whole = F.concat(F.col(host), F.regexp_replace(F.coalesce(F.col(path), F.lit("")), "/$", ""))
    of = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<int>")
    at = lambda text, mark, n: F.call_function("substring_index", text, F.lit(mark), n)
    domains = F.transform(F.filter(of(labels), lambda n: n <= labels_of(F.col(host))), lambda n: F.struct(F.lit("domain").alias("kind"), at(F.col(host), ".", -n).alias("pattern")))
    prefixes = F.transform(F.filter(of(parts), lambda n: n <= parts_of(whole)), lambda n: F.struct(F.lit("prefix").alias("kind"), at(whole, "/", n).alias("pattern")))
    return F.concat(domains, prefixes)


def lengths(listed: DataFrame, kind: str, length: Column) -> list[int]:
    """The different lengths of the lists' patterns of a kind: as many numbers as there are lengths, not patterns."""
    return sorted(r[0] for r in listed.where(F.col("kind") == kind).select(length).distinct().collect())


def evaluate(captures: DataFrame, entries: DataFrame, *, url: str = "url", day: str = "day") -> DataFrame:
    """captures with _host, _active (number of active entries), _rule (the deciding pattern or null) and _blocked."""
    own, names = shield(captures)
    address, fetched = names[url], names[day]
    listed = cut(intervals(entries))
    once = own.select(F.col(address).alias("_url"), F.col(fetched).alias("_day")).where("_url is not null and _day is not null").distinct()
    once = once.withColumn("_h", host_of("_url")).where("_h is not null").withColumn("_p", path_of("_url"))
    asked = once.select("_url", "_day", F.inline(keys("_h", "_p", lengths(listed, "domain", labels_of(F.col("pattern"))), lengths(listed, "prefix", parts_of(F.col("pattern"))))))
    met = join_small(asked, listed, ["kind", "pattern"]).where((F.col("_from") <= F.col("_day")) & (F.col("_to").isNull() | (F.col("_day") < F.col("_to"))))
    best = F.max(F.struct(F.length("pattern").alias("n"), F.col("action"), F.col("pattern")))
    decided = met.groupBy("_url", "_day").agg(F.count("*").alias("_n"), best.alias("_best"))
    out = own.join(decided, (F.col(address) == F.col("_url")) & (F.col(fetched) == F.col("_day")), "left")
    return unshield(out, names, _host=host_of(address), _active=F.coalesce("_n", F.lit(0)), _rule=F.col("_best.pattern"), _blocked=F.coalesce(F.col("_best.action") == "block", F.lit(False)))
