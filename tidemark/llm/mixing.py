"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the key -ln(u) / w, with u a hash of its id and text and w its quality weight; small keys go first. A source
with the target t and the size s gives floor(t / s) complete epochs and then documents in key order until the words that are left
are used up; the last of them is cut. The order inside a source is a prefix sum, but no source is ever sorted whole: sizes are
summed by source and key bucket, and a running sum over at most BUCKETS rows of a source finds the bucket in which the budget ends.
While that bucket holds more than EDGE_ROWS rows, it is dealt into BUCKETS smaller ones by the next bits of the key, and so on; only
the last is sorted. So a source that holds a third of all rows costs no more than the others, however many rows that is.

Defined cases: null text counts 0 words and is never taken; a null source is a source, last in order; a null id hashes like any
value; repeated rows are taken as rows of their own, in any order among equals; an empty table gives an empty table; an input column
with the name of an added one is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, join_small, shield, text_or_empty, unshield, word_count

#: Key buckets of a source, and of a bucket; BUCKETS ** LEVELS tells keys apart to their last bits but four.
BUCKETS, LEVELS = 4096, 4
#: Rows of the bucket in which a budget ends that are sorted.
EDGE_ROWS = 1000
#: Weights of the sources in order, repeated.
CYCLE = (3.0, 1.0, 2.0)
#: A column name that no table has.
WEIGHT = "weight of the key"
#: Marks that ordinary prose hardly has.
MARKS = "#$%&*!|"


def quality_weight(text: str = "text") -> Column:
    """1 for prose, down to 0.25 with a rising share of marks."""
    length = F.length(text_or_empty(text))
    marks = length - F.length(F.translate(text_or_empty(text), MARKS, ""))
    return F.greatest(F.lit(0.25), F.lit(1.0) - 4.0 * marks / F.greatest(length, F.lit(1)))


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """Weights CYCLE in code point order of the source, null last."""
    place = (F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1) % len(CYCLE)
    return sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, CYCLE)), (place + 1).cast("int")))


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds _target to (_source, _size, _weight): `share` times all sizes by weight, each at most `most` times its size, what is
    above dealt again by weight. There is one level of target per weight below which nobody is cut, so one pass in the order of
    (limit / weight) finds it: a source is at its limit if the level that the rest would have reaches its own ratio."""
    limit = F.col("_size") * F.lit(most)
    order = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    every = Window.partitionBy()
    level = (F.col("_all") * share - F.coalesce(F.sum("_limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = (
        sources.withColumn("_limit", limit)
        .withColumn("_ratio", F.col("_limit") / F.col("_weight"))
        .withColumn("_all", F.sum("_size").over(every))
        .withColumn("_level", level)
        .withColumn("_open", F.min(F.when(F.col("_level") < F.col("_ratio"), F.struct("_ratio", "_level"))).over(every))
    )
    free = F.col("_open").isNotNull() & (F.col("_ratio") >= F.col("_open._ratio"))
    target = F.when(free, F.least(F.col("_open._level") * F.col("_weight"), F.col("_limit"))).otherwise(F.col("_limit"))
    return filled.select("_source", "_size", "_weight", target.alias("_target"))


def mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, weights=cyclic_weights, share: float = 1.5, most: float = 2.0, seed: int = 17, keep_text: bool = True) -> DataFrame:
    """docs with _words, _source_size, _target, _epochs, _cut and _taken = _epochs * _words + _cut.

    keep_text: with False the text column goes, and texts are read once: numbers are written to the shared folder in their place.

    weights: a function that adds _weight to a table of (_source, _size), one row a source. The table of sources is the only
    thing that is ever brought together; its length is the number of sources, not of documents.
    """
    weighed = docs.withColumn(WEIGHT, quality_weight(text) if quality is None else quality)
    own, names = shield(weighed)
    weight, text, id, source = (names.pop(WEIGHT) if c == WEIGHT else names[c] for c in (WEIGHT, text, id, source))
    drawn = (F.pmod(F.xxhash64(F.lit(seed), F.col(id), F.col(text)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = own.withColumns({"_source": F.col(source), "_key": -F.ln(drawn) / F.col(weight), "_words": word_count(text), "_digest": F.xxhash64(F.col(text))}).withColumn("_place", F.least(F.lit(1.0) - F.exp(-F.col("_key")), F.lit(1.0 - 2.0**-52)))
    if not keep_text:
        keyed, names = cut(keyed.drop(text)), {c: own for c, own in names.items() if own != text}
    slim = keyed if not keep_text else cut(keyed.select("_source", "_place", "_words"))
    same = lambda a, b: a["_source"].eqNullSafe(b["_of"])
    cell = lambda scale: F.floor(F.col("_place") * scale)
    sums = cut(slim.groupBy("_source", cell(F.lit(BUCKETS)).alias("_cell")).agg(F.sum("_words").alias("_sum")))
    sources = water_fill(weights(sums.groupBy("_source").agg(F.sum("_sum").alias("_size"))), share, most)
    sources = sources.withColumn("_epochs", F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(0).cast("long")).withColumn("_budget", F.round(F.col("_target") - F.col("_epochs") * F.col("_size")).cast("long"))
    plan = cut(sources.select(F.col("_source").alias("_of"), F.col("_size").alias("_source_size"), "_target", "_epochs", "_budget", F.lit(0).cast("long").alias("_last"), F.lit(1).cast("long").alias("_scale"), F.lit(0).cast("long").alias("_before")))
    plan = narrowed(plan, sums, same)
    for _ in range(LEVELS - 1):  # a bucket that is too full is dealt by the next bits of the key
        edge = join_small(slim, plan, same(slim, plan)).where((F.col("_scale") > 1) & (cell(F.col("_scale")) == F.col("_last")))
        edge = cut(edge.groupBy("_source", cell(F.col("_scale") * BUCKETS).alias("_cell")).agg(F.sum("_words").alias("_sum"), F.count("*").alias("_n")))
        full = edge.groupBy("_source").agg(F.sum("_n").alias("_n")).where(F.col("_n") > EDGE_ROWS)
        if full.isEmpty():
            break
        plan = narrowed(plan, edge.join(full.select(F.col("_source").alias("_of")), F.col("_source").eqNullSafe(F.col("_of")), "left_semi"), same)
    ready = join_small(keyed, plan, same(keyed, plan))
    at = F.when(F.col("_scale") > 1, cell(F.col("_scale")))  # null in a source that has no edge
    at_edge = F.coalesce(at == F.col("_last"), F.lit(False))
    whole = ready.where(~at_edge).withColumn("_cut", F.when((F.col("_budget") > 0) & (at.isNull() | (at < F.col("_last"))), F.col("_words")).otherwise(0).cast("long"))
    order = Window.partitionBy("_source").orderBy("_key", F.col(id), "_digest", "_words").rowsBetween(Window.unboundedPreceding, -1)
    part = ready.where(at_edge).withColumn("_cut", F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_budget") - F.col("_before") - F.coalesce(F.sum("_words").over(order), F.lit(0)))).cast("long"))
    out = whole.unionByName(part).withColumn("_taken", F.col("_epochs") * F.col("_words") + F.col("_cut"))
    return unshield(out, names, **{c: F.col(c) for c in ("_words", "_source_size", "_target", "_epochs", "_cut", "_taken")})


def narrowed(plan: DataFrame, sums: DataFrame, same) -> DataFrame:
    """plan (a row for each source) with the cell of `sums` (_source, _cell, _sum) in which its budget ends, if it does in one, the finer
    scale of these cells and the words before it."""
    below = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("_below", F.coalesce(F.sum("_sum").over(below), F.lit(0)))
    met = running.join(plan.select("_of", "_budget", "_before"), same(running, plan)).withColumn("_start", F.col("_before") + F.col("_below"))
    edge = met.where((F.col("_start") <= F.col("_budget")) & (F.col("_budget") < F.col("_start") + F.col("_sum"))).groupBy(F.col("_of").alias("_edge_of")).agg(F.min(F.struct("_cell", "_start")).alias("_edge"))
    moved = F.col("_edge").isNotNull()
    found = {"_last": F.when(moved, F.col("_edge._cell")).otherwise(F.col("_last")), "_before": F.when(moved, F.col("_edge._start")).otherwise(F.col("_before")), "_scale": F.when(moved, F.col("_scale") * BUCKETS).otherwise(F.col("_scale"))}
    return cut(plan.join(edge, F.col("_of").eqNullSafe(F.col("_edge_of")), "left").withColumns(found).drop("_edge_of", "_edge"))


def first_words(text: str, n: str) -> Column:
    """The text up to the end of its n-th word, cut between a word and white space, so that nothing inside changes."""
    pieces = F.split(F.col(text), "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), F.col(n).cast("int")), "")


def materialize(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of the mix: a whole copy for each epoch, and one more for what the fraction takes, cut to its words."""
    part = F.when(F.col("_cut") > 0, F.array(F.col("_cut"))).otherwise(F.array().cast("array<bigint>"))
    copies = F.concat(F.array_repeat(F.col("_words"), F.col("_epochs").cast("int")), part)
    rows = mixed.where(F.col("_words") > 0).withColumn("_take", F.explode(copies))
    return rows.withColumn(text, F.when(F.col("_take") < F.col("_words"), first_words(text, "_take")).otherwise(F.col(text)))
