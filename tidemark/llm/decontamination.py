"""Benchmark decontamination with a distributed positional inverted index.

A window is a run of WINDOW consecutive words of a benchmark item (a shorter item is one window). A first pass over the documents
counts the benchmark's terms. Each window then has its rarest and its second rarest term, and a second pass stores postings of these
anchor terms alone: (term, document, position, the words around). For a window, the lists of both anchors are shifted by the
anchors' offsets and intersected, from the rarest; a common start is a candidate, and the posting's context confirms the phrase, by
64 bits of its anchors and 32 bits of each of its other words. A document's key is a 128-bit digest of its text, so copies share their hits.

The same lists give proximity matches of whole windows, words of which may be missing from the corpus: the two rarest terms that do
occur lie within SLACK words of where the phrase would have them, and of the window's different words at most MISSING are absent among
the WINDOW - 1 words on either side of each of the two. An exact occurrence is one too. They are reported and drop no document.

The window table is broadcast to the indexing tasks in blocks of at most BLOCK_WINDOWS windows; a larger benchmark makes more blocks,
each of which is looked up in all documents. Postings of a frequent anchor stay spread over the tasks that found them: windows come
to them, they are never grouped by term.

Defined cases: null or wordless texts have no words and no hits, null or wordless items no windows; a null item_id hits like others
but isn't listed; repeated item ids count once; repeated rows each get their row; with an empty benchmark all documents are clean;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words
from tidemark.llm.common import cut, join_small, shield, unshield

WINDOW = 10
#: Of proximity matches: how far the anchors may be shifted against one another, and how many of a window's words may be absent.
SLACK, MISSING = 2, 2
#: Windows that are broadcast at once: some 100 bytes each.
BLOCK_WINDOWS = 250_000


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def windows_of(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The distinct windows and their items: _item, _words array<long>."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = [], []
            names = batch.column(0).to_pylist()
            for first, many in words.by_text(batch.column(1), words.ALPHANUMERIC):
                for i, w in enumerate(many):
                    k = min(window, len(w))
                    for at in range(len(w) - k + 1 if k else 0):
                        ids.append(names[first + i])
                        lists.append(_signed(w[at : at + k]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lists, pa.list_(pa.int64()))], names=["_item", "_words"])

    return benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).mapInArrow(read, "_item string, _words array<long>").distinct()


def term_counts(docs: DataFrame, terms: np.ndarray, *columns: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """One pass over the documents: how often each of the terms (sorted, 64-bit) occurs, (_term, _count), of which a task sends one row
    a term at most; and for each document the named columns, _doc and n_words (nothing if no column is named)."""
    kept = docs.select(*columns, digest(text), F.col(text).cast("string").alias("_text"))
    fields = [f for f in kept.schema.fields if f.name != "_text"] if columns else []
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("n_words", T.LongType()), T.StructField("_term", T.LongType()), T.StructField("_count", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros(len(terms) + 1, dtype=np.int64), None
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(fields))]
            for first, many in words.by_text(batch.column(batch.num_columns - 1), words.ALPHANUMERIC):
                total += np.bincount(_places(np.concatenate(many), terms), minlength=len(terms) + 1)
                if fields:
                    none = pa.nulls(len(many), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(many)) for i in range(len(fields))), pa.array([len(w) for w in many], pa.int64()), none, none], names=schema.names)
        some = np.flatnonzero(total[:-1])
        if len(some):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), k) for k in kinds), pa.nulls(len(some), pa.int64()), pa.array(_signed(terms[some])), pa.array(total[some])], names=schema.names)

    both = cut(kept.mapInArrow(count, schema))
    return both.where("_term is not null").groupBy("_term").agg(F.sum("_count").alias("_count")), both.where("_term is null").drop("_term", "_count")


def _places(w: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The place of each word among the sorted terms, len(terms) for others."""
    at = np.searchsorted(terms, w)
    at[at == len(terms)] = 0
    return np.where(terms[at] == w, at, len(terms)) if len(terms) else np.zeros(len(w), dtype=np.int64)


def postings(docs: DataFrame, anchors: np.ndarray, *, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The positional index of the anchor terms: _term, _doc (digest of the text), _at, _around: the 2 * window - 1 words around,
    32 bits of each. Copies of a text repeat its postings; they fall together when lists are intersected."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, many in words.by_text(batch.column(1), words.ALPHANUMERIC):
                flat, sizes = np.concatenate(many), np.array([len(w) for w in many])
                hit = np.flatnonzero(_places(flat, anchors) < len(anchors))
                if not len(hit):
                    continue
                ends = np.cumsum(sizes)
                doc = np.searchsorted(ends, hit, side="right")
                start, end = (ends - sizes)[doc], ends[doc]
                around = hit[:, None] + np.arange(1 - window, window)[None, :]
                ok = (around >= start[:, None]) & (around < end[:, None])
                near = np.where(ok, flat[np.clip(around, 0, len(flat) - 1)], 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.astype(np.uint32).view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(flat[hit])), batch.column(0).take(pa.array(first + doc)), pa.array((hit - start).astype(np.int64)), lists], names=["_term", "_doc", "_at", "_around"])

    keyed = docs.select(digest(text), F.col(text).cast("string").alias("_text"))
    return keyed.mapInArrow(index, "_term long, _doc binary, _at long, _around array<int>")


def digest(text: str = "text"):
    return F.unhex(F.md5(F.col(text).cast("string").cast("binary"))).alias("_doc")


def anchored(windows: DataFrame, counts: DataFrame, near: int | None = None) -> DataFrame:
    """The windows whose terms all occur (_whole), with their two rarest places: _id, _words, _whole, _term1, _offset1, _term2, _offset2.
    And of windows of `near` words those that have two places with terms that occur."""
    own = windows.select("_words").distinct().withColumn("_id", F.xxhash64("_words"))
    placed = own.select("_id", "_words", F.posexplode("_words").alias("_offset", "_term")).join(counts, "_term")
    by_window = placed.groupBy("_id", "_words").agg(F.array_sort(F.collect_list(F.struct("_count", "_offset", "_term"))).alias("_terms"))
    whole = F.size("_terms") == F.size("_words")
    wanted = whole if near is None else whole | ((F.size("_words") == near) & (F.size("_terms") > 1))
    second = F.coalesce(F.get("_terms", F.lit(1)), F.get("_terms", F.lit(0)))
    return by_window.where(wanted).select("_id", "_words", whole.alias("_whole"), F.col("_terms")[0]["_term"].alias("_term1"), F.col("_terms")[0]["_offset"].alias("_offset1"), second["_term"].alias("_term2"), second["_offset"].alias("_offset2"))


def _low(words_of: str):
    """The lower 32 bits of each word, as postings have them."""
    bits = lambda w: w.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.transform(words_of, lambda w: F.when(bits(w) >= 1 << 31, bits(w) - (1 << 32)).otherwise(bits(w)).cast("int"))


def occurrences(index: DataFrame, plan: DataFrame, window: int = WINDOW) -> DataFrame:
    """Where windows occur: _doc, _start, _id, _length. Both anchors' lists, shifted, must share the start, and the words must agree."""
    at = lambda k: join_small(index.withColumnRenamed("_term", f"_term{k}"), plan, f"_term{k}").withColumn("_start", F.col("_at") - F.col(f"_offset{k}")).where("_start >= 0")
    same = F.slice("_around", F.lit(window) - F.col("_offset1"), F.size("_words")) == _low("_words")
    first = at(1).where(same).select("_doc", "_start", "_id", F.size("_words").alias("_length"))
    second = at(2).select("_doc", "_start", "_id")
    return first.distinct().join(second.distinct(), ["_doc", "_start", "_id"])


def proximity(index: DataFrame, plan: DataFrame, slack: int = SLACK, missing: int = MISSING) -> DataFrame:
    """Looser matches: both anchors of a window lie within `slack` words of where the phrase would have them, and among the words around
    either at most `missing` of the window's different words are absent: _doc, _id, _start, _shift (of the second anchor). Starts are
    cut into slots of slack + 1, so each posting meets the few near it only, and copies of a text fall together before they meet."""
    wide = slack + 1
    own = cut(plan.withColumn("_low", F.array_distinct(_low("_words"))).drop("_words", "_whole"))
    held = F.size(F.array_intersect("_low", "_around")) >= F.size("_low") - missing
    at = lambda k: join_small(index.withColumnRenamed("_term", f"_term{k}"), own, f"_term{k}").where(held).select("_doc", "_id", (F.col("_at") - F.col(f"_offset{k}")).alias(f"_start{k}")).distinct()
    first = at(1).withColumn("_slot", F.explode(F.array(*[F.floor(F.col("_start1") / wide) + d for d in (-1, 0, 1)])))
    second = at(2).withColumn("_slot", F.floor(F.col("_start2") / wide))
    both = first.join(second, ["_doc", "_id", "_slot"]).where(F.abs(F.col("_start2") - F.col("_start1")) <= slack)
    return both.select("_doc", "_id", F.col("_start1").alias("_start"), (F.col("_start2") - F.col("_start1")).alias("_shift")).distinct()


def _sorted_terms(df: DataFrame, *columns: str) -> np.ndarray:
    """The distinct terms of a block of windows: at most WINDOW * BLOCK_WINDOWS numbers."""
    one = df.select(F.explode(F.array(*columns)).alias("_term")) if columns else df.select(F.explode("_words").alias("_term"))
    got = one.distinct().toArrow().column(0).to_numpy()
    return np.sort(got.view(np.uint64))


def contaminated(docs: DataFrame, benchmark: DataFrame, *columns: str, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, near: bool = False) -> tuple[DataFrame, DataFrame]:
    """For each text that holds a window: _doc, n_hit, n_items, _items (the item ids, sorted); with near, n_near_items as well, the
    number of items with proximity matches, and rows for texts that hold nothing else. And for each document the named columns, _doc
    and n_words, from the pass that counts terms."""
    windows = cut(windows_of(benchmark, item=item, text=item_text, window=window).withColumn("_id", F.xxhash64("_words")))
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    found = sizes = loose = None
    for b in range(blocks):
        mine = windows.where(F.pmod("_id", F.lit(blocks)) == b)
        terms = _sorted_terms(mine)
        counts, own = term_counts(docs, terms, *(columns if sizes is None else ()), text=text)
        sizes, counts = own if sizes is None else sizes, cut(counts)
        plan = cut(anchored(mine, counts, window if near else None))
        index = cut(postings(docs, _sorted_terms(plan, "_term1", "_term2"), text=text, window=window))
        here = occurrences(index, cut(plan.where("_whole")) if near else plan, window)
        found = here if found is None else found.unionByName(here)
        if near:
            here = proximity(index, plan.where(F.size("_words") == window)).select("_doc", "_id")
            loose = here if loose is None else loose.unionByName(here)
    found = cut(found)
    hit = found.select("_doc", F.explode(F.sequence("_start", F.col("_start") + F.col("_length") - 1)).alias("_at")).distinct().groupBy("_doc").agg(F.count("*").alias("n_hit"))
    items = lambda rows: rows.select("_doc", "_id").distinct().join(windows.select("_id", "_item"), "_id").groupBy("_doc")
    named = items(found).agg(F.array_sort(F.collect_set("_item")).alias("_items"))
    hits = hit.join(named, "_doc", "left").select("_doc", "n_hit", F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"), "_items")
    return hits if loose is None else hits.join(items(loose).agg(F.countDistinct("_item").alias("n_near_items")), "_doc", "full"), sizes


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items (items with proximity matches)."""
    hits, sizes = contaminated(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), benchmark, "_id", text="_text", window=window, near=True)
    joined = join_small(sizes.withColumnRenamed("_id", id), cut(hits), "_doc", "left")
    listed = F.sha2(F.array_join(F.coalesce("_items", F.array().cast("array<string>")), ",").cast("binary"), 256)
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(id, "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), listed.alias("items_sha256"), (hit > 0).alias("contaminated"), F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of the benchmark; their columns may have any names."""
    own, names = shield(docs)
    hits = cut(contaminated(own, benchmark, text=names[text], window=window)[0].select("_doc"))
    return unshield(join_small(own.withColumn("_doc", digest(names[text])), hits, "_doc", "left_anti"), names)
