"""Spelling variants by a symmetric-delete join.

Runs of letters are read from whole texts, lower-cased (A-Z) and, by the contract, damaged where a checksum of document and run says so.
A task sends each distinct word of a megabyte of text once, with its number; sums over all documents give the words that count.

Every word emits a key for itself and one for each distinct result of deleting one letter, with the places whose deletion gives it (a
run of equal letters). A key is a 64-bit hash, made for all places of a word in one pass, so a long word costs memory and shuffle in
proportion to its length, not to its square. Two words that share a key and a place differ by that one letter: replaced, where both
deleted it, or inserted, where one of them is whole. The strings are compared afterwards, which settles collisions. A pair meets at one
key alone, so no pair is found twice. What shares a key is bounded by the letters and places of a word, not by the corpus.

Aggregates over the near words give each word's form; pointers to forms are then doubled in joins until they stand still, which takes
some five rounds at most, as every step multiplies the number of occurrences.

Defined cases: null texts have no runs; a null id counts as an empty one in the checksum; runs of any length; equal occurrences of near
words are settled by code points; repeated rows count as often as they stand there; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.common import cut, gathered, join_small

#: Every DAMAGED-th checksum loses a letter; words have LETTERS at least and occur OCCURRENCES times; a form has FACTOR times more.
DAMAGED, LETTERS, OCCURRENCES, FACTOR = 199, 6, 5, 5
#: Bytes of the longest run whose checksum is worked out together with others.
TOGETHER = 64

_ASCII = np.zeros(256, dtype=bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True
_BETWEEN = re.compile(rb"[^A-Za-z\x80-\xFF]")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1)).astype(np.uint32)
    return table


_CRC = _crc_table()


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to letters A-Z, a-z or U+00C0 to U+00FF; the latter are those with the lead byte C3."""
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    return inside


def checksums(before: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each run, going on from the crc32 of what stands before it."""
    flat, sizes = np.frombuffer(data, dtype=np.uint8), ends - starts
    out = before ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-np.minimum(sizes, TOGETHER + 1), kind="stable")
    short = order[np.searchsorted(-sizes[order], -TOGETHER) :] if len(order) else order
    state, at, left = out[short], starts[short], sizes[short]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j))  # those longer than j come first
        state[:n] = _CRC[(state[:n] ^ flat[at[:n] + j]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out[short] = state
    out ^= np.uint32(0xFFFFFFFF)
    for i in order[: len(order) - len(short)].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]], int(before[i]))
    return out


def parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of some SPAN bytes, cut where no run can be."""
    at = 0
    while len(text) - at > words.SPAN:
        gap = _BETWEEN.search(text, at + words.SPAN)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def _counted(ids: list[bytes], texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of some texts after the damage, and how often each occurs; words of fewer than LETTERS are left out."""
    data = b"\n".join(texts).lower()
    flat = np.frombuffer(data, dtype=np.uint8)
    starts, ends, hashed = words.marked(flat, letters(flat))
    tails = np.concatenate([[0], np.cumsum((flat & 0xC0) == 0x80)])
    size = (ends - starts) - (tails[ends] - tails[starts])
    long = np.flatnonzero(size >= LETTERS)
    starts, ends, hashed, size = starts[long], ends[long], hashed[long], size[long]
    prefix = np.array([zlib.crc32(b"%b:" % i) for i in ids], dtype=np.uint32)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    sums = checksums(prefix[doc], data, starts, ends)
    hit = sums % DAMAGED == 0
    whole = np.flatnonzero(~hit)
    _, first, n = np.unique(hashed[whole], return_index=True, return_counts=True)
    found = [data[s:e] for s, e in zip(starts[whole[first]].tolist(), ends[whole[first]].tolist())]
    damaged = []
    for i in np.flatnonzero(hit & (size > LETTERS)).tolist():
        run, p = data[starts[i] : ends[i]].decode(), int(sums[i]) % int(size[i])
        damaged.append((run[:p] + run[p + 1 :]).encode())
    return found + damaged, np.concatenate([n, np.ones(len(damaged), dtype=np.int64)])


def vocabulary(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = OCCURRENCES) -> DataFrame:
    """The words that occur at least `least` times: word, n."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.encode() for x in batch.column(0).to_pylist()]
            for first, texts in words.runs(batch.column(1)):
                whole = [(ids[first : first + len(texts)], texts)] if len(texts) > 1 else [(ids[first : first + 1], [p]) for p in parts(texts[0])]
                for own, some in whole:
                    found, n = _counted(own, some)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    own = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")), F.col(text).cast("string")).mapInArrow(read, "word string, n long")
    return own.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def deletion_keys(batch_ids: np.ndarray, lists: list[bytes]) -> tuple[np.ndarray, ...]:
    """For words in Latin-1: (key, id, lo, hi) of each whole word (lo 0, hi the largest int) and each distinct single deletion, which
    the letters lo to hi give."""
    flat = np.frombuffer(b"".join(lists), dtype=np.uint8)
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    word = np.repeat(np.arange(len(lists)), sizes)
    start = np.cumsum(sizes) - sizes
    power, inverse = words._power_tables(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(words._BYTE[flat] * power[: len(flat)], out=sums[1:])
    base = inverse[start]
    whole = (sums[start + sizes] - sums[start]) * base
    place = np.arange(len(flat))
    local = place - start[word]
    # What stands behind the place moves one to the front.
    less = (sums[place] - sums[start[word]]) * base[word] + (sums[(start + sizes)[word]] - sums[place + 1]) * base[word] * inverse[1]
    new = np.flatnonzero((local == 0) | (flat != np.concatenate([flat[:1], flat[:-1]])))
    until = np.minimum(np.concatenate([new[1:], [len(flat)]]), (start + sizes)[word[new]]) - 1
    key = np.concatenate([words.mixed(whole + sizes.astype(np.uint64)), words.mixed(less[new] + (sizes[word[new]] - 1).astype(np.uint64))])
    lo = np.concatenate([np.zeros(len(lists), dtype=np.int64), local[new]])
    hi = np.concatenate([np.full(len(lists), 2**31 - 1, dtype=np.int64), until - start[word[new]]])
    return key.view(np.int64), np.concatenate([batch_ids, batch_ids[word[new]]]), lo.astype(np.int32), hi.astype(np.int32)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """All pairs of words (_id, word) at a distance of exactly one letter: _a < _b. The vocabulary must be cut."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in deletion_keys(batch.column(0).to_numpy(), batch.column(1).to_pylist())], names=["_key", "_a", "_lo", "_hi"])

    keys = cut(vocabulary.select("_id", F.encode("word", "ISO-8859-1")).mapInArrow(emit, "_key long, _a long, _lo int, _hi int"))
    other = keys.select("_key", F.col("_a").alias("_b"), F.col("_lo").alias("_lo2"), F.col("_hi").alias("_hi2"))
    met = keys.join(other, "_key").where((F.col("_a") < F.col("_b")) & (F.greatest("_lo", "_lo2") <= F.least("_hi", "_hi2")))
    pairs = met.select("_a", "_b")
    for end in ("_a", "_b"):
        pairs = join_small(pairs, vocabulary.select(F.col("_id").alias(end), F.col("word").alias(f"_word{end}"), F.col("n").alias(f"_n{end}")), end)
    return pairs.where(F.levenshtein("_word_a", "_word_b", 1) == 1)


def roots(pointers: DataFrame) -> DataFrame:
    """(_id, _to, _root) with the pointers (_id, _to, _root: the word of _to), which are cut, followed to their ends."""
    moved, rows = True, pointers.count()
    while moved:
        onward = pointers.select(F.col("_id").alias("_to"), F.col("_to").alias("_next"), F.col("_root").alias("_far"))
        followed = join_small(pointers.drop("_moved"), onward, "_to", "left").select("_id", F.coalesce("_next", "_to").alias("_to"), F.coalesce("_far", "_root").alias("_root"), F.col("_next").isNotNull().alias("_moved"))
        pointers = cut(gathered(followed, rows))
        moved = not pointers.where("_moved").isEmpty()
    return pointers.drop("_moved")


def variants(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = OCCURRENCES, factor: int = FACTOR) -> DataFrame:
    """One row per word: word, form (the near word of most occurrences, if it has `factor` times the word's), root (the last form), n,
    n_near (near words), form_n."""
    known = cut(vocabulary(docs, id=id, text=text, least=least).withColumn("_id", F.monotonically_increasing_id()))
    pairs = near_pairs(known)
    side = lambda a, b: F.struct(F.col(a).alias("_id"), F.col(f"_n{a}").alias("_n"), F.col(b).alias("_to"), F.col(f"_word{b}").alias("_form"), F.col(f"_n{b}").alias("_form_n"))
    sides = F.inline(F.array(side("_a", "_b"), side("_b", "_a")))
    best = F.min(F.struct((-F.col("_form_n")).alias("_less"), "_form", "_to"))
    near = cut(pairs.select(sides).groupBy("_id", "_n").agg(F.count("*").alias("n_near"), best.alias("_best")))
    enough = -F.col("_best._less") >= factor * F.col("_n")
    linked = near.where(enough).select("_id", F.col("_best._to").alias("_to"), F.col("_best._form").alias("_root"))
    ends = roots(linked)
    joined = join_small(known, near.select("_id", "n_near", F.when(enough, F.col("_best._form")).alias("form"), F.when(enough, -F.col("_best._less")).alias("form_n")), "_id", "left")
    joined = join_small(joined, ends.select("_id", "_root"), "_id", "left")
    return joined.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
