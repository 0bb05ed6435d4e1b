"""Phrase collocation mining: how much more often words stand together than their parts stand anywhere, per language.

Texts are lower-cased (A-Z) and split into pieces at punctuation and line ends. Identical pieces of a language become one row with a
multiplicity, so copies of documents and repeated lines are read once from there on. Phrases of 1, 2, 3 and 4 words are counted level
by level. A task sends each distinct phrase of a few megabytes of pieces once, with the weights of its pieces added up, in one row for
each language and hash bucket; in each bucket DuckDB takes the rows apart and adds up the weights out of core, under a memory bound,
spilling into the shared folder. So a hot phrase arrives once for each batch that holds it, and a bucket as large as the disk allows.

A phrase can occur `least` times only if its beginning and its end without one word do. Each level therefore skips phrases whose parts
aren't marked in a bitmap of the frequent phrases of the level before. The bitmap is indexed by a hash and has at most 2^MOST_BITS bits,
whatever the corpus holds: when it fills up it only skips less. Counts don't depend on it.

Each cut of a candidate sends requests for the counts of its two parts; requests and counts meet in a join on the part, which adaptive
execution splits where a part is asked for very often. Scores are whole numbers from decimals of 38 digits. A candidate is dropped if
a longer one that holds it has `share` per cent of its occurrences: each longer candidate offers its count to its parts, the largest
offer counts. A rank within a language takes the best `top` of each task first.

Defined cases: a null text is empty, a null language `und` (and joins rows declared `und`); texts without words add nothing; words that
no punctuation parts may be of any length; ties are settled by score, then occurrences, then the phrase's bytes; repeated rows count as
often as they stand there; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.common import cut, scratch, text_or_empty

#: Where pieces end, and what parts the words of a piece.
PIECE_END = "[.,;:!?\\x0A-\\x0D]"
GAP = "[\\x20\\x09]+"
SPACED = words.byte_table([(0x20, 0x20), (0x09, 0x0D)])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The bitmap of frequent phrases has 2^MOST_BITS bits at most, 32 MB, and else some 16 bits a phrase.
MOST_BITS = 28
#: Memory of one bucket's aggregation; what is beyond goes to the shared folder.
BUCKET_MEMORY = "192MB"
#: Pieces that a task gets at once; small_batches bounds their bytes.
PIECES_AT_ONCE = 50_000

#: Rows of phrases that DuckDB takes apart at once.
ROWS_APART = 64

COUNTED = "lang string, phrase string, key long, f long"


def pieces(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The distinct pieces of each language with their multiplicity: lang, piece (words parted by one space), times."""
    lowered = F.translate(text_or_empty(text), UPPER, LOWER)
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lowered, PIECE_END)).alias("piece"))
    plain = own.select("lang", F.trim(F.regexp_replace("piece", GAP, " ")).alias("piece")).where("piece <> ''")
    return plain.groupBy("lang", "piece").agg(F.count("*").alias("times"))


def _phrase_keys(hashes: np.ndarray, piece: np.ndarray, tongue: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place where n words of one piece begin: the place, and a 64-bit key of language and words."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    last = len(hashes) - n + 1
    out = hashes[:last].copy()
    for i in range(1, n):
        out = words.mixed(out * np.uint64(0xD1342543DE82EF95) + hashes[i : last + i])
    at = np.flatnonzero(piece[:last] == piece[n - 1 :])
    return at, words.mixed(out[at] + tongue[piece[at]] + np.uint64(n))


def _tongue_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _marked(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which keys are marked in the bitmap."""
    place = keys & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct key, and the sum of its weights."""
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    return order[new], np.add.reduceat(weights[order], new)


def _keys_of(langs: list[str], phrases: list[str]) -> np.ndarray:
    """The keys of whole phrases."""
    data = "\n".join(phrases).encode()
    starts, ends, hashed = words.every(data, SPACED)
    piece = np.searchsorted(np.cumsum([len(p.encode()) + 1 for p in phrases]), starts, side="right")
    seeds = {x: _tongue_hash(x) for x in set(langs)}
    tongue = np.array([seeds[x] for x in langs], dtype=np.uint64)
    at, keys = _phrase_keys(hashed, piece, tongue, len(hashed) // max(1, len(phrases)))
    return keys


def phrase_rows(pieces: DataFrame, n: int, buckets: int, bitmap=None) -> DataFrame:
    """Phrases of n words, each once for a batch of pieces, with their weights: bucket, lang, phrases (a line each), f. Of one word also
    an empty phrase, whose weight is the number of words of a language. With a bitmap (broadcast), only phrases of which both parts of
    n - 1 words are marked."""

    def found(hashed, starts, ends, piece, tongue, weight, seeds, data):
        """The distinct phrases of a run of pieces: keys, weights, languages, hashes of first words, phrases."""
        at, keys = _phrase_keys(hashed, piece, seeds[tongue], n)
        if bitmap is not None and len(at):
            shorter, known = _phrase_keys(hashed, piece, seeds[tongue], n - 1)
            good = np.zeros(len(hashed) + 1, dtype=bool)
            good[shorter] = _marked(known, bitmap.value)
            keep = good[at] & good[at + 1]
            at, keys = at[keep], keys[keep]
        if not len(at):
            return None
        lead, total = _sums(keys, weight[piece[at]])
        place = at[lead]
        return keys[lead], total, tongue[piece[place]], hashed[place], [data[b:e] for b, e in zip(starts[place].tolist(), ends[place + n - 1].tolist())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tongues = batch.column(0).dictionary_encode()
            names = tongues.dictionary.to_pylist()
            own, times = tongues.indices.to_numpy(), batch.column(2).to_numpy()
            seeds = np.array([_tongue_hash(x) for x in names], dtype=np.uint64)
            parts, size = [], np.zeros(len(names), dtype=np.int64)
            for first, texts in words.runs(batch.column(1)):
                data = b"\n".join(texts)
                starts, ends, hashed = words.every(data, SPACED)
                piece = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
                tongue, weight = own[first : first + len(texts)], times[first : first + len(texts)]
                np.add.at(size, tongue[piece], weight[piece])
                parts.append(found(hashed, starts, ends, piece, tongue, weight, seeds, data))
            rows = [(0, names[i], b"", [size[i]]) for i in range(len(names))] if n == 1 else []
            parts = [x for x in parts if x]
            if parts:
                keys, total, tongue, lead = (np.concatenate(x) for x in list(zip(*parts))[:4])
                phrases = [x for part in parts for x in part[4]]
                some, total = _sums(keys, total)
                bucket, tongue = (keys[some] >> np.uint64(32)) % np.uint64(buckets), tongue[some]
                order = np.lexsort((lead[some], bucket, tongue))  # phrases that begin alike stand together
                bucket, tongue, total, some = bucket[order], tongue[order], total[order], some[order]
                ends = np.flatnonzero(np.concatenate([(np.diff(bucket) != 0) | (np.diff(tongue) != 0), [True]])) + 1
                at = 0
                for end in ends.tolist():
                    rows.append((int(bucket[at]), names[tongue[at]], b"\n".join([phrases[i] for i in some[at:end].tolist()]), total[at:end]))
                    at = end
            if rows:
                kinds, langs, joined, f = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(langs, pa.string()), pa.array(joined, pa.binary()).cast(pa.string()), pa.array(f, pa.list_(pa.int64()))], names=["bucket", "lang", "phrases", "f"])

    return pieces.select("lang", "piece", "times").mapInArrow(read, "bucket int, lang string, phrases string, f array<long>")


def added_up(rows: DataFrame, least: int, spill: str) -> DataFrame:
    """Weights of equal phrases added up by DuckDB in each hash bucket: lang, phrase (null: all words), key, f. Phrases of fewer than
    `least` go."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return
        own = f"{spill}/{uuid.uuid4().hex}"

        def all_batches():  # in small parts, as DuckDB takes apart as many rows at once as it gets
            for batch in chain([first], batches):
                for at in range(0, batch.num_rows, ROWS_APART):
                    yield batch.slice(at, ROWS_APART)

        con = duckdb.connect(config={"memory_limit": BUCKET_MEMORY, "threads": 1, "temp_directory": own, "preserve_insertion_order": False})
        try:
            con.register("bucket", pa.RecordBatchReader.from_batches(first.schema, all_batches()))
            summed = con.sql(f"SELECT lang, phrase, CAST(sum(f) AS BIGINT) AS f FROM (SELECT lang, unnest(string_split(phrases, chr(10))) AS phrase, unnest(f) AS f FROM bucket) GROUP BY lang, phrase HAVING sum(f) >= {int(least)} OR phrase = ''")
            for batch in summed.to_arrow_reader(20_000):
                langs, phrases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                real, keys = [i for i, p in enumerate(phrases) if p], np.zeros(len(phrases), dtype=np.uint64)
                keys[real] = _keys_of([langs[i] for i in real], [phrases[i] for i in real])
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([p or None for p in phrases], pa.string()), pa.array(keys.view(np.int64)), batch.column(2)], names=["lang", "phrase", "key", "f"])
        finally:
            con.close()
            shutil.rmtree(own, ignore_errors=True)

    return rows.repartition("bucket").mapInArrow(add, COUNTED)


def frequent_bits(spark: SparkSession, frequent: DataFrame):
    """A broadcast bitmap, indexed by the lower bits of the key, in which all keys of `frequent` are marked. Its words are made by a
    grouped aggregation, so the driver gets at most 2^MOST_BITS bits."""
    bits = min(MOST_BITS, max(16, (16 * frequent.count()).bit_length()))
    place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    got = frequent.select(place.alias("place")).groupBy(F.expr("shiftright(place, 6)").alias("word")).agg(F.bit_or(one).alias("mask")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.uint64)
    bitmap[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bitmap)


def spill_folder(path: str) -> str:
    """path, which lies in the shared folder, as DuckDB can write it."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path} isn't a mounted folder: name one that all executors share in `spill`")
    return parts.path


def counts(docs: DataFrame, *, least: int = 30, longest: int = 4, text: str = "text", lang: str = "lang", spill: str | None = None) -> DataFrame:
    """lang, phrase, f, and words (the phrase's number of words) of phrases that occur at least `least` times; and with a null phrase
    and words = 0, the number of words of each language."""
    spark, levels, bitmap = docs.sparkSession, [], None
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark, "phrases") as path:
        pieces(docs, text=text, lang=lang).write.option("compression", "zstd").parquet(f"{path}/pieces")
        own = spark.read.parquet(f"{path}/pieces")
        folder = spill or f"{spill_folder(path)}/spill"
        os.makedirs(folder, exist_ok=True)
        for n in range(1, longest + 1):
            level = cut(added_up(phrase_rows(own, n, buckets, bitmap), least, folder), rows=PIECES_AT_ONCE)
            levels.append(level.select("lang", "phrase", "f", F.when(F.col("phrase").isNull(), 0).otherwise(n).alias("words")))
            if bitmap is not None:
                bitmap.unpersist()
            if n < longest:
                bitmap = frequent_bits(spark, level.where("phrase is not null"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _slice(n, first: Column, length: Column) -> Column:
    return F.array_join(F.slice(n, first, length), " ")


def collocations(docs: DataFrame, *, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000, text: str = "text", lang: str = "lang", spill: str | None = None) -> DataFrame:
    """The best `top` phrases of 2 to `longest` words of each language: lang, rank, phrase, a (its occurrences), l and r (those of the
    parts at the cut that scores least), n (words of the language), score. `spill`: a folder that all executors share, where the one
    of the checkpoints isn't a mounted path."""
    counted = counts(docs, least=least, longest=longest, text=text, lang=lang, spill=spill)
    whole = counted.where("phrase is not null").select("lang", "phrase", "f", "words")
    found = whole.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = found.select("lang", "phrase", "a", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("_k"))
    requests = cuts.select("lang", "phrase", "a", "_k", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), _slice("_w", F.lit(1), F.col("_k")).alias("part")),
        F.struct(F.lit("r").alias("side"), _slice("_w", F.col("_k") + 1, F.size("_w") - F.col("_k")).alias("part")))).alias("_ask"))
    answers = requests.select("lang", "phrase", "a", "_k", F.col("_ask.side").alias("_side"), F.col("_ask.part").alias("_part")).join(whole.select("lang", F.col("phrase").alias("_part"), "f"), ["lang", "_part"])
    # At most 2 * (longest - 1) answers a phrase; sorted, those of a cut stand side by side, left part first.
    sides = answers.groupBy("lang", "phrase", "a").agg(F.array_sort(F.collect_list(F.struct("_k", "_side", "f"))).alias("_s"))
    at = F.expr("transform(sequence(0, size(_s) div 2 - 1), i -> struct(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(_s[2 * i].f as decimal(20,0)) + _s[2 * i + 1].f) as score, _s[2 * i]._k as k, _s[2 * i].f as l, _s[2 * i + 1].f as r))")
    scored = sides.select("lang", "phrase", "a", F.array_min(at).alias("_b"))
    # Every proper part of a longer candidate, of two words or more, is offered its count.
    part = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("_w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("_w") - m + 1), lambda i: _slice("_w", i, m)))))
    offers = found.where(F.size("_w") > 2).select("lang", "a", part.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    covered = F.coalesce(F.expr(f"cast(100 as decimal(10,0)) * cast(_longer as decimal(20,0)) >= cast({share} as decimal(10,0)) * cast(a as decimal(20,0))"), F.lit(False))
    kept = scored.join(offers, ["lang", "phrase"], "left").where(~covered).select("lang", "phrase", "a", "_b.l", "_b.r", "_b.score")
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    total = counted.where("phrase is null").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
