"""Token counts with a digest cache.

The cache is a Parquet table of (digest of the normalised content, digest of the tokenizer file, bytes, tokens). Documents are joined
to it by digest; of each text that it lacks, one copy is encoded, and the counts are appended, so a second run over the same corpus
encodes nothing. A row whose text occurs once is encoded where it is read, and of repeated texts the row with the smallest id is. Which
rows are left out is broadcast, or where these are too many a filter of them; then only the texts that it leaves out by mistake move.

Normalised content: white-space runs become one space if the tokenizer's own normalizer says that they are one (it replaces \\s+ by a
space); else the text as it is. Such a tokenizer also never joins across white space, so a text is counted word by word, through a
bounded memo of (64-bit hash of the word, tokens) which the library fills; words of more than LONG bytes are always encoded. Other
tokenizers encode whole texts. Texts become Python objects a megabyte at a time, and Spark hands them over in batches of a few
megabytes, so a worker's memory follows neither the length of a batch nor that of the corpus.

Defined cases: null counts as empty, 0 tokens; very long texts need memory for their words only; repeated rows are counted once and
each reported; null ids are ids like others; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidemark.llm import words
from tidemark.llm.common import WHITE_SPACE, cut, gathered, join_small, rows_without, small_batches, text_or_empty

#: Words that a worker remembers, 12 bytes each; when it is full it starts anew.
MEMO_WORDS = 2_000_000
#: Bytes of the longest word that is remembered.
LONG = 64
#: Words that are handed to the library at once.
ENCODE_WORDS = 256
SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

_SPACE = re.compile(rb"[ \t-\r]")
_loaded: dict[str, object] = {}
_memos: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def splits_at_space(path: str) -> bool:
    """Whether the tokenizer drops white space and never joins what stands on its sides."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norms = (spec.get("normalizer") or {}).get("normalizers") or []
    one_space = any(x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " " for x in norms)
    pres = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    dropped = pres[0].get("type") == "Split" and pres[0].get("behavior") == "Removed" and "[^\\s" in str((pres[0].get("pattern") or {}).get("Regex"))
    plain = all(not any(c.isspace() for c in x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec.get("added_tokens") or [])
    return one_space and dropped and plain


def tokenizer_of(path: str):
    """The library's tokenizer; loaded once per worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[path] = tokenizer
    return _loaded[path]


def count_whole(texts: list[str], path: str) -> list[int]:
    """Token counts of whole texts."""
    tokenizer = tokenizer_of(path)
    if path.endswith(".model"):
        return [len(x) for x in tokenizer.encode(texts, num_threads=1)]
    return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def count_words(pieces: list[str], path: str) -> np.ndarray:
    """Token counts of words without white space, for a tokenizer that splits at it: the words are encoded in one text, and a token
    belongs to the word in which it starts."""
    tokenizer, out = tokenizer_of(path), []
    for at in range(0, len(pieces), ENCODE_WORDS):
        some = pieces[at : at + ENCODE_WORDS]
        begins = np.array([o[0] for o in tokenizer.encode(" ".join(some), add_special_tokens=False).offsets], dtype=np.int64)
        ends = np.cumsum([len(w) + 1 for w in some])
        out.append(np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(some)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def spans(text: bytes) -> Iterator[bytes]:
    """The text in parts of some SPAN bytes, cut at white space."""
    at = 0
    while len(text) - at > words.SPAN:
        gap = _SPACE.search(text, at + words.SPAN)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def _word_tokens(data: bytes, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of data, and their tokens; fills the memo."""
    starts, ends, hashed = words.located(np.frombuffer(data, dtype=np.uint8), words.SPACED)
    own = lambda at: [data[starts[i] : ends[i]].decode("utf-8", "replace") for i in at]
    tokens = np.zeros(len(starts), dtype=np.int64)
    long = ends - starts > LONG
    far, near = np.flatnonzero(long), np.flatnonzero(~long)
    tokens[far] = count_words(own(far), path)
    kinds, first, back = np.unique(hashed[near], return_index=True, return_inverse=True)
    keys, counts = _memos.get(path, (np.zeros(0, np.uint64), np.zeros(0, np.int32)))
    if len(keys) + len(kinds) > MEMO_WORDS:
        keys, counts = keys[:0], counts[:0]
    place = np.searchsorted(keys, kinds)
    known = keys[np.minimum(place, len(keys) - 1)] == kinds if len(keys) else np.zeros(len(kinds), dtype=bool)
    each = np.zeros(len(kinds), dtype=np.int32)
    each[known] = counts[place[known]]
    each[~known] = count_words(own(near[first[~known]]), path)
    _memos[path] = np.insert(keys, place[~known], kinds[~known]), np.insert(counts, place[~known], each[~known])
    tokens[near] = each[back]
    return starts, tokens


def count_by_word(texts: list[bytes], path: str) -> np.ndarray:
    """Token counts of one run of texts."""
    if len(texts) == 1:
        return np.array([sum(int(_word_tokens(part, path)[1].sum()) for part in spans(texts[0]))])
    starts, tokens = _word_tokens(b"\n".join(texts), path)
    before = np.concatenate([[0], np.cumsum(tokens)])
    return np.diff(before[np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))])


def encode_rows(rows: DataFrame, path: str, by_word: bool) -> DataFrame:
    """rows (digest, _text) to (digest, n_bytes, n_tokens)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in words.runs(batch.column(1)):
                counts = count_by_word(texts, path) if by_word else count_whole([t.decode("utf-8", "replace") for t in texts], path)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["digest", "n_bytes", "n_tokens"])

    return rows.mapInArrow(read, "digest binary, n_bytes long, n_tokens long")


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """The cache's rows for one tokenizer; none if there is no cache yet."""
    try:
        stored = spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], SCHEMA)
    return stored.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def row_key() -> Column:
    """A row by its id and digest."""
    return F.unhex(F.sha2(F.concat_ws(":", F.hex("digest"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))).cast("binary"), 256))


def token_counts(docs: DataFrame, path: str, cache: str, *, id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit. What the cache at `cache` lacked is appended to it."""
    spark, version, by_word = docs.sparkSession, file_digest(path), splits_at_space(path)
    content = F.regexp_replace(text_or_empty(text), F.lit(WHITE_SPACE), F.lit(" ")) if by_word else text_or_empty(text)
    read = docs.select(F.col(id).alias("_id"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), content.alias("_text")).withColumn("digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    slim = cut(read.select("_id", "n_bytes", "digest"))
    digests = slim.groupBy("digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    known = cached(spark, cache, version)
    # Rows that are not to be encoded: of texts in the cache, and copies of another row.
    judged = slim.select("_id", "digest").join(digests.join(known.select("digest", F.lit(True).alias("_known")), "digest", "left").where("_known or _rows > 1"), "digest")
    many = slim.count()
    skip = cut(gathered(judged.where("_known or not _id <=> _first").select(row_key().alias("_row")).distinct(), many))
    rows = rows_without(read.withColumn("_row", row_key()), slim.select(row_key().alias("_row")), skip, "_row")
    with small_batches(spark):
        encode_rows(rows.select("digest", "_text"), path, by_word).withColumn("tokenizer", F.lit(version)).select(*SCHEMA.names).write.mode("append").parquet(cache)
    counts = cut(gathered(cached(spark, cache, version).join(digests.select("digest"), "digest", "left_semi"), many))
    joined = join_small(slim, counts, "digest").select(F.col("_id").alias(id), "n_bytes", "n_tokens")
    return joined.withColumn("over_limit", F.col("n_tokens") > limit)
