"""A quality classifier from weak labels.

Eight heuristic labellers vote good, bad or nothing on a document, each on another trait of its text. Expectation-maximisation
estimates how each of them votes on good and on bad documents and how many are good, from the counts of the vote patterns alone (at
most 3^8 of them, counted over all documents by one grouped aggregation). The posterior of a pattern labels its documents, and these
labels train a linear scorer over hashed features of the whole text: words, trigrams of character classes, and how words repeat.

Texts are read twice. The first pass counts patterns and takes the features of the rows whose id's hash falls below FIT_ROWS / rows;
the second gives every document its votes and its score. Both work on whole runs of texts with arrays, so no text becomes words in
Python.

Defined cases: null, empty or wordless texts have score 0 and aren't kept; if all rows fall into one class, that posterior is the score
of all; repeated rows each get their row; null ids hash like any value; an empty table gives an empty table; other columns are kept,
but one with the name of an added column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.common import cut, shield, unshield

#: Hashed words, trigrams of seven character classes, and three more features.
WORD_CELLS, TRIGRAMS, MORE = 1 << 12, 7**3, 3
FIT_ROWS = 8_000
#: Kept from this score on.
LEAST = 0.5
LABELLERS = 8

#: Character classes: white space, lower and upper letters, digits, sentence marks, other marks, non-ASCII.
_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[ord(c) for c in ".,;:?'\""]] = 4


def _bytes_of(marks: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in marks]] = True
    return table


#: Marks that prose hardly has, marks that end a sentence, marks of tables.
_MARKS, _ENDS, _BARS = _bytes_of("#$%&*!|~^_=+<>{}[]\\/@"), _bytes_of(".!?"), _bytes_of("|\t")


class Run:
    """Counts over a run of texts; every attribute has one value a text, owner one a word."""

    def __init__(self, parts: list[bytes]) -> None:
        data = b"\n".join(parts)
        raw = np.frombuffer(data, dtype=np.uint8)
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size + 1)[:-1]])
        self.kind, texts = _CLASS[raw], len(parts)
        starts, ends, self.hash = words.every(data.lower(), words.SPACED)
        self.owner = np.searchsorted(self.begin, starts, side="right") - 1
        by_text = lambda flag: np.bincount(self.owner[flag], minlength=texts)
        first, last, length = raw[starts], raw[ends - 1], ends - starts
        second, before = raw[np.minimum(starts + 1, ends - 1)], raw[np.maximum(ends - 2, starts)]
        self.words = np.bincount(self.owner, minlength=texts)
        self.sentences = by_text(_ENDS[last])
        self.marked = by_text((length > 1) & _MARKS[last] & _MARKS[before])
        self.shouted = by_text((length > 1) & (_CLASS[first] == 2) & (_CLASS[second] == 2))
        self.barred = by_text((length == 1) & (first == ord("|")))
        self.repeated = np.bincount(self.owner[1:][(self.hash[1:] == self.hash[:-1]) & (self.owner[1:] == self.owner[:-1])], minlength=texts)
        self.kinds = self._distinct(self.hash, self.owner, texts)
        line, _, of_line = words.every(data, words.LINES)
        own = np.searchsorted(self.begin, line, side="right") - 1
        self.lines, self.line_kinds = np.bincount(own, minlength=texts), self._distinct(of_line, own, texts)
        self.marks, self.bars, self.upper, self.lower = (self._bytes(x) for x in (_MARKS[raw], _BARS[raw], self.kind == 2, self.kind == 1))

    @staticmethod
    def _distinct(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        at = np.unique(words.mixed(values + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)[1]
        return np.bincount(owner[at], minlength=texts)

    def _bytes(self, flag: np.ndarray) -> np.ndarray:
        if len(self.size) == 1:
            return np.array([np.count_nonzero(flag)])
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
        return sums[self.begin + self.size] - sums[self.begin]

    def votes(self) -> np.ndarray:
        """A row for each text: 1 good, 0 bad, -1 no vote."""
        share = lambda a, b: a / np.maximum(b, 1)
        size, n = np.maximum(self.size, 1), np.maximum(self.words, 1)
        marks, marked = self.marks / size, self.marked / n
        upper, shouted = share(self.upper, self.upper + self.lower), self.shouted / n
        ends, again, kinds = self.sentences / n, self.repeated / n, self.kinds / n
        bars, barred, lines = self.bars / size, self.barred / n, share(self.line_kinds, self.lines)
        rules = [
            ((marks < 0.01) & (marked < 0.02), (marks > 0.04) | (marked > 0.08)),
            ((upper < 0.1) & (shouted < 0.05), (upper > 0.3) | (shouted > 0.2)),
            ((ends > 0.02) & (ends < 0.4), (ends == 0) | (ends >= 0.6)),
            (again < 0.02, again > 0.08),
            (kinds > 0.35, kinds < 0.15),
            ((bars < 0.001) & (barred < 0.01), (bars > 0.01) | (barred > 0.05)),
            (lines > 0.8, (lines < 0.5) & (self.lines > 4)),
            (self.words >= 30, self.words < 4),
        ]
        return np.stack([np.where(bad, 0, np.where(good, 1, -1)) for good, bad in rules], axis=1)

    def word_cells(self) -> np.ndarray:
        return (self.hash >> np.uint64(52)).astype(np.int64)

    def trigrams(self) -> np.ndarray:
        """Square roots of the shares of the trigrams of character classes, [text, trigram]."""
        k, texts = self.kind.astype(np.int32), len(self.size)
        if texts == 1:
            total = sum((np.bincount(k[a : a + words.SPAN + 2][:-2] * 49 + k[a : a + words.SPAN + 2][1:-1] * 7 + k[a : a + words.SPAN + 2][2:], minlength=TRIGRAMS) for a in range(0, max(len(k) - 2, 0), words.SPAN)), np.zeros(TRIGRAMS, dtype=np.int64))[None, :]
        else:
            own = np.repeat(np.arange(texts), np.maximum(self.size - 2, 0))
            at = np.arange(len(own)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(self.size - 2, 0))[:-1]]), np.maximum(self.size - 2, 0)) + self.begin[own]
            total = np.bincount(own * TRIGRAMS + k[at] * 49 + k[at + 1] * 7 + k[at + 2], minlength=texts * TRIGRAMS).reshape(texts, TRIGRAMS)
        return np.sqrt(total / np.maximum(total.sum(axis=1, keepdims=True), 1))

    def more(self) -> np.ndarray:
        n = np.maximum(self.words, 1)
        return np.sqrt(np.stack([self.repeated / n, self.kinds / n, np.minimum(1.0, self.words / 1000)], axis=1))

    def features(self, i: int, trigrams: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of one text's features."""
        cells, counts = np.unique(self.word_cells()[self.owner == i], return_counts=True)
        three = np.flatnonzero(trigrams[i])
        return np.concatenate([cells, WORD_CELLS + three, WORD_CELLS + TRIGRAMS + np.arange(MORE)]), np.concatenate([counts / max(self.words[i], 1), trigrams[i][three], more[i]])

    def scores(self, weights: np.ndarray, intercept: float) -> np.ndarray:
        word = np.bincount(self.owner, weights=weights[:WORD_CELLS][self.word_cells()], minlength=len(self.size)) / np.maximum(self.words, 1)
        z = word + self.trigrams() @ weights[WORD_CELLS : WORD_CELLS + TRIGRAMS] + self.more() @ weights[WORD_CELLS + TRIGRAMS :] + intercept
        return np.where(self.words > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def codes(votes: np.ndarray) -> np.ndarray:
    """One number a pattern of votes, in base 3."""
    return ((votes + 1) * 3 ** np.arange(LABELLERS)).sum(axis=1)


def pattern(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(LABELLERS) % 3 - 1


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """patterns: rows of votes 0, 1 or -1 (none). Returns the posterior of good for each pattern, P(vote | class) as
    [labeller, class, vote + 1], and the share of good. At the start two bad votes make a document bad, so class 1 is the good one."""
    n, k = patterns.shape
    good = np.choose(np.minimum((patterns == 0).sum(1), 2), [0.95, 0.5, 0.05])
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    table, prior = np.zeros((k, 2, 3)), 0.5
    for _ in range(rounds):
        weights = np.stack([(1 - good) * counts, good * counts])
        table = np.einsum("cn,nkv->kcv", weights, hot) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        prior = (weights[1].sum() + 1) / (counts.sum() + 2)
        logs = np.einsum("nkv,kcv->nc", hot, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good, table, prior


def survey(docs: DataFrame, fit: Column, text: str) -> DataFrame:
    """_code and _n, the counts of vote patterns, at most one row a task and pattern; and for the rows that `fit` marks and that have
    words: _code, _at and _values, the features."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros(3**LABELLERS, dtype=np.int64), ["_code", "_n", "_at", "_values"]
        lists = pa.list_(pa.int32()), pa.list_(pa.float64())
        for batch in batches:
            chosen = batch.column(1).to_numpy(zero_copy_only=False)
            for first, parts in words.runs(batch.column(0)):
                run = Run(parts)
                code = codes(run.votes())
                np.add.at(total, code, 1)
                mine = np.flatnonzero(chosen[first : first + len(parts)].astype(bool) & (run.words > 0))
                if len(mine):
                    three, more = run.trigrams(), run.more()
                    found = [run.features(i, three, more) for i in mine]
                    yield pa.RecordBatch.from_arrays([pa.array(code[mine].astype(np.int32)), pa.nulls(len(mine), pa.int64()), pa.array([f[0].astype(np.int32) for f in found], lists[0]), pa.array([f[1] for f in found], lists[1])], names=names)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some]), pa.nulls(len(some), lists[0]), pa.nulls(len(some), lists[1])], names=names)

    return docs.select(F.col(text).cast("string"), fit).mapInArrow(read, "_code int, _n long, _at array<int>, _values array<double>")


def train(sample: DataFrame, posterior: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of the scorer; each row counts as good and as bad, by its posterior."""
    width = WORD_CELLS + TRIGRAMS + MORE
    vector = F.udf(lambda at, values: Vectors.sparse(width, at, values), VectorUDT())
    good = F.get(F.lit(posterior), F.col("_code"))
    rows = sample.select(vector("_at", "_values").alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), good.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - good).alias("w")))).alias("l"))
    model = LogisticRegression(weightCol="w", regParam=1e-4, maxIter=50, standardization=False).fit(rows.select("features", "l.label", "l.w"))
    return model.coefficients.toArray(), float(model.intercept)


def classify(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with _votes (array of 0, 1, -1), _posterior (of good, from the votes), _score and _kept."""
    own, names = shield(docs)
    rows = own.count()
    share = int(min(1.0, FIT_ROWS / max(rows, 1)) * (1 << 30)) + 1
    seen = cut(survey(own, F.pmod(F.xxhash64(F.col(names[id]), F.lit("fit")), F.lit(1 << 30)) < share, names[text]))
    counted = seen.where("_n is not null").groupBy("_code").agg(F.sum("_n").alias("_n")).toPandas()
    posterior = np.zeros(3**LABELLERS)
    if len(counted):
        code = counted["_code"].to_numpy()
        posterior[code] = em(pattern(code), counted["_n"].to_numpy(dtype=float))[0]
    sample = seen.where("_n is null")
    tally = sample.groupBy("_code").count().toPandas()
    mass, n = float((posterior[tally["_code"]] * tally["count"]).sum()) if len(tally) else 0.0, int(tally["count"].sum())
    weights, intercept = np.zeros(WORD_CELLS + TRIGRAMS + MORE), 0.0
    if n and min(mass, n - mass) >= 1e-6:
        weights, intercept = train(sample, posterior)
    elif n:  # one class only
        intercept = float(np.log(max(mass / n, 1e-12) / max(1 - mass / n, 1e-12)))

    @F.arrow_udf("code int, posterior double, score double")
    def judge(texts: pa.Array) -> pa.Array:
        code, score = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for _, parts in words.runs(texts):
            run = Run(parts)
            code.append(codes(run.votes()))
            score.append(run.scores(weights, intercept))
        code = np.concatenate(code)
        return pa.StructArray.from_arrays([pa.array(code.astype(np.int32)), pa.array(posterior[code]), pa.array(np.concatenate(score))], names=["code", "posterior", "score"])

    judged = own.withColumn("_judged", judge(F.col(names[text]).cast("string")))
    votes = F.array(*[(F.floor(F.col("_judged.code") / 3**k) % 3 - 1).cast("int") for k in range(LABELLERS)])
    return unshield(judged, names, _votes=votes, _posterior=F.col("_judged.posterior"), _score=F.col("_judged.score"), _kept=F.col("_judged.score") >= LEAST)
