"""Language ID by fusing evidence in Bayes' way.

For each language l the posterior is proportional to

    P(l | host) * P(text | l)^(SEEN / n) * P(declared | l) * P(address | l)

P(text | l): byte trigrams of the whole text, hashed, under a model of each language. n trigrams of one text are far from independent,
so their mean counts as SEEN draws, or as n if there are fewer. Another model gives every trigram the same probability; it stands for
no language (`und`). P(declared | l) is the reliability of the markup's language. P(address | l) is learned: the shares of the address
suffixes among the texts that look like l, drawn towards those of the whole corpus; it counts as a square root, for the host's prior
leans on the same suffix. P(l | host) are shares of the languages that the texts of a host look like, drawn towards those of its address suffix, and these
towards those of the whole corpus, by grouped aggregation.

Declared values are read without case and region (`en-US` is `en`). The languages are the codes of two letters that at least
LEAST_ROWS rows declare, whatever the size of the table, so junk makes no model and there are at most 676 models. The text
models are fitted on the rows whose id's hash falls below a share, with the declared language as the label; the share is
FIT_ROWS / rows, or for each language what gives it FIT_EACH rows. All else covers all rows.

A row is rejected if `und` wins or the winner's posterior is below LEAST. But a text with letters whose declared value is a code of two
or three letters without a model can't be judged; where it would be rejected, it is kept under that code, with a null posterior. Codes
that stand for no language (`und`, `mul`, `mis`, `zxx`, private ones) never are one.

Defined cases: null, empty or letterless texts are `und` and rejected; texts of any length are read in parts of a megabyte; languages of
equal posterior go by code; a null declared language, host or address is no evidence; a
declared value that is no language here is none either; if nothing is declared anywhere, every text is `und`; repeated rows each get
their row; an empty table gives an empty table; other columns are kept, but one with the name of an added column is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, join_small, shield, unshield

#: Hashed trigrams.
CELLS = 1 << 15
FIT_ROWS = 20_000
#: Rows that each language is fitted on, or all that it has.
FIT_EACH = 2_000
#: Rows that make a code a language of the models.
LEAST_ROWS = 10
#: What can be a language of the models: a code of two letters, so there are 676 at most.
MODELLED = "^[a-z]{2}$"
#: What can be a code at all: two or three letters; and which of them stand for no language (so do qaa to qtz).
CODE, NO_CODE = "^([a-z]{2,3})([-_][a-z0-9]+)*$", "^(und|mul|mis|zxx|q[a-t][a-z])$"
SEEN = 60.0
LEAST = 0.5
#: Reliability of the declared language, and the weight of the address suffix.
DECLARED, ADDRESS = 0.9, 0.5
#: Pseudo-counts that draw a host towards its suffix, and a suffix towards the corpus.
HOST_PULL, SUFFIX_PULL = 20.0, 100.0
UND = "und"
UND_PRIOR = 1e-3
#: Bytes that are handled at once.
SPAN = 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[0x80:] = True


def cells(text: str | None) -> list[np.ndarray]:
    """The cells of the byte trigrams of a text that begin or end with a letter, in parts."""
    data, out = (text or "").lower().encode("utf-8"), []
    for at in range(0, max(len(data) - 2, 0), SPAN):
        b = np.frombuffer(data, dtype=np.uint8)[at : at + SPAN + 2].astype(np.uint32)
        keep = _LETTER[b[:-2]] | _LETTER[b[2:]]
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        out.append(((code * np.uint32(2654435761)) >> np.uint32(17))[keep])
    return out


def code(declared: str) -> Column:
    """The language of a declared value, without region; null if it is no code, or one for no language."""
    own = F.nullif(F.regexp_extract(F.lower(F.trim(F.col(declared).cast("string"))), CODE, 1), F.lit(""))
    return F.when(~own.rlike(NO_CODE), own)


def languages(docs: DataFrame, declared: str) -> tuple[dict[str, int], int]:
    """The languages with their numbers of rows, and the number of all rows."""
    rows = docs.count()
    counts = docs.where(F.col(declared).rlike(MODELLED)).groupBy(F.col(declared).alias("l")).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    return dict(sorted((r["l"], r["n"]) for r in counts.collect())), rows


def fit(docs: DataFrame, counts: dict[str, int], rows: int, *, id: str, text: str, declared: str) -> np.ndarray:
    """Log probabilities of the cells, a row for each language and one for `und`."""
    langs = list(counts)
    shares = [int(min(1.0, max(FIT_ROWS / max(rows, 1), FIT_EACH / n)) * (1 << 30)) + 1 for n in counts.values()]
    share = F.get(F.array(*map(F.lit, shares)), F.array_position(F.array(*map(F.lit, langs)), F.col(declared)).cast("int") - 1) if langs else F.lit(0)
    sample = docs.where((F.pmod(F.xxhash64(F.col(id), F.lit("fit")), F.lit(1 << 30)) < share) & F.col(declared).isin(langs))
    at = {x: i for i, x in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), CELLS), dtype=np.int64)
        for batch in batches:
            for t, l in zip(batch.column(0), batch.column(1)):
                for part in cells(t.as_py()):
                    total[at[l.as_py()]] += np.bincount(part, minlength=CELLS)
        lang, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[lang, cell])], names=["lang", "cell", "n"])

    counted = sample.select(F.col(text).cast("string"), F.col(declared)).mapInArrow(count, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    seen = np.full((len(langs), CELLS), 0.05)
    seen[counted["lang"].to_numpy(), counted["cell"].to_numpy()] += counted["n"].to_numpy()
    model = np.log(seen / seen.sum(axis=1, keepdims=True)) if langs else seen
    return np.vstack([model, np.full((1, CELLS), -np.log(CELLS))]).astype(np.float32)


def scorer(model: np.ndarray):
    """A column function: the log likelihoods of a text, scaled to SEEN draws, for each row of the model; for a text without letters
    only `und` is possible."""

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            total, n = np.zeros(len(model)), 0
            for part in cells(t):
                n += len(part)
                for i in range(len(model)):
                    total[i] += model[i].take(part).sum(dtype=np.float64)
            out.append(total / n * min(n, SEEN) if n else np.concatenate([np.full(len(model) - 1, -1e3), [0.0]]))
        return pd.Series(out)

    return score


def address_suffix(url: str) -> Column:
    """The last label of a url's host."""
    return F.nullif(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://[^/?#:]*\.([a-z]+)", 1), F.lit(""))


def _vector(values: str, langs: list[str], right: float) -> Column:
    """Log P(value | l) for each language; nothing if the value is no language."""
    wrong = (1 - right) / max(1, len(langs) - 1)
    one = [F.when(F.col(values) == l, float(np.log(right))).otherwise(float(np.log(wrong))) for l in langs]
    return F.when(F.col(values).isin(langs), F.array(*one)).otherwise(F.array(*[F.lit(0.0)] * len(langs)))


def page_text(html: str) -> Column:
    """The text of a page: without scripts, styles, comments and marks."""
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def markup_language(html: str) -> Column:
    """The language that a page's html mark declares; null if it declares none."""
    return F.nullif(F.regexp_extract(F.col(html), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]+(?:[-_][a-z0-9]+)*)", 1), F.lit(""))


def page_host(url: str) -> Column:
    """A url's host without user and port; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]+)", 1), F.lit(""))


def identify_pages(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """pages (id, url, html) identified with all evidence: text, declared language of the markup, host and address suffix. The id and url
    with declared, _language, _posterior, _look and _accepted."""
    read = pages.select(F.col(id), F.col(url), page_text(html).alias("_body"), markup_language(html).alias("declared"), page_host(url).alias("_site"))
    return identify(read, id=id, text="_body", declared="declared", host="_site", url=url).drop("_body", "_site")


def host_priors(looks: DataFrame, langs: list[str]) -> DataFrame:
    """(_host, _suffix, _look, _n) to (_of_host, _of_suffix, _prior: log P(l | host), _address: weighted log P(suffix | l))."""
    n = [F.sum(F.when(F.col("_look") == l, F.col("_n")).otherwise(0)).alias(f"_n{i}") for i, l in enumerate(langs)]
    hosts = looks.groupBy("_host", "_suffix").agg(*n)
    suffixes = hosts.groupBy("_suffix").agg(*[F.sum(f"_n{i}").alias(f"_s{i}") for i in range(len(langs))]).withColumnRenamed("_suffix", "_suffix2")
    every = hosts.agg(*[F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"_g{i}") for i in range(len(langs))]).first()
    total = sum(every)
    world = [(g + 1) / (total + len(langs)) for g in every]
    sums = lambda p: sum((F.col(f"{p}{i}") for i in range(len(langs))), F.lit(0))
    joined = hosts.join(suffixes, F.col("_suffix").eqNullSafe(F.col("_suffix2")))
    of_suffix = [(F.col(f"_s{i}") + SUFFIX_PULL * world[i]) / (sums("_s") + SUFFIX_PULL) for i in range(len(langs))]
    of_host = [F.when(F.col("_host").isNull(), s).otherwise((F.col(f"_n{i}") + HOST_PULL * s) / (sums("_n") + HOST_PULL)) for i, s in enumerate(of_suffix)]
    among = sums("_s") / max(total, 1)  # the suffix's share of the corpus
    of_address = [F.when(F.col("_suffix").isNull(), 0.0).otherwise(ADDRESS * F.ln((F.col(f"_s{i}") + SUFFIX_PULL * among + 1e-9) / (every[i] + SUFFIX_PULL))) for i in range(len(langs))]
    return joined.select(F.col("_host").alias("_of_host"), F.col("_suffix").alias("_of_suffix"), F.array(*[F.ln(x * (1 - UND_PRIOR)) for x in of_host]).alias("_prior"), F.array(*of_address).alias("_address"))


def identify(docs: DataFrame, *, id: str = "doc_id", text: str = "text", declared: str | None = "lang", host: str | None = "source", url: str | None = None) -> DataFrame:
    """docs with _language, _posterior, _look (the language of the text alone) and _accepted."""
    none = F.lit(None).cast("string")
    own, names = shield(docs)
    id, text, declared, host, url = (names[c] if c else None for c in (id, text, declared, host, url))
    keyed = own.withColumns({"_declared": code(declared) if declared else none, "_host": F.col(host) if host else none, "_suffix": address_suffix(url) if url else none})
    counts, rows = languages(keyed, "_declared")
    langs = list(counts)
    score = scorer(fit(keyed, counts, rows, id=id, text=text, declared="_declared"))
    every = F.array(*map(F.lit, [*langs, UND]))
    best = lambda values: F.element_at(every, F.array_position(values, F.array_max(values)).cast("int"))
    looks = cut(keyed.select("_host", "_suffix", score(F.col(text).cast("string")).alias("_text")).groupBy("_host", "_suffix", best(F.col("_text")).alias("_look")).agg(F.count("*").alias("_n")))
    priors = cut(host_priors(looks, langs)) if langs else None
    fused = keyed.withColumn("_text", score(F.col(text).cast("string")))
    if langs:
        same = F.col("_host").eqNullSafe(F.col("_of_host")) & F.col("_suffix").eqNullSafe(F.col("_of_suffix"))
        fused = join_small(fused, priors, same)
        know = F.zip_with(F.zip_with(F.col("_prior"), _vector("_declared", langs, DECLARED), lambda a, b: a + b), F.col("_address"), lambda a, b: a + b)
        fused = fused.withColumn("_log", F.zip_with("_text", F.concat(know, F.array(F.lit(float(np.log(UND_PRIOR))))), lambda a, b: a + b))
    else:
        fused = fused.withColumn("_log", F.col("_text"))
    weights = F.transform("_log", lambda x: F.exp(x - F.array_max("_log")))
    posterior = F.lit(1.0) / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    out = fused.withColumns({"_language": best(F.col("_log")), "_posterior": posterior, "_look": best(F.col("_text"))})
    out = out.withColumn("_accepted", (F.col("_language") != UND) & (F.col("_posterior") >= LEAST))
    unmodelled = F.col("_declared").isNotNull() & ~F.col("_declared").isin(langs)
    unknown = F.coalesce(~F.col("_accepted") & unmodelled & (F.element_at("_text", -1) < 0), F.lit(False))
    out = out.withColumns({"_language": F.when(unknown, F.col("_declared")).otherwise(F.col("_language")), "_posterior": F.when(~unknown, F.col("_posterior")), "_accepted": F.col("_accepted") | unknown})
    return unshield(out, names, **{c: F.col(c) for c in ("_language", "_posterior", "_look", "_accepted")})
