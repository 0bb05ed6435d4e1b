"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move the score.

Base spans follow fixed patterns, leftmost and non-overlapping per kind: e-mail addresses, IPv4 addresses, payment cards (Luhn) and
international phone numbers. They always stay. Added spans are bank accounts (IBAN, modulo 97), national phone numbers and social
security numbers; each kind has a prior score, a checksum or a word in the CONTEXT code points before or after it raises it, and a span
of at least ACCEPT stays. An added span that overlaps a base one, or an added one of a kind listed earlier, goes. Base spans are scored
in the same way, but the score drops none.

Patterns run over the UTF-8 bytes of some megabyte of texts at a time, parted by line feeds, which no pattern takes in; bytes are turned
into code points for the few spans found. Every pattern is anchored, so that its work is linear: an e-mail is searched from its @, the
others can't begin inside a run of digits, and repeated groups give nothing back where that can't help.

Defined cases: null and empty texts have no spans; texts of any length are read whole, one of more than a megabyte by itself; ties (spans
of one start) go by the order of KINDS; repeated rows each get their spans; an empty table gives an empty table; the caller's columns may
have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words
from tidemark.llm.common import shield, unshield

#: Kinds in their order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "ssn")
BASE = KINDS[:4]
#: Code points before and after a span in which words count, and the least score of an added span.
CONTEXT, ACCEPT = 40, 0.5

#: The base patterns. An e-mail's first part is what stands before its @.
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
#: The added patterns.
_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])++")
_LOCAL_PHONE = re.compile(rb"(?:(?<![0-9])|(?=\())\(?[0-9]++\)?(?:[\x20.-][0-9]++)++")
_SSN = re.compile(rb"(?<![0-9])[0-9]++(?:-[0-9]++)++")
#: What a whole run of these must be: groups of 2 to 5 and then of 2 to 4 digits, 7 to 12 in all; and groups of 3, 2 and 4.
_LOCAL_PHONE_WHOLE = re.compile(rb"\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,4}){2,4}")
_SSN_WHOLE = re.compile(rb"[0-9]{3}-[0-9]{2}-[0-9]{4}")
#: What may not stand before and after them.
_JOINED = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

#: Prior score of each kind, what its checksum adds, what a word nearby adds, and the words (lower case).
SCORES = {
    "email": (0.7, 0.0, 0.2, ("mail", "email", "e-mail", "contact", "courriel", "correo")),
    "ip": (0.5, 0.0, 0.3, ("ip", "address", "host", "server", "adresse")),
    "card": (0.2, 0.5, 0.2, ("card", "visa", "credit", "carte", "tarjeta", "karte")),
    "phone": (0.6, 0.0, 0.3, ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono")),
    "iban": (0.2, 0.6, 0.1, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    "local_phone": (0.2, 0.0, 0.4, ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono")),
    "ssn": (0.3, 0.0, 0.4, ("ssn", "social security")),
}
#: Letters, digits and the like, between which a word doesn't end.
WORD_LETTER = "0-9A-Za-z_\u00C0-\u024F"
_NEAR = {kind: re.compile(f"(?<![{WORD_LETTER}])(?:" + "|".join(map(re.escape, s[3])) + f")(?![{WORD_LETTER}])") for kind, s in SCORES.items()}

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())])


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def digits_of(data: bytes) -> bytes:
    return bytes(c for c in data if 0x30 <= c <= 0x39)


def luhn(digits: bytes) -> bool:
    """Whether every second digit from the right, doubled (its digits added up), and the others add up to a multiple of ten."""
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(c - 0x30 for c in reversed(digits))) % 10 == 0


def mod97(account: bytes) -> bool:
    """Whether an account, its first four places moved to the end and letters read as 10 to 35, leaves 1 when divided by 97."""
    return int("".join(str(int(chr(c), 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(data: bytes) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _DOMAIN.finditer(data):
        begin = at = m.start()
        while begin > last and data[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at:
            yield begin, m.end()
            last = m.end()


def _ips(data: bytes) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(data):
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip(b"0") or b"0" for p in m[0].split(b"."))):
            yield m.span()


def _cards(data: bytes) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(data):
        if 14 <= m.end() - m.start() <= 38 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(data: bytes) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(data):
        if 10 <= len(m[0].translate(None, b"+ ().-")) <= 15:
            yield m.span()


def _ibans(data: bytes) -> Iterator[tuple[int, int]]:
    """The longest beginning of the match, cut at a space or its end, that is an account of 15 to 34 places."""
    for m in _IBAN.finditer(data):
        head = m[0][: 2 * 34]
        whole = len(head) == len(m[0]) and not (m.end() < len(data) and chr(data[m.end()]).isalnum() and data[m.end()] < 0x80)
        ends = [i for i, c in enumerate(head) if c == 0x20] + ([len(head)] if whole else [])
        for end in reversed(ends):
            account = head[:end].replace(b" ", b"")
            if 15 <= len(account) <= 34 and mod97(account):
                yield m.start(), m.start() + end
                break


def _apart(data: bytes, start: int, end: int, before: frozenset, after: frozenset) -> bool:
    return not (start and data[start - 1] in before) and not (end < len(data) and data[end] in after)


def _local_phones(data: bytes) -> Iterator[tuple[int, int]]:
    for m in _LOCAL_PHONE.finditer(data):
        if _LOCAL_PHONE_WHOLE.fullmatch(m[0]) and 7 <= len(digits_of(m[0])) <= 12 and _apart(data, *m.span(), _JOINED | frozenset(b"+.-"), _JOINED):
            yield m.span()


def _ssns(data: bytes) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(data):
        if _SSN_WHOLE.fullmatch(m[0]) and _apart(data, *m.span(), _JOINED | frozenset(b"-"), _JOINED | frozenset(b"-")):
            yield m.span()


_FINDERS = (_emails, _ips, _cards, _phones, _ibans, _local_phones, _ssns)


def _score(kind: str, before: str, after: str) -> float:
    prior, check, word, _ = SCORES[kind]
    near = _NEAR[kind]
    return round(prior + check + (word if near.search(before.lower()) or near.search(after.lower()) else 0.0), 3)


def find(texts: list[bytes]) -> list[list[tuple[str, int, int, float, bool, int, int]]]:
    """The spans of each of some texts, sorted by start and kind: kind, start and end in code points, score, whether it is a base one,
    start and end in bytes."""
    data = b"\n".join(texts)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    tails = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) == 0x80)
    points = lambda at: at - int(np.searchsorted(tails, at))  # noqa: E731 (code points of data before a byte)
    found = [Span(k, *span) for k, finder in enumerate(_FINDERS) for span in finder(data)]
    out: list[list] = [[] for _ in texts]
    for span in found:
        doc = int(np.searchsorted(begins, span.start, side="right")) - 1
        base, low, high = span.kind < len(BASE), int(begins[doc]), int(begins[doc + 1]) - 1
        before = data[max(low, span.start - 4 * CONTEXT) : span.start].decode("utf-8", "ignore")[-CONTEXT:]
        after = data[span.end : min(high, span.end + 4 * CONTEXT)].decode("utf-8", "ignore")[:CONTEXT]
        score = _score(KINDS[span.kind], before, after)
        if not base and score < ACCEPT:
            continue
        start = points(low)
        out[doc].append((KINDS[span.kind], points(span.start) - start, points(span.end) - start, score, base, span.start - low, span.end - low))
    return [_settled(spans) for spans in out]


def _settled(spans: list[tuple]) -> list[tuple]:
    """Spans sorted by start and kind, without added ones that overlap a base one or an added one of an earlier kind."""
    if len(spans) < 2 or all(s[4] for s in spans):
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    kept = [s for s in spans if s[4]]
    for kind in KINDS[len(BASE) :]:
        starts = sorted((s[1], s[2]) for s in kept)
        reach = np.maximum.accumulate([e for _, e in starts]) if starts else np.zeros(0)
        for s in [x for x in spans if x[0] == kind]:
            # Of the spans that begin before s ends, does the furthest reach into it?
            i = int(np.searchsorted([b for b, _ in starts], s[2])) if starts else 0
            if i == 0 or reach[i - 1] <= s[1]:
                kept.append(s)
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0])))


def personal_spans(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of docs with `_spans`: array of (kind, start, end, score, base), in code points, sorted by start and kind."""
    own, names = shield(docs)
    schema = T.StructType([*(f for f in own.schema.fields if f.name != "_text"), T.StructField("_spans", T.ArrayType(SPAN))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            for first, texts in words.runs(batch.column(batch.num_columns - 1)):
                spans = [[dict(zip(("kind", "start", "end", "score", "base"), s)) for s in spans] for spans in find(texts)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(texts)) for i in range(batch.num_columns - 1)), pa.array(spans, kind)], names=schema.names)

    found = own.withColumn("_text", F.col(names[text]).cast("string")).mapInArrow(read, schema)
    return unshield(found, names, _spans=F.col("_spans"))


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of docs with each span of the text replaced by its kind in brackets, such as [email]; of overlapping spans, the first
    of them names what they cover together. Other columns and null texts stay."""
    own, names = shield(docs)

    def masked(raw: bytes, spans: list[tuple]) -> str:
        out, at, cover = [], 0, -1
        for kind, *_, begin, end in spans:
            if begin >= cover:
                out += [raw[at:begin], b"[" + kind.encode() + b"]"]
            at = cover = max(cover, end)
        return b"".join([*out, raw[at:]]).decode("utf-8", "replace")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            for first, some in words.runs(texts):
                new = pa.array([masked(t, s) if s else t.decode("utf-8", "replace") for t, s in zip(some, find(some))], pa.string())
                new = pc.if_else(texts.slice(first, len(some)).is_valid(), new, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([new if i == place else batch.column(i).slice(first, len(some)) for i in range(batch.num_columns)], names=batch.schema.names)

    place = own.columns.index(names[text])
    read_text = own.withColumn(names[text], F.col(names[text]).cast("string"))
    return unshield(read_text.mapInArrow(read, read_text.schema), names)


def listed(spans: str | Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all of them, listed)."""
    found = personal_spans(docs.select(F.col(id).alias("_id"), F.col(text).alias("_read")), text="_read").select("_id", "_spans")
    base = F.filter("_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("_id").alias(id), *[count(k) for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("_spans").alias("spans"))
