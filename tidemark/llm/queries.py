"""The queries of the training-data operators and, where DuckDB can say the same, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, exact_dedup, language, mixing, near_dedup, personal, phrases, quality, sharding, spelling, token_counts, url_filters, warc
from tidemark.llm.common import scratch, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return mixed.select("doc_id", F.col("_words").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    back = warc.read_archives(spark, path)
    return back.select(F.col("source_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "pages").createOrReplaceTempView("op4_pages")
    pages = spark.table("op4_pages").select("page_id", F.expr(OP4_URL).alias("url"), F.expr(OP4_DAY).alias("day"))
    judged = url_filters.evaluate(pages, spark.sql(OP4_LISTS.format(pages="op4_pages")))
    return judged.select("page_id", "url", "day", F.col("_host").alias("host"), F.col("_active").alias("n_active"), F.col("_rule").alias("rule"), F.col("_blocked").alias("blocked"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("_node", "_digest")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json"))
    earlier = docs.where(F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(2)) == 0)
    with scratch(spark, "token-counts") as cache:  # what the counts are joined from is cut
        token_counts.token_counts(earlier, path, cache)  # an earlier run has seen half of the texts; the whole encodes the others alone
        return token_counts.token_counts(docs, path, cache, limit=2048)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 24, law="rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", F.col("lang").alias("declared"), F.col("_look").alias("text_language"), F.col("_language").alias("language"), F.col("_posterior").alias("posterior"), F.col("_accepted").alias("kept"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op9_language_id over pages, which have all of its evidence: markup, host and address suffix."""
    found = language.identify_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "declared", F.col("_look").alias("text_language"), F.col("_language").alias("language"), F.col("_posterior").alias("posterior"), F.col("_accepted").alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", F.col("_votes").alias("votes"), F.col("_posterior").alias("posterior"), F.col("_score").alias("score"), F.col("_kept").alias("kept"))


#: Pages have no fetch date and there is no list; both follow from ids and hosts by a rule, in words that both engines know.
OP4_DAY = "CAST((page_id * 37) % 365 AS INT)"
#: Crawled addresses also come with users, ports, upper-case hosts and final dots; some pages get one, by their id.
OP4_URL = r"""CASE page_id % 7 WHEN 1 THEN replace(url, '://', '://good.example@') WHEN 2 THEN replace(url, '://', '://u:p@')
  WHEN 3 THEN regexp_replace(url, '^([a-z]+://[^/?#:]+)', '$1.:8080') WHEN 4 THEN replace(url, '://', '://WWW.') WHEN 5 THEN regexp_replace(url, '^([a-z]+://)[^/?#]+', '$1[2001:db8::1]:80') ELSE url END"""
OP4_LISTS = r"""
WITH h AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www[.]', '') AS host FROM {pages}),
d AS (SELECT DISTINCT regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS domain FROM h),
p AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www[.]', '') || '/' || regexp_extract(url, '^[A-Za-z]+://[^/]+/([^/?#]+)', 1) AS prefix FROM {pages}),
e AS (SELECT 'hosts' AS list, 'block' AS action, 'domain' AS kind, host AS pattern FROM h
      UNION ALL SELECT 'domains', 'block', 'domain', domain FROM d
      UNION ALL SELECT 'paths', 'allow', 'prefix', prefix FROM p),
n AS (SELECT *, instr('0123456789abcdef', substr(md5(pattern), 1, 1)) AS a, instr('0123456789abcdef', substr(md5(pattern), 2, 1)) AS b, instr('0123456789abcdef', substr(md5(pattern), 3, 1)) AS c FROM e)
SELECT list, action, kind, pattern, CAST(b * 10 AS INT) AS day, 'add' AS change FROM n WHERE a <= 10
UNION ALL SELECT list, action, kind, pattern, CAST(b * 10 + c * 6 AS INT), 'remove' FROM n WHERE a <= 8
UNION ALL SELECT list, action, kind, pattern, CAST(b * 10 + c * 6 + 40 AS INT), 'add' FROM n WHERE a <= 4
"""
OP4_SQL = (
    "WITH caps AS (SELECT *, regexp_replace(rtrim(CASE WHEN starts_with(own, '[') THEN split_part(own, ']', 1) || ']' ELSE split_part(own, ':', 1) END, '.'), '^www[.]', '') AS host"
    + " FROM (SELECT *, lower(split_part(authority, '@', -1)) AS own, regexp_extract(substr(rest, length(authority) + 1), '^(/[^?#]*)', 1) AS path"
    + " FROM (SELECT *, regexp_extract(rest, '^[^/?#]*') AS authority FROM (SELECT *, substr(url, instr(url, '://') + 3) AS rest"
    + " FROM (SELECT page_id, " + OP4_URL.replace("$1", "\\1") + " AS url, " + OP4_DAY + " AS day FROM pages))))),"
    + " entries AS (" + OP4_LISTS.format(pages="pages") + "),"
    + """ active AS (SELECT c.page_id, e.list, e.action, e.kind, e.pattern, arg_max(e.change, (e.day, e.change = 'add')) AS last FROM caps c JOIN entries e
        ON e.day <= c.day AND (e.kind = 'domain' AND (c.host = e.pattern OR ends_with(c.host, '.' || e.pattern)) OR e.kind = 'prefix' AND (c.host || c.path = e.pattern OR starts_with(c.host || c.path, e.pattern || '/')))
        GROUP BY ALL HAVING last = 'add'),
    best AS (SELECT page_id, count(*) AS n_active, max((length(pattern), action, pattern)) AS m FROM active GROUP BY page_id)
    SELECT page_id, url, day, host, coalesce(n_active, 0) AS n_active, m[3] AS rule, coalesce(m[2] = 'block', false) AS blocked FROM caps LEFT JOIN best USING (page_id)"""
)

OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
bits AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS last, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS b FROM p),
coded AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT)
                   + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT) + CAST(substr(b, 5 * i + 5, 1) AS INT), 1), '' ORDER BY i) AS payload_digest
          FROM bits, range(32) AS r(i) GROUP BY page_id)
SELECT page_id, strlen(h) AS payload_bytes, payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM bits JOIN coded USING (page_id)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_az(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower_az(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)),
items AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
grams AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)),
hits AS (SELECT DISTINCT g.doc_id, g.i, g.k, win.item_id FROM grams g JOIN win USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1),
whole AS (SELECT DISTINCT win, string_split(win, ' ') AS ws FROM win WHERE k = 10),
often AS (SELECT term, count(*) AS c FROM (SELECT unnest(w) AS term FROM d) WHERE term IN (SELECT unnest(ws) FROM whole) GROUP BY 1),
placed AS (SELECT win, ws, o, term, c FROM (SELECT win, ws, unnest(ws) AS term, unnest(range(10)) AS o FROM whole) JOIN often USING (term)),
anchors AS (SELECT win, ws, l[1]['o'] AS o1, l[1]['term'] AS t1, l[2]['o'] AS o2, l[2]['term'] AS t2 FROM (SELECT win, ws, list({'o': o, 'term': term} ORDER BY c, o) AS l FROM placed GROUP BY 1, 2 HAVING count(*) > 1)),
spots AS (SELECT doc_id, i, term FROM (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE term IN (SELECT t1 FROM anchors UNION SELECT t2 FROM anchors)),
post AS (SELECT doc_id, i, term, w[greatest(1, i - 9) : i + 9] AS around FROM spots JOIN d USING (doc_id)),
p1 AS (SELECT doc_id, win, i - o1 AS s1 FROM post JOIN anchors ON t1 = term WHERE len(list_intersect(ws, around)) >= len(list_distinct(ws)) - 2),
p2 AS (SELECT doc_id, win, i - o2 AS s2 FROM post JOIN anchors ON t2 = term WHERE len(list_intersect(ws, around)) >= len(list_distinct(ws)) - 2),
loose AS (SELECT DISTINCT doc_id, win FROM p1 JOIN p2 USING (doc_id, win) WHERE abs(s2 - s1) <= 2),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM loose JOIN (SELECT win, item_id FROM win WHERE k = 10) USING (win) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n, 0) AS n_near_items
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
""".replace("lower_az(text)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").replace("\\\\x", "\\x")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, count(*) AS c FROM p GROUP BY ALL),
g AS (SELECT lang, w[i : i + m - 1] AS v, m, sum(c)::BIGINT AS f FROM (SELECT lang, w, c, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 5) AS r(m)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, v, m, f AS a FROM g WHERE m > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.v, c.m, c.a, k, l.f AS l, r.f AS r, 2000000::HUGEINT * c.a // (l.f::HUGEINT + r.f) AS score
         FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c JOIN g l ON l.lang = c.lang AND l.v = c.v[1 : k] JOIN g r ON r.lang = c.lang AND r.v = c.v[k + 1 : c.m]),
best AS (SELECT lang, v, a, min((score, k, l, r)) AS b FROM cuts GROUP BY lang, v, a),
offers AS (SELECT lang, v[i : i + s - 1] AS v, max(a) AS longer FROM (SELECT lang, v, a, s, unnest(range(1, m - s + 2)) AS i FROM cand, range(2, 4) AS q(s) WHERE s < m) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN offers USING (lang, v) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (SELECT lang, array_to_string(v, ' ') AS phrase, a, b[3] AS l, b[4] AS r, b[1]::BIGINT AS score FROM kept),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_data(table(spark, sf_dir, "documents"))


def _spans_sql(kind: str, pattern: str, keep: str) -> str:
    """The spans of a kind as a table: doc_id, kind, s (the span's text), a and b (its ends), those for which `keep` holds. The pattern has
    one group, the span; what is left between the matches says where they stand."""
    return rf"""{kind}_m AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', 1) AS o, string_split_regex(text, '{pattern}') AS g FROM d),
    {kind}_at AS (SELECT doc_id, text, o[i] AS s, CAST(list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) + length(m[i]) - length(o[i]) AS BIGINT) AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m)),
    {kind} AS (SELECT doc_id, '{kind}' AS kind, text, s, a, a + length(s) AS b FROM {kind}_at WHERE {keep})"""


_DIGITS = "regexp_replace(s, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: (list_transform([CAST(reverse({_DIGITS})[i] AS INT)], lambda x: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END))[1])) % 10 = 0"
_CONTEXT = lambda kind: " OR ".join(f"regexp_matches(lower({side}), '(^|[^{personal.WORD_LETTER}])({'|'.join(personal.SCORES[kind][3])})($|[^{personal.WORD_LETTER}])')" for side in ("substr(text, greatest(a - 39, 1), least(a, 40))", "substr(text, a + length(s) + 1, 40)"))
_APART = lambda before, after: f"NOT regexp_matches(substr(text, a, CASE WHEN a > 0 THEN 1 ELSE 0 END), '[{before}]') AND NOT regexp_matches(substr(text, a + length(s) + 1, 1), '[{after}]')"
_CLEAR = lambda kind, kept: f"SELECT k.doc_id, k.kind, k.a, k.b FROM {kind} k WHERE NOT EXISTS (SELECT 1 FROM {kept} o WHERE o.doc_id IS NOT DISTINCT FROM k.doc_id AND o.a < k.b AND o.b > k.a)"
_LISTED = lambda kinds: f"SELECT doc_id, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, list_position({list(personal.KINDS)}, kind)) AS l FROM {kinds} GROUP BY doc_id"
OP12_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), "
    + ", ".join([
        _spans_sql("email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", "true"),
        _spans_sql("ip", r"([0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+))", "list_bool_and(list_transform(string_split(s, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || right(ltrim(x, '0'), 3) AS INT) <= 255))"),
        _spans_sql("card", r"([0-9](?:[\x20-]?[0-9])+)", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
        _spans_sql("phone", r"(\+[0-9][\x20().0-9-]+[0-9])", f"length({_DIGITS}) BETWEEN 10 AND 15"),
        _spans_sql("iban_run", r"(?:^|[^A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])+)", "true"),
        _spans_sql("local_phone", r"(\(?[0-9]+\)?(?:[\x20.-][0-9]+)+)", rf"regexp_full_match(s, '\(?[0-9]{{2,5}}\)?(?:[\x20.-][0-9]{{2,4}}){{2,4}}') AND length({_DIGITS}) BETWEEN 7 AND 12 AND {_APART('0-9A-Za-z+.-', '0-9A-Za-z')} AND ({_CONTEXT('local_phone')})"),
        _spans_sql("ssn", r"([0-9]+(?:-[0-9]+)+)", f"regexp_full_match(s, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND {_APART('0-9A-Za-z-', '0-9A-Za-z-')} AND ({_CONTEXT('ssn')})"),
        """iban_end AS (SELECT doc_id, a, b, text, unnest(list_concat(list_filter(range(1, least(length(s), 68)), lambda i: s[i + 1] = ' '), CASE WHEN length(s) <= 68 AND NOT regexp_matches(substr(text, b + 1, 1), '[0-9A-Za-z]') THEN [length(s)] ELSE [] END)) AS e, s FROM iban_run),
    iban_ok AS (SELECT doc_id, a, max(e) AS e FROM (SELECT *, replace(substr(s, 1, e), ' ', '') AS acc FROM iban_end) WHERE length(acc) BETWEEN 15 AND 34
        AND list_reduce(list_prepend(0, list_transform(range(1, length(acc) + 1), lambda i: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (substr(acc, 5) || substr(acc, 1, 4))[i]) - 1)), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1 GROUP BY 1, 2),
    iban AS (SELECT doc_id, 'iban' AS kind, a, a + e AS b FROM iban_ok)""",
        "base AS (" + " UNION ALL ".join(f"SELECT doc_id, kind, a, b FROM {k}" for k in personal.BASE) + ")",
        f"with_iban AS (FROM base UNION ALL {_CLEAR('iban', 'base')}), with_local AS (FROM with_iban UNION ALL {_CLEAR('local_phone', 'with_iban')}), every AS (FROM with_local UNION ALL {_CLEAR('ssn', 'with_local')})",
        f"base_l AS ({_LISTED('base')}), every_l AS ({_LISTED('every')})",
        "n AS (SELECT doc_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in personal.BASE) + " FROM base GROUP BY 1)",
    ])
    + " SELECT d.doc_id, " + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in personal.BASE) + ", sha256(coalesce(base_l.l, '')) AS base_sha256, coalesce(every_l.l, '') AS spans FROM d LEFT JOIN n USING (doc_id) LEFT JOIN base_l USING (doc_id) LEFT JOIN every_l USING (doc_id)"
)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE bytes AS (SELECT list(c ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(b))),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM d WHERE length(run) >= 6 GROUP BY doc_id, run),
summed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
             lambda s, b: xor(s // 256, crc[xor(s % 256, b) + 1])), 4294967295) AS h FROM runs, bytes),
left_ AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM summed),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM left_ WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
gone AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, a.n, b.word AS o, b.n AS m FROM gone a JOIN gone b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
         UNION SELECT g.word, g.n, w.word, w.n FROM gone g JOIN w ON g.k = w.word
         UNION SELECT w.word, w.n, g.word, g.n FROM gone g JOIN w ON g.k = w.word),
best AS (SELECT word, n, count(*) AS n_near, min((-m, o)) AS b FROM near GROUP BY word, n),
forms AS MATERIALIZED (SELECT word, n_near, CASE WHEN -b[1] >= 5 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 5 * n THEN -b[1] END AS form_n FROM best),
walk AS (SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM w LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mixing, op2_exact_dedup, op3_warc, op4_url_filters, op5_near_dedup, op6_sharding, op7_token_counts, op8_decontamination, op9_language_id, op10_quality, op11_phrases, op12_personal_data, op13_spelling, page_languages, pipeline)}
SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op4_url_filters": OP4_SQL, "op8_decontamination": OP8_SQL, "op11_phrases": OP11_SQL, "op12_personal_data": OP12_SQL, "op13_spelling": OP13_SQL}
