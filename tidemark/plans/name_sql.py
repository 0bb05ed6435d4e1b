"""Name scores as DuckDB says them, for the twins of queries over names."""

from __future__ import annotations


def scored(pairs: str) -> str:
    """CTEs that score the pairs (x, y) of the table `pairs`, both with single spaces: the last is scored(x, y, plain, sorted, common,
    weighted). Longest common subsequences come row by row of the usual table, for all distinct pairs of strings at once."""
    w, start = "string_split({}, ' ')", "greatest(length(x), length(y))::DOUBLE / least(length(x), length(y))"
    return f"""
asked_ AS (SELECT DISTINCT x, y, {start} AS long_, array_to_string(list_sort({w.format("x")}), ' ') AS sx, array_to_string(list_sort({w.format("y")}), ' ') AS sy, list_distinct({w.format("x")}) AS wx, list_distinct({w.format("y")}) AS wy FROM {pairs} WHERE x <> '' AND y <> ''),
sets_ AS (SELECT *, array_to_string(list_sort(list_intersect(wx, wy)), ' ') AS b, array_to_string(list_sort(list_filter(wx, lambda z: NOT list_contains(wy, z))), ' ') AS ox, array_to_string(list_sort(list_filter(wy, lambda z: NOT list_contains(wx, z))), ' ') AS oy FROM asked_),
strings_ AS (SELECT *, trim(b || ' ' || ox) AS bx, trim(b || ' ' || oy) AS by_, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l,
    CASE WHEN length(sx) <= length(sy) THEN sx ELSE sy END AS ss, CASE WHEN length(sx) <= length(sy) THEN sy ELSE sx END AS sl FROM sets_),
parts_ AS (SELECT DISTINCT s, l, substr(l, greatest(i, 0) + 1, i + length(s) - greatest(i, 0)) AS p FROM (SELECT s, l, unnest(range(1 - length(s), length(l))) AS i FROM (SELECT s, l FROM strings_ WHERE long_ >= 1.5 UNION SELECT ss, sl FROM strings_ WHERE long_ >= 1.5))),
need_ AS (SELECT x AS p, y AS q FROM strings_ UNION SELECT sx, sy FROM strings_ UNION SELECT bx, by_ FROM strings_ UNION SELECT b, bx FROM strings_ WHERE b <> '' UNION SELECT b, by_ FROM strings_ WHERE b <> '' UNION SELECT s, p FROM parts_),
rows_ AS (SELECT p, q, 0 AS i, list_transform(range(length(q) + 1), lambda z: 0) AS r FROM need_
    UNION ALL SELECT p, q, i + 1, list_transform(range(1, length(q) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k = 1 THEN 0 ELSE greatest(r[k], r[k - 1] + (q[k - 1] = p[i + 1])::INT) END))) FROM rows_ WHERE i < length(p)),
ratio_ AS MATERIALIZED (SELECT p, q, 200.0::DOUBLE * r[length(q) + 1] / (length(p) + length(q)) AS v FROM rows_ WHERE i = length(p)),
part_ AS (SELECT s, l, max(v) AS v FROM parts_ JOIN ratio_ ON ratio_.p = s AND ratio_.q = parts_.p GROUP BY 1, 2),
each_ AS (SELECT t.x, t.y, t.long_, a.v AS plain, c.v AS sorted, CASE WHEN b <> '' AND (ox = '' OR oy = '') THEN 100.0 ELSE greatest(d.v, coalesce(e.v, 0), coalesce(f.v, 0)) END AS common, g.v AS part, CASE WHEN b <> '' THEN 100.0 ELSE h.v END AS part_sorted
    FROM strings_ t JOIN ratio_ a ON a.p = x AND a.q = y JOIN ratio_ c ON c.p = sx AND c.q = sy JOIN ratio_ d ON d.p = bx AND d.q = by_ LEFT JOIN ratio_ e ON e.p = b AND e.q = bx LEFT JOIN ratio_ f ON f.p = b AND f.q = by_
    LEFT JOIN part_ g ON g.s = t.s AND g.l = t.l LEFT JOIN part_ h ON h.s = t.ss AND h.l = t.sl),
scored AS (SELECT x, y, plain, sorted, common, CASE WHEN long_ >= 1.5 THEN greatest(plain, CASE WHEN long_ <= 8 THEN 0.9 ELSE 0.6 END * part, 0.95 * CASE WHEN long_ <= 8 THEN 0.9 ELSE 0.6 END * part_sorted) ELSE greatest(plain, 0.95 * sorted, 0.95 * common) END AS weighted FROM each_)"""
