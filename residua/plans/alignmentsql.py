"""The 14 scores of pairs of fragments as DuckDB statements: closed forms, and a recursion over anti-diagonals."""

from __future__ import annotations

from residua.operators.alignment import EXTEND, LOW, MATCH, METRICS, MISMATCH, SCHEMES

CLOSED = {
    "HD": f"CAST({MATCH} * len(list_filter(range(1, n + 1), lambda i: a[i] = b[i])) AS BIGINT)",
    "SH": f"CAST({MATCH} * list_max(list_transform(range(1 - n, n), lambda k: len(list_filter(range(greatest(1, 1 - k), least(n, n - k) + 1), lambda i: a[i] = b[i + k])))) AS BIGINT)",
}


def scored(source: str, ident: str) -> str:
    """CTEs up to ``sc``: ident and the 14 scores of the rows (ident, a, b) of ``source``; fragments of a pair have one length.

    ``dp`` holds, for each pair, scheme and kind of ends, the best scores of the last two anti-diagonals by the place in the
    first fragment, and those that end in a gap on either side."""
    schemes = ", ".join(f"('{name}', {cost})" for name, cost in SCHEMES.items())
    dp_pivot = ", ".join(f"max(best) FILTER (WHERE name = '{m[2:]}' AND free = {m.startswith('SW')}) AS {m}" for m in METRICS if m not in CLOSED)
    row = f"{ident}, n, name, cost, free"
    return f"""al AS MATERIALIZED (SELECT {ident}, a, b, CAST(length(a) AS INTEGER) AS n, string_split(a, '') AS x, string_split(b, '') AS y FROM {source}),
dp AS (
  SELECT {row}, x, y, CAST(0 AS INTEGER) AS d, list_transform(range(0, n + 1), lambda i: CAST({LOW} AS INTEGER)) AS two, list_transform(range(0, n + 1), lambda i: CAST(CASE WHEN i = 0 THEN 0 ELSE {LOW} END AS INTEGER)) AS one,
    list_transform(range(0, n + 1), lambda i: CAST({LOW} AS INTEGER)) AS gb, list_transform(range(0, n + 1), lambda i: CAST({LOW} AS INTEGER)) AS ga, CAST({LOW} AS INTEGER) AS best
  FROM al, (VALUES {schemes}) s(name, cost), (VALUES (true), (false)) e(free)
  UNION ALL
  SELECT {row}, x, y, d, one, list_transform(now, lambda z: z.h), list_transform(now, lambda z: z.g), list_transform(now, lambda z: z.f),
    CASE WHEN NOT free THEN now[n + 1].h ELSE greatest(best, CASE WHEN d >= n THEN greatest(now[n + 1].h, now[d - n + 1].h) ELSE {LOW} END) END
  FROM (SELECT {row}, x, y, d, one, best, list_transform(cells, lambda c: {{'g': c.g, 'f': c.f, 'h': CAST(CASE WHEN NOT c.inside THEN {LOW} WHEN free AND c.edge THEN 0 ELSE greatest(c.g, c.f, c.m) END AS INTEGER)}}) AS now FROM (
    SELECT {row}, x, y, d + 1 AS d, one, best, list_transform(range(0, n + 1), lambda i: {{'inside': i <= d + 1 AND d + 1 - i <= n, 'edge': i = 0 OR i = d + 1,
      'g': CAST(CASE WHEN i <= d AND d + 1 - i <= n THEN greatest(one[i + 1] + cost, gb[i + 1] + {EXTEND}) ELSE {LOW} END AS INTEGER),
      'f': CAST(CASE WHEN i >= 1 AND i <= d + 1 AND d + 1 - i <= n THEN greatest(one[i] + cost, ga[i] + {EXTEND}) ELSE {LOW} END AS INTEGER),
      'm': CAST(CASE WHEN i >= 1 AND i <= d AND d + 1 - i <= n THEN two[i] + CASE WHEN x[i] = y[d + 1 - i] THEN {MATCH} ELSE {MISMATCH} END ELSE {LOW} END AS INTEGER)}}) AS cells
    FROM dp WHERE d < 2 * n))),
sc AS (SELECT al.{ident}, {CLOSED["HD"]} AS HD, {CLOSED["SH"]} AS SH, w.* EXCLUDE ({ident}) FROM al JOIN (SELECT {ident}, {dp_pivot.replace("max(best)", "CAST(max(best)").replace(") AS ", ") AS BIGINT) AS ")} FROM dp WHERE d = 2 * n GROUP BY {ident}) w ON al.{ident} = w.{ident})"""


def columns() -> str:
    return ", ".join(METRICS)


def histogram(keys: str = "", source: str = "sc") -> str:
    """alignment, keys, score, count of the scored rows of ``source``."""
    keep = f"{keys}, " if keys else ""
    return f"SELECT alignment, {keep}score, count(*) AS count FROM (UNPIVOT (SELECT {keep}{columns()} FROM {source}) ON {columns()} INTO NAME alignment VALUE score) GROUP BY ALL"
