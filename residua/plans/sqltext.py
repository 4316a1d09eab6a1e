"""Shared pieces of the DuckDB statements that stand beside the queries."""

from __future__ import annotations

from residua.functions.alphabet import EXCHANGE, LETTERS, RESIDUES

NORM = f"regexp_replace(translate(translate(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\x0b\\x0c]', '', 'g'), '{LETTERS.lower()}', '{LETTERS}'), '{LETTERS}', '{EXCHANGE}'), '[^A-Z]', 'X', 'g')"
PROT = f"prot AS (SELECT *, length(seq) AS len FROM (SELECT doc_id AS prot_id, source AS org, lang AS clade, {NORM} AS seq FROM documents))"
PST = "pst AS (SELECT *, CAST(coalesce(sum(len + 1) OVER (ORDER BY prot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gs FROM prot)"
HAMMING = "CAST(len(list_filter(range(1, length(a_frag) + 1), lambda i: a_frag[i] <> b_frag[i])) AS INTEGER)"


def km(lf: int, keep: str = "prot_id, org", name: str = "km", where: str = "", source: str = "prot") -> str:
    """Windows as a CTE; chunked like the operator, for the same reason."""
    return (
        f"{name} AS (SELECT * FROM (SELECT {keep}, CAST(c * 256 + p AS INTEGER) AS pos, substr(chunk, p, {lf}) AS frag FROM (SELECT {keep}, c, chunk, unnest(range(1, length(chunk) - {lf} + 2)) AS p FROM "
        f"(SELECT {keep}, c, substr(seq, c * 256 + 1, {256 + lf - 1}) AS chunk FROM (SELECT {keep}, seq, unnest(range(0, (len - {lf}) // 256 + 1)) AS c FROM {source} WHERE len >= {lf})))) {where})"
    )


VALID = "WHERE NOT contains(frag, 'X')"


def prime_above(expr: str) -> str:
    return f"(SELECT min(x) FROM (SELECT unnest(range({expr} + 1, {expr} + 2000)) AS x) WHERE len(list_filter(range(2, CAST(floor(sqrt(x)) AS BIGINT) + 1), lambda d: x % d = 0)) = 0)"


def pairs(lf: int, n: int, seed: int = 0, around: bool = False) -> str:
    """CTEs up to ``pairs``: the two-stride sample; around: n pairs, or as many as bring the first side round the corpus."""
    return f"""{PROT}, {PST}, tot AS (SELECT CAST(sum(len + 1) AS BIGINT) AS t FROM prot),
st AS (SELECT t, {prime_above("CAST(floor(pow(2 * t, 0.25)) AS BIGINT)")} AS m1, {prime_above("CAST(floor(pow(t, 0.5)) AS BIGINT)")} AS m2, greatest(1, t // 100000) AS step FROM tot),
raw AS (SELECT * FROM (SELECT i AS pair_id, (i * m1) % t AS pos1, ({seed} * step + i * m2) % t AS pos2 FROM (SELECT *, unnest(range({f"greatest({n}, (t + m1 - 1) // m1)" if around else n})) AS i FROM st)) WHERE pos2 > pos1 + {lf}),
one AS (SELECT raw.*, prot_id AS a_prot, org AS a_org, CAST(pos1 - gs + 1 AS INTEGER) AS a_pos, seq AS s1, len AS l1 FROM raw ASOF JOIN pst ON raw.pos1 >= pst.gs),
two AS (SELECT one.*, prot_id AS b_prot, org AS b_org, CAST(pos2 - gs + 1 AS INTEGER) AS b_pos, seq AS s2, len AS l2 FROM one ASOF JOIN pst ON one.pos2 >= pst.gs),
pairs AS (SELECT pair_id, pos1, pos2, a_prot, a_org, a_pos, substr(s1, a_pos, {lf}) AS a_frag, b_prot, b_org, b_pos, substr(s2, b_pos, {lf}) AS b_frag FROM two WHERE a_pos + {lf} - 1 <= l1 AND b_pos + {lf} - 1 <= l2),
pm AS (SELECT *, {HAMMING} AS pm FROM pairs)"""


def sample(lf: int, step: int, shift: int, batches: int) -> str:
    """CTEs up to ``smp``: the systematic sample."""
    return f"""{PROT}, {PST}, smp AS (SELECT batch, gpos, prot_id, org, CAST(gpos - gs + 1 AS INTEGER) AS pos, substr(seq, gpos - gs + 1, {lf}) AS frag FROM (
  SELECT CAST(b AS INTEGER) AS batch, prot_id, org, seq, gs, unnest(range(gs + (((b * {shift} - gs) % {step}) + {step}) % {step}, gs + len - {lf} + 1, {step})) AS gpos FROM pst, range({batches}) r(b)))"""


def hashed(n: int, expr: str) -> str:
    """The number below n that a key draws."""
    return f"(CAST('0x' || substr(md5({expr}), 1, 8) AS BIGINT) % {n})"


def prob_table() -> str:
    """CTE ``pr``: aa, p of the 20 residues."""
    return f"cnt AS (SELECT aa, CAST(sum(length(seq) - length(replace(seq, aa, ''))) AS BIGINT) AS n FROM prot, (SELECT unnest(string_split('{','.join(RESIDUES)}', ',')) AS aa) GROUP BY aa), pr AS (SELECT aa, CAST(n AS DOUBLE) / (SELECT sum(n) FROM cnt) AS p, n FROM cnt)"


def frag_prob(lf: int) -> str:
    """The product of probabilities, from the left, as the operator takes it (needs ``pm_map``)."""
    return "*".join(["1.0::DOUBLE", *[f"coalesce(m[frag[{i}]], 0)" for i in range(1, lf + 1)]])


PM_MAP = "pm_map AS (SELECT map(list(aa), list(p)) AS m FROM pr)"
