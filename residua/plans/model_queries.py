"""Queries of alignment scores and of null models of fragments, with DuckDB statements for both."""

from __future__ import annotations

from pyspark.sql import functions as F

from residua.operators import alignment as al
from residua.operators import homology, models, nullmodels, sampling
from residua.plans import alignmentsql
from residua.plans.pair_queries import REL, SMALL, S, corpus_shuffle_sql, frags, list_shuffle, relationships, the_pairs
from residua.plans.sqltext import PROT, VALID, hashed, km, pairs
from residua.sinks.scratch import place
from residua.sources.corpus import proteins

QUERIES, SQL = {}, {}
#: Pairs of the score queries: residues of a fragment, and pairs drawn.
LF, N = 50, 4000
#: Of the flavours: residues of a fragment and of its domain, and pairs drawn.
SHORT, DOMAIN, FEW = 20, 100, 1000


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("s4_alignment_scores", f"WITH RECURSIVE {pairs(LF, N)}, src AS (SELECT pair_id, a_frag AS a, b_frag AS b FROM pairs), {alignmentsql.scored('src', 'pair_id')}, w AS (SELECT pair_id, {alignmentsql.columns()} FROM sc) SELECT w.*, pos1, pos2 FROM w JOIN pairs USING (pair_id)")
def _(s, d):
    rows = the_pairs(s, d, LF, N, False).select("pair_id", "pos1", "pos2", F.col("a_frag").alias("frag1"), F.col("b_frag").alias("frag2"))
    return al.score_pairs(rows).drop("frag1", "frag2")


@query(
    "s3_score_histogram",
    f"WITH RECURSIVE {pairs(LF, N)}, src AS (SELECT 'natural:' || pair_id AS id, a_frag AS a, b_frag AS b FROM pairs UNION ALL SELECT 'fragment:' || pair_id, {list_shuffle('a_frag', 'pair_id', 's3a')}, {list_shuffle('b_frag', 'pair_id', 's3b')} FROM pairs), "
    f"{alignmentsql.scored('src', 'id')}, scm AS (SELECT split_part(id, ':', 1) AS model, * FROM sc) {alignmentsql.histogram('model', 'scm')}",
)
def _(s, d):
    p = the_pairs(s, d, LF, N, False)
    nat = p.select(F.lit("natural").alias("model"), F.col("a_frag").alias("frag1"), F.col("b_frag").alias("frag2"))
    shuffled = p.select(F.lit("fragment").alias("model"), nullmodels.shuffled(F.col("a_frag"), F.col("pair_id"), "s3a").alias("frag1"), nullmodels.shuffled(F.col("b_frag"), F.col("pair_id"), "s3b").alias("frag2"))
    return al.score_histogram(al.score_pairs(nat.unionByName(shuffled)), ("model",))


ROUNDS, BLOCK = 3, 400
_BLOCKS = [f"(WITH {pairs(LF, BLOCK, r)} SELECT {r} AS r, pair_id, a_frag, b_frag FROM pairs)" for r in range(ROUNDS)]


@query(
    "s3_score_rounds",
    "WITH RECURSIVE drawn AS (" + " UNION ALL ".join(f"SELECT * FROM {b}" for b in _BLOCKS) + f"), src AS (SELECT 'natural:' || r || ':' || pair_id AS id, a_frag AS a, b_frag AS b FROM drawn"
    f" UNION ALL SELECT 'F:' || r || ':' || pair_id, {list_shuffle('a_frag', 'pair_id', 'F1')}, {list_shuffle('b_frag', 'pair_id', 'F2')} FROM drawn), {alignmentsql.scored('src', 'id')}, scm AS (SELECT split_part(id, ':', 1) AS model, * FROM sc) {alignmentsql.histogram('model', 'scm')}",
)
def _(s, d):
    path, p = place(s, "score-rounds"), proteins(s, d)
    models.evaluate_rounds(s, p, ("natural", "F"), LF, DOMAIN, BLOCK, ROUNDS - 1, path)
    return models.evaluate_rounds(s, p, ("natural", "F"), LF, DOMAIN, BLOCK, ROUNDS, path)  # goes on after what is stored


@query(
    "d19_scored_relationships",
    f"WITH RECURSIVE {S}, {REL}, r AS (SELECT rel.*, a.frag AS f1, b.frag AS f2, row_number() OVER () AS id FROM rel JOIN smp a ON a.batch = batch1 AND a.gpos = pos1 JOIN smp b ON b.batch = batch2 AND b.gpos = pos2 WHERE alignment = 'ali3'), keep AS MATERIALIZED (SELECT * FROM r), "
    f"src AS (SELECT id, f1 AS a, f2 AS b FROM keep), {alignmentsql.scored('src', 'id')} SELECT alignment, batch1, batch2, pos1, pos2, prob, {alignmentsql.columns()} FROM sc JOIN keep USING (id)",
)
def _(s, d):
    f = frags(s, d)
    return al.score_pairs(homology.with_fragments(relationships(s, d, ("ali3",)), f)).drop("frag1", "frag2")


def chain_sql(name: str, source: str, seed: str, length: int) -> str:
    """CTEs up to ``name`` (id, text): a residue chain from the first residue of each row (id, first) of ``source``; needs the
    CTE ``m`` of ``CHAIN``."""
    return f"""{name}_c AS (SELECT id, CASE WHEN m.t[first] IS NOT NULL THEN first ELSE least END AS text, 0 AS i, t, least FROM {source}, m
  UNION ALL SELECT id, text || coalesce(list_filter(coalesce(t[right(text, 1)], t[least]), lambda z: z.upto > CAST('0x' || substr(md5('{seed}:' || id || ':' || (i + 1)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)[1].b, least), i + 1, t, least FROM {name}_c WHERE i < {length - 1}),
{name} AS (SELECT id, text FROM {name}_c WHERE i = {length - 1})"""


CHAIN = f"{km(2, 'prot_id', 'k2', VALID)}, dc AS (SELECT frag[1] AS x, frag[2] AS y, count(*) AS c FROM k2 GROUP BY ALL), cum AS (SELECT x, y, CAST(sum(c) OVER (PARTITION BY x ORDER BY y) AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY x) AS DOUBLE) AS upto FROM dc), tab AS (SELECT x, list({{'b': y, 'upto': upto}} ORDER BY y) AS l FROM cum GROUP BY x), m AS MATERIALIZED (SELECT map(list(x), list(l)) AS t, min(x) AS least FROM tab)"


@query("g9_markov_model", f"WITH RECURSIVE {SMALL}, {CHAIN}, src AS (SELECT gpos AS id, frag[1] AS first FROM smp), {chain_sql('drawn', 'src', 'g9', 50)} SELECT id AS gpos, text AS frag FROM drawn")
def _(s, d):
    draw = models.chain(proteins(s, d))
    f = sampling.systematic(proteins(s, d), 50, 20_000, 2_000, 4)
    return f.select("gpos", draw(F.substr("frag", F.lit(1), F.lit(1)), F.col("gpos"), "g9", 50).alias("frag"))


def model_sql(model: str) -> str:
    """SELECT of pair_id, frag1, frag2 under a model."""
    kind, plain = model[0], pairs(SHORT, FEW)
    if kind in models.GROUPS:
        group = models.GROUPS[kind]
        new = corpus_shuffle_sql(group[0] if group else None, model, kind == "E", "string_agg(aa, '' ORDER BY pos) AS seq")
        other = f"prot AS (SELECT p.prot_id, org, s.seq, length(s.seq) AS len FROM (SELECT doc_id AS prot_id, source AS org FROM documents) p JOIN ({new}) s USING (prot_id))"
        return f"SELECT pair_id, a_frag AS frag1, b_frag AS frag2 FROM (WITH {pairs(SHORT, FEW, int(model[1:])).replace(PROT, other)} SELECT * FROM pairs)"
    if kind == "n":
        return f"SELECT pair_id, a_frag AS frag1, b_frag AS frag2 FROM (WITH {plain} SELECT * FROM pairs)"
    if kind == "F":
        return f"SELECT pair_id, {list_shuffle('a_frag', 'pair_id', 'F1')} AS frag1, {list_shuffle('b_frag', 'pair_id', 'F2')} AS frag2 FROM (WITH {plain} SELECT * FROM pairs)"
    if kind == "T":
        return f"SELECT pair_id, first AS frag1, second AS frag2 FROM (WITH RECURSIVE {plain}, {CHAIN}, a AS (SELECT pair_id AS id, a_frag[1] AS first FROM pairs), b AS (SELECT pair_id AS id, b_frag[1] AS first FROM pairs), {chain_sql('drawn1', 'a', f'{model}:0', SHORT)}, {chain_sql('drawn2', 'b', f'{model}:1', SHORT)} SELECT id AS pair_id, drawn1.text AS first, drawn2.text AS second FROM drawn1 JOIN drawn2 USING (id))"
    start = lambda x: f"CAST(least(greatest({x}_pos - {(DOMAIN - SHORT) // 2}, 1), {x}_len - {DOMAIN - 1}) AS INTEGER)"
    dom = ", ".join(f"substr({x}_seq, {start(x)}, {DOMAIN}) AS {x}_dom" for x in "ab")
    rows = f"(WITH {plain} SELECT pair_id, {dom} FROM (SELECT pairs.*, x.seq AS a_seq, x.len AS a_len, y.seq AS b_seq, y.len AS b_len FROM pairs JOIN prot x ON x.prot_id = a_prot JOIN prot y ON y.prot_id = b_prot WHERE x.len >= {DOMAIN} AND y.len >= {DOMAIN}))"
    if kind == "D":
        return f"SELECT pair_id, substr({list_shuffle('a_dom', 'pair_id', 'D1')}, 1, {SHORT}) AS frag1, substr({list_shuffle('b_dom', 'pair_id', 'D2')}, 1, {SHORT}) AS frag2 FROM {rows}"
    k = int(model[1:])

    def blocks(x: str, seed: str) -> str:
        ring, offset = f"({x}_dom || substr({x}_dom, 1, {k}))", hashed(k, f"'{seed}o:' || pair_id")
        return f"substr(array_to_string(list_transform(list_sort(list_transform(range(0, {-(-DOMAIN // k)}), lambda i: {{'k': md5('{seed}:' || pair_id || ':' || i), 'i': i, 'b': substr({ring}, CAST({offset} + i * {k} + 1 AS BIGINT), least({k}, {DOMAIN} - i * {k}))}})), lambda x: x.b), ''), 1, {SHORT})"

    return f"SELECT pair_id, {blocks('a', f'{model}1')} AS frag1, {blocks('b', f'{model}2')} AS frag2 FROM {rows}"


def flavour_sql(names: tuple[str, ...]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{m}:' || pair_id AS id, frag1 AS a, frag2 AS b FROM ({model_sql(m)})" for m in names)
    return f"WITH RECURSIVE src AS MATERIALIZED ({rows}), {alignmentsql.scored('src', 'id')}, scm AS (SELECT split_part(id, ':', 1) AS model, * FROM sc) {alignmentsql.histogram('model', 'scm')}"


for _flavour, _names in models.FLAVOURS.items():
    query(f"g10_flavour_{_flavour}", flavour_sql(_names))(lambda s, d, names=_names: models.evaluate(s, proteins(s, d), names, SHORT, DOMAIN, FEW))
