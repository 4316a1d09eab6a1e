"""Queries over the corpus: ingest, windows, composition, abundance, entropy, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from residua.functions import stats
from residua.functions.alphabet import LETTERS, RESIDUES, code, decode
from residua.operators import abundance as ab
from residua.operators import composition as co
from residua.operators import entropy as en
from residua.operators import kmers
from residua.plans.sqltext import NORM, PM_MAP, PROT, PST, VALID, frag_prob, km, prob_table
from residua.sources.corpus import pretty_name, proteins, starts, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


@query("src1_ingest", f"WITH {PROT} SELECT prot_id, org, len, md5(seq) AS seq_md5 FROM prot")
def _(s, d):
    return proteins(s, d).select("prot_id", "org", "len", F.md5("seq").alias("seq_md5"))


@query("f1_normalise", f"WITH {PROT} SELECT org, CAST(sum(len) AS BIGINT) AS residues, CAST(sum(length(seq) - length(replace(seq, 'X', ''))) AS BIGINT) AS invalid FROM prot GROUP BY org")
def _(s, d):
    return proteins(s, d).groupBy("org").agg(F.sum("len").cast("long").alias("residues"), F.sum(F.length("seq") - F.length(F.replace("seq", F.lit("X")))).cast("long").alias("invalid"))


@query("src6_residue_probabilities", f"WITH {PROT}, {prob_table()} SELECT aa, round(p, 6) AS prob FROM pr WHERE n > 0")
def _(s, d):
    return co.frequencies(proteins(s, d), (), RESIDUES).select("aa", r6("freq").alias("prob"))


@query("src4_pages_lines", "SELECT page_id, CAST(len(list_filter(string_split(html, chr(10)), lambda x: NOT starts_with(x, '>'))) AS INTEGER) AS lines FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.size(F.filter(F.split("html", "\n", -1), lambda x: ~F.startswith(x, F.lit(">")))).alias("lines"))


@query("d5_protein_starts", f"WITH {PROT}, {PST} SELECT prot_id, gs AS global_start FROM pst")
def _(s, d):
    return starts(proteins(s, d)).select("prot_id", "global_start")


@query("d6_organism_starts", f"WITH {PROT}, {PST} SELECT org, min(gs) AS org_start, count(*) AS prots FROM pst GROUP BY org")
def _(s, d):
    return starts(proteins(s, d)).groupBy("org").agg(F.min("global_start").alias("org_start"), F.count(F.lit(1)).alias("prots"))


@query("f2_fragments", f"WITH {PROT} SELECT prot_id, CAST(greatest(len - 99, 0) AS BIGINT) AS frags FROM prot")
def _(s, d):
    p = proteins(s, d)
    w = kmers.windows(p, 100, ("prot_id",)).groupBy("prot_id").agg(F.count(F.lit(1)).alias("frags"))
    return p.select("prot_id").join(w, "prot_id", "left").select("prot_id", F.coalesce("frags", F.lit(0)).cast("long").alias("frags"))


@query("f3_contains_x", f"WITH {PROT}, {km(10)} SELECT org, count(*) FILTER (WHERE contains(frag, 'X')) AS with_x, count(*) FILTER (WHERE NOT contains(frag, 'X')) AS without_x FROM km GROUP BY org")
def _(s, d):
    w = kmers.windows(proteins(s, d), 10, ("org",))
    x = F.contains("frag", F.lit("X"))
    return w.groupBy("org").agg(F.count_if(x).alias("with_x"), F.count_if(~x).alias("without_x"))


@query("f4_valid_windows", f"WITH {PROT} SELECT org, CAST(lf AS INTEGER) AS lf, CAST(sum(list_sum(list_transform(string_split(seq, 'X'), lambda r: greatest(length(r) - lf + 1, 0)))) AS BIGINT) AS valid FROM prot, (SELECT unnest([5, 10, 50, 100]) AS lf) GROUP BY org, lf")
def _(s, d):
    rows = proteins(s, d).withColumn("lf", F.explode(F.array(*[F.lit(x) for x in (5, 10, 50, 100)])))
    return rows.groupBy("org", "lf").agg(F.sum(kmers.valid_windows(F.col("seq"), F.col("lf"))).alias("valid"))


@query("f5_fragment_codes", f"WITH {PROT}, {km(3, 'prot_id', where=VALID)} SELECT DISTINCT frag, CAST((instr('{RESIDUES}', frag[1]) - 1) * 400 + (instr('{RESIDUES}', frag[2]) - 1) * 20 + instr('{RESIDUES}', frag[3]) - 1 AS BIGINT) AS code, frag AS back FROM km")
def _(s, d):
    frags = kmers.windows(proteins(s, d), 3, ("prot_id",), True).select("frag").distinct()
    return frags.withColumn("code", code(F.col("frag"))).withColumn("back", decode(F.col("code"), 3))


@query("f10_fragment_probability", f"WITH {PROT}, {km(4, 'prot_id', where=VALID)}, {prob_table()}, {PM_MAP}, f AS (SELECT DISTINCT frag FROM km) SELECT frag, round({frag_prob(4)} * 1e6, 6) AS prob_ppm FROM f, pm_map")
def _(s, d):
    p = proteins(s, d)
    frags = kmers.windows(p, 4, ("prot_id",), True).select("frag").distinct()
    return frags.select("frag", r6(co.fragment_prob(F.col("frag"), co.prob_map(p)) * 1e6).alias("prob_ppm"))


EXPECTED_CTE = f"{PROT}, {km(4, 'prot_id', where=VALID)}, {prob_table()}, {PM_MAP}, h AS (SELECT frag, count(*) AS hits FROM km GROUP BY frag), w AS (SELECT count(*) AS n FROM km), e AS (SELECT frag, hits, {frag_prob(4)} AS prob, {frag_prob(4)} * n AS exp FROM h, pm_map, w)"


def _expected(s, d):
    p = proteins(s, d)
    n = ab.n_valid(p, 4)
    return ab.expected(ab.hits(p, 4), co.prob_map(p), n), n


@query("f11_expected_hits", f"WITH {EXPECTED_CTE} SELECT frag, hits, round(exp, 6) AS exp FROM e")
@query("agg16_expected_observed", f"WITH {EXPECTED_CTE} SELECT frag, hits, round(exp, 6) AS exp, round(hits / exp, 6) AS ratio FROM e")
def _(s, d):
    e, _n = _expected(s, d)
    return e.select("frag", "hits", r6("exp").alias("exp"), r6("ratio").alias("ratio"))


QUERIES["f11_expected_hits"] = lambda s, d: _expected(s, d)[0].select("frag", "hits", r6("exp").alias("exp"))


@query("agg17_over_under", f"WITH {EXPECTED_CTE} SELECT count(*) FILTER (WHERE hits > exp * 2) AS over, count(*) FILTER (WHERE hits * 2 < exp) AS under, count(*) AS frags, round(sum(abs(hits - exp)), 3) AS abs_error FROM e")
def _(s, d):
    return ab.over_under(_expected(s, d)[0], 2).withColumn("abs_error", F.round("abs_error", 3))


@query("agg17_probability_hits", f"WITH {EXPECTED_CTE} SELECT CAST(floor(round(ln(prob) / ln(1.01), 9)) AS BIGINT) AS prob_bin, hits, count(*) AS count FROM e GROUP BY ALL")
def _(s, d):
    return ab.prob_hits_histogram(_expected(s, d)[0])


@query("agg18_error_to_expectation", f"WITH {EXPECTED_CTE} SELECT round(sum(greatest(hits - exp, 0)), 3) AS over, round(sum(greatest(exp - hits, 0)), 3) AS under_seen, round((1 - sum(prob)) * (SELECT n FROM w), 3) AS unseen FROM e")
def _(s, d):
    e, n = _expected(s, d)
    x = ab.error_to_expectation(e, n)
    return x.select(*[F.round(c, 3).alias(c) for c in x.columns])


@query("f12_expected_identity", f"WITH {PROT}, {prob_table()} SELECT CAST(lf AS INTEGER) AS lf, round(lf * (SELECT sum(p * p) FROM pr), 6) AS identity FROM (SELECT unnest([10, 50, 100, 200]) AS lf)")
def _(s, d):
    sq = co.frequencies(proteins(s, d), (), RESIDUES).agg(F.sum(F.col("freq") * F.col("freq")).alias("sq"))
    return sq.select(F.explode(F.array(*[F.lit(x) for x in (10, 50, 100, 200)])).alias("lf"), "sq").select("lf", r6(F.col("lf") * F.col("sq")).alias("identity"))


@query("f13_binomials", "SELECT CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS k, round(CASE WHEN k = 0 THEN 1.0 ELSE list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(1, k + 1), lambda i: i::DOUBLE)), lambda a, i: a * (n - i + 1) / i) END, 3) AS value FROM range(21) a(n), range(21) b(k) WHERE k <= n")
def _(s, d):
    t = s.range(21).select(F.col("id").cast("int").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    return t.select("n", "k", F.round(stats.binomial(F.col("n"), F.col("k")), 3).alias("value"))


TRANSITION_CTE = f"""{PROT}, {prob_table()}, m AS (SELECT round(sum(p * p), 9) AS m FROM pr), d AS (SELECT CAST(lf AS INTEGER) AS lf, CAST(pm AS INTEGER) AS pm FROM (SELECT unnest([20, 50, 100]) AS lf), range(101) r(pm) WHERE pm <= lf),
b AS (SELECT lf, pm, CASE WHEN pm = 0 THEN 1.0 ELSE list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(1, pm + 1), lambda i: i::DOUBLE)), lambda a, i: a * (lf - i + 1) / i) END * pow(1 - m, pm) * pow(m, lf - pm) AS prob, m FROM d, m),
t AS (SELECT lf, max(pm) FILTER (WHERE prob <= 1e-6 AND pm <= lf * (1 - m)) AS transition FROM b GROUP BY lf)"""


def _transition(s, d):
    sq = co.frequencies(proteins(s, d), (), RESIDUES).agg(F.round(F.sum(F.col("freq") * F.col("freq")), 9)).first()[0]
    return stats.transition(s, [20, 50, 100], 1e-6, sq)


@query("f14_transition", f"WITH {TRANSITION_CTE} SELECT lf, transition FROM t")
def _(s, d):
    return _transition(s, d)


@query("f15_twilight", f"WITH {TRANSITION_CTE} SELECT lf, greatest(transition - 5, 0) AS low, least(transition + 5, lf) AS high FROM t")
def _(s, d):
    low, high = stats.twilight(F.col("transition"), F.col("lf"), 5)
    return _transition(s, d).select("lf", low.alias("low"), high.alias("high"))


@query("f17_mean_variance", f"WITH {PROT} SELECT org, round(avg(len), 6) AS mean, round(var_pop(len), 3) AS variance FROM prot GROUP BY org")
def _(s, d):
    return proteins(s, d).groupBy("org").agg(r6(F.avg("len")).alias("mean"), F.round(F.var_pop("len"), 3).alias("variance"))


@query("f18_entropy", f"WITH {PROT}, c AS (SELECT org, aa, CAST(sum(length(seq) - length(replace(seq, aa, ''))) AS BIGINT) AS n FROM prot, (SELECT unnest(string_split('{','.join(LETTERS)}', ',')) AS aa) GROUP BY ALL HAVING n > 0), t AS (SELECT *, n / sum(n) OVER (PARTITION BY org) AS p FROM c) SELECT org, round(-sum(p * log2(p)), 6) AS entropy, CAST(sum(n) AS BIGINT) AS total FROM t GROUP BY org")
def _(s, d):
    return stats.entropy(co.letter_counts(proteins(s, d), ("org",)), ["org"], "count").select("org", r6("entropy").alias("entropy"), "total")


@query("f20_const_bins", "SELECT CAST(floor(value / 5) AS BIGINT) AS bin, CAST(floor(value / 5) AS DOUBLE) * 5 AS start, count(*) AS count FROM events WHERE value IS NOT NULL GROUP BY ALL")
def _(s, d):
    b, start = stats.const_bin(F.col("value"), 5.0)
    return table(s, d, "events").filter("value is not null").groupBy(b.alias("bin"), start.alias("start")).agg(F.count(F.lit(1)).alias("count"))


@query("f21_log_bins", "SELECT CASE WHEN value > 0 THEN CAST(floor(round(ln(value) / ln(2), 9)) AS BIGINT) END AS bin, count(*) AS count FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(s, d):
    b, _start = stats.log_bin(F.col("value"), 2.0)
    return table(s, d, "events").filter("value is not null").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


@query("f22_pretty_names", "SELECT p_partkey, ' ' || p_name AS name FROM part")
def _(s, d):
    head = F.concat(F.lit("id|"), F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_name"), F.lit(" OS=any OX=1"))
    return table(s, d, "part").select("p_partkey", pretty_name(head).alias("name"))


@query("f23_names", f"WITH {PROT}, {PST} SELECT prot_id, org || '/' || clade AS label, gs AS global_start FROM pst")
def _(s, d):
    p = starts(proteins(s, d))
    return p.select("prot_id", F.concat_ws("/", "org", "clade").alias("label"), "global_start")


@query("f31_next_residue", f"WITH {PROT}, {km(5, 'prot_id')} SELECT frag[1:4] AS frag, frag[5] AS next, count(*) AS count FROM km WHERE NOT contains(frag, 'X') GROUP BY ALL")
def _(s, d):
    return en.next_counts(proteins(s, d), 4)


@query("agg1_residue_counts", f"WITH {PROT}, {prob_table()} SELECT aa, n AS count FROM pr WHERE n > 0")
def _(s, d):
    return co.letter_counts(proteins(s, d), (), RESIDUES)


@query("agg2_invalid_letters", "SELECT ch, count(*) AS count FROM (SELECT unnest(string_split(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\x0b\\x0c]', '', 'g'), '')) AS ch FROM documents) WHERE NOT regexp_matches(ch, '[A-Za-z]') AND ch <> '' GROUP BY ch")
def _(s, d):
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r\x0b\x0cA-Za-z]", "")
    return table(s, d, "documents").select(F.explode(F.split(bare, "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("count"))


@query("agg3_length_histogram", f"WITH {PROT} SELECT len, count(*) AS count FROM prot GROUP BY len")
@query("snk4_length_statistics", f"WITH {PROT} SELECT len, count(*) AS count FROM prot GROUP BY len")
def _(s, d):
    return co.length_histogram(proteins(s, d)).select(F.col("len").cast("long").alias("len"), "count")


@query("agg4_residue_frequencies", f"WITH {PROT}, c AS (SELECT aa, CAST(sum(length(seq) - length(replace(seq, aa, ''))) AS BIGINT) AS n FROM prot, (SELECT unnest(string_split('{','.join(LETTERS)}', ',')) AS aa) GROUP BY aa HAVING n > 0) SELECT aa, n AS count, round(n / sum(n) OVER (), 6) AS freq FROM c")
def _(s, d):
    return co.frequencies(proteins(s, d)).withColumn("freq", r6("freq"))


PIVOT = ", ".join(f"CAST(sum(length(seq) - length(replace(seq, '{c}', ''))) AS BIGINT) AS {c}" for c in LETTERS)


@query("agg6_residues_by_protein", f"WITH {PROT} SELECT prot_id, {PIVOT} FROM prot GROUP BY prot_id")
def _(s, d):
    return co.pivoted(proteins(s, d), ("prot_id",))


@query("agg7_residues_of_organism", f"WITH {PROT} SELECT prot_id, {PIVOT} FROM prot WHERE org = 'src0' GROUP BY prot_id")
def _(s, d):
    return co.pivoted(proteins(s, d).filter("org = 'src0'"), ("prot_id",))


@query("agg5_residues_by_range", f"WITH {PROT} SELECT prot_id // 100 AS block, {PIVOT} FROM prot GROUP BY 1")
def _(s, d):
    return co.pivoted(proteins(s, d).withColumn("block", F.floor(F.col("prot_id") / 100)), ("block",))


@query("agg8_residues_by_organism", f"WITH {PROT} SELECT org, {PIVOT} FROM prot GROUP BY org")
def _(s, d):
    return co.pivoted(proteins(s, d), ("org",))


@query("agg9_hits", f"WITH {PROT}, {km(6, 'prot_id', where=VALID)} SELECT frag, count(*) AS hits FROM km GROUP BY frag HAVING hits > 3")
def _(s, d):
    return ab.hits(proteins(s, d), 6).filter("hits > 3")


@query("agg10_hits_per_protein", f"WITH {PROT}, {km(6, 'prot_id', where=VALID)} SELECT frag, count(DISTINCT prot_id) AS prots, count(*) AS hits FROM km GROUP BY frag HAVING prots > 3")
def _(s, d):
    return ab.hits_per_protein(proteins(s, d), 6).filter("prots > 3")


@query("agg11_abundance", f"WITH {PROT}, {km(5, 'prot_id')}, h AS (SELECT frag, count(*) AS hits FROM km GROUP BY frag) SELECT hits, count(*) AS frags FROM h GROUP BY hits")
def _(s, d):
    return ab.histogram(ab.hits(proteins(s, d), 5, False), "hits")


@query("agg12_hit_counts_per_protein", f"WITH {PROT}, {km(5, 'prot_id', where=VALID)}, h AS (SELECT frag, count(DISTINCT prot_id) AS prots FROM km GROUP BY frag) SELECT prots, count(*) AS frags FROM h GROUP BY prots")
def _(s, d):
    return ab.histogram(ab.hits_per_protein(proteins(s, d), 5), "prots")


@query("agg14_most_often", f"WITH {PROT}, {km(8, 'prot_id', where=VALID)}, h AS (SELECT frag, count(DISTINCT prot_id) AS prots, count(*) AS hits FROM km GROUP BY frag) SELECT frag, prots, hits FROM h WHERE prots >= 5 AND prots = (SELECT max(prots) FROM h)")
def _(s, d):
    return ab.most_often(proteins(s, d), 8)


@query("agg19_short_contexts", f"WITH {PROT}, " + ", ".join(km(n, "prot_id", f"k{n}", VALID) for n in (2, 3, 4)) + ", " + ", ".join(f"e{n} AS (SELECT f, -sum(c / t * log2(c / t)) AS e, any_value(t) AS t FROM (SELECT *, sum(c) OVER (PARTITION BY f) AS t FROM (SELECT frag[1:{n - 1}] AS f, frag[{n}] AS x, count(*) AS c FROM k{n} GROUP BY ALL)) GROUP BY f)" for n in (2, 3, 4)) + " " + " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS lf, round(sum(e * t) / sum(t), 6) AS entropy, round(sum(e * e * t) / sum(t) - pow(sum(e * t) / sum(t), 2), 6) AS variance, CAST(sum(t) AS BIGINT) AS total, count(*) AS contexts FROM e{n}" for n in (2, 3, 4)))
def _(s, d):
    return en.conditional(proteins(s, d), [2, 3, 4]).withColumn("entropy", r6("entropy")).withColumn("variance", r6("variance"))


PREDICT_CTE = f"{PROT}, {km(5, 'prot_id', where=VALID)}, c AS (SELECT frag[1:4] AS frag, frag[5] AS next, count(*) AS n FROM km GROUP BY ALL), b AS (SELECT frag, next AS predicted, n / sum(n) OVER (PARTITION BY frag) AS certainty, CAST(sum(n) OVER (PARTITION BY frag) AS BIGINT) AS total, row_number() OVER (PARTITION BY frag ORDER BY n DESC, next) AS k FROM c)"


@query("agg20_predictions", f"WITH {PREDICT_CTE} SELECT frag, predicted, round(certainty, 6) AS certainty, total FROM b WHERE k = 1")
def _(s, d):
    return en.predictions(proteins(s, d), 4).withColumn("certainty", r6("certainty"))


def benchmark_items(s, d):
    from residua.functions.alphabet import normalise

    return table(s, d, "benchmark").select("item_id", normalise(F.col("text")).alias("seq")).withColumn("len", F.length("seq"))


ITEMS = f"items AS (SELECT *, length(seq) AS len FROM (SELECT item_id, {NORM} AS seq FROM benchmark))"


@query("agg21_predict_along", f"WITH {PREDICT_CTE}, {ITEMS}, {km(5, 'item_id', 'q', source='items')} SELECT q.item_id, q.pos, q.frag[5] AS real, b.predicted, round(b.certainty, 6) AS certainty, CASE WHEN b.total IS NOT NULL THEN round(coalesce(c.n, 0) / b.total, 6) END AS real_prob FROM q LEFT JOIN b ON q.frag[1:4] = b.frag AND b.k = 1 LEFT JOIN c ON c.frag = q.frag[1:4] AND c.next = q.frag[5]")
def _(s, d):
    return en.predict_along(benchmark_items(s, d), proteins(s, d), 4, "item_id").withColumn("certainty", r6("certainty")).withColumn("real_prob", r6("real_prob"))


@query("agg22_ortholog_paralog", f"WITH {PROT}, {km(8, where=VALID)}, p AS (SELECT frag, org, count(*) AS n FROM km GROUP BY ALL), t AS (SELECT frag, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n * n) AS BIGINT) AS sq FROM p GROUP BY frag) SELECT frag, total, CAST((total * total - sq) // 2 AS BIGINT) AS ortho, CAST((sq - total) // 2 AS BIGINT) AS para FROM t WHERE total > 1")
def _(s, d):
    return ab.ortholog_paralog(proteins(s, d), 8)


@query("agg23_paralog_ratio", f"WITH {PROT}, o AS (SELECT org, CAST(lf AS INTEGER) AS lf, sum(greatest(len - lf + 1, 0)) AS n FROM prot, (SELECT unnest([10, 50, 100]) AS lf) GROUP BY ALL HAVING n > 0), t AS (SELECT lf, CAST(sum(n * n) AS DOUBLE) / (CAST(sum(n) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS para FROM o GROUP BY lf) SELECT lf, round(para, 6) AS para, round(1 - para, 6) AS ortho, round((1 - para) / para, 6) AS ratio FROM t")
def _(s, d):
    t = ab.paralog_ratio(proteins(s, d), [10, 50, 100])
    return t.select("lf", *[r6(c).alias(c) for c in ("para", "ortho", "ratio")])


WEIGHT = "greatest(least(pos, len - pos + 1, lf, len - lf + 1), 0)"
WEIGHTED_CTE = f"{PROT}, {km(1, 'prot_id, org, len', 'res')}, lfs AS (SELECT unnest([20, 100]) AS lf)"


@query("agg26_weighted_frequencies", f"WITH {WEIGHTED_CTE}, w AS (SELECT CAST(lf AS INTEGER) AS lf, frag AS aa, CAST(sum({WEIGHT}) AS BIGINT) AS weight FROM res, lfs WHERE frag <> 'X' GROUP BY ALL HAVING weight > 0) SELECT lf, aa, weight, round(weight / sum(weight) OVER (PARTITION BY lf), 6) AS prob FROM w")
def _(s, d):
    return co.weighted(proteins(s, d), [20, 100]).withColumn("prob", r6("prob"))


@query("agg27_weighted_by_protein", f"WITH {WEIGHTED_CTE}, w AS (SELECT CAST(lf AS INTEGER) AS lf, prot_id, frag AS aa, CAST(sum({WEIGHT}) AS BIGINT) AS weight FROM res, lfs WHERE frag <> 'X' GROUP BY ALL HAVING weight > 0) SELECT lf, prot_id, aa, weight, round(weight / sum(weight) OVER (PARTITION BY lf, prot_id), 6) AS prob FROM w")
def _(s, d):
    return co.weighted(proteins(s, d), [20, 100], ("prot_id",)).withColumn("prob", r6("prob"))


@query("agg28_mixture", f"WITH {PROT}, {km(1, 'prot_id, org, len', 'res')}, lfs AS (SELECT unnest([20]) AS lf), w AS (SELECT lf, prot_id, frag AS aa, sum({WEIGHT}) AS weight FROM res, lfs WHERE frag <> 'X' GROUP BY ALL HAVING weight > 0), g AS (SELECT lf, aa, sum(weight) / (SELECT sum(weight) FROM w) AS q FROM w GROUP BY lf, aa), o AS (SELECT lf, prot_id, aa, weight, weight / sum(weight) OVER (PARTITION BY lf, prot_id) AS p FROM w), m AS (SELECT o.lf, prot_id, sum(p * q) AS m, sum(weight) AS w FROM o JOIN g USING (lf, aa) GROUP BY ALL), t AS (SELECT *, w / sum(w) OVER () AS share FROM m), x AS (SELECT CAST(lf AS INTEGER) AS lf, CAST(d AS INTEGER) AS d, m, share FROM t, range(21) r(d)) SELECT lf, d, round(sum(share * CASE WHEN d = 0 THEN 1.0 ELSE list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(1, d + 1), lambda i: i::DOUBLE)), lambda a, i: a * (lf - i + 1) / i) END * pow(1 - m, d) * pow(m, lf - d)), 6) AS prob FROM x GROUP BY lf, d")
def _(s, d):
    return co.mixture(proteins(s, d), [20]).withColumn("prob", r6("prob"))


@query("agg35_frequency_table", f"WITH {PROT}, {prob_table()}, t AS (SELECT CAST(sum(n) AS BIGINT) AS t FROM cnt) SELECT aa, n AS count, round(100.0 * n / t, 6) AS frequency FROM cnt, t WHERE n > 0 UNION ALL SELECT 'total', t, 100.0 FROM t")
def _(s, d):
    return co.with_total(proteins(s, d)).withColumn("frequency", r6("frequency"))


@query("agg37_long_proteins", f"WITH {PROT} SELECT prot_id, org, len FROM prot WHERE len >= 2000")
def _(s, d):
    return proteins(s, d).filter("len >= 2000").select("prot_id", "org", "len")


@query("w3_residue_gaps", f"WITH {PROT}, {km(1, 'prot_id', 'res')}, g AS (SELECT prot_id, frag AS aa, pos - lag(pos) OVER (PARTITION BY prot_id, frag ORDER BY pos) AS gap FROM res WHERE frag <> 'X') SELECT aa, gap, count(*) AS count FROM g WHERE gap IS NOT NULL GROUP BY ALL")
def _(s, d):
    return en.gap_counts(proteins(s, d))


@query("w3_gap_ends", f"WITH {PROT}, {km(1, 'prot_id, len', 'res')} SELECT prot_id, frag AS aa, min(pos) AS to_start, any_value(len) - max(pos) + 1 AS to_end FROM res WHERE frag <> 'X' GROUP BY prot_id, frag")
def _(s, d):
    return en.gap_ends(proteins(s, d))


@query("w4_gap_entropies", f"WITH {PROT}, {km(1, 'prot_id', 'res')}, g AS (SELECT prot_id, frag AS aa, pos - lag(pos) OVER (PARTITION BY prot_id, frag ORDER BY pos) AS gap FROM res WHERE frag <> 'X'), c AS (SELECT prot_id, aa, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL), e AS (SELECT prot_id, aa, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY prot_id, aa) AS t FROM c) GROUP BY ALL) SELECT aa, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS deviation, count(*) AS prots FROM e GROUP BY aa")
def _(s, d):
    return en.gap_entropies(proteins(s, d)).withColumn("mean", r6("mean")).withColumn("deviation", r6("deviation"))


@query("j1_substring_search", f"WITH {PROT}, {km(12, 'prot_id')}, {ITEMS}, {km(12, 'item_id', 'q', source='items')}, h AS (SELECT frag, count(*) AS hits FROM km GROUP BY frag) SELECT item_id, pos, q.frag, coalesce(hits, 0) AS hits FROM q LEFT JOIN h ON q.frag = h.frag")
def _(s, d):
    return ab.search(benchmark_items(s, d), proteins(s, d), 12).drop("first_prot")


@query("j2_first_occurrence", f"WITH {PROT}, {km(12, 'prot_id')}, {ITEMS}, {km(12, 'item_id', 'q', source='items')}, h AS (SELECT frag, min(prot_id) AS first_prot FROM km GROUP BY frag) SELECT item_id, pos, q.frag, first_prot FROM q LEFT JOIN h ON q.frag = h.frag")
def _(s, d):
    return ab.search(benchmark_items(s, d), proteins(s, d), 12).drop("hits")


@query("d9_representatives", f"WITH {PROT}, {km(5, 'prot_id')} SELECT frag, min(prot_id) AS prot_id, CAST(min(prot_id * 10000000 + pos) % 10000000 AS INTEGER) AS pos FROM km GROUP BY frag")
def _(s, d):
    return ab.representatives(proteins(s, d), 5)


@query("j4_hits_per_organism", f"WITH {PROT}, {km(7, where=VALID)} SELECT frag, org, count(*) AS hits FROM km GROUP BY frag, org HAVING hits > 2")
def _(s, d):
    return ab.per_organism(proteins(s, d), 7).filter("hits > 2")


@query("j5_organisms_with_fragment", f"WITH {PROT}, {km(7, where=VALID)} SELECT frag, count(DISTINCT org) AS orgs FROM km GROUP BY frag HAVING orgs > 3")
def _(s, d):
    return ab.per_organism(proteins(s, d), 7).groupBy("frag").agg(F.count(F.lit(1)).alias("orgs")).filter("orgs > 3")


@query("j19_occurrences_in_context", f"WITH {PROT}, {km(12, 'prot_id')}, {ITEMS}, {km(12, 'item_id', 'q', source='items')}, f AS (SELECT DISTINCT frag FROM q) SELECT km.prot_id, km.pos, km.frag, substr(seq, greatest(pos - 20, 1), pos - greatest(pos - 20, 1)) AS before, substr(seq, pos + 12, 20) AS after FROM km SEMI JOIN f ON km.frag = f.frag JOIN prot ON prot.prot_id = km.prot_id")
def _(s, d):
    frags = kmers.windows(benchmark_items(s, d), 12, ("item_id",)).select("frag")
    return ab.context(proteins(s, d), frags, 12)


@query("j20_protein_fetch", f"WITH {PROT} SELECT prot_id, org, len, seq FROM prot WHERE prot_id = 17")
def _(s, d):
    return proteins(s, d).filter("prot_id = 17").select("prot_id", "org", "len", "seq")


@query("j22_exact_duplicates", f"WITH {PROT} SELECT md5(seq) AS seq_md5, count(*) AS prots, min(prot_id) AS first_prot FROM prot GROUP BY 1 HAVING prots > 1")
def _(s, d):
    return proteins(s, d).groupBy(F.md5("seq").alias("seq_md5")).agg(F.count(F.lit(1)).alias("prots"), F.min("prot_id").alias("first_prot")).filter("prots > 1")
