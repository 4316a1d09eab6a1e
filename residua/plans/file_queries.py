"""Queries that write a file with one of the library's writers, or in a format of its readers, and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from residua.functions.alphabet import LETTERS, RESIDUES, is_prime, next_prime
from residua.functions.strings import hamming
from residua.operators import abundance as ab
from residua.operators import composition as co
from residua.operators import distance
from residua.plans.pair_queries import ASSIGN, GENOMES, P, assignments, genome_table, the_pairs
from residua.plans.sqltext import PROT, VALID, km, prime_above, prob_table
from residua.sinks import tables
from residua.sinks.scratch import place
from residua.sources import files
from residua.sources.corpus import fasta_lines, proteins, read_fasta, table
from residua.sources.layers import Layers

QUERIES, SQL = {}, {}
WIDTH = 60


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def written_fasta(s, d) -> str:
    path = place(s, "fasta")
    lines = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("len") / WIDTH).cast("int") - 1, F.lit(0))), lambda i: F.substr("seq", i * WIDTH + 1, F.lit(WIDTH)))
    text = F.concat_ws("\n", F.concat(F.lit(">"), F.col("prot_id").cast("string"), F.lit(" name OS="), F.col("org")), F.array_join(lines, "\n"))
    proteins(s, d).filter("len > 0").select(text.alias("value")).write.text(path)
    return path


@query("src1_fasta", f"WITH {PROT} SELECT prot_id || ' name OS=' || org AS name, len, md5(seq) AS seq_md5 FROM prot WHERE len > 0")
def _(s, d):
    return read_fasta(s, written_fasta(s, d)).select("name", "len", F.md5("seq").alias("seq_md5"))


@query("src4_fasta_lines", f"WITH {PROT}, l AS (SELECT unnest(list_transform(range(0, (len + {WIDTH - 1}) // {WIDTH}), lambda i: least({WIDTH}, len - i * {WIDTH}))) AS n FROM prot WHERE len > 0) SELECT CAST(n AS INTEGER) AS length, count(*) AS lines FROM l GROUP BY n")
def _(s, d):
    return fasta_lines(s, written_fasta(s, d)).groupBy(F.length("value").alias("length")).agg(F.count(F.lit(1)).alias("lines"))


@query("src5_listing", "SELECT DISTINCT source AS org, CAST(1 AS BIGINT) AS files, true AS has_bytes FROM documents WHERE source IS NOT NULL")
def _(s, d):
    path = place(s, "listing")
    table(s, d, "documents").filter("source is not null").select("doc_id", F.col("source").alias("org")).repartition(1).write.partitionBy("org").csv(path)
    found = files.listing(s, path).select(F.regexp_extract("path", "org=([^/]*)/", 1).alias("org"), "length")
    return found.groupBy("org").agg(F.count(F.lit(1)).alias("files"), (F.min("length") > 0).alias("has_bytes"))


@query("src6_probability_file", f"WITH {PROT}, {prob_table()} SELECT aa, round(p, 6) AS prob FROM pr WHERE n > 0")
def _(s, d):
    path = place(s, "probabilities")
    counts = proteins(s, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("aa"), (F.length("seq") - F.length(F.replace("seq", F.lit(c)))).alias("n")) for c in LETTERS])).alias("x"))
    tables.write_map(counts.groupBy("x.aa").agg(F.sum("x.n").alias("count")), "aa", "count", path, header=False)
    return files.probabilities(s, path).filter("prob > 0").select("aa", F.round("prob", 6).alias("prob"))


@query("src9_hit_list", "SELECT line_no, value, CAST(row_number() OVER (ORDER BY line_no) AS INTEGER) AS rank FROM (SELECT doc_id AS line_no, '  ' || doc_id || ' ECOD_' || source AS value FROM documents WHERE doc_id % 3 = 0 AND doc_id > 10 ORDER BY doc_id LIMIT 250)")
def _(s, d):
    value = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), F.col("doc_id").cast("string"), F.lit(" ECOD_"), F.col("source"))).otherwise(F.lit("other line"))
    return files.hit_list(table(s, d, "documents").select(F.col("doc_id").alias("line_no"), value.alias("value")), "ECOD")


@query("src10_assignment_file", f"WITH {ASSIGN} SELECT CAST(batch AS INTEGER) AS batch, pos, ecod FROM asg")
def _(s, d):
    path = place(s, "assignments")
    assignments(s, d).select(F.concat_ws(" ", F.col("batch").cast("string"), F.col("pos").cast("string"), "ecod").alias("value")).write.text(path)
    return files.assignments(s, path)


@query("src11_genome_file", f"WITH {GENOMES} SELECT fasta, md5(species) AS species_md5 FROM gen")
def _(s, d):
    path = place(s, "genomes")
    genome_table(s, d).select(F.concat_ws("\t", "species", "fasta").alias("value")).write.text(path)
    return files.genomes(s, path).select("fasta", F.md5("species").alias("species_md5"))


@query("snk1_table", f"WITH {PROT} SELECT org, count(*) AS prots, CAST(sum(len) AS BIGINT) AS residues FROM prot GROUP BY org")
def _(s, d):
    path = place(s, "table")
    for _ in range(2):  # a second write replaces the first as a whole
        tables.write_table(proteins(s, d), path)
    return s.read.parquet(path).groupBy("org").agg(F.count(F.lit(1)).alias("prots"), F.sum("len").cast("long").alias("residues"))


@query("snk3_map_file", f"WITH {PROT}, {prob_table()} SELECT aa, n AS count FROM pr WHERE n > 0")
def _(s, d):
    path = place(s, "map")
    found = co.letter_counts(proteins(s, d), (), RESIDUES).filter("count > 0")
    tables.write_map(found, "aa", "count", path, sep=";")
    return s.read.csv(path, sep=";", header=True, schema="aa string, count long")


@query("snk6_fasta_pairs", f"WITH {P} SELECT pm AS h, CAST(4 * count(*) AS BIGINT) AS lines, CAST(2 * count(*) AS BIGINT) AS heads FROM pm WHERE pm <= 14 GROUP BY pm")
def _(s, d):
    path = place(s, "pairs")
    rows = the_pairs(s, d).select("pair_id", "a_frag", "b_frag", hamming(F.col("a_frag"), F.col("b_frag")).alias("h")).filter("h <= 14")
    tables.write_fasta_pairs(rows, path, "h")
    return s.read.text(path).groupBy("h").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.startswith("value", F.lit(">"))).alias("heads"))


@query("snk5_accumulated_rounds", f"WITH {P} SELECT 'HD' AS alignment, 'natural' AS model, 100 * (20 - pm) AS score, CAST(0 AS INTEGER) AS replica, CAST(20 AS INTEGER) AS lf, CAST(100 AS INTEGER) AS domain, count(*) AS count FROM pm GROUP BY pm")
def _(s, d):
    path, pairs_ = place(s, "histogram"), the_pairs(s, d)
    stored = None
    for part in range(2):  # each round adds to what is stored and writes it anew
        own = pairs_.filter(F.col("pair_id") % 2 == part).groupBy((100 * (20 - hamming(F.col("a_frag"), F.col("b_frag")))).alias("score")).agg(F.count(F.lit(1)).alias("count"))
        own = own.select(F.lit("HD").alias("alignment"), F.lit("natural").alias("model"), "score", F.lit(0).alias("replica"), F.lit(20).alias("lf"), F.lit(100).alias("domain"), "count")
        tables.write_histogram(tables.merge_counts(stored, own, tables.SCORE_KEYS), f"{path}-{part}")
        stored = s.read.csv(f"{path}-{part}", sep="\t", header=True, schema="alignment string, model string, score int, replica int, lf int, domain int, count long")
    return stored


@query("agg36_incremental_histogram", f"WITH {PROT} SELECT CAST(len // 100 AS BIGINT) AS bin, count(*) AS count FROM prot GROUP BY 1")
def _(s, d):
    bins = proteins(s, d).select("prot_id", F.floor(F.col("len") / 100).alias("bin"))
    stored = None
    for part in range(3):
        own = bins.filter(F.col("prot_id") % 3 == part).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
        stored = tables.merge_counts(stored, own, ("bin",))
    return stored


@query("f16_primes", f"SELECT x AS n, len(list_filter(range(2, x), lambda d: x % d = 0)) = 0 AND x > 1 AS prime, {prime_above('x0')} AS next_prime FROM (SELECT x, x AS x0 FROM (SELECT unnest(range(1, 200)) AS x))")
def _(s, d):
    return s.createDataFrame([(n, is_prime(n), next_prime(n)) for n in range(1, 200)], "n long, prime boolean, next_prime long")


@query("src2_layer_reuse", f"WITH {PROT} SELECT org, CAST(sum(len) AS BIGINT) AS residues, CAST(2 AS INTEGER) AS times_made FROM prot GROUP BY org")
def _(s, d):
    layers, made = Layers(s, place(s, "layers")), []

    def make():
        made.append(1)
        return proteins(s, d).groupBy("org").agg(F.sum("len").cast("long").alias("residues"))

    base = layers.path("data")
    layers.layer("data", lambda: proteins(s, d).select("prot_id", "len"))
    for _ in range(2):
        layers.layer("residues", make, 1, (base,))  # made once, then taken
    proteins(s, d).select("prot_id", "len").write.mode("overwrite").parquet(base)
    found = layers.layer("residues", make, 1, (base,))  # what it was made from is newer
    return found.withColumn("times_made", F.lit(len(made)))


@query("j20_protein_at", f"WITH {PROT}, pst AS (SELECT *, CAST(coalesce(sum(len + 1) OVER (ORDER BY prot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gs FROM prot), wanted AS (SELECT unnest([0, 1000, 100000]) AS place) SELECT CAST(place AS BIGINT) AS place, prot_id, org, md5(seq) AS seq_md5 FROM wanted JOIN pst ON place >= gs AND place <= gs + len")
def _(s, d):
    from residua.sources.corpus import starts

    places = s.createDataFrame([(x,) for x in (0, 1000, 100000)], "place long")
    rows = starts(proteins(s, d))
    inside = (F.col("place") >= F.col("global_start")) & (F.col("place") <= F.col("global_start") + F.col("len"))
    return rows.join(F.broadcast(places), inside).select("place", "prot_id", "org", F.md5("seq").alias("seq_md5"))


J16_LF = 9


J16 = f"{PROT}, {km(J16_LF, 'prot_id', where=VALID)}, f AS MATERIALIZED (SELECT frag, count(*) AS hits FROM km GROUP BY frag), k AS MATERIALIZED (SELECT frag, hits, i, frag[1:i] || '.' || frag[i + 2:{J16_LF}] AS w FROM f, range({J16_LF}) r(i)), g AS MATERIALIZED (SELECT k.* FROM k SEMI JOIN (SELECT i, w FROM k GROUP BY i, w HAVING count(*) > 1) USING (i, w))"


@query("j16_neighbour_list", f"WITH {J16} SELECT a.frag, b.frag AS neighbour, b.hits AS neighbour_hits FROM g a JOIN g b ON a.w = b.w AND a.i = b.i WHERE a.frag <> b.frag")
def _(s, d):
    return distance.neighbour_list(ab.hits(proteins(s, d), J16_LF), J16_LF)


@query("j16_profile_neighbours", f"WITH {J16}, p AS (SELECT a.frag, a.i, b.frag AS neighbour, b.hits AS h FROM g a JOIN g b ON a.w = b.w AND a.i = b.i WHERE a.frag <> b.frag), t AS (SELECT frag, sum(h) AS n FROM p GROUP BY frag), o AS (SELECT frag, i, sum(h) AS n FROM p GROUP BY ALL) SELECT p.frag, neighbour, h AS neighbour_hits, round((({J16_LF} - 2) * t.n + o.n + h) / ({J16_LF} * t.n), 6) AS overlap FROM p JOIN t USING (frag) JOIN o ON o.frag = p.frag AND o.i = p.i WHERE (({J16_LF} - 2) * t.n + o.n + h) / ({J16_LF} * t.n) > 0.9")
def _(s, d):
    return distance.profile_neighbours(ab.hits(proteins(s, d), J16_LF), J16_LF).withColumn("overlap", F.round("overlap", 6))
