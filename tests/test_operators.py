"""Operators against brute force on small fixtures, and their invariants."""

import hashlib
import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from residua.functions import strings
from residua.functions.alphabet import RESIDUES, is_prime, next_prime, normalise
from residua.operators import abundance, alignment, curation, distance, entropy, graph, homology, intervals, kmers, nullmodels, sampling, studies, suffix, within
from residua.sinks import tables
from residua.sources import corpus, files
from residua.sources.corpus import running, starts


def proteins(spark, seqs, orgs=None):
    rows = [(i, (orgs or ["o"] * len(seqs))[i], "c", s, len(s)) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "prot_id long, org string, clade string, seq string, len int")


def test_windows_at_every_edge(spark):
    seqs = ["", "A", "ACD", "ACDE", "AAAAAA", "AXCDX", "ACDEFGHIKL" * 60]
    got = sorted((r.prot_id, r.pos, r.frag) for r in kmers.windows(proteins(spark, seqs), 3).collect())
    assert got == sorted((i, p + 1, s[p : p + 3]) for i, s in enumerate(seqs) for p in range(len(s) - 2))
    valid = kmers.windows(proteins(spark, seqs), 3, valid_only=True)
    assert all("X" not in r.frag for r in valid.collect())
    n = proteins(spark, seqs).select(kmers.valid_windows(F.col("seq"), F.lit(3)).alias("n")).agg(F.sum("n")).first()[0]
    assert n == valid.count()


def test_fasta_and_normalisation(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_text(">p1 first protein OS=Some organism OX=1\nACD\nBJX\n>p2 empty OS=x\n>p3 lower\nacD*\n>p4\r\nAC\r\n")
    got = {r.name: r.seq for r in corpus.read_fasta(spark, str(path)).collect()}
    assert got["p1 first protein OS=Some organism OX=1"] == "ACDDXX"
    assert got["p2 empty OS=x"] == "" and got["p3 lower"] == "XXDX"
    head = spark.createDataFrame([("p1 first protein OS=Some organism",)], "h string").select(corpus.pretty_name(F.col("h"))).first()[0]
    assert head == " first protein"
    assert corpus.fasta_lines(spark, str(path)).filter("value like '>%'").count() == 0
    assert spark.createDataFrame([("a b\nZ-é",)], "t string").select(normalise(F.col("t"))).first()[0] == "ADEXX"


def brute_alignment(a, b, opening, free):
    low = -(10**9)
    n, m = len(a), len(b)
    h, e, f = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 and j == 0:
                h[0][0] = 0
                continue
            if j:
                e[i][j] = max(h[i][j - 1] + opening, e[i][j - 1] - 10)
            if i:
                f[i][j] = max(h[i - 1][j] + opening, f[i - 1][j] - 10)
            d = h[i - 1][j - 1] + 100 * (a[i - 1] == b[j - 1]) if i and j else low
            h[i][j] = max(d, e[i][j], f[i][j])
            if free and (i == 0 or j == 0):
                h[i][j] = 0
    return max([h[n][j] for j in range(m + 1)] + [h[i][m] for i in range(n + 1)]) if free else h[n][m]


def test_scores_equal_a_plain_recurrence():
    rng = random.Random(3)
    pairs = [("".join(rng.choice("ACDE") for _ in range(n)), "".join(rng.choice("ACDE") for _ in range(n))) for n in (1, 2, 3, 7, 12, 20) for _ in range(12)]
    got = alignment.scores([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), row in zip(pairs, got, strict=True):
        s = dict(zip(alignment.METRICS, row, strict=True))
        for name, opening in alignment.SCHEMES.items():
            assert s[f"NW{name}"] == brute_alignment(a, b, opening, False), (a, b, name)
            assert s[f"SW{name}"] == brute_alignment(a, b, opening, True), (a, b, name)
        assert s["HD"] == brute_alignment(a, b, -20000, False) and s["SH"] == brute_alignment(a, b, -20000, True)
        assert s["SH"] >= s["HD"] and all(s[f"SW{x}"] >= s[f"NW{x}"] >= s["HD"] for x in alignment.SCHEMES)
    back = alignment.scores([b for _, b in pairs], [a for a, _ in pairs])
    assert np.array_equal(got, back)


def test_score_pairs_and_histogram(spark):
    df = spark.createDataFrame([(1, "ACDE", "ACDE"), (2, "ACDE", "AC"), (3, None, "AC")], "pair_id long, frag1 string, frag2 string")
    out = {r.pair_id: r for r in alignment.score_pairs(df).collect()}
    assert out[1].HD == 400 and out[2].HD is None and out[3].SH is None
    h = alignment.score_histogram(alignment.score_pairs(df.filter("pair_id = 1")))
    assert h.agg(F.sum("count")).first()[0] == len(alignment.METRICS)


def test_string_functions(spark):
    df = spark.createDataFrame([("ACDEA", "ACCEA"), ("AAAA", "AAAA"), ("A", "C")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(strings.hamming(a, b), strings.common_prefix(a, b), strings.compositional_overlap(a, b)).collect()
    assert [tuple(r) for r in rows] == [(1, 2, 4), (0, 4, 4), (1, 0, 0)]


@pytest.mark.parametrize("group", [("prot_id",), ("org",), ()])
def test_shuffles_keep_residues_and_x(spark, group):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACDEFGX") for _ in range(rng.randint(1, 300))) for _ in range(12)]
    p = proteins(spark, seqs, [f"o{i % 3}" for i in range(12)])
    out = {r.prot_id: r.seq for r in nullmodels.permuted(p, group, "s", per_cell=7).collect()}
    assert all([c == "X" for c in out[i]] == [c == "X" for c in s] for i, s in enumerate(seqs))
    key = (lambda i: i) if group == ("prot_id",) else (lambda i: i % 3) if group else (lambda i: 0)
    for g in {key(i) for i in range(12)}:
        assert sorted("".join(seqs[i] for i in range(12) if key(i) == g)) == sorted("".join(out[i] for i in range(12) if key(i) == g))
    assert any(out[i] != s for i, s in enumerate(seqs))


@pytest.mark.parametrize("model", ["P3", "G1", "A2", "E0"])
def test_letters_at_places_are_those_of_the_whole_shuffle(spark, model, monkeypatch):
    from residua.operators import models

    rng = random.Random(6)
    seqs = ["".join(rng.choice("ACDEFGX") for _ in range(rng.randint(1, 300))) for _ in range(12)]
    p = proteins(spark, seqs, [f"o{i % 3}" for i in range(12)])
    whole = {r.prot_id: r.seq for r in nullmodels.permuted(p, models.GROUPS[model[0]], model, model[0] == "E").collect()}
    at = [(i, rng.randint(1, len(s) - 5)) for i, s in enumerate(seqs) if len(s) > 10]
    free = lambda s: len(s) - s.count("X")
    rows = [(model, k, i, free(seqs[i][: pos - 1]), free(seqs[i][pos - 1 : pos + 5])) for k, (i, pos) in enumerate(at)]
    places = spark.createDataFrame(rows, "model string, place long, prot_id long, before long, n long")
    if model[0] in "GA":  # the whole shuffle isn't made on the way
        monkeypatch.setattr(nullmodels, "keyed_cells", None)
    got = {r.place: r.letters for r in nullmodels.letters_at(p, places, models.GROUPS[model[0]], model[0] == "E", per_cell=7).collect()}
    want = {k: whole[i][pos - 1 : pos + 5].replace("X", "") for k, (i, pos) in enumerate(at)}
    assert {k: got.get(k, "") for k in want} == want


def test_numbered_keys_are_md5():
    import hashlib

    from residua.functions.keys import numbered_keys

    prefixes = [b"", b"G1:7:", b"x" * 45, b"A:-12345678901:"]
    numbers = [1, 9, 10, 99, 100, 12345, 99_999, 1_000_000]
    for some in (prefixes, [*prefixes, b"y" * 80]):
        owner, number = np.repeat(np.arange(len(some)), len(numbers)), np.tile(numbers, len(some))
        want = b"".join(hashlib.md5(x + b"%d" % n).digest() for x in some for n in numbers)
        assert numbered_keys(some, owner, number, chunk=5).tobytes() == want


def test_equal_model_is_even(spark):
    p = proteins(spark, ["A" * 400])
    seq = nullmodels.permuted(p, (), "e", True).first().seq
    assert {seq.count(c) for c in RESIDUES} == {20}


@pytest.mark.parametrize("lf", [1, 7, 10, 23])
def test_distances_to_queries_by_brute_force(spark, lf, monkeypatch):
    rng = random.Random(lf)
    word = lambda: "".join(rng.choice("ACDXYZ") for _ in range(lf))
    asked, hits = [(7 * i, word()) for i in range(9)], {word(): rng.randint(1, 3) for _ in range(200)}
    hits[asked[0][1]] = 1
    want = Counter()
    for g, q in asked:
        for f, n in hits.items():
            want[g, sum(x != y for x, y in zip(f, q, strict=True))] += n
    monkeypatch.setattr(distance, "hamming", None)  # pairs aren't rows
    sample, frags = spark.createDataFrame(asked, "gpos long, frag string"), spark.createDataFrame(list(hits.items()), "frag string, hits long")
    rows = lambda **k: {(r.gpos, r.pm): r["count"] for r in distance.against(sample, frags, lf=lf, **k).collect()}
    assert rows(skip_self=False, block=4) == want
    assert rows(skip_self=True) == {k: n - (k[1] == 0) for k, n in want.items() if n > (k[1] == 0)}


def test_exhaustive_distance_by_brute_force(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACD") for _ in range(30)) for _ in range(4)]
    w = [s[i : i + 4] for s in seqs for i in range(len(s) - 3)]
    want = {}
    for a in w:
        for b in w:
            pm = sum(x != y for x, y in zip(a, b, strict=True))
            want[pm] = want.get(pm, 0) + 1
    got = {r.pm: r["count"] for r in distance.exhaustive(proteins(spark, seqs), 4).collect() if r["count"]}
    assert got == want


def test_component_by_brute_force(spark):
    rng = random.Random(2)
    frags = sorted({"".join(rng.choice("ACD") for _ in range(6)) for _ in range(60)})
    df = spark.createDataFrame([(f,) for f in frags], "frag string")
    for pm in (1, 2):
        reached, todo = {frags[0]}, [frags[0]]
        while todo:
            v = todo.pop()
            for f in frags:
                if f not in reached and sum(x != y for x, y in zip(v, f, strict=True)) <= pm:
                    reached.add(f)
                    todo.append(f)
        comp = graph.component(df, df.filter(F.col("frag") == frags[0]), 6, pm)
        assert {r.frag for r in comp.collect()} == reached
    assert graph.nearest(df, frags[3]).first().pm == 0


def test_components_by_brute_force(spark):
    rng = random.Random(7)
    frags = sorted({"".join(rng.choice("ACDEFG") for _ in range(6)) for _ in range(400)})
    df = spark.createDataFrame([(f,) for f in frags], "frag string")
    for pm in (1, 2):
        near = {f: [g for g in frags if sum(x != y for x, y in zip(f, g, strict=True)) <= pm] for f in frags}
        root: dict[str, str] = {}
        for f in frags:
            todo = [] if f in root else [f]
            while todo:
                v = todo.pop()
                if v not in root:
                    root[v] = f
                    todo += near[v]
        assert {r.frag: r.root for r in graph.components(df, 6, pm).collect()} == root
        sizes = Counter(root.values())
        want = {(f, sizes[root[f]]) for f in frags[::9]}
        assert {tuple(r) for r in graph.seeded(df, 6, pm, 9).collect()} == want
    chain = [f"{'C' * i}{'A' * (30 - i)}" for i in range(31)]  # a long path
    assert {r.root for r in graph.components(spark.createDataFrame([(f,) for f in chain], "frag string"), 30, 1).collect()} == {chain[0]}
    assert graph.components(spark.createDataFrame([], "frag string"), 6, 1).count() == 0


def test_profile_neighbours_by_the_profile(spark):
    rng = random.Random(3)
    hits = {"".join(rng.choice("ACD") for _ in range(9)): rng.randint(1, 50) for _ in range(1500)}
    want = set()
    for f in hits:
        near = [g for g in hits if sum(x != y for x, y in zip(f, g, strict=True)) == 1]
        if not near:
            continue
        profile = [Counter() for _ in range(9)]
        for g in near:
            for i, ch in enumerate(g):
                profile[i][ch] += hits[g]
        total = sum(hits[g] for g in near)
        for g in near:
            overlap = sum(profile[i][ch] / total for i, ch in enumerate(g)) / 9
            if overlap > 0.9:
                want.add((f, g, hits[g], round(overlap, 6)))
    got = distance.profile_neighbours(spark.createDataFrame(list(hits.items()), "frag string, hits long"), 9)
    assert {(r.frag, r.neighbour, r.neighbour_hits, round(r.overlap, 6)) for r in got.collect()} == want and want


def test_pairs_of_batches_in_tiles(spark):
    rng = random.Random(5)
    rows = [(b, g) for b, n in ((0, 13), (1, 5), (2, 0), (3, 7)) for g in rng.sample(range(1000), n)]
    frags = spark.createDataFrame(rows, "batch int, gpos long")
    for which, cmp in (("ali", lambda a, b: a > b), ("ali2", lambda a, b: a < b), ("ali3", lambda a, b: a == b)):
        own = {b: sorted(g for x, g in rows if x == b) for b in range(4)}
        want = {(b, (b + 1) % 4, p, q) for b in range(4) for i, p in enumerate(own[b]) for j, q in enumerate(own[(b + 1) % 4]) if cmp(i, j)}
        for side in (3, 256):
            got = {(r.batch1, r.batch2, r.pos1, r.pos2) for r in homology.pair_batches(frags, which, 4, side).collect()}
            assert got == want
        name = {"ali": "above", "ali2": "below", "ali3": "equal"}[which]
        counted = Counter((a, b) for a, b, *_ in want)
        assert all(counted[r.batch1, r.batch2] == r[name] for r in homology.ring_sizes(frags, 4).collect())


def test_counted_pairs_are_the_listed_ones(spark):
    rng, n_batches, cuts = random.Random(8), 3, (20, 60)
    frags = spark.createDataFrame([(b, 10 * i + b) for b, n in enumerate((7, 11, 4)) for i in range(n)], "batch int, gpos long")
    ids = [(r.batch, r.gpos, e) for r in frags.collect() for e in rng.choice(([], [None], ["1.1.1"], ["1.2.1", "2.1"], ["2.1"], ["3.1"], ["2.2", None]))]
    assign = spark.createDataFrame(ids, "batch int, pos long, ecod string")
    score = lambda b1, p1, b2, p2: (p1[:, None] * 7 + p2[None, :] * 3 + b1) % 100
    listed = None
    for which in ("ali", "ali2", "ali3"):
        own = homology.pair_batches(frags, which, n_batches, 4).withColumn("alignment", F.lit(which))
        listed = own if listed is None else listed.unionByName(own)
    value = (F.col("pos1") * 7 + F.col("pos2") * 3 + F.col("batch1")) % 100
    rows = homology.family_h(homology.classify(listed, assign, True), assign).withColumn("band", F.when(value < 20, 0).when(value < 60, 1).otherwise(2))
    keys = ["alignment", "batch1", "batch2", "class", "same_h", "band"]
    want = Counter(tuple(r) for r in rows.select(*keys).collect())
    got = {tuple(r[k] for k in keys): r.pairs for r in homology.counted(frags, assign, n_batches, score, cuts, side=4).collect()}
    assert len(want) > 40 and got == want
    assert sum(r.pairs for r in homology.counted(frags, assign, n_batches).collect()) == sum(want.values())


def test_genome_lines_hold_anything(spark, tmp_path):
    lines = ['"quoted" species\tUP1_1.fasta', "tab\there\tUP2_1.fasta", " blanks \tUP3_1.fasta", "\tUP4_1.fasta", "no tab"]
    (tmp_path / "g.tsv").write_text("\n".join(lines) + "\n")
    got = sorted(tuple(r) for r in files.genomes(spark, str(tmp_path / "g.tsv")).collect())
    assert got == sorted([('"quoted" species', "UP1_1.fasta"), ("tab\there", "UP2_1.fasta"), (" blanks ", "UP3_1.fasta"), ("", "UP4_1.fasta")])


def test_rounds_go_on_where_they_ended(spark, tmp_path, monkeypatch):
    from residua.operators import models

    rng = random.Random(4)
    p = proteins(spark, ["".join(rng.choice("ACDEFG") for _ in range(150)) for _ in range(6)], ["x", "y"] * 3)
    made = []
    real = models.evaluate
    monkeypatch.setattr(models, "evaluate", lambda *a: made.append(a[-1]) or real(*a))
    rows = lambda df: sorted(map(tuple, df.collect()))
    once = rows(models.evaluate_rounds(spark, p, ("natural",), 10, 20, 30, 3, str(tmp_path / "a")))
    models.evaluate_rounds(spark, p, ("natural",), 10, 20, 30, 2, str(tmp_path / "b"))
    (tmp_path / "b" / "round_1" / "_SUCCESS").unlink()  # as if the second round had been ended
    again = rows(models.evaluate_rounds(spark, p, ("natural",), 10, 20, 30, 3, str(tmp_path / "b")))
    assert again == once and made == [0, 1, 2, 0, 1, 1, 2]


def test_pair_studies(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ACDE") for _ in range(12))
    rows = [(i, rng.choice("xy"), rng.choice("xy"), rng.randint(1, 3), rng.randint(1, 3), word(), word()) for i in range(60)]
    pairs = spark.createDataFrame(rows, "pair_id long, a_org string, b_org string, a_prot long, b_prot long, a_frag string, b_frag string")
    made = studies.replicas(pairs, 3, "s").collect()
    at = {r[0]: r for r in rows}
    for r in made:
        assert sorted(r.a_frag) == sorted(at[r.pair_id][5]) and sorted(r.b_frag) == sorted(at[r.pair_id][6])
        assert r.model == "shuffled" or (r.a_frag, r.b_frag) == at[r.pair_id][5:]
    assert Counter(r.model for r in made) == {"natural": 60, "shuffled": 180}
    pm = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    got = {(r.series, r.pm): r["count"] for r in studies.orthologs(pairs, 3).collect()}
    want = Counter(("natural" if r[1] != r[2] else "same_organism", pm(r[5], r[6])) for r in rows)
    assert {k: v for k, v in got.items() if k[0] != "shuffled"} == want
    assert sum(v for k, v in got.items() if k[0] == "shuffled") == 3 * sum(v for k, v in want.items() if k[0] == "natural")
    got = {(r.org, r.same_prot, r.pm): r["count"] for r in studies.paralogs(pairs, 3).filter("model = 'natural'").collect()}
    assert got == Counter((r[1], r[3] == r[4], pm(r[5], r[6])) for r in rows if r[1] == r[2])
    local = Counter()
    for _, _, _, _, _, a, b in rows:
        if 5 <= pm(a, b) <= 9:
            same = [i for i in range(12) if a[i] == b[i]]
            local.update((pm(a, b), j - i, a[i], a[j]) for k, i in enumerate(same) for j in same[k + 1 :])
    found = studies.twilight_locality(pairs, (5, 9), 2).filter("model = 'natural'").collect()
    assert {(r.pm, r.distance, r.aa1, r.aa2): r["count"] for r in found} == local
    first = studies.examples(pairs, 2).collect()
    assert all(r.rank <= 2 for r in first) and len({r.pm for r in first}) == len({pm(r[5], r[6]) for r in rows})
    lengths = studies.shuffle_models(pairs, (2, 12)).filter("model = 'natural'").collect()
    assert {(r.lf, r.pm): r["count"] for r in lengths} == Counter((n, pm(r[5][:n], r[6][:n])) for r in rows for n in range(2, 13))


def test_maximal_repeats_and_unique_lengths(spark):
    seqs = ["ACDEFGHACDEFGK", "XACDEF", "AAAAAA"]
    base = suffix.corpus(proteins(spark, seqs, ["o", "p", "q"]))
    got = {(r.lf, r.frag, r.hits) for r in intervals.with_text(intervals.maximal_repeats(suffix.ordered(base)), base).collect()}
    assert (6, "ACDEFG", 2) in got and (5, "ACDEF", 3) in got and (4, "ACDE", 3) not in got
    assert (3, "AAA", 4) in got  # two of its places don't overlap
    text = "ACACD"
    want = {}
    for i in range(len(text)):
        for n in range(1, len(text) - i + 1):
            if sum(text[j : j + n] == text[i : i + n] for j in range(len(text) - n + 1)) == 1:
                want[n] = want.get(n, 0) + 1
                break
    assert {r.length: r["count"] for r in suffix.unique_lengths(suffix.ordered(suffix.corpus(proteins(spark, [text])))).collect()} == want


def test_suffix_order(spark):
    seqs = ["BANANA".replace("B", "D"), "ANA", "A"]
    out = suffix.ordered(suffix.corpus(proteins(spark, seqs))).orderBy("rank").collect()
    want = sorted((s[i:], p, i + 1) for p, s in enumerate(seqs) for i in range(len(s)))
    assert [(seqs[r.prot_id][r.pos - 1 :], r.prot_id, r.pos) for r in out] == want
    lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert [r.next for r in out] == [*(lcp(a[0], b[0]) for a, b in pairwise(want)), 0]


def test_classes_in_the_order_given(spark):
    assign = spark.createDataFrame([(0, 1, "1.1.1.1"), (0, 2, None), (1, 1, "1.2.1.1"), (1, 2, "2.1.1.1"), (1, 3, None), (0, 4, "9"), (1, 4, "9")], "batch int, pos long, ecod string")
    rows = [(0, 1, 1, 1), (0, 1, 1, 2), (0, 1, 1, 3), (0, 2, 1, 9), (0, 1, 1, 9), (0, 9, 1, 1), (0, 4, 1, 4)]
    pairs = spark.createDataFrame(rows, "batch1 int, pos1 long, batch2 int, pos2 long")
    got = {(r.pos1, r.pos2): r["class"] for r in homology.classify(pairs, assign).collect()}
    assert got == {(1, 1): "P", (1, 2): "C", (1, 3): "Q", (2, 9): "Q", (4, 4): "P"}
    assert homology.classify(pairs, assign, True).filter("class is null").count() == 2


def test_triangles_make_up_all_pairs(spark):
    f = spark.createDataFrame([(b, 1000 * b + i) for b in range(3) for i in range(4 + b)], "batch int, gpos long")
    n = {w: homology.pair_batches(f, w, 3).count() for w in ("ali", "ali2", "ali3")}
    assert sum(n.values()) == 4 * 5 + 5 * 6 + 6 * 4 and n["ali3"] == 4 + 5 + 4


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "r.align").write_text("log\nCommand      hhalign -i a3m_0/frag_30.a3m -t a3m_1/frag_77.a3m\n\nNo 1\n\nProbab=88.71  E=1\nCommand      hhalign -i a3m_0/frag_31.a3m -t a3m_1/frag_78.a3m\n\nnone\n")
    assert [tuple(r) for r in files.read_alignments(spark, str(tmp_path / "r.align")).collect()] == [(0, 30, 1, 77, 88.71)]
    (tmp_path / "a.assign").write_text("5 10050000 4321.1.1.8\n5 1004050000\n")
    assert sorted((r.pos, r.ecod) for r in files.assignments(spark, str(tmp_path / "a.assign")).collect()) == [(10050000, "4321.1.1.8"), (1004050000, None)]
    lines = spark.createDataFrame([("head",), ("more 1 2",), ("ACDE 17",), ("ACDF 5",)], "value string")
    assert [tuple(r) for r in files.fragments(lines, 10).collect()] == [("ACDE", 17)]
    (tmp_path / "aa.csv").write_text("A,6\nB,1\nD,1\nX,50\n")
    assert {r.aa: r.prob for r in files.probabilities(spark, str(tmp_path / "aa.csv")).collect()} == {"A": 0.75, "D": 0.25}
    (tmp_path / "g.tsv").write_text("Escherichia coli (strain K)\tUP1_1.fasta\nuncultured thing\tUP2_2.fasta\nCandidatus X\tUP3_3.fasta\n[Bacillus] 'x'\tUP4_4.fasta\nFoo-like y\tUP5_5.fasta\n")
    got = curation.curated(files.genomes(spark, str(tmp_path / "g.tsv")))
    assert [tuple(r) for r in got.collect()] == [("Bacillus", "UP4_4.fasta"), ("Escherichia", "UP1_1.fasta")]
    folder = tmp_path / "fa"
    folder.mkdir()
    (folder / "UP9_7.fasta").write_text(">tr|K8E1|K8E1_CARML desc\nACD\n>tr|K8E2|K8E2_CARML\nAC\n")
    (folder / "UP8_3.fasta").write_text(">sp|P1|NAME_SPEC other=1\nACD\n")
    assert sorted(tuple(r) for r in files.identifiers(spark, str(folder)).collect()) == [("UP8", "NAME_SPEC"), ("UP9", "K8E1_CARML")]
    assert files.listing(spark, str(folder)).count() == 2
    h = spark.createDataFrame([("HD", "n", 100, 0, 20, 100, 3)], "alignment string, model string, score int, replica int, lf int, domain int, count long")
    merged = tables.merge_counts(h, h, tables.SCORE_KEYS)
    assert merged.first()["count"] == 6
    tables.write_histogram(merged, str(tmp_path / "h"))
    assert spark.read.csv(str(tmp_path / "h"), sep="\t", header=True).count() == 1
    tables.write_map(h, "score", "count", str(tmp_path / "m"))
    tables.write_fasta_pairs(spark.createDataFrame([(1, "AC", "AD", 2)], "pair_id long, a_frag string, b_frag string, h int"), str(tmp_path / "p"), "h")
    assert spark.read.text(str(tmp_path / "p" / "h=2")).count() == 4
    hits = spark.createDataFrame([(i, f"  {i} ECOD_{i} x") for i in range(1, 30)], "line_no int, value string")
    assert [r.line_no for r in files.hit_list(hits, "ECOD", 5).orderBy("rank").collect()] == [11, 12, 13, 14, 15]


def test_samples(spark):
    p = proteins(spark, ["ACDEFGHIKL" * 5, "ACD", "LKIHGFEDCA" * 7])
    s = sampling.systematic(p, 10, 7, 3, 2).collect()
    text, start = "", {}
    for i, n in enumerate((50, 3, 70)):
        start[i] = len(text)
        text += [r.seq for r in p.orderBy("prot_id").collect()][i] + "\0"
    want = {(b, g) for b in range(2) for g in range(b * 3, len(text), 7) if "\0" not in text[g : g + 10] and len(text[g : g + 10]) == 10}
    assert {(r.batch, r.gpos) for r in s} == want and all(text[r.gpos : r.gpos + 10] == r.frag for r in s)
    pairs = sampling.pairs(spark, p, 5, 200).collect()
    assert pairs and all(text[r.pos1 : r.pos1 + 5] == r.a_frag and text[r.pos2 : r.pos2 + 5] == r.b_frag and r.pos2 > r.pos1 + 5 for r in pairs)
    assert is_prime(2) and not is_prime(1) and next_prime(7) == 11


def test_starts_with_null_and_sparse_ids(spark):
    rows = [(10**15, "ACD"), (5, "AC"), (None, "ACDE"), (-3, ""), (7, "A")]
    p = spark.createDataFrame(rows, "prot_id long, seq string").withColumn("len", F.length("seq"))
    assert {r.prot_id: r.global_start for r in starts(p).collect()} == {-3: 0, 5: 1, 7: 4, 10**15: 6, None: 10}
    many = spark.range(0, 3_000_000, 1000).selectExpr("id * id AS prot_id", "CAST(id % 7 AS INT) AS len")
    got = running(many, "prot_id", F.col("len"), "s", per_range=100).orderBy("prot_id").collect()
    total = 0
    for r in got:
        assert r.s == total
        total += r.len
    by = running(many.withColumn("g", F.when(F.col("len") > 0, F.col("len"))), "prot_id", F.lit(1), "s", ("g",), 100)
    assert by.groupBy("g").agg(F.max("s").alias("m"), F.count(F.lit(1)).alias("n")).filter("m <> n - 1").count() == 0


def test_ortholog_paralog_pairs(spark):
    p = proteins(spark, ["ACDACD", "ACD", "ACD"], ["x", "x", "y"])
    r = {x.frag: x for x in abundance.ortholog_paralog(p, 3).collect()}["ACD"]
    assert (r.total, r.ortho, r.para) == (4, 3, 3)


def test_models_and_seeded_components(spark):
    from residua.operators import models

    rng = random.Random(4)
    p = proteins(spark, ["".join(rng.choice("ACDEFG") for _ in range(150)) for _ in range(6)], ["x", "y"] * 3)
    for name in ("natural", "F", "D", "k3", "T1", "P1", "E0"):
        rows = models.model_pairs(spark, p, name, 10, 100, 60).collect()
        assert rows and all(len(r.frag1) == len(r.frag2) == 10 for r in rows), name
    h = models.evaluate(spark, p, ("natural", "F"), 10, 100, 60)
    totals = {r.model: r.n for r in h.groupBy("model").agg(F.sum("count").alias("n")).collect()}
    assert totals["natural"] == totals["F"] and totals["F"] % len(alignment.METRICS) == 0
    frags = [f"{a}{b}{c}" for a in "AC" for b in "AC" for c in "AC"] + ["FFF"]
    out = graph.seeded(spark.createDataFrame([(f,) for f in frags], "frag string"), 3, 1, 8)
    assert {(r.seed, r["size"]) for r in out.collect()} == {("AAA", 8), ("FFF", 1)}


def test_packed_graph_by_brute_force(spark):
    rng = random.Random(8)
    seqs = ["".join(rng.choices("ACDX", [6, 6, 6, 1], k=rng.randint(0, 90))) for _ in range(14)] + ["A" * 40]
    p = proteins(spark, seqs, ["o"] * len(seqs))
    for lf in (6, 12):
        frags = sorted({s[i : i + lf] for s in seqs for i in range(len(s) - lf + 1)} - {f for s in seqs for i in range(len(s) - lf + 1) if "X" in (f := s[i : i + lf])})
        near = {f: [g for g in frags if sum(x != y for x, y in zip(f, g, strict=True)) == 1] for f in frags}
        words = graph.fragments(p, lf)
        shared = graph.one_apart(words, lf, 50).cache()
        degree = shared.groupBy("a").agg(F.sum(F.col("n") - 1).alias("n")).select(graph.text(F.col("a"), lf).alias("frag"), "n")
        assert {r.frag: r.n for r in degree.collect()} == {f: len(g) for f, g in near.items() if g}
        root = {}
        for f in frags:
            todo = [f] if f not in root else []
            while todo:
                g = todo.pop()
                if g not in root:
                    root[g] = f
                    todo += near[g]
        got = graph.grown(shared).select(graph.text(F.col("frag"), lf).alias("frag"), graph.text(F.col("root"), lf).alias("root"))
        assert {r.frag: r.root for r in got.collect()} == {f: r for f, r in root.items() if near[f]}
        size = Counter(root.values())
        assert {tuple(r) for r in graph.seeded_words(words, lf, 7).collect()} == {(f, size[root[f]]) for f in frags[::7]}
    none = graph.fragments(proteins(spark, ["AC"], ["o"]), 12)
    assert graph.one_apart(none, 12).count() == 0 and graph.seeded_words(none, 12, 7).count() == 0


@pytest.mark.parametrize("name", ["j17_component", "j18_seeded_components"])
def test_graph_queries_list_no_patterns_as_text(spark, monkeypatch, name):
    import os

    from residua.plans import pair_queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    monkeypatch.setattr(graph, "open_patterns", None)
    monkeypatch.setattr(distance, "wildcards", None)
    assert pair_queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_pairs_are_dealt_out_by_their_number(spark):
    f = spark.createDataFrame([(b, 1000 * b + i) for b in range(3) for i in range(200)], "batch int, gpos long")
    assign = spark.createDataFrame([(b, 1000 * b + i, None if i % 7 == 0 else f"{i % 5}.1") for b in range(3) for i in range(200) if i % 11], "batch int, pos long, ecod string")
    tiles = 3 * 25 * 26 // 2
    got = homology.pair_batches(f, "ali", 3, 8)
    assert got.rdd.getNumPartitions() >= tiles // homology.DEALT
    sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 3 * 200 * 199 // 2 and max(sizes) <= 64 * homology.DEALT
    # classes are known before there are pairs, which no join deals out again
    by_pair = homology.classified(f, assign, 3, 8)
    plan = by_pair._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate explode")]
    pairs = homology.paired(f, 3).select("alignment", "batch1", "batch2", "pos1", "pos2")
    want = homology.classify(pairs, assign).select(*by_pair.columns)
    assert by_pair.exceptAll(want).isEmpty() and by_pair.count() == want.count() > 50_000


def test_records_of_a_report_are_made_and_read_once(spark):
    rng = random.Random(3)
    parts = ["a3m_1/frag_22", "a3m_30/frag_4", "/frag_5", "a3m_6/", ".a3m", " ", "\n", " -t ", "Probab=", "77.5", "8", "x", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(4, 16))) for _ in range(4000)]
    side = r"a3m_([0-9]+)/frag_([0-9]+)"

    def read(v):
        m, p = re.search(rf"{side}\S*\s.*?{side}", v), re.search("Probab=([0-9.]+)", v)
        return (*map(int, m.groups()), float(p[1]))

    texts = [v for v in texts if not re.search(r"Probab=[0-9.]*\.[0-9.]*\.|Probab=(?![0-9])|Probab=\.", v)]  # one number each
    want = sorted(read(v) for v in texts if "Probab=" in v and re.search(rf"{side}\S*\s.*?{side}", v))
    records = spark.createDataFrame([(v,) for v in texts], "value string")
    assert sorted(tuple(r) for r in files.alignments(records).collect()) == want and len(want) > 20
    made = files.alignments(records.select(F.concat("value", F.md5("value")).alias("value")))
    assert made._jdf.queryExecution().executedPlan().toString().count("md5(") == 1


def test_gaps_are_counted_inside_proteins(spark):
    rng = random.Random(12)
    rows = [(i % 37 if i % 5 else None if i % 2 else 100 + i, "".join(rng.choice("ACDX") for _ in range(rng.choice((0, 1, 3, 40))))) for i in range(60)]
    p = spark.createDataFrame(rows, "prot_id long, seq string")
    places = {}
    for ident, seq in rows:  # rows of an id are one protein
        for i, c in enumerate(seq):
            if c != "X":
                places.setdefault((ident, c), []).append(i)
    found = {k: Counter(b - a for a, b in pairwise(sorted(v))) for k, v in places.items() if len(v) > 1}
    want = Counter()
    for (_, c), n in found.items():
        want.update({(c, g): m for g, m in n.items()})
    got = entropy.gap_counts(p)
    assert {(r.aa, r.gap): r["count"] for r in got.collect()} == want
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    batch = pa.RecordBatch.from_pylist(sorted(({"prot_id": i, "seq": s} for i, s in rows), key=lambda r: (r["prot_id"] is not None, r["prot_id"] or 0)))
    parts = Counter()
    for out in within.gap_counts([batch.slice(0, 17), batch.slice(17)], 10):
        parts.update({(r["aa"], r["gap"]): r["n"] for r in out.to_pylist()})
    assert parts == want
    own = {c: [-sum(m / n.total() * np.log2(m / n.total()) for m in n.values()) for (_, x), n in found.items() if x == c] for c in "ACD"}
    for r in entropy.gap_entropies(p).collect():
        assert r.prots == len(own[r.aa]) and abs(r.mean - np.mean(own[r.aa])) < 1e-9 and abs(r.deviation - np.std(own[r.aa])) < 1e-9


def test_own_shuffles_keep_rows_apart(spark):
    rows = [(i, s) for i, s in enumerate(("ACDXEFG", "", "XX", "A", "ACDEFGHIKL" * 30))]
    p = spark.createDataFrame([(i, s, len(s)) for i, s in rows], "prot_id long, seq string, len int")
    got = {r.prot_id: r.seq for r in nullmodels.permuted(p, ("prot_id",), "s").collect()}
    for i, s in rows:
        order = iter(c for _, _, c in sorted((hashlib.md5(f"s:{i}:{k}".encode()).hexdigest(), k, c) for k, c in enumerate(s, 1) if c != "X"))
        assert got[i] == "".join(c if c == "X" else next(order) for c in s)
    batch = pa.RecordBatch.from_pylist([{"prot_id": i, "ident": str(i), "seq": s} for i, s in rows])
    assert {r["prot_id"]: r["seq"] for out in nullmodels.own_order([batch], "s", 5) for r in out.to_pylist()} == got


@pytest.mark.parametrize("lf", [2, 5, 12, 13])
def test_hits_per_protein_count_proteins_once(spark, lf):
    rng = random.Random(lf)
    seqs = [rng.choice(("ACDACD", "AXCADY", "Y", "")) * rng.randrange(1, 9) for _ in range(60)]
    rows = [(i % 37 if i % 5 else None, s) for i, s in enumerate(seqs)]  # rows of an id are one protein, null is none
    places = [(s[i : i + lf], ident) for ident, s in rows for i in range(len(s) - lf + 1) if "X" not in s[i : i + lf]]
    want = {f: (len({i for g, i in places if g == f and i is not None}), n) for f, n in Counter(f for f, _ in places).items()}
    p = spark.createDataFrame([(i, s, len(s)) for i, s in rows], "prot_id long, seq string, len int")
    assert {r.frag: (r.prots, r.hits) for r in abundance.hits_per_protein(p, lf).collect()} == want
    top = max(n for n, _ in want.values())
    assert {r.frag for r in abundance.most_often(p, lf, 2).collect()} == {f for f, (n, _) in want.items() if n == top}
    if lf <= within.LETTERS:
        batch = pa.RecordBatch.from_pylist([{"prot_id": i, "seq": s} for i, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))])
        parts = Counter()
        for out in within.fragment_counts([batch.slice(0, 23), batch.slice(23)], lf, 30):
            for r in out.to_pylist():
                parts[r["word"], "prots"] += r["prots"]
                parts[r["word"], "hits"] += r["hits"]
        assert sorted(parts.values()) == sorted(x for v in want.values() for x in v)


def test_replicas_are_dealt_out_and_in_keyed_order(spark):
    rng = random.Random(21)
    rows = [(i, *("".join(rng.choice(RESIDUES) for _ in range(rng.randrange(1, 9))) for _ in "ab"), i % 3) for i in range(40)]
    p = spark.createDataFrame(rows, "pair_id long, a_frag string, b_frag string, org int").coalesce(1)
    made = studies.replicas(p, 3, "s")
    assert made.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    order = lambda t, s, i, r: "".join(c for _, _, c in sorted((hashlib.md5(f"s{s}:{i}:{r}:{k}".encode()).hexdigest(), k, c) for k, c in enumerate(t)))
    want = [(i, o, a, b, "natural") for i, a, b, o in rows] + [(i, o, order(a, "a", i, r), order(b, "b", i, r), "shuffled") for i, a, b, o in rows for r in (1, 2, 3)]
    assert sorted(tuple(r) for r in made.select("pair_id", "org", "a_frag", "b_frag", "model").collect()) == sorted(want)


@pytest.mark.parametrize(("part", "most"), [(7, 5), (1 << 18, 1 << 22)])
def test_first_places_are_found_inside_tasks(part, most):
    import pyarrow as pa

    from residua.operators import heads

    rng = random.Random(3)
    texts = ["".join(rng.choices("ACX", k=rng.randint(0, 30))) for _ in range(12)]
    ids = [7, 7, None, 3, 9, 2**62, -4, None, 11, 12, 13, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["prot_id", "seq"])
    want, got = {}, {}
    for i, t in zip(ids, texts, strict=True):
        for k in range(len(t) - 2):
            word = sum((ord(c) & 31) << 5 * (2 - j) for j, c in enumerate(t[k : k + 3]))
            want[word] = min(want.get(word, (True, 0, 0)), (i is None, i or 0, k + 1 if i is not None else 0))
    told = [r for b in heads.first_places(iter([batch]), 3, part, most) for r in b.to_pylist()]
    for r in told:
        key = (r["prot_id"] is None, r["prot_id"] or 0, r["pos"] if r["prot_id"] is not None else 0)
        got[r["word"]] = min(got.get(r["word"], key), key)
    assert got == want and (most == 5 or len(told) == len(want))
