import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import AWKWARD, frame

from residua.llm import jaccard_join as op

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, k, num, den):
    sets = {}
    for i, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = set(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, own in sets.items():
        for s in own:
            lists[s].append(i)
    shared = Counter((min(a, b), max(a, b)) for own in lists.values() for x, a in enumerate(own) for b in own[:x])
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(own), find(i)) for i, own in sets.items()}


def near_copies(seed, groups):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for _ in range(groups):
        base = [rng.choice(words) + rng.choice(["", "x", "é"]) for _ in range(rng.choice([1, 2, 3, 5, 9, 13, 14, 15, 16, 17, 18, 20, 30, 60, 100]))]
        for _ in range(rng.randint(1, 10)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                p, r = rng.randrange(len(w)), rng.random()
                if r < 0.4:
                    w[p] = rng.choice(words)
                elif r < 0.7:
                    w.insert(p, rng.choice(words))
                elif len(w) > 1:
                    del w[p]
            docs.append(rng.choice([" ", "\n", " \t"]).join(x.upper() if rng.random() < 0.1 else x for x in w))
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    return docs


def run(spark, docs, *how, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in op.jaccard_components(frame(spark, docs).repartition(3), *how, **more).collect()}


@pytest.mark.parametrize(("how", "more"), [((4, 85, 100), {}), ((4, 85, 100), {"pack_tokens": 200, "list_limit": 2}), ((2, 80, 100), {"pack_tokens": 60}), ((5, 80, 100), {"max_broadcast_rows": 0})])
def test_matches_brute_force(spark, how, more):
    docs = near_copies(sum(how), 40) + [(9000 + r[0], r[1]) for r in AWKWARD]
    assert run(spark, docs, *how, **more) == brute(docs, *how)


def test_small_sets_are_enumerated_and_large_ones_listed():
    small = op.boundary(1.2, 85, 100)
    assert 6 <= small <= 20
    rng = np.random.default_rng(0)
    table, twice = np.zeros(1024, np.uint8), np.full(1024, 255, np.uint8)
    for n in range(1, 40):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for gone in range(0, n - op.needed(n, 85, 100) + 1):
            b = a[gone:]
            if len(b) and 100 * len(b) >= 85 * len(a):
                assert np.intersect1d(op.keys_of(a, table, twice, small, 85, 100), op.keys_of(b, table, twice, small, 85, 100)).size, (n, gone)


def test_bound_never_drops_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 800))
        base = np.unique(rng.integers(0, 2**63, n + 200).astype(np.uint64))
        a, b = base[:n], base[int(rng.integers(0, n // 8 + 1)) : n + int(rng.integers(0, n // 8 + 1))]
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert op.plausible(np.array([len(a), len(b)]), [op.sketch(a), op.sketch(b)], 85, 100).tolist() == [0, 0]


def components_of(sets, num, den):
    out = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if den * both >= num * (len(a) + len(sets[j]) - both):
                lo, hi = sorted((out[i], out[j]))
                out = [lo if x == hi else x for x in out]
    return out


def test_links_of_a_family_match_brute_force():
    def u(*x):
        return np.unique(np.array(x, np.uint64))

    # 0 reaches 1; both leave together, then 2 alone, which has another size than 0; 3 and 4 link
    a = np.arange(40)
    sets = [u(*a), u(*a, 40, 41, 42, 43), u(*a, 40, 41, 42, 43, 44, 45, 46, 47), u(*range(100, 120)), u(*range(100, 120), 120), u(*range(200, 230))]
    assert op.linked(sets, 85, 100).tolist() == components_of(sets, 85, 100) == [0, 0, 0, 3, 3, 5]
    rng = np.random.default_rng(3)
    for _ in range(150):
        sets = []
        for _ in range(int(rng.integers(1, 12))):  # chains of growing sets, each linked with the next, dealt in any order
            low, size = int(rng.integers(0, 10**6)), int(rng.integers(5, 60))
            for _ in range(int(rng.integers(1, 9))):
                sets.append(np.arange(low, low + size).astype(np.uint64))
                size += int(rng.integers(0, max(2, size // 6)))
        sets = [sets[i] for i in rng.permutation(len(sets))] if rng.random() < 0.5 else sets
        assert op.linked(sets, 85, 100).tolist() == components_of(sets, 85, 100)


def test_one_of_each_and_empty(spark):
    docs = near_copies(5, 15) + [(5000, "one two three four five six"), (5000, "one two three four five six"), (5001, None), (5002, None)]
    df = frame(spark, docs)
    found = op.jaccard_components(df, 5, 80, 100)
    out = op.one_of_each(df, found)
    want = brute(docs, 5, 80, 100)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in want.values()})
    assert op.jaccard_components(frame(spark, [])).count() == 0


def test_rows_without_an_id_stay(spark):
    text = "one two three four five six seven"
    df = frame(spark, [(1, text), (2, text), (None, text), (None, text), (None, None)])
    found = op.jaccard_components(df)
    assert sorted((r.doc_id or 0, r.component_id) for r in found.collect() if r.doc_id) == [(1, 1), (2, 1)]
    assert [r.component_id for r in found.collect() if r.doc_id is None] == [None] * 3
    assert sorted(r.doc_id or 0 for r in op.one_of_each(df, found).collect()) == [0, 0, 0, 1]


def test_an_id_with_two_texts(spark):
    text = "one two three four five six seven"
    docs = [(1, text), (5, text), (5, "something else altogether that nobody links with anything"), (7, "other words here for all to see and read"), (7, "OTHER words here for all to see and read"), (9, None), (9, "")]
    df = frame(spark, docs)
    for more in ({}, {"max_broadcast_rows": 0}):
        found = op.jaccard_components(df, **more)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == [(1, 4, 1), (5, 4, 1), (5, 5, 5), (7, 6, 7), (7, 6, 7), (9, 0, 9), (9, 0, 9)]
        out = sorted((r.doc_id, (r.text or "").lower()) for r in op.one_of_each(df, found, **more).collect())
        assert out == [(1, text), (5, docs[2][1]), (7, docs[3][1]), (9, "")]


def test_a_group_that_falls_apart_is_searched_in_blocks(spark):
    """Long lists whose documents don't link: all share a passage, in clusters of three that do link."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = []
    for c in range(60):
        own = [f"c{c}w{i}" for i in range(40)]
        for v in range(3):
            docs.append(f"{passage} {' '.join(own)} {' '.join(f'v{v}x{rng.randint(0, 9)}' for _ in range(2))}")
    docs = list(enumerate(docs))
    want = brute(docs, 4, 85, 100)
    assert len({c for _, c in want.values()}) == 60
    for more in ({"pack_tokens": 2000, "list_limit": 10}, {"pack_tokens": 300, "list_limit": 3}):
        assert run(spark, docs, **more) == want


def test_blocks_of_a_group_read_few_rows(spark):
    """What blocks read grows with the rows where a group hangs together."""
    read = spark.sparkContext.accumulator(0)

    def first(table):  # all of a group link
        read.add(table.num_rows)
        return op.star(table.column("doc_id").to_numpy(), [(own, np.zeros(len(own), int)) for own in op.by_group(table)])

    for n in (400, 1600):
        read.value = 0
        rows = spark.range(n).selectExpr("1L AS group", "id AS doc_id", f"{n}L AS load", f"{n}L AS n")
        edges = op.grouped_links(rows, first, 100, 100, "test")
        assert op.components(edges).select("root").distinct().count() == 1
        assert read.value < n + 20 * (2 * n // 100)
