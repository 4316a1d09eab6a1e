import random
from collections import defaultdict

import pytest
from helpers import AWKWARD, frame

from residua.llm import mixing as op


def water(sizes, weights, total, most):
    """Shares by weight; the excess over most * size is handed on until there is none."""
    got = [0.0] * len(sizes)
    free, open_ = total, {i for i in range(len(sizes)) if sizes[i]}
    while free > 1e-9 and open_:
        w = sum(weights[i] for i in open_)
        for i in open_:
            got[i] += free * weights[i] / w
        free = 0.0
        for i in list(open_):
            if got[i] >= most * sizes[i] - 1e-12:
                free += got[i] - most * sizes[i]
                got[i] = most * sizes[i]
                open_.discard(i)
    return got


def check(spark, rows, rows_per_bucket):
    out = op.mix(frame(spark, rows).repartition(3), rows_per_bucket=rows_per_bucket).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = [sum(r.size for r in by[s]) for s in names]
    want = water(size, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(size), 2)
    for s, n, t in zip(names, size, want, strict=True):
        assert {r.source_size for r in by[s]} == {n}
        assert by[s][0].target == pytest.approx(t, abs=1e-6)
        assert abs(sum(r.taken for r in by[s]) - t) <= 0.5
        assert all(0 <= r.taken <= 2 * r.size for r in by[s])
    return out


@pytest.mark.parametrize("rows_per_bucket", [1, 3, 4096])
def test_targets_and_cuts(spark, rows_per_bucket):
    rng = random.Random(rows_per_bucket)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 50])), None, rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])) for i in range(200)]
    a = check(spark, rows, rows_per_bucket)
    b = check(spark, rows[::-1], rows_per_bucket)
    assert sorted((r.doc_id, r.taken) for r in a) == sorted((r.doc_id, r.taken) for r in b)


def test_awkward_and_empty(spark):
    out = {r.doc_id: r for r in check(spark, AWKWARD, 2)}
    assert out[2].size == 0 and out[3].taken == 0
    assert op.mix(frame(spark, [])).count() == 0
    docs = frame(spark, [])
    assert op.mixed(docs, op.mix(docs)).count() == 0


def test_the_mix_holds_what_the_plan_takes(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{k}" for k in range(rng.randint(0, 30))), "en", rng.choice(["a", "b", "c", None])) for i in range(120)] + [(500, None, None, "a")]
    docs = frame(spark, rows)
    plan = op.mix(docs)
    mixed = op.mixed(docs, plan)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    texts = dict((i, t) for i, t, *_ in rows)
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert words == {r.doc_id: r.taken for r in plan.collect() if r.taken}
