import hashlib
import random
import zlib

import pytest
from helpers import AWKWARD, NO_ID, frame
from pyspark.sql import functions as F

from residua.llm import merkle as op


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    i, t, lang, source = (*row, *(None,) * (4 - len(row)))
    return sha(*map(cell, (i, source, lang, None if t is None else len(t), text)))


def levels(nodes):
    """Each level of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def proof(tree, i):
    """(left, right) siblings by level."""
    found = []
    for level in tree[:-1]:
        a = i // 3 * 3
        found.append((level[a:i], level[i + 1 : a + 3]))
        i //= 3
    return found


def expected(rows, tampers):
    by = {}
    for r in rows:
        r = (*r, *(None,) * (4 - len(r)))
        by.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), leaf(r, r[1].replace("\n", "") if r[1] is not None and tampers(r[0]) else r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:2])
        trees[s] = levels([x[1] for x in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, own, now, r) in enumerate(by[s]):
            path = proof(trees[s], i) + proof(top, k)
            node = now
            for a, b in path:
                node = sha(*a, node, *b)
            out.append((r[0], own, trees[s][-1][0], top[-1][0] if top else None, sha(*[d for a, b in path for d in a + b]), node))
    return out


def found(df):
    h = lambda c: F.lower(F.hex(c))
    rows = df.select("doc_id", h("leaf"), h("subroot"), h("root"), h("proof_digest"), h("folded_root")).collect()
    return sorted(map(tuple, rows), key=str)


def corpus():
    rng = random.Random(5)
    rows = [(100 + i, "\n".join(rng.choices(["a", "b", "é"], k=rng.randint(0, 5))), "en", s) for i, s in enumerate(rng.choices(["hot", "a", "ä", "b"], [9, 1, 1, 1], k=400))]
    return [*AWKWARD, *NO_ID, *rows, *[(500_000 + i, None, None, f"only{i}") for i in range(30)], AWKWARD[0]]


@pytest.mark.parametrize("n_levels", [1, 2, 5])
def test_equals_a_loop(spark, n_levels):
    rows = corpus()
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampers = lambda i: i is not None and zlib.crc32(str(i).encode()) % 2 == 0
    got = op.manifest(frame(spark, rows), n_levels, tampered=F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    assert found(got) == sorted(expected(rows, tampers), key=str)


def test_small_data_sets(spark):
    for rows in ([], [(1, "alone", "en", "a")], [(2, "x", None, "b"), (1, "y", None, "b")], [(i, "t", None, None) for i in range(4)]):
        assert found(op.manifest(frame(spark, rows))) == sorted(expected(rows, lambda i: False), key=str)


def test_any_changed_sibling_changes_the_root():
    nodes = [hashlib.sha256(bytes([i])).digest() for i in range(7)]
    proofs = [bytearray() for _ in nodes]
    root = op.subtree(nodes, proofs, 0, op.height(7))
    assert all(op.folded(n, bytes(p)) == root for n, p in zip(nodes, proofs, strict=True))
    own = list(op.siblings(bytes(proofs[3])))
    for level in range(len(own)):
        for side in (0, 1):
            for k in range(len(own[level][side])):
                changed = [([*a], [*b]) for a, b in own]
                changed[level][side][k] = bytes(32)
                packed = b"".join(bytes([4 * len(a) + len(b)]) + b"".join(a + b) for a, b in changed)
                assert op.folded(nodes[3], packed) != root
