import random
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import AWKWARD, frame

from residua.llm import sharding as op


def test_places_and_sizes(spark):
    placed, versions = op.shard(frame(spark, AWKWARD), 24)
    out = placed.collect()
    assert len(out) == len(AWKWARD)
    texts = dict((i, t or "") for i, t, *_ in AWKWARD)
    by = defaultdict(list)
    for r in out:
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert versions.count() == 2 * op.N_SLOTS


def test_balance_by_bytes_and_reruns(spark):
    rng = random.Random(1)
    rows = [(i, "a" * rng.choice([1, 10, 200, 3000])) for i in range(3000)]
    a, _ = op.shard(frame(spark, rows), 24)
    b, _ = op.shard(frame(spark, rows[::-1]).repartition(5), 24)
    a, b = a.collect(), b.collect()
    assert sorted(a) == sorted(b)
    load = Counter()
    for r in a:
        load[r.shard] += r.size
    assert len(load) == 24 and max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 24 + 20


def test_map_edits():
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 5, 100, 1000]) for _ in range(512)]
    v0 = op.first_map(8, 512)
    v1 = op.rebalance(v0, sizes, 8)
    load = Counter()
    for s, k in enumerate(v1):
        load[k] += sizes[s]
    assert max(load.values()) - min(load.values()) <= 5
    v2 = op.grow(v1, sizes, 8)
    assert all(b in (a, 8) for a, b in zip(v1, v2, strict=True))
    grown = Counter()
    for s, k in enumerate(v2):
        grown[k] += sizes[s]
    assert grown[8] > 0.8 * sum(sizes) / 9
    assert sum(a != b for a, b in zip(v1, op.rebalance(v1, sizes, 8, max_moves=0), strict=True)) == 0


def test_empty_and_versions_by_row(spark):
    placed, versions = op.shard(frame(spark, []), 24)
    assert placed.count() == 0
    docs = frame(spark, AWKWARD)
    placed, versions = op.shard(docs, 4)
    want = {r.doc_id: r.shard for r in placed.collect()}
    rows = op.with_shards(docs, versions)
    assert rows.columns == [*docs.columns, "virtual_slot", "_shard"]
    assert {r.doc_id: r._shard for r in rows.collect()} == want


def test_a_stored_map_is_read_edited_and_versioned(spark, tmp_path):
    rng = random.Random(3)
    path = str(tmp_path / "map")
    rows = [(i, "a" * rng.choice([1, 10, 200, 3000])) for i in range(2000)]
    first, _ = op.shard(frame(spark, rows), 8, map_path=path)
    assert {r.map_version for r in first.collect()} == {1} and op.versions_at(spark, path) == [0, 1]
    again, _ = op.shard(frame(spark, rows), 8, map_path=path)
    assert sorted(again.collect()) == sorted(first.collect()) and op.versions_at(spark, path) == [0, 1]  # nothing moved
    more = rows + [(5000 + i, "b" * 2000) for i in range(50)]
    third, versions = op.shard(frame(spark, more), 8, map_path=path)
    third = {r.doc_id: r.shard for r in third.collect()}
    moved = sum(third[r.doc_id] != r.shard for r in first.collect())
    assert op.versions_at(spark, path) == [0, 1, 2] and 0 < moved < 400  # an edit, not a new deal
    load = op.slot_bytes(op.measured(frame(spark, more)))[0]
    before = op.read_version(spark, path, 2)
    grown, version = op.edited(spark, path, load, 9)
    assert version == 3 and set(grown) == set(range(9)) and sum(a != b for a, b in zip(before, grown, strict=True)) < op.N_SLOTS // 4
    old = op.with_shards(frame(spark, rows), versions, 1)
    assert {r.doc_id: r._shard for r in old.collect()} == {r.doc_id: r.shard for r in first.collect()}


def test_rows_without_an_id_spread(spark):
    placed, _ = op.shard(frame(spark, [(None, f"text {i} {'x' * (i % 50)}") for i in range(2000)]), 8)
    load = Counter()
    for r in placed.collect():
        load[r.shard] += r.size
    assert len(load) == 8 and max(load.values()) - min(load.values()) < 200


def test_a_writer_that_died_blocks_no_later_one(spark, tmp_path):
    path, rows = str(tmp_path / "map"), [(i, "x" * (i % 50)) for i in range(200)]
    op.shard(frame(spark, rows), 4, map_path=path)
    (tmp_path / "map" / "version=2" / "_temporary").mkdir(parents=True)  # begun, never ended
    (tmp_path / "map" / "_writing-0").mkdir()
    assert op.versions_at(spark, path) == [0, 1] and op.next_version(spark, path) == 3
    grown, version = op.edited(spark, path, [1] * op.N_SLOTS, 6)
    assert version == 3 and op.versions_at(spark, path) == [0, 1, 3] and op.read_version(spark, path, 3) == grown
    assert {r.version for r in op.map_versions(spark, path).select("version").distinct().collect()} == {0, 1, 3}


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "map")
    op.write_version(spark, path, 0, [0, 1, 0])
    with pytest.raises(FileExistsError):
        op.write_version(spark, path, 0, [1, 1, 1])
    assert op.read_version(spark, path, 0) == [0, 1, 0] and sorted(p.name for p in (tmp_path / "map").iterdir()) == ["version=0"]
