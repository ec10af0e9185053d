import zlib

import pytest

from gazetide.llm import sharding
from gazetide.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def sound(rows, texts, shards, cell=None):
    assert len(rows) == len(texts)
    sizes, slots = [0] * shards, {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    return sizes


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes = sound(QUERIES["op4_sharding"](spark, SF).collect(), texts, 8)
    assert max(sizes) - min(sizes) <= max(len((t or "").encode()) + 1 for t in texts.values())


def test_odd_rows(spark):
    texts = {i: t for i, t in enumerate([None, "", "é", "x" * 50_000] + ["same"] * 200)}
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in texts.items()], "doc_id long, text string, size int, cell int")
    sound(sharding.assigned(df, 4, slots=16, cell_rows=3).collect(), texts, 4)
    again = sharding.assigned(df.union(df), 4, slots=16).collect()
    assert len(again) == 2 * len(texts)
    nulls = spark.createDataFrame([(None, str(i)) for i in range(50)], "doc_id long, text string")
    rows = sharding.assigned(nulls, 4).collect()
    assert len({r.vslot for r in rows}) > 20 and len(rows) == 50
    assert sharding.assigned(df.where("false")).collect() == []


def test_map_is_greedy_and_grows_by_moving_into_the_new_shard(spark):
    sizes = [(i, (i * 7919) % 101) for i in range(64)]
    slot_sizes = spark.createDataFrame(sizes, "vslot int, bytes long")
    first = sharding.first_map(slot_sizes, 5)
    load, want = [0] * 5, {}
    for minus, slot in sorted((-b, s) for s, b in sizes):
        want[slot] = load.index(min(load))
        load[want[slot]] -= minus
    assert {r.vslot: r.shard for r in first.collect()} == want
    grown = sharding.grown_map(first, slot_sizes, 5)
    new = {r.vslot: r.shard for r in grown.where("version = 1").collect()}
    assert all(new[s] in (want[s], 5) for s in want)
    total, moved = sum(b for _, b in sizes), sum(b for s, b in sizes if new[s] == 5)
    assert moved == pytest.approx(total / 6, rel=0.35)
    assert {r.vslot: r.shard for r in grown.where("version = 0").collect()} == want


def test_stored_map_is_read_and_edited(spark, tmp_path):
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    path = str(tmp_path / "map")
    sharding.write_map(sharding.first_map(sharding.slot_bytes(sharding.records(df, 256), 256), 4), path)
    first = {r.doc_id: r for r in sharding.assigned(df, path=path).collect()}
    sharding.rebalance(df, path)
    new = {r.doc_id: r for r in sharding.assigned(df, path=path).collect()}
    moved = [i for i in first if first[i].shard != new[i].shard]
    assert moved and {new[i].shard for i in moved} == {4} and {r.shard for r in first.values()} == {0, 1, 2, 3}
    assert 3000 / 5 * 0.5 < len(moved) < 3000 / 5 * 1.5
    texts = {i: "x" * (i % 50) for i in range(3000)}
    sound(list(new.values()), texts, 5)
    assert {r.doc_id: r for r in sharding.assigned(df, path=path, version=0).collect()} == first
