from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from flatspan.llm import sharding
from tests.llm.helpers import documents, frame, odd_documents


def brute_shards(rows: list[tuple[int, int]], n: int) -> dict[int, int]:
    """Slots (number, bytes), largest first, each to the least loaded shard."""
    load, out = [0] * n, {}
    for size, slot in sorted((-b, s) for s, b in rows):
        k = load.index(min(load))
        out[slot] = k
        load[k] -= size
    return out


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = frame(sharding.shard_documents(docs))
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples()} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in text.items()}
    want = brute_shards(list(got.groupby("virtual")["size"].sum().items()), 16)
    assert dict(zip(got.virtual, got.shard, strict=True)) == want and set(got.map_version) == {1}
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= got["size"].max()
    assert got.grown_shard.isna().all() and set(got.law) == {"bytes"}
    again = frame(sharding.shard_documents(docs.repartition(9)))
    key = ["doc_id", "shard", "slot"]
    assert sorted(map(tuple, got[key].to_numpy())) == sorted(map(tuple, again[key].to_numpy()))


def test_map_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = sharding.build_slot_map(sharding.slot_bytes(sharding.measure(docs)), 4)
    sharding.save_slot_map(one, str(tmp_path / "map"))
    two = sharding.add_shard(sharding.load_slot_map(spark, str(tmp_path / "map")), 4)
    sharding.save_slot_map(two, str(tmp_path / "map"))
    latest = sharding.load_slot_map(spark, str(tmp_path / "map"))
    assert latest.select(F.max("version")).first()[0] == 2 and sharding.load_slot_map(spark, str(tmp_path / "map"), 1).count() == latest.count()
    before, after = ({r.virtual: r.shard for r in m.collect()} for m in (one, latest))
    assert {after[v] for v in after if after[v] != before[v]} == {4}
    loads = latest.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert len(loads) == 5 and max(r.b for r in loads) < 1.5 * min(r.b for r in loads)
    placed = frame(sharding.shard_documents(docs, slot_map=latest))
    assert set(placed.shard) == {0, 1, 2, 3, 4}


def test_new_data_meets_a_stored_map(spark, sf, tmp_path):
    """A map made of few documents spreads many others, keeps its version, and grows by one shard."""
    few = spark.read.parquet(f"{sf}/documents.parquet")
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    folder = str(tmp_path / "map")
    assert sharding.shard_and_store(few, folder, 4).select("map_version").distinct().first()[0] == 1
    one = sharding.load_slot_map(spark, folder)
    assert one.count() == sharding.VIRTUAL_SLOTS
    sharding.save_slot_map(sharding.add_shard(one, 4), folder)
    two = sharding.load_slot_map(spark, folder)
    assert two.count() == sharding.VIRTUAL_SLOTS
    before, after = (frame(sharding.shard_documents(many, 4, m)) for m in (one, two))
    assert set(after.map_version) == {2} and set(before.map_version) == {1}
    assert before.groupby("shard").size().min() > 0.15 * len(before) and after.groupby("shard").size().min() > 0.1 * len(after)
    old = dict(zip(before.doc_id, before.shard, strict=True))
    assert {r.shard for r in after.itertuples() if old[r.doc_id] != r.shard} == {4}


def test_repeated_rows_spread(spark):
    """A third and more of all rows equal, among them rows without id and text: shards stay near equal."""
    rows = [(7, "the same words")] * 6000 + [(None, None)] * 3000 + [(10 + i, f"text {i}") for i in range(3000)]
    docs = documents(spark, rows)
    got = frame(sharding.shard_documents(docs))
    assert len(got) == 12_000 and (got.doc_id == 7).sum() == 6000 and got.doc_id.isna().sum() == 3000
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 16 and loads.max() - loads.min() <= got.groupby("virtual")["size"].sum().max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_odd_rows(spark):
    got = frame(sharding.shard_documents(odd_documents(spark)))
    assert len(got) == 10 and got[got.doc_id == 3].text_crc32.isna().all() and (got[got.doc_id == 3]["size"] == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_empty(spark):
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def test_main_path_is_native(spark, sf):
    plan = sharding.shard_documents(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
