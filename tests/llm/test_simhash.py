from __future__ import annotations

import random

import numpy as np
import xxhash

from flatspan.llm import simhash
from flatspan.llm.components import connected_components
from tests.llm.helpers import documents, frame, odd_documents


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items: dict[int, int], distance: int = 2) -> dict[int, int]:
    """Smallest id reachable, by repeated passes over all pairs."""
    low = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for i, a in items.items():
            for j, b in items.items():
                if (a ^ b).bit_count() <= distance and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = simhash.digest(simhash.near_duplicates(docs)).collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    low = brute_components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", low[i]) for i, f in fps.items()}


def crowd(seed: int) -> list[int]:
    """Random fingerprints, chains of near ones, and a crowd around one centre."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(300)]
    for f in out[:40]:
        for _ in range(4):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            out.append(f)
    centre = rng.getrandbits(64)
    out += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)]
    return list(dict.fromkeys(out))


def test_links_connect_what_all_close_pairs_connect(spark):
    fps = crowd(1)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_components(dict(zip(signed, fps, strict=True)))
    for cell in (4, 10_000):  # nearly all through the crowded way, and all by pairs
        links = simhash.near_links(df, 2, cell)
        rows = links.collect()
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in rows)
        comps = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
        assert {f: comps.get(f, f) for f in signed} == want


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(0)
    cost = rng.random((50, 3, 4)) * np.array([0, 1, 5, 50])
    thresholds, best = simhash.allocate(cost, 2)
    assert (thresholds.sum(axis=1) == 2 - 3 + 1).all()
    every = simhash.allocations(3, 2)
    least = [min(sum(c[g, t + 1] for g, t in enumerate(a)) for a in every) for c in cost]
    assert np.allclose(best, least)


def test_odd_rows(spark):
    got = frame(simhash.digest(simhash.near_duplicates(odd_documents(spark))))
    assert len(got) == 10
    by = {r.doc_id: r for r in got.itertuples() if r.doc_id is not None}
    assert by[2].fingerprint == by[3].fingerprint == by[5].fingerprint.replace(by[5].fingerprint, "0" * 16)
    assert by[3].component_id == 2
    assert sorted(r.component_id for r in got.itertuples() if r.doc_id is None) == [1, 2]
    assert 2**53 + 1 in by
    kept = frame(simhash.keep_one(odd_documents(spark)))
    assert sorted(kept.doc_id) == sorted({by[i].component_id for i in by})
    assert "size" in kept.columns


def test_empty(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.keep_one(documents(spark, [])).count() == 0


def test_group_without_id_keeps_one(spark):
    docs = documents(spark, [(None, "a b c d"), (None, "a b c d"), (7, "totally other words here now")])
    assert sorted((r.doc_id is None, r.text) for r in simhash.keep_one(docs).collect()) == [(False, "totally other words here now"), (True, "a b c d")]


def test_ids_stay_exact_beside_nulls(spark):
    docs = documents(spark, [(None, "a b c d"), (2**53 + 1, "other words"), (None, None), (2**60 + 3, "other words")]).coalesce(1)
    got = frame(simhash.digest(simhash.near_duplicates(docs)))
    assert sorted(got.doc_id.dropna()) == [2**53 + 1, 2**60 + 3] and set(got[got.doc_id.notna()].component_id) == {2**53 + 1}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect() if r.doc_id is not None) == [2**53 + 1]
