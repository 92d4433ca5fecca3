from __future__ import annotations

import numpy as np

from flatspan.llm import embeddings
from tests.llm.helpers import frame


def brute(ids: list[int], x: list) -> dict[int, tuple[int, int]]:
    ok = [i for i, v in enumerate(x) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and np.any(np.array(v, float))]
    u = {i: np.array(x[i], float) / np.linalg.norm(np.array(x[i], float)) for i in ok}
    near = {i: {j for j in ok if j != i and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.95} if i in u else set() for i in range(len(x))}
    low = list(ids)
    changed = True
    while changed:
        changed = False
        for i, js in near.items():
            for j in js:
                if low[j] < low[i]:
                    low[i], changed = low[j], True
    return {ids[i]: (len(near[i]), low[i]) for i in range(len(x))}


def table(spark, ids, x):
    return spark.createDataFrame([(i, v, 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int")


def clustered(seed: int, dims: int = 40) -> list[list[float]]:
    """Random directions with a decaying spectrum, near copies, chains and exact copies."""
    rng = np.random.default_rng(seed)
    x = list(rng.standard_normal((120, dims)) * np.linspace(2, 0.2, dims))
    x += [x[i] + 0.05 * rng.standard_normal(dims) for i in range(60) for _ in range(3)]
    v = x[3].copy()
    for _ in range(20):
        v = v + 0.25 * np.linalg.norm(v) / np.sqrt(dims) * rng.standard_normal(dims)
        x.append(v)
    x += [x[0]] * 50 + [2 * x[1]] * 3
    return [v.astype(np.float32).tolist() for v in x]


def test_matches_brute_force(spark):
    x = clustered(5)
    ids = (np.random.default_rng(1).permutation(len(x)) + 2**53).tolist()
    want = brute(ids, x)
    for tile in (32, None):
        got = frame(embeddings.near_duplicates(table(spark, ids, x), tile=tile))
        assert {r.vec_id: (r.n_links, r.component_id) for r in got.itertuples()} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.itertuples())
    assert max(n for n, _ in want.values()) >= 50 and len({c for _, c in want.values()}) > 50


def test_suffix_bound_loses_nothing():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((700, 64))
    a[350:] = a[:350] + rng.uniform(0, 0.6, (350, 1)) * rng.standard_normal((350, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    i, j = embeddings.close_pairs(a, a, 0.95, True)
    want = {(p, q) for p, q in zip(*np.nonzero(a @ a.T >= 0.95), strict=True) if p < q}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want


def test_tiles_cover_close_pairs(spark):
    """Every close pair shares a tile or meets; tiles keep to their size though many vectors have equal coordinates; far ones don't meet."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 3)) * [1.0, 0.7, 0.4]
    x = centres[rng.integers(0, 40, 3000)] + 0.02 * rng.standard_normal((3000, 3))
    x[:500] = x[0]
    turned = spark.createDataFrame([(v.tolist(),) for v in x], "lead array<double>")
    tree, cells = embeddings.grow(turned, 3, 200)
    tiles, partners = embeddings.tile_plan(cells, 200, 0.3)
    cell = tree.cells(x)
    tile = np.array([tiles[c][0] + k % tiles[c][1] for k, c in enumerate(cell)])
    assert np.bincount(tile).max() <= 200
    met = np.zeros((len(partners), len(partners)), dtype=bool)
    for k, p in enumerate(partners):
        met[k, p] = True
    close = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.3
    assert met[tile[:, None], tile[None]][close].all() and met.mean() < 0.8


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1e200, 1e199]), (9, [3.0, 0.0]), (9, [3.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0])]
    df = table(spark, [r[0] for r in rows], [r[1] for r in rows])
    from pyspark.sql import functions as F

    got = frame(embeddings.near_duplicates(df.select("*", F.lit(1).alias("unit"), F.lit(2).alias("size"), F.lit(3).alias("node"))))
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got.itertuples()}
    assert all((by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True) for i in (2, 3, 4, 5, 6, 7, 10))
    assert by[1].n_links == 4 and by[8].n_links == 4 and by[9].component_id == 1
    assert by[None].n_links == 4 and by[None].component_id == 1 and by[None].kept is False


def test_empty(spark):
    assert embeddings.near_duplicates(table(spark, [], [])).count() == 0


def test_given_table(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = t.collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(t).collect()} == want


def test_pairs_at_the_threshold_itself(spark):
    """20 e_i and (19, 5, 3, 2, 1) in any places have a cosine of 19 / 20."""
    rng = np.random.default_rng(2)
    rows = [np.eye(8)[i] * 20 for i in range(8)]
    for i in range(8):
        for _ in range(5):
            x = np.zeros(8)
            x[[i, *rng.permutation([k for k in range(8) if k != i])[:4]]] = [19, 5, 3, 2, 1]
            rows.append(x)
    rows += list(rng.standard_normal((200, 8)))
    u = [x / np.sqrt(sum(v * v for v in x)) for x in rows]
    want = [sum(sum(float(p) * float(q) for p, q in zip(a, b, strict=True)) >= 0.95 for k, b in enumerate(u) if k != i) for i, a in enumerate(u)]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    for tile in (None, 16):
        got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df, tile=tile).collect()}
        assert [got[i] for i in range(len(rows))] == want and max(want[:8]) == 5
