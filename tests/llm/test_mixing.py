from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from flatspan.llm import mixing
from tests.llm.helpers import documents, frame, odd_documents


def test_targets_are_capped_and_reshared():
    sizes = {"a": 10, "b": 100, "c": 1000, None: 5}
    t = mixing.fill_targets(sizes, {"a": 1, "b": 2, "c": 3, None: 1})
    assert t["a"] == 30 and t[None] == 15 and t["b"] == 300
    assert abs(sum(t.values()) - 1115) < 1e-9


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(20):
        patterns = [{s: rng.randint(1, 3) for s in p} for p in ("a", "b", "ab", "bc")]
        quotas = {"a": rng.randint(0, 4), "b": rng.randint(0, 4), "c": rng.randint(0, 4)}
        flow = mixing.min_cost_flow(patterns, quotas)
        spent = lambda n, size: sum(mixing.REPEAT_COSTS[min(k // size, 2)] for k in range(n))
        size = [sum(p.values()) for p in patterns]
        got = sum(sum(f.values()) for f in flow)
        cost = sum(spent(sum(f.values()), n) for f, n in zip(flow, size, strict=True))
        assert all(sum(f.get(s, 0) for f in flow) <= q for s, q in quotas.items())
        assert all(n <= 3 * p[s] for f, p in zip(flow, patterns, strict=True) for s, n in f.items())
        # brute force over all splits of the small table
        best = None
        arcs = [(i, s) for i, p in enumerate(patterns) for s in sorted(p)]
        for split in itertools.product(*[range(min(quotas[s], 3 * patterns[i][s]) + 1) for i, s in arcs]):
            used, to = [0] * 4, dict.fromkeys(quotas, 0)
            for (i, s), n in zip(arcs, split, strict=True):
                used[i] += n
                to[s] += n
            if all(to[s] <= quotas[s] for s in to) and all(u <= 3 * n for u, n in zip(used, size, strict=True)):
                key = (-sum(used), sum(spent(u, n) for u, n in zip(used, size, strict=True)))
                best = min(best, key) if best else key
        assert (-got, cost) == best


def near_targets(got, slack: float = 0.02) -> None:
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(slack * g.target.iloc[0], g["size"].max() / 2), (g.source.iloc[0], g.taken.sum(), g.target.iloc[0])


def brute_targets(sizes: dict, weights: dict) -> dict:
    """Shares by weight; whoever is above three times its size stops there, and the excess goes round again."""
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = sum(weights[s] for s in sizes if s not in capped)
        share = {s: left * weights[s] / free for s in sizes if s not in capped}
        over = {s for s, x in share.items() if x > 3 * sizes[s]}
        if not over:
            return share | {s: 3 * sizes[s] for s in capped}
        capped |= over


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = frame(mixing.mix_documents(docs))
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == size
    assert (got.taken <= 3 * got["size"]).all()
    assert abs(got.groupby("source").target.first().sum() - sum(size.values())) < 1e-6
    sizes = got.groupby("source")["size"].sum().to_dict()
    want = brute_targets(sizes, {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))})
    assert all(abs(want[r.source] - r.target) < 1e-6 and sizes[r.source] == r.source_size for r in got.itertuples())
    near_targets(got)
    again = frame(mixing.mix_documents(docs.repartition(7)))
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    mixed = frame(mixing.mix_rows(docs))
    assert sum(size[i] for i in mixed.doc_id) == got.taken.sum() and list(mixed.columns) == docs.columns


def test_overlapping_sources(spark):
    """Texts of source a stand in b too: b, which needs words most, repeats those less that a takes."""
    rows = [(i, f"own a {i} " * 10, "en", "a") for i in range(30)] + [(100 + i, f"both {i} " * 10, "en", "a") for i in range(30)]
    rows += [(200 + i, f"both {i} " * 10, "en", "b") for i in range(30)] + [(300 + i, f"own b {i} " * 10, "en", "b") for i in range(30)]
    got = frame(mixing.mix_documents(documents(spark, rows), {"a": 1, "b": 3}))
    assert (got.taken <= 3 * got["size"]).all()
    near_targets(got)
    text = {r[0]: r[1] for r in rows}
    repeats = got.assign(text=got.doc_id.map(text)).groupby("text").agg(taken=("taken", "sum"), size=("size", "sum"))
    # 750 and 2,250 words out of 600 + 900 in patterns of a, both and b: nothing needs a third repetition
    assert (repeats.taken <= 2 * repeats["size"]).all()
    parts, _, sizes = mixing.plan_mix([(1, None, "aa", 300), (2, ["aa", "ab"], "aa", 200), (3, ["aa", "ab"], "ab", 200), (4, None, "ab", 50)], {"aa": 1, "ab": 3})
    assert sizes == {"aa": 500, "ab": 250} and abs(sum(p["take"] for p in parts) - 750) <= 1


def test_repeated_rows(spark):
    """3,000 rows with 30 ids, a third of them one text; and rows without ids."""
    rows = [(i % 30, f"text {i % 30} and five words more", "en", f"s{i % 3}") for i in range(2000)] + [(5, "one text of all", "en", "s1")] * 1000
    docs = documents(spark, rows)
    got = frame(mixing.mix_documents(docs))
    assert len(got) == 3000 and (got.taken <= 3 * got["size"]).all()
    near_targets(got, 0.0)
    again = frame(mixing.mix_documents(docs.repartition(5)))
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(tuple, got[key].to_numpy())) == sorted(map(tuple, again[key].to_numpy()))
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns
    words = {s: n for s, n in ((r["source"], r["n"]) for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect())}
    assert words == got.groupby("source").taken.sum().to_dict()
    got = frame(mixing.mix_documents(documents(spark, [(None, "some words here", "en", "a")] * 600 + [(None, "none at all now", "en", None)] * 500)))
    near_targets(got, 0.0)


def test_many_patterns(spark, monkeypatch):
    """3,000 texts of two sources each, in 3,000 different patterns: all take part in the flow."""
    pairs = list(itertools.islice(itertools.combinations(range(80), 2), 3000))
    rows = [(2 * i + k, f"text {i} " * 5, "en", f"s{pair[k]:02d}") for i, pair in enumerate(pairs) for k in (0, 1)]
    docs = documents(spark, rows)
    mix = mixing.Mix(docs)
    assert mix.shared.select("pattern").distinct().count() == 3000
    got = frame(mixing.mix_documents(docs))
    assert len(got) == 6000
    near_targets(got)
    monkeypatch.setattr(mixing, "MAX_CELLS", 5999)
    with pytest.raises(ValueError, match="merge sources"):
        mixing.mix_documents(docs)


def test_plan_takes_least_cost_at_any_number_of_patterns():
    """Quotas that one repetition of all patterns can fill are filled without further ones."""
    rng = random.Random(5)
    names = [f"a{i:03d}" for i in range(300)]
    patterns = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(20_000)})
    flow = mixing.min_cost_flow([{s: 10 for s in p} for p in patterns], dict.fromkeys(names, 10 * len(patterns) // len(names)))
    assert sum(sum(f.values()) for f in flow) == 10 * len(patterns) // len(names) * len(names)
    assert all(sum(f.values()) <= 20 for f in flow)


def test_odd_rows(spark):
    got = frame(mixing.mix_documents(odd_documents(spark)))
    assert len(got) == 10 and (got[got["size"] == 0].taken == 0).all()
    assert got[got.source.isna()].target.iloc[0] == 0.0
    assert 2**53 + 1 in set(got.doc_id)
    assert frame(mixing.mix_rows(odd_documents(spark))).columns[0] == "doc_id"


def test_empty(spark):
    assert mixing.mix_documents(documents(spark, [])).count() == 0
    assert mixing.mix_rows(documents(spark, [])).count() == 0
