from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
from flatspan.llm import mixing, sharding
from tests.llm.helpers import frame
from tests.llm.test_decontamination import brute as overlaps
from tests.llm.test_language import brute as languages
from tests.llm.test_mixing import re
from tests.llm.test_simhash import brute_components, brute_fingerprint


def leaks(doc: list[str], items: list[list[str]]) -> bool:
    """Whether any item overlaps; 13 words with 0.8 of them equal hold four equal ones in a row, so other items are not looked at."""
    runs = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    own = runs(doc)
    assert all(len(i) >= 13 for i in items)
    return any(own & runs(i) and overlaps(doc, i) for i in items)


def test_stages_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    work, sf_rows = docs, docs.collect()
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    # language
    known = languages(sf_rows)
    work = stage["language ID"](spark, work, sf)
    assert work.columns == docs.columns
    kept = {r.doc_id: r for r in work.collect()}
    assert set(kept) == {i for i, (lang, _) in known.items() if lang != "und"}
    # near-duplicates
    low = brute_components({i: brute_fingerprint(r.text) for i, r in kept.items()})
    work = stage["SimHash near-dedup"](spark, work, sf)
    assert work.columns == docs.columns and sorted(r.doc_id for r in work.collect()) == sorted(set(low.values()))
    # contamination
    items = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r.doc_id for r in work.collect() if leaks(r.text.lower().split(), items)}
    before = {r.doc_id for r in work.collect()}
    work = stage["benchmark decontamination"](spark, work, sf)
    assert work.columns == docs.columns and {r.doc_id for r in work.collect()} == before - hit and hit
    # mixing: sources near their targets, no document more than three times
    source = work.collect()
    mixed = stage["mixing sources to target weights"](spark, work, sf)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in source}
    assert max(times.values()) <= 3
    sizes: Counter = Counter()
    for r in source:
        sizes[r.source] += size[r.doc_id]
    targets = mixing.fill_targets(dict(sizes), {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))})
    for s in sizes:
        own = [r.doc_id for r in source if r.source == s]
        assert abs(sum(times[i] * size[i] for i in own) - targets[s]) <= max(0.02 * targets[s], max(size[i] for i in own) / 2 + 1)
    # sharding
    out = frame(stage["sharding"](spark, mixed, sf))
    assert Counter(out.doc_id) == times
    texts = {r.doc_id: r.text.encode() for r in source}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in out.itertuples())
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert sharding.VIRTUAL_SLOTS > 16


def test_run_applies_all_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "map_version"] and out.count() > 0
