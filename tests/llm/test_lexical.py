"""Ranked search: against scores of all documents, ties and odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from flatspan.llm import lexical
from flatspan.llm.lexical import Shard, nra, rank_documents, terms_of
from tests.llm.helpers import documents, frame, odd_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs: list[tuple], items: list[tuple], k: int = 50) -> list[tuple]:
    held = [(i, Counter(t), len(t)) for i, t in ((i, plain_terms(text)) for i, text in docs) if t]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


def ranked(df) -> list[tuple]:
    return sorted((tuple(r) for r in frame(df)[["item_id", "rank", "doc_id", "score"]].itertuples(index=False, name=None)), key=str)


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("seed", range(3))
def test_equals_scores_of_all_documents(spark, seed, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_READ", 2)
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(60)] + ["Éé", "日本", "x1"]
    text = lambda most: " ".join(rng.choices(words, k=rng.randint(1, most)))
    docs = [(i, text(40)) for i in range(400)]
    docs += docs[:40] + [(1000 + i, docs[7][1]) for i in range(120)]  # repeated rows, and ties past the 50th place
    items = [(i, text(20)) for i in range(12)] + [(90, docs[7][1]), (91, None), (92, "!!"), (93, "nowhere")]
    got = rank_documents(documents(spark, docs, clashes=True).repartition(5), items_frame(spark, items))
    assert ranked(got) == sorted(plain(docs, items), key=str)


def test_reading_stops_early_and_is_exact():
    rng = np.random.default_rng(5)
    n, terms = 5000, 6
    lists = [rng.permutation(n)[: rng.integers(50, n)] for _ in range(terms)]
    doc, term = np.concatenate(lists), np.repeat(np.arange(terms), [len(x) for x in lists])
    impacts = (rng.pareto(1.5, len(doc)) * 1000).astype(np.int64)
    weights = rng.integers(1, 9, terms)
    at, scores = nra(Shard.of(np.arange(n), terms, doc, term, impacts), np.arange(terms), weights, 10)
    total = np.zeros(n, dtype=np.int64)
    np.add.at(total, doc, impacts * weights[term])
    want = np.lexsort((np.arange(n), -total))[:10]
    assert at.tolist() == want.tolist() and scores.tolist() == total[want].tolist()


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ASKED_BYTES", 20)
    docs, items = [(1, "a b c"), (2, "b c d"), (3, "c d e")], [(1, "a b"), (2, "c e"), (3, "d")]
    assert ranked(rank_documents(documents(spark, docs), items_frame(spark, items))) == sorted(plain(docs, items), key=str)


def test_shards_of_few_postings(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 4)
    docs = [(i, f"a b{i % 7} c{i % 3}") for i in range(300)]
    items = [(1, "a b1 c2"), (2, "b3")]
    assert ranked(rank_documents(documents(spark, docs), items_frame(spark, items))) == sorted(plain(docs, items), key=str)


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "the LAZY dog"), (2, "word5 and"), (2, "one"), (None, "ünïcode 12"), (3, None)]
    assert ranked(rank_documents(docs, items_frame(spark, items))) == sorted(plain(rows, items), key=str)
    assert rank_documents(documents(spark, []), items_frame(spark, items)).count() == 0
    assert rank_documents(docs, items_frame(spark, [])).count() == 0


def test_terms_are_those_of_the_pattern():
    text = "Ab-c_d É9\x00x\x7fy z w `q{r"
    assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)
