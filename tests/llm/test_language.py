from __future__ import annotations

import zlib
from collections import Counter

from flatspan.llm import language
from tests.llm.helpers import documents, frame, odd_documents


def brute_grams(text: str) -> Counter:
    out: Counter = Counter()
    word = ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            padded = f"_{word}_"
            out.update(word)
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        word = ""
    return out


def code(gram: str) -> int:
    n = 0
    for c in gram:
        n = n << 21 | (1 if c == "_" else ord(c) + 1)
    return n


def top(counts: Counter) -> list[str]:
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: language.PROFILE]


def brute(rows) -> dict[int, tuple[str, float]]:
    by: dict[str, Counter] = {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            by.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    ranks = {lang: {g: k for k, g in enumerate(top(c))} for lang, c in sorted(by.items())}
    out = {}
    for r in rows:
        own = top(brute_grams(r.text or ""))
        apart = {lang: sum(abs(p.get(g, 10**9) - k) if g in p else language.PROFILE for k, g in enumerate(own)) for lang, p in ranks.items()}
        best = min(apart, key=lambda x: (apart[x], x)) if own and apart else "und"
        out[r.doc_id] = (best, 1 - apart[best] / (language.PROFILE * len(own)) if best != "und" else 0.0)
    return out


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    want = brute(rows)
    got = language.identify(docs, language.learn(docs)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, (lang, _) in want.items()}
    assert all(abs(r.score - want[r.doc_id][1]) < 1e-12 for r in got)
    lang = {r.doc_id: r.lang for r in rows}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = frame(language.identify(docs, language.learn(docs)))
    assert len(got) == 10 and got.score.between(0, 1).all()
    by = {r.doc_id: r.lang_pred for r in got.itertuples() if r.doc_id is not None}
    assert by[2] == by[3] == by[5] == "und" and by[6] != "und" and 2**53 + 1 in by
    kept = frame(language.keep_identified(docs))
    assert len(kept) == 6 and list(kept.columns) == docs.columns


def test_empty_and_unlearned(spark):
    none = documents(spark, [])
    assert language.identify(none, language.learn(none)).count() == 0
    unmarked = documents(spark, [(7, "some words", None)])
    assert language.identify(unmarked, language.learn(unmarked)).first().lang_pred == "und"


def test_ids_stay_exact_beside_nulls(spark):
    docs = documents(spark, [(None, "some words", "en"), (2**53 + 1, "some words", "en"), (3, None, "en")]).coalesce(1)
    got = frame(language.identify(docs, language.learn(docs)))
    assert sorted(got.doc_id.dropna()) == [3, 2**53 + 1] and got.doc_id.isna().sum() == 1
