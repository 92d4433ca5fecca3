"""Token alignment: against whole-text encoding and plain counting, and the hash function alone."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flatspan.llm.alignment import A_FILE, B_FILE, FOLDER, Vocabularies, align_documents, aligned, group_texts, pieces_of, tokenized
from flatspan.llm.minimal_hash import MinimalHash
from tests.llm.helpers import documents, frame, odd_documents

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def vocabularies():
    return Vocabularies(*(open(f"{FOLDER}/{f}", "rb").read() for f in (A_FILE, B_FILE)))


def tokens(v: Vocabularies, text: str | None):
    """(a ids, b ids, a ends, b ends) of a whole text, or None."""
    if not text:
        return None
    a, b = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(v.a_bytes[i] for i in a) != raw or b"".join(v.b_bytes[i] for i in b) != raw:
        return None
    return a, b, np.cumsum([len(v.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(v.b_bytes[i]) for i in b]).tolist()


def groups_of(a, b, a_ends, b_ends) -> list[str]:
    out, i, j = [], 0, 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        p, q = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
        out.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
        i, j = p, q
    return out


def links_of(a, b, a_ends, b_ends) -> list[tuple[int, int]]:
    spans = lambda ends: list(zip([0, *ends[:-1]], ends, strict=True))
    return [(x, y) for x, (s, e) in zip(a, spans(a_ends), strict=True) for y, (t, f) in zip(b, spans(b_ends), strict=True) if s < f and t < e]


def plain(v: Vocabularies, texts: list[str | None]) -> list[tuple]:
    found = [tokens(v, t) for t in texts]
    links = [links_of(*t) if t else [] for t in found]
    count = Counter(pair for own in links for pair in set(own))
    top: dict[int, int] = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for t, own in zip(found, links, strict=True):
        g = groups_of(*t) if t else []
        digest = hashlib.sha256(";".join(g).encode()).hexdigest() if t else ""
        out.append((len(t[0]) if t else 0, len(t[1]) if t else 0, len(g), len(own), sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), digest))
    return out


TEXTS = [
    "The quick brown fox", "the quick brown fox", " leading and trailing ", "two  blanks and\ttabs \n lines\n\n  here", "a▁b c", "<|endoftext|> <s> <unk> </s>", "日本語 のテキスト です",
    "Ünïcode ßtraße É́ é", "x y  z  　w", "\x00 \x01 nul", " ", "  ", "\n", "1234567890 12 3.14159", "don't we'll they're I'M", "🙂🙂 👩‍👩‍👧 flags 🇩🇪", "᠎ x​ y﻿ z", "", None,
]


def test_equals_plain_counting(spark, vocabularies):
    texts = TEXTS + ["the quick brown fox jumps", "the slow brown dog jumps"] * 3
    got = frame(align_documents(documents(spark, list(enumerate(texts)), clashes=True).repartition(3)))
    got = got.sort_values("doc_id")
    assert list(got[COLUMNS].itertuples(index=False, name=None)) == plain(vocabularies, texts)


def test_given_table(spark, sf, vocabularies):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000")
    rows = docs.collect()
    got = frame(align_documents(docs)).sort_values("doc_id")
    want = plain(vocabularies, [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])])
    assert list(got[COLUMNS].itertuples(index=False, name=None)) == want


def test_nulls_repeats_long_texts_and_empty_tables(spark, vocabularies):
    docs = odd_documents(spark)
    got = frame(align_documents(docs))
    assert sorted(map(str, got["doc_id"])) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert set(got.loc[got["doc_id"] == 3, "groups_sha256"]) == {""}
    one = got[got["doc_id"] == 1]
    assert len(one) == 2 and one["count_sum"].nunique() == 1 and (one["n_best"] == one["n_links"]).all()
    assert align_documents(documents(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab  \t\n  　​.,'é1日🙂́"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_pieces_have_the_tokens_of_the_whole_text(text):
    v = _cached()
    t = tokenized(pieces_of(text), v)
    whole = tokens(v, text)
    if text:
        assert bool(t.ok.all()) == (whole is not None)
    if whole and text:
        assert (t.a.tolist(), t.b.tolist()) == whole[:2]
        assert ";".join(group_texts(t, aligned(t, v))) == ";".join(groups_of(*whole))


_KEPT: list = []


def _cached() -> Vocabularies:
    if not _KEPT:
        _KEPT.append(Vocabularies(*(open(f"{FOLDER}/{f}", "rb").read() for f in (A_FILE, B_FILE))))
    return _KEPT[0]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_hash_function_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**62, n))
    f = MinimalHash.from_bytes(MinimalHash.build(keys).to_bytes())
    assert sorted(f(keys).tolist()) == list(range(len(keys))) and len(f) == len(keys)
    assert len(f.to_bytes()) <= max(200, len(keys))


def test_hash_function_refuses_equal_keys():
    with pytest.raises(ValueError):
        MinimalHash.build(np.array([5, 5]))
