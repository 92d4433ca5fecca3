from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from flatspan.llm import language_model as lm
from tests.llm.helpers import documents, frame, odd_documents


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split() + [b" "]


def held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 7 == 2


class Brute:
    """The automaton itself: states, arcs and failure arcs in dictionaries, read from left to right."""

    def __init__(self, texts):
        lists = [tokens(t) for t in texts]
        self.c = Counter(w for x in lists for w in x)
        self.n, self.v = sum(self.c.values()), len(self.c)
        once, twice = (sum(k == m for k in self.c.values()) for m in (1, 2))
        self.cut = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
        self.unseen = max(self.v, once * (once - 1) / (2 * (twice + 1)))
        self.grams: Counter = Counter()
        for x in lists:
            s = [b" ", *x]
            for k in (2, 3):
                self.grams.update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
        self.of: Counter = Counter()
        for g, k in self.grams.items():
            self.of[g[:-1]] += k
        self.arcs: dict = {}
        for g in sorted(self.grams, key=len):
            self.arcs.setdefault(g[:-1], {})[g[-1]] = self.p(g[-1], g[:-1])

    def root(self, w: bytes) -> float:
        return (self.c[w] - self.cut if self.c[w] else self.cut * self.v / self.unseen) / self.n

    def p(self, w: bytes, h: tuple[bytes, ...]) -> float:
        if not h:
            return self.root(w)
        k = lm.BACKOFF[len(h) - 1]
        return (self.grams[(*h, w)] + k * self.p(w, h[1:])) / (self.of[h] + k)

    def score(self, text) -> float:
        total, state = 0.0, (b" ",)
        for w in tokens(text):
            h = state
            while h and w not in self.arcs.get(h, {}):
                total += math.log10(lm.BACKOFF[len(h) - 1] / (self.of[h] + lm.BACKOFF[len(h) - 1]))
                h = h[1:]
            total += math.log10(self.arcs[h][w] if h else self.root(w))
            state = (state + (w,))[-2:]
            while state and state not in self.arcs:
                state = state[1:]
        return total

    def base(self, text) -> float:
        return sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in tokens(text))


def small(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 25), p=np.arange(12, 0, -1) / 78)) + (" rare%d" % i if i % 5 == 0 else "")) for i in range(60)]
    rows += [(100 + i, "a b c d e A B C") for i in range(8)]
    return documents(spark, rows), rows


def test_matches_brute_force(spark):
    docs, rows = small(spark)
    brute = Brute([t for i, t in rows if not held(i)])
    text = dict(rows)
    for r in lm.score_documents(docs).collect():
        t = text[r.doc_id]
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(tokens(t)) and r.train_tokens == brute.n
        assert r.n_known == sum(brute.c[w] > 0 for w in tokens(t))
        assert math.isclose(r.base_score, brute.base(t), rel_tol=1e-9)
        assert math.isclose(r.score, brute.score(t), rel_tol=1e-9), (t, r.score, brute.score(t))


def test_probabilities_sum_to_one(spark):
    docs, rows = small(spark)
    b = Brute([t for i, t in rows if not held(i)])
    for h in [(), (b" ",), (b"w0",), (b"a", b"b"), (b"w0", b"w1")]:
        assert abs(sum(b.p(w, h) for w in b.c) + b.unseen * b.p(b"never seen", h) - 1) < 1e-9


def test_rare_words_have_arcs_at_any_size(spark):
    """Words of less than 1 in 10,000 tokens, in bigrams and trigrams that occur once or more."""
    rows = [(i, "a b c d e " * 600) for i in range(20)] + [(100 + i, "seldom seen words follow here") for i in range(5)]
    rows += [(200 + i, f"few rare{i // 3} then odd{i // 3} a b") for i in range(9)]
    brute = Brute([t for i, t in rows if not held(i)])
    assert brute.grams[(b"rare1", b"then", b"odd1")] < 1e-4 * brute.n
    text = dict(rows)
    for r in lm.score_documents(documents(spark, rows)).collect():
        assert math.isclose(r.score, brute.score(text[r.doc_id]), rel_tol=1e-9), (r.doc_id, r.score)


def test_blocks_and_parts_change_nothing(spark, monkeypatch):
    docs, _ = small(spark)
    want = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "LEAST_BLOCKS", 1)
    monkeypatch.setattr(lm, "PART_BYTES", 50)
    got = {r.doc_id: r.score for r in lm.score_documents(docs.repartition(3)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_noise_scores_below_held_out_text(spark, sf):
    """Made-up words, none of them known, are less likely than real texts word by word."""
    rng = np.random.default_rng(5)
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    noise = documents(spark, [(10**6 + i, " ".join(f"zq{k}x" for k in rng.integers(0, 10**9, 50))) for i in range(60)])
    got = frame(lm.score_documents(real.union(noise)))
    each = got.score.astype(float) / got.n_tokens.astype(float)
    out = got.held_out.astype(bool)
    assert each[out & (got.doc_id >= 10**6)].max() < each[out & (got.doc_id < 10**6)].mean() - 1


def test_repeated_rows_spread_over_blocks(spark):
    """A third of all rows equal, and rows without ids: each gets its row, and each counts."""
    rows = [(3, "one and the same text " * 20)] * 400 + [(None, "no id here")] * 200 + [(i + 10, f"text {i} of its own") for i in range(600)]
    got = frame(lm.score_documents(documents(spark, rows)))
    assert len(got) == 1200 and (got.doc_id == 3).sum() == 400 and got.doc_id.isna().sum() == 200
    brute = Brute([t for i, t in rows if not held(i)])
    assert set(got.train_tokens) == {brute.n} and math.isclose(got[got.doc_id == 3].score.iloc[0], brute.score(rows[0][1]), rel_tol=1e-9)


def test_ids_stay_exact_beside_nulls(spark):
    got = frame(lm.score_documents(documents(spark, [(None, "a b"), (2**53 + 1, "a b c"), (None, None)]).coalesce(1)))
    assert sorted(got.doc_id.dropna()) == [2**53 + 1] and got.doc_id.isna().sum() == 2


def test_held_out_texts_fit_better_than_the_base(spark, sf):
    got = frame(lm.score_documents(spark.read.parquet(f"{sf}/documents.parquet")))
    out = got[got.held_out.astype(bool)]
    assert out.score.sum() > out.base_score.sum()


def test_odd_rows(spark):
    got = frame(lm.score_documents(odd_documents(spark)))
    assert len(got) == 10 and set(got[got.doc_id.isin([2, 3])].n_tokens) == {1} and 2**53 + 1 in set(got.doc_id)
    assert (got.score.astype(float) <= 0).all() and got[got.doc_id == 4].n_tokens.iloc[0] == 60_001


def test_empty(spark):
    assert lm.score_documents(documents(spark, [])).count() == 0


def test_counts_beyond_four_bytes():
    from flatspan.llm.language_model import _counts, _numbers

    for n in ([2**32 + 5, 1], [3, 4], []):
        assert _numbers(_counts(np.array(n, dtype=np.float64)), len(n)).tolist() == n
