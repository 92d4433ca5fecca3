from __future__ import annotations

import random

import numpy as np
import pandas as pd

from flatspan.llm import substrings as sub
from flatspan.llm.common import local_roots
from tests.llm.helpers import documents, frame, odd_documents

RNG = random.Random(6)
VOCAB = [f"v{i}" for i in range(6000)]


def sentence(n: int) -> str:
    return " ".join(RNG.choices(VOCAB, k=n)).capitalize() + "."


def prose(n: int) -> str:
    out = []
    while sum(len(s.split()) for s in out) < n:
        out.append(sentence(RNG.randint(6, 14)))
    return " ".join(out)


def paragraphs(n: int) -> list[str]:
    return [prose(RNG.randint(25, 70)) for _ in range(n)]


def edited(text: str, changes: int) -> str:
    w = text.split()
    for k in RNG.sample(range(len(w)), changes):
        w[k] = "edited"
    return " ".join(w)


def planted():
    """(documents, ids that share a passage): embedded passages, near-copies of paragraphs, and clean texts."""
    docs = {i: paragraphs(RNG.randint(1, 4)) for i in range(150)}
    shared = set()
    for k in range(12):  # embedded in the middle of other paragraphs
        passage = prose(RNG.randint(52, 70))
        for i in range(5 * k, 5 * k + 3):
            w = docs[i][0].split()
            at = RNG.randint(0, len(w))
            docs[i][0] = " ".join([*w[:at], passage, *w[at:]])
            shared.add(i)
    for i in range(60, 90, 2):  # a paragraph near-copied
        p = prose(120)
        docs[i].append(p)
        docs[i + 1].insert(0, edited(p, 2))
        shared.update((i, i + 1))
    line = sentence(13)  # a short common line is no passage
    for i in range(90, 150):
        docs[i].append(line)
    return [(i, "\n".join(d)) for i, d in docs.items()], shared


def test_planted_passages(spark):
    rows, shared = planted()
    got = frame(sub.repeated_passages(documents(spark, rows)))
    assert set(got.doc_id) == shared
    text = {i: t.lower().split() for i, t in rows}
    for r in got.itertuples():
        assert r.n_words == r.end - r.start >= sub.MIN_PASSAGE and r.end <= len(text[r.doc_id])
        assert r.removed == (r.first_doc < r.doc_id)
    kept = got[~got.removed.astype(bool)]
    assert len(kept) and set(got.first_doc) <= set(got.doc_id)


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_paragraph_clusters_match_all_pairs(spark):
    """Every pair of paragraphs with similarity 0.8 or more shares a cluster, and clusters hold nothing else."""
    base = [prose(60) for _ in range(12)]
    texts = [*base, *(edited(b, RNG.randint(1, 4)) for b in base for _ in range(9))]
    texts += [edited(base[0], 1) for _ in range(120)]  # a crowded bucket
    docs = documents(spark, list(enumerate(texts)))
    rows = sub.texts_of(docs)
    found = sub.units(rows).where("kind = 'p'")
    classes = found.select("key", "bands", "doc_id", "row", "start", "n").dropDuplicates(["key"])
    links = sub.paragraph_links(rows, classes)
    of = {r.key: r.doc_id for r in classes.collect()}
    got = [(of[r.a], of[r.b]) for r in links.collect()]
    crowd = {0, *range(12, 21), *range(120, 240)}
    assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in got if not {a, b} <= crowd)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    roots = lambda pairs: local_roots(len(texts), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    same = {texts.index(t) for t in texts}
    want, have = roots(near), roots([*got, *((texts.index(t), i) for i, t in enumerate(texts))])
    assert same and [want[i] for i in range(len(texts))] == [have[i] for i in range(len(texts))]


def test_crowded_bucket_links(spark):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(50)]
    g = pd.DataFrame({"key": np.arange(50), "shingles": sets})
    got = sub.compare_bucket(g, 0.5)
    near = [(i, j) for i in range(50) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.5 * len(set(sets[i]) | set(sets[j]))]
    want = local_roots(50, np.array([i for i, _ in near]), np.array([j for _, j in near]))
    assert {b: a for a, b in zip(got.a, got.b, strict=True)} == {i: r for i, r in enumerate(want) if r != i}


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Near-copies, a ring around them and strangers in one bucket: components equal those of all pairs."""
    monkeypatch.setattr(sub, "TILE", 16)
    rng = np.random.default_rng(2)
    base, sets = np.arange(100), []
    for i in range(150):
        s = set(base.tolist())
        for k in rng.integers(0, 100, [2, 6, 12, 18, 40][i % 5]):
            s.discard(int(k))
            s.add(int(1000 + rng.integers(0, 300)))
        sets.append(sorted(s))
    frame_of = spark.createDataFrame([(k, [int(x) for x in s]) for k, s in enumerate(sets)], "key long, shingles array<long>")
    crowded = spark.createDataFrame([(7, k, 0) for k in range(150)], "bucket long, key long, pivot long")
    got = sub.crowded_links(crowded, frame_of).collect()
    like = lambda i, j: len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j]))
    near = [(i, j) for i in range(150) for j in range(i) if like(i, j) >= 0.8]
    roots = lambda pairs: local_roots(150, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])).tolist()
    assert roots([(r.a, r.b) for r in got]) == roots(near)


def test_rows_of_a_crowded_bucket_grow_in_proportion(spark):
    """1,000 near-copies of one paragraph: comparisons beyond the first one with the pivot are few."""
    rng = np.random.default_rng(4)
    rows = [(k, [int(x) for x in {*range(100), 1000 + k} - {int(rng.integers(0, 100))}]) for k in range(1000)]
    sets = spark.createDataFrame(rows, "key long, shingles array<long>")
    got = sub.crowded_links(spark.createDataFrame([(1, k, 0) for k in range(1000)], "bucket long, key long, pivot long"), sets)
    assert {(r.a, r.b) for r in got.collect()} == {(0, k) for k in range(1, 1000)}


def test_passages_in_long_sentences(spark):
    """Passages of 51 words and more with sentences of 20 to 40 words, inside other long lines."""
    rows, want = [], set()
    long = lambda n: " ".join(sentence(RNG.randint(20, 40)) for _ in range(n))
    for k in range(60):
        passage = " ".join(long(3).split()[: RNG.randint(51, 60)])
        for i in (2 * k, 2 * k + 1):
            rows.append((i, f"{long(2)} {passage} {long(2)}"))
            want.add(i)
    rows += [(1000 + i, long(6)) for i in range(60)]
    got = set(frame(sub.repeated_passages(documents(spark, rows))).doc_id)
    assert got <= want and len(got) >= 0.95 * len(want)


def test_copies_of_short_lines(spark):
    """Verse, lists and hard-wrapped text: copies count though no line has 20 words."""
    verse = lambda n: [" ".join(RNG.choices(VOCAB, k=RNG.randint(5, 12))) for _ in range(n)]
    poem, other = verse(14), verse(14)
    rows = [(1, "\n".join(poem)), (2, "\n".join([*verse(5), "", *poem, "", *verse(3)])), (3, "\n".join(other)), (4, "\n".join(verse(14)))]
    common = sentence(9)  # a common short line alone, and two of them together, are no passage
    rows += [(10 + i, "\n".join([*verse(6), common, common[:-1] + " too.", *verse(6)])) for i in range(20)]
    got = frame(sub.repeated_passages(documents(spark, rows)))
    assert set(got.doc_id) == {1, 2} and got[got.doc_id == 2].n_words.sum() >= 60


def test_units_are_cut_by_content(spark):
    """The inner sentences of a passage are the same units wherever it stands."""
    passage = prose(60)
    keys = []
    for pre, post in (("", ""), ("some other words before it", "and after it"), ("x " * 31, "y " * 17)):
        rows = frame(sub.units(sub.texts_of(documents(spark, [(1, f"{pre} {passage} {post}")]))))
        keys.append(set(rows[rows.kind == "s"].key))
    assert len(keys[0] & keys[1] & keys[2]) >= 3


def test_given_table_against_all_shared_stretches(spark, sf):
    """Stretches of 51 words that another document holds word for word overlap a passage; passages are shared words."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = {r.doc_id: r.text.encode().lower().split() for r in docs.collect()}
    holders: dict[bytes, set[int]] = {}
    for i, w in words.items():
        for k in range(len(w) - 50):
            holders.setdefault(b" ".join(w[k : k + 51]), set()).add(i)
    passages: dict[int, list[tuple[int, int]]] = {}
    for r in sub.repeated_passages(docs).collect():
        passages.setdefault(r.doc_id, []).append((r.start, r.end))
    stretches = [(i, k) for i, w in words.items() for k in range(len(w) - 50) if len(holders[b" ".join(w[k : k + 51])]) > 1]
    met = [any(s < k + 51 and k < e for s, e in passages.get(i, [])) for i, k in stretches]
    assert stretches and sum(met) >= 0.98 * len(met)
    owners: dict[bytes, set[int]] = {}
    for i, w in words.items():
        for k in range(len(w) - 4):
            owners.setdefault(b" ".join(w[k : k + 5]), set()).add(i)
    for i, own in passages.items():
        for s, e in own:
            runs = [b" ".join(words[i][k : k + 5]) for k in range(s, e - 4)]
            assert sum(len(owners[r]) > 1 for r in runs) >= 0.6 * len(runs), (i, s, e)


def test_given_table_recall_of_paragraph_pairs(spark, sf):
    """Of all pairs of different paragraphs with similarity 0.8 or more, found by brute force, 0.9 at least share a cluster."""
    rows = sub.texts_of(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"))
    classes = sub.units(rows).where("kind = 'p'").select("key", "bands", "doc_id", "row", "start", "n").dropDuplicates(["key"]).cache()
    words = {r.doc_id: bytes(r.raw).lower().split() for r in rows.collect()}
    sets = {r.key: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in classes.collect() for w in [words[r.doc_id][r.start : r.start + r.n]]}
    holders: dict[tuple, list[int]] = {}
    for key, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(key)
    near = set()
    for a, own in sets.items():
        shared: dict[int, int] = {}
        for s in own:
            for b in holders[s]:
                shared[b] = shared.get(b, 0) + 1
        near |= {(a, b) for b, n in shared.items() if a < b and n >= 0.8 * (len(own) + len(sets[b]) - n)}
    number = {k: i for i, k in enumerate(sets)}
    links = [(number[r.a], number[r.b]) for r in sub.paragraph_links(rows, classes).collect()]
    root = local_roots(len(sets), np.array([a for a, _ in links]), np.array([b for _, b in links]))
    found = [root[number[a]] == root[number[b]] for a, b in near]
    assert len(near) >= 20 and sum(found) >= 0.9 * len(near), (sum(found), len(near))


def test_via(spark):
    """A near-copied paragraph goes before the sentences beside it; a passage inside other paragraphs comes by sentences."""
    p, q = prose(120), prose(60)
    rows = [(1, p), (2, edited(p, 2)), (3, f"{prose(40)} {q} {prose(40)}"), (4, f"{prose(40)} {q} {prose(40)}")]
    got = frame(sub.repeated_passages(documents(spark, rows)))
    assert {i: set(g.via) for i, g in got.groupby("doc_id")} == {1: {"paragraph"}, 2: {"paragraph"}, 3: {"sentence"}, 4: {"sentence"}}


def test_texts_of_one_id(spark):
    """Different texts of one id each give their own passages; equal ones count once."""
    own = [prose(60) for _ in range(40)]
    rows = [(1, p) for p in own] * 3 + [(100 + i, p) for i, p in enumerate(own)]
    got = frame(sub.repeated_passages(documents(spark, rows)))
    assert len(got) == 80 and (got.first_doc == 1).all()
    assert sorted(got[got.doc_id == 1].n_words) == sorted(got[got.doc_id != 1].n_words) == sorted(len(p.split()) for p in own)
    many = frame(sub.repeated_passages(documents(spark, [*rows, *[(7, own[0])] * 500])))
    assert len(many) == 81 and len(many[many.doc_id == 7]) == 1


def test_odd_rows(spark):
    got = frame(sub.repeated_passages(odd_documents(spark)))
    assert len(got) == 0
    long = " ".join(f"word{i % 977} and" for i in range(30_000))
    p = prose(80)
    rows = [(1, p), (1, p), (2**53 + 1, f"before {p} after"), (None, p), (3, None), (4, ""), (5, long), (6, long + " end"), (7, f"{p}\n{p}")]
    got = frame(sub.repeated_passages(documents(spark, rows, clashes=True)))
    assert {1, 2**53 + 1, 5, 6, 7} == set(got.doc_id)
    alone = frame(sub.repeated_passages(documents(spark, [(1, p), (1, p), (2, prose(50))])))
    assert len(alone) == 0  # repeats of one document's rows are no passage


def test_empty(spark):
    assert sub.repeated_passages(documents(spark, [])).count() == 0
