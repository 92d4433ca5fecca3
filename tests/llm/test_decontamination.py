from __future__ import annotations

import itertools
import random

from flatspan.llm import decontamination as dc
from tests.llm.helpers import documents, frame, odd_documents

RNG = random.Random(4)
VOCAB = [f"w{i}" for i in range(5000)]


def words(n: int) -> list[str]:
    return RNG.choices(VOCAB, k=n)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(doc: list[str], item: list[str]) -> bool:
    """Whether some aligned window of 13 words or more (0.8 of a short item) has 0.8 or more of its words equal."""
    need = min(dc.MIN_OVERLAP, -(-len(item) * 8 // 10))
    for shift in range(-len(item) + 1, len(doc)):
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        same = [item[k] == doc[k + shift] for k in range(lo, hi)]
        total = [0]
        for s in same:
            total.append(total[-1] + s)
        if any(total[b] - total[a] >= 0.8 * (b - a) - 1e-9 for a in range(len(same)) for b in range(a + need, len(same) + 1)):
            return True
    return False


def test_masks():
    assert all(m.count("1") == 8 and m[0] == m[-1] == "1" for m in dc.MASKS) and len(set(dc.MASKS)) == len(dc.MASKS)


def allowed(n: int) -> list[list[bool]]:
    """Windows of an item of n words that may overlap, by equal words: up to twice the least length, as longer ones hold one."""
    need = min(dc.MIN_OVERLAP, -(-n * 8 // 10))
    return [[k not in gone for k in range(m)] for m in range(need, min(n, 2 * need - 1) + 1) for gone in itertools.combinations(range(m), m // 5)]


def test_every_allowed_overlap_is_hit():
    for n in range(1, 26):
        masks = dc.SHORT.get(n, (*dc.MASKS, *dc.LIGHT))
        for equal in allowed(n):
            assert any(all(equal[at + k] for k, c in enumerate(m) if c == "1") for m in masks for at in range(len(equal) - len(m) + 1)), (n, equal)


def test_equals_brute_force_at_the_threshold(spark):
    """Items of 1 to 20 words with as many words replaced as may be, and with one more."""
    items, docs = [], []
    for n in range(1, 21):
        item = words(n)
        items.append((n, item))
        for r in range(30):
            changed = list(item)
            for k in RNG.sample(range(n), min(n, n // 5 + (r % 5 == 0))):
                changed[k] = f"other{k}"
            docs.append((n * 100 + r, words(r % 4) + changed + words(r % 3)))
    few = [f"t{i}" for i in range(6)]
    items += [(100 + i, RNG.choices(few, k=6 + i)) for i in range(10)]
    docs += [(5000 + d, RNG.choices(few, k=30)) for d in range(40)]
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(documents(spark, [(d, " ".join(w)) for d, w in docs]), benchmark(spark, [(i, " ".join(w)) for i, w in items])).collect()}
    assert got == {(d, i) for d, w in docs for i, t in items if brute(w, t)}


def test_planted_passages(spark):
    items = [(i, words(RNG.randint(15, 55))) for i in range(30)]
    docs, want = [], set()
    for d in range(120):
        body = words(RNG.randint(20, 200))
        if d % 3 == 0:
            i, passage = RNG.choice(items)
            passage = [w if (k + d) % 9 or d % 2 else "changed" for k, w in enumerate(passage)]  # at most one in nine replaced
            at = RNG.randint(0, len(body))
            body = body[:at] + passage + body[at:]
            want.add((d, i))
        docs.append((d, "\n".join(" ".join(body[k : k + 17]) for k in range(0, len(body), 17)).title()))
    table = benchmark(spark, [(i, " ".join(w)) for i, w in items])
    df = documents(spark, docs)
    got = frame(dc.contaminated(df, table))
    assert {(r.doc_id, r.item_id) for r in got.itertuples()} == want
    assert (got.n_equal >= 0.8 * got.n_words).all()
    small = frame(dc.contaminated(df, table, block_words=200))  # many blocks, the same result
    assert sorted(map(tuple, small.to_numpy())) == sorted(map(tuple, got.to_numpy()))
    assert {r.doc_id for r in dc.keep_clean(df, table, 200).collect()} == set(range(120)) - {d for d, _ in want}


def test_matches_brute_force_on_dense_vocabulary(spark):
    """Short overlaps by chance: everything found is an overlap, and clear overlaps are found."""
    few = [f"t{i}" for i in range(12)]
    items = [(i, RNG.choices(few, k=14)) for i in range(6)]
    docs = [(d, RNG.choices(few, k=40)) for d in range(25)]
    docs += [(100 + i, ["x"] * 5 + w + ["y"] * 5) for i, w in items]
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(documents(spark, [(d, " ".join(w)) for d, w in docs]), benchmark(spark, [(i, " ".join(w)) for i, w in items])).collect()}
    want = {(d, i) for d, w in docs for i, t in items if brute(w, t)}
    assert got <= want and {(100 + i, i) for i, _ in items} <= got


def test_odd_rows(spark):
    items = [(1, "quick brown fox jumps over the lazy dog"), (2, None), (None, "the quick brown fox"), (3, ""), (5, "QUICK brown fox jumps over the lazy dog"), (1, "quick brown fox jumps over the lazy dog"), (9, "word3 and word4 and word5 and word6 and word7 and")]
    from pyspark.sql import functions as F

    table = benchmark(spark, items).withColumn("start", F.lit(1))
    got = frame(dc.contaminated(odd_documents(spark), table))
    pairs = [(r.doc_id, r.item_id) for r in got.itertuples()]
    assert pairs.count((1, 1)) == 2 and (None, 1) in pairs and (4, 9) in pairs and {i for _, i in pairs} == {1, 5, 9}
    kept = frame(dc.keep_clean(odd_documents(spark), table))
    assert sorted(kept.doc_id.dropna()) == [2, 3, 5, 6, 2**53 + 1] and list(kept.columns) == odd_documents(spark).columns


def test_empty(spark):
    none, some = benchmark(spark, []), benchmark(spark, [(1, "a b c d e f g h i j")])
    assert dc.contaminated(documents(spark, []), some).count() == 0
    assert dc.contaminated(documents(spark, [(1, "a b c d e f g h i j")]), none).count() == 0
    assert dc.keep_clean(documents(spark, [(1, "a b c d e f g h i j")]), none).count() == 1


def test_given_tables(spark, sf):
    """Items that stand in a text word for word are found; nothing else shares half of an item."""
    docs, table = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.coverage for r in dc.contaminated(docs, table).collect()}
    texts = {r.doc_id: " ".join(r.text.lower().split()) for r in docs.collect()}
    exact = {(d, r.item_id) for r in table.collect() for d, t in texts.items() if f" {' '.join(r.text.lower().split())} " in f" {t} "}
    assert exact <= set(got) and exact


def test_ids_stay_exact_beside_nulls(spark):
    item = "one two three four five six seven"
    docs = documents(spark, [(None, item), (2**53 + 1, f"before {item}"), (2, None)]).coalesce(1)
    got = frame(dc.contaminated(docs, benchmark(spark, [(2**53 + 3, item)])))
    assert sorted(got.doc_id.dropna()) == [2**53 + 1] and got.doc_id.isna().sum() == 1 and set(got.item_id) == {2**53 + 3}


def test_repetitive_texts_stay_in_bounded_memory():
    """Thousands of equal words against an item of equal words: every pair of places is a hit."""
    import tracemalloc

    block = dc.TestBlock([(1, [b"a"] * 120), (2, [b"a"] * 60 + [b"b"] + [b"a"] * 59), (3, [b"a", b"b"] * 40)])
    texts = [b"a " * 12_000, b"a b " * 3000, b"c " * 50]
    tracemalloc.start()
    found = {(t, i): (start, n, same) for t, _, i, start, n, same in dc.overlaps([block], texts)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    assert found[0, 0] == (0, 120, 120) and found[0, 1] == (0, 120, 119) and found[1, 2] == (0, 80, 80)
    assert not any(t == 2 for t, _ in found)
