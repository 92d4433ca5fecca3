"""Language-model scoring with a weighted backoff automaton."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatspan.llm.common import WordHashes, as_utf8, fold, mix, odd_constants, release, words_of

FOLDS, HELD = 7, 2
#: Key of the end token; no word holds white space, so none shares its bytes. It also stands before a text.
END = xxhash.xxh64_intdigest(b" ")
#: What the failure arc of a word and of a bigram weighs, in occurrences.
BACKOFF = (100.0, 3.0)
#: Bytes of text that are scored together, and the least number of such blocks.
BLOCK_BYTES, LEAST_BLOCKS = 16 << 20, 8
#: Bytes of text for each part of the key space: two million n-grams or so are counted together.
PART_BYTES = 8 << 20
#: Bits of a key that count beside its part: with two million keys a part, 1 in 500,000 meets another's.
KEY_BITS = 40
_CHUNK = 400_000
_PAIR, _TRIPLE = odd_constants(2, 21), odd_constants(2, 22)


@dataclass
class Grams:
    """Keys of the words to predict in some texts, one after another, and of the n-grams that end there.

    one, two, three: keys of the word, bigram and trigram (0: the text has no trigram there yet). first: where each text
    begins; the state before a text is the end token's.
    """

    one: np.ndarray
    two: np.ndarray
    three: np.ndarray
    first: np.ndarray


def _grams_of(texts: list[np.ndarray]) -> Grams:
    ends = np.array([END], dtype=np.uint64)
    h = np.concatenate([part for t in texts for part in (ends, t, ends)])
    sizes = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(sizes + 1) - (sizes + 1)
    opens = np.zeros(len(h), dtype=bool)
    opens[first] = True
    two, three = np.zeros(len(h), dtype=np.uint64), np.zeros(len(h), dtype=np.uint64)
    two[1:] = mix(h[:-1] * _PAIR[0] + h[1:] * _PAIR[1])
    two[opens] = 0
    three[1:] = mix(two[:-1] * _TRIPLE[0] + h[1:] * _TRIPLE[1])
    three[1:][opens[:-1]] = 0
    at = np.flatnonzero(~opens)
    return Grams(h[at], two[at], three[at], np.cumsum(sizes) - sizes)


def _grams(raws: Iterable[bytes], hashes: WordHashes) -> Iterator[Grams]:
    """The n-grams of many texts, a bounded number of words (and at least one text) at a time."""
    held, total = [], 0
    for raw in raws:
        held.append(hashes(words_of(raw)))
        total += len(held[-1]) + 1
        if total > _CHUNK:
            yield _grams_of(held)
            held, total = [], 0
    if held:
        yield _grams_of(held)


def _whole(raws: Iterable[bytes]) -> Grams:
    """The n-grams of a block's texts."""
    found = list(_grams(raws, WordHashes()))
    before = np.cumsum([0, *[len(g.one) for g in found[:-1]]])
    join = lambda name: np.concatenate([getattr(g, name) for g in found])
    return Grams(join("one"), join("two"), join("three"), np.concatenate([g.first + b for g, b in zip(found, before, strict=True)]))


@dataclass(frozen=True)
class Parts:
    """The key space in 2 ** bits parts by leading bits."""

    bits: int

    @classmethod
    def for_bytes(cls, size: int) -> Parts:
        return cls(min(max(math.ceil(math.log2(max(size / PART_BYTES, 1))), 2), 64 - KEY_BITS))

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """Where each part begins among ascending keys, and their number."""
        starts = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        return np.append(np.searchsorted(keys, starts), len(keys))


def _packed(keys: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """The KEY_BITS after the part of ascending keys, as differences: three low bytes each, and what is above them, compressed."""
    d = np.diff((keys << np.uint64(bits)) >> np.uint64(64 - KEY_BITS), prepend=np.uint64(0))
    return d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3].tobytes(), zlib.compress((d >> np.uint64(24)).astype("<u2").tobytes(), 1)


def _unpacked(low: bytes, high: bytes) -> np.ndarray:
    d = np.zeros((len(low) // 3, 8), dtype=np.uint8)
    d[:, :3] = np.frombuffer(low, dtype=np.uint8).reshape(-1, 3)
    return np.cumsum(d.view("<u8").ravel() + (np.frombuffer(zlib.decompress(high), dtype="<u2").astype(np.uint64) << np.uint64(24)))


def _counts(n: np.ndarray) -> bytes:
    """Counts, most of them small, in few bytes; in eight bytes each before where one doesn't fit four."""
    return zlib.compress(n.astype("<u8" if len(n) and n.max() >= 1 << 32 else "<u4").tobytes(), 1)


def _numbers(cell: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(cell)
    return np.frombuffer(raw, dtype="<u8" if len(raw) > 4 * n else "<u4")


def cells(kinds: list[tuple[np.ndarray, np.ndarray]], parts: Parts, block: int) -> pd.DataFrame:
    """A row a part and kind (words, bigrams, trigrams): the block's distinct keys there, ascending, and what it adds to their counts."""
    rows = []
    for kind, (keys, n) in enumerate(kinds):
        edge = parts.bounds(keys)
        rows += [(p, block, kind, *_packed(keys[edge[p] : edge[p + 1]], parts.bits), _counts(n[edge[p] : edge[p + 1]])) for p in np.flatnonzero(np.diff(edge)).tolist()]
    return pd.DataFrame(rows, columns=["part", "block", "kind", "low", "high", "n"])


CELLS = "part int, block int, kind int, low binary, high binary, n binary"


def summed(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(counts by distinct key, each sent key's place among them, keys by cell) of one part."""
    kinds, where = np.unique(np.concatenate([_unpacked(*c) for c in zip(group["low"], group["high"], strict=True)]), return_inverse=True)
    sizes = [len(low) // 3 for low in group["low"]]
    n = np.bincount(where, weights=np.concatenate([_numbers(c, m) for c, m in zip(group["n"], sizes, strict=True)]), minlength=len(kinds))  # exact up to 2 ** 53
    return n, where, sizes


def words_in_all(train: DataFrame, parts: Parts) -> tuple[int, int, int, int]:
    """(tokens, distinct tokens, those that occur once, twice) over all rows of train (column raw)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for g in _grams((raw for b in batches for raw in b["raw"]), WordHashes()):
            held.append(np.unique(g.one, return_counts=True))
            if sum(len(k) for k, _ in held) > 4_000_000:
                held = [_merged(held)]
                if len(held[0][0]) > 2_000_000:
                    yield cells(held, parts, 0)
                    held = []
        if held:
            yield cells([_merged(held)], parts, 0)

    def tally(group: pd.DataFrame) -> pd.DataFrame:
        n, _, _ = summed(group)
        return pd.DataFrame({"tokens": [int(n.sum())], "kinds": [len(n)], "once": [int((n == 1).sum())], "twice": [int((n == 2).sum())]})

    found = train.mapInPandas(count, CELLS).groupBy("part").applyInPandas(tally, "tokens long, kinds long, once long, twice long")
    return tuple(x or 0 for x in found.agg(*[F.sum(c) for c in found.columns]).first())


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    kinds, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return kinds, np.bincount(where, weights=np.concatenate([n for _, n in held]), minlength=len(kinds)).astype(np.int64)


@dataclass(frozen=True)
class Root:
    """The automaton's root: its arcs cover the vocabulary, and all words that it lacks share what the discount leaves.

    Known words have (n - cut) of ``tokens``. The rest goes to unknown words by equal parts; how many kinds of them there
    are is estimated from words that occur once and twice (Chao), and taken as at least the known ones.
    """

    tokens: int
    kinds: int
    once: int
    twice: int

    def probability(self, n: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(n))  # nothing was learned: one outcome, the unknown word
        cut = min(max(self.once / max(self.once + 2 * self.twice, 1), 0.1), 0.9)
        unseen = max(self.kinds, self.once * (self.once - 1) / (2 * (self.twice + 1)))
        return np.where(n > 0, n - cut, cut * self.kinds / unseen) / self.tokens


def traverse(root: Root, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, first: np.ndarray, texts: int) -> np.ndarray:
    """log10 probability of each word along one traversal of the automaton from left to right.

    States are the histories seen in training: a bigram, a word, or the root; a text starts in the end token's state, of
    which there were ``texts``. The state after a word is the longest history that ends there. An arc of state h that reads
    w weighs (n(hw) + k * p) / (n(h) + k), where p is what the state without its first word gives; where there is no arc, the
    failure arc weighs k / (n(h) + k) and leads there. So a state's arcs and its failure arc share all of its mass.
    """
    p = root.probability(n1)
    word, pair = np.zeros(len(n1)), np.zeros(len(n1))  # counts of the states before each word
    word[1:], pair[1:] = n1[:-1], n2[:-1]
    word[first], pair[first] = texts, 0
    for state, n, k in ((word, n2, BACKOFF[0]), (pair, n3, BACKOFF[1])):
        p = n / (state + k) + k / (state + k) * p
    return np.log10(p)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every whole text.

    Learned from the rows whose fold is not HELD: all their words, bigrams and trigrams, each told apart by a hash. A null or empty
    text is the end token alone; rows with a null id are of fold 0; repeated rows each get a row and each count; an
    empty table gives an empty result; further columns are ignored.

    Counts may not fit anywhere whole. Texts are dealt into blocks of bounded bytes, by id, text and their place in the
    input, so that no source, id or repeated row makes one large. Each block sends its distinct n-grams once, cut by
    parts of the key space, with what it adds to their counts; a part of bounded size sums them and answers each block in the same
    order; the block, whose texts are shuffled once for both, is scored with its answers.
    """
    rows = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"),  # no null among longs, which pandas would make floats
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), as_utf8(F.coalesce("text", F.lit(""))).alias("raw"),
    )
    size, texts = rows.agg(F.coalesce(F.sum(F.octet_length("raw") + 1), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    parts, blocks = Parts.for_bytes(size), max(LEAST_BLOCKS, math.ceil(size / BLOCK_BYTES))
    root = Root(*words_in_all(rows.where(~F.col("held_out")).select("raw"), parts))
    release(docs.sparkSession)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "raw", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    def ask(b: pd.DataFrame) -> pd.DataFrame:
        g, held = _whole(b["raw"]), b["held_out"].to_numpy(dtype=bool)
        learned = np.repeat(~held, np.diff(np.append(g.first, len(g.one)))).astype(np.float64)
        kinds = []
        for key in (g.one, g.two, g.three):
            own, where = np.unique(key, return_inverse=True)
            n = np.bincount(where, weights=learned, minlength=len(own))
            kinds.append((own[own != 0], n[own != 0]))
        return cells(kinds, parts, int(b["block"].iloc[0]))

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        n, where, sizes = summed(group)
        own = np.split(n[where], np.cumsum(sizes)[:-1])
        return group[["part", "block", "kind"]].assign(n=[_counts(x) for x in own])

    def score(b: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        g, found = _whole(b["raw"]), []
        for kind, key in enumerate((g.one, g.two, g.three)):
            own, where = np.unique(key, return_inverse=True)
            said, edge = answers[answers["kind"] == kind].sort_values("part"), np.diff(parts.bounds(own[own != 0]))
            counts = [_numbers(c, int(edge[p])) for c, p in zip(said["n"], said["part"], strict=True)]
            found.append(np.concatenate([np.zeros(int(own[0] == 0), dtype="<u4"), *counts])[where].astype(np.float64))
        n1, n2, n3 = found
        base = np.log10((n1 + 1) / (root.tokens + root.kinds + 1))
        total = lambda x: np.add.reduceat(x, g.first)
        return pd.DataFrame({
            "id": b["id"], "no_id": b["no_id"], "held_out": b["held_out"], "n_tokens": np.diff(np.append(g.first, len(n1))), "n_known": total((n1 > 0).astype(np.int64)),
            "base_score": total(base), "score": total(traverse(root, n1, n2, n3, g.first, texts)),
        })

    answered = dealt.groupBy("block").applyInPandas(ask, CELLS).groupBy("part").applyInPandas(answer, "part int, block int, kind int, n binary")
    scored = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(score, "id long, no_id boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(root.tokens).cast("long").alias("train_tokens"), "base_score", "score")
