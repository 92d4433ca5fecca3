"""Benchmark decontamination by spaced-seed hashing and substitution-tolerant verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatspan.llm.common import WordHashes, as_utf8, mix, odd_constants, words_of

#: Fixed masks: 1 takes part in the hash, 0 is ignored. All have weight 8.
MASKS = ("11111111", "1110110111", "11011010111", "101101110101")
#: Masks of weight 6; one of them hits every overlap of 11 words or more with 0.8 or more equal, whichever words differ.
LIGHT = ("1101111", "11010000111", "11101011", "100111011")
#: By the words of a shorter item, masks that hit every overlap of 0.8 of it; items of under 5 words match as a whole.
SHORT = {
    **{n: ("1" * n,) for n in range(1, 5)},
    **{n: ("1111", "10111", "11011", "11101") for n in (5, 6)},
    7: ("1111", "11011"),
    8: ("11111", "110111", "111011"),
    9: ("111111", "1101111", "1111011"),
    **{n: ("110111", "11001011", "11111") for n in (10, 11, 12)},
}
#: An overlap counts from so many words (or 0.8 of a shorter item), with 0.8 or more of them equal.
MIN_OVERLAP = 13
SIMILARITY = 0.8
#: Words of test items that one broadcast holds; more items take more broadcasts.
BLOCK_WORDS = 1_000_000
_CHUNK = 300_000
#: Pairs of places that are listed at once, and cells of diagonals that are verified at once.
_PIECE, _CELLS = 500_000, 500_000
_PREPARED: list[TestBlock] = []
_TABLE_BITS = 22
_CONSTANTS = odd_constants(64, 5)


def _seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each position where it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            total += h[k : k + n] * _CONSTANTS[k]
    return mix(total)


class TestBlock:
    """Items of a bounded number of words. Their seeds are made where they are used, so that only words are broadcast."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        hashes = WordHashes()
        self.ids = [i for i, _ in items]
        self.words = [hashes(w) for _, w in items]
        self.seeds: list[tuple] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seeds": []}

    def prepare(self) -> TestBlock:
        """By mask: sorted seed hashes, their items and places there, and whether any seed has given leading bits."""
        items_of: dict[str, list[int]] = {}
        for i, h in enumerate(self.words):
            for mask in SHORT.get(len(h), (*MASKS, *LIGHT)):
                items_of.setdefault(mask, []).append(i)
        for mask, own in sorted(items_of.items()) if not self.seeds else ():
            found = [_seed_hashes(self.words[i], mask) for i in own]
            n = np.array([len(x) for x in found])
            if n.sum():
                x = np.concatenate(found)
                order = np.argsort(x, kind="stable")
                item, pos = np.repeat(np.array(own, dtype=np.int32), n), np.concatenate([np.arange(k, dtype=np.int32) for k in n])
                table = np.zeros(1 << _TABLE_BITS, dtype=bool)
                table[x >> np.uint64(64 - _TABLE_BITS)] = True
                self.seeds.append((mask, x[order], item[order], pos[order], table))
        return self

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, item, position in the item) of every seed that the words h share with an item, in bounded pieces."""
        for mask, x, item, pos, table in self.seeds:
            own = _seed_hashes(h, mask)
            at = np.flatnonzero(table[own >> np.uint64(64 - _TABLE_BITS)])
            lo, hi = np.searchsorted(x, own[at], "left"), np.searchsorted(x, own[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            upto, first = np.cumsum(n), 0
            while first < len(at):
                last = max(first + 1, int(np.searchsorted(upto, upto[first] - n[first] + _PIECE, "right")))
                own_n = n[first:last]
                k = np.repeat(lo[first:last], own_n) + np.arange(own_n.sum()) - np.repeat(np.cumsum(own_n) - own_n, own_n)
                yield np.repeat(at[first:last], own_n), item[k], pos[k]
                first = last

    def verify(self, h: np.ndarray, item: int, shifts: np.ndarray) -> tuple[int, int, int] | None:
        """Best of the longest similar overlaps on some diagonals: (start in h, words, equal words) between outer equal words.

        Most equal words win, then the first start. A window that loses nothing at +1 for an equal word and -4 for
        another has 0.8 equal; all diagonals are looked at together, a bounded number at a time.
        """
        words, best = self.words[item], None
        size = len(words)
        need = min(MIN_OVERLAP, int(np.ceil(SIMILARITY * size)))
        many = max(1, _CELLS // (size + 1))
        for top in range(0, len(shifts), many):
            at = shifts[top : top + many, None] + np.arange(size)
            inside = (at >= 0) & (at < len(h))
            equal = inside & (h[np.clip(at, 0, len(h) - 1)] == words)
            gain = np.zeros((len(at), size + 1), dtype=np.int64)
            np.cumsum(np.where(equal, 1, np.where(inside, -4, -8 * size)), axis=1, out=gain[:, 1:])
            row = np.arange(len(at))[:, None] * (32 * size * size + 64)
            # for each end, the first start that it isn't below: one ascending list of all rows' minima so far
            begin = np.searchsorted((row - np.minimum.accumulate(gain, axis=1)).ravel(), (row - gain).ravel(), "left").reshape(gain.shape) - np.arange(len(at))[:, None] * (size + 1)
            length = np.arange(size + 1) - begin
            end = length.argmax(axis=1)
            for r in np.flatnonzero(length[np.arange(len(at)), end] >= need):
                start = begin[r, end[r]]
                own = np.flatnonzero(equal[r, start : end[r]])
                found = (int(shifts[top + r] + start + own[0]), int(own[-1] - own[0]) + 1, len(own))
                if best is None or (-found[2], found[0]) < (-best[2], best[0]):
                    best = found
                    if best[2] == size:  # no later diagonal of this list starts earlier
                        return best
        return best


def overlaps(blocks: list[TestBlock], texts: list[bytes | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text number, block number, item number, start, words, equal words): the best overlap of each text and item."""
    hashes, held, total = WordHashes(), [], 0
    for k in range(len(texts) + 1):
        if k < len(texts) and len(h := hashes(words_of(texts[k]))):
            held.append((k, h))
            total += len(h)
        if held and (k == len(texts) or total > _CHUNK):
            for number, block in enumerate(blocks):
                yield from ((text, number, *found) for text, *found in _overlaps(_ready(block, len(blocks)), held))
            held, total = [], 0


def _ready(block: TestBlock, blocks: int) -> TestBlock:
    """The block with its seeds. Where there are several blocks, a worker holds the seeds of one at a time."""
    if blocks > 1 and not block.seeds:
        for other in _PREPARED:
            other.seeds = []
        _PREPARED[:] = [block]
    return block.prepare()


def _overlaps(block: TestBlock, held: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int, int, int]]:
    """Diagonals are verified piece by piece of the hits, so memory stays bounded however often words repeat.

    A text and item whose overlap is whole are looked at no more: pieces go from left to right, so any other whole
    overlap starts later.
    """
    joined = np.concatenate([h for _, h in held])
    starts = np.concatenate(([0], np.cumsum([len(h) for _, h in held])))
    items, most = len(block.words), max(len(w) for w in block.words)
    span = len(joined) + most
    best: dict[int, tuple[int, int, int]] = {}
    for at, item, pos in block.hits(joined):
        text = np.searchsorted(starts, at, "right") - 1
        keys = np.unique((text * items + item) * span + (at - starts[text] - pos + most))
        pairs, first = np.unique(keys // span, return_index=True)
        for pair, own in zip(pairs.tolist(), np.split(keys, first[1:]), strict=True):
            text, item = divmod(pair, items)
            if pair in best and best[pair][2] == len(block.words[item]):
                continue
            h, shifts = held[text][1], own % span - most
            shifts = shifts[(shifts > -len(block.words[item])) & (shifts < len(h))]
            found = block.verify(h, item, shifts) if len(shifts) else None
            if found and (pair not in best or (-found[2], found[0]) < (-best[pair][2], best[pair][0])):
                best[pair] = found
    for pair, found in sorted(best.items()):
        yield (held[pair // items][0], pair % items, *found)


def test_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[TestBlock]:
    """The items in blocks of bounded size, read one partition at a time; equal items count once, under their smallest id."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id")).orderBy("item_id")
    held, total = [], 0
    for r in items.select("item_id", as_utf8(F.col("text")).alias("raw")).toLocalIterator():
        words = words_of(bytes(r["raw"]))
        if held and total + len(words) > block_words:
            yield TestBlock(held)
            held, total = [], 0
        if words:
            held.append((r["item_id"], words))
            total += len(words)
    if held:
        yield TestBlock(held)


def _sent(docs: DataFrame, benchmark: DataFrame, block_words: int) -> list[Broadcast]:
    """The blocks of items, each a broadcast of at most block_words words (or one item) of 8 bytes."""
    return [docs.sparkSession.sparkContext.broadcast(block) for block in test_blocks(benchmark, block_words)]


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, start, n_words, n_equal, item_words, coverage): each document's overlap with each item.

    Clean documents have no row. Texts are taken whole, lower-cased, by words. Null or wordless texts and items,
    and items without an id, overlap nothing; equal items count under the smallest id; repeated documents each
    get their rows, those without an id with a null one. Either table may be empty. Further columns are ignored.
    The items are the stated query set: they are broadcast in blocks of ``block_words`` words, and one pass over the
    texts meets all blocks. Python sees the texts alone, so ids keep every digit.
    """
    blocks = _sent(docs, benchmark, block_words)

    @F.pandas_udf("array<struct<item_id:long,start:int,n_words:int,n_equal:int,item_words:int>>")
    def find(raw: pd.Series) -> pd.Series:
        own = [b.value for b in blocks]
        out: list[list[tuple]] = [[] for _ in range(len(raw))]
        for k, b, i, *found in overlaps(own, list(raw)):
            out[k].append((own[b].ids[i], *found, len(own[b].words[i])))
        return pd.Series(out)

    found = docs.select("doc_id", find(as_utf8(F.col("text"))).alias("found")).select("doc_id", F.explode("found").alias("o"))
    return found.select("doc_id", "o.*").withColumn("coverage", F.col("n_equal") / F.col("item_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that overlap any item: one narrow pass, no join."""
    blocks = _sent(docs, benchmark, block_words)

    @F.pandas_udf("boolean")
    def clean(raw: pd.Series) -> pd.Series:
        out = np.ones(len(raw), dtype=bool)
        for k, *_ in overlaps([b.value for b in blocks], list(raw)):
            out[k] = False
        return pd.Series(out)

    return docs.where(clean(as_utf8(F.col("text"))))
