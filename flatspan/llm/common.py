"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flatspan.runtime import cut_lineage, ensure_checkpoint_dir, stored_for_now

__all__ = ["WORD", "WordHashes", "as_utf8", "cut_lineage", "ensure_checkpoint_dir", "fold", "local_roots", "mix", "odd_constants", "read_table", "release", "small_or_whole", "stored", "stored_for_now", "words_of"]

#: Word pattern of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def as_utf8(text: Column) -> Column:
    """A text's bytes, so that Python need not encode it again."""
    return text.cast("binary")


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words; bytes.split() splits at just the white space that WORD leaves out."""
    return raw.lower().split() if raw else []


class WordHashes:
    """XXH64 of words, remembered up to a bound so that frequent words are hashed once."""

    def __init__(self, seed: int = 0, bound: int = 400_000):
        self.seed, self.bound, self.known = seed, bound, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, seed, digest = self.known, self.seed, xxhash.xxh64_intdigest
        if len(known) > self.bound:
            known.clear()
        get, out = known.get, []
        add = out.append
        for w in words:
            h = get(w)
            if h is None:
                h = known[w] = digest(w, seed)
            add(h)
        return np.array(out, dtype=np.uint64)


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers for order-sensitive sums of hashes."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (shift, multiply, shift), so that all bits of a sum are usable."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i]: each node's smallest reachable node."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def stored(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage is cut, and columns can be pruned."""
    return stored_for_now(df)[0]


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished phases now: it does so when their owners are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_or_whole(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else as it is, to be joined by a shuffle. df is written out already."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
