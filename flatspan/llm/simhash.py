"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatspan.llm.common import as_utf8, cut_lineage, words_of
from flatspan.llm.components import connected_components

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 2
#: An index cell with more fingerprints than this is searched by shared neighbours instead of by pairs.
CELL = 32
BITS = 64
_BIT = np.arange(BITS, dtype=np.uint64)


def fingerprint(raw: bytes | None, width: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of a text's word shingles (repeats counted); no word: 0."""
    words = words_of(raw)
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):  # whole text, in bounded pieces
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(np.where(2 * ones > len(h), np.uint64(1) << _BIT, np.uint64(0))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) with fp as a signed long. A null text counts as an empty one.

    Python sees the texts alone, so ids keep every digit whatever nulls stand beside them.
    """

    @F.pandas_udf("long")
    def of_texts(raw: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in raw], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), of_texts(as_utf8(F.col("text"))).alias("fp"))


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((BITS, BITS), dtype=np.int64)
    for b in batches:
        x = _unpacked(b["fp"].to_numpy()).astype(np.float32)
        total += (x.T @ x).astype(np.int64)
    yield pd.DataFrame({"cell": np.arange(BITS * BITS), "n": total.ravel()})


def _unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(number, share of ones by bit, correlation of bits) over all fingerprints; 4,096 sums reach the driver."""
    n = fps.count()
    sums = np.zeros(BITS * BITS)
    for r in fps.select("fp").mapInPandas(_together, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums[r["cell"]] = r["n"]
    both = sums.reshape(BITS, BITS) / max(n, 1)
    p = both.diagonal().copy()
    spread = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    return n, p, (both - np.outer(p, p)) / np.outer(spread, spread)


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Correlated bits share a part: each part grows by the free bit that correlates most with it."""
    strength, free, out = np.abs(corr), set(range(BITS)), []
    for k in range(parts):
        room = BITS // parts + (k < BITS % parts)
        first = max(sorted(free), key=lambda b: strength[b, sorted(free)].sum())
        group = [first]
        free.remove(first)
        while len(group) < room:
            nxt = max(sorted(free), key=lambda b: strength[b, group].mean())
            group.append(nxt)
            free.remove(nxt)
        out.append(sorted(group))
    return out


def allocations(parts: int, distance: int) -> list[tuple[int, ...]]:
    """All thresholds with sum distance - parts + 1, each -1 (part not probed) or more: one part must match."""
    def grow(head: tuple[int, ...], left: int) -> Iterator[tuple[int, ...]]:
        if len(head) == parts - 1:
            yield (*head, left - 1)
            return
        for t in range(left + 1):
            yield from grow((*head, t - 1), left - t)

    return list(grow((), distance + 1))


def estimated_candidates(bits: np.ndarray, p: np.ndarray, groups: list[list[int]], n: int, distance: int) -> np.ndarray:
    """[query, part, threshold + 1]: probes plus expected matches, from the shares of ones, by a DP over a part's bits."""
    out = np.zeros((len(bits), len(groups), distance + 2))
    for g, group in enumerate(groups):
        miss = np.where(bits[:, group] == 1, 1 - p[group], p[group])
        exact = np.zeros((len(bits), distance + 1))
        exact[:, 0] = 1
        for j in range(len(group)):  # chance of 0, 1, 2 ... differing bits so far
            m = miss[:, j : j + 1]
            exact = exact * (1 - m) + np.pad(exact[:, :-1], ((0, 0), (1, 0))) * m
        probes = np.cumsum([_choose(len(group), t) for t in range(distance + 1)])
        out[:, g, 1:] = np.cumsum(exact, axis=1) * n + probes
    return out


def _choose(n: int, k: int) -> int:
    return int(np.prod([n - i for i in range(k)]) // np.prod(range(1, k + 1))) if k else 1


def allocate(cost: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query, thresholds of least total cost and that cost: dynamic programming over parts and budget spent."""
    n, parts, _ = cost.shape
    best = np.full((n, parts + 1, distance + 2), np.inf)
    best[:, 0, 0] = 0
    pick = np.zeros((n, parts + 1, distance + 2), dtype=np.int64)
    for g in range(parts):
        for spent in range(distance + 2):
            ways = np.stack([best[:, g, spent - t] + cost[:, g, t] for t in range(spent + 1)], axis=1)
            pick[:, g + 1, spent] = ways.argmin(axis=1)
            best[:, g + 1, spent] = ways.min(axis=1)
    thresholds, spent = np.zeros((n, parts), dtype=np.int64), np.full(n, distance + 1)
    for g in range(parts, 0, -1):
        t = pick[np.arange(n), g, spent]
        thresholds[:, g - 1], spent = t - 1, spent - t
    return thresholds, best[:, parts, distance + 1]


def choose_parts(p: np.ndarray, corr: np.ndarray, n: int, distance: int, most: int = 4) -> list[list[int]]:
    """The number of parts whose expected cost is least for typical fingerprints (drawn from the shares of ones)."""
    typical = (np.random.default_rng(0).random((64, BITS)) < p).astype(np.uint8)
    plans = [group_bits(corr, m) for m in range(2, most + 1)]
    return min(plans, key=lambda g: allocate(estimated_candidates(typical, p, g, n, distance), distance)[1].mean())


def near_links(fps: DataFrame, distance: int = MAX_DISTANCE, cell: int = CELL) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all pairs at ``distance`` (2 or less) bits or fewer.

    fps: distinct fingerprints, column fp. Every link is verified. The links connect whatever the full set of
    close pairs connects: cells of the index with up to ``cell`` fingerprints give all their pairs; of crowded
    cells, every fingerprint that lies in or probes one lists itself at the 65 values within one bit of it.
    Two fingerprints differ at no more than two bits just when they meet at such a value, and at most 65 can
    meet at one, so crowded cells cost 65 rows a fingerprint, whatever their size, and miss nothing.
    """
    n, p, corr = bit_statistics(fps)
    groups = choose_parts(p, corr, max(n, 1), distance)
    masks = [sum(1 << b for b in g) for g in groups]

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy().astype(np.int64)
            for k in range(0, len(fp), 4096):
                yield from _probes(fp[k : k + 4096], p, groups, masks, n, distance)

    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    index = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("sig")) for i, m in enumerate(signed)])).alias("c")).select("fp", "c.*")
    asked = cut_lineage(fps.mapInPandas(probes, "q long, part int, sig long"))
    crowded = cut_lineage(index.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell))
    close = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= distance
    pairs = asked.join(crowded, ["part", "sig"], "left_anti").join(index, ["part", "sig"]).where(close & (F.col("q") != F.col("fp")))
    pairs = pairs.select(F.least("q", "fp").alias("a"), F.greatest("q", "fp").alias("b")).distinct()
    dense = index.join(crowded, ["part", "sig"], "left_semi").select("fp").union(asked.join(crowded, ["part", "sig"], "left_semi").select("q")).distinct()
    if distance == 2:
        near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(BITS)])
        met = dense.select("fp", F.explode(near).alias("point")).groupBy("point").agg(F.array_sort(F.collect_list("fp")).alias("at")).where(F.size("at") > 1)
        shared = met.select(F.col("at")[0].alias("a"), F.explode(F.slice("at", 2, BITS)).alias("b"))
    elif distance == 1:
        near = F.array(*[F.col("fp").bitwiseAND(F.lit(~(1 << b) if b < 63 else (1 << 63) - 1).cast("long")) for b in range(BITS)])
        met = dense.select("fp", F.posexplode(near).alias("bit", "point")).groupBy("bit", "point").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
        shared = met.where("a < b").select("a", "b")
    else:
        raise ValueError("distance is 1 or 2")
    return pairs.union(shared.distinct())


def _probes(fp: np.ndarray, p: np.ndarray, groups: list, masks: list, n: int, distance: int) -> Iterator[pd.DataFrame]:
    thresholds, _ = allocate(estimated_candidates(_unpacked(fp), p, groups, n, distance), distance)
    u = fp.view(np.uint64)
    for g, (bits, mask) in enumerate(zip(groups, masks, strict=True)):
        sig = u & np.uint64(mask)
        flips = [(0, np.uint64(0))]
        one = [np.uint64(1) << np.uint64(b) for b in bits]
        flips += [(1, x) for x in one]
        flips += [(2, x | y) for i, x in enumerate(one) for y in one[:i]] if distance > 1 else []
        for level in range(distance + 1):
            at = thresholds[:, g] >= level
            if at.any():
                for k, x in flips:
                    if k == level:
                        yield pd.DataFrame({"q": fp[at], "part": np.int32(g), "sig": (sig[at] ^ x).view(np.int64)})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id): documents whose fingerprints reach each other by links of 2 bits.

    component_id is the smallest doc_id reachable, itself included. Equal texts share a fingerprint and so a
    component. A null, empty or wordless text has fingerprint 0 and links like any other. Rows without an id get
    their group's component_id (null where no member has an id). Repeated rows stay as they are; an empty table
    gives an empty result; columns besides doc_id and text are ignored.
    """
    rows = cut_lineage(fingerprints(docs))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = cut_lineage(classes)
    comps = connected_components(near_links(classes.select("fp")), "a", "b")
    owner = classes.join(comps, classes["fp"] == comps["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("comp"))
    lowest = owner.groupBy("comp").agg(F.min("first").alias("component_id"))
    owner = owner.join(lowest, "comp").select("fp", "comp", "component_id")
    return rows.join(owner, "fp").select("doc_id", "text_hash", "fp", "comp", "component_id")


def digest(near: DataFrame) -> DataFrame:
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with docs' columns: the one with the smallest id.

    Of rows with that id, one stays; a group without any id keeps one of its rows.
    """
    near = cut_lineage(near_duplicates(docs))
    chosen = near.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("comp").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"), F.count(F.lit(1)).alias("rows"))
    chosen = chosen.select("comp", F.col("k.doc_id").alias("k_id"), F.col("k.text_hash").alias("k_hash"), "rows")
    same = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_hash")
    kept = docs.select(*same).join(chosen, F.col("d_id").eqNullSafe(F.col("k_id")) & (F.col("d_hash") == F.col("k_hash")))
    single = kept.where("rows = 1").select("row.*")
    repeated = kept.where("rows > 1").dropDuplicates(["comp"]).select("row.*")
    return single.union(repeated)
