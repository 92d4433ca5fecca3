"""Substring dedup: MinHash banding of paragraphs, exact verification, and clusters by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flatspan.llm.common import WordHashes, as_utf8, cut_lineage, local_roots, mix, odd_constants, release, small_or_whole, stored_for_now
from flatspan.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
#: 1 - (1 - 0.8 ** 3) ** 7 = 0.993 of the pairs at the threshold collide, and more above it.
BANDS, ROWS = 7, 3
#: Lines with fewer words are short. Short lines that follow each other form a paragraph, up to a blank line or to one
#: that its content marks as the last; paragraphs of fewer words are left.
MIN_PARAGRAPH = 20
#: Sentences with fewer words join the next one; sentence units with fewer words are left; longer sentences than
#: LONG_SENTENCE are cut by content too, where a pair of words has the least hash of all within REACH words.
MIN_SENTENCE, MIN_UNIT, LONG_SENTENCE, REACH = 6, 5, 12, 4
#: Repeated units of a text that follow each other (over at most GAP other words) form a passage. It needs so many
#: words outside lines of under 20 words: common short lines, however many stand together, are no passage. A passage
#: of over 50 words loses the ends up to its first and last cut, some words each, to the text around it. Where a passage
#: goes on through short lines, MIN_MIXED words suffice of which MIN_LONG stand outside them; and MIN_MIXED words in
#: paragraphs of short lines that repeat as such.
GAP, MIN_PASSAGE, MIN_MIXED, MIN_LONG = 5, 24, 40, 10
#: Buckets with more paragraphs are compared in tiles.
BUCKET, TILE = 48, 128
_CHUNK = 200_000
_SHINGLE = odd_constants(SHINGLE, 1)
_HASHES = odd_constants(BANDS * ROWS, 2)
_CUT = odd_constants(2, 3)
_BAND = odd_constants(ROWS, 4)


class MarkedHashes(WordHashes):
    """Word hashes whose lowest bit tells whether the word ends a sentence."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > self.bound:
            known.clear()
        get, out = known.get, []
        for w in words:
            h = get(w)
            if h is None:
                h = known[w] = (digest(w) & ~1) | (w[-1] in b".!?")
            out.append(h)
        return np.array(out, dtype=np.uint64)


class Powers:
    """Random odd weights by place, as many as the longest unit so far needs."""

    def __init__(self):
        self.w = odd_constants(4096, 9)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.w):
            self.w = odd_constants(1 << n.bit_length(), 9)
        return self.w[:n]


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words (fewer words: of them all)."""
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    total = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k):
        total += h[i : i + n] * _SHINGLE[i]
    return mix(total)


def _sums(h: np.ndarray, starts: np.ndarray, stops: np.ndarray, powers: Powers) -> np.ndarray:
    """Order-sensitive hash of each unit h[start:stop]; units are ascending and don't overlap."""
    n = stops - starts
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(starts, n) + place
    return mix(np.add.reduceat(h[at] * powers(int(n.max()))[place], np.cumsum(n) - n) + n.astype(np.uint64))


def _lines(raw: bytes) -> tuple[list[bytes], list[int], list[bool]]:
    """All words, where each line with words ends, and whether a blank line (or none) stands before it."""
    words, ends, opens, blank = [], [], [], True
    for line in raw.lower().split(b"\n"):
        own = line.split()
        if own:
            words += own
            ends.append(len(words))
            opens.append(blank)
        blank = not own
    return words, ends, opens


def _least_nearby(v: np.ndarray) -> np.ndarray:
    """For each word, whether its pair with the word before has the least hash of all within REACH words; v: from the second word on."""
    padded = np.full(len(v) + 1 + 2 * REACH, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[REACH + 1 : REACH + 1 + len(v)] = v
    own = padded[REACH : REACH + 1 + len(v)]
    least = own < np.iinfo(np.uint64).max
    for k in (*range(-REACH, 0), *range(1, REACH + 1)):
        least &= own < padded[REACH + k : REACH + k + 1 + len(v)]
    return least


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units of whole texts: paragraphs with their band keys, and sentences."""
    hashes, powers = MarkedHashes(), Powers()
    held: list[tuple[tuple[int, int], np.ndarray, list[int], list[bool]]] = []
    total = 0
    for b in batches:
        for doc_id, row, raw in zip(b["doc_id"].tolist(), b["row"].tolist(), b["raw"], strict=True):
            words, ends, opens = _lines(raw)
            if words:
                held.append(((doc_id, row), hashes(words), ends, opens))
                total += len(words)
            if total > _CHUNK:
                yield _units_of(held, powers)
                held, total = [], 0
    if held:
        yield _units_of(held, powers)


def _units_of(held: list[tuple[tuple[int, int], np.ndarray, list[int], list[bool]]], powers: Powers) -> pd.DataFrame:
    h = np.concatenate([x for _, x, _, _ in held])
    sizes = np.array([len(x) for _, x, _, _ in held])
    base = np.cumsum(sizes) - sizes
    line_end = np.concatenate([np.asarray(e) + o for (_, _, e, _), o in zip(held, base, strict=True)])
    line_start = np.concatenate(([0], line_end[:-1]))
    # paragraphs: long lines, and short ones together
    few = line_end - line_start < MIN_PARAGRAPH
    last = mix(h[line_end - 1] * _CUT[0] + h[line_start] * _CUT[1]) >> np.uint64(62) == 0
    opens = np.concatenate([np.asarray(o) for _, _, _, o in held]) | ~few
    opens[1:] |= ~few[:-1] | last[:-1]
    at = np.flatnonzero(opens)
    ps, pe, joined = line_start[at], line_end[np.append(at[1:], len(few)) - 1], few[at]
    long = pe - ps >= MIN_PARAGRAPH
    ps, pe, joined = ps[long], pe[long], joined[long]
    bands = np.empty((0, BANDS), dtype=np.uint64)
    if len(ps):
        sh = shingles(h)
        n = pe - ps - SHINGLE + 1
        first = np.cumsum(n) - n
        own = sh[np.repeat(ps, n) + np.arange(n.sum()) - np.repeat(first, n)]
        bands = np.zeros((len(ps), BANDS), dtype=np.uint64)
        for k, c in enumerate(_HASHES):
            bands[:, k // ROWS] += np.minimum.reduceat(own * c, first) * _BAND[k % ROWS]
        bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
    # sentences: where a long one ends, where two words' hash says so, and at line ends
    ends_line = np.zeros(len(h) + 1, dtype=bool)
    ends_line[line_end] = True
    stop = np.flatnonzero(((h & np.uint64(1)) == 1) | ends_line[1:]) + 1
    length = np.diff(stop, prepend=0)
    cut = _least_nearby(mix(h[:-1] * _CUT[0] + h[1:] * _CUT[1]))
    cut &= np.repeat(length, length) > LONG_SENTENCE  # the last word of h ends a line, so lengths cover all words
    cut[stop[length >= MIN_SENTENCE] - 1] = True
    cut[line_end - 1] = True
    se = np.flatnonzero(cut) + 1
    ss = np.concatenate(([0], se[:-1]))
    whole = np.zeros(len(h) + 1, dtype=bool)
    whole[ps] = True
    keep = (se - ss >= MIN_UNIT) & ~(whole[ss] & ends_line[se] & (se - ss >= MIN_PARAGRAPH))
    ss, se = ss[keep], se[keep]
    ids = np.array([i for i, _, _, _ in held], dtype=np.int64).reshape(-1, 2)
    parts = []
    short = few[np.searchsorted(line_end, ss, "right")]
    for kind, s, e, in_short, bs in (("p", ps, pe, joined, list(bands.view(np.int64))), ("s", ss, se, short, None)):
        if len(s):
            doc = np.searchsorted(base, s, "right") - 1
            parts.append(pd.DataFrame({"kind": kind, "key": _sums(h, s, e, powers).view(np.int64), "doc_id": ids[doc, 0], "row": ids[doc, 1], "start": (s - base[doc]).astype(np.int32), "n": (e - s).astype(np.int32), "short": in_short, "bands": bs}))
    return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("kind", "key", "doc_id", "row", "start", "n", "short", "bands")})


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, raw): each document's texts, once each. row is 0 where an id has one row, and a text's hash where it has several.

    Rows are counted by id and hash first, in each task and then in all. Only where more than a bounded number of ids repeat
    are texts shuffled to find theirs; a text that repeats under one id is merged in each task before it moves.
    """
    text = F.col("text")
    rows = docs.where(F.col("doc_id").isNotNull() & text.isNotNull()).select("doc_id", F.xxhash64(text).alias("row"), as_utf8(text).alias("raw"))
    several = rows.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 1").select("doc_id")
    several = small_or_whole(cut_lineage(several))
    single = rows.join(several, "doc_id", "left_anti").select("doc_id", F.lit(0).cast("long").alias("row"), "raw")
    return single.union(cut_lineage(rows.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", "row"])))


def units(texts: DataFrame) -> DataFrame:
    """All units of the texts (doc_id, row, raw)."""
    return texts.mapInPandas(_units, "kind string, key long, doc_id long, row long, start int, n int, short boolean, bands array<long>")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingle sets of the wanted paragraphs, whose content is checked again."""
    hashes, powers = MarkedHashes(), Powers()
    for b in batches:
        keys, found = [], []
        for raw, wanted in zip(b["raw"], b["wanted"], strict=True):
            h = hashes(_lines(raw)[0])
            for w in wanted:
                own = h[w["start"] : w["start"] + w["n"]]
                if len(own) == w["n"] and _sums(own, np.array([0]), np.array([len(own)]), powers).view(np.int64)[0] == w["key"]:
                    keys.append(w["key"])
                    found.append(np.unique(shingles(own)).view(np.int64))
        yield pd.DataFrame({"key": np.array(keys, dtype=np.int64), "shingles": found})


def compare_bucket(group: pd.DataFrame, similarity: float = SIMILARITY) -> pd.DataFrame:
    """Links (key, root) among two tiles of a crowded bucket: each paragraph with its smallest partner by links here."""
    group = group.drop_duplicates("key").sort_values("key")
    key, own = group["key"].to_numpy(), group["shingles"].to_list()
    n = np.array([len(x) for x in own])
    kinds, at = np.unique(np.concatenate(own), return_inverse=True)
    row = np.repeat(np.arange(len(own)), n)
    shared = np.zeros((len(own), len(own)), dtype=np.float32)
    for k in range(0, len(kinds), 4096):  # bounded memory for any number of shingles
        inside = (at >= k) & (at < k + 4096)
        m = np.zeros((len(own), min(4096, len(kinds) - k)), dtype=np.float32)
        m[row[inside], at[inside] - k] = 1
        shared += m @ m.T
    i, j = np.nonzero(np.triu(shared >= similarity * (n[:, None] + n[None, :] - shared) - 1e-6, 1))
    root = local_roots(len(own), i, j)
    linked = np.flatnonzero(root != np.arange(len(own)))
    return pd.DataFrame({"a": key[root[linked]], "b": key[linked]})


def paragraph_links(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): verified links between distinct paragraphs, that connect all colliding pairs of similarity 0.8 or more.

    texts: doc_id, row, raw. classes: key, bands, and where one of the paragraphs is: doc_id, row, start, n.
    """
    banded = classes.select("key", F.explode("bands").alias("bucket"))
    buckets = cut_lineage(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("key").alias("a"), F.max("key").alias("b")).where("members > 1"))
    several = banded.join(buckets.where("members > 2").select("bucket", "members", F.col("a").alias("pivot")), "bucket")
    some = several.where(F.col("members") <= BUCKET).select("bucket", "key")
    pairs = some.select("bucket", F.col("key").alias("a")).join(some.select("bucket", F.col("key").alias("b")), "bucket").where("a < b").select("a", "b")
    pairs = cut_lineage(pairs.union(buckets.where("members = 2 and a < b").select("a", "b")).distinct())
    crowded = cut_lineage(several.where(F.col("members") > BUCKET).select("bucket", "key", "pivot"))
    release(texts.sparkSession)
    wanted = pairs.select("a").union(pairs.select("b")).union(crowded.select("key")).distinct().select(F.col("a").alias("key"))
    where = classes.select("key", "doc_id", "row", "start", "n").join(wanted, "key").groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "start", "n")).alias("wanted"))
    asked = texts.join(where, ["doc_id", "row"])
    sets = cut_lineage(asked.select("raw", "wanted").mapInPandas(_sets, "key long, shingles array<long>").dropDuplicates(["key"]))
    del asked, where, wanted
    release(texts.sparkSession)
    left, right = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    close = pairs.join(left, "a").join(right, "b").where(_similarity() >= SIMILARITY).select("a", "b")
    return cut_lineage(close.union(crowded_links(crowded, sets)))


def _similarity():
    """Jaccard similarity of the sets sa and sb."""
    shared = F.size(F.array_intersect("sa", "sb"))
    return shared / (F.size("sa") + F.size("sb") - shared)


def crowded_links(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """Links in crowded buckets (bucket, key, pivot), that connect all their pairs of similarity 0.8 or more.

    Every member is compared with its bucket's pivot first: one row a member. Members within 0.2 of the pivot (Jaccard
    distance is a metric) are linked to it and need no comparison with each other, and none of them is near a member more
    than 0.4 away. What remains, the others with each other and those from 0.2 to 0.4 away with the near ones, meets in
    tiles: few where a bucket holds copies of one paragraph, all pairs of tiles at worst.
    """
    pivots = crowded.select(F.col("pivot").alias("key")).distinct().join(sets, "key").select(F.col("key").alias("pivot"), F.col("shingles").alias("sa"))
    seen = crowded.join(sets.select("key", F.col("shingles").alias("sb")), "key").join(small_or_whole(cut_lineage(pivots), 1000), "pivot")
    seen = cut_lineage(seen.select("bucket", "key", "pivot", _similarity().alias("like")))
    zone = F.when(F.col("like") >= SIMILARITY, 0).when(F.col("like") >= 2 * SIMILARITY - 1 - 1e-9, 1).otherwise(2)
    placed = seen.withColumn("zone", zone)
    counts = placed.groupBy("bucket").agg(*[F.ceil(F.count_if(c) / TILE).cast("int").alias(n) for n, c in (("near", F.col("zone") == 0), ("ring", F.col("zone") == 1), ("rest", F.col("zone") > 0))])
    placed = placed.join(small_or_whole(cut_lineage(counts), 10_000), "bucket")
    tile = lambda n: F.pmod(F.xxhash64("key"), F.greatest(F.col(n), F.lit(1))).cast("int")
    every = lambda n, make: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)).otherwise(F.array())
    meet = lambda kind, t, u: F.struct(F.lit(kind).alias("kind"), t.cast("int").alias("t"), u.cast("int").alias("u"))
    among = every("rest", lambda u: meet(0, F.least(tile("rest"), u), F.greatest(tile("rest"), u)))
    across = F.when(F.col("zone") == 0, every("ring", lambda u: meet(1, u, tile("near")))).when(F.col("zone") == 1, every("near", lambda u: meet(1, tile("ring"), u))).otherwise(F.array())
    meets = F.concat(F.when(F.col("zone") > 0, among).otherwise(F.array()), across)
    tiled = placed.select("bucket", "key", F.explode(meets).alias("m")).select("bucket", "key", "m.*").join(sets, "key")
    star = seen.where((F.col("like") >= SIMILARITY) & (F.col("key") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    return star.union(tiled.groupBy("bucket", "kind", "t", "u").applyInPandas(lambda g: compare_bucket(g), "a long, b long"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_words, cluster, first_doc, removed, via): passages that other documents hold too.

    Units of a text are its paragraphs (lines of 20 words or more, and shorter lines together) and its sentences.
    Paragraphs are near-duplicates where their sets of five-word shingles have a Jaccard similarity of 0.8 or more:
    MinHash bands propose pairs, exact sets verify them, components cluster them. A passage may also stand inside
    different paragraphs; there its sentences and parts of long ones, cut by content alone, repeat word for word. Repeated
    units that follow each other form a passage; of 24 words or more in lines of 20 or more (or 40 in all) it is
    returned, with the smallest document that shares one of its units (first_doc) and a cluster: that of its longest
    paragraph (via: paragraph), or of its longest sentence where no paragraph of it is a near-duplicate (via: sentence).
    It is removed from all documents but the first.

    Word numbers count A-Z-lowered words split at ASCII white space, over the whole text. Null ids and texts are
    ignored; repeats within one document alone are no passage; rows with equal ids are one document, whose different
    texts each have word numbers and passages of their own and whose equal ones count once; an empty table gives an empty
    result; further columns are ignored.
    """
    spark = docs.sparkSession
    texts = texts_of(docs)
    found, drop_units = stored_for_now(units(texts), "kind")
    spread = F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
    place = "doc_id", "row", "start", "n", "short", "run", "whole", "cluster", "lo"
    sentences = found.where("kind = 's'").select("key", "doc_id", "row", "start", "n", "short")
    same = cut_lineage(sentences.groupBy("key").agg(*spread).where("lo < hi").select("key", "lo"))
    equal = cut_lineage(sentences.join(same, "key").withColumn("cluster", F.col("key")).withColumns({"run": F.lit(False), "whole": F.lit(False)}).select(*place))
    drop_units("kind=s")
    del same
    release(spark)
    paragraphs = found.where("kind = 'p'")
    classes, drop_classes = stored_for_now(paragraphs.groupBy("key").agg(*spread, F.first("bands").alias("bands"), F.min(F.struct("doc_id", "row", "start", "n")).alias("at")).select("key", "lo", "hi", "bands", "at.*"))
    links = paragraph_links(texts, classes)
    release(spark)
    comps = connected_components(links, "a", "b")
    placed = classes.select("key", "lo", "hi").join(comps, F.col("key") == F.col("node"), "left").select("key", "lo", "hi", F.coalesce("component", "key").alias("cluster"))
    shared = placed.groupBy("cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("cluster", "lo")
    # written out, so that the joins below stand between plain exchanges, whose hot keys Spark can split
    groups = cut_lineage(placed.select("key", "cluster").join(shared, "cluster").select("key", "cluster", "lo"))
    near = cut_lineage(paragraphs.select("key", "doc_id", "row", "start", "n", "short", F.col("short").alias("run"), F.lit(True).alias("whole")).join(groups, "key").select(*place))
    drop_units()
    drop_classes()
    return passages(near.union(equal))


def passages(repeated: DataFrame) -> DataFrame:
    """Repeated units joined to passages: islands within each text."""
    in_text = Window.partitionBy("doc_id", "row").orderBy("start", "n", "cluster")
    before = F.max(F.col("start") + F.col("n")).over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("start") > before + GAP)).cast("int")
    islands = repeated.withColumn("opens", opens).withColumn("island", F.sum("opens").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    words = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    joined = islands.groupBy("doc_id", "row", "island").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.max(F.struct("whole", "n", "cluster")).alias("most"), F.min("lo").alias("first_doc"),
        words(F.col("short") & ~F.col("run")).alias("in_short"), words(F.col("run")).alias("in_runs"),
    )
    joined = joined.withColumn("n_words", F.col("end") - F.col("start"))
    outside = F.col("n_words") - F.greatest("in_short", "in_runs")
    joined = joined.where((outside >= MIN_PASSAGE) | ((F.col("n_words") >= MIN_MIXED) & (outside >= MIN_LONG)) | (F.col("in_runs") >= MIN_MIXED))
    via = F.when(F.col("most.whole"), "paragraph").otherwise("sentence").alias("via")
    return joined.select("doc_id", "start", "end", "n_words", F.col("most.cluster").alias("cluster"), "first_doc", (F.col("first_doc") < F.col("doc_id")).alias("removed"), via)
