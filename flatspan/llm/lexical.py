"""Ranked lexical search: impact-sorted lists read by the NRA rule until the best documents and their scores are settled."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flatspan.llm.common import as_utf8, stored

#: Bytes of items that are asked together; more are asked in further passes over the index.
ASKED_BYTES = 8 << 20
#: Postings of a shard: documents whose lists are read together.
SHARD_POSTINGS = 2_000_000
#: Entries of each list that are read before bounds are first looked at; doubled from look to look.
FIRST_READ = 64

#: Lower-cases A-Z and makes a blank of every ASCII byte that is neither a letter nor a digit.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters, A-Z lower-cased."""
    return raw.translate(_FOLD).split() if raw else []


def impact(tf: np.ndarray, n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """What a posting adds for each unit of its term's weight, in whole numbers."""
    m = 100 - 50 + (50 * n * total_docs) // max(total_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(total_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1)))


@dataclass
class Shard:
    """Postings of some documents by term, each list by falling impact."""

    ids: np.ndarray  # doc ids, ascending, null ones last
    starts: np.ndarray  # where each term's list begins; one more for the end
    docs: np.ndarray
    impacts: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, terms: int, doc: np.ndarray, term: np.ndarray, impacts: np.ndarray) -> Shard:
        order = np.lexsort((doc, -impacts, term))
        return cls(ids, np.searchsorted(term[order], np.arange(terms + 1)), doc[order], impacts[order])


def nra(shard: Shard, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(places of documents, exact scores): the k best by score, smallest place first on ties, of those that reach ``floor``.

    All lists are read side by side from their strongest entries on. What a document has in the lists read so far is its
    lower bound; each list where it wasn't met can add what was read there last, which gives its upper bound. Reading
    ends when k documents are complete (nothing more can come) and no other, met or unmet, can reach the k-th score. A list that
    has ended adds nothing, so with all lists at their ends every bound is exact.
    """
    live = [(int(shard.starts[t]), int(shard.starts[t + 1]), int(w)) for t, w in zip(terms, weights, strict=True) if w > 0 and shard.starts[t + 1] > shard.starts[t]]
    none = np.zeros(0, dtype=np.int64)
    if not live:
        return none, none
    lists = [(shard.docs[a:b], shard.impacts[a:b] * w) for a, b, w in live]
    low = np.zeros(len(shard.ids), dtype=np.int64)
    met = np.zeros((len(lists), len(shard.ids)), dtype=bool)
    done, upto = 0, FIRST_READ
    while True:
        for docs, scores, seen in zip((x[0] for x in lists), (x[1] for x in lists), met, strict=True):
            d = docs[done:upto]  # a document stands in a list once
            low[d] += scores[done:upto]
            seen[d] = True
        more = np.array([int(scores[upto - 1]) if upto < len(scores) else 0 for _, scores in lists], dtype=np.int64)
        if not more.any():
            break
        reach = int(more.sum())
        found = np.flatnonzero(low > 0)
        kth = max(int(np.partition(low[found], len(found) - k)[len(found) - k]), floor) if len(found) >= k else floor
        if reach < kth:  # an unmet document stays below
            rivals = found[low[found] + reach >= kth]
            gap = more @ ~met[:, rivals]
            if not gap[low[rivals] + gap >= kth].any():
                break
        done, upto = upto, upto * 2
    found = np.flatnonzero(low >= floor)
    order = found[np.lexsort((found, -low[found]))[:k]]
    return order, low[order]


@dataclass(frozen=True)
class Asked:
    """A block of items: number, and the distinct terms that each asks for as numbers of the block's terms."""

    terms: dict[bytes, int]
    items: list[tuple[int, np.ndarray]]


def _asked(items: DataFrame) -> Iterator[Asked]:
    """Items in blocks of bounded bytes; they come to the driver one after another."""
    terms: dict[bytes, int] = {}
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for row in items.toLocalIterator():
        own = sorted(set(terms_of(row["raw"])))
        held.append((row["item"], np.array([terms.setdefault(t, len(terms)) for t in own], dtype=np.int64)))
        size += sum(map(len, own)) + 16
        if size > ASKED_BYTES:
            yield Asked(terms, held)
            terms, held, size = {}, [], 0
    if held:
        yield Asked(terms, held)


def index_terms(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """Postings of the given terms in all documents, a row for some documents that stand together, in the shared folder.

    Columns: ids, no_id (of all documents with a term), size (terms of each with repeats), doc, term, tf (postings). One pass over the texts,
    no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, postings = sent.value, [], 0
        for b in batches:
            for i, no_id, raw in zip(b["id"], b["no_id"], b["raw"], strict=True):
                own = terms_of(raw)
                if own:
                    tf = Counter(own)
                    got = [(number[t], n) for t, n in tf.items() if t in number] if len(tf) < len(number) else [(k, tf[t]) for t, k in number.items() if t in tf]
                    held.append((i, no_id, len(own), got))
                    postings += len(got) + 1
                    if postings >= SHARD_POSTINGS // 4:
                        yield _packed(held)
                        held, postings = [], 0
        if held:
            yield _packed(held)

    def _packed(held: list) -> pd.DataFrame:
        pack = lambda x, kind: zlib.compress(np.array(x, dtype=kind).tobytes(), 1)
        flat = [(d, t, n) for d, h in enumerate(held) for t, n in h[3]]
        doc, term, tf = zip(*flat, strict=True) if flat else ((), (), ())
        return pd.DataFrame([{
            "ids": pack([h[0] for h in held], "<i8"), "no_id": pack([h[1] for h in held], "?"), "size": pack([h[2] for h in held], "<i8"), "doc": pack(doc, "<i4"), "term": pack(term, "<i4"), "tf": pack(tf, "<i8"),
        }])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), as_utf8(F.coalesce("text", F.lit(""))).alias("raw"))
    return stored(rows.mapInPandas(post, "ids binary, no_id binary, size binary, doc binary, term binary, tf binary"))


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype=kind)


def statistics(index: DataFrame) -> tuple[int, int, dict[int, int]]:
    """(documents with a term, all their terms, documents by asked term); the driver gets a number for each asked term."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs = total = 0
        df = np.zeros(0, dtype=np.int64)
        for b in batches:
            for size, term in zip(b["size"], b["term"], strict=True):
                n, own = _unpack(size, "<i8"), np.bincount(_unpack(term, "<i4"), minlength=len(df))
                docs, total = docs + len(n), total + int(n.sum())
                own[: len(df)] += df
                df = own
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": [-2, -1, *at.tolist()], "n": [docs, total, *df[at].tolist()]})

    found = {r["term"]: r["n"] for r in index.select("size", "term").mapInPandas(tally, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
    return found.pop(-2, 0), found.pop(-1, 0), found


def best_of_shards(index: DataFrame, asked: Asked, k: int) -> DataFrame:
    """(item, doc_id, score): for every item the k best documents of each task's part of the index.

    A task joins rows of the index to shards of bounded size and searches one after another; the k-th score so far is what a
    further shard's documents must reach.
    """
    n_docs, n_terms, df = statistics(index)
    sent = index.sparkSession.sparkContext.broadcast((asked.items, np.array([weight(n_docs, df.get(t, 0)) for t in range(len(asked.terms))], dtype=np.int64)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, weights = sent.value
        best: dict[int, list[tuple[int, bool, int]]] = {}
        rows, held = (r for b in batches for r in b.itertuples(index=False)), []
        for r in rows:
            held.append([_unpack(r.ids, "<i8"), _unpack(r.no_id, "?"), _unpack(r.size, "<i8"), _unpack(r.doc, "<i4").astype(np.int64), _unpack(r.term, "<i4"), _unpack(r.tf, "<i8")])
            if sum(len(h[3]) + len(h[0]) for h in held) >= SHARD_POSTINGS:
                _search(held, items, weights, best)
                held = []
        if held:
            _search(held, items, weights, best)
        out = [(item, None if no_id else i, score) for item, found in best.items() for score, no_id, i in found]
        yield pd.DataFrame({"item": np.array([x[0] for x in out], dtype=np.int64), "doc_id": pd.array([x[1] for x in out], dtype="Int64"), "score": np.array([x[2] for x in out], dtype=np.int64)})

    def _search(held: list, items: list, weights: np.ndarray, best: dict) -> None:
        before = np.cumsum([0, *[len(h[0]) for h in held[:-1]]])
        ids, no_id, size, term, tf = (np.concatenate([h[c] for h in held]) for c in (0, 1, 2, 4, 5))
        doc = np.concatenate([h[3] + at for h, at in zip(held, before, strict=True)])
        order = np.lexsort((ids, no_id))  # places by ascending id, null ids last
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        shard = Shard.of(ids[order], len(weights), place[doc], term, impact(tf, size[doc], n_docs, n_terms))
        no_id = no_id[order]
        for item, terms in items:
            own = best.setdefault(item, [])
            at, scores = nra(shard, terms, weights[terms], k, own[-1][0] if len(own) == k else 1)
            own += zip(scores.tolist(), no_id[at].tolist(), shard.ids[at].tolist(), strict=True)
            own.sort(key=lambda x: (-x[0], x[1], x[2]))
            del own[k:]

    return index.mapInPandas(search, "item long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents by the integer score, ties by ascending doc_id.

    Postings of the items' terms are stored by blocks of documents, from one pass over whole texts. After corpus counts, every block
    is searched where it lies by the NRA rule, and what comes back is k rows an item and task, of which the k best stay. The
    items are a stated query set, in blocks of bounded bytes.

    Items or texts that are null or have no term meet nothing, and documents without a term don't count. Repeated rows are documents
    of their own. Items with equal ids and texts are one; those with one id and different texts are ranked each on its own (column
    ``item`` tells them apart). Null doc_ids come last among ties. An empty table gives no rows; further columns are ignored.
    """
    texts = stored(items.select("item_id", as_utf8(F.coalesce("text", F.lit(""))).alias("raw")).distinct().withColumn("item", F.monotonically_increasing_id()))
    found = []
    for asked in _asked(texts.select("item", "raw")):
        found.append(best_of_shards(index_terms(docs, asked.terms), asked, k))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long, item long")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    return best.join(texts.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score", "item")
