"""Toxicity by non-negative positive-unlabelled learning of a linear classifier in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flatspan.llm.common import as_utf8, cut_lineage, fold, stored, words_of

FOLDS = 5
#: Confirmed toxic texts, at most, in which features are looked for. Their shares, the classifier and its boundary use all rows.
MAX_POSITIVE = 4_000
#: Features in fewer of those texts are none.
MIN_TEXTS = 5
LIFT = 3
#: Lengths, in bytes, of the beginnings of words that are features too (inflected words share a beginning).
PREFIXES = (4, 6, 8)
#: Shares of a text's words with a beginning that are told apart; the first: any at all.
RATES = (0.0, 0.004, 0.01)
STEPS, RATE, DECAY = 80, 0.15, 1e-4
#: The boundary is looked for among so many steps of the score.
BINS = 4096
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CHUNK = 300_000


def features(raw: bytes | None) -> np.ndarray:
    """Sorted distinct features of a whole text: its words without punctuation at their edges, and the beginnings of
    its words by their share of all words."""
    digest, words = xxhash.xxh64_intdigest, words_of(raw)
    begun: dict[bytes, int] = {}
    found = set()
    for word in words:
        w = word.strip(_EDGE)
        found.add(digest(w))
        for k in PREFIXES:
            if len(w) > k:
                begun[w[:k]] = begun.get(w[:k], 0) + 1
    found |= {digest(b, k + 1) for b, n in begun.items() for k, rate in enumerate(RATES) if n >= rate * len(words)}
    return np.sort(np.array(list(found), dtype=np.uint64))


class Finder:
    """Which of some features (sorted hashes) stand in texts; each word is looked up once and remembered up to a bound."""

    def __init__(self, kinds: np.ndarray, bound: int = 400_000):
        self.kinds, self.bound = kinds, bound
        self.index = {int(k): i for i, k in enumerate(kinds)}
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.own = np.full(1 << 14, -1, dtype=np.int32)
        self.begins = np.full((1 << 14, len(PREFIXES)), -1, dtype=np.int32)
        self.used = 1  # number 0: a word without any feature
        self.slots: dict[bytes, int] = {}  # beginnings with features, by number; others: -1
        self.levels = np.full((1024, len(RATES)), -1, dtype=np.int32)
        self.many = 0

    def _learn(self, word: bytes) -> int:
        w, digest, get = word.strip(_EDGE), xxhash.xxh64_intdigest, self.index.get
        own, slots = get(digest(w), -1), []
        for k in PREFIXES:
            slot = -1
            if len(w) > k:
                slot = self.slots.get(w[:k], -2)
                if slot == -2:
                    levels = [get(digest(w[:k], j + 1), -1) for j in range(len(RATES))]
                    slot = self.slots[w[:k]] = self.many if max(levels) >= 0 else -1
                    if slot >= 0:
                        if slot == len(self.levels):
                            self.levels = np.concatenate((self.levels, np.full_like(self.levels, -1)))
                        self.levels[slot] = levels
                        self.many += 1
            slots.append(slot)
        if own < 0 and max(slots) < 0:
            return 0
        if self.used == len(self.own):
            self.own, self.begins = (np.concatenate((x, np.full_like(x, -1))) for x in (self.own, self.begins))
        self.own[self.used], self.begins[self.used] = own, slots
        self.used += 1
        return self.used - 1

    def __call__(self, raws: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of texts, text, feature): the features of the next texts, a bounded number of words at a time."""
        held, total = [], 0
        for k in range(len(raws) + 1):
            if k < len(raws):
                words = words_of(raws[k])
                if max(len(self.number), len(self.slots)) > self.bound:
                    if held:
                        yield self._features(held)
                        held, total = [], 0
                    self._clear()
                for w in set(words).difference(self.number):
                    self.number[w] = self._learn(w)
                held.append((len(words), np.fromiter(filter(None, map(self.number.__getitem__, words)), dtype=np.int64)))
                total += len(words)
            if held and (k == len(raws) or total > _CHUNK):
                yield self._features(held)
                held, total = [], 0

    def _features(self, held: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        word = np.concatenate([w for _, w in held])
        text = np.repeat(np.arange(len(held)), [len(w) for _, w in held])
        size = np.array([n for n, _ in held])
        width, slots = max(len(self.kinds), 1), max(self.many, 1)
        own = self.own[word]
        keys = [(text * width + own)[own >= 0]]
        begins = self.begins[word]
        at, _ = np.nonzero(begins >= 0)
        pairs, n = np.unique(text[at] * slots + begins[begins >= 0], return_counts=True)
        of, slot = pairs // slots, pairs % slots
        for k, rate in enumerate(RATES):
            level = self.levels[slot, k]
            keys.append((of * width + level)[(level >= 0) & (n >= rate * size[of])])
        found = np.unique(np.concatenate(keys))
        return len(held), found // width, found % width


def telling(inside: np.ndarray, positives: int, everywhere: np.ndarray, texts: int) -> np.ndarray:
    """Which features' share in positive texts is LIFT times that in all texts, beyond chance.

    The bound for the z scores of m features is sqrt(2 ln m), which noise alone hardly exceeds, whatever the
    number of texts; so small tables give few features and large ones more.
    """
    p, u = inside / positives, everywhere / texts
    share = (inside + everywhere) / (positives + texts)
    z = (p - u) / np.sqrt(share * (1 - share) * (1 / positives + 1 / texts) + 1e-12)
    return (p >= LIFT * u) & (z >= np.sqrt(2 * np.log(len(inside) + 1)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def sums(texts: np.ndarray, at: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over texts with features at (text number, feature) that count n times each: the sum of log(1 + exp(f)), of n, and
    the gradient of the first; after it the gradient of the sum of f. w: weights, then the bias."""
    z = np.bincount(texts, weights=w[at], minlength=len(n)) + w[-1]
    s = _sigmoid(z) * n
    back = lambda g: np.append(np.bincount(at, weights=g[texts], minlength=len(w) - 1), g.sum())
    return np.concatenate(([(np.logaddexp(0, z) * n).sum(), n.sum()], back(s), back(n)))


def gradient(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Step direction of the non-negative PU risk with the logistic loss, and its negative part, from both sides' sums.

    Risk: prior * E+[l(f)] + max(0, Eu[l(-f)] - prior * E+[l(-f)]). Where the second term is negative, the step goes
    up that term instead, so that the classifier does not fit unlabelled positives away.
    """
    width = (len(positive) - 2) // 2
    (lp, n_p), (lu, n_u) = positive[:2], unlabelled[:2]
    gp, ones, gu = positive[2 : 2 + width] / n_p, positive[2 + width :] / n_p, unlabelled[2 : 2 + width] / n_u
    part = lu / n_u - prior * lp / n_p
    g = gu - prior * gp
    if part < 0:
        return -g, part
    return g + prior * (gp - ones), part  # l(f) = log(1 + exp(f)) - f


class Model:
    """Feature hashes, their weights and the bias; without features and bias there was nothing to learn from."""

    def __init__(self, kinds: np.ndarray, weights: np.ndarray, learned: bool):
        self.kinds, self.weights, self.learned = kinds, weights, learned

    def score(self, patterns: pd.Series) -> np.ndarray:
        z = np.array([self.weights[np.asarray(p, dtype=np.int64)].sum() for p in patterns], dtype=float) + self.weights[-1]
        return _sigmoid(z) if self.learned else np.zeros(len(patterns))


def _no_model() -> Model:
    return Model(np.empty(0, dtype=np.uint64), np.zeros(1), False)


def row_key() -> Column:
    return F.xxhash64("doc_id", "text", F.lit(10))


def toxic_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) once an id, outside fold 0."""
    inside = (fold(F.col("doc_id"), FOLDS) != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()
    return labels.where(inside).groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("toxic"))


def candidates(docs: DataFrame, toxic: DataFrame, max_positive: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(features, texts that hold them, texts): counted over a seeded sample of at most max_positive confirmed toxic texts.

    Ids and keys alone are joined; repeated rows count once. What reaches the driver is bounded with the sample.
    """
    train = docs.where((fold(F.col("doc_id"), FOLDS) != 0) & F.col("doc_id").isNotNull())
    keys = train.select("doc_id", row_key().alias("row_key")).join(toxic, "doc_id", "left_semi").select("row_key").distinct()
    picked = cut_lineage(keys.orderBy("row_key").limit(max_positive))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [features(t) for t in b["raw"]]
            kinds, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
            yield pd.DataFrame({"kind": kinds.view(np.int64), "n": n})

    sample = train.select(row_key().alias("row_key"), as_utf8(F.col("text")).alias("raw")).join(F.broadcast(picked), "row_key").dropDuplicates(["row_key"])
    rows = sample.select("raw").mapInPandas(count, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TEXTS).collect()
    kinds = np.array([r["kind"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(kinds)
    return kinds[order], np.array([r["n"] for r in rows], dtype=np.int64)[order], picked.count()


def count_everywhere(docs: DataFrame, kinds: np.ndarray) -> tuple[np.ndarray, int]:
    """(texts that hold each of some features, texts) over all rows outside fold 0."""
    sent = docs.sparkSession.sparkContext.broadcast(kinds)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder, total, texts = Finder(sent.value), np.zeros(len(sent.value), dtype=np.int64), 0
        for b in batches:
            for n, _, at in finder(list(b["raw"])):
                total += np.bincount(at, minlength=len(total))
                texts += n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": np.append(at, -1), "n": np.append(total[at], texts)})

    train = docs.where(fold(F.col("doc_id"), FOLDS) != 0).select(as_utf8(F.col("text")).alias("raw"))
    out, texts = np.zeros(len(kinds), dtype=np.int64), 0
    for r in train.mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row a candidate
        if r["at"] < 0:
            texts = r["n"]
        else:
            out[r["at"]] = r["n"]
    return out, texts


def patterns_of(docs: DataFrame, kinds: np.ndarray) -> DataFrame:
    """(doc_id, held_out, pattern): which features of the model stand in each whole text, by number."""
    sent = docs.sparkSession.sparkContext.broadcast(kinds)

    # Python sees the texts alone, so ids keep every digit whatever nulls stand beside them
    @F.pandas_udf("array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(sent.value)
        for raw in batches:
            out: list[np.ndarray] = []
            for n, text, at in finder(list(raw)):
                out += np.split(at.astype(np.int32), np.searchsorted(text, np.arange(1, n)))
            yield pd.Series(out, dtype=object)

    return docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), find(as_utf8(F.col("text"))).alias("pattern"))


def fit(positive: DataFrame, unlabelled: DataFrame, width: int, prior: float) -> np.ndarray:
    """Weights and bias that minimise the non-negative PU risk over all rows, by Adam; a step is one pass over distinct patterns.

    positive, unlabelled: (pattern, n). Each task returns its sums of a few times ``width`` numbers.
    """

    def both(side: int, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(side).alias("side"), "pattern", F.col("n").cast("double").alias("n"))

    rows = cut_lineage(both(0, positive).union(both(1, unlabelled)).coalesce(32))
    sc = rows.sparkSession.sparkContext
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        sent = sc.broadcast(w)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, 2 + 2 * len(sent.value)))
            for b in batches:
                for side, own in b.groupby("side"):
                    sizes = own["pattern"].map(len).to_numpy()
                    at = np.concatenate([np.asarray(p, dtype=np.int64) for p in own["pattern"]] or [np.empty(0, dtype=np.int64)])
                    total[side] += sums(np.repeat(np.arange(len(own)), sizes), at, own["n"].to_numpy(), sent.value)
            yield pd.DataFrame({"total": [total.tobytes()]})

        total = sum(np.frombuffer(r["total"]).reshape(2, -1) for r in rows.mapInPandas(run, "total binary").collect())
        sent.unpersist()
        g, _ = gradient(total[0], total[1], prior)
        g = g + DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-5)
    return np.round(w, 6)  # the order of sums leaves no trace


def boundary(z: np.ndarray, n: np.ndarray, prior: float, slack: float) -> float:
    """The widest gap among the scores z (ascending, n rows each) above which a share near the class prior lies, as its middle."""
    upto = np.cumsum(n)
    lo, hi = (np.searchsorted(upto, upto[-1] * (1 - prior * k)) for k in (1 + slack, 1 - slack))
    gaps = np.diff(z[lo : min(hi, len(z) - 1) + 2])
    if not len(gaps):
        return 0.0
    k = int(lo) + int(gaps.argmax())
    return float((z[k] + z[k + 1]) / 2)


def learn(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE) -> tuple[Model, DataFrame]:
    """(classifier, patterns of all documents) from confirmed toxic texts and unlabelled ones, none of them of fold 0.

    Features are looked for in a bounded sample of confirmed toxic texts; their shares come from all rows outside
    fold 0, the classifier is fitted to all confirmed toxic and all unlabelled rows, and its boundary lies in the widest gap
    of all their scores near the class prior: the share of toxic among all labelled ids outside fold 0. Without any
    confirmed toxic text, or any telling feature, every score is 0.
    """
    marked = cut_lineage(toxic_ids(labels))
    n, toxic = marked.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    kinds, inside, positives = candidates(docs, marked.where("toxic = 1"), max_positive) if toxic else (np.empty(0, dtype=np.uint64), np.empty(0), 0)
    if len(kinds):
        everywhere, texts = count_everywhere(docs, kinds)
        kinds = kinds[telling(inside, positives, everywhere, texts)]
    if not len(kinds):
        return _no_model(), patterns_of(docs, kinds)
    patterns = stored(patterns_of(docs, kinds))
    train = patterns.where(~F.col("held_out"))
    prior = min(max(toxic / n, 0.001), 0.5)
    counted = lambda rows: rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    unlabelled = cut_lineage(counted(train))
    w = fit(counted(train.join(marked.where("toxic = 1"), "doc_id", "left_semi")), unlabelled, len(kinds), prior)
    model = Model(kinds, w, True)
    low, high = w[:-1][w[:-1] < 0].sum() + w[-1], w[:-1][w[:-1] > 0].sum() + w[-1]
    step = max(high - low, 1e-9) / BINS

    @F.pandas_udf("int")
    def binned(pattern: pd.Series) -> pd.Series:
        p = model.score(pattern)
        return pd.Series(np.floor((np.log(p) - np.log1p(-p) - low) / step).astype(np.int32))

    bins = sorted((r["bin"], r["n"]) for r in unlabelled.groupBy(binned("pattern").alias("bin")).agg(F.sum("n").alias("n")).collect())  # BINS rows
    z, many = np.array([b for b, _ in bins]) * step + low, np.array([k for _, k in bins])
    # two standard errors of the prior
    slack = min(0.5, 2 * np.sqrt((1 - prior) / prior / n))
    w[-1] -= boundary(z + step / 2, many, prior, slack)
    return model, patterns


def score_toxicity(patterns: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, from its pattern of features alone.

    A null or wordless text is scored by the classifier's bias alone. Rows with a null id are held out;
    repeated rows each get a row; an empty table gives an empty result; further columns are ignored.
    """
    sent = patterns.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(pattern: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(pattern))

    return patterns.select("doc_id", "held_out", score("pattern").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
