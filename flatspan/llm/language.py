"""Language identification by rank-order n-gram profiles and their out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flatspan.llm.common import fold

#: n-grams kept of a language and of a document.
PROFILE = 300
#: First-step groups of the top n-grams of a language.
SALTS = 16
MAX_LANGUAGES = 1000
FOLDS = 5
_PAD = 1  # stands for any run of characters that are no letters; a letter is its code point plus 1


@cache
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> np.ndarray:
    """All 1-, 2- and 3-grams of a text's padded, lower-cased words as integers (21 bits a character)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = np.full(len(codes) + 2, _PAD, dtype=np.int64)
    s[1:-1] = np.where(_letters()[codes], codes.astype(np.int64) + 1, _PAD)
    s = s[np.concatenate(([True], (s[1:] != _PAD) | (s[:-1] != _PAD)))]  # one pad between words
    if len(s) < 3:
        return np.empty(0, dtype=np.int64)
    pairs = (s[:-1] << 21) | s[1:]
    triples = (s[:-2] << 42) | pairs[1:]
    return np.concatenate((s[s != _PAD], pairs, triples[s[1:-1] != _PAD]))


def ranked(g: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; the smaller integer goes first on ties."""
    kinds, n = np.unique(g, return_counts=True)
    if len(kinds) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        kinds, n = kinds[n >= least], n[n >= least]
    return kinds[np.lexsort((kinds, -n))][:most]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    kinds, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return kinds, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts by language, merged in the task as far as memory allows."""
    held: dict[str, list] = {}
    for b in batches:
        for lang, texts in b.groupby("lang")["text"]:
            parts, chunk, size = held.setdefault(lang, []), [], 0
            for t in [*texts, None]:
                if t is not None:
                    chunk.append(grams(t))
                    size += len(chunk[-1])
                if chunk and (t is None or size > 1_000_000):
                    parts.append(np.unique(np.concatenate(chunk), return_counts=True))
                    chunk, size = [], 0
            if sum(len(k) for k, _ in parts) > 1_000_000:
                held[lang] = parts = [_merge(parts)]
                if len(parts[0][0]) > 500_000:
                    yield pd.DataFrame({"lang": lang, "gram": parts[0][0], "n": parts[0][1]})
                    held[lang] = []
    for lang, parts in held.items():
        if parts:
            kinds, n = _merge(parts)
            yield pd.DataFrame({"lang": lang, "gram": kinds, "n": n})


class Profiles:
    """Learned languages (in code-point order) and, for every n-gram of any profile, its rank in those that hold it.

    The ranks of n-gram kinds[k] are at first[k] to first[k + 1] of ``lang`` and ``rank``: PROFILE entries a language.
    """

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        number = {lang: i for i, lang in enumerate(self.langs)}
        entries = sorted((g, number[lang], rank) for lang, g, rank in rows)
        gram, self.lang, self.rank = (np.array([e[k] for e in entries], dtype=np.int64) for k in range(3))
        self.kinds, starts = np.unique(gram, return_index=True)
        self.first = np.append(starts, len(gram))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (first on ties) and 1 less its share of the largest possible distance."""
        own = ranked(grams(text)) if text and self.langs else np.empty(0, dtype=np.int64)
        if not len(own):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.kinds, own), len(self.kinds) - 1)
        place = np.flatnonzero(self.kinds[at] == own)
        at = at[place]
        n = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # an n-gram that a profile lacks is PROFILE places off; one that it holds is nearer by the difference
        nearer = np.bincount(self.lang[entry], weights=PROFILE - np.abs(self.rank[entry] - np.repeat(place, n)), minlength=len(self.langs))
        best = int(nearer.argmax())
        return self.langs[best], float(nearer[best] / (PROFILE * len(own)))


def learn(docs: DataFrame) -> Profiles:
    """Profiles of all languages from all rows with a text, a language and a fold other than 0.

    Counts are summed in each task before the shuffle; top n-grams are found within salted groups, then in their
    union. The driver gets PROFILE rows a language and at most MAX_LANGUAGES languages.
    """
    train = docs.where((fold(F.col("doc_id"), FOLDS) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = train.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), "gram"]
    some = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).orderBy(*order))).where(F.col("rank") <= PROFILE)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).where(F.col("rank") < PROFILE)
    rows = [(r["lang"], r["gram"], r["rank"]) for r in top.select("lang", "gram", "rank").limit(PROFILE * MAX_LANGUAGES + 1).collect()]
    if len(rows) > PROFILE * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Profiles(rows)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text; only the text is used for a prediction.

    A null text, one without a letter, or no learned language: ``und`` with score 0. Rows with a null id are held
    out. Repeated rows each get a row; an empty table gives an empty result; further columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    # Python sees the texts alone, so ids keep every digit whatever nulls stand beside them
    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.predict(t) for t in text], columns=["lang_pred", "score"])

    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), predict("text").alias("said"))
    return rows.select("doc_id", "held_out", "said.lang_pred", "said.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows in which no language is found (``und``), in one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sent.value.predict(t)[0] != "und").astype(bool)

    return docs.where(known("text"))
