"""K-subspaces clustering and its ensemble form."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flatspan.frame import check_broadcast, width_of
from flatspan.functions.kernels import orthonormal, residuals, top_eigenvectors
from flatspan.functions.vectors import dot, literal_vector
from flatspan.operators.agreement import COLUMNS, coassociation_vectors
from flatspan.operators.kmeans import kmeans_labels
from flatspan.operators.pairing import HeldPoints, against, packed
from flatspan.operators.spectral import STARTS, spectral_labels, unit_rows
from flatspan.params import EnsembleParams, KSubspacesParams
from flatspan.runtime import cut_lineage

#: Steps after which the alternation stops with a warning where no limit is given.
SAFETY_CAP = 1000


def residual_columns(x: Column, bases: np.ndarray) -> list[Column]:
    """Distance to each subspace as a column expression; for few and small subspaces."""
    inside = [sum((dot(x, literal_vector(u[:, j])) ** 2 for j in range(u.shape[1])), F.lit(0.0)) for u in bases]
    return [F.sqrt(F.greatest(dot(x, x) - v, F.lit(0.0))) for v in inside]


def _stack(b: pd.DataFrame) -> np.ndarray:
    return np.vstack(b["features"].to_list()) if len(b) else np.empty((0, 0))


def assign(df: DataFrame, bases: np.ndarray) -> DataFrame:
    """(id, cluster, residual): the nearest subspace, the lowest number on ties. One narrow pass."""
    sent = df.sparkSession.sparkContext.broadcast(bases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                r = residuals(_stack(b), sent.value)
                yield pd.DataFrame({"id": b["id"], "cluster": r.argmin(axis=1).astype(np.int32), "residual": r.min(axis=1)})

    return df.select("id", "features").mapInPandas(run, "id long, cluster int, residual double")


def scatter(df: DataFrame) -> DataFrame:
    """(cluster, i, j, value): upper triangles of the sums of x x', for columns cluster and features.

    Each task sums its own rows first, so a task sends at most one row a cluster and cell.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x, c = _stack(b), b["cluster"].to_numpy()
            for k in np.unique(c):
                own = x[c == k]
                sums[k] = sums.get(k, 0) + own.T @ own
        for k, s in sums.items():
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({"cluster": np.int32(k), "i": i.astype(np.int32), "j": j.astype(np.int32), "value": s[i, j]})

    return df.select("cluster", "features").mapInPandas(run, "cluster int, i int, j int, value double").groupBy("cluster", "i", "j").agg(F.sum("value").alias("value"))


#: Entries of a row that a trim drops at most where they are kept as a table beside the labels.
FEW = 64
#: Rows up to which the table of all pairs is the quicker way.
SMALL = 4096
#: Task sums of a cluster's scatter meet in so many groups before they meet in one.
SALTS = 32
#: Parts of an ensemble's runs, each of which reads all vectors; steps after which a run's sums begin anew.
RUN_PARTS, FRESH = 24, 16
#: Bytes of scatter matrices (of vectors, where all stay in one task) that a task holds, and that travel in one row.
HELD_BYTES, ROW_BYTES = 64 << 20, 512 << 10


def portions(runs: list[int], k: int, width: int) -> list[tuple[list[int], range]]:
    """(runs, clusters) whose scatter matrices fit in a task together: some runs whole, or a part of one run's clusters."""
    room = max(1, HELD_BYTES // (8 * width * width))
    if k <= room:
        each = room // k
        return [(runs[i : i + each], range(k)) for i in range(0, len(runs), each)]
    return [([r], range(c, min(c + room, k))) for r in runs for c in range(0, k, room)]


def dealt(df: DataFrame, most: int | None = None) -> DataFrame:
    """df in parts that many passes can share out: 512 rows or more, up to 24 of them, then 8,192 rows each. A file of vectors is often one part.

    ``most`` bounds the parts where each sends much.
    """
    n = df.count()
    parts = max(1, -(-n // 8192), min(24, -(-n // 512)))
    return df.repartition(min(parts, most or parts))


def step(df: DataFrame, bases: dict[int, np.ndarray], before: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, int], dict[int, float]]:
    """One alternation of several runs: (next bases, labels that differ from those of ``before``, sum of squared residuals).

    Each task sums the scatter of its own rows by run and cluster and sends the matrices packed, a few clusters a row; sums
    meet by salted groups, then by those clusters, where the eigenproblems are solved. Only bases reach the driver.
    What a task holds is bounded: runs and clusters are dealt into portions, which read the vectors one beside the other.
    """
    sent = df.sparkSession.sparkContext.broadcast((bases, before))
    some = next(iter(bases.values()))
    k, width, dim = some.shape
    together = max(1, ROW_BYTES // (8 * width * width))
    columns = ["run", "cluster", "salt", "sum", "changed", "cost"]

    def sums(runs: list[int], clusters: range) -> Callable[[Iterator], Iterator]:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            new, old = sent.value
            total: dict[tuple[int, int], np.ndarray] = {}
            changed, cost = dict.fromkeys(runs, 0), dict.fromkeys(runs, 0.0)
            for b in batches:
                x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) if len(b) else np.empty((0, width))
                for r in runs if len(b) else ():
                    res = residuals(x, new[r])
                    label = res.argmin(axis=1)
                    if clusters.start == 0:  # a run's first portion counts for all of it
                        cost[r] += float((res.min(axis=1) ** 2).sum())
                        changed[r] += int((label != residuals(x, old[r]).argmin(axis=1)).sum()) if r in old else len(x)
                    for c in np.unique(label[(label >= clusters.start) & (label < clusters.stop)]).tolist():
                        own = x[label == c]
                        total[r, c] = total.get((r, c), 0) + own.T @ own
            salt = TaskContext.get().partitionId() % SALTS  # the same when a lost task runs again
            none = np.zeros((width, width))
            for r in runs:
                for c in range(clusters.start, clusters.stop, together):
                    own = range(c, min(c + together, clusters.stop))
                    first = c == 0
                    if first or any((r, i) in total for i in own):
                        packed_sum = np.stack([total.pop((r, i), none) for i in own]).tobytes()
                        row = (r, c, salt, packed_sum, changed[r] if first else 0, cost[r] if first else 0.0)
                        yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.float64()), strict=True)], names=columns)

        return run

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s) for s in g["sum"])
        return pd.DataFrame({"run": [g["run"].iloc[0]], "cluster": [g["cluster"].iloc[0]], "sum": [total.tobytes()], "changed": [g["changed"].sum()], "cost": [g["cost"].sum()]})

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        m = meet(g)
        scatters = np.frombuffer(m["sum"].iloc[0]).reshape(-1, width, width)
        return m.assign(sum=[np.stack([top_eigenvectors(s, dim) for s in scatters]).tobytes()])

    x = df.select("features")
    each = [x.mapInArrow(sums(*p), "run int, cluster int, salt int, sum binary, changed long, cost double") for p in portions(list(bases), k, width)]
    out = "run int, cluster int, sum binary, changed long, cost double"
    rows = reduce(DataFrame.union, each).groupBy("run", "cluster", "salt").applyInPandas(meet, out)
    groups = len(bases) * -(-k // together)
    rows = rows.repartition(min(24, groups), "run", "cluster").groupBy("run", "cluster").applyInPandas(solve, out)  # by number: small rows, but each is an eigenproblem
    found = {r: np.stack([np.eye(width)[:, :dim]] * k) for r in bases}  # an empty cluster's zero scatter has these
    changed, cost = dict.fromkeys(bases, 0), dict.fromkeys(bases, 0.0)
    for r in rows.collect():
        own = np.frombuffer(r["sum"]).reshape(-1, width, dim)
        found[r["run"]][r["cluster"] : r["cluster"] + len(own)] = own
        changed[r["run"]] += r["changed"]
        cost[r["run"]] += r["cost"]
    return found, changed, cost


@dataclass
class KSubspacesModel:
    params: KSubspacesParams
    bases: np.ndarray
    iterations: int = 0
    objective: tuple[float, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        """(id, cluster)."""
        return assign(df, self.bases).select("id", "cluster")

    def distance(self, df: DataFrame, queries: Column | str | None = None) -> DataFrame:
        return label_distance(self.transform(df), queries)

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.params.to_json(), list(self.bases.shape), self.bases.ravel().tolist())], "params string, shape array<int>, bases array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> KSubspacesModel:
        r = spark.read.parquet(path).first()
        return KSubspacesModel(KSubspacesParams.from_json(r["params"]), np.array(r["bases"]).reshape(r["shape"]))


def label_distance(labels: DataFrame, queries: Column | str | None = None) -> DataFrame:
    """(i, j, value): 0 where labels agree, 1 where they differ, for the stated query rows i against all rows j.

    The query rows are broadcast (their number is checked); all rows are read once, and nothing is shuffled.
    """
    asked = labels.where(queries) if queries is not None else labels
    n = asked.count()
    check_broadcast(n, 2, "label distance queries")
    rows = asked.select("id", "cluster").toPandas()
    sent = labels.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), rows["cluster"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, clusters = sent.value
        for b in batches:
            for j, c in zip(b["id"], b["cluster"], strict=True):
                yield pd.DataFrame({"i": ids, "j": j, "value": (clusters != c).astype(float)})

    return labels.select("id", "cluster").mapInPandas(run, "i long, j long, value double")


class KSubspaces:
    """Alternates nearest-subspace assignment and per-cluster leading eigenvectors (uncentred)."""

    def __init__(self, init: np.ndarray | None = None, **params):
        self.params, self.init = KSubspacesParams(**params), init

    def fit(self, df: DataFrame, iterations: int | None = None) -> KSubspacesModel:
        """Until no label changes, or for so many steps. df: (id, features).

        A step is one pass over the vectors: labels and the partial scatter sums are made together, and only packed
        sums by cluster are shuffled. The labels of two steps are compared without storing either: the previous
        bases give the previous labels again in the same pass.
        """
        if iterations is not None and iterations < 1:
            raise ValueError("iterations must be 1 or more")
        p, width = self.params, width_of(df)
        if p.dim_subspaces > width:
            raise ValueError("dim_subspaces is above the number of features")
        rng = np.random.RandomState(p.random_seed)
        bases = self.init if self.init is not None else np.stack([orthonormal(rng, width, p.dim_subspaces) for _ in range(p.n_clusters)])
        df, objective, done, before = dealt(df).persist(), [], 0, {}
        try:
            while True:
                new, changed, cost = step(df, {0: bases}, before)
                if before:
                    objective.append(cost[0])
                if (before and not changed[0]) or done == (iterations or SAFETY_CAP):
                    break
                before, bases = {0: bases}, new[0]
                done += 1
            if changed[0] and iterations is None:
                warnings.warn(f"labels still changed after {SAFETY_CAP} steps", stacklevel=2)
        finally:
            df.unpersist()
        return KSubspacesModel(p, bases, done, tuple(objective))


def _alternated(points: HeldPoints, bases: np.ndarray, iterations: int) -> np.ndarray:
    """A run's bases when its labels stay, or after so many steps.

    Vectors that change their cluster are taken from one sum and added to another; sums begin anew where many vectors change, where a cluster
    has few, and every FRESH steps, as rounding adds up.
    """
    k, width, dim = bases.shape
    label, sums = np.full(len(points.ids), -1, dtype=np.int32), np.zeros((k, width, width))
    for done in range(iterations + 1):
        before, label = label, np.concatenate([residuals(x, bases).argmin(axis=1).astype(np.int32) for _, x in points.blocks()])
        moved = label != before
        if not moved.any() or done == iterations:
            break
        touched, rows = np.union1d(before[moved], label[moved]), np.bincount(label, minlength=k)
        anew = np.ones(k, dtype=bool) if done % FRESH == 0 or 2 * moved.sum() > len(label) else np.isin(np.arange(k), touched) & (rows < width)
        touched = np.flatnonzero(np.isin(np.arange(k), touched) | anew)
        sums[anew] = 0
        for s, x in points.blocks():
            own, was, gone = label[s : s + len(x)], before[s : s + len(x)], moved[s : s + len(x)]
            for c in touched.tolist():
                add = x[own == c] if anew[c] else x[gone & (own == c)]
                sums[c] += add.T @ add
                if not anew[c]:
                    less = x[gone & (was == c)]
                    sums[c] -= less.T @ less
        bases = bases.copy()
        bases[touched] = np.stack([top_eigenvectors(sums[c], dim) for c in touched.tolist()])
    return bases


def _runs_in_tasks(df: DataFrame, starts: list[np.ndarray], iterations: int) -> list[np.ndarray]:
    """Every run's last bases: runs are dealt into a few parts, and each part's task reads all vectors once."""
    parts, size, held = min(RUN_PARTS, len(starts)), starts[0].shape, HELD_BYTES
    points = packed(df, "features").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "ids", "x").repartitionById(parts, "part")
    sent = df.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, part = HeldPoints(size[1], held), None
        for b in batches:
            for own, ids, x in zip(b["part"], b["ids"], b["x"], strict=True):
                part = int(own)
                points.add(ids, x)
        if part is not None:
            points.close()
            for r in range(part, len(sent.value), parts):
                yield pd.DataFrame({"run": [r], "bases": [_alternated(points, sent.value[r], iterations).tobytes()]})

    found = {r["run"]: np.frombuffer(r["bases"]).reshape(size) for r in points.mapInPandas(run, "run int, bases binary").collect()}
    return [found[r] for r in range(len(starts))]


def _runs_by_steps(df: DataFrame, starts: list[np.ndarray], iterations: int) -> list[np.ndarray]:
    """The same where a run's sums are too many for a task: all runs take each step in the same pass, and a run leaves when its labels stay."""
    bases, live, before = dict(enumerate(starts)), set(range(len(starts))), {}
    for k in range(iterations + 1):
        new, changed, _ = step(df, {r: bases[r] for r in live}, before)
        live = {r for r in live if changed[r]}
        if not live or k == iterations:
            break
        before = {r: bases[r] for r in live}
        bases |= {r: new[r] for r in live}
    return [bases[r] for r in range(len(starts))]


def base_labels(df: DataFrame, params: EnsembleParams, iterations: int = 100) -> DataFrame:
    """(id, labels): each row's label in every base clustering, by number.

    Runs are dealt into a few parts. All vectors stream once into each part's task (memory up to HELD_BYTES, a nameless file beyond), and its runs take all
    their steps there, until their labels stay as they are: no sums travel from step to step, unless a run's are above HELD_BYTES. Every run has its own seed, drawn in order from the
    ensemble's. What the driver and a task hold is runs x clusters bases.
    """
    width = width_of(df)
    seeds = np.random.RandomState(params.random_seed).randint(0, 2**32 - 1, params.n_base, dtype=np.uint32).tolist()
    starts = []
    for seed in seeds:
        rng = np.random.RandomState(seed)
        starts.append(np.stack([orthonormal(rng, width, params.dim_subspaces) for _ in range(params.n_clusters)]))
    df = df.select("id", "features")
    together = 8 * params.n_clusters * width * width <= HELD_BYTES  # a run's sums fit in a task
    found = _runs_in_tasks(df, starts, iterations) if together else None
    df = dealt(df, 12).persist()
    try:
        found = found or _runs_by_steps(df, starts, iterations)
        sent = df.sparkSession.sparkContext.broadcast(found)

        def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = _stack(b)
                    yield pd.DataFrame({"id": b["id"], "labels": list(np.stack([residuals(x, own).argmin(axis=1) for own in sent.value], axis=1).astype(np.int32))})

        return cut_lineage(df.mapInPandas(label, "id long, labels array<int>"))
    finally:
        df.unpersist()


def gather_labels(labels: DataFrame) -> DataFrame:
    """(id, labels) from (run, id, cluster), in the order of the runs."""
    return labels.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "cluster"))), lambda s: s["cluster"]).alias("labels"))


def coassociation(gathered: DataFrame, queries: Column | str | None = None, most: int | None = None, high_ids_first: bool = False) -> DataFrame:
    """(i, j, value): the share of base clusterings in which i and j agree, where it isn't 0; 1 for i = j.

    Rows i (all, or a stated query set) are compared with all rows in packed blocks of labels. For all rows the result is
    the whole affinity: as many entries as pairs that ever agree. With ``most`` each block of others sends a row's
    largest entries only, so many (ties by j), which hold the row's largest among all: no table of pairs comes about.
    """

    def compare(ids: np.ndarray, own: np.ndarray, others: np.ndarray, theirs: np.ndarray) -> pd.DataFrame:
        out = []
        order = np.argsort(-others if high_ids_first else others)
        others, theirs = others[order], theirs[order]
        for i, labels in zip(ids, own, strict=True):
            share = (theirs == labels).mean(axis=1)
            share[others == i] = 1.0
            at = np.flatnonzero(share)
            if most is not None and len(at) > most:
                at = at[np.argsort(-share[at], kind="stable")[:most]]
            out.append(pd.DataFrame({"i": i, "j": others[at], "value": share[at]}))
        return pd.concat(out)

    asked = gathered.where(queries) if queries is not None else gathered
    return against(packed(asked, "labels", "i4", 1024), packed(gathered, "labels", "i4", 1024), compare, "i long, j long, value double", "i4")


def trimmed_coassociation(gathered: DataFrame, n: int, thresh: int, mode: str = "drop_smallest") -> DataFrame:
    """``trim`` of the co-association of all n rows, of which only entries that a row can keep are ever made rows."""
    if thresh < 0:
        return coassociation(gathered)
    top = mode == "keep_top"
    return trim(coassociation(gathered, most=thresh if top else n - thresh, high_ids_first=not top), n, thresh, mode)


def _agreements(own: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """In how many base clusterings each row of own agrees with each of theirs."""
    out = np.zeros((len(own), len(theirs)), dtype=np.int16)
    for a, b in zip(own.T, theirs.T, strict=True):
        out += a[:, None] == b
    return out


def patterns(gathered: DataFrame) -> DataFrame:
    """(pattern, labels, rows): the different rows of labels, each known by its smallest id. Equal labels have equal rows of co-association."""
    return cut_lineage(gathered.groupBy("labels").agg(F.min("id").alias("pattern"), F.count(F.lit(1)).alias("rows")))


def smallest(asked: DataFrame, gathered: DataFrame, thresh: int) -> DataFrame:
    """(i, j, agree): for each row of asked (id, labels) its thresh smallest entries of the co-association, zeros included, ties by j, as counts.

    Of rows with equal labels only the thresh smallest ids can be among them, so no more are compared.
    """
    place = F.row_number().over(Window.partitionBy("labels").orderBy("id"))
    others = gathered.withColumn("place", place).where(F.col("place") <= thresh).select("id", "labels")

    def least(found: pd.DataFrame) -> pd.DataFrame:
        i, j, agree = (found[c].to_numpy() for c in ("i", "j", "agree"))
        order = np.lexsort((j, agree, i))
        i = i[order]
        order = order[np.arange(len(i)) - np.searchsorted(i, i) < thresh]
        return pd.DataFrame({"i": found["i"].to_numpy()[order], "j": j[order], "agree": agree[order]})

    def compare(ids: np.ndarray, own: np.ndarray, others: np.ndarray, theirs: np.ndarray) -> pd.DataFrame:
        order = np.argsort(others)
        others, agree, m = others[order], _agreements(own, theirs[order]), min(thresh, len(others))
        key = agree.astype(np.int64) * len(others) + np.arange(len(others))  # by agreements, then by j
        at = np.partition(key, m - 1, axis=1)[:, :m] % len(others)
        return pd.DataFrame({"i": np.repeat(ids, m), "j": others[at.ravel()], "agree": np.take_along_axis(agree, at, axis=1).ravel().astype(np.int32)})

    found = against(packed(asked, "labels", "i4", 1024), packed(others, "labels", "i4", 1024), compare, "i long, j long, agree int", "i4", least)
    rank = F.row_number().over(Window.partitionBy("i").orderBy("agree", "j"))
    return found.withColumn("rank", rank).where(F.col("rank") <= thresh).select("i", "j", "agree")


def trimmed_rows(gathered: DataFrame, thresh: int, queries: Column | str | None = None) -> DataFrame:
    """``trim_rows`` of the co-association's rows of a query set: entries (i, j, value) behind the thresh smallest.

    What a row keeps lies behind one entry, the last of its smallest: that is found first by patterns of labels, travels with the
    row's labels, and each comparison of blocks keeps what is behind it. Nothing is sorted by row.
    """
    asked = gathered.where(queries) if queries is not None else gathered
    own = patterns(asked)
    cut = smallest(own.select(F.col("pattern").alias("id"), "labels"), gathered, thresh) if thresh > 0 else None
    limit = F.array(F.lit(-1), F.lit(-1)).cast("array<long>")
    if cut is not None:
        last = cut.groupBy(F.col("i").alias("pattern")).agg(F.max(F.struct("agree", "j")).alias("last"))
        known = own.join(last, "pattern", "left").select("labels", F.array(F.col("last.agree").cast("long"), F.col("last.j")).alias("limit"))
        asked, limit = cut_lineage(asked.join(known, "labels").select("id", "labels", "limit")), F.coalesce("limit", limit)

    def compare(ids: np.ndarray, own: np.ndarray, others: np.ndarray, theirs: np.ndarray) -> pd.DataFrame:
        out, runs = [], theirs.shape[1]
        for s in range(0, len(ids), 64):
            least, last = own[s : s + 64, runs, None], own[s : s + 64, runs + 1, None]
            agree = _agreements(own[s : s + 64, :runs], theirs)
            i, j = np.nonzero((agree > 0) & ((agree > least) | ((agree == least) & (others > last))))
            out.append(pd.DataFrame({"i": ids[s : s + 64][i], "j": others[j], "value": agree[i, j] / runs}))
        return pd.concat(out)

    left = asked.select("id", F.concat(F.col("labels").cast("array<long>"), limit).alias("labels"))
    right = gathered.select("id", F.col("labels").cast("array<long>").alias("labels"))
    return against(packed(left, "labels", "i8", 1024), packed(right, "labels", "i8", 1024), compare, "i long, j long, value double", "i8")


def trimmed_degrees(gathered: DataFrame, thresh: int) -> DataFrame:
    """(id, degree, n): sum and number of entries of each row of the trimmed co-association (``trim``, smallest dropped), without its pairs.

    Rows with equal labels have equal entries and drop the same ones. With S the co-association and D(p) what a pattern p drops, row i sums
    all of S[i, j] twice, less what it drops and what the rows that drop i had there; an entry is gone where both drop it.
    """
    own = patterns(gathered)
    runs = own.select(F.size("labels").alias("runs")).first()["runs"]

    def meet(ids: np.ndarray, mine: np.ndarray, others: np.ndarray, theirs: np.ndarray) -> pd.DataFrame:
        agree, rows = _agreements(mine[:, :-1], theirs[:, :-1]), theirs[:, -1]
        return pd.DataFrame({"pattern": ids, "total": agree.astype(np.int64) @ rows, "held": (agree > 0) @ rows})

    weighed = packed(own.select(F.col("pattern").alias("id"), F.concat(F.col("labels").cast("array<long>"), F.array("rows")).alias("labels")), "labels", "i8", 1024)
    sums = against(weighed, weighed, meet, "pattern long, total long, held long", "i8").groupBy("pattern").agg(F.sum("total").alias("total"), F.sum("held").alias("held"))
    member = gathered.join(own, "labels").select("id", "pattern")
    found = smallest(own.select(F.col("pattern").alias("id"), "labels"), gathered, thresh) if thresh > 0 else own.select(F.col("pattern").alias("i"), F.col("pattern").alias("j"), F.lit(0).alias("agree")).limit(0)
    gone = cut_lineage(found.where("agree > 0").withColumnRenamed("i", "p").join(member.select(F.col("id").alias("j"), F.col("pattern").alias("q")), "j"))
    dropped = gone.groupBy(F.col("p").alias("pattern")).agg(F.sum("agree").alias("dropped"))
    cells = gone.groupBy(F.col("p").alias("q"), F.col("q").alias("p")).agg(F.count(F.lit(1)).alias("back"))
    lost = gone.join(own.select(F.col("pattern").alias("p"), "rows"), "p").join(cells, ["p", "q"], "left")
    lost = lost.groupBy(F.col("j").alias("id")).agg(F.sum(F.col("agree") * F.col("rows")).alias("lost"), F.sum(F.coalesce("back", F.lit(0))).alias("both"))
    rows = member.join(sums, "pattern").join(dropped, "pattern", "left").join(lost, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = rows.select("id", ((2 * F.col("total") - zero("dropped") - zero("lost")) / (2 * runs)).alias("degree"), (F.col("held") - zero("both")).alias("n"))
    return out.where("n > 0")


def trimmed_off(gathered: DataFrame, thresh: int) -> DataFrame:
    """(i, j, value): what ``trim`` (smallest dropped) takes from the co-association, so a few entries a row."""
    own = patterns(gathered)
    found = smallest(own.select(F.col("pattern").alias("id"), "labels"), gathered, thresh).where("agree > 0").withColumnRenamed("i", "pattern")
    runs = F.size("labels")
    d = gathered.join(own, "labels").select(F.col("id").alias("i"), "pattern", runs.alias("runs")).join(found, "pattern").select("i", "j", (F.col("agree") / (2 * F.col("runs"))).alias("value"))
    return cut_lineage(d.union(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")).groupBy("i", "j").agg(F.sum("value").alias("value")))


def trim_rows(affinity: DataFrame, n: int, thresh: int, mode: str = "drop_smallest") -> DataFrame:
    """Per row i, zero the thresh smallest entries (ties by j); absent entries are zeros and go first.

    mode ``keep_top`` keeps the thresh largest instead.
    """
    per_row = Window.partitionBy("i")
    if mode == "keep_top":
        return affinity.withColumn("rank", F.row_number().over(per_row.orderBy(F.desc("value"), "j"))).where(F.col("rank") <= thresh).drop("rank")
    ranked = affinity.withColumn("rank", F.row_number().over(per_row.orderBy("value", "j"))).withColumn("held", F.count(F.lit(1)).over(per_row))
    return ranked.where(F.col("rank") + (F.lit(n) - F.col("held")) > thresh).select("i", "j", "value")


def trim(affinity: DataFrame, n: int, thresh: int, mode: str = "drop_smallest") -> DataFrame:
    """Rows and columns trimmed and averaged: (R + R') / 2 for a symmetric affinity."""
    if thresh < 0:
        return affinity
    r = trim_rows(affinity, n, thresh, mode)
    both = r.union(r.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return both.groupBy("i", "j").agg((F.sum("value") / 2).alias("value"))


class EnsembleKSubspaces:
    """Co-association of many base clusterings, trimmed and cut spectrally."""

    def __init__(self, **params):
        self.params = EnsembleParams(**params)

    def affinity(self, df: DataFrame) -> DataFrame:
        """(i, j, value), large where similar."""
        p = self.params
        gathered = base_labels(df, p).persist()
        n = gathered.count()
        if p.thresh > n:
            raise ValueError("thresh is above the number of rows")
        return trimmed_coassociation(gathered, n, p.thresh, p.trim)

    def transform(self, df: DataFrame) -> DataFrame:
        """(id, cluster)."""
        p = self.params
        if p.n_base * p.n_clusters > COLUMNS or p.trim != "drop_smallest" or p.thresh > FEW or df.count() <= SMALL:
            return spectral_labels(self.affinity(df), df.select("id"), p.n_clusters, p.random_seed)
        gathered = base_labels(df, p)
        if p.thresh > gathered.count():
            raise ValueError("thresh is above the number of rows")
        less = trimmed_off(gathered, p.thresh) if p.thresh > 0 else None
        less = less if less is not None and less.limit(1).count() else None
        v, _ = coassociation_vectors(gathered, p.n_base, p.n_clusters, less, p.n_clusters)
        return kmeans_labels(unit_rows(v), p.n_clusters, p.random_seed, 200, STARTS)


def model_summary(model: KSubspacesModel) -> str:
    return json.dumps({"iterations": model.iterations, "objective": list(model.objective)})
