"""Rows against all rows, in packed blocks: what one task holds is a part of either side, whose size is bounded, whatever the size of the table."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flatspan.runtime import cut_lineage

#: Rows of a block, and rows of the left block that are compared at once.
BLOCK, PIECE = 4096, 256
#: Parts that either side of a comparison is dealt into, and bytes of a part above which there are more.
SIDE, TILE_BYTES = 8, 64 << 20


def packed(df: DataFrame, column: str, dtype: str = "f8", rows: int = BLOCK) -> DataFrame:
    """(block, ids, x): rows that stand together, as arrays of bytes (``unpacked``). As many blocks as the rows ask for, whatever df's partitions.

    Doubles that are all numbers of single precision take half the room, and come back the same.
    """
    apart = max(1, math.ceil(df.count() / rows))
    df = df.select("id", column).repartition(apart)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        block = TaskContext.get().partitionId()
        for b in batches:
            while len(b):
                room = rows - sum(len(h) for h in held)
                held.append(b.iloc[:room])
                b = b.iloc[room:]
                if sum(len(h) for h in held) == rows:
                    yield _one(pd.concat(held), block)
                    held, block = [], block + apart
        if held:
            yield _one(pd.concat(held), block)

    def _one(b: pd.DataFrame, block: int) -> pd.DataFrame:
        x = np.array(b[column].to_list(), dtype=dtype)
        return pd.DataFrame({"ids": [b["id"].to_numpy(dtype=np.int64).tobytes()], "x": [_bytes(x)], "block": [block]})

    return cut_lineage(df.mapInPandas(pack, "ids binary, x binary, block long"))


def _bytes(x: np.ndarray) -> bytes:
    if x.dtype == np.float64:
        with np.errstate(over="ignore", under="ignore"):
            few = x.astype("f4")
        if (few == x).all():
            return few.tobytes() + b"\0"  # the odd byte tells
    return x.tobytes()


def unpacked(ids: bytes, x: bytes, dtype: str = "f8") -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows) of a packed block."""
    few = len(x) % 4 == 1
    rows = np.frombuffer(x, dtype="f4", count=len(x) // 4).astype("f8") if few else np.frombuffer(x, dtype=dtype)
    return np.frombuffer(ids, dtype=np.int64), rows.reshape(len(ids) // 8, -1)


class HeldPoints:
    """All points as they come into a task, as packed blocks: by id in memory up to ``held`` bytes, and in a nameless file of its own beyond.

    ``last`` is a number that stands behind each point, if any.
    """

    def __init__(self, width: int, held: int, last: float | None = None):
        self.width, self.held, self.size, self.last = width + (last is not None), held, 0, last
        self.parts: list[tuple[np.ndarray, np.ndarray | None]] = []
        self.file = None

    def add(self, ids: bytes, x: bytes) -> None:
        own, rows = unpacked(ids, x)
        if self.last is not None:
            rows = np.column_stack([rows, np.full(len(rows), self.last)])
        self.size += rows.nbytes
        if self.file is None and self.size > self.held:
            self.file = tempfile.TemporaryFile()
            for _, b in self.parts:
                self.file.write(b.tobytes())
            self.parts = [(i, None) for i, _ in self.parts]
        if self.file is not None:
            self.file.write(rows.tobytes())
        self.parts.append((own, rows if self.file is None else None))

    def close(self) -> None:
        self.ids = np.concatenate([i for i, _ in self.parts])
        order = np.argsort(self.ids, kind="stable")
        self.ids = self.ids[order]
        if self.file is None:
            self.x = np.concatenate([b for _, b in self.parts])[order]
        else:
            came, self.file = self._mapped(), tempfile.TemporaryFile()
            for s in range(0, len(order), BLOCK):
                self.file.write(came[order[s : s + BLOCK]].tobytes())
            self.x = self._mapped()
        self.parts = []

    def _mapped(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, dtype="f8", mode="r", shape=(len(self.ids), self.width))

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for s in range(0, len(self.x), BLOCK):
            yield s, np.asarray(self.x[s : s + BLOCK])


def tiles(blocks: int, size: int) -> int:
    """Parts of one side of a comparison: SIDE, but more where a part would be above TILE_BYTES, and no more than blocks."""
    return max(1, min(blocks, max(SIDE, math.ceil(size / TILE_BYTES))))


def against(left: DataFrame, right: DataFrame, compare: Callable, schema: str, dtype: str = "f8", meet: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """compare(ids, x, other ids, other x) of every block of left with every block of right, all results together.

    Blocks of each side are dealt evenly into a few parts, and every part of the left meets every part of the right in a task of
    its own. So a block travels SIDE times however many blocks there are, until parts of TILE_BYTES need more. ``meet`` joins
    what one left block found in all of a part's right blocks.
    """
    sized = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("x")), F.lit(0))).first()
    rows, columns = tiles(*sized(left)), tiles(*sized(right))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lefts = left.select((F.col("block") % rows).alias("row"), each(columns).alias("column"), F.lit(True).alias("own"), "ids", "x")
    rights = right.select((F.col("block") % columns).alias("column"), each(rows).alias("row"), F.lit(False).alias("own"), "ids", "x").select(*lefts.columns)
    dealt = lefts.union(rights).select((F.col("row") * columns + F.col("column")).cast("int").alias("tile"), "own", "ids", "x").repartitionById(rows * columns, "tile")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bool, list] = {True: [], False: []}
        for b in batches:
            for own, ids, x in zip(b["own"], b["ids"], b["x"], strict=True):
                held[bool(own)].append(unpacked(ids, x, dtype))
        for own in held[True]:
            found = (compare(*own, *other) for other in held[False])
            if meet is None:
                yield from found
            elif held[False]:
                yield meet(pd.concat(list(found)))

    return dealt.mapInPandas(run, schema)


def _strongest_one(ids: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """_strongest for k = 1: found in single precision where the next one lies further below than its error, else in double precision."""
    size = np.sqrt((x * x).sum(axis=1))
    most = np.sqrt((y * y).sum(axis=1)).max(initial=0.0)
    if not (0 < most < np.inf and len(y) > 1):
        return _strongest(ids, x, other, y, 1, False)
    order = np.argsort(other, kind="stable")
    other, y = other[order], y[order]
    few, error, held = (y / most).astype("f4").T, (x.shape[1] + 8) * 2.0**-22, np.empty((min(PIECE, len(x)), len(y)), dtype="f4")
    first, last = np.searchsorted(other, ids), np.searchsorted(other, ids, side="right")
    best, sure = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    for top in range(0, len(x), PIECE):
        own = slice(top, top + PIECE)
        unit = (x[own] / np.where(size[own] > 0, size[own], 1)[:, None]).astype("f4")
        near = np.matmul(unit, few, out=held[: len(unit)])
        np.abs(near, out=near)
        for i in np.flatnonzero(first[own] < last[own]).tolist():
            near[i, first[top + i] : last[top + i]] = -1
        row, j = np.arange(len(near)), near.argmax(axis=1)
        strongest = near[row, j]
        near[row, j] = -1
        best[own], sure[own] = j, strongest - near.max(axis=1) > error
    found = pd.DataFrame({"id": ids[sure], "other": other[best[sure]], "score": np.abs(np.einsum("ij,ij->i", x[sure], y[best[sure]]))})
    return found if sure.all() else pd.concat([found, _strongest(ids[~sure], x[~sure], other, y, 1, False)])


def _strongest(ids: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray, k: int, fast: bool = True) -> pd.DataFrame:
    if k == 1 and fast:
        return _strongest_one(ids, x, other, y)
    out, order = [], np.argsort(other, kind="stable")
    other, y = other[order], y[order]
    place = np.searchsorted(other, ids)
    itself = np.flatnonzero((place < len(other)) & (other[np.minimum(place, len(other) - 1)] == ids))
    last = np.searchsorted(other, ids, side="right")
    for top in range(0, len(x), PIECE):
        score = np.abs(x[top : top + PIECE] @ y.T)
        own = ids[top : top + PIECE]
        for i in itself[(itself >= top) & (itself < top + PIECE)].tolist():
            score[i - top, place[i] : last[i]] = -1
        if k == 1:  # the first of the largest has the lowest id
            j = score.argmax(axis=1)
            best = score[np.arange(len(score)), j]
            keep = best >= 0
            out.append(pd.DataFrame({"id": own[keep], "other": other[j[keep]], "score": best[keep]}))
            continue
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1] if k < score.shape[1] else np.full(len(score), -1.0)
        i, j = np.nonzero((score >= least[:, None]) & (score >= 0))
        order = np.lexsort((other[j], -score[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, i)  # where the row's own entries begin
        keep = np.arange(len(i)) - first < k
        out.append(pd.DataFrame({"id": own[i[keep]], "other": other[j[keep]], "score": score[i[keep], j[keep]]}))
    return pd.concat(out)


def _first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k largest scores of each id, the smallest other on ties."""
    i, other, score = (found[c].to_numpy() for c in ("id", "other", "score"))
    order = np.lexsort((other, -score, i))
    i = i[order]
    keep = order[np.arange(len(i)) - np.searchsorted(i, i) < k]
    return pd.DataFrame({"id": found["id"].to_numpy()[keep], "other": other[keep], "score": score[keep]})


def top_partners(queries: DataFrame, atoms: DataFrame, k: int) -> DataFrame:
    """(id, rank, other, score): for each query row (id, features) the k other atoms with the largest |inner product|, smallest id on ties.

    atoms: packed. Every pair of parts gives k rows a query, and those meet by query.
    """
    found = against(packed(queries, "features"), atoms, lambda i, x, j, y: _strongest(i, x, j, y, k), "id long, other long, score double", meet=lambda f: _first(f, k))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other")))
    return ranked.where(F.col("rank") <= k).select("id", F.col("rank").cast("int").alias("rank"), "other", "score")
