"""Embedding near-duplicates by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flatspan.llm.common import cut_lineage, local_roots, stored
from flatspan.llm.components import connected_components

THRESHOLD = 0.95
#: Bytes of a tile at most; a comparison holds two tiles. Smaller tables have about FEWEST tiles, so that tasks share the work.
TILE_BYTES, FEWEST = 16 << 20, 4
#: Leading coordinates whose boxes tell tiles apart.
LEAD = 8
#: Leading dimensions after which the bound is looked at again.
STEPS = (12, 24, 48)
MAX_DIMENSIONS = 4096
_SLACK = 1e-9


def unit(vector: Column) -> Column:
    """The direction in double precision; null for null, empty, zero, and vectors with null or non-finite components."""
    x = vector.cast("array<double>")
    big = F.array_max(F.transform(x, F.abs))
    over = F.when(big.between(1e-100, 1e100), F.lit(1.0)).otherwise(big)  # squares of other sizes would overflow or vanish
    # the divisors stand outside the lambdas, which would compute them again for each component
    scaled = F.zip_with(x, F.array_repeat(over, F.size(x)), lambda v, b: v / b)
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda a, v: a + v * v))
    sound = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (big > 0)
    return F.when(sound, F.zip_with(scaled, F.array_repeat(norm, F.size(x)), lambda v, n: v / n))


def _matrix(cells: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    lengths = cells.map(len).to_numpy()
    if (lengths == width).all():
        return np.concatenate(cells.to_list()).reshape(-1, width) if len(cells) else np.empty((0, width))
    out = np.zeros((len(cells), width))
    for i, c in enumerate(cells):
        out[i, : len(c)] = c
    return out


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Orthonormal axes by falling second moment, from sums over all classes; width squared sums reach the driver."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            x = _matrix(b["unit"], width)
            total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "v": total.ravel()})

    sums = np.zeros((width, width))
    for r in classes.select("unit").mapInPandas(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r["i"], r["j"]] = r["v"]
    values, axes = np.linalg.eigh((sums + sums.T) / 2)
    return axes[:, np.argsort(-values, kind="stable")]


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, axes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with a[i] . b[j] >= threshold; i < j where both are one tile. axes: what a and b are turned by for the bounds.

    The turn may change a product's last digits, so pairs within _SLACK of the threshold are decided on a and b themselves,
    summed in the order of components.

    Products grow over leading dimensions; after each step the rest is at most the product of the suffix norms
    (Cauchy-Schwarz), and pairs that can no longer reach the threshold are left. What remains is computed whole.
    """
    width, plain_a, plain_b = a.shape[1], a, b
    if axes is not None:
        a, b = a @ axes, b @ axes
    steps = [k for k in STEPS if k < width]
    left = lambda x, k: np.sqrt(np.clip(1 - (x[:, :k] ** 2).sum(axis=1), 0, None))
    rest_a, rest_b = {k: left(a, k) for k in steps}, {k: left(b, k) for k in steps}
    out_i, out_j = [], []
    for top in range(0, len(a), 512):
        rows = slice(top, min(top + 512, len(a)))
        if steps:
            k = steps[0]
            bound = a[rows, :k] @ b[:, :k].T
            got = np.nonzero(bound + np.outer(rest_a[k][rows], rest_b[k]) >= threshold - _SLACK)
            i, j = got[0] + top, got[1]
            if same:
                i, j = i[i < j], j[i < j]
            for piece in range(0, len(i), 200_000):  # bounded memory, however many remain
                pi, pj = i[piece : piece + 200_000], j[piece : piece + 200_000]
                dot, done = (a[pi, :k] * b[pj, :k]).sum(axis=1), k
                for k2 in steps[1:]:
                    dot = dot + (a[pi, done:k2] * b[pj, done:k2]).sum(axis=1)
                    may = dot + rest_a[k2][pi] * rest_b[k2][pj] >= threshold - _SLACK
                    pi, pj, dot, done = pi[may], pj[may], dot[may], k2
                near = (a[pi] * b[pj]).sum(axis=1) >= threshold - _SLACK
                out_i.append(pi[near])
                out_j.append(pj[near])
        else:
            i, j = np.nonzero(a[rows] @ b.T >= threshold - _SLACK)
            i = i + top
            out_i.append(i[i < j] if same else i)
            out_j.append(j[i < j] if same else j)
    i, j = np.concatenate(out_i or [np.empty(0, int)]), np.concatenate(out_j or [np.empty(0, int)])
    sure = np.ones(len(i), dtype=bool)
    for piece in range(0, len(i), 200_000):
        pi, pj = i[piece : piece + 200_000], j[piece : piece + 200_000]
        dot = np.zeros(len(pi))
        for c in range(width):
            dot += plain_a[pi, c] * plain_b[pj, c]
        sure[piece : piece + 200_000] = dot >= threshold
    return i[sure], j[sure]


def compare_tiles(group: pd.DataFrame, width: int, threshold: float, axes: np.ndarray | None = None) -> pd.DataFrame:
    """Links within one tile, or between two: for each linked class the members it gains, and its smallest partner by links here.

    The links themselves are not listed: a class gets one row a comparison, however many partners it has.
    """
    group = group.sort_values("node")
    x = np.frombuffer(b"".join(group["vec"]), dtype=np.float64).reshape(-1, width)
    tiles, dims = group["tile"].to_numpy(), group["dims"].to_numpy()
    node, size = group["node"].to_numpy(), group["size"].to_numpy()
    one, two = (np.flatnonzero(tiles == t) for t in (tiles.min(), tiles.max()))
    i, j = close_pairs(x[one], x[two], threshold, len(one) == len(tiles), axes)
    i, j = one[i], two[j]
    alike = dims[i] == dims[j]
    i, j = i[alike], j[alike]
    gain = np.bincount(i, weights=size[j], minlength=len(x)) + np.bincount(j, weights=size[i], minlength=len(x))
    root = local_roots(len(x), i, j)
    linked = np.flatnonzero(gain)
    return pd.DataFrame({"node": node[linked], "gain": gain[linked].astype(np.int64), "root": node[root[linked]]})


class Tree:
    """Cuts of space into cells by leading coordinates, level by level: cell c has the cells 2c and 2c + 1 below it."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # by cell: coordinate, and where it is cut

    def cells(self, lead: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(lead), dtype=np.int64)
        for axis, cut in self.levels:
            cell = 2 * cell + (lead[np.arange(len(lead)), axis[cell]] > cut[cell])
        return cell


def _cell_of(tree: Tree, lead: int):
    @F.pandas_udf("long")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(tree.cells(_matrix(x, lead)))

    return cell


def grow(turned: DataFrame, lead: int, rows: int) -> tuple[Tree, dict[int, tuple]]:
    """(tree, by cell: vectors, lowest and highest leading coordinates) with at most ``rows`` vectors a cell, where they differ.

    Each level halves the cells that are too large at the median of their widest coordinate; what the driver holds is a
    few numbers a cell.
    """
    tree = Tree()
    while True:
        by = turned.select("lead", _cell_of(tree, lead)("lead").alias("cell")).groupBy("cell")
        numbers = lambda f: F.array(*[f(F.col("lead")[d]) for d in range(lead)])
        found = {r["cell"]: r for r in by.agg(F.count(F.lit(1)).alias("n"), numbers(F.min).alias("low"), numbers(F.max).alias("high"), numbers(lambda c: F.percentile_approx(c, 0.5, 1000)).alias("mid")).collect()}
        large = [r for r in found.values() if r["n"] > rows and max(np.subtract(r["high"], r["low"])) > 0]
        if not large or len(tree.levels) == 40:
            return tree, {c: (r["n"], r["low"], r["high"]) for c, r in found.items()}
        axis, cut = np.zeros(1 << len(tree.levels), dtype=np.int64), np.full(1 << len(tree.levels), np.inf)
        for r in large:
            d = int(np.argmax(np.subtract(r["high"], r["low"])))
            axis[r["cell"]], cut[r["cell"]] = d, r["mid"][d] if r["mid"][d] < r["high"][d] else (r["low"][d] + r["high"][d]) / 2
        tree.levels.append((axis, cut))


def tile_plan(cells: dict[int, tuple], rows: int, reach: float) -> tuple[dict[int, tuple[int, int]], list[np.ndarray]]:
    """(by cell: its first tile and number of tiles, by tile: the tiles it meets).

    A cell of equal leading coordinates may be too large; it gets several tiles. Tiles meet where their boxes of leading
    coordinates are within reach of each other: others hold no close pair.
    """
    tiles, low, high = {}, [], []
    for cell in sorted(cells):
        n, a, b = cells[cell]
        many = -(-n // rows)
        tiles[cell] = len(low), many
        low += [a] * many
        high += [b] * many
    lo, hi = np.array(low), np.array(high)
    apart = lambda t: (np.maximum(np.maximum(lo - hi[t], lo[t] - hi), 0) ** 2).sum(axis=1)
    return tiles, [np.flatnonzero(apart(t) <= reach**2 + _SLACK) for t in range(len(lo))]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors linked where their cosine is at least ``threshold``.

    Compared are classes of equal directions, so copies never meet as pairs: each vector's links are its class's
    other members and the members of all linked classes. Every close pair of classes is found: tiles of vectors, cut
    by leading principal coordinates, are compared pair by pair, but for tiles whose boxes are further apart than close
    vectors can be, and within a comparison the bound on suffix norms stops a product early. tile: vectors of a tile.

    Null, empty or zero vectors and those with null or non-finite components link with nothing, and vectors of
    different lengths do not link. Rows without a vec_id link as others do but name no component. Repeated rows
    count as other vectors. An empty table gives an empty result; further columns are ignored.
    """
    rows = vectors.select("vec_id", unit(F.col("embedding")).alias("unit"))
    classes = rows.where(F.col("unit").isNotNull()).groupBy("unit").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first"))
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
    width = classes.agg(F.max(F.size("unit"))).first()[0] or 1
    if width > MAX_DIMENSIONS:
        raise ValueError(f"more than {MAX_DIMENSIONS} dimensions")
    axes = principal_axes(classes, width)

    lead, sent = min(LEAD, width), vectors.sparkSession.sparkContext.broadcast(axes)  # width squared numbers, bounded by MAX_DIMENSIONS

    def rotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["unit"], width)
            yield pd.DataFrame({"node": b["node"], "size": b["size"], "dims": b["unit"].map(len).astype(np.int32), "lead": list(x @ sent.value[:, :lead]), "vec": [v.tobytes() for v in x]})

    turned = stored(classes.select("node", "size", "unit").mapInPandas(rotate, "node long, size long, dims int, lead array<double>, vec binary"))
    rows_of = tile or max(min(-(-turned.count() // FEWEST), TILE_BYTES // (8 * width)), 1)
    tree, cells = grow(turned, lead, rows_of)
    tiles, partners = tile_plan(cells, rows_of, float(np.sqrt(2 - 2 * threshold)))
    first = np.array([tiles[c][0] if c in tiles else 0 for c in range(1 << len(tree.levels))])
    many = np.array([tiles[c][1] if c in tiles else 1 for c in range(1 << len(tree.levels))])
    plan = vectors.sparkSession.sparkContext.broadcast((tree, first, many, partners))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, first, many, partners = plan.value
        for b in batches:
            cell = tree.cells(_matrix(b["lead"], lead))
            at = first[cell] + b["node"].to_numpy() % many[cell]
            meets = [(np.minimum(partners[t], t) * len(partners) + np.maximum(partners[t], t)).tolist() for t in at]
            yield b[["node", "size", "dims", "vec"]].assign(tile=at.astype(np.int64), pairs=meets)

    dealt = turned.mapInPandas(deal, "node long, size long, dims int, vec binary, tile long, pairs array<long>")
    met = dealt.select("node", "size", "dims", "vec", "tile", F.explode("pairs").alias("pair"))
    found = met.groupBy("pair").applyInPandas(lambda g: compare_tiles(g, width, threshold, sent.value), "node long, gain long, root long")
    found = cut_lineage(found)
    comps = connected_components(found, "node", "root")
    gains = found.groupBy("node").agg(F.sum("gain").alias("gain"))
    known = classes.join(gains, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    info = known.join(lowest, "component").select(F.col("unit").alias("of"), (F.col("size") - 1 + F.coalesce("gain", F.lit(0))).alias("links"), "component_id")
    return rows.join(info, F.col("unit") == F.col("of"), "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id")), F.lit(False)).alias("kept"),
    )
