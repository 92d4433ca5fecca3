"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded selection."""

from __future__ import annotations

import math
from collections import deque
from fractions import Fraction
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flatspan.llm.common import WORD, cut_lineage, small_or_whole

#: Cost of a word's first, second and third repetition: convex, so that repeats spread before they pile up.
REPEAT_COSTS = (0, 1, 3)
SEED = "mix-1"
#: Sources, and sources of each pattern, that the flow on the driver takes; more are an error. 150,000 of them take some 10 seconds.
MAX_CELLS = 200_000
#: Bits of the seeded order, and those that each of two narrowing steps looks at.
ORDER_BITS, LEVEL_BITS = 60, 12
FILL_ROUNDS = 4
#: Copies that one row stands for until they are selected.
RUN = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def named(source: Column) -> Column:
    """A source's name for grouping and joining: never null, in code-point order with null last."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def seeded_order(doc_id: Column, text_key: Column, copy: Column) -> Column:
    """The place of a document's copy in the seeded order, 0 to 2**60 - 1."""
    parts = F.coalesce(doc_id.cast("string"), F.lit("")), text_key.cast("string"), F.when(copy > 0, copy.cast("string"))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts).cast("binary")), 1, ORDER_BITS // 4), 16, 10).cast("long")


def fill_targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: int = 3) -> dict[str | None, float]:
    """Shares of the sum of sizes by weight; none above ``most`` times its size, the excess reshared by weight."""
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (Fraction(most * sizes[s]) / Fraction(weights[s]), s is None, s or ""))
    left, weight, out = total, sum(weights.values()), {}
    for k, s in enumerate(order):
        if Fraction(most * sizes[s]) * Fraction(weight) >= Fraction(left) * Fraction(weights[s]):
            return out | {r: left / weight * weights[r] for r in order[k:]}
        out[s] = float(most * sizes[s])
        left, weight = left - most * sizes[s], weight - weights[s]
    return out


def min_cost_flow(patterns: list[dict], quotas: dict, costs: tuple[int, ...] = REPEAT_COSTS) -> list[dict]:
    """For each pattern {source: words that it has there}, the words that each of its sources takes: {source: words}.

    The graph is origin -> pattern (an arc a repetition, all of the pattern's words at that repetition's cost) ->
    source (as many repetitions of its own words) -> sink (the quota). The costs are convex, so a pattern's arcs fill
    in their order. Potentials come from Dijkstra; all that fits along the cheapest paths is then sent at once, by
    blocking flows over arcs of no reduced cost, so there are few rounds: one for each length of a cheapest path.
    """
    sources = list(quotas)
    n_p, number = len(patterns), {s: i for i, s in enumerate(sources)}
    origin, sink = n_p + len(sources), n_p + len(sources) + 1
    to, cap, cost, at = [], [], [], [[] for _ in range(sink + 1)]

    def arc(u: int, v: int, capacity: int, price: int) -> None:
        for x, y, c, p in ((u, v, capacity, price), (v, u, 0, -price)):
            at[x].append(len(to))
            to.append(y), cap.append(c), cost.append(p)

    for i, words in enumerate(patterns):
        for price in costs:
            arc(origin, i, sum(words.values()), price)
        for s in sorted(words):
            arc(i, n_p + number[s], len(costs) * words[s], 0)
    for s in sources:
        arc(n_p + number[s], sink, quotas[s], 0)
    potential = [0] * (sink + 1)
    while True:
        far, heap = {origin: 0}, [(0, origin)]
        while heap:
            d, u = heappop(heap)
            if d > far[u]:
                continue
            for e in at[u]:
                if cap[e] > 0 and (x := d + cost[e] + potential[u] - potential[to[e]]) < far.get(to[e], 1 << 60):
                    far[to[e]] = x
                    heappush(heap, (x, to[e]))
        if sink not in far:
            break
        for v in range(sink + 1):
            potential[v] += min(far.get(v, far[sink]), far[sink])
        while _blocking_flow(origin, sink, to, cap, at, lambda u, e: cost[e] + potential[u] - potential[to[e]] == 0):
            pass
    return [{sources[to[e] - n_p]: cap[e ^ 1] for e in at[i] if not e & 1 and cap[e ^ 1]} for i in range(n_p)]


def _blocking_flow(origin: int, sink: int, to: list[int], cap: list[int], at: list[list[int]], usable) -> bool:
    """Send flow along shortest usable paths until each has a full arc; False where there is no path."""
    level, queue = {origin: 0}, deque([origin])
    while queue:
        u = queue.popleft()
        for e in at[u]:
            if cap[e] > 0 and to[e] not in level and usable(u, e):
                level[to[e]] = level[u] + 1
                queue.append(to[e])
    if sink not in level:
        return False
    turn, path, u = {v: 0 for v in level}, [], origin
    while True:
        if u == sink:
            room = min(cap[e] for e in path)
            for e in path:
                cap[e] -= room
                cap[e ^ 1] += room
            path, u = [], origin
        while turn[u] < len(at[u]):
            e = at[u][turn[u]]
            if cap[e] > 0 and level.get(to[e], -1) == level[u] + 1 and usable(u, e):
                break
            turn[u] += 1
        if turn[u] < len(at[u]):
            path.append(at[u][turn[u]])
            u = to[path[-1]]
        elif u == origin:
            return True
        else:  # nothing leads on from here
            e = path.pop()
            u = to[e ^ 1]
            turn[u] += 1


def measured(docs: DataFrame) -> DataFrame:
    """Kinds of rows: doc_id, source, size and text_key with their count ``copies``; counted in each task first."""
    text = F.col("text")
    return docs.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(text).alias("text_key")).groupBy("doc_id", "source", "size", "text_key").agg(F.count(F.lit(1)).alias("copies"))


def shared_texts(kinds: DataFrame) -> DataFrame:
    """(text_key, pattern): texts that stand in several sources, by the names of those."""
    sets = kinds.where("size > 0").groupBy("text_key").agg(F.sort_array(F.collect_set(named(F.col("source")))).alias("pattern"))
    return cut_lineage(sets.where(F.size("pattern") > 1))


def cells_of(records: DataFrame) -> list[tuple]:
    """(cell, pattern, source, words) rows for the flow; more than MAX_CELLS are an error, raised before they are gathered."""
    words = F.sum(F.col("size") * F.col("copies")).alias("words")
    rows = records.groupBy("cell", "pattern", named(F.col("source")).alias("source")).agg(words).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} sources and sources of patterns; merge sources (those of one domain, say) before mixing")
    return [tuple(r) for r in rows]


def cell_key() -> Column:
    """Key of a pattern's part in one source; columns pattern (null: the source alone) and source."""
    return F.xxhash64(F.coalesce(F.array_join("pattern", "\x00"), F.lit("")), named(F.col("source")))


def plan_mix(cells: list[tuple], weights: dict | None = None, most: int = 3) -> tuple[list[dict], dict, dict]:
    """(parts, targets by source, sizes by source) from (cell, pattern, source, words) rows.

    Sources are names (see named). parts: by cell its source, words and ``take`` (words to take of it). Without
    weights, sources weigh 1, 2, 3, repeating, in order of their names.
    """
    by_pattern: dict[tuple, dict] = {}
    sizes: dict[str, int] = {}
    for cell, pattern, source, words in sorted(cells, key=lambda c: (c[1] or [], c[2])):
        by_pattern.setdefault(tuple(pattern or [source]) + (pattern is None,), {})[source] = (cell, words)
        sizes[source] = sizes.get(source, 0) + words
    sizes = dict(sorted(sizes.items()))
    targets = fill_targets(sizes, weights or {s: i % 3 + 1 for i, s in enumerate(sizes)}, most)
    quotas = {s: math.floor(targets[s] + 0.5) for s in sizes}
    found = list(by_pattern.values())
    routed = min_cost_flow([{s: words for s, (_, words) in own.items()} for own in found], quotas, REPEAT_COSTS[:most])
    parts = [{"cell": cell, "source": s, "words": words, "take": to.get(s, 0)} for own, to in zip(found, routed, strict=True) for s, (cell, words) in own.items()]
    return parts, targets, sizes


def select(records: DataFrame, asked: list[tuple[int, int, int]]) -> DataFrame:
    """(cell, base, low, gap): a copy is taken base times, and once more where its order is below low; gap words stay open.

    asked: (cell, base, words wanted beyond base times all).
    The seeded order is narrowed in two steps of 12 bits: words are summed by cell and bits, a window over at most
    4,096 sums a cell finds the bits where the words run out, and only rows with those bits are looked at again. So the
    last window sees a 2**-24 part of a cell. records: cell, size, order.
    """
    spark = records.sparkSession
    state = spark.createDataFrame(asked, "cell long, base long, rest long")
    state = state.withColumn("low", F.lit(0).cast("long"))
    shift = ORDER_BITS
    for _ in range(2):
        shift -= LEVEL_BITS
        inside = _inside(records, state, shift + LEVEL_BITS)
        sums = inside.groupBy("cell", F.shiftright("order", shift).alias("bits")).agg(F.sum("size").alias("words"))
        state = cut_lineage(_advance(state, sums, F.shiftleft(F.col("bits"), shift), F.shiftleft(F.col("bits") + 1, shift)))
    last = _inside(records, state, shift).groupBy("cell", F.col("order").alias("bits")).agg(F.sum("size").alias("words"))
    return cut_lineage(_advance(state, last, F.col("bits"), F.col("bits") + 1)).withColumnRenamed("rest", "gap")


def _inside(records: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """Rows whose leading bits are those of low, in cells that have words to give; state has a row a cell, a bounded number."""
    live = F.broadcast(state.where("rest > 0").select("cell", "low"))
    return records.join(live, "cell").where(F.shiftright("order", shift) == F.shiftright("low", shift))


def _advance(state: DataFrame, sums: DataFrame, begin: Column, end: Column) -> DataFrame:
    """state after taking whole groups in order while they fit: low at the first that doesn't fit, or after the last."""
    in_order = Window.partitionBy("cell").orderBy("bits").rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.withColumn("upto", F.sum("words").over(in_order)).select("cell", "words", "upto", begin.alias("begin"), end.alias("end"))
    cut = upto.join(F.broadcast(state.select("cell", "rest")), "cell").groupBy("cell").agg(
        F.min(F.when(F.col("upto") > F.col("rest"), F.col("begin"))).alias("stop"), F.max("end").alias("beyond"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("used")
    )
    return state.join(F.broadcast(cut), "cell", "left").select("cell", "base", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"), F.coalesce("stop", "beyond", "low").alias("low"))


def later(records: DataFrame, cells: list[tuple[int, int, int]]) -> DataFrame:
    """(cell, source, size, order): copies at or after low in their cell, for (cell, source's number, low) rows."""
    return records.join(F.broadcast(records.sparkSession.createDataFrame(cells, "cell long, source long, low long")), "cell").where("order >= low").drop("low")


def fill(rest: DataFrame, gaps: dict[int, int]) -> list[tuple[int, int]]:
    """(cell, order) of further copies out of rest (see later), for the words that each source has open.

    FILL_ROUNDS times the largest copy that still fits goes in, then the smallest one if that comes nearer.
    """
    spark, extra, gaps = rest.sparkSession, [], dict(gaps)
    for k in range(FILL_ROUNDS + 1):
        asked = [(s, gap) for s, gap in gaps.items() if gap > 0]
        if not asked:
            break
        fit = rest.join(F.broadcast(spark.createDataFrame(asked, "source long, gap long")), "source").where("size <= gap" if k < FILL_ROUNDS else "size < 2 * gap")
        if extra:
            fit = fit.join(F.broadcast(spark.createDataFrame(extra, "cell long, order long")), ["cell", "order"], "left_anti")
        by_size = F.struct("size", (-F.col("order")).alias("minus"), "cell")
        for r in fit.groupBy("source").agg((F.max(by_size) if k < FILL_ROUNDS else F.min(by_size)).alias("best")).collect():
            extra.append((r["best"]["cell"], -r["best"]["minus"]))
            gaps[r["source"]] -= r["best"]["size"]
    return extra


def decide(wanted: DataFrame, parts: list[dict], most: int = 3) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """((cell, base, low), (cell, order)): which copies are taken how often, and those that are taken once more.

    Each cell takes whole copies in the seeded order. What they leave open in the cells of one source is taken, in the same
    order, from the copies that come next in all of those cells; the last open words are filled.
    """
    number = {s: i for i, s in enumerate(sorted({p["source"] for p in parts}))}
    of = {p["cell"]: number[p["source"]] for p in parts}
    found = {r["cell"]: (r["base"], r["low"], r["gap"]) for r in select(wanted, [(p["cell"], *divmod(p["take"], p["words"])) for p in parts if p["words"]]).collect()}
    gaps, open_cells = {}, {}
    for cell, (_, _, gap) in found.items():
        if gap > 0:
            gaps[of[cell]] = gaps.get(of[cell], 0) + gap
            open_cells.setdefault(of[cell], []).append(cell)
    low = {cell: low for cell, (_, low, _) in found.items()}
    several = {s: cells for s, cells in open_cells.items() if len(cells) > 1}
    if several:
        rest = later(wanted, [(c, s, low[c]) for s, cells in several.items() for c in cells])
        for r in select(rest.select(F.col("source").alias("cell"), "size", "order"), [(s, 0, gaps[s]) for s in several]).collect():
            gaps[r["cell"]] = r["gap"]
            for c in several[r["cell"]]:
                low[c] = max(low[c], r["low"])
    rest = [(c, of[c], low[c]) for c, (base, _, _) in found.items() if base < most and gaps.get(of[c], 0) > 0]
    return [(c, base, low[c]) for c, (base, _, _) in found.items()], fill(later(wanted, rest), gaps) if rest else []


def _runs(df: DataFrame, n: str, *keys: str) -> DataFrame:
    """Each row of df n times, numbered by ``copy`` from 0, RUN at a time over all tasks, so that no task writes all."""
    once = df.where(F.col(n) == 1).withColumn("copy", F.lit(0).cast("long"))
    runs = df.where(F.col(n) > 1).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / RUN)))).repartition(*keys, "run")
    more = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col(n)) - 1))).drop("run")
    return once.unionByName(more)


class Mix:
    """The decided mix of a table: who is taken how often."""

    def __init__(self, docs: DataFrame, weights: dict | None = None, most: int = 3):
        """weights: by source, null as None."""
        kinds = cut_lineage(measured(docs))
        self.shared = small_or_whole(shared_texts(kinds))
        records = kinds.join(self.shared, "text_key", "left").withColumn("cell", cell_key())
        by_name = weights and {"b" if s is None else f"a{s}": w for s, w in weights.items()}
        parts, self.targets, self.sizes = plan_mix(cells_of(records), by_name, most)
        spread = _runs(records.drop("pattern"), "copies", "doc_id", "text_key")
        self.records = cut_lineage(spread.withColumn("order", seeded_order(F.col("doc_id"), F.col("text_key"), F.col("copy"))))
        wanted = self.records.where("size > 0").select("cell", "size", "order")
        chosen, extra = decide(wanted, parts, most)
        spark = docs.sparkSession
        # a row a cell, and FILL_ROUNDS + 1 rows a source at most
        self.chosen = F.broadcast(spark.createDataFrame(chosen, "cell long, base long, low long"))
        self.extra = F.broadcast(spark.createDataFrame([(c, o, 1) for c, o in extra], "cell long, order long, more int"))
        self.of = F.broadcast(spark.createDataFrame([(s, self.sizes[s], float(self.targets[s])) for s in self.sizes], "of string, source_size long, target double"))

    def copies(self, rows: DataFrame) -> DataFrame:
        """rows (cell, order, size) with how often each is taken, column ``taken_times``."""
        out = rows.join(self.chosen, "cell", "left").join(self.extra, ["cell", "order"], "left")
        times = F.col("base") + (F.col("order") < F.col("low")).cast("int") + F.coalesce("more", F.lit(0))
        return out.withColumn("taken_times", F.when((F.col("size") > 0) & F.col("base").isNotNull(), times).otherwise(0).cast("int")).drop("base", "low", "more")


def mix_documents(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """Each document's words in the mix: doc_id, size, source_size, target, taken, copies, source.

    Sources (null is one) weigh 1, 2, 3, repeating in code-point order, unless weights are given, and share the words
    of the table. Equal texts of several sources form a membership pattern; the flow spreads repeats over all
    patterns. No document is taken more than three times, always whole. A null or wordless text has size 0 and takes
    nothing; repeated rows are taken one by one; an empty table gives an empty result; further columns are ignored.
    All patterns take part; more than MAX_CELLS sources and sources of patterns are an error.
    """
    mix = Mix(docs, weights)
    out = mix.copies(mix.records).withColumn("name", named(F.col("source"))).join(mix.of, F.col("name") == F.col("of"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("taken_times") * F.col("size")).cast("long").alias("taken"), F.col("taken_times").alias("copies"), "source")


def mix_rows(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """The mix itself, with docs' columns: each document as often as it is taken, a wordless one not at all.

    Rows with equal id, source and text are one document here: as many copies of one of them come out as all of
    them are taken. Others meet small tables alone, so texts are shuffled only where more than a bounded number of texts is
    shared or repeated.
    """
    mix, text = Mix(docs, weights), F.col("text")
    kind = "doc_id", "source", "size", "text_key"
    totals = small_or_whole(cut_lineage(mix.copies(mix.records.where("copies > 1")).groupBy(F.xxhash64(*kind).alias("kind")).agg(F.sum("taken_times").alias("total"))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", word_count(text).alias("size"), F.xxhash64(text).alias("text_key"))
    rows = rows.join(mix.shared, "text_key", "left").withColumn("cell", cell_key()).withColumn("order", seeded_order(F.col("doc_id"), F.col("text_key"), F.lit(0))).withColumn("kind", F.xxhash64(*kind))
    rows = rows.select("row", "kind", "cell", "order", "size").join(totals, "kind", "left")
    single = mix.copies(rows.where("total is null")).where("taken_times > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("taken_times"))).alias("copy"))
    repeated = _runs(rows.where("total > 0").dropDuplicates(["kind"]).select("row", "kind", "total"), "total", "kind").select("row", "copy")
    return single.select("row.*").union(repeated.select("row.*"))
