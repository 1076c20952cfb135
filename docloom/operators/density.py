"""Clusters by density, with outliers: neighbours by cells, core distances, a spanning forest in rounds, a condensed tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, drop

#: Points that a point meets in a cell of the finest grid, on the average at most.
BLOCK = 64
#: Halvings of ``reach`` at most; rows of a group in a task; pairs of points in memory at a time.
HALVINGS, ROWS, PAIRS = 16, 20000, 1 << 20
#: Coordinates that cells are made of; distances are of all coordinates.
CELL_AXES = 3
NOISE = -1


def _cell(length: float, axes: int) -> Column:
    """The cell of a point; sides are a little longer than ``length``, so that rounding never parts neighbours by two cells."""
    return F.array(*[F.floor(F.col("x")[i] / (length * (1 + 1e-9))) for i in range(axes)])


def _around(cell: str, axes: int, half: bool = False) -> Column:
    """The cells around one and itself; with ``half``, of every two that are opposite one."""
    steps = [x for x in product((-1, 0, 1), repeat=axes) if not half or x >= (0,) * axes]
    return F.explode(F.array(*[F.array(*[F.col(cell)[i] + F.lit(v) for i, v in enumerate(x)]) for x in steps]))


def _lengths(points: DataFrame, reach: float, axes: int) -> list[float]:
    """Rising lengths up to ``reach``, each twice the one before; in cells of the first, points are few."""
    most = BLOCK * points.count()
    for halvings in range(HALVINGS + 1):
        n = F.col("count").cast("double")
        met = points.groupBy(_cell(reach / 2**halvings, axes).alias("cell")).count().agg(F.sum(n * n)).first()[0]
        if met <= most:
            break
    return [reach / 2**i for i in range(halvings, -1, -1)]


def _meetings(asking: DataFrame, points: DataFrame, work: Callable[..., pa.Table], schema: str) -> DataFrame:
    """``work`` on the pairs of rows asking (cell, x, ...) with points (cell, x, ...) of the same cell: (asking, places, points,
    places, distances), about ``PAIRS`` at a time. Cells are dealt by hash to groups of about ``ROWS`` points."""
    count = points.count() // ROWS + 1
    keyed = lambda rows: rows.withColumn("key", F.xxhash64("cell")).select("key", F.pmod("key", F.lit(count)).alias("deal"), *[F.col(c).alias(c) for c in rows.columns if c != "cell"])
    asking = asking.join(points.select("cell").distinct(), "cell", "left_semi")
    left, right = keyed(asking), keyed(points.join(asking.select("cell").distinct(), "cell", "left_semi"))

    def group(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("key")
        xa, xb = (t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (a, b))
        keys, wanted = b.column("key").to_numpy(), a.column("key").to_numpy()
        first = np.searchsorted(keys, wanted)
        n = np.searchsorted(keys, wanted, side="right") - first
        ends, at, found = np.cumsum(n), 0, []
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            own = n[at:end]
            i = np.repeat(np.arange(at, end), own)
            j = np.repeat(first[at:end] - (np.cumsum(own) - own), own) + np.arange(len(i))
            found.append(work(a, i, b, j, np.sqrt(((xa[i] - xb[j]) ** 2).sum(1))))
            at = end
        return pa.concat_tables(found)

    return left.groupBy("deal").cogroup(right.groupBy("deal")).applyInArrow(group, schema)


def core_distances(points: DataFrame, reach: float, neighbours: int) -> DataFrame:
    """(id, rep, x, core) of points (id, x) with at least ``neighbours`` points within ``reach``, themselves too: the distance
    of the last of these. rep is the smallest id at the same place.

    Points look for neighbours within a short length first, and only those with too few there within twice that, and so on:
    crowded cells are met in pieces, and long lengths only by points with few others around.
    """
    axes = min(CELL_AXES, len(points.first().x))
    places = cut(points.groupBy("x").agg(F.min("id").alias("rep"), F.count("*").alias("n")))

    def nearest(length: float) -> Callable[..., pa.Table]:
        def work(a: pa.Table, i: np.ndarray, b: pa.Table, j: np.ndarray, d: np.ndarray) -> pa.Table:
            near = d <= length
            i, j, d = i[near], j[near], d[near]
            order = np.lexsort((d, i))
            copies = np.minimum(b.column("n").to_numpy()[j[order]], neighbours)
            i, d = np.repeat(i[order], copies), np.repeat(d[order], copies)
            kept = np.arange(len(i)) - np.searchsorted(i, i) < neighbours
            i, d = i[kept], d[kept]
            own, starts = np.unique(i, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(i)), pa.int32()), pa.array(d))
            return pa.table({"rep": a.column("rep").take(pa.array(own)), "near": lists})

        return work

    asking, known = places, []
    for length in _lengths(places, reach, axes):
        placed = places.withColumn("cell", _cell(length, axes))
        asked = asking.select("rep", "x", _cell(length, axes).alias("own")).select("rep", "x", _around("own", axes).alias("cell"))
        found = _meetings(asked, placed.select("cell", "x", "n"), nearest(length), "rep long, near array<double>")
        core = found.groupBy("rep").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, neighbours).alias("near")).where(F.size("near") >= neighbours)  # a few of each cell around
        known.append(cut(core.select("rep", F.element_at("near", -1).alias("core"))))
        if length < reach:
            asking = cut(asking.join(known[-1], "rep", "left_anti"))
    out = cut(points.join(places.select("rep", "x").join(reduce(DataFrame.unionByName, known), "rep"), "x").select("id", "rep", "x", "core"))
    drop(places, *known)
    return out


def forest_edges(cores: DataFrame, reach: float) -> DataFrame:
    """(u, v, w) among points (id, rep, x, core): edges that hold a minimum spanning forest of all mutual reachabilities up to
    ``reach``: the larger of a distance and both core distances.

    Edges come by rising lengths. Those up to the first are a forest of each group of cells: for every two of its points that has
    a path of edges no longer than theirs, so all of these together connect, up to any length, what the edges between all points
    would. Up to the next one only edges between components of what is connected so far can matter. Most cells hold one
    component nearly alone: its points meet only points of others, so crowded cells aren't met as a whole. Copies hang on
    the first of them by their core distance.
    """
    axes = min(CELL_AXES, len(cores.first().x))
    copies = cores.where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v"), F.col("core").alias("w"))
    places = cut(cores.where("id = rep").select("id", "x", "core"))

    def local(length: float) -> Callable[..., pa.Table]:
        def work(a: pa.Table, i: np.ndarray, b: pa.Table, j: np.ndarray, d: np.ndarray) -> pa.Table:
            (u, cu, ru), (v, cv, rv) = ([t.column(c).to_numpy()[at] for c in ("id", "core", "root")] for t, at in ((a, i), (b, j)))
            w = np.maximum(d, np.maximum(cu, cv))
            near = np.flatnonzero((ru != rv) & (w <= length))
            near = near[spanning_forest(ru[near], rv[near], w[near])]
            return pa.table({"u": np.minimum(u[near], v[near]), "v": np.maximum(u[near], v[near]), "w": w[near]})

        return work

    parts: list[DataFrame] = []
    for length in _lengths(places, reach, axes):
        if not parts:
            placed = places.withColumn("root", F.col("id")).withColumn("cell", _cell(length, axes))
            asked = placed.withColumnRenamed("cell", "own").withColumn("cell", _around("own", axes, half=True)).drop("own")
        else:
            roots = _labelled(places.select(F.col("id").alias("seed")), reduce(DataFrame.unionByName, parts).select(F.col("u").alias("a"), F.col("v").alias("b"), "w"))
            placed = cut(places.join(roots.withColumnRenamed("seed", "id"), "id").withColumn("cell", _cell(length, axes)))
            kinds = placed.groupBy("cell", "root").agg(F.count("*").alias("n"))
            cells = cut(kinds.groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")))
            own = placed.join(cells.select("cell", "main"), "cell").withColumnRenamed("cell", "own")
            others = own.where("root <> main").withColumn("cell", _around("own", axes)).join(cells.withColumnRenamed("main", "met"), "cell").where("roots > 1 or met <> root")
            between = cells.select(F.col("cell").alias("own"), F.col("main").alias("here"), _around("cell", axes).alias("to")).join(cells.select(F.col("cell").alias("to"), F.col("main").alias("there")), "to").where("here <> there")
            side = length * (1 + 1e-9)
            gaps = [F.greatest(F.lit(0.0), F.col("cell")[i] * side - F.col("x")[i], F.col("x")[i] - (F.col("cell")[i] + 1) * side) for i in range(axes)]
            mains = own.where("root = main").join(between.select("own", F.col("to").alias("cell")), "own").where(sum(g * g for g in gaps) <= side * side)
            asked = others.select("cell", "id", "x", "core", "root").unionByName(mains.select("cell", "id", "x", "core", "root"))
        found = _meetings(asked, placed.select("cell", "id", "x", "core", "root"), local(length), "u long, v long, w double")
        parts.append(cut(found.distinct()))
    edges = cut(reduce(DataFrame.unionByName, parts, copies))
    drop(places, *parts)
    return edges


def spanning_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b, w) are a minimum spanning forest: in rounds each component takes its shortest edge."""
    order = np.argsort(w, kind="stable")
    nodes, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    a, b = ends[: len(order)], ends[len(order) :]
    comp, left, kept = np.arange(len(nodes)), np.arange(len(order)), [np.zeros(0, np.int64)]
    while True:
        left = left[comp[a[left]] != comp[b[left]]]
        if not len(left):
            return order[np.concatenate(kept)]
        best = np.full(len(nodes), len(order))
        for end in (a, b):
            own = np.full(len(nodes), len(order))
            own[comp[end[left[::-1]]]] = left[::-1]  # of several the shortest stays
            best = np.minimum(best, own)
        c = np.flatnonzero(best < len(order))
        to = np.arange(len(nodes))
        to[c] = comp[a[best[c]]] + comp[b[best[c]]] - c
        both = c[(to[to[c]] == c) & (c < to[c])]
        to[both] = both
        while (to[to] != to).any():
            to = to[to]
        kept.append(np.unique(best[c]))
        comp = to[comp]


def _ends(pointers: DataFrame) -> DataFrame:
    """(c, end) of pointers (c, to): where following them leads. Of two that point at each other the smaller is the end,
    and so is what has no pointer. The way is halved in each round."""
    back = pointers.select(F.col("c").alias("to"), F.col("to").alias("then"))
    way = pointers.join(back, "to", "left").select("c", F.when((F.col("then") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("end"))
    old = None
    while True:
        on = way.join(way.select(F.col("c").alias("end"), F.col("end").alias("further")), "end", "left").select("c", F.coalesce("further", "end").alias("end"), (F.coalesce("further", "end") != F.col("end")).alias("moved"))
        on = cut(on)
        if old is not None:
            drop(old)
        old, way = on, on.select("c", "end")
        if on.where("moved").isEmpty():
            return on.select("c", "end")


def grow_seeds(points: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(members (id, seed, w), ties (a, b, w)): components of ``least`` points, what joins them, and the links between them.

    All points begin as components of their own. In each round a component of fewer points takes its shortest edge. Where
    these lead to a large one, the lengths on the way only fall, so all on it join at their own edge's length; two
    small ones that lead to each other become one, and if that is large, a seed. w is the length at which a point's
    component first has ``least`` points. Small components that no edge leads out of have no seed.
    """
    where = cut(points.select("id", F.col("id").alias("c"), F.lit(None).cast("double").alias("w")))
    open_ = cut(edges.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "w", F.lit(False).alias("lu"), F.lit(False).alias("lv"), "u", "v"))
    ties, settled = [], []
    if least <= 1:
        where = where.withColumn("w", F.lit(0.0))
        return where.select("id", F.col("c").alias("seed"), "w"), edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "w")
    while True:
        way = F.struct("w", "u", "v")
        out = open_.where("not lu").select(F.col("cu").alias("c"), F.col("cv").alias("to"), F.col("lv").alias("large"), way.alias("e")).unionByName(open_.where("not lv").select(F.col("cv").alias("c"), F.col("cu").alias("to"), F.col("lu").alias("large"), way.alias("e")))
        first = cut(out.groupBy("c").agg(F.min_by(F.struct("to", "large", "e"), "e").alias("x")).select("c", "x.to", "x.large", F.col("x.e.w").alias("w")))
        if first.isEmpty():
            drop(first)
            break
        large = first.where("large").select(F.col("to").alias("end"), F.lit(True).alias("at_large")).distinct()
        ends = _ends(first.select("c", "to"))
        sizes = where.where("w is null").groupBy("c").agg(F.count("*").alias("n"))
        lead = first.join(ends, "c").join(large, "end", "left").join(sizes, "c")
        # two that lead to each other: the end is the smaller one, and its partner is who it leads to
        pair = lead.where("at_large is null and c = end").select(F.col("c").alias("a"), F.col("to").alias("b"), F.col("n").alias("na"), F.col("w").alias("wp"))
        pair = pair.join(sizes.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", "wp", (F.col("na") + F.col("nb") >= least).alias("grown"))
        moved = lead.where("at_large").select("c", F.col("end").alias("new"), F.lit(True).alias("big"), F.col("w").alias("at"))
        for side in ("a", "b"):
            moved = moved.unionByName(pair.select(F.col(side).alias("c"), F.col("a").alias("new"), F.col("grown").alias("big"), F.when(F.col("grown"), F.col("wp")).alias("at")))
        moved = cut(moved)
        where_new = where.join(moved, "c", "left").select("id", F.coalesce("new", "c").alias("c"), F.coalesce("at", "w").alias("w"))
        where_new = cut(where_new)
        settled.append(where_new.where("w is not null"))
        drop(where)
        where = where_new.where("w is null")
        for side in ("u", "v"):
            names = moved.select(F.col("c").alias(f"c{side}"), "new", "big")
            open_ = open_.join(names, f"c{side}", "left").withColumn(f"c{side}", F.coalesce("new", f"c{side}")).withColumn(f"l{side}", F.coalesce("big", f"l{side}")).drop("new", "big")
        open_ = cut(open_.where("cu <> cv"))
        ties.append(open_.where("lu and lv").select(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b"), "w"))
        open_ = open_.where("not (lu and lv)")
        drop(first, moved)
    members = where.select("id", F.lit(None).cast("long").alias("seed"), "w")
    for part in settled:
        members = members.unionByName(part.select("id", F.col("c").alias("seed"), "w"))
    links = edges.sparkSession.createDataFrame([], "a long, b long, w double")
    for part in ties:
        links = links.unionByName(part)
    return members, links.groupBy("a", "b").agg(F.min("w").alias("w"))


def _labelled(seeds: DataFrame, ties: DataFrame) -> DataFrame:
    """(seed, root): connected seeds have the same root; every round each component follows its smallest neighbour."""
    names = cut(seeds.select("seed", F.col("seed").alias("root")))
    while True:
        a, b = (names.select(F.col("seed").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        both = ties.join(a, "a").join(b, "b").where("ra <> rb")
        out = both.select(F.col("ra").alias("c"), F.col("rb").alias("to")).unionByName(both.select(F.col("rb").alias("c"), F.col("ra").alias("to")))
        first = cut(out.groupBy("c").agg(F.min("to").alias("to")).where("to < c"))
        if first.isEmpty():
            return names
        ends = _ends(first)
        names = cut(names.join(ends.withColumnRenamed("c", "root"), "root", "left").select("seed", F.coalesce("end", "root").alias("root")))
        drop(first)


def merge_tree(seeds: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, reach: float) -> list[tuple[int, int, float, float]]:
    """(node, parent, born, dies) of one component's seeds and of what they become: ties are gone through by length, equal
    ones at once, and all that they join become one new node, negative and numbered from -2. The last one dies at ``reach``."""
    up, node, parent, born, dies = {s: s for s in seeds}, {s: s for s in seeds}, {}, {s: 0.0 for s in seeds}, {}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    order, at, nth = np.argsort(w, kind="stable"), 0, -2
    while at < len(order):
        end = at
        joined: dict[int, set[int]] = {}
        while end < len(order) and w[order[end]] == w[order[at]]:
            x, y = find(a[order[end]]), find(b[order[end]])
            if x != y:
                under = joined.pop(x, {node[x]}) | joined.pop(y, {node[y]})
                up[y] = x
                joined[x] = under
            end += 1
        for x, under in joined.items():
            for child in under:
                parent[child], dies[child] = nth, float(w[order[at]])
            born[nth], node[x] = float(w[order[at]]), nth
            nth -= 1
        at = end
    return [(n, parent.get(n, -1), born[n], dies.get(n, reach)) for n in born]


def best_clusters(parent: dict[int, int], stability: dict[int, float]) -> dict[int, int]:
    """The chosen cluster of each node of a tree (itself or one above it), or -1: of every node and the best of what is
    below it, the more stable is taken, the node where they are equal."""
    below: dict[int, list[int]] = {}
    for n, p in parent.items():
        below.setdefault(p, []).append(n)
    order, total, whole = list(below.get(-1, [])), {}, set()
    for n in order:
        order += below.get(n, [])
    for n in reversed(order):
        rest = sum(total[c] for c in below.get(n, []))
        if not below.get(n) or stability[n] >= rest:
            whole.add(n)
        total[n] = max(stability[n], rest) if below.get(n) else stability[n]
    chosen = {}
    for n in order:
        above = chosen.get(parent[n], NOISE)
        chosen[n] = above if above != NOISE else n if n in whole else NOISE
    return chosen


def density_clusters(points: DataFrame, reach: float, neighbours: int = 5, least: int = 10) -> DataFrame:
    """(id, cluster) of points (id long, x): the smallest id of its cluster, or -1 for what is in none.

    The distance of two points is at least either's core distance, that of its ``neighbours``-th nearest point, itself
    counted. Components at rising lengths up to ``reach`` make a tree; components of fewer than ``least`` points are not
    in it, their points leave it where they do; and those parts of the tree are clusters that together hold their points
    longest, in sums of 1 / length. Points that reach too few others, or belong to no chosen part, are -1. What lies
    further apart than ``reach`` is never together: the result is that of the whole hierarchy cut off there.

    Ids must be unique. Points with null or non-finite coordinates are -1. Neighbours are found by cells over the first
    ``CELL_AXES`` coordinates, in grids of rising lengths, the first so fine that points are few in a cell; long lengths are
    looked at only by points with few others around and between components. Seeds, components and sums are joins and grouped
    sums; the tree of one component's seeds, of at most a ``least``-th of its points, is walked in one task.
    """
    fine = F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = cut(points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")))
    good = rows.where(fine)
    noise = rows.select("id", F.lit(NOISE).cast("long").alias("cluster"))
    if good.isEmpty():
        return noise
    cores = core_distances(good, reach, neighbours)
    if cores.isEmpty():
        return noise
    edges = forest_edges(cores, reach)
    members, ties = grow_seeds(cores, edges, least)
    members, ties = cut(members), cut(ties)
    seeds = members.where("seed is not null").select("seed").distinct()
    roots = _labelled(seeds, ties)
    tied = ties.join(roots.withColumnRenamed("seed", "a"), "a").select("root", "a", "b", "w")
    listed = roots.groupBy("root").agg(F.collect_list("seed").alias("seeds")).join(tied.groupBy("root").agg(F.collect_list(F.struct("a", "b", "w")).alias("ties")), "root", "left")

    def grown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for root, own, links in zip(pdf.root, pdf.seeds, pdf.ties, strict=True):
                links = [] if links is None else links
                columns = [np.array([x[k] for x in links]) for k in ("a", "b", "w")]
                tree = merge_tree(np.array(own), *columns, reach)
                yield pd.DataFrame([(root, *x) for x in tree], columns=["root", "node", "parent", "born", "dies"])

    nodes = cut(listed.mapInPandas(grown, "root long, node long, parent long, born double, dies double"))
    placed = cut(_climbed(members.where("seed is not null").join(roots, "seed").select("id", "root", F.col("seed").alias("node"), "w"), nodes))
    # a point is in a node from the length at which it joins it, or the node is born, to that at which the node dies
    rate = lambda c: 1 / F.greatest(c, F.lit(reach * 1e-9))
    held = placed.join(nodes, ["root", "node"]).groupBy("root", "node").agg(F.count("*").alias("n"), F.sum(rate(F.greatest("w", "born")) - rate(F.col("dies"))).alias("held"))
    flow = cut(nodes.join(held, ["root", "node"], "left").select("root", "node", "parent", "born", "dies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("held", F.lit(0.0)).alias("held")))
    listed = flow.groupBy("root").agg(F.collect_list(F.struct("node", "parent", "born", "dies", "n", "held")).alias("nodes"))

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = reach * 1e-9
        for pdf in frames:
            for root, own in zip(pdf.root, pdf.nodes, strict=True):
                tree = {x["node"]: x for x in own}
                below = {n: 0 for n in tree}  # points of all nodes under it, which it holds from its birth on
                for n in sorted(tree, key=lambda n: (tree[n]["dies"], -n)):
                    up = tree[n]["parent"]
                    if up != -1:
                        below[up] += below[n] + tree[n]["n"]
                stability = {n: x["held"] + below[n] * (1 / max(x["born"], floor) - 1 / max(x["dies"], floor)) for n, x in tree.items()}
                best = best_clusters({n: x["parent"] for n, x in tree.items()}, stability)
                yield pd.DataFrame([(root, n, c) for n, c in best.items()], columns=["root", "node", "chosen"])

    best = listed.mapInPandas(chosen, "root long, node long, chosen long")
    met = placed.join(best, ["root", "node"]).where(F.col("chosen") != NOISE).select("id", "root", "chosen")
    names = met.groupBy("root", "chosen").agg(F.min("id").alias("cluster"))
    return rows.select("id").join(met.join(names, ["root", "chosen"]).select("id", "cluster"), "id", "left").select("id", F.coalesce("cluster", F.lit(NOISE)).cast("long").alias("cluster"))


def _climbed(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points (id, root, node, w) at the first node, from theirs up, that dies later than w; by jumps of 2^k nodes."""
    jumps = [nodes.where("parent <> -1").select("root", "node", F.col("parent").alias("to"), F.col("dies").alias("past"))]
    while True:
        step = jumps[-1]
        further = cut(step.join(step.select("root", F.col("node").alias("to"), F.col("to").alias("then"), F.col("past").alias("last")), ["root", "to"]).select("root", "node", F.col("then").alias("to"), F.col("last").alias("past")))
        if further.isEmpty():
            break
        jumps.append(further)
    for step in reversed(jumps):
        points = points.join(step, ["root", "node"], "left").withColumn("node", F.when(F.col("w") >= F.col("past"), F.col("to")).otherwise(F.col("node"))).drop("to", "past")
    return points


def projected(documents: DataFrame, features: int = 256, axes: int = 3) -> DataFrame:
    """(id, x) of documents (doc_id, text): hashed TF-IDF of unit length on its ``axes`` main components."""
    from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from ..functions import text as T

    words = documents.select("doc_id", T.term_tokens(F.coalesce("text", F.lit(""))).alias("words"))
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=features).transform(words)
    unit = Normalizer(inputCol="idf", outputCol="unit").transform(IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf))
    found = PCA(k=axes, inputCol="unit", outputCol="main").fit(unit).transform(unit)
    whole: Column = vector_to_array("main")
    return found.select(F.col("doc_id").cast("long").alias("id"), F.transform(whole, lambda v: F.round(v, 9)).alias("x"))
