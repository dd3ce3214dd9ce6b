"""Embedding near-dedup (operator 6): exact cosine pairs by dual traversal of cover trees.

Equal vectors are one point with a count. The upper levels of the tree are cells: a cell of more points
than a block is split by the nearest of a few of its own points, again and again, and every cell knows how
far its points reach. Cells are met in pairs from the root down, a join on their parents for each level:
a pair whose centres are farther apart than the threshold and both covering radii is dropped with all
below it, and one whose points are all near enough to each other is settled as a whole. The last cells
are blocks; each block builds a cover tree of its own: nested levels of centres with halving radii, each
point within the radius of its centre on every level. What pairs of blocks are left are tasks, which walk both trees
from the top by the same two rules and compare what remains in double precision.

Links are counted, not listed, and components leave a task as (point, smallest point) edges, so a
dense group of any size gives rows in proportion to its points. Centres come from samples of
SAMPLE to 2 * SAMPLE points of a cell; they steer the pruning alone, every pair within the threshold is
found whatever they are. Nothing but counts of cells comes to the driver.

Cases: vectors that are null, empty, zero, or hold nulls or non-finite numbers, and those without vec_id, link with
nothing and are kept; vectors of different lengths never link; rows that share a vec_id are nodes of one id, and
their links add up; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, ship, union

COSINE = 0.95
#: Points of a cell that its centres are chosen from (to twice as many), and centres of one split at most.
SAMPLE, CENTRES = 512, 32
#: Points of a block at most, and bytes of their vectors.
BLOCK, BLOCK_BYTES = 8192, 16 << 20
#: Splits one below the other; cells that are larger even then, of points that hardly differ, are dealt by a hash.
ROUNDS = 8
#: All points of one length, if more than this, are split into ROOTS cells at least, so that there are tasks enough.
ALONE, ROOTS = 1024, 8
#: Points of a large cell that one task assigns to its centres.
DEALT = 100_000
#: Covering radii of a block's levels; above the first, cells do what coarser levels would.
LEVELS = (0.5, 0.25, 0.125, 0.0625)
CHUNK = 100_000
_SLACK = 1e-7


def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, unit) of each row; unit is null for vectors that can't link."""
    for batch in batches:
        units, dims = [], []
        for known, v in zip(batch.column(0).is_valid().to_pylist(), batch.column(1), strict=True):
            x = None
            if known and v.is_valid and len(v) and not v.values.null_count:
                x = np.asarray(v.values, dtype=np.float64)
                norm = np.linalg.norm(x / m) * m if np.isfinite(x).all() and (m := np.abs(x).max()) > 0 else 0.0
                x = x / m / (norm / m) if norm else None
            units.append(None if x is None else x.tobytes())
            dims.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["vec_id", "dim", "unit"])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * dots))


def spread(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k centres, each the point farthest from those before."""
    chosen, far = [0], distance(x @ x[0])
    while len(chosen) < min(k, len(x)) and far.max() > _SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distance(x @ x[chosen[-1]]))
    return x[chosen]


def net(x: np.ndarray, members: np.ndarray, radius: float) -> np.ndarray:
    """The centre of each of `members`, itself one of them, within the radius (but for rounding: covering radii are
    taken from the points themselves); the first is always a centre. x may be in single precision."""
    near, out, centres = 1 - radius * radius / 2, np.full(len(members), -1), np.empty(0, np.int64)
    for a in range(0, len(members), 512):
        rows = members[a : a + 512]
        if len(centres):
            dots = x[rows] @ x[centres].T
            best = dots.argmax(1)
            ok = dots[np.arange(len(rows)), best] >= near
            out[a : a + 512][ok] = centres[best[ok]]
        left = np.flatnonzero(out[a : a + 512] < 0)
        close = x[rows[left]] @ x[rows[left]].T >= near
        fresh, own = [], np.full(len(left), -1)
        for i in range(len(left)):
            if own[i] < 0:
                own[(own < 0) & close[i]] = i
                own[i] = i
                fresh.append(i)
        out[a + left] = rows[left][own]
        centres = np.concatenate([centres, rows[left][fresh]])
    return out


def build(x: np.ndarray) -> np.ndarray:
    """The centre of each point on each level, coarsest first; centres stay centres below."""
    x = x.astype(np.float32)
    levels = [net(x, np.arange(len(x)), LEVELS[0])]
    for radius in LEVELS[1:]:
        above, now = levels[-1], np.arange(len(x))
        order = np.lexsort((above != np.arange(len(x)), above))  # a node's own centre first
        cuts = np.flatnonzero(np.diff(above[order], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            if b - a > 1:
                now[order[a:b]] = net(x, order[a:b], radius)
        levels.append(now)
    return np.stack(levels)


class Tree:
    """Nodes by level: (centre, covering radius), their children or, below the last level, points, and weights."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, weight: np.ndarray):
        self.x, self.weight = x, weight
        self.nodes, self.kids, self.node_of, self.weights = [], [], [], []
        for i, own in enumerate(levels):
            centre, node = np.unique(own, return_inverse=True)
            reach = np.zeros(len(centre))
            np.maximum.at(reach, node, distance(np.einsum("ij,ij->i", x, x[own])))
            reach[np.bincount(node) == 1] = 0
            self.nodes.append((centre, reach))
            self.node_of.append(node)
            self.weights.append(np.bincount(node, weight, len(centre)).astype(np.int64))
            if i:
                parent = np.searchsorted(self.nodes[i - 1][0], levels[i - 1][centre])
                self.kids.append(self.listed(parent, np.arange(len(centre)), len(self.nodes[i - 1][0])))
        self.kids.append(self.listed(node, np.arange(len(x)), len(centre)))
        # what is settled for whole nodes: links gained by each point, how often with its own node, and if any
        self.gain = [np.zeros(len(c), np.int64) for c, _ in self.nodes]
        self.selves = [np.zeros(len(c), np.int64) for c, _ in self.nodes]
        self.settled = [np.zeros(len(c), bool) for c, _ in self.nodes]

    @staticmethod
    def listed(owner: np.ndarray, what: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(owner, kind="stable")
        return np.searchsorted(owner[order], np.arange(n + 1)), what[order]

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes of the first level in order of their radii, the radii, the centres in single precision)."""
        centre, reach = self.nodes[0]
        order = np.argsort(reach, kind="stable")
        return order, reach[order], self.x[centre[order]].astype(np.float32)


def product(left: tuple, right: tuple, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of what node a[k] and node b[k] list, in chunks."""
    na, nb = np.diff(left[0])[a], np.diff(right[0])[b]
    ends = np.cumsum(na * nb)
    k = 0
    while k < len(a):
        base = ends[k - 1] if k else 0
        upto = max(k + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        size = (na * nb)[k:upto]
        which = np.repeat(np.arange(k, upto), size)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield left[1][left[0][a[which]] + step // nb[which]], right[1][right[0][b[which]] + step % nb[which]]
        k = upto


class Links:
    """Counts of links and labels of components over the points of both sides."""

    def __init__(self, n: int):
        self.count, self.label = np.zeros(n, np.int64), np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            keep = a != b
            i, j, a, b = i[keep], j[keep], a[keep], b[keep]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def traverse(left: Tree, right: Tree, links: Links, shift: int, cosine: float = COSINE) -> None:
    """Count the links between two trees' points; shift: the first number of right's points (0: the same tree)."""
    limit = float(np.sqrt(2 - 2 * cosine))
    same = shift == 0

    def meet(a: np.ndarray, b: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Node pairs that need their children; drops those too far apart and settles those near as a whole."""
        (ca, ra), (cb, rb) = left.nodes[level], right.nodes[level]
        d = distance(np.einsum("ij,ij->i", left.x[ca[a]], right.x[cb[b]]))
        reach = ra[a] + rb[b]
        ok = d <= limit + reach + _SLACK
        full = ok & (d + reach <= limit - _SLACK) & (reach > 0)
        x, y = a[full], b[full]
        np.add.at(left.gain[level], x, right.weights[level][y])
        left.settled[level][x] = True
        if same:
            np.add.at(left.selves[level], x[x == y], 1)
        else:
            np.add.at(right.gain[level], y, left.weights[level][x])
            right.settled[level][y] = True
        links.join(ca[x], cb[y] + shift)
        go = ok & ~full
        return a[go], b[go]

    def exact(i: np.ndarray, j: np.ndarray) -> None:
        if same:
            i, j = i[i != j], j[i != j]
        ok = np.einsum("ij,ij->i", left.x[i], right.x[j]) >= cosine
        i, j = i[ok], j[ok]
        np.add.at(links.count, i, right.weight[j])
        if not same:
            np.add.at(links.count, j + shift, left.weight[i])
        links.join(i, j + shift)

    def descend(a: np.ndarray, b: np.ndarray, level: int) -> None:
        if not len(a):
            return
        for i, j in product(left.kids[level], right.kids[level], a, b):
            if level + 1 == len(LEVELS):
                exact(i, j)
            else:
                descend(*meet(i, j, level + 1), level + 1)

    # the top of both trees as products of matrices in single precision, with room for its rounding; nodes come in order
    # of their radii, so that one bound rules out most of a tile
    (oa, ra, xa), (ob, rb, xb) = left.top(), right.top()
    room = (left.x.shape[1] + 8) * 2e-7
    for k, k_end in tiles(ra, 1024):
        for m, m_end in tiles(rb, 4096):
            dots = xa[k:k_end] @ xb[m:m_end].T
            bound = lambda reach: 1 - np.minimum(2.0, limit + reach + _SLACK) ** 2 / 2 - room
            near = np.flatnonzero((dots >= np.float32(bound(ra[k_end - 1] + rb[m_end - 1]))).ravel())
            a, b = np.divmod(near, m_end - m)
            ok = dots.ravel()[near] >= bound(ra[k + a] + rb[m + b])
            a, b = oa[k + a[ok]], ob[m + b[ok]]
            for c in range(0, len(a), CHUNK):
                descend(*meet(a[c : c + CHUNK], b[c : c + CHUNK], 0), 0)


def tiles(reach: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of ascending radii, of `size` at most and each of much the same radius."""
    cuts = sorted({0, len(reach), *range(0, len(reach), size), *np.searchsorted(reach, (0.0, 0.05, 0.15, 0.3, 0.6), "right").tolist()})
    return list(zip(cuts, cuts[1:], strict=False))


def push_down(tree: Tree, links: Links, shift: int) -> None:
    """Give the points of settled nodes their links."""
    at = np.arange(len(tree.x)) + shift
    for level, (centre, _) in enumerate(tree.nodes):
        node = tree.node_of[level]
        links.count[at] += tree.gain[level][node] - tree.selves[level][node] * tree.weight
        mine = np.flatnonzero(tree.settled[level][node])
        links.join(at[mine], centre[node[mine]] + shift)


def met(t: pa.Table) -> pa.Table:
    """(vec_id, links, low) of the points of one pair of blocks that have links in it."""
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    own, trees, ids = np.array(t["block"].to_pylist(), object), [], []
    for block in dict.fromkeys((i, j)):
        rows = t.filter(pa.array(own == block))
        rows = rows.take(pa.array(np.argsort(rows["place"].to_numpy())))
        x = matrix(rows["unit"])
        trees.append(Tree(x, np.frombuffer(b"".join(rows["levels"].to_pylist()), np.int32).reshape(len(x), -1).T.astype(np.int64), rows["n"].to_numpy()))
        ids.append(rows["vec_id"].to_numpy())
    all_ids = np.concatenate(ids)
    links = Links(len(all_ids))
    traverse(trees[0], trees[-1], links, 0 if i == j else len(ids[0]))
    for k, tree in enumerate(trees):
        push_down(tree, links, k * len(ids[0]))
    low = np.full(len(all_ids), np.iinfo(np.int64).max)
    np.minimum.at(low, links.label, all_ids)
    at = np.flatnonzero(links.count)
    return pa.table({"vec_id": pa.array(all_ids[at], pa.int64()), "links": pa.array(links.count[at], pa.int64()), "low": pa.array(low[links.label[at]], pa.int64())})


def placed(t: pa.Table) -> pa.Table:
    """Points of a block with their place in it and their centres by level."""
    levels = build(matrix(t["unit"])).T.astype(np.int32)
    t = t.append_column("place", pa.array(np.arange(t.num_rows), pa.int32()))
    return t.append_column("levels", pa.array([r.tobytes() for r in levels], pa.binary()))


POINTS = "cell string, dim int, vec_id long, n long, unit binary"


def choose(t: pa.Table) -> pa.Table:
    """Centres of one cell from its sample, as one row."""
    least = ROOTS if "." not in t["cell"][0].as_py() else 2
    k = int(min(CENTRES, max(least, -(-3 * t["size"][0].as_py() // (2 * t["most"][0].as_py())))))
    x = matrix(t["unit"].take(pa.array(np.argsort(t["unit"].to_numpy(zero_copy_only=False), kind="stable"))))
    return pa.table({"cell": t["cell"].slice(0, 1), "centres": pa.array([spread(x, k).tobytes()], pa.binary())})


def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points in order of their cells, each cell's centres first: (parent, point with its new cell, far, centre)."""
    cell, centres = None, np.empty((0, 0))
    for b in batches:
        own, packed, dims = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("cell", "centres", "dim"))
        heads = {i for i, c in enumerate(packed) if c is not None}
        cuts = sorted({0, *heads})
        for x, y in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
            if x in heads:
                cell, centres, x = own[x], np.frombuffer(packed[x], np.float64).reshape(-1, dims[x]), x + 1
            if x >= y:
                continue
            part = b.slice(x, y - x)
            if cell != own[x]:
                raise ValueError("the points of a cell have no centres")
            dots = matrix(part.column(part.schema.get_field_index("unit"))) @ centres.T
            k = dots.argmax(1)
            new = pa.array([f"{cell}.{i}" for i in k.tolist()])
            columns = [new, *(part.column(part.schema.get_field_index(c)) for c in ("dim", "vec_id", "n", "unit")), part.column(part.schema.get_field_index("cell")), pa.array(distance(dots[np.arange(len(k)), k])), pa.array([centres[i].tobytes() for i in k.tolist()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "dim", "vec_id", "n", "unit", "parent", "far", "centre"])


def apart(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Pairs of cells that may have links, and whether all their points are linked."""
    limit = float(np.sqrt(2 - 2 * cosine))
    for b in batches:
        dims, out = np.array([len(x) for x in b.column(b.schema.get_field_index("centre_i")).to_pylist()]), []
        for dim in np.unique(dims):
            part = b.take(pa.array(np.flatnonzero(dims == dim)))
            x, y = (matrix(part.column(part.schema.get_field_index(f"centre_{s}"))) for s in "ij")
            reach = sum(part.column(part.schema.get_field_index(f"far_{s}")).to_numpy() for s in "ij")
            d = distance(np.einsum("ij,ij->i", x, y))
            out.append(part.select(["i", "j"]).append_column("whole", pa.array(d + reach <= limit - _SLACK)).filter(pa.array(d <= limit + reach + _SLACK)))
        yield from out


def blocks_of(single: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(points with their block as `cell`, the cells made by each round of splits: parent, cell, centre, far)."""
    now = materialize(single.select(F.col("dim").cast("string").alias("cell"), "dim", F.col("rep").alias("vec_id"), "n", "unit"), "points")
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))).cast("int")
    done, rounds = [], []
    for turn in range(ROUNDS + 1):
        large = materialize(now.groupBy("cell", "dim").agg(F.count("*").alias("size")).withColumn("most", most).where(F.col("size") > F.least("most", F.lit(BLOCK if turn else min(BLOCK, ALONE)))), "large-cells")
        if large.isEmpty():
            done.append(now)
            break
        open_ = now.join(large.select("cell", "size", "most"), "cell")
        done.append(now.join(large, "cell", "left_anti"))
        if turn == ROUNDS:
            done.append(open_.withColumn("cell", F.concat_ws(".", "cell", F.pmod(F.xxhash64("unit"), F.ceil(F.col("size") / F.col("most"))))).select(now.columns))
            break
        seen = open_.where(F.pmod(F.xxhash64("unit", F.lit(turn)), F.greatest(F.lit(1), F.floor(F.col("size") / SAMPLE)).cast("long")) == 0)
        centres = seen.groupBy("cell").applyInArrow(choose, "cell string, centres binary")
        parts = F.ceil(F.col("size") / DEALT).cast("int")
        heads = centres.join(large, "cell").select("cell", "dim", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("unit"), "centres", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        rest = open_.select("cell", "dim", "vec_id", "n", "unit", F.lit(None).cast("binary").alias("centres"), F.pmod(F.xxhash64("unit"), parts).cast("int").alias("part"))
        ordered = heads.unionByName(rest).repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("centres").isNull())
        split = materialize(ordered.mapInArrow(assign, f"{POINTS}, parent string, far double, centre binary"), "cells")
        rounds.append(materialize(split.groupBy("parent", "cell").agg(F.first("centre").alias("centre"), F.max("far").alias("far")), "cell-tree"))
        now = split.select(now.columns)
    return materialize(union(done), "blocks"), rounds


def pairs_of(blocks: DataFrame, rounds: list[DataFrame], cosine: float) -> tuple[DataFrame, DataFrame | None]:
    """(pairs of blocks (i, j) that may have links, pairs of cells that are linked as a whole)."""
    leaves = blocks.select("cell").distinct()
    now, whole = leaves.select(F.substring_index("cell", ".", 1).alias("i")).distinct().withColumn("j", F.col("i")), []
    for k, made in enumerate(rounds):
        kids = made
        if k:  # cells that no round has split so far stand for themselves
            split = union([r.select(F.col("parent").alias("cell")) for r in rounds[: k + 1]]).distinct()
            kept = union(rounds[:k]).join(split, "cell", "left_anti")
            kids = made.unionByName(kept.select(F.col("cell").alias("parent"), "cell", "centre", "far"))
        roots = now.where("i = j and not contains(i, '.')").join(made.select(F.col("parent").alias("i")), "i", "left_anti").select("i", "j", F.lit(False).alias("whole"))
        i, j = (kids.select(F.col("parent").alias(f"parent_{s}"), F.col("cell").alias(s), F.col("centre").alias(f"centre_{s}"), F.col("far").alias(f"far_{s}")) for s in "ij")
        both = now.withColumnsRenamed({"i": "parent_i", "j": "parent_j"}).join(i, "parent_i").join(j, "parent_j").where("parent_i <> parent_j or i <= j")
        got = materialize(both.select("i", "j", "centre_i", "centre_j", "far_i", "far_j").mapInArrow(lambda b: apart(b, cosine), "i string, j string, whole boolean").unionByName(roots), "cell-pairs")
        whole.append(got.where("whole").select("i", "j"))
        now = got.where("not whole").select("i", "j")
    # blocks that were dealt by a hash lie below the last cells
    below = leaves.withColumn("cell_of", F.col("cell")) if not rounds else leaves.withColumn("cell_of", F.when(F.size(F.split("cell", "\\.")) > ROUNDS + 1, F.substring_index("cell", ".", ROUNDS + 1)).otherwise(F.col("cell")))
    i, j = (below.select(F.col("cell_of").alias(f"{s}_"), F.col("cell").alias(s)) for s in "ij")
    last = now.withColumnsRenamed({"i": "i_", "j": "j_"}).join(i, "i_").join(j, "j_").where("i_ <> j_ or i <= j").select("i", "j")
    return last, union(whole) if whole else None


def settled_links(blocks: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((vec_id, links), edges (a, b)) of the points of cells that are linked as a whole."""
    steps = F.split("cell", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat_ws(".", F.slice(steps, F.lit(1), k)))
    within = blocks.groupBy("cell").agg(F.sum("n").alias("weight"), F.min("vec_id").alias("rep")).select("cell", F.explode(above).alias("at"), "weight", "rep")
    cells = materialize(within.groupBy("at").agg(F.sum("weight").alias("weight"), F.min("rep").alias("rep")), "cell-weights")
    i, j = (cells.select(F.col("at").alias(s), F.col("weight").alias(f"weight_{s}"), F.col("rep").alias(f"rep_{s}")) for s in "ij")
    known = materialize(whole.join(i, "i").join(j, "j"), "whole-pairs")
    gains = known.select(F.col("i").alias("at"), F.col("weight_j").alias("gain"), F.col("rep_i").alias("rep"), (F.col("i") == F.col("j")).cast("int").alias("own"))
    gains = gains.unionByName(known.where("i <> j").select(F.col("j").alias("at"), F.col("weight_i").alias("gain"), F.col("rep_j").alias("rep"), F.lit(0).alias("own")))
    gains = gains.groupBy("at").agg(F.sum("gain").alias("gain"), F.sum("own").alias("own"), F.first("rep").alias("rep"))
    of_block = within.select("cell", "at").join(gains, "at").select("cell", "gain", "own", F.col("rep").alias("b"))
    mine = materialize(blocks.select("cell", "vec_id", "n").join(of_block, "cell").select("vec_id", (F.col("gain") - F.col("own") * F.col("n")).alias("links"), "b"), "whole-links")
    edges = mine.select(F.col("vec_id").alias("a"), "b").unionByName(known.select(F.col("rep_i").alias("a"), F.col("rep_j").alias("b")))
    return mine.select("vec_id", "links"), edges


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) of each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(points, "vec_id long, dim int, unit binary"), "vectors")
    single = materialize(rows.where("unit is not null").groupBy("dim", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "points")
    blocks, rounds = blocks_of(single)
    pairs, whole = pairs_of(blocks, rounds, cosine)
    trees = blocks.select(F.col("cell").alias("block"), "vec_id", "n", "unit").groupBy("block").applyInArrow(placed, "block string, vec_id long, n long, unit binary, place int, levels binary")
    trees = materialize(trees, "trees")
    dealt = trees.join(pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), "block")
    found = materialize(dealt.groupBy("i", "j").applyInArrow(met, "vec_id long, links long, low long"), "found")
    links, edges = found.select("vec_id", "links"), found.select(F.col("vec_id").alias("a"), F.col("low").alias("b"))
    if whole is not None:
        more, joined = settled_links(blocks, whole)
        links, edges = links.unionByName(more), edges.unionByName(joined)
    component = connected_components(edges, "vector-components")
    links = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    known = single.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("dim", "unit", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    got = rows.join(known, ["dim", "unit"], "left")
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op6(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
