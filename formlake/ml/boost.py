"""Second-order boosted trees, grown from histograms that Spark aggregates.

Inputs are binned once; bin 0 is "missing". For every pass over a tree, sums of gradients and hessians by
(node, feature, bin) are all that leaves the rows, and what they give is bounded by nodes x features x bins, whatever
the number of rows. Rows are blocks of arrays (``blocks``), in which tasks count, and a group of the ranker is whole in its
block; where a group is over-full, rows stay a table and Spark's grouped sums do the same. Only the lighter child of a
split is summed; its sibling is the difference. A split sends a set of bins to the left: a prefix of the thresholds, or of the categories in order of gradient / hessian, and the missing
ones where they do more good. Leaves hold -G / (H + l2).

Trees grow level by level, or best leaf first up to a number of leaves. For the latter, all open leaves are
expanded in one pass and the order of gains decides afterwards, so a tree takes as many passes as it is deep.

Where rows are few (``HELD_ROWS``), one task holds them and grows all trees, as a job for each pass would take longer than the pass.

Margins stay with their rows. Rows kept for validation get them too, and their loss comes with the sums for the next root, so
growth stops ``patience`` trees after the best one without another fit.
"""

from __future__ import annotations

import heapq
import json
import math
import random
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake import schema
from formlake.ml.blocks import HELD_ROWS, LOTS, Block, Held, combined, drawn, joined, lots, row_count, to_blocks
from formlake.ml.compiled import COPIES, Flat, Scorer, inputs as vector_of, number_split
from formlake.operators.skew import KeyScan, dealt, match, positions
from formlake.session import cut_lineage

LABEL = "target_win"
#: Plans of more trees than this on top of each other take longer to analyse than to run.
CHECKPOINT_EVERY = 3
#: Blocks have no plan; their lineage is cut so that a lost one isn't computed through all trees.
BLOCKS_CHECKPOINT_EVERY = 20


@dataclass(frozen=True)
class Params:
    """``leaves`` set: best leaf first up to so many, else level by level. ``rows`` and ``columns`` are the shares that a
    tree sees. ``bins`` bounds the thresholds of a number, ``categories`` the categories of an input that have a bin of
    their own, the most frequent ones; the rest share one."""

    trees: int = 1000
    rate: float = 0.05
    depth: int = 6
    leaves: int | None = None
    l2: float = 1.0
    min_child: float = 1.0
    min_gain: float = 0.0
    bins: int = 64
    categories: int = 254
    rows: float = 1.0
    columns: float = 1.0
    patience: int = 50
    seed: int = 42


# ---- bins


@dataclass(frozen=True)
class Bins:
    """Thresholds of each number and labels of each category. NULL and NaN are bin 0, a label not seen is too."""

    edges: dict[str, list[float]]
    labels: dict[str, list[str]]
    overflow: dict[str, bool]

    @property
    def names(self) -> list[str]:
        return [*self.edges, *self.labels]

    @property
    def width(self) -> int:
        return 2 + max([1, *[len(x) for x in self.edges.values()], *[len(x) for x in self.labels.values()]])

    def inputs(self) -> list[Column]:
        """What ``matrix`` reads of a row: numbers, and the bins of categories."""
        numbers = [F.col(c).cast("double") for c in self.edges]
        return [c.alias(f"_x{i}") for i, c in enumerate([*numbers, *map(self._category, self.labels)])]

    def matrix(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """The bins of ``inputs``, a line of the array for each of them."""
        out = np.empty((len(columns), len(columns[0])), np.uint8 if self.width <= 256 else np.int32)
        for i, edges in enumerate(self.edges.values()):
            v = columns[i]
            out[i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(edges, np.float64), v))
        for i in range(len(self.edges), len(columns)):
            out[i] = columns[i]
        return out

    def vector(self) -> Column:
        """What trees of thresholds look at."""
        return vector_of(map(F.col, self.edges), map(self._category, self.labels))

    def _number(self, name: str, column: str) -> Column:
        edges = ",".join(map(repr, self.edges[name]))
        below = f"size(filter(cast(split('{edges}', ',') as array<double>), e -> e < v))" if edges else "0"
        # The value is the argument of a lambda, so what it is computed from runs once, not for every threshold.
        return F.expr(
            f"element_at(transform(array(cast(`{column}` as double)), v -> if(v is null or isnan(v), 0, 1 + {below})), 1)")

    def _category(self, name: str) -> Column:
        labels = self.labels[name]
        if not labels:
            return F.lit(0)
        place = F.coalesce(F.array_position(F.array(*map(F.lit, labels)), F.col(name).cast("string")), F.lit(0)).cast("int")
        rest = len(labels) + 1 if self.overflow[name] else 0
        return F.when(F.col(name).isNull(), 0).when(place == 0, rest).otherwise(place)


def fit_bins(df: DataFrame, numbers: Sequence[str], categories: Sequence[str] = (), bins: int = 64, labels: int = 254) -> Bins:
    """Quantiles of the values that are numbers, in one aggregate, and the most frequent labels."""
    shares = [i / bins for i in range(1, bins)]
    finite = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numbers}
    found = df.agg(*[F.percentile_approx(v, shares, 10_000).alias(c) for c, v in finite.items()]).first() if numbers else {}
    edges = {c: sorted({x for x in found[c] or [] if math.isfinite(x)}) for c in numbers}
    kept, over = {}, {}
    top = _frequent_labels(df, categories, labels + 1) if categories else {}
    for c in categories:
        over[c] = len(top[c]) > labels
        kept[c] = sorted(top[c][:labels])
    return Bins(edges, kept, over)


def _frequent_labels(df: DataFrame, categories: Sequence[str], n: int) -> dict[str, list[str]]:
    """The ``n`` most frequent labels of each column, most frequent first; all columns are counted in one pass."""
    cells = F.inline(F.array(*[
        F.struct(F.lit(i).alias("at"), F.col(c).cast("string").alias("label")) for i, c in enumerate(categories)]))
    counts = df.select(cells).where("label is not null").groupBy("at", "label").count()
    place = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("count"), "label"))
    rows = counts.withColumn("place", place).where(F.col("place") <= n).orderBy("at", "place").collect()
    return {c: [r["label"] for r in rows if r["at"] == i] for i, c in enumerate(categories)}


# ---- trees


@dataclass
class Tree:
    """Nodes as parallel lists; ``left`` is -1 at leaves, the right child follows the left one."""

    feature: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    mask: list[str] = field(default_factory=list)  # a '1' for each bin that goes left
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    gradient: list[float] = field(default_factory=list)
    hessian: list[float] = field(default_factory=list)
    depth: int = 0


def walk(trees: Sequence[Tree], result: str, bins: str = "_bins") -> str:
    """SQL: the node that a row of bins reaches in one tree, or the sum of all trees' leaf values.

    The trees are constant arrays, so the plan has the same size for any number of them.
    """
    feature, left, mask, value, roots = [], [], [], [], []
    for t in trees:
        at = len(feature)
        roots.append(at)
        feature += t.feature
        left += [x + at if x >= 0 else -1 for x in t.left]
        mask += t.mask
        value += t.value

    def constant(values, kind):
        return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"

    f, l, m = constant(feature, "int"), constant(left, "int"), constant(mask, "string")
    step = f"{l}[n] + if(substr({m}[n], {bins}[{f}[n]] + 1, 1) = '1', 0, 1)"
    steps = f"sequence(1, {max([1, *[t.depth for t in trees]])})"
    if result == "node":
        return f"aggregate({steps}, 0, (n, i) -> if({l}[n] < 0, n, {step}))"
    node = f"aggregate({steps}, r, (n, i) -> if({l}[n] < 0, n, {step}))"
    return f"aggregate({constant(roots, 'int')}, 0D, (s, r) -> s + {constant(map(repr, value), 'double')}[{node}])"


def _flat(t: Tree, bins: Bins) -> Flat:
    """The tree with the thresholds of its bins."""
    edges, width = list(bins.edges.values()), bins.width
    place, goes_left, categories = [], [], []
    for f, left, mask in zip(t.feature, t.left, t.mask, strict=True):
        if left < 0:
            at, values, n = -1, [], -1
        elif f < len(edges):
            last = mask.rfind("1", 1)  # of numbers, the bins up to it go left
            cut = math.nan if last < 1 else math.inf if last > len(edges[f]) else edges[f][last - 1]
            (at, values), n = number_split(f, cut, mask[0] == "1"), -1
        else:
            at, values, n = len(edges) * (COPIES - 1) + f, [float(k) for k, c in enumerate(mask) if c == "1"], width
        place.append(at)
        goes_left.append(values)
        categories.append(n)
    return Flat(t.left, place, goes_left, categories, t.value)


class Walk:
    """``walk`` on arrays of bins. A leaf is its own left child and sends every bin there."""

    def __init__(self, trees: Sequence[Tree], width: int):
        self.width, self.steps, self.trees = width, [t.depth for t in trees], []
        for t in trees:
            left = np.array(t.left, np.int64)
            leaf = left < 0
            goes_right = np.zeros((len(left), width), np.int64)
            for i in np.flatnonzero(~leaf):
                goes_right[i] = 1
                goes_right[i, :len(t.mask[i])] = np.frombuffer(t.mask[i].encode(), np.uint8) != ord("1")
            left[leaf] = np.flatnonzero(leaf)
            self.trees.append((np.array(t.feature, np.int64), left, goes_right.ravel(), np.array(t.value, np.float64)))

    def node(self, bins: np.ndarray, number: int = 0) -> np.ndarray:
        feature, left, goes_right, _ = self.trees[number]
        n = bins.shape[1]
        row, flat, at = np.arange(n), bins.ravel(), np.zeros(n, np.int64)
        for _ in range(self.steps[number]):
            at = left[at] + goes_right[at * self.width + flat[feature[at] * n + row]]
        return at

    def value(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros(bins.shape[1])
        for number, (*_, value) in enumerate(self.trees):
            total += value[self.node(bins, number)]
        return total


@dataclass
class _Node:
    depth: int
    hist: np.ndarray  # features x bins x (gradient, hessian)
    split: tuple | None = None
    children: tuple[int, int] | None = None

    @property
    def total(self) -> np.ndarray:
        return self.hist[0].sum(axis=0)


def best_split(hist: np.ndarray, categorical: np.ndarray, allowed: np.ndarray, p: Params) -> tuple | None:
    """(gain, feature, mask of bins that go left) of the best split of a node, None if none gains enough."""
    sums = hist[:, 1:]
    g, h = hist[0].sum(axis=0)
    least = max(p.min_child, 1e-9)
    if h < least:  # nor has either side as much
        return None
    order = np.tile(np.arange(sums.shape[1]), (len(hist), 1))
    if categorical.any():
        ratio = sums[categorical, :, 0] / (sums[categorical, :, 1] + 1e-9)
        order[categorical] = np.argsort(ratio, axis=1, kind="stable")
    ordered = np.take_along_axis(sums, order[:, :, None], axis=1)
    left = np.concatenate([np.zeros((len(hist), 1, 2)), np.cumsum(ordered, axis=1)], axis=1)
    sides = np.stack([left, left + hist[:, :1]])  # missing ones right, left
    gl, hl = sides[..., 0], sides[..., 1]
    gr, hr = g - gl, h - hl
    gain = gl ** 2 / (hl + p.l2 + 1e-12) + gr ** 2 / (hr + p.l2 + 1e-12) - g ** 2 / (h + p.l2 + 1e-12)
    gain = np.where((hl >= least) & (hr >= least) & allowed[None, :, None], gain, -np.inf)
    side, f, k = np.unravel_index(np.argmax(gain), gain.shape)
    best = float(gain[side, f, k])
    if not best > max(p.min_gain, 1e-9):
        return None
    goes_left = np.zeros(hist.shape[1], bool)
    goes_left[order[f, :k] + 1] = True
    # Where a node has no missing value, a later one goes with most rows.
    goes_left[0] = bool(side) if hist[f, 0, 1] > 0 else bool(hl[side, f, k] >= hr[side, f, k])
    return best, int(f), goes_left


def _text(goes_left: np.ndarray) -> str:
    return (goes_left.astype(np.uint8) + ord("0")).tobytes().decode()


def _assembled(nodes: list[_Node], split: set[int], rate: float, l2: float) -> Tree:
    """The tree in which exactly these nodes are split, numbered from the root down."""
    t, queue, numbered = Tree(), [0], 1
    for i in queue:  # grows while it is read
        node = nodes[i]
        g, h = (float(x) for x in node.total)
        inner = i in split
        gain, feature, goes_left = node.split if inner else (0.0, 0, np.zeros(0, bool))
        t.feature.append(feature)
        t.left.append(numbered if inner else -1)
        t.mask.append(_text(goes_left))
        t.gain.append(gain)
        t.value.append(-g / (h + l2 + 1e-12) * rate)
        t.gradient.append(g)
        t.hessian.append(h)
        t.depth = max(t.depth, node.depth)
        if inner:
            numbered += 2
            queue += node.children
    return t


def _chosen(nodes: list[_Node], p: Params) -> tuple[set[int], set[int]]:
    """(splits that the tree has so far, nodes whose children must be known to go on)."""
    if p.leaves is None:
        split = {i for i, n in enumerate(nodes) if n.children}
        return split, {i for i, n in enumerate(nodes) if n.split and not n.children and n.depth < p.depth}
    heap = [(-nodes[0].split[0], 0)] if nodes[0].split and p.depth > 0 else []
    split: set[int] = set()
    while heap and len(split) < p.leaves - 1:
        _, i = heap[0]
        if nodes[i].children is None:  # every open leaf may be next; those that can't be reached any more aren't needed
            room = p.leaves - 1 - len(split)
            return split, {j for _, j in heapq.nsmallest(room, heap) if nodes[j].children is None}
        heapq.heappop(heap)
        split.add(i)
        for c in nodes[i].children:
            if nodes[c].split and nodes[c].depth < p.depth:
                heapq.heappush(heap, (-nodes[c].split[0], c))
    return split, set()


class _Grower:
    """Grows one tree on the present gradients of ``rows``."""

    def __init__(self, rows: _Rows | _Blocks, p: Params, number: int):
        self.rows, self.p, self.number = rows, p, number
        names = rows.bins.names
        self.categorical = np.array([c in rows.bins.labels for c in names])
        chance = random.Random(p.seed * 1_000_003 + number)
        n = len(names)
        kept = chance.sample(range(n), max(1, round(p.columns * n)))
        self.allowed = np.isin(np.arange(n), kept)

    def _sums(self, tree: Tree | None, wanted: Sequence[int], loss: bool) -> tuple[dict[int, np.ndarray], tuple[float, float]]:
        """Sums by feature and bin for the wanted nodes of ``tree`` (None: the root), and with ``loss`` (loss, weight)
        of the rows for validation."""
        return self.rows.sums(tree, wanted, loss, self.number, self.p, self.allowed)

    def grow(self) -> tuple[Tree, tuple[float, float]]:
        """(the tree, loss and weight of the rows for validation before it)."""
        p = self.p
        found, measured = self._sums(None, [0], loss=True)
        nodes = [self._node(0, found[0])]
        while True:
            split, open_ = _chosen(nodes, p)
            if not open_:
                return _assembled(nodes, split, p.rate, p.l2), measured
            lighter = {}
            for i in sorted(open_):
                n = nodes[i]
                gain, f, goes_left = n.split
                n.children = len(nodes), len(nodes) + 1
                h_left = n.hist[f, goes_left, 1].sum()
                lighter[n.children[int(h_left > n.total[1] - h_left)]] = i
                nodes += [self._node(n.depth + 1, None), self._node(n.depth + 1, None)]
            every = {i for i, n in enumerate(nodes) if n.children}
            tree, place = self._routes(nodes, every)
            found, _ = self._sums(tree, [place[c] for c in lighter], loss=False)
            for c, i in lighter.items():
                a, b = nodes[i].children
                other = b if c == a else a
                nodes[c].hist = found[place[c]]
                nodes[other].hist = nodes[i].hist - nodes[c].hist
                for x in (c, other):
                    nodes[x].split = best_split(nodes[x].hist, self.categorical, self.allowed, p)

    def _node(self, depth: int, hist: np.ndarray | None) -> _Node:
        return _Node(depth, hist, None if hist is None else best_split(hist, self.categorical, self.allowed, self.p))

    @staticmethod
    def _routes(nodes: list[_Node], split: set[int]) -> tuple[Tree, dict[int, int]]:
        """A tree that only routes, and where each node is in it."""
        t, queue, numbered = Tree(), [0], 1
        for i in queue:
            n = nodes[i]
            inner = i in split
            t.feature.append(n.split[1] if inner else 0)
            t.left.append(numbered if inner else -1)
            t.mask.append(_text(n.split[2]) if inner else "")
            t.value.append(0.0)
            t.depth = max(t.depth, n.depth)
            if inner:
                numbered += 2
                queue += n.children
        return t, {i: k for k, i in enumerate(queue)}


# ---- objectives


def logistic_gradients(state: DataFrame) -> DataFrame:
    p = 1 / (1 + F.exp(-F.col("_margin")))
    sign = F.when(F.col("_y") > 0.5, -F.col("_margin")).otherwise(F.col("_margin"))
    loss = F.greatest(sign, F.lit(0.0)) + F.log1p(F.exp(-F.abs("_margin")))  # stable for large margins
    return state.withColumns({"_g": p - F.col("_y"), "_h": p * (1 - p), "_loss": loss, "_weight": F.lit(1.0)})


def _discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1.0)


def ranking_gradients(state: DataFrame, scan: KeyScan) -> DataFrame:
    """Listwise gradients of each group, weighted by the NDCG that a better order would add.

    With p the softmax of the margins within the group and t a row's share of the group's gain, the gradient is
    w * (p - t) and the hessian w * p * (1 - p); w is 1 - NDCG of the present order. All of it are sums and ranks of the
    group, one row per runner; a group above the split size is summed before it is joined and ranked in chunks.
    """
    ranked = positions(state, ["_group"], [F.desc("_margin"), F.col("_row")], "_rank", scan)
    gain = F.pow(F.lit(2.0), F.col("_y")) - 1
    ranked = ranked.withColumn("_dcg", gain * _discount(F.col("_rank")))
    if scan.hot(["_group"]) is None:
        group = Window.partitionBy("_group")
        top = ranked.withColumn("_top", F.max("_margin").over(group))
        summed = top.withColumn("_e", F.exp(F.col("_margin") - F.col("_top"))).withColumns({
            "_sum_e": F.sum("_e").over(group), "_sum_dcg": F.sum("_dcg").over(group)})
    else:
        tops = ranked.groupBy("_group").agg(F.max("_margin").alias("_top"))
        top = match(ranked, tops, ["_group"]).withColumn("_e", F.exp(F.col("_margin") - F.col("_top")))
        sums = top.groupBy("_group").agg(F.sum("_e").alias("_sum_e"), F.sum("_dcg").alias("_sum_dcg"))
        summed = match(top, sums, ["_group"])
    p, worse = F.col("_e") / F.col("_sum_e"), 1 - F.col("_sum_dcg") / F.col("_ideal")
    # A group in perfect order keeps a little weight, so that its margins don't drift.
    w = F.greatest(worse, F.lit(0.01))
    first = F.col("_rank") == 1  # the loss of a group is counted at one of its rows
    return summed.withColumns({
        "_g": w * (p - gain / F.col("_gain")), "_h": w * p * (1 - p),
        "_loss": F.when(first, worse).otherwise(0.0), "_weight": F.when(first, 1.0).otherwise(0.0),
    }).drop("_rank", "_dcg", "_top", "_e", "_sum_e", "_sum_dcg")


def logistic_arrays(block: Block) -> Block:
    """``logistic_gradients`` on arrays; of the loss and weight, the sums of the rows for validation."""
    m, y = block["margin"], block["y"]
    small = np.exp(-np.abs(m))
    p = np.where(m >= 0, 1 / (1 + small), small / (1 + small))
    loss = np.maximum(np.where(y > 0.5, -m, m), 0.0) + np.log1p(small)
    valid = block["valid"]
    return {**block, "g": p - y, "h": p * (1 - p), "measured": np.array([loss[valid].sum(), valid.sum()])}


def ranking_arrays(block: Block) -> Block:
    """``ranking_gradients`` on arrays; ``starts`` are the first rows of the block's groups."""
    m, starts = block["margin"], block["starts"]
    group = _numbered(starts, len(m))
    dcg = block["gain"] / np.log2(_ranks(group, starts, -m, block["row"]) + 1.0)
    e = np.exp(m - np.maximum.reduceat(m, starts)[group])
    p = e / np.add.reduceat(e, starts)[group]
    worse = 1 - np.add.reduceat(dcg, starts) / block["ideal"]
    w = np.maximum(worse, 0.01)[group]
    valid = block["valid"][starts]
    return {**block, "g": w * (p - block["share"]), "h": w * p * (1 - p), "measured": np.array([worse[valid].sum(), valid.sum()])}


def _numbered(starts: np.ndarray, n: int) -> np.ndarray:
    """The group of every row."""
    return np.repeat(np.arange(len(starts)), np.diff(starts, append=n))


def _ranks(group: np.ndarray, starts: np.ndarray, key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places from 1 in the group, by rising key."""
    order = np.lexsort((row, key, group))
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - starts[group] + 1  # groups are in order already
    return out


# ---- rows


class _Rows:
    """A table of rows with bins and margins; gradients are columns and sums Spark's."""

    def __init__(self, state: DataFrame, bins: Bins, gradients):
        self.state, self.bins, self.gradients, self.number = state, bins, gradients, 0
        self.rows = gradients(state).persist(StorageLevel.MEMORY_AND_DISK)

    def step(self, tree: Tree) -> None:
        """Adds the tree to the margins."""
        self.number += 1
        columns = self.state.columns
        state = self.rows.withColumn("_margin", F.col("_margin") + F.expr(walk([tree], "value"))).select(*columns)
        self.state = cut_lineage(state) if self.number % CHECKPOINT_EVERY == 0 else state
        before, self.rows = self.rows, self.gradients(self.state).persist(StorageLevel.MEMORY_AND_DISK)
        self.rows.count()
        before.unpersist()

    def close(self) -> None:
        self.rows.unpersist()

    def sums(self, tree, wanted, loss, number, p, allowed):
        own = F.transform("_bins", lambda b, i: F.struct(
            i.cast("int").alias("f"), b.alias("b"), F.col("_g").alias("g"), F.col("_h").alias("h")))
        rows = self.rows.withColumn("_node", F.expr(walk([tree], "node")) if tree else F.lit(0))
        sampled = F.lit(True) if p.rows >= 1 else drawn(F.col("_lot"), F.col("_step"), number) < round(p.rows * LOTS)
        use = ~F.col("_valid") & sampled & F.col("_node").isin(list(wanted))
        if loss:
            none = F.array(F.struct(F.lit(-1).alias("f"), F.lit(0).alias("b"), F.col("_loss").alias("g"), F.col("_weight").alias("h")))
            cells, use = F.when(F.col("_valid"), none).otherwise(own), use | F.col("_valid")
        else:
            cells = own
        table = rows.where(use).select("_node", F.inline(cells)).groupBy("_node", "f", "b").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        node_, f, b, g, h = (table.column(c).to_numpy() for c in ("_node", "f", "b", "g", "h"))
        out, measured = {}, (0.0, 0.0)
        if loss and (f < 0).any():
            measured = float(g[f < 0].sum()), float(h[f < 0].sum())
        for i in wanted:
            mine = (node_ == i) & (f >= 0)
            out[i] = np.zeros((len(self.bins.names), self.bins.width, 2))
            out[i][f[mine], b[mine]] = np.stack([g[mine], h[mine]], axis=1)
        return out, measured


class _Blocks:
    """Blocks of bins, labels and margins; gradients are arrays and sums the tasks'."""

    def __init__(self, blocks: RDD | Held, bins: Bins, gradients):
        self.bins, self.gradients, self.number = bins, gradients, 0
        self.given = blocks
        self.blocks = blocks.map(gradients).persist(StorageLevel.MEMORY_AND_DISK)
        self.before: RDD | None = None
        self.marked: RDD | None = None
        self.kept: str | None = None

    def few(self) -> bool:
        """Whether one task can hold all rows, and doesn't yet."""
        return not isinstance(self.given, Held) and row_count(self.given) <= HELD_ROWS

    def in_one_task(self, p: Params, objective: str, base: float) -> Boosted:
        """The model, grown by one task on all rows. Its trees are those of the passes, up to the order of sums."""
        bins, gradients = self.bins, self.gradients

        def grow(part: Iterator[Block]) -> Iterator[Boosted]:
            yield _grown(_Blocks(Held(list(part), joined), bins, gradients), p, objective, base)

        found = self.given.coalesce(1).mapPartitions(grow).collect()
        return found[0] if found else _grown(_Blocks(Held([]), bins, gradients), p, objective, base)

    def step(self, tree: Tree) -> None:
        """Adds the tree to the margins."""
        gradients, added = self.gradients, Walk([tree], self.bins.width)
        self.number += 1

        def grown(block: Block) -> Block:
            return gradients({**block, "margin": block["margin"] + added.value(block["bins"])})

        self.before, self.blocks = self.blocks, self.blocks.map(grown).persist(StorageLevel.MEMORY_AND_DISK)
        if self.number % BLOCKS_CHECKPOINT_EVERY == 0 and not isinstance(self.blocks, Held):
            self.blocks.checkpoint()
            self.marked = self.blocks

    def _drop_old(self) -> None:
        """Once a checkpoint is written nothing reads the one before, which may be as large as the rows."""
        if self.marked is None or not self.marked.isCheckpointed():
            return
        old, self.kept, spark = self.kept, self.marked.getCheckpointFile(), self.marked.ctx
        self.marked = None
        if old:
            there = spark._jvm.org.apache.hadoop.fs.Path(old)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)

    def close(self) -> None:
        self.blocks.unpersist()

    def sums(self, tree, wanted, loss, number, p, allowed):
        width, n_inputs = self.bins.width, len(allowed)
        counted = [f for f in range(n_inputs) if allowed[f] or f == 0]  # input 0 also gives the sums of the node
        route = Walk([tree], width) if tree else None
        slots = np.full(len(tree.left) if tree else 1, -1)
        slots[list(wanted)] = np.arange(len(wanted))
        cells, bound = len(wanted) * width, round(p.rows * LOTS)

        def work(block: Block) -> dict[int, np.ndarray]:
            use = ~block["valid"]
            if p.rows < 1:
                use &= drawn(block["lot"], block["step"], number) < bound
            slot = slots[route.node(block["bins"])] if route else np.zeros(len(use), np.int64)
            rows = np.flatnonzero(use & (slot >= 0))
            at, g, h = slot[rows] * width, block["g"][rows], block["h"][rows]
            found = np.zeros((len(wanted), n_inputs, width, 2))
            for f in counted:
                cell = at + block["bins"][f][rows]
                for k, x in enumerate((g, h)):
                    found[:, f, :, k] = np.bincount(cell, x, cells).reshape(len(wanted), width)
            out = dict(zip(wanted, found, strict=True))
            return {**out, -1: block["measured"]} if loss else out

        found = combined(self.blocks, work, cells * n_inputs * 16)
        if self.before:  # the pass has made the present blocks
            self.before.unpersist()
            self.before = None
            self._drop_old()
        none = np.zeros((n_inputs, width, 2))
        measured = tuple(map(float, found.get(-1, (0.0, 0.0))))
        return {i: found.get(i, none) for i in wanted}, measured


# ---- models


@dataclass(frozen=True)
class Boosted:
    """Bins and trees. ``losses`` are those of the validation rows after 0, 1, 2 ... trees, as far as trees were grown."""

    bins: Bins
    trees: tuple[Tree, ...]
    base: float
    objective: str
    losses: tuple[float, ...] = ()

    def margin(self, df: DataFrame, name: str) -> DataFrame:
        if "_scorer" not in self.__dict__:
            trees = [_flat(t, self.bins) for t in self.trees]
            object.__setattr__(self, "_scorer", Scorer(trees, len(self.bins.edges) * COPIES + len(self.bins.labels)))
        return self._scorer.add(df, self.bins.vector(), name).withColumn(name, F.lit(self.base) + F.col(name))

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        """The given columns and the probability; of a ranker, a number from 0 to 1 that orders a group."""
        return self.margin(df, name).withColumn(name, 1 / (1 + F.exp(-F.col(name))))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node: what it splits on, where missing values go, its sums and, at leaves, the value."""
        rows, names = [], self.bins.names
        for number, t in enumerate(self.trees):
            for i, left in enumerate(t.left):
                name = names[t.feature[i]] if left >= 0 else None
                threshold = None
                if name in self.bins.edges:
                    last = t.mask[i].rfind("1", 1)
                    threshold = self.bins.edges[name][last - 1] if 0 < last <= len(self.bins.edges[name]) else None
                rows.append((
                    number, i, name, threshold, t.mask[i][0] == "1" if left >= 0 else None, left if left >= 0 else None,
                    t.gain[i], t.gradient[i], t.hessian[i], None if left >= 0 else t.value[i]))
        return spark.createDataFrame(rows, (
            "tree int, node int, feature string, threshold double, missing_left boolean, left int, gain double, "
            "gradient double, hessian double, value double"))

    def importance(self, spark: SparkSession, n: int = 10) -> DataFrame:
        """Gain and number of splits of the ``n`` features with the largest gain."""
        total = {c: [0.0, 0] for c in self.bins.names}
        for t in self.trees:
            for f, left, gain in zip(t.feature, t.left, t.gain, strict=True):
                if left >= 0:
                    total[self.bins.names[f]][0] += gain
                    total[self.bins.names[f]][1] += 1
        rows = [(c, gain, splits) for c, (gain, splits) in total.items()]
        table = spark.createDataFrame(rows, "feature string, gain double, splits long")
        return table.orderBy(F.desc("gain"), "feature").limit(n)

    def save(self, spark: SparkSession, path: str) -> None:
        head = {"bins": asdict(self.bins), "base": self.base, "objective": self.objective, "losses": self.losses}
        lines = [(-1, json.dumps(head)), *[(i, json.dumps(asdict(t))) for i, t in enumerate(self.trees)]]
        spark.createDataFrame(lines, "tree int, json string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        first, *rest = [json.loads(r["json"]) for r in spark.read.parquet(path).orderBy("tree").collect()]
        return cls(Bins(**first["bins"]), tuple(Tree(**t) for t in rest), first["base"], first["objective"],
                   tuple(first["losses"]))


def _boost(rows: _Rows | _Blocks, p: Params, objective: str, base: float) -> Boosted:
    return rows.in_one_task(p, objective, base) if isinstance(rows, _Blocks) and rows.few() else _grown(rows, p, objective, base)


def _grown(rows: _Rows | _Blocks, p: Params, objective: str, base: float) -> Boosted:
    trees: list[Tree] = []
    losses: list[float] = []
    while True:
        number = len(trees)
        tree, (loss, weight) = _Grower(rows, p, number).grow()
        if weight:
            losses.append(loss / weight)
            best = int(np.argmin(losses))
            if number - best >= p.patience:
                break
        if number == p.trees or len(tree.left) == 1:
            break
        trees.append(tree)
        rows.step(tree)
    rows.close()
    kept = int(np.argmin(losses)) if losses else len(trees)
    return Boosted(rows.bins, tuple(trees[:kept]), base, objective, tuple(losses))


def _valid(train: DataFrame, share: float) -> DataFrame:
    from formlake.ml.train import _holdout  # which needs this module itself

    return _holdout(train, share)


def train_boosted_trees(
    train: DataFrame, features: Sequence[str] = tuple(schema.BASE_FEATURES), categories: Sequence[str] = tuple(schema.CATEGORIES),
    label: str = LABEL, params: Params = Params(), holdout: float = 0.1,
) -> Boosted:
    """Log-loss on a label of 0 and 1. The newest ``holdout`` of the days only decide when to stop; with 0 all trees grow."""
    return train_boosted_models(train, [params], features, categories, label, holdout)[0]


def train_boosted_models(
    train: DataFrame, models: Sequence[Params], features: Sequence[str] = tuple(schema.BASE_FEATURES),
    categories: Sequence[str] = tuple(schema.CATEGORIES), label: str = LABEL, holdout: float = 0.1,
) -> list[Boosted]:
    """``train_boosted_trees`` for each of the parameters. Those with equal bins and seed grow on the same blocks, which are
    made once. Where rows are few, a model is the work of one task, so all are grown side by side."""
    marked = _valid(train.where(F.col(label).isNotNull()), holdout)
    share = marked.where("not _valid").agg(F.avg(F.col(label).cast("double"))).first()[0]
    share = min(max(share or 0.5, 1e-6), 1 - 1e-6)
    base = math.log(share / (1 - share))
    binned: dict[tuple[int, int], Bins] = {}
    blocks: dict[tuple[int, int, int | None], RDD] = {}
    rows = []
    for p in models:
        cut = p.bins, p.categories
        same = *cut, p.seed if p.rows < 1 else None
        if cut not in binned:
            binned[cut] = fit_bins(marked.where("not _valid"), features, categories, *cut)
        if same not in blocks:
            blocks[same] = _row_blocks(marked, binned[cut], label, same[-1], base)
        rows.append(_Blocks(blocks[same], binned[cut], logistic_arrays))
    side_by_side = len(models) if rows and rows[0].few() else 1
    with ThreadPoolExecutor(max(1, side_by_side)) as pool:
        boost = inheritable_thread_target(train.sparkSession)(_boost)
        return list(pool.map(lambda r, p: boost(r, p, "logistic", base), rows, models))


def _row_blocks(marked: DataFrame, bins: Bins, label: str, seed: int | None, base: float) -> RDD:
    """Without a seed rows have no lots, as all of them are used. The first margins are the same for all, so they aren't stored."""
    state = marked.select(*bins.inputs(), F.col(label).cast("double").alias("_y"), "_valid")
    if seed is not None:
        state = state.withColumn("_row", F.monotonically_increasing_id()).select("*", *lots("_row", seed))
    stored = to_blocks(state, lambda block: _arrays(block, bins))
    return stored.map(lambda block: {**block, "margin": np.full(len(block["y"]), base)})


def _arrays(block: Block, bins: Bins) -> Block:
    drawn_by = {name: block[f"_{name}"] for name in ("lot", "step") if f"_{name}" in block}
    return {
        "bins": bins.matrix([block[f"_x{i}"] for i in range(len(bins.names))]), "y": block["_y"], "valid": block["_valid"].astype(bool),
        **drawn_by}


def train_listwise_ranker(
    train: DataFrame, group: Sequence[str] = tuple(schema.RACE_KEY), features: Sequence[str] = tuple(schema.BASE_FEATURES),
    categories: Sequence[str] = tuple(schema.CATEGORIES), label: str = LABEL, params: Params = Params(), holdout: float = 0.1,
) -> Boosted:
    """Learns the order within each group. ``label`` is a relevance from 0 up; rows without a whole group key, and
    groups without a relevant row, teach nothing. Validation is by NDCG of whole groups (of whole days)."""
    used = list(dict.fromkeys([*group, *features, *categories, label, "date"]))
    rows = train.where(F.col(label).isNotNull()).dropna(subset=list(group)).select(*used).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        marked = _valid(rows, holdout)
        bins = fit_bins(marked.where("not _valid"), features, categories, params.bins, params.categories)
        state = marked.select(
            F.monotonically_increasing_id().alias("_row"), *bins.inputs(), F.col(label).cast("double").alias("_y"),
            "_valid", F.struct(*group, "_valid").alias("_group"))
        state = state.select("*", *lots("_row", params.seed))
        scan = KeyScan(state)
        if scan.hot(["_group"]) is None:
            known = _Blocks(_group_blocks(state, bins, scan.rows), bins, ranking_arrays)
        else:
            known = _split_groups(state, bins)
    finally:
        rows.unpersist()
    return _boost(known, params, "ranking", 0.0)


def _group_blocks(state: DataFrame, bins: Bins, n_rows: int) -> RDD:
    """Blocks of whole groups; those without a relevant row are left out."""
    place = F.row_number().over(Window.partitionBy("_group").orderBy("_row"))
    state = dealt(state, ["_group"], n_rows).withColumn("_first", place == 1).drop("_group")

    def make(block: Block) -> Block:
        gain = np.power(2.0, block["_y"]) - 1
        starts = np.flatnonzero(block["_first"])
        total = np.add.reduceat(gain, starts)
        kept = total > 0
        rows = np.repeat(kept, np.diff(starts, append=len(gain)))
        block, gain = {k: v[rows] for k, v in block.items()}, gain[rows]
        starts = np.flatnonzero(block["_first"])
        group = _numbered(starts, len(gain))
        best = gain / np.log2(_ranks(group, starts, -block["_y"], block["_row"]) + 1.0)
        return {
            **_arrays(block, bins), "row": block["_row"], "starts": starts, "margin": np.zeros(len(gain)), "gain": gain,
            "share": gain / total[kept][group], "ideal": np.add.reduceat(best, starts) if len(starts) else best}

    return to_blocks(state, make, "_first").filter(lambda block: len(block["starts"]) > 0)


def _split_groups(state: DataFrame, bins: Bins) -> _Rows:
    """Over-full groups are ranked in chunks, so the rows stay a table."""
    inputs = [f"_x{i}" for i in range(len(bins.names))]
    # The bins of categories are there; those of numbers are computed from the inputs.
    numbers = [bins._number(c, x) for c, x in zip(bins.edges, inputs, strict=False)]
    binned = F.array(*numbers, *inputs[len(numbers):])
    state = cut_lineage(state.withColumns({"_bins": binned, "_margin": F.lit(0.0)}).drop(*inputs))
    scan = KeyScan(state)
    gain = F.pow(F.lit(2.0), F.col("_y")) - 1
    ideal = positions(state, ["_group"], [F.desc("_y"), F.col("_row")], "_best", scan)
    totals = ideal.groupBy("_group").agg(
        F.sum(gain).alias("_gain"), F.sum(gain * _discount(F.col("_best"))).alias("_ideal")).where("_gain > 0")
    # Dealt by group once: the windows of every tree find the rows where they are.
    state = cut_lineage(match(state, totals, ["_group"], "inner").repartition("_group"))
    return _Rows(state, bins, lambda s: ranking_gradients(s, scan))
