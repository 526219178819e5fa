"""Gradient-boosted trees grown leaf by leaf on histograms, distributed over Spark.

Rows are binned once: numbers at up to ``max_bin`` - 1 quantile edges of the train rows, categories by their train levels, and
missing or unseen values in a bin of their own. Rows are kept as blocks of numpy arrays, dealt evenly to the partitions. A job
sums, for the leaves that are asked for, gradient, curvature and count of every bin of every feature; partitions are summed in a
tree, so what reaches the driver is bounded by leaves x features x bins and not by rows.

The leaf with the largest gain is split next, until there are ``leaves``. The children of all large leaves that can still
be split are summed in one job, the smaller child of each alone (its sibling is what is left of the parent), a level at a time.
Small leaves wait until no large one is left, or some levels more than halving would take have passed; then all of them are split
to their end in one shuffle, each in one task, and their splits wait for their turn. Splits do not depend on each other, so this
gives the tree that one job for each split would give, in a few jobs a round. Numbers split at an edge, with missing values on the
side of the larger gain; categories split into a set and the rest by the order of their mean gradients, missing and unseen ones
outside the set.

Every round bags rows by a hash of their key and draws features by a seed. Boosting ends when the AUC of the
validation rows has not improved for ``patience`` rounds, and keeps the best round. The AUC is exact over margins of 12
significant bits, summed in the same job as the next root histogram.

This is the one place that uses an RDD: a round updates the margins inside cached blocks and reads them some ten
times, which a DataFrame would plan anew each time. Blocks are checkpointed every ``CUT`` rounds, so a lost executor costs
the rounds since then.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.operators.shap import Tree, matrix
from contrail.session import checkpoint_dir

#: FIXED VALUES: learning settings.
PARAMS = dict(rate=0.05, leaves=63, min_rows=200, feature_share=0.8, row_share=0.8, rounds=3000, patience=100, max_bin=255,
              min_curvature=1e-3, cat_smooth=10.0, cat_l2=10.0, seed=42)
CUT = 25
#: Rows of a partition where there are cores for more partitions, and at most (33 bytes a row); rows of a block where there are several partitions.
ROWS_PER_PART, MOST_PER_PART, ROWS_PER_BLOCK = 65_536, 2**22, 2**15
#: Rows of a leaf that one task splits to its end at most (32 bytes a row), and where all cores have leaves.
GATHER, LEAST_GATHER = 2**21, 2**19


@dataclass
class Bins:
    """How values become bin numbers; the last bin, ``missing``, is the same for all features."""
    features: list[str]
    levels: dict[str, list[str]]  # of each categorical feature
    edges: dict[str, list[float]]  # of each numeric feature, rising; a bin ends at its edge

    @property
    def missing(self) -> int:
        return max([len(v) for v in self.levels.values()] + [len(e) + 1 for e in self.edges.values()] + [1])

    def codes(self, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        out = np.full((batch.num_rows, len(self.features)), self.missing, np.int32)
        for j, f in enumerate(self.features):
            if f in self.levels:
                at = pc.index_in(batch.column(f).cast(pa.string()), pa.array(self.levels[f], pa.string()))
                out[:, j] = pc.fill_null(at, self.missing).to_numpy(zero_copy_only=False)
            else:
                x = pc.fill_null(batch.column(f).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
                out[:, j] = np.where(np.isnan(x), self.missing, np.searchsorted(self.edges[f], x))
        return out


def learn_bins(train: DataFrame, cats: list[str], nums: list[str], max_bin: int) -> Bins:
    """Levels and quantile edges of the train rows; few distinct numbers are all edges. One pass finds the distinct values of all
    features, as far as they count, and one the quantiles of all others."""
    values = train.select(*[F.col(c).cast("string").alias(c) for c in cats], *[F.col(c).cast("double").alias(c) for c in nums])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set] = [set() for _ in (*cats, *nums)]
        for b in batches:
            for j, known in enumerate(seen):
                if j < len(cats):
                    known.update(pc.unique(b.column(j).drop_null()).to_pylist())
                elif len(known) <= max_bin:
                    x = b.column(j).drop_null().to_numpy(zero_copy_only=False) + 0.0  # no minus zero
                    known.update(np.unique(x[~np.isnan(x)]).tolist())
        for j, known in enumerate(seen):
            kept = list(known)[:None if j < len(cats) else max_bin + 1]  # more numbers than bins are counted alone
            of = [[None] * len(kept), [None] * len(kept)]
            of[j >= len(cats)] = kept
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(kept), pa.int32()), pa.array(of[0], pa.string()), pa.array(of[1], pa.float64())],
                                             names=["j", "level", "number"])
    found = values.mapInArrow(distinct, "j int, level string, number double").groupBy("j").agg(
        F.collect_set("level").alias("levels"), F.slice(F.array_sort(F.collect_set("number")), 1, max_bin + 1).alias("numbers")).collect()
    levels = dict.fromkeys(cats, ()) | {cats[r.j]: r.levels for r in found if r.j < len(cats)}
    few = dict.fromkeys(nums, ()) | {nums[r.j - len(cats)]: r.numbers for r in found if r.j >= len(cats)}
    many = [c for c in nums if len(few[c]) > max_bin]
    shares = [i / max_bin for i in range(1, max_bin)]
    cuts = dict(zip(many, values.approxQuantile(many, shares, 1 / (4 * max_bin)), strict=True)) if many else {}
    return Bins([*cats, *nums], {c: sorted(v) for c, v in levels.items()}, {c: sorted(set(cuts[c])) if c in cuts else list(few[c])[:-1] for c in nums})


def parted(codes: np.ndarray, rows: np.ndarray, tables: tuple[np.ndarray, ...], wanted: list[int]) -> dict[int, np.ndarray]:
    """Which of the ``rows`` stand in each wanted node, in their order. ``codes`` has a row for each feature; ``tables`` are the
    nodes' features, bins that go left and children, which have higher numbers than their parents."""
    feature, go, left, right = tables
    needed = set(wanted)
    for v in range(len(feature) - 1, -1, -1):
        if feature[v] >= 0 and (left[v] in needed or right[v] in needed):
            needed.add(v)
    at, out = {0: rows}, {}
    for v in range(len(feature)):
        if v not in at:
            continue
        here = at.pop(v)
        if v in wanted:
            out[v] = here
        if feature[v] >= 0 and (left[v] in needed or right[v] in needed):
            goes = go[v][codes[feature[v]][here]]
            at[int(left[v])], at[int(right[v])] = here[goes], here[~goes]
    return out


def route(codes: np.ndarray, feature: np.ndarray, go: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The node where each row ends; ``go`` has for each node the bins that go left."""
    at = np.zeros(codes.shape[1], np.int64)
    for v, rows in parted(codes, np.arange(codes.shape[1]), (feature, go, left, right), np.flatnonzero(feature < 0).tolist()).items():
        at[rows] = v
    return at


def _bagged(block: dict, round_: int, p: dict) -> np.ndarray:
    """Rows of the train part that this round uses."""
    x = (block["key"] ^ np.uint64((p["seed"] * 1_000_003 + round_) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ~block["val"] & ((x ^ (x >> np.uint64(32))) >> np.uint64(11) < np.uint64(int(p["row_share"] * 2**53)))


def slopes(block: dict, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the rows."""
    prob = 1 / (1 + np.exp(-block["margin"][rows]))
    return prob - block["y"][rows], prob * (1 - prob)


def histogram(codes: np.ndarray, rows: np.ndarray | slice, grad: np.ndarray, curve: np.ndarray, usable: np.ndarray, bins: int) -> np.ndarray:
    """features x bins x (gradient, curvature, count) over the ``rows``, whose slopes are given; features that are not usable
    stay zero, save the first, which gives the totals."""
    out = np.zeros((len(usable), bins, 3))
    for j in range(len(usable)):
        if usable[j] or not j:
            cell = codes[j][rows].astype(np.intp)
            for k, w in enumerate((grad, curve, None)):
                out[j, :, k] = np.bincount(cell, w, bins)
    return out


def best_split(h: np.ndarray, is_cat: np.ndarray, usable: np.ndarray, p: dict) -> tuple[float, int, np.ndarray, float] | None:
    """Gain, feature, bins that go left and whether missing values do, of the best split of a histogram; None without a
    split of positive gain. Of equal gains the first feature, the lowest cut and missing values on the right win."""
    real, miss, total = h[:, :-1], h[:, -1], h[0].sum(0)
    order = np.broadcast_to(np.arange(real.shape[1]), real.shape[:2]).copy()
    ratio = np.where(real[is_cat, :, 2] > 0, real[is_cat, :, 0] / (real[is_cat, :, 1] + p["cat_smooth"]), np.inf)
    order[is_cat] = np.argsort(ratio, 1, kind="stable")
    run = np.cumsum(np.take_along_axis(real, order[:, :, None], 1), 1)
    left = np.stack([run, run + miss[:, None, :]], 2)  # features x cuts x (missing right, missing left) x sums
    right = total - left
    l2 = np.where(is_cat, p["cat_l2"], 0.0)[:, None, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0]**2 / (left[..., 1] + l2) + right[..., 0]**2 / (right[..., 1] + l2) - total[0]**2 / total[1]
    rows, curve = p["min_rows"] - 0.5, p["min_curvature"]
    ok = (left[..., 2] > rows) & (right[..., 2] > rows) & (left[..., 1] >= curve) & (right[..., 1] >= curve) & usable[:, None, None]
    ok[:, :, 1] &= (~is_cat & (miss[:, 2] > 0))[:, None]
    gain = np.where(ok, gain, -np.inf)
    at = int(gain.argmax())
    f, cut, side = np.unravel_index(at, gain.shape)
    if not gain[f, cut, side] > 1e-9:
        return None
    go = np.zeros(h.shape[1], bool)
    go[order[f, :cut + 1]] = True
    if is_cat[f]:
        go[:-1] &= real[f, :, 2] > 0  # a level without rows here stays with the rest
    go[-1] = bool(side)
    return float(gain[f, cut, side]), int(f), go, float(left[f, cut, side, 2])


@dataclass
class Nodes:
    """Nodes of a tree that grows; children have higher numbers than their parents."""
    feature: list[int]
    go: list[np.ndarray]
    left: list[int]
    right: list[int]
    total: list[np.ndarray]  # gradient, curvature and count
    split: list[tuple | None]  # as from best_split; node numbers of the children are set once they are known
    hist: dict[int, np.ndarray]  # of nodes without children

    def add(self, total: np.ndarray, split: tuple | None, hist: np.ndarray | None = None) -> int:
        v = len(self.feature)
        self.feature.append(-1)
        self.go.append(np.zeros_like(self.go[0]) if self.go else np.zeros(hist.shape[1], bool))
        self.left.append(-1)
        self.right.append(-1)
        self.total.append(total)
        self.split.append(split)
        if hist is not None:
            self.hist[v] = hist
        return v

    def part(self, v: int, left: int, right: int) -> None:
        _, self.feature[v], self.go[v], _ = self.split[v]
        self.left[v], self.right[v] = left, right
        self.hist.pop(v, None)

    def tables(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.stack(self.go), np.array(self.left), np.array(self.right)


def _expand(root: np.ndarray, ask, is_cat: np.ndarray, usable: np.ndarray, p: dict, finish=None) -> tuple[Nodes, list[int]]:
    """Nodes of a tree from its root histogram, and which are its leaves. ``ask(tables, nodes)`` gives the histograms of nodes of
    the tree so far. With ``finish(tables, hists, sizes, leaves)``, small nodes get their own trees of that many leaves at most; all that
    is known to be needed is asked for at once, large nodes before small ones. Many small nodes get fewer leaves each; where one
    needs more, the rest of its tree is asked for then. Without ``finish``, a split is asked for when it is made."""
    nodes = Nodes([], [], [], [], [], [], {})
    nodes.add(root[0].sum(0), best_split(root, is_cat, usable, p), root)
    open_ = [0]
    ahead = 2 + max(0, math.ceil(math.log2(max(1, nodes.total[0][2]) / max(1, p["gather"])))) if finish else 0  # levels that small nodes wait

    def is_small(v: int) -> bool:
        return nodes.total[v][2] <= p["gather"]

    def halves(todo: list[int]) -> None:
        """Children of nodes by the histogram of the smaller one."""
        smaller, hists = [], [nodes.hist[v] for v in todo]
        for v in todo:
            kids = [nodes.add(np.zeros(3), None) for _ in range(2)]
            nodes.part(v, *kids)
            small_left = bool(2 * nodes.split[v][3] <= nodes.total[v][2])
            smaller.append((kids[not small_left], kids[small_left]))
        for (small, large), whole, found in zip(smaller, hists, ask(nodes.tables(), [s for s, _ in smaller]), strict=True):
            nodes.hist[small], nodes.hist[large] = found, whole - found
            for w in (small, large):
                nodes.total[w] = nodes.hist[w][0].sum(0)
                nodes.split[w] = best_split(nodes.hist[w], is_cat, usable, p)

    def graft(todo: list[int], leaves: int) -> None:
        """Descendants of small nodes, as far as they can be needed."""
        for v, (feature, left, right, total, split) in zip(todo, finish(nodes.tables(), {v: nodes.hist.get(v) for v in todo}, [float(nodes.total[v][2]) for v in todo], leaves), strict=True):
            number = {0: v} | {i: nodes.add(total[i], split[i]) for i in range(1, len(feature))}
            for i, f in enumerate(feature):
                if f >= 0:
                    nodes.part(number[i], number[left[i]], number[right[i]])

    while len(open_) < p["leaves"]:
        ranked = sorted((v for v in open_ if nodes.split[v]), key=lambda v: (-nodes.split[v][0], v))
        if not ranked:
            break
        v, room = ranked[0], p["leaves"] - len(open_)
        if nodes.feature[v] < 0 and not finish:
            halves([v])
        elif nodes.feature[v] < 0:
            ends = sorted((w for w in nodes.hist if nodes.split[w]), key=lambda w: (w != v, -nodes.split[w][0], w))
            large = [w for w in ends if not is_small(w)]
            if large and (ahead > 0 or not is_small(v)):
                ahead -= 1
                halves(large[:room])
                continue
            waiting = [w for w in ranked if nodes.feature[w] < 0 and w not in nodes.hist]  # ends of trees of too few leaves
            todo = [v, *(w for w in [*waiting, *ends] if w != v and is_small(w))][:room]
            graft(todo, min(room + 1, max(32, 8 * room // len(todo))))
        open_.remove(v)
        open_ += [nodes.left[v], nodes.right[v]]
    return nodes, open_


def subtree(root: np.ndarray, codes: np.ndarray, grad: np.ndarray, curve: np.ndarray, is_cat: np.ndarray, usable: np.ndarray, p: dict):
    """Features, children, totals and splits of the nodes of a tree over rows at hand."""
    at = {0: np.arange(len(grad))}  # rows of the nodes

    def ask(tables: tuple[np.ndarray, ...], wanted: list[int]) -> list[np.ndarray]:
        feature, go, left, right = tables
        w = wanted[0]
        v = int(np.flatnonzero((left == w) | (right == w))[0])
        here = at.pop(v)
        goes = go[v][codes[feature[v]][here]]
        at[int(left[v])], at[int(right[v])] = here[goes], here[~goes]
        return [histogram(codes, at[w], grad[at[w]], curve[at[w]], usable, root.shape[1])]
    nodes, open_ = _expand(root, ask, is_cat, usable, p)
    return nodes.feature, nodes.left, nodes.right, nodes.total, nodes.split


def grow(root: np.ndarray, ask, is_cat: np.ndarray, usable: np.ndarray, p: dict, finish) -> dict:
    """A tree from its root histogram."""
    nodes, open_ = _expand(root, ask, is_cat, usable, p, finish)
    # leaves that were parted only to look ahead are leaves
    number, todo = {}, [0]
    while todo:
        v = todo.pop(0)
        number[v] = len(number)
        if v not in open_:
            todo += [nodes.left[v], nodes.right[v]]
    out = {"feature": [], "go": [], "left": [], "right": [], "value": [], "cover": [], "gain": []}
    for v in number:
        leaf = v in open_
        g, c, n = nodes.total[v]
        out["feature"].append(-1 if leaf else nodes.feature[v])
        out["go"].append(nodes.go[v])
        out["left"].append(-1 if leaf else number[nodes.left[v]])
        out["right"].append(-1 if leaf else number[nodes.right[v]])
        out["value"].append(float(-p["rate"] * g / c) if c > 0 else 0.0)
        out["cover"].append(float(n))
        out["gain"].append(0.0 if leaf else nodes.split[v][0])
    return out


def _tables(tree: dict) -> tuple[np.ndarray, ...]:
    return np.array(tree["feature"]), np.stack(tree["go"]), np.array(tree["left"]), np.array(tree["right"])


def _ranks(margin: np.ndarray) -> np.ndarray:
    """Integers in the order of the margins, equal where 12 significant bits are."""
    bits = (margin.astype(np.float32) + np.float32(0)).view(np.int32).astype(np.int64) >> 12
    return np.where(bits < 0, -(bits & 0x7FFFF) - 1, bits)


def _tally(ranks: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, ...]:
    kinds, at = np.unique(ranks, return_inverse=True)
    return kinds, np.bincount(at, positive, len(kinds)), np.bincount(at, negative, len(kinds))


def auc(positive: np.ndarray, negative: np.ndarray) -> float:
    """Share of pairs in order, ties as half, from counts in rising order of the score."""
    pairs = positive.sum() * negative.sum()
    return float((positive * (np.cumsum(negative) - negative / 2)).sum() / pairs) if pairs else 0.5


def _blocks(rows: DataFrame, bins: Bins, label: str, val: str, key: str, base: float, parts: int):
    """RDD of blocks of arrays, dealt evenly to ``parts`` partitions, and the cached RDD that it is dealt from; a single partition is a
    single block and is not dealt."""
    kind = np.uint8 if bins.missing < 2**8 else np.uint16 if bins.missing < 2**16 else np.int32

    def block(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        codes, y, v, k = (np.concatenate(x, -1) for x in zip(*found, strict=True))
        y = y.astype(np.uint8) if np.isin(y, (0, 1)).all() else y
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps({"codes": codes, "y": y, "val": v, "key": k, "margin": np.full(len(y), base)}, 5)],
                                                    pa.binary())], names=["block"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for b in batches:
            if b.num_rows:
                found.append((np.ascontiguousarray(bins.codes(b).T, kind), b.column("__y").to_numpy(zero_copy_only=False),
                              b.column("__val").to_numpy(zero_copy_only=False), b.column("__key").to_numpy().view(np.uint64)))
                n += b.num_rows
                if parts > 1 and n >= ROWS_PER_BLOCK:
                    yield block(found)
                    found, n = [], 0
        if found:
            yield block(found)
    read = rows.select(*bins.features, F.col(label).cast("double").alias("__y"), F.col(val).alias("__val"), F.xxhash64(F.col(key)).alias("__key"))
    if parts == 1:
        return read.coalesce(1).mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r.block)), None
    packed = read.mapInArrow(pack, "block binary").rdd.map(lambda r: r.block).persist(StorageLevel.MEMORY_AND_DISK)
    numbered = packed.zipWithIndex().map(lambda x: (x[1], x[0])).partitionBy(parts, lambda i: i % parts)
    return numbered.mapPartitions(lambda these: (pickle.loads(x) for _, x in sorted(these))), packed


def picked(blocks: Iterator[dict], round_: int, tables: tuple[np.ndarray, ...], wanted: list[int], usable: np.ndarray, p: dict) -> dict[int, tuple]:
    """Codes (of the usable features and the first; no rows for others), gradients and curvatures of the bagged rows of each wanted node."""
    out: dict[int, list] = {v: [] for v in wanted}
    sent = usable | (np.arange(len(usable)) == 0)
    for b in blocks:
        for v, rows in parted(b["codes"], np.flatnonzero(_bagged(b, round_, p)), tables, wanted).items():
            if len(rows):
                out[v].append(([b["codes"][j][rows] if sent[j] else b["codes"][j][:0] for j in range(len(usable))], *slopes(b, rows)))
    return {v: _joined(found) for v, found in out.items() if found}


def _joined(found: list[tuple]) -> tuple:
    codes, grad, curve = zip(*found, strict=True)
    return [np.concatenate(c) for c in zip(*codes, strict=True)], np.concatenate(grad), np.concatenate(curve)


def dealt(sizes: list[float], parts: int) -> list[int]:
    """A part for each item, the largest items first and each to the part with the least so far."""
    load, out = [0.0] * parts, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = min(range(parts), key=load.__getitem__)
        load[out[i]] += sizes[i]
    return out


def fit(rows: DataFrame, cats: list[str], nums: list[str], label: str = "y", val: str = "is_val", key: str = "flight_id",
        params: dict | None = None) -> dict:
    """Boost trees over ``rows``, where ``val`` marks the validation rows; the model is a plain dict (see ``save``).

    Rows without a label are left out. Without train rows, or with one class alone, the model has no trees. Without
    validation rows of both classes all rounds are grown.
    """
    p = PARAMS | (params or {})
    spark = rows.sparkSession
    checkpoint_dir(spark)
    rows = rows.where(F.col(label).isNotNull())
    train = rows.where(~F.col(val))
    n, mean = train.agg(F.count(F.lit(1)), F.avg(label)).first()
    few = max(1, min(-(-n // ROWS_PER_PART), spark.sparkContext.defaultParallelism))  # a wave of tasks for each job where partitions stay small
    p, options = {"gather": min(GATHER, max(LEAST_GATHER, n // few))} | p, p
    bins = learn_bins(train, cats, nums, p["max_bin"])
    mean = float(mean or 0)
    model = {"features": bins.features, "levels": bins.levels, "edges": bins.edges, "trees": [], "ended": "one_class", "params": options, "best_auc": None,
             "base": float(np.log(mean / (1 - mean))) if 0 < mean < 1 else (0.0 if not n else float(np.sign(mean - 0.5) * 35))}
    if not 0 < mean < 1:
        return model
    is_cat = np.array([f in bins.levels for f in bins.features])
    width = bins.missing + 1
    parts = few * max(1, -(-n // (few * MOST_PER_PART)))  # whole waves
    blocks, packed = _blocks(rows, bins, label, val, key, model["base"], parts)
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    depth = 1 if parts <= 64 else 3
    r = np.random.default_rng(p["seed"])
    best, best_round, kept, stale = -1.0, 0, [], [] if packed is None else [packed]

    def summed(job, merge):
        """Results of ``job`` over the blocks of each partition, merged."""
        either = lambda x, y: y if x is None else x if y is None else merge(x, y)
        return blocks.mapPartitions(job).treeAggregate(None, either, either, depth)

    def start(round_: int, usable: np.ndarray):
        def job(these: Iterator[dict]):
            h, ranks, y = np.zeros((len(usable), width, 3)), [], []
            for b in these:
                here = np.flatnonzero(_bagged(b, round_, p))
                h += histogram(b["codes"], here, *slopes(b, here), usable, width)
                ranks.append(_ranks(b["margin"][b["val"]]))
                y.append(b["y"][b["val"]])
            if ranks:
                y = np.concatenate(y).astype(float)
                yield h, _tally(np.concatenate(ranks), y, 1 - y)
        return summed(job, lambda x, y: (x[0] + y[0], _tally(*(np.concatenate(pair) for pair in zip(x[1], y[1], strict=True)))))

    model["ended"] = "rounds"
    for round_ in range(p["rounds"] + 1):
        usable = np.zeros(len(is_cat), bool)
        usable[r.choice(len(is_cat), max(1, round(p["feature_share"] * len(is_cat))), replace=False)] = True
        root, (_, positive, negative) = start(round_, usable)  # also the validation rows' ranks by the trees so far
        while stale:
            stale.pop().unpersist()
        now = auc(positive, negative)
        if positive.sum() and negative.sum():
            if now > best:
                best, best_round = now, round_
            elif round_ - best_round >= p["patience"]:
                model["ended"] = "auc"
                break
        else:
            best_round = round_
        if round_ == p["rounds"]:
            break

        def ask(tables, wanted, round_=round_, usable=usable):
            def job(these: Iterator[dict]):
                found, out = picked(these, round_, tables, wanted, usable, p), np.zeros((len(wanted), len(usable), width, 3))
                for k, v in enumerate(wanted):
                    if v in found:
                        out[k] = histogram(found[v][0], slice(None), *found[v][1:], usable, width)
                yield out
            return summed(job, lambda x, y: x + y)

        def finish(tables, hists, sizes, leaves, round_=round_, usable=usable):
            wanted = list(hists)
            to = dealt(sizes, min(len(wanted), few))

            def send(i: int, these: Iterator[dict]):
                for v, rows in picked(these, round_, tables, wanted, usable, p).items():
                    yield wanted.index(v), (i, rows)

            def end(these: Iterator[tuple]):
                found: dict[int, list] = {}
                for k, part in these:
                    found.setdefault(k, []).append(part)
                for k in sorted(found):
                    codes, grad, curve = _joined([rows for _, rows in sorted(found.pop(k), key=lambda part: part[0])])
                    root = hists[wanted[k]]
                    root = histogram(codes, slice(None), grad, curve, usable, width) if root is None else root
                    yield k, subtree(root, codes, grad, curve, is_cat, usable, p | {"leaves": leaves})
            found = blocks.mapPartitionsWithIndex(send).partitionBy(max(to) + 1, to.__getitem__).mapPartitions(end).collectAsMap()
            return [found[k] for k in range(len(wanted))]
        tree = grow(root, ask, is_cat, usable, p, finish)
        if len(tree["feature"]) == 1:
            model["ended"] = "no_split"
            break
        kept.append(tree)
        tables, values = _tables(tree), np.array(tree["value"])

        def step(b: dict, tables=tables, values=values) -> dict:
            return b | {"margin": b["margin"] + values[route(b["codes"], *tables)]}
        stale.append(blocks)
        blocks = blocks.map(step).persist(StorageLevel.MEMORY_AND_DISK)
        if (round_ + 1) % CUT == 0:
            blocks.checkpoint()
    for x in (*stale, blocks):
        x.unpersist()
    model["best_auc"] = best if best >= 0 else None
    model["grown"] = len(kept)
    model["trees"] = [_readable(t, bins, is_cat) for t in kept[:best_round]]
    return model


def _readable(tree: dict, bins: Bins, is_cat: np.ndarray) -> dict:
    """A tree with thresholds and sets of level numbers in place of bins."""
    threshold, categories = [], []
    for f, go in zip(tree["feature"], tree["go"], strict=True):
        if f < 0 or is_cat[f]:
            threshold.append(0.0)
            categories.append([int(i) for i in np.flatnonzero(go[:-1])] if f >= 0 else None)
        else:
            edges = bins.edges[bins.features[f]]
            cut = int(np.flatnonzero(go[:-1]).max())
            threshold.append(float(edges[cut]) if cut < len(edges) else float("inf"))
            categories.append(None)
    rest = {k: tree[k] for k in ("feature", "left", "right", "value", "cover", "gain")}
    return rest | {"threshold": threshold, "categories": categories, "missing_left": [bool(g[-1]) for g in tree["go"]]}


def trees_of(model: dict) -> list[Tree]:
    """Node arrays of the trees, for scoring and attributions."""
    return [Tree(np.array(t["left"]), np.array(t["right"]), np.array(t["feature"]), np.array(t["threshold"]),
                 [None if c is None else set(c) for c in t["categories"]], np.array(t["cover"]), np.array(t["value"]), 1.0,
                 np.array(t["missing_left"])) for t in model["trees"]]


def feature_rows(df: DataFrame, model: dict, out: str = "features") -> DataFrame:
    """``df`` with the model's features as one array of doubles: level numbers, null for unseen levels and missing values."""
    def column(f: str) -> Column:
        if f not in model["levels"]:
            return F.col(f).cast("double")
        at = F.array_position(F.lit(model["levels"][f]).cast("array<string>"), F.col(f).cast("string"))
        return F.when(at > 0, (at - 1).cast("double"))
    return df.withColumn(out, F.array(*[column(f) for f in model["features"]]))


def margins(x: np.ndarray, trees: list[Tree], base: float) -> np.ndarray:
    """Log-odds of rows of features; NaN is a missing value."""
    columns = np.ascontiguousarray(x.T)
    out = np.full(len(x), base)
    for t in trees:
        todo = [(0, np.arange(len(x)))]
        while todo:
            v, here = todo.pop()
            if t.left[v] < 0:
                out[here] += t.value[v]
            elif here.size:
                goes = t.goes_left(int(v), columns[t.feature[v]][here])
                todo += [(t.left[v], here[goes]), (t.right[v], here[~goes])]
    return out


def score(df: DataFrame, model: dict, features: str = "features", margin: str = "margin", prob: str = "score") -> DataFrame:
    """``df`` with the model's log-odds and probability, from the array column of :func:`feature_rows`."""
    shared = df.sparkSession.sparkContext.broadcast([dict(t.__dict__) for t in trees_of(model)])
    base, size = model["base"], len(model["features"])

    @F.arrow_udf("double")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = [Tree(**t) for t in shared.value]
        for part in parts:
            yield pa.array(margins(matrix(part, size), trees, base))
    return df.withColumn(margin, of(features)).withColumn(prob, 1 / (1 + F.exp(-F.col(margin))))


def importance(model: dict) -> list[tuple[str, float]]:
    """Share of the splits' gain by feature, in the model's order."""
    total = dict.fromkeys(range(len(model["features"])), 0.0)
    for t in model["trees"]:
        for f, g in zip(t["feature"], t["gain"], strict=True):
            if f >= 0:
                total[f] += g
    whole = sum(total.values()) or 1.0
    return [(model["features"][f], g / whole) for f, g in total.items()]


def save(spark: SparkSession, model: dict, path: str) -> None:
    """The model as JSON, a row for each tree and one for the rest."""
    rows = [("head", -1, json.dumps({k: v for k, v in model.items() if k != "trees"}))]
    rows += [("tree", i, json.dumps(t)) for i, t in enumerate(model["trees"])]
    spark.createDataFrame(rows, "kind string, i int, body string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict:
    rows = spark.read.parquet(path).orderBy("i").toArrow().to_pylist()
    return json.loads(rows[0]["body"]) | {"trees": [json.loads(r["body"]) for r in rows[1:]]}
