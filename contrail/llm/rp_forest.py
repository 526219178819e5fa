"""Near duplicates among embeddings by a forest of random-projection trees.

Each tree splits the vectors by random hyperplanes, near the median of a node, again and again until a leaf
is small. Vectors within ``spill`` of a hyperplane go to both sides. Vectors that share a leaf and a label are compared
in double precision; every pair found is verified by its cosine and joined into components.

Two unit vectors at the limit lie sqrt(2 - 2 * limit) apart, so along a random direction in d dimensions their distance is
normal with a deviation of that over sqrt(d). The spill is a multiple of it: a pair is torn apart by one split with
a chance of some 2.5 % at the limit, and less above, whatever the table; it is missed only if every tree tears it.

The hyperplanes are fitted on a sample of at most ``sample`` vectors; every vector is indexed. Leaves that hold more than
``block`` vectors of a label are cut into blocks by hash, and each pair of blocks is a group of its own, so no group grows with the
table and none is left out. Equal vectors of one label are one class and are compared once.

No group sends its pairs on. A vector's links are counted where the pair meets first (the first leaf, by number, that both
share), by products of the incidence of vectors and leaves; what leaves a group is one row for each vector, with its count
and the smallest vector that it reaches in the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.components import components
from contrail.sources.sinks import materialize

LIMIT, TREES, LEAF, BLOCK, SAMPLE, SPILL = 0.93, 6, 256, 1024, 16_384, 0.5
#: Leaves of one tree are numbered below this.
TREE = 1 << 32




def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; their largest components are taken out first, so nothing overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def grow(x: np.ndarray, least: float, margin: float, r: np.random.Generator, tries: int = 4) -> tuple:
    """A tree over the unit vectors ``x``: hyperplanes, their cuts, and two children a node, where a child below zero is leaf
    ``-1 - child``. Nodes are split while they hold more than ``least`` of them and
    some direction of ``tries`` really parts them."""
    planes, cuts, children = [], [], []
    leaves = 0
    todo = [(np.arange(len(x)), None, 0)]
    while todo:
        own, parent, side = todo.pop()
        best = None
        if len(own) > max(least, 1):
            for _ in range(tries):
                plane = r.normal(size=x.shape[1])
                plane /= np.sqrt(plane @ plane)
                at = x[own] @ plane
                cut = np.quantile(at, r.uniform(0.45, 0.55))
                left, right = own[at < cut + margin], own[at > cut - margin]
                if max(len(left), len(right)) <= 0.85 * len(own):
                    best = plane, cut, left, right
                    break
        if best is None:
            number, leaves = -1 - leaves, leaves + 1
        else:
            number = len(planes)
            planes.append(best[0])
            cuts.append(best[1])
            children.append([0, 0])
            todo += [(best[2], number, 0), (best[3], number, 1)]
        if parent is not None:
            children[parent][side] = number
    return (np.array(planes, np.float64).reshape(-1, x.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(-1, 2))


def leaves_of(x: np.ndarray, tree: tuple, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves that they fall into, several for rows near a hyperplane."""
    planes, cuts, children = tree
    rows, leaves = [], []
    todo = [(np.arange(len(x)), 0 if len(planes) else -1)]
    while todo:
        own, node = todo.pop()
        if not len(own):
            continue
        if node < 0:
            rows.append(own)
            leaves.append(np.full(len(own), -1 - node))
            continue
        at = x[own] @ planes[node]
        todo += [(own[at < cuts[node] + margin], children[node, 0]), (own[at > cuts[node] - margin], children[node, 1])]
    return np.concatenate(rows), np.concatenate(leaves)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to ``size``."""
    flat, stops = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    stops = stops - stops[0]
    n = np.diff(stops)
    out = np.zeros((len(n), size), flat.dtype)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(stops[:-1], n)] = flat
    return out


def met_before(leaves: list[np.ndarray], leaf: int) -> np.ndarray:
    """Which rows share a leaf of a number below ``leaf``."""
    n = np.array([len(x) for x in leaves])
    row, code = np.repeat(np.arange(len(leaves)), n), np.concatenate(leaves)
    early = code < leaf
    codes, place, many = np.unique(code[early], return_inverse=True, return_counts=True)
    row = row[early]
    use = many[place] > 1
    columns = np.cumsum(many > 1) - 1
    held = np.zeros((len(leaves), max(int((many > 1).sum()), 1)), np.float32)
    held[row[use], columns[place[use]]] = 1
    return held @ held.T > 0


def least_reached(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that it reaches."""
    n = len(links)
    label = np.arange(n)
    while True:
        now = np.minimum(label, np.where(links, label[None, :], n).min(1, initial=n))
        now = np.minimum(now, now[now])
        if (now == label).all():
            return label
        label = now


def usable(vec: Column) -> Column:
    """Whether a vector has components, all of them finite numbers and some not zero."""
    good = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & good & F.exists(vec, lambda v: v != 0)


def forest(classes: DataFrame, size: int, largest: int, limit: float, trees: int, leaf: int, sample: int, spill: float, seed: int) -> tuple[list, float]:
    """Trees fitted on ``sample`` vectors at most, chosen by hash, and the margin of their splits."""
    total = classes.count()
    share = min(1.0, sample / max(total, 1))
    chosen = classes.where(F.pmod("h", F.lit(1 << 20)) < F.lit(int(np.ceil(share * (1 << 20))))).orderBy("h", "g").limit(sample).select("x").toArrow()
    x = unit(_matrix(chosen["x"].combine_chunks(), size)) if chosen.num_rows else np.zeros((0, size))
    margin = spill * float(np.sqrt(max(2 - 2 * limit, 0) / size))
    least = max(2.0, leaf * len(x) / max(largest, 1)) if share < 1 else leaf * len(x) / max(largest, 1)
    r = np.random.default_rng(seed)
    return [grow(x, least, margin, r) for _ in range(trees)], margin


def indexed(classes: DataFrame, trees: list, margin: float, size: int) -> DataFrame:
    """``classes`` with ``leaves``: the numbers of all leaves that each vector falls into, ascending."""
    shared = classes.sparkSession.sparkContext.broadcast((trees, margin))
    rest = [c for c in classes.columns if c != "leaves"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, margin = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column("x"), size))
            found = [leaves_of(x, t, margin) for t in trees]
            row, code = np.concatenate([f[0] for f in found]), np.concatenate([f[1] + k * TREE for k, f in enumerate(found)])
            order = np.lexsort((code, row))
            stops = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(code[order].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], lists], names=[*rest, "leaves"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, schema + ", leaves array<bigint>")


def compared(rows: DataFrame, size: int, limit: float, block: int) -> DataFrame:
    """``(c, links, least)``: for each vector of a group that has links there, how many meet here first and the smallest
    class that it reaches; groups are leaves of one label, or pairs of blocks of a leaf."""
    spread = rows.select("c", "label", "n", "x", "leaves", F.explode("leaves").alias("leaf"))
    wide = rows.select("label", F.explode("leaves").alias("leaf")).groupBy("label", "leaf").agg(F.count(F.lit(1)).alias("m")).where(
        F.col("m") > block).select("label", "leaf", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    cut = spread.join(wide, ["label", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    cut = cut.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, other = (table[k].to_numpy() for k in ("own", "other"))
        c, n = table["c"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(c)
        x = unit(_matrix(table["x"].combine_chunks().take(pa.array(order)), size))
        c, n, own, other = c[order], n[order], own[order], other[order]
        links = x @ x.T >= limit
        np.fill_diagonal(links, False)
        if (own != other).any():  # two blocks: pairs inside a block have a group of their own
            links &= own[:, None] != own[None, :]
        some = np.flatnonzero(links.any(1))
        if not len(some):
            return pa.table({"c": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
        links = links[np.ix_(some, some)]
        lists = [np.array(table["leaves"][int(k)].as_py(), np.int64) for k in order[some]]
        fresh = links & ~met_before(lists, table["leaf"][0].as_py())
        return pa.table({"c": c[some], "links": pa.array((fresh * n[some]).sum(1), pa.int64()), "least": c[some][least_reached(links)]})
    return cut.select("label", "leaf", "i", "j", "c", "n", "x", "leaves", "own", "other").groupBy("label", "leaf", "i", "j").applyInArrow(
        compare, "c bigint, links bigint, least bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", limit: float = LIMIT,
                 trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE, spill: float = SPILL, seed: int = 12) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row for each row of ``vectors``.

    Vectors of one label are linked when their cosine is ``limit`` or more; no other pairs are. ``n_links`` counts the other
    vectors linked directly, ``component_id`` is the smallest id reachable and ``kept`` is true for that vector.

    Vectors that are null, empty, zero, or hold null or non-finite components, and vectors without label, link with nothing.
    Vectors of different lengths do not link. Equal rows are one vector, each returned with its verdict; rows of one id with different vectors are
    vectors of their own. A null id stays unlinked (null component, kept). An empty table gives an empty table. Other columns are not read.
    """
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast(f"array<{kind}>").alias("x"))
    can = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x"))
    rows = rows.withColumn("can", F.coalesce(can, F.lit(False))).withColumn("h", F.xxhash64("x")).withColumn("g", F.xxhash64(F.lit(7), "x"))
    key = ["label", "h", "g"]
    ids = rows.where("can").groupBy("vec_id", *key).agg(F.any_value("x").alias("x"))
    classes = ids.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"), F.any_value("x").alias("x"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    size = classes.agg(F.max(F.size("x"))).first()[0] or 1
    # a length is part of the label: vectors of different lengths are never compared
    keyed = classes.select("c", F.struct("label", F.size("x").alias("length")).alias("label"), "n", "x", "h", "g")
    largest = keyed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    planes, margin = forest(keyed, size, largest, limit, trees, leaf, sample, spill, seed)
    found = materialize(compared(indexed(keyed.select("c", "label", "n", "x"), planes, margin, size), size, limit, block), "vector-links")

    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("c").alias("a"), F.col("least").alias("b")))
    named = classes.select("c", *key, "n", "least_id").join(reached.select(F.col("node").alias("c"), "component"), "c", "left").withColumn(
        "component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = materialize(named.join(least, "component").join(counts, "c", "left").select(
        *key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "vector-classes")
    named = named.withColumn("can", F.lit(True))
    out = rows.select("vec_id", "can", *key).join(named, ["can", *key], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
                      ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
