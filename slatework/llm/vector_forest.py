"""Near-duplicate vectors by a forest of random-projection trees.

Vectors with equal label and equal components form one class.  In every tree, the classes of a label are split again
and again at the median of a random projection, where classes close to the cut go to both sides, until a leaf is
small or no longer shrinks; every label is split twice at least, however small.  The overlap is narrow, so a level adds
about 8 % of copies; a pair that one tree parts meets in another.  Levels are split for all trees and leaves at once, by one aggregation each.  Within a
leaf all classes are compared by exact cosine in double precision; a leaf that stayed large is compared block by
block, over several tasks.  A pair that meets in several leaves counts in the smallest of them only, which each side
knows from its own list of leaves, so links are counted without writing pairs.  Leaves join their classes first and send
one row per class to the union of all leaves.

Vectors that are NULL, empty, zero, or hold NULL or non-finite components, and those with a NULL label, are linked
with nothing.  Vectors of different lengths are not compared.  Repeated rows are linked with each other.  A NULL id
never names a component while another id is in it.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slatework.llm.common import written
from slatework.llm.components import components

_BLOCK = 1024
#: Levels that every tree has, whatever the size of its label.
_LEAST_LEVELS = 2


def _unit(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    values = table.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    # Scaled first: squares of very large or small components stay in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _projected(trees: int, levels: int, seed: int):
    def run(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("vector")])
            out: list = [None] * batch.num_rows
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = _unit(batch.take(pa.array(rows)), "vector")
                axes = np.random.default_rng([seed, int(size)]).normal(size=(int(size), trees * levels))
                axes *= math.sqrt(size) / np.sqrt((axes * axes).sum(axis=0))
                for row, values in zip(rows, x @ axes):
                    out[row] = values
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("root"), pa.array(out, pa.list_(pa.float64()))], names=["node", "root", "along"]
            )

    return run


def leaves_of(classes: DataFrame, *, trees: int, leaf_rows: int, spill: float, seed: int) -> DataFrame:
    """(node, leaf) for every class and leaf it lies in, over all trees."""
    largest = classes.groupBy("root").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    levels = max(_LEAST_LEVELS, math.ceil(math.log2(max(1, largest) / leaf_rows)) + 4)
    along = classes.select("node", "root", "vector").mapInArrow(_projected(trees, levels, seed), "node long, root long, along array<double>")
    open_rows = written(along.select(
        "node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("along", t * levels + 1, levels))).alias("tree", "along"),
        F.lit(1 << 62).cast("long").alias("above"), "root",
    ).withColumn("leaf", F.xxhash64("root", "tree")).drop("root", "tree"))
    closed = None
    for level in range(levels):
        here = F.col("along")[level]
        nodes = open_rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx(here, 0.5, 1000).alias("cut"), F.first("above").alias("before"))
        large = F.col("rows") > (1 if level < _LEAST_LEVELS else leaf_rows)
        splits = large & (F.col("rows") <= F.col("before") * 0.9)
        nodes = written(nodes.select("leaf", "rows", F.when(splits, F.col("cut")).alias("cut")))
        placed = open_rows.join(nodes, "leaf")
        sides = F.filter(F.array(F.when(here <= F.col("cut") + spill, F.lit(0)), F.when(here >= F.col("cut") - spill, F.lit(1))), lambda s: s.isNotNull())
        done = placed.where(F.col("cut").isNull()).select("node", "leaf")
        closed = done if closed is None else closed.union(done)
        further = placed.where(F.col("cut").isNotNull()).select("node", "along", F.col("rows").alias("above"), "leaf", F.explode(sides).alias("side"))
        open_rows = written(further.select("node", "along", "above", F.xxhash64("leaf", "side").alias("leaf")))
        if open_rows.isEmpty():
            return closed
    return closed.union(open_rows.select("node", "leaf"))


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of each pair; afterwards ``parent`` names the smallest member of every set."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent[:] = further


def _compared(least: float):
    def run(key, table):
        table = table.combine_chunks()
        x = _unit(table, "vector")
        node, rows = table.column("node").to_numpy(), table.column("rows").to_numpy().astype(np.float64)
        block = table.column("block").to_numpy()
        leaf, low, high = (k.as_py() for k in key)
        lists = table.column("leaves").to_pylist()
        # Which earlier leaves each class lies in: pairs that meet in one of those are counted there.
        earlier = sorted({v for own in lists for v in own if v < leaf})
        number = {v: i for i, v in enumerate(earlier)}
        inside = np.zeros((len(lists), max(1, len(earlier))), np.float32)
        for i, own in enumerate(lists):
            inside[i, [number[v] for v in own if v < leaf]] = 1
        links, parent = np.zeros(len(node)), np.arange(len(node))
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for begin in range(0, len(left), 512):
            some = left[begin : begin + 512]
            near = x[some] @ x[right].T >= least
            if low == high:
                near &= some[:, None] < right[None, :]
            fresh = near & (inside[some] @ inside[right].T == 0)
            links[some] += fresh @ rows[right]
            links[right] += rows[some] @ fresh
            while True:
                apart = near & (parent[some][:, None] != parent[right][None, :])
                asks = np.flatnonzero(apart.any(axis=1))
                if not len(asks):
                    break
                _unite(parent, some[asks], right[apart[asks].argmax(axis=1)])
        links = np.rint(links).astype(np.int64)
        partner = node[parent]
        keep = (links > 0) | (partner != node)
        return pa.table({"node": node[keep], "links": links[keep], "partner": partner[keep]})

    return run


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, trees: int = 5, leaf_rows: int = 512, spill: float = 0.1, seed: int = 5) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest id reachable), kept."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    usable = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda v: v != 0)
    node = F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "vector"))
    rows = rows.withColumn("node", node)
    classes = written(rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("vector").alias("vector"), F.first("label").alias("label")
    ).withColumn("root", F.xxhash64("label", F.size("vector"))).drop("label"))
    leaves = written(leaves_of(classes, trees=trees, leaf_rows=leaf_rows, spill=spill, seed=seed))
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(_BLOCK)).cast("int").alias("blocks"))
    lists = leaves.groupBy("node").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    placed = leaves.join(sizes, "leaf").join(lists, "node").join(classes.select("node", "rows", "vector"), "node")
    own = F.pmod(F.xxhash64("node", "leaf"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "rows", "vector", "leaves", "block")
    found = written(placed.groupBy("leaf", "low", "high").applyInArrow(_compared(least), "node long, links long, partner long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("partner").alias("b")))
    labelled = written(classes.select("node", "rep", "rows").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    smallest = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    groups = written(labelled.join(smallest, "label").join(counts, "node", "left").select(
        "node", "component_id", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    ))
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "node").join(groups, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )
