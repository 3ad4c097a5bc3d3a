"""Near-duplicate documents by one-permutation MinHash.

A document's set holds the 64-bit hashes of its distinct word shingles.  One permutation fills the bins of the
signature; empty bins borrow from the first filled bin of their own fixed random order (optimal densification).
Runs of bins are bands, equal bands are buckets.  Documents with equal sets form one class, and only classes go into
buckets.  A bucket's candidates form a star: its best-connected class is compared with all others, on the full sets, so
a bucket of n alike classes costs n pairs.  Buckets whose members end in one component are done.  In the others an
exact pass looks for links between different components, in blocks of members and without writing pairs: only one
candidate link per pair of components leaves it, and it is confirmed on the full sets like all others.

A document with fewer words than a shingle has one shingle, its whole sequence.  NULL, empty and blank texts have
empty sets and are linked with nothing.  Repeated rows fall into one class.  Rows with
a NULL id are linked like all others; their component_id is NULL where no row of their component has an id.  An empty table
gives an empty result.  Extra columns are not carried; join the result on the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from slatework.llm.common import written
from slatework.llm.components import components
from slatework.llm.encoding import runs, slices
from slatework.operators.ordering import top_rows

#: Members of a bucket that are compared in one task at most with as many others.
_BLOCK = 256
_SPACE = r"[\x20\x09-\x0D]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    parts = pc.split_pattern_regex(pc.ascii_trim(lowered, " \t\n\x0b\f\r"), _SPACE)
    coded = parts.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    offsets = parts.offsets.to_numpy()
    offsets = (offsets - offsets[0]).tolist()
    words = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = words.copy()
        for k in range(1, size):
            whole = max(0, len(words) - k)
            rolled[:whole] = rolled[:whole] * _STEP + words[k:]
        rolled = _mixed(rolled)
        out = []
        for begin, end in zip(offsets, offsets[1:]):
            if end - begin >= size:
                out.append(np.unique(rolled[begin : end - size + 1]))
            elif words[begin:end].any():
                own = np.uint64(end - begin)
                for w in words[begin:end]:
                    own = own * _STEP + w
                out.append(_mixed(np.array([own])))
            else:
                out.append(np.empty(0, np.uint64))
    return out


class Signer:
    """Signatures of ``bands`` times ``rows`` bins, as one hash per band."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        draw = np.random.default_rng(seed)
        self.borrow = np.array([draw.permutation(self.bins) for _ in range(self.bins)], np.int32)
        self.salt = draw.integers(1, 1 << 62, bands).astype(np.uint64)

    def bands_of(self, hashes: np.ndarray) -> np.ndarray:
        """``hashes`` sorted and not empty: the first of each bin is its minimum."""
        at = (((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        filled = np.zeros(self.bins, bool)
        signature = np.zeros(self.bins, np.uint64)
        filled[at[first]] = True
        signature[at[first]] = hashes[first]
        if len(first) < self.bins:
            empty = np.flatnonzero(~filled)
            order = self.borrow[empty]
            signature[empty] = signature[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
        with np.errstate(over="ignore"):
            out = self.salt.copy()
            for column in signature.reshape(self.bands, self.rows).T:
                out = _mixed(out * _STEP + column)
        return out.view(np.int64)


def _class_of(hashes: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else None


def _signed(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), size)
                node = [_class_of(s) for s in sets]
                band = [signer.bands_of(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(band, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "node", "bands"],
                )

    return run


def _sets_of(size: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), size)
                yield pa.RecordBatch.from_arrays([
                        pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array([(s >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets], pa.list_(pa.int32())),
                    ],
                    names=["node", "hashes", "short"],
                )

    return run


def _linked(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    sizes = (F.size("ha"), F.size("hb"))
    bounded = denominator * F.least(*sizes) >= numerator * F.greatest(*sizes)
    shared = F.size(F.array_intersect("ha", "hb"))
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b"
    )
    alike = denominator * shared >= numerator * (sizes[0] + sizes[1] - shared)
    return joined.where(F.when(bounded, alike).otherwise(False)).select("a", "b")


def _rest_links(least: float):
    """Links that join different components of a bucket, one per pair of components, from its members' short sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["bucket", "low", "high"]):
            node, label = rows.column("node").to_numpy(), rows.column("label").to_numpy()
            short = rows.column("short").combine_chunks()
            sizes = np.diff(short.offsets.to_numpy())
            _, code = np.unique(short.flatten().to_numpy(), return_inverse=True)
            owner = np.repeat(np.arange(len(node)), sizes)
            order = np.argsort(code, kind="stable")
            holders, starts = owner[order], np.searchsorted(code[order], np.arange(code.max() + 2))
            ends = np.cumsum(sizes)
            _, group = np.unique(label, return_inverse=True)
            block, low, high = rows.column("block").to_numpy(), rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
            largest = np.bincount(group).argmax()
            links = []
            # Each pair of components has a side outside the largest one, and that side asks.
            for i in np.flatnonzero(group != largest):
                other = (group != group[i]) & ((block != block[i]) if low != high else True)
                if not other.any():
                    continue
                own = code[ends[i] - sizes[i] : ends[i]]
                shared = np.bincount(np.concatenate([holders[starts[c] : starts[c + 1]] for c in own]), minlength=len(node))
                for j in np.flatnonzero(other & (shared >= least * (sizes + sizes[i] - shared))):
                    if group[i] != group[j]:
                        links.append((int(node[i]), int(node[j])))
                        group[group == group[i]] = group[j]
            if links:
                left, right = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["a", "b"])

    return run


def star_links(members: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Components (node, label) of the classes in ``members`` (bucket, node, n, degree)."""
    centres = written(top_rows(members, ["bucket"], [F.desc("degree"), F.col("node")]).select("bucket", F.col("node").alias("centre"), F.col("n").alias("centre_n")))
    near = denominator * F.least("n", "centre_n") >= numerator * F.greatest("n", "centre_n")
    pairs = members.join(centres, "bucket").where((F.col("node") != F.col("centre")) & near)
    pairs = pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    links = written(_linked(pairs, sets, numerator, denominator))
    labels = components(links)
    rest = written(members.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    wide = rest.groupBy("bucket").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.ceil(F.count(F.lit(1)) / F.lit(_BLOCK)).cast("int").alias("blocks"))
    rest = written(rest.join(wide.where("first < last").select("bucket", "blocks"), "bucket"))
    if rest.isEmpty():
        return labels
    # Large buckets are compared block by block, over many tasks.
    placed = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "label", "block")
    placed = placed.join(sets.select("node", "short"), "node").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")
    found = written(placed.mapInArrow(_rest_links(numerator / denominator), "a long, b long").distinct())
    return components(links.union(_linked(found, sets, numerator, denominator)))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable), kept, and the class ``node``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = written(texts.mapInArrow(_signed(shingle, bands, rows), f"doc_id {kind}, n_shingles long, node long, bands array<long>"))
    full = signed.where(F.col("node").isNotNull())
    classes = full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes)
    in_band = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = in_band.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    members = written(in_band.join(shared.select("bucket", "size"), "bucket"))
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    members = written(members.drop("size").join(degree, "node"))
    if members.isEmpty():
        groups = classes.select("node", F.col("rep").alias("component_id"))
    else:
        wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("rep").alias("doc_id")).where("doc_id is not null")
        # The class is worked out from the text again, so ids that occur with different texts do no harm.
        # Rows without an id cannot be asked for by it: their texts are all read.
        held = texts.where("doc_id is not null").join(wanted, "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))
        by_class = held.mapInArrow(_sets_of(shingle), "node long, hashes array<long>, short array<int>")
        sets = written(by_class.where(F.col("node").isNotNull()).dropDuplicates(["node"]))
        labels = star_links(members, sets, percent, 100)
        labelled = classes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        labelled = written(labelled)
        smallest = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
        groups = labelled.join(smallest, "label").select("node", "component_id")
    groups = written(groups)
    out = signed.select("doc_id", "n_shingles", "node").join(groups, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), "node")
