"""Packed token-id matrices by best-fit decreasing.

Documents are encoded where they are read and cut into pieces of at most the sequence length, nothing being lost.
Pieces with their ids are dealt by row number to groups of about ``group_docs`` documents.  In a group, longest first,
a piece goes into the fullest sequence it fits in, which a segment tree over the residual capacities finds in
logarithmic time, or else opens a new one.  Each sequence is a row: ids padded to the sequence length, cumulative
lengths of its segments, and positions that start again at each segment.

NULL and empty texts are documents with the end id alone.  Repeated rows are packed once each; NULL ids stay NULL.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from slatework.llm.encoding import encoder, runs, slices, with_end

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Capacities:
    """Open sequences by residual capacity, with a segment tree that finds the least sufficient one."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.stacks: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.stacks[capacity].append(sequence)
        at = capacity + self.width
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, sequence) with the least capacity of ``size`` or more, removed."""
        at = size + self.width
        if not self.count[at]:
            # Up until a right-hand neighbour holds something, then down to its leftmost.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.width
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, self.stacks[capacity].pop()


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Sequence of each piece, pieces given longest first, and the number of sequences."""
    tree, out, fresh = Capacities(capacity), np.empty(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        found = tree.take(size) if size < capacity else None
        if found is None:
            found, fresh = (capacity, fresh), fresh + 1
        room, sequence = found
        out[i] = sequence
        if room > size:
            tree.put(room - size, sequence)
    return out, fresh


def _pieces_of(json_path, ranks_path, pattern, end_id, capacity, groups, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(json_path, ranks_path, pattern), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, sizes = with_end(*encode.encode(batch.column("text")), end_id)
                counts = -(-sizes // capacity)
                total = int(counts.sum())
                row = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                stored = memoryview(ids.astype(kind)).cast("B")
                wide = np.dtype(kind).itemsize
                at = ((np.cumsum(sizes) - sizes)[row] + start) * wide
                cut = [bytes(stored[a : a + n]) for a, n in zip(at.tolist(), (length * wide).tolist())]
                number = np.uint64(part << 40) + (seen + np.arange(total)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    mixed = (number ^ (number >> np.uint64(31))) * _MIX
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
                seen += total
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(cut, pa.binary()),
                        pa.array(((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)), pa.array(number.astype(np.int64)),
                    ],
                    names=["doc_id", "start", "length", "ids", "pack_group", "dealt"],
                )

    return run


def _matrices(capacity: int, pad_id: int, kind: str):
    def rows_of(group: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        length = table.column("length").to_numpy()
        sequence, total = best_fit(length, capacity)
        order = np.argsort(sequence, kind="stable")
        ends = np.cumsum(np.bincount(sequence, minlength=total))
        ids, docs, starts = table.column("ids"), table.column("doc_id"), table.column("start")
        count = np.arange(capacity)
        for first in range(0, total, 1024):
            last = min(total, first + 1024)
            rows = order[ends[first - 1] if first else 0 : ends[last - 1]]
            own_ids = ids.take(pa.array(rows)).to_pylist()
            matrix = np.full((last - first, capacity), pad_id, np.dtype(kind))
            resets = np.zeros((last - first, capacity), np.int32)
            cuts, at, line = [], 0, -1
            for row, stored in zip(rows, own_ids):
                if sequence[row] - first != line:
                    line, at = int(sequence[row] - first), 0
                    cuts.append([0])
                n = int(length[row])
                matrix[line, at : at + n] = np.frombuffer(stored, kind)
                resets[line, at : at + n] = count[:n]
                at += n
                cuts[-1].append(at)
            counts = np.array([len(c) - 1 for c in cuts])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((group << 36) + np.arange(first, last)), pa.array([c[-1] for c in cuts], pa.int32()),
                    pa.array([r.tobytes() for r in matrix], pa.binary()), pa.array(cuts, pa.list_(pa.int32())),
                    pa.array([r.tobytes() for r in resets.astype("<u2" if capacity < 65536 else "<u4")], pa.binary()),
                    pa.ListArray.from_arrays(offsets, docs.take(pa.array(rows)).combine_chunks()),
                    pa.ListArray.from_arrays(offsets, starts.take(pa.array(rows)).combine_chunks()),
                ],
                names=["sequence_id", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "starts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["pack_group"]):
            yield from rows_of(table.column("pack_group")[0].as_py(), table)

    return run


def pack_ids(docs: DataFrame, *, json_path: str, ranks_path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 50256, pad_id: int = 50256, kind: str = "<u2", group_docs: int = 4096) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids (``capacity`` numbers of ``kind``), cu_seqlens, positions, doc_ids, starts."""
    groups = max(1, round(docs.count() / group_docs))
    own = docs.schema[doc_id].dataType.simpleString()
    pieces = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _pieces_of(json_path, ranks_path, pattern, end_id, capacity, groups, kind), f"doc_id {own}, start long, length long, ids binary, pack_group long, dealt long"
    )
    dealt = pieces.repartition(groups, "pack_group").sortWithinPartitions("pack_group", F.desc("length"), "dealt")
    return dealt.mapInArrow(
        _matrices(capacity, pad_id, kind),
        f"sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<{own}>, starts array<long>",
    )


def write_matrices(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet, in the order of their numbers within each file."""
    packed.sortWithinPartitions("sequence_id").write.parquet(path)
