"""Best-fit packing by sums of squares.

Documents are encoded where they are read; longer ones are cut into pieces of the sequence length, the first
piece being the shorter one.  Only the pieces' numbers (not ids or texts) are dealt by row number to packing
groups of about ``group_docs`` documents.  In a group, longest first, every piece goes to the open sequence after
which the sum of squared counts of open sequences per residual gap is smallest; ties go to the tighter gap, and a
new sequence is opened only where the piece fits in none.  A group leaves a handful of sequences open, so the
number of groups hardly counts.

NULL and empty texts are documents with the end id alone.  Repeated rows are packed once each.  NULL ids are
kept as they are.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from slatework.llm.encoding import encoder, runs, slices, with_end

_MIX = np.uint64(0x9E3779B97F4A7C15)


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, taken in the order given."""
    open_at = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequences, offsets, fresh = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, size in enumerate(sizes.tolist()):
        gap = capacity
        if size < capacity:
            old = open_at[size:capacity]
            # Change of the sum of squares, less two, when a sequence of gap g becomes one of gap g - size.
            change = np.where(old > 0, 2 * (open_at[: capacity - size] - old), never)
            if old[0] > 0:
                change[0] = -2 * old[0] - 1
            best = int(change.argmin())
            if change[best] != never:
                gap = size + best
        if gap == capacity:
            sequence, fresh = fresh, fresh + 1
        else:
            sequence = stacks[gap].pop()
            open_at[gap] -= 1
        left = gap - size
        if left:
            stacks[left].append(sequence)
            open_at[left] += 1
        sequences[i], offsets[i] = sequence, capacity - gap
    return sequences, offsets


def _pieces_of(json_path, ranks_path, pattern, end_id, capacity, groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(json_path, ranks_path, pattern), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, sizes = with_end(*encode.encode(batch.column("text")), end_id)
                counts = -(-sizes // capacity)
                total = int(counts.sum())
                row = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
                first = sizes - (counts - 1) * capacity
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                at = (np.cumsum(sizes) - sizes)[row] + start
                view = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                # Dealt by row number: rows with equal ids spread like all others, and a rerun deals alike.
                with np.errstate(over="ignore"):
                    mixed = (np.uint64(part << 40) + (seen + np.arange(total)).astype(np.uint64)) * _MIX
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
                seen += total
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                        pa.array(crc, pa.int64()), pa.array(((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)),
                        pa.array((np.uint64(part << 40) + (seen + np.arange(total)).astype(np.uint64)).astype(np.int64)),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "pack_group", "dealt"],
                )

    return run


def _packed(capacity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["pack_group"]):
            sequence, offset = place(rows.column("length").to_numpy(), capacity)
            group = rows.column("pack_group")[0].as_py()
            rows = rows.append_column("sequence_id", pa.array((group << 36) + sequence)).append_column("offset", pa.array(offset))
            yield from rows.drop_columns(["pack_group", "dealt"]).to_batches()

    return run


def pack(docs: DataFrame, *, json_path: str, ranks_path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, group_docs: int = 8192) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    groups = max(1, round(docs.count() / group_docs))
    kind = docs.schema[doc_id].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _pieces_of(json_path, ranks_path, pattern, end_id, capacity, groups), f"{columns}, pack_group long, dealt long"
    )
    dealt = pieces.repartition(groups, "pack_group").sortWithinPartitions("pack_group", F.desc("length"), "dealt")
    return dealt.mapInArrow(_packed(capacity), f"{columns}, sequence_id long, offset long")
