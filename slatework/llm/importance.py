"""Importance resampling towards a target, with hashed n-grams read off prefix CRCs.

Every text is scanned once.  Its bytes are normalised (letters A-Z lower-cased, every separator one space) and the
running CRC-32 is stored at the end of each word.  The CRC of any n-gram then follows from two stored prefixes
without looking at its bytes again: ``crc(AB) = shift(crc(A), len(B)) XOR crc(B)``, so the earlier prefix, shifted over
the n-gram's length by a linear map over GF(2), cancels out of the later one.  The hashed features of a text are
written as one binary value and give both passes that follow: the counts of all buckets, and the mean gain of a
text.  Gains are as many numbers as there are buckets, a parameter, whatever the size of the corpus.  Texts are
drawn without replacement as the highest sums of mean gain and Gumbel noise that a digest of the key fixes.

NULL, empty and wordless texts have no features, weight 0 and a score, and are never drawn.  NULL keys draw as the key
'' and come last among ties; rows of equal score and key are ordered by the hash of their text, and equal rows get
different ranks.  Extra columns travel along as far as ``keep`` names them; those named like an added column are
replaced by it.  An empty table of either kind is a corpus with all counts 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, functions as F

from slatework.llm.common import free_of, written
from slatework.llm.encoding import slices
from slatework.operators.ordering import with_positions

ADDED = ["n_words", "n_features", "weight", "score", "rank"]
_POLYNOMIAL = 0xEDB88320
_STEPS = 64
#: Scores are counted by runs of so many before the highest are sorted.
_BIN = 64


def _normal() -> bytes:
    """The byte map: A-Z to a-z, digits, a-z and bytes of other characters kept, the rest to spaces."""
    kept = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    table = bytearray(b" " * 256)
    for byte in kept:
        table[byte] = byte
    for byte in range(0x41, 0x5B):
        table[byte] = byte + 0x20
    return bytes(table)


NORMAL = _normal()


class Shifts:
    """Linear maps over GF(2) that move a CRC over zero bytes, as byte-wise tables."""

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(_POLYNOMIAL), byte >> 1)
        self.byte = byte.astype(np.uint32)
        basis = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        near = [basis]
        for _ in range(_STEPS):
            near.append(self.byte[near[-1] & 255] ^ (near[-1] >> 8))
        #: Shifts by 0 to 63 bytes, then by 64, 128, 256, ... bytes.
        self.near = np.stack(near[:_STEPS])
        self.far = [near[_STEPS]]

    @staticmethod
    def _mapped(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]

    def space(self, crc: np.ndarray) -> np.ndarray:
        """The running CRC after one more space."""
        state = ~crc
        return ~(self.byte[(state ^ 0x20) & 255] ^ (state >> 8))

    def shift(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        flat = self.near.reshape(-1)
        base = (size % _STEPS) * 1024
        out = flat[base + (crc & 255)] ^ flat[base + 256 + ((crc >> 8) & 255)] ^ flat[base + 512 + ((crc >> 16) & 255)] ^ flat[base + 768 + (crc >> 24)]
        more, power = size // _STEPS, 0
        while more.any():
            if power == len(self.far):
                self.far.append(self._mapped(self.far[-1], self.far[-1]))
            rows = np.flatnonzero(more & 1)
            out[rows] = self._mapped(self.far[power], out[rows])
            more, power = more >> 1, power + 1
        return out


_shifts: list[Shifts] = []


def shifts() -> Shifts:
    if not _shifts:
        _shifts.append(Shifts())
    return _shifts[0]


def _next(crc: int, piece: bytes) -> int:
    return crc32(piece, crc)


def features(texts: Sequence[bytes], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``n`` words of each text, with the words and the features per text."""
    split = [t.translate(NORMAL).split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    words = [w for own in split for w in own]
    if not words:
        return np.empty(0, np.int64), counts, np.zeros(len(counts), np.int64)
    maps = shifts()
    ends = np.fromiter(accumulate((b" " + w for w in words), _next, initial=0), np.uint32, len(words) + 1)
    starts, ends = maps.space(ends[:-1]), ends[1:]
    last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.concatenate([[0], last[:-1]]) + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    found, owners = [], []
    for run in range(1, n + 1):
        heads = np.flatnonzero(owner[: len(words) - run + 1] == owner[run - 1 :]) if run <= len(words) else np.empty(0, np.int64)
        tails = heads + run - 1
        crc = ends[tails] ^ maps.shift(starts[heads], last[tails] - begin[heads])
        found.append(crc.astype(np.int64) % buckets)
        owners.append(owner[heads])
    found, owners = np.concatenate(found), np.concatenate(owners)
    return found[np.argsort(owners, kind="stable")], counts, np.bincount(owners, minlength=len(counts))


def _scan(text: str, keep: list[str], n: int, buckets: int):
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                found, words, sizes = features(pc.fill_null(batch.column(text), "").cast(pa.binary()).to_pylist(), n, buckets)
                ends = np.concatenate([[0], np.cumsum(sizes) * kind().itemsize]).astype(np.int64)
                packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(found.astype(kind))])
                columns = [pa.array(words), pa.array(sizes, pa.int64()), packed.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=[*keep, "__words", "__size", "__found"])

    return run


def _codes(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    data = batch.column("__found")
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    held = data.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.empty(0, np.uint8)
    return raw.view(kind), (ends - ends[0]) // kind().itemsize


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "__found"):
                counts += np.bincount(_codes(batch, buckets)[0], minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held])], names=["bucket", "n"])

    return run


def _weighed(gains: np.ndarray, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__found"):
                codes, ends = _codes(batch, len(gains))
                sums = np.concatenate([[0], np.cumsum(gains[codes])])
                sums, sizes = sums[ends[1:]] - sums[ends[:-1]], np.diff(ends)
                weight = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(weight)], names=[*keep, "__weight"])

    return run


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def scanned(docs: DataFrame, *, text: str, keep: Sequence[str], n: int, buckets: int) -> DataFrame:
    """The kept columns with the number of words and the buckets of all features, written: each text is read once."""
    keep = list(keep)
    narrow = docs.select(*dict.fromkeys([*keep, text]))
    return written(narrow.mapInArrow(_scan(text, keep, n, buckets), f"{_fields(docs, keep)}__words long, __size long, __found binary"))


def bucket_counts(scans: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket: counted per task, added up by bucket; as many numbers as buckets reach the driver."""
    parts = scans.select("__found").mapInArrow(_counted(buckets), "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(target: np.ndarray, source: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Per bucket: the floored, scaled log ratio of its smoothed shares in target and source."""
    t, s = target.astype(np.float64), source.astype(np.float64)
    size = len(t)
    ratio = (t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def noise(key: Column, seed: int, scale: int = 1000) -> Column:
    """Floored, scaled Gumbel noise from the first 8 hex digits of the sha256 of ``<seed>:<key>``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(float(-scale)) * F.ln(-F.ln((drawn + 0.5) / 4294967296.0))).cast("long")


def _cut(able: DataFrame, percent: int) -> tuple[int, int]:
    """How many rows are drawn, and the bin of the lowest score drawn.

    Gains and noise lie within some 100 times their scale, so the bins are a few thousand however many rows there are.
    """
    bins = able.groupBy(F.floor(F.col("__score") / _BIN).alias("bin")).count().orderBy(F.desc("bin")).collect()
    wanted = sum(r["count"] for r in bins) * percent // 100
    left = wanted
    for row in bins:
        left -= row["count"]
        if left <= 0:
            return wanted, row["bin"]
    return wanted, 0


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", keep: Sequence[str] = ("doc_id",), n: int = 2, buckets: int = 10_000, seed: int = 7, min_words: int = 20, percent: int = 25) -> DataFrame:
    """The kept columns with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    ``rank`` is 1, 2, 3, ... over the ``percent`` of the texts of at least ``min_words`` words that are drawn, and NULL elsewhere.
    Only the narrow rows that can be drawn are sorted, by range, never in one task.
    """
    kept = free_of(list(keep), ADDED)
    names = [f"__k{i}" for i in range(len(kept))]
    masked = docs.select(*[F.col(c).alias(m) for c, m in zip(kept, names)], F.col(key).alias("__key"), F.xxhash64(text).alias("__hash"), F.col(text).alias("__text"))
    carried = [*names, "__key", "__hash"]
    own = scanned(masked, text="__text", keep=carried, n=n, buckets=buckets)
    aim = scanned(target.select(F.col(target_text).alias("__text")), text="__text", keep=[], n=n, buckets=buckets)
    gain = gains(bucket_counts(aim, buckets), bucket_counts(own, buckets))
    carried += ["__words", "__size"]
    weighed = own.mapInArrow(_weighed(gain, carried), f"{_fields(own, carried)}__weight long")
    scored = written(weighed.withColumn("__score", F.col("__weight") + noise(F.col("__key"), seed)))
    able = F.col("__words") >= min_words
    wanted, cut = _cut(scored.where(able), percent)
    high = able & (F.floor(F.col("__score") / _BIN) >= cut)
    order = [F.desc("__score"), F.asc_nulls_last("__key"), F.asc("__hash")]
    # Rows below the cut's bin are out and rows without a rank; only the others are sorted.
    placed = with_positions(scored.where(high), [], order, "__at", "__of")
    ranked = placed.withColumn("__rank", F.when(F.col("__at") < wanted, F.col("__at") + 1).cast("long")).drop("__at", "__of")
    rest = scored.where(~high).withColumn("__rank", F.lit(None).cast("long"))
    out = dict(zip(ADDED, ("__words", "__size", "__weight", "__score", "__rank")))
    return ranked.unionByName(rest).select(*[F.col(m).alias(c) for c, m in zip(kept, names)], *[F.col(v).alias(k) for k, v in out.items()])
