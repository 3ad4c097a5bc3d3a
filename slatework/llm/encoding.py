"""Token ids of whole texts, many texts at a time.

A text is cut at single spaces, where the tokenizer's own pattern cuts too, every distinct chunk is encoded
once and the ids are put together with numpy.  Texts with other white space, rare characters or the look of a
special token are encoded whole.  The ids are those of ``tokenizers`` with the JSON file; where the same
vocabulary is given as ranks, ``tiktoken`` encodes the chunks, at several times the speed.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts with anything but printable ASCII, Latin letters, common punctuation, single spaces and line ends.
_UNUSUAL = "[^\n\x20-\x7e¡-ɏ‐-‧‰-⁞€]|\n | \n|  |^[ \n]|[ \n]$|<\\|"
_CACHE_WORDS = 300_000
_CHUNK_BYTES = 2 << 20

_encoders: dict[tuple, Encoder] = {}


def encoder(json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = (json_path, ranks_path)
    if key not in _encoders:
        _encoders[key] = Encoder(json_path, ranks_path, pattern)
    return _encoders[key]


class Encoder:
    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.cache: dict[str, bytes] = {}
        self.ranked = None
        if ranks_path is not None:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        if len(self.cache) > _CACHE_WORDS:
            self.cache.clear()
        missing = [c for c in chunks if c not in self.cache]
        if self.ranked is not None:
            for c in missing:
                self.cache[c] = np.array(self.ranked.encode_ordinary(c), np.uint32).tobytes()
        else:
            for c, found in zip(missing, self.whole.encode_batch_fast(missing, add_special_tokens=False)):
                self.cache[c] = np.array(found.ids, np.uint32).tobytes()
        return [self.cache[c] for c in chunks]

    def _usual(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = offsets[:-1]
        known = coded.dictionary.to_pylist()
        first = [known[i] for i in codes[heads]]
        ids = self._chunk_ids([" " + w for w in known]) + self._chunk_ids(first)
        codes[heads] = len(known) + np.arange(len(first))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        starts = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        at = np.repeat(starts[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
        return flat[at], np.add.reduceat(each, heads)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text; NULL reads as ''."""
        if len(texts) == 0:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._usual(texts)
        pieces: list[np.ndarray] = [None] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            ids, sizes = self._usual(texts.take(pa.array(plain)))
            for i, own in zip(plain, np.split(ids, np.cumsum(sizes)[:-1])):
                pieces[i] = own
        for i in np.flatnonzero(odd):
            pieces[i] = np.array(self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)


def slices(batch: pa.RecordBatch, column: str):
    """The batch in runs of rows with a few MB of text each, so that one batch's arrays stay small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + _CHUNK_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, from batches sorted by them."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = tuple(c[begin] for c in columns)
            if held and key != current:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text."""
    out = np.full(len(ids) + len(sizes), end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(sizes) + np.arange(len(sizes))] = False
    out[own] = ids
    return out, sizes + 1
