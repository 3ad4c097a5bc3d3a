"""Packing: exact round trips, full sequences, few sequences."""

import collections
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from slatework.llm.encoding import Encoder
from slatework.llm.packing_ids import Capacities, best_fit, pack_ids
from slatework.llm.packing_squares import pack, place
from slatework.llm.queries import vocabulary

ODD = [None, "", " ", "a  b", " lead", "tail ", "line\nend", "line \n next", "tab\there", "x y", "<|endoftext|> here", "naïve café", "日本語 text", "emoji 🙂 x", "don't stop", "a\r\nb", "1234 5", "É. È"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary()["json_path"])


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(spark, tokenizer):
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for ranks in (vocabulary()["ranks_path"], None):
        ids, sizes = Encoder(vocabulary()["json_path"], ranks, vocabulary()["pattern"]).encode(pa.array(texts, pa.string()))
        for own, text in zip(np.split(ids, np.cumsum(sizes)[:-1]), texts):
            assert own.tolist() == ids_of(tokenizer, text), text


def rows_of(spark, extra=()):
    docs = [(i, t) for i, t in enumerate([*ODD, "word " * 5000, "same text", "same text", *extra])]
    return docs + [docs[-1], (None, "no id"), (None, "no id")]


def test_pieces_are_whole_and_sequences_gapless(spark, tokenizer):
    rows = rows_of(spark)
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, piece int, dealt int")
    out = pack(df, **vocabulary(), capacity=64).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = ids_of(tokenizer, t) + [2]
        count = -(-len(ids) // 64)
        first = len(ids) - 64 * (count - 1)
        for p in range(count):
            start = 0 if p == 0 else first + 64 * (p - 1)
            piece = ids[start : start + (first if p == 0 else 64)]
            want[(i, p, start, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    at = collections.defaultdict(list)
    for r in out:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty, **vocabulary()).collect() == [] and pack_ids(empty, **vocabulary()).collect() == []


def test_squares_choice_against_a_plain_version():
    draw = np.random.default_rng(4)
    sizes = np.sort(draw.integers(1, 40, 400))[::-1]
    fast, offsets = place(sizes, 40)
    gaps, choice = [], []
    for size in sizes.tolist():
        def squares(change):
            counts = collections.Counter(g for g in [*change] if 0 < g < 40)
            return sum(n * n for n in counts.values())
        fitting = sorted({g for g in gaps if g >= size})
        options = [(squares([*(x for k, x in enumerate(gaps) if k != gaps.index(g)), g - size]), g) for g in fitting]
        if options:
            gap = min(options)[1]
            gaps[gaps.index(gap)] = gap - size
        else:
            gap = 40
            gaps.append(40 - size)
        choice.append(40 - gap)
    assert offsets.tolist() == choice and fast.max() + 1 == len(gaps)


def test_squares_pack_tightly():
    sizes = np.sort(np.random.default_rng(1).integers(1, 1025, 4000))[::-1]
    sequences, _ = place(sizes, 1024)
    assert sequences.max() + 1 <= 1.03 * max(math.ceil(sizes.sum() / 1024), (sizes > 512).sum())


def test_segment_tree_finds_the_tightest():
    draw = np.random.default_rng(5)
    tree, held = Capacities(50), []
    for number in range(600):
        if draw.random() < 0.6:
            capacity = int(draw.integers(1, 51))
            tree.put(capacity, number)
            held.append(capacity)
        else:
            size = int(draw.integers(1, 51))
            found = tree.take(size)
            want = min((c for c in held if c >= size), default=None)
            assert (found and found[0]) == want
            if found:
                held.remove(want)
    sequences, total = best_fit(np.array([50, 30, 20, 20, 10]), 50)
    assert total == 3 and sequences.tolist() == [0, 1, 1, 2, 2]


def test_matrices_round_trip(spark, tokenizer):
    rows = rows_of(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    back = collections.Counter()
    pieces = collections.defaultdict(list)
    for r in pack_ids(df, **vocabulary(), capacity=64).collect():
        ids, positions = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        assert len(ids) == len(positions) == 64 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        assert (ids[r["n_tokens"] :] == 50256).all()
        for a, b, doc, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["starts"]):
            assert positions[a:b].tolist() == list(range(b - a))
            pieces[doc].append((start, tuple(ids[a:b].tolist())))
    for i, t in rows:
        ids = ids_of(tokenizer, t) + [50256]
        for start in range(0, len(ids), 64):
            back[(i, start, tuple(ids[start : start + 64]))] += 1
    assert back == collections.Counter((d, s, p) for d, x in pieces.items() for s, p in x)


def test_written_matrices_give_every_text_back(spark, tokenizer, tmp_path):
    """Files are read without Spark: ids, segment lengths and positions of all rows, and the texts they hold."""
    import pyarrow.parquet as pq

    from slatework.llm.packing_ids import write_matrices

    texts = {i: f"word{i} " * (i % 40) + "end é" for i in range(150)} | {900: None, 901: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    path = str(tmp_path / "matrices")
    write_matrices(pack_ids(df, **vocabulary(), capacity=64), path)
    parts: dict[int, list] = {}
    for row in pq.read_table(path).to_pylist():
        ids, positions = np.frombuffer(row["ids"], "<u2"), np.frombuffer(row["positions"], "<u2")
        cuts = row["cu_seqlens"]
        assert len(ids) == len(positions) == 64 and cuts[0] == 0 and cuts[-1] == row["n_tokens"] <= 64
        for begin, end, doc, start in zip(cuts, cuts[1:], row["doc_ids"], row["starts"]):
            assert positions[begin:end].tolist() == list(range(end - begin))
            parts.setdefault(doc, []).append((start, ids[begin:end].tolist()))
    whole = {doc: [i for _, ids in sorted(own) for i in ids] for doc, own in parts.items()}
    assert whole == {doc: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 50256] for doc, text in texts.items()}
