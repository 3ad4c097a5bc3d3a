"""Importance resampling: CRCs off prefixes equal direct ones; draws equal a plain replay."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
from hypothesis import given, settings, strategies as st

from slatework.llm.importance import features, resample, shifts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n=2):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def replay(docs, target, *, n=2, buckets=10_000, seed=7, min_words=20, percent=25):
    coded = lambda text: [crc32(g.encode()) % buckets for g in grams(text, n)[0]]
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(coded(text))
    for text in target:
        t.update(coded(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    out = []
    for key, text in docs:
        own = coded(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, grams(text)[1], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=repr)


def rows():
    rng = np.random.default_rng(3)
    vocabulary = ["Alpha", "beta", "gamma9", "DÉJÀ", "漢字", "x" * 90, "İ", "don't", "a_b", "\x00z"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(300)]
    made = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, "..., !"), (1003, "Long Word " * 120_000), (1004, "y" * 70_000 + " end")]
    return made + [(2000 + i, texts[5]) for i in range(120)]


def frame(spark, data):
    return spark.createDataFrame([(*d, 1, "r") for d in data], "doc_id long, text string, rank int, SCORE string")


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


def test_draw_equals_a_replay(spark):
    target = ["beta gamma9 beta", None, "déjà don't"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert found(resample(frame(spark, rows()), goal)) == replay(rows(), target)
    options = {"n": 3, "buckets": 70_000, "seed": 9, "min_words": 5, "percent": 60}
    assert found(resample(frame(spark, rows()), goal, **options)) == replay(rows(), target, **options)


def test_repeated_and_missing_ids_get_different_ranks(spark):
    text = "one two three four five " * 6
    data = [(None, text)] * 40 + [(4, text)] * 40 + [(5, text + " six")] * 40
    got = resample(frame(spark, data), spark.createDataFrame([("one",)], "text string"), percent=50).collect()
    assert len(got) == 120 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 61))
    lowest = min(r["score"] for r in got if r["rank"])
    assert all(r["score"] <= lowest for r in got if not r["rank"])


def test_clashing_columns_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample(frame(spark, []), none).count() == 0
    out = resample(frame(spark, rows()[:50]), none, keep=("doc_id", "text", "rank", "SCORE"))
    assert out.columns == ["doc_id", "text", "n_words", "n_features", "weight", "score", "rank"]
    assert found(out) == replay(rows()[:50], [])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aZ9é漢 .\x00\x7f", max_size=40), max_size=8), st.integers(1, 4))
def test_crcs_off_prefixes(texts, n):
    got, words, sizes = features([t.encode() for t in texts], n, 1 << 32)
    cuts = np.cumsum(sizes)[:-1] if len(sizes) else []
    assert [sorted(map(int, own)) for own in (np.split(got, cuts) if texts else [])] == [sorted(crc32(g.encode()) for g in grams(t, n)[0]) for t in texts]
    assert words.tolist() == [grams(t)[1] for t in texts]


def test_shifts_of_any_length():
    sizes = np.array([0, 1, 63, 64, 65, 127, 4096, 100_003])
    crcs = np.array([crc32(b"head")] * len(sizes), np.uint32)
    moved = shifts().shift(crcs, sizes)
    for size, got in zip(sizes.tolist(), moved.tolist()):
        tail = bytes(i % 251 for i in range(size))
        assert got ^ crc32(tail) == crc32(b"head" + tail)
