"""Near duplicates against brute force on full sets."""

import random
import re

import pytest

from slatework.llm.minhash import near_duplicates
from slatework.llm.queries import QUERIES


def brute(rows, size, percent=80):
    """doc index -> (set size, smallest id reachable)."""
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(find(i), doc_id)) for i, (doc_id, _) in enumerate(rows)]


def result(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, bands int")
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df, **options).collect()), key=str)


def edited(draw, words, share):
    out = list(words)
    for i in range(len(out)):
        if draw.random() < share:
            out[i] = f"x{draw.randrange(10**9)}"
    return out


@pytest.fixture(scope="module")
def families():
    """Families of copies around the threshold: stars, chains, and documents that share a passage only."""
    draw, rows = random.Random(3), []
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [draw.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([8, 30, 120, 400]))]
        rows.append(base)
        rows += [edited(draw, base, draw.choice([0.0, 0.01, 0.02, 0.03, 0.05])) for _ in range(9)]
        last = base
        for _ in range(4):
            last = edited(draw, last, 0.015)
            rows.append(last)
    rows += [passage + [draw.choice(vocabulary) for _ in range(draw.choice([20, 40]))] for _ in range(25)]
    draw.shuffle(rows)
    return [(i, " ".join(words)) for i, words in enumerate(rows)]


@pytest.mark.parametrize("size", [4, 5])
def test_components_equal_brute_force(spark, families, size):
    assert result(spark, families, shingle=size) == sorted(brute(families, size), key=str)


def test_rows_without_id_are_linked(spark):
    """NULL ids by near copies: between ids, among themselves, and as the only bridge of a chain."""
    draw = random.Random(9)
    rows = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(120)]
        rows += [(None if group % 2 else 10 * group + 5, " ".join(base)), (None, " ".join(edited(draw, base, 0.02))), (None, " ".join(base[:110]))]
        rows.append((10 * group + 1 if group < 4 else None, " ".join(base[:100])))
    assert result(spark, rows, shingle=4) == sorted(brute(rows, 4), key=str)


def test_corner_cases(spark):
    long_text = " ".join(f"l{i % 7000}" for i in range(30_000))
    rows = [
        (5, None), (6, ""), (7, " \n\t "), (8, "One Two"), (3, "one\ttwo"), (9, "one"), (2, "one"), (2, "one"),
        (20, long_text), (21, long_text + " tail"), (None, "one"), (None, "alone here"), (30, "École a b c d"), (31, "école a b c d"),
    ]
    assert result(spark, rows, shingle=4) == sorted(brute(rows, 4), key=str)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_one_document_of_a_hot_group_stays(spark):
    base = [f"w{i}" for i in range(200)]
    draw = random.Random(1)
    rows = [(i, " ".join(base)) for i in range(100, 300)] + [(i, " ".join(edited(draw, base, 0.012))) for i in range(300, 500)]
    got = result(spark, rows, shingle=5)
    assert got == sorted(brute(rows, 5), key=str)


def test_query_columns(spark):
    df = QUERIES["op1_minhash_dedup"](spark, "/root/testdata/sf0.001")
    assert df.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
