"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest

from slatework.llm.vector_forest import leaves_of, near_vectors


def brute(rows, least=0.98):
    unit = []
    for _, v, label in rows:
        x = None if v is None or label is None or any(a is None for a in v) else np.array(v, float)
        ok = x is not None and len(x) and np.isfinite(x).all() and (x != 0).any()
        unit.append(x / np.sqrt((x * x).sum()) if ok else None)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    lowest = {}
    for i, r in enumerate(rows):
        lowest[find(i)] = min(r[0], lowest.get(find(i), r[0]))
    return sorted((r[0], links[i], lowest[find(i)], r[0] == lowest[find(i)]) for i, r in enumerate(rows))


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, leaf int")
    return sorted(tuple(r) for r in near_vectors(df, **options).collect())


@pytest.fixture(scope="module")
def clusters():
    draw = np.random.default_rng(2)
    rows = []
    for centre in range(60):
        base = draw.normal(size=64)
        for _ in range(draw.integers(1, 9)):
            # Angles up to and beyond the threshold.
            noise = draw.normal(size=64) * draw.choice([0.0, 0.05, 0.12, 0.16, 0.2])
            rows.append((base + noise).astype(np.float32).tolist())
    base = draw.normal(size=64)
    rows += [(base + draw.normal(size=64) * 0.03).astype(np.float32).tolist() for _ in range(150)]
    order = draw.permutation(len(rows))
    return [(int(i), rows[j], int(j % 2)) for i, j in enumerate(order)]


@pytest.mark.parametrize("leaf_rows", [12, 64, 512])
def test_links_equal_brute_force(spark, clusters, leaf_rows):
    assert result(spark, clusters, leaf_rows=leaf_rows) == brute(clusters)


def test_leaves_shrink(spark, clusters):
    from pyspark.sql import functions as F

    classes = spark.createDataFrame([(i, 1, v) for i, v, _ in clusters[:200]], "node long, root long, vector array<double>")
    sizes = leaves_of(classes, trees=4, leaf_rows=20, spill=0.25, seed=1).groupBy("leaf").count()
    assert sizes.agg(F.min("count")).first()[0] < 40 and sizes.count() > 16


def test_small_labels_are_split_too(spark):
    from pyspark.sql import functions as F

    apart = np.random.default_rng(6).normal(size=(90, 32)).tolist()
    classes = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(apart)], "node long, root long, vector array<double>")
    leaves = leaves_of(classes, trees=5, leaf_rows=512, spill=0.1, seed=1)
    assert leaves.select("leaf").distinct().count() >= 3 * 5 * 4 and leaves.groupBy("leaf").count().agg(F.max("count")).first()[0] < 20


def test_recall_in_one_large_label(spark):
    """20,000 rows of one label whose noise lies around the threshold; copies stay few."""
    from pyspark.sql import functions as F

    draw = np.random.default_rng(8)
    base = draw.normal(size=(5000, 48))
    x = np.repeat(base, 4, axis=0) + draw.normal(size=(20000, 48)) * draw.choice([0.04, 0.09, 0.12], size=(20000, 1))
    x = x.astype(np.float32).astype(float)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    true = np.zeros(len(x), int)
    for begin in range(0, len(x), 2000):
        true[begin : begin + 2000] = (unit[begin : begin + 2000] @ unit.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(8)
    found = {r["vec_id"]: r["n_links"] for r in near_vectors(df).collect()}
    assert all(found[i] <= true[i] for i in range(len(x)))
    assert true.sum() > 10000 and sum(found.values()) >= 0.98 * true.sum()
    classes = df.select(F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("root"), F.col("embedding").alias("vector"))
    assert leaves_of(classes, trees=5, leaf_rows=512, spill=0.1, seed=5).count() < 12 * len(x)


def test_corner_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None),
        (9, [1.0, 0.0], 1), (10, [2.0, 0.0], 1), (11, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1.0, 0.0], 2), (14, [-1.0, 0.0], 1),
        (15, [1e-30, 0.0], 1), (16, [3e30, 1e28], 1),
    ]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
