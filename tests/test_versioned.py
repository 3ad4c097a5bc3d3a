"""Versioned tables: refreshes are seen whole or not at all, and read only what they touch."""

import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from slatework.sources import versioned

D = [date(2024, 1, n) for n in range(1, 6)]


def make(spark, rows):
    return spark.createDataFrame(rows, "k int, d date, v int")


def shown(spark, path, **options):
    return sorted(((r["k"], r["d"], r["v"]) for r in versioned.read_table(spark, path, partition="d", **options).collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    versioned.create_table(make(spark, [(1, D[0], 1), (2, D[0], 2), (3, D[1], 3), (4, D[2], 4), (5, None, 5)]), path, keys=["k"], partition="d")
    return path


OPTIONS = {"keys": ["k"], "order": "v", "partition": "d"}


def test_moves_updates_inserts_and_emptied_dates(spark, table):
    assert versioned.refresh_table(spark, table, make(spark, [(3, D[3], 30), (1, D[0], 10), (1, D[0], 9), (6, D[4], 60)]), **OPTIONS) == 1
    want = [(1, D[0], 10), (2, D[0], 2), (3, D[3], 30), (4, D[2], 4), (5, None, 5), (6, D[4], 60)]
    assert shown(spark, table) == sorted(want, key=repr)
    # A key that moved before is found where it went, and the date without a value is a date like others.
    versioned.refresh_table(spark, table, make(spark, [(3, D[0], 31), (5, D[2], 50), (6, None, 61)]), **OPTIONS)
    want = [(1, D[0], 10), (2, D[0], 2), (3, D[0], 31), (4, D[2], 4), (5, D[2], 50), (6, None, 61)]
    assert shown(spark, table) == sorted(want, key=repr)
    assert shown(spark, table, version=0) == sorted([(1, D[0], 1), (2, D[0], 2), (3, D[1], 3), (4, D[2], 4), (5, None, 5)], key=repr)


def test_reader_between_steps_sees_the_old_state(spark, table, monkeypatch):
    before = shown(spark, table)
    updates = make(spark, [(1, D[3], 100), (7, D[0], 70)])

    def fail(*_):
        raise RuntimeError("lost before publishing")

    with monkeypatch.context() as patch:
        patch.setattr(versioned, "_publish", fail)
        with pytest.raises(RuntimeError):
            versioned.refresh_table(spark, table, updates, **OPTIONS)
    assert shown(spark, table) == before and versioned.versions(spark, table) == [0]
    versioned.refresh_table(spark, table, updates, **OPTIONS)
    assert (1, D[3], 100) in shown(spark, table) and (7, D[0], 70) in shown(spark, table) and len(shown(spark, table)) == 6


def test_untouched_dates_are_neither_read_nor_rewritten(spark, table):
    versioned.refresh_table(spark, table, make(spark, [(2, D[1], 20)]), **OPTIONS)
    files = versioned.read_table(spark, table, partition="d").select(F.input_file_name().alias("f"), "d").distinct().collect()
    written = {r["d"]: r["f"].split("__version=")[1][0] for r in files}
    assert written == {D[0]: "1", D[1]: "1", D[2]: "0", None: "0"}


def test_all_rows_leave_and_vacuum(spark, table):
    for n in range(3):
        versioned.refresh_table(spark, table, make(spark, [(k, D[n], k * 10 + n) for k in range(1, 6)]), **OPTIONS)
    assert shown(spark, table) == [(k, D[2], k * 10 + 2) for k in range(1, 6)]
    versioned.vacuum(spark, table, keep=1)
    assert versioned.versions(spark, table) == [3] and shown(spark, table) == [(k, D[2], k * 10 + 2) for k in range(1, 6)]
    versioned.refresh_table(spark, table, make(spark, [(1, D[4], 99)]), **OPTIONS)
    assert (1, D[4], 99) in shown(spark, table) and len(shown(spark, table)) == 5


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "empty")
    versioned.create_table(make(spark, []), path, keys=["k"], partition="d")
    assert shown(spark, path) == []
    versioned.refresh_table(spark, path, make(spark, [(1, D[0], 1)]), **OPTIONS)
    assert shown(spark, path) == [(1, D[0], 1)]
