"""The pipeline: columns, decisions, planted cases."""

import pytest

import corpus_pipeline
from slatework.llm.common import table, written
from slatework.llm.queries import ORACLES, QUERIES
from slatework.verify import compare, oracle_connection

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    docs = table(spark, FOLDER, "documents")
    copy = docs.where("doc_id < 40").selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")
    docs = written(docs.union(copy).union(spark.createDataFrame([(200000, None, None, None, 0), (200001, "", "en", None, 0)], docs.schema)))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], FOLDER)))
    return out


def test_stages(kept):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for before, after in zip(kept[:-2], kept[1:-1]):
        assert after.columns == kept[0].columns and 0 < after.count() <= before.count()


def test_planted_cases(spark, kept):
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in kept]
    toxic = {r["doc_id"] for r in table(spark, FOLDER, "labels").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in table(spark, FOLDER, "labels").where("toxic = 0").collect()}
    assert len(toxic & ids[1]) <= 0.3 * len(toxic) and clean <= ids[1]
    assert not {200000, 200001} & ids[2] and len(ids[1]) - len(ids[2]) < 0.02 * len(ids[1])
    assert not any(i >= 100000 for i in ids[3])
    assert ids[5] == ids[4] < ids[3]
    assert kept[5].groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").isEmpty()


def test_one_row_of_each_component_stays(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcd"}
    rows = [(7, "a"), (7, "b"), (3, "a"), (None, "c"), (None, "c"), (9, "d"), (9, "d"), (None, "d")]
    df = spark.createDataFrame([(i, texts[k]) for i, k in rows] + [(1, None)], "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, FOLDER).collect()
    assert sorted((r["text"] or "", r["doc_id"]) for r in got) == sorted([("", 1), (texts["a"], 3), (texts["b"], 7), (texts["c"], None), (texts["d"], 9)])


def test_mixing_leaves_out_rows_not_ids(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    hot = docs.selectExpr("CAST(777777 AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars")
    after = corpus_pipeline.mix_to_targets(spark, docs.union(hot), "/root/testdata/sf0.001")
    assert 0 < after.where("doc_id = 777777").count() < hot.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    folder = "/root/testdata/sf0.001"
    assert compare(QUERIES[name](spark, folder), oracle_connection(folder), ORACLES[name]) is None


def test_ten_operators_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11))
