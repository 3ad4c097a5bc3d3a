"""Toxicity and language: automaton against edit distance, held-out accuracy, corner cases."""

import random

import pytest
from pyspark.sql import functions as F

from slatework.llm import language, toxicity
from slatework.llm.common import crc_share
from slatework.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    draw = random.Random(1)
    terms = ["scum", "idiot", "idiom", "loser", "disgusting", "disgustings", "abcab", "aaaaa"]
    machine = toxicity.automaton(terms)
    words = set(terms)
    for term in terms:
        for _ in range(150):
            word = list(term)
            for _ in range(draw.randrange(1, 4)):
                at = draw.randrange(len(word) + 1)
                kind = draw.choice("isd")
                if kind == "i":
                    word.insert(at, draw.choice("abciz"))
                elif word and at < len(word):
                    word[at : at + 1] = [draw.choice("abciz")] if kind == "s" else []
            words.add("".join(word))
    words = sorted(words)
    for word, kind in zip(words, machine.match(words)):
        near = any(distance(word, t) <= toxicity.edits_of(t) for t in terms)
        assert kind == (2 if word in terms else 1 if near else 0), word


def test_stems_looks_and_benign_words():
    model = toxicity.Model(toxicity.automaton(["idiot", "lowei*"]), frozenset({"idiom"}))
    assert model.kinds(["loweischaft", "lowei", "lowe", "1d10t", "idiot", "idiom", "idiott", "", "7"]).tolist() == [2, 2, 0, 1, 2, 0, 1, 0, 0]
    assert toxicity.automaton([]).match(["a", ""]).tolist() == [0, 0]


def test_quotation():
    assert toxicity.quoted('he said "you idiot" to me', 13, 18) and toxicity.quoted("«idiot»", 1, 6)
    assert not toxicity.quoted("you idiot", 4, 9) and not toxicity.quoted('"a" idiot "b"', 4, 9)


@pytest.fixture(scope="module")
def abuse():
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("bcdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randrange(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(20, 200))]
        if toxic := i % 6 == 0:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(["grumblit", "snorkling", "vexx", "blatherskite"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1 if toxic else 0))
    return docs, labels


def test_toxic_documents_are_found(spark, abuse):
    docs, labels = abuse
    extra = [(1000, None), (1001, ""), (1002, "ba " * 50_000), (1003, "ba be grumb1it bo snorklnig"), (1004, 'they wrote "grumblit" there'), (None, "ba"), (1000, None)]
    df = spark.createDataFrame([(*d, "k", 5) for d in [*docs, *extra]], "doc_id long, text string, lang string, score int")
    known = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, known.where(crc_share("doc_id", 5) != 0))
    out = toxicity.score(df, model, keep=["doc_id", "lang", "score"])
    assert out.columns == ["doc_id", "lang", "score", "predicted", "plain_hits", "misspelt_hits", "quoted_hits"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(docs) + len(extra)
    assert all(got[i]["predicted"] == y for i, y in labels)
    assert got[1000]["predicted"] == got[1001]["predicted"] == got[1002]["predicted"] == 0 and 0 <= got[1000]["score"] < 0.5
    assert got[1003]["plain_hits"] + got[1003]["misspelt_hits"] == 2 and got[1003]["predicted"] == 1
    assert got[1004]["quoted_hits"] == 1 and got[1004]["predicted"] == 0


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert [r["predicted"] for r in toxicity.score(docs, model).collect()] == [0]
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_held_out_toxicity(spark):
    scored = QUERIES["op7_toxicity"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where(F.col("toxic").isNotNull())
    clean = scored.where("toxic = 0").agg(F.sum("predicted"), F.count(F.lit(1))).first()
    toxic = scored.where("toxic = 1 AND NOT held_out").agg(F.sum("predicted"), F.count(F.lit(1))).first()
    assert clean[0] == 0 and toxic[0] >= 0.7 * toxic[1]


def test_held_out_language(spark):
    found = QUERIES["op10_language"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert held[0] > 0.98 and held[1] < 0.02


def test_language_corner_cases(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("der die das und nicht", "de"), ("the and of with", "en")] * 40)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !!", None), (103, "the " * 60_000, None), (104, "日本", None), (105, "und die", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = language.fit(df)
    got = {r["doc_id"]: r for r in language.detect(df, model, keep=df.columns).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (100, 101, 102))
    assert got[103]["lang_pred"] == "en" and got[105]["lang_pred"] == "de" and got[104]["lang_pred"] in ("de", "en")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = language.detect(df, model, keep=df.columns, prefix="new_")
    assert {r["lang_pred"] for r in kept.collect()} == {"z"} and "new_rejected" in kept.columns


def test_language_sample_is_bounded_under_hot_ids_and_texts(spark, monkeypatch):
    """One id on a third of the rows, none on another third, one text on half of them, and very long texts."""
    draw, rows = random.Random(6), []
    for i in range(3000):
        lang = draw.choice(["de", "en"])
        words = ["der", "die", "und", "nicht"] if lang == "de" else ["the", "and", "with", "of"]
        text = "the same words of all" if i % 2 == 0 else " ".join(draw.choice(words) for _ in range(20)) + f" {i}"
        rows.append((7 if i % 3 == 0 else None if i % 3 == 1 else i, text, "en" if i % 2 == 0 else lang))
    rows += [(i, f"{i} " + "the and with of " * 20_000, "en") for i in range(20)]
    taken = {}
    monkeypatch.setattr(language, "train", lambda texts, langs: taken.update(texts=texts, langs=langs))
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), fit_docs=400, fit_chars=5_000)
    assert 300 < len(taken["texts"]) < 480 and taken["texts"].count("the same words of all") <= 1
    assert max(map(len, taken["texts"])) <= 5_000 and 120 < taken["langs"].count("de") < 280
    again = dict(taken)
    language.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string"), fit_docs=400, fit_chars=5_000)
    assert again == taken


def test_language_without_rows(spark):
    df = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert language.fit(df) is None
    assert [r["lang_pred"] for r in language.detect(df, None).collect()] == ["und"]
    assert language.detect(df.where("false"), None).count() == 0
