"""Quality counts against brute force, estimates against numpy, planted outliers."""

import collections
import random
import re

import numpy as np
import pytest

from slatework.llm.quality_mcd import STATS, chi_square_cut, chi_square_share, judge, text_stats


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    draw = random.Random(1)
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n x\nx", "# * é 🙂 | <>", "\x0b a\x0cb\r\n", "a b c\n\na b c"]
    texts += [" ".join(draw.choice("abcdef") for _ in range(draw.randrange(1, 300))) for _ in range(60)] + ["w " * 60_000, " ".join(f"v{i}" for i in range(50_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in text_stats(df).collect():
        assert tuple(r[s] for s in STATS) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_windows_that_share_a_hash_are_told_apart(spark):
    draw = random.Random(3)
    texts = [None, "", "a b c d", "a b c a b c", "w " * 3000] + [" ".join(draw.choice("abcdefghijkl") for _ in range(n)) for n in (5, 40, 200, 900, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for digits in (2, 12):
        for r in text_stats(df, hash_digits=digits).collect():
            assert tuple(r[s] for s in STATS) == brute(texts[r["doc_id"]])


def test_chi_square():
    assert chi_square_cut(2, 0.95) == pytest.approx(5.991465, abs=1e-5)
    assert chi_square_share(5, 11.0705) == pytest.approx(0.95, abs=1e-5)


def corpus():
    draw, rows = random.Random(2), []
    for i in range(400):
        words = ["".join(draw.choice("abcdefghijklm") for _ in range(draw.randrange(2, 9))) for _ in range(draw.randrange(60, 400))]
        rows.append((i, " ".join(words), draw.choice(["en", "fr", None]), draw.choice(["s1", "s2", None]), 9, 9))
    for i in range(400, 410):
        rows.append((i, " ".join("&&%%$$##" + draw.choice("ab") + str(j) for j in range(200)), "en", "s1", 9, 9))
    return rows + [(500, None, None, None, 9, 9), (501, "", "en", "s1", 9, 9), (502, "same words " * 200, "en", "s1", 9, 9)] + [rows[0]] * 3 + [(503, rows[1][1], "xx", "rare", 9, 9)]


def test_outliers_go_and_clean_documents_stay(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, x0 int, kept int")
    out = judge(df)
    assert out.columns == ["doc_id", "lang", "source", "x0", *STATS, "base_failed", "distance", "kept"]
    got = out.collect()
    assert len(got) == len(corpus())
    for r in got:
        if r["doc_id"] < 400 or r["doc_id"] == 503:
            assert r["kept"] and not r["base_failed"], r
        else:
            assert r["kept"] is False, r
        assert r["base_failed"] == (r["doc_id"] >= 500 and r["doc_id"] != 503)
        assert (r["distance"] is None) == r["base_failed"]


def test_concentration_lowers_the_determinant(spark):
    """The estimate of a polluted group is close to that of its clean part."""
    from slatework.llm.quality_mcd import _P, estimate

    draw = np.random.default_rng(0)
    clean = draw.multivariate_normal(np.zeros(_P), np.eye(_P) * 4, 900)
    rows = np.vstack([clean, draw.normal(30, 1, (150, _P))])
    df = spark.createDataFrame([("g", "a", *map(float, r)) for r in rows], "lang string, source string, " + ", ".join(f"x{i} double" for i in range(_P)))
    fitted = estimate(df, ["lang", "source"], broad=["lang"]).first()
    assert all(abs(fitted[f"m{i}"]) < 0.4 for i in range(_P))
    assert all(0.3 < fitted[f"w{i}{i}"] < 0.65 for i in range(_P))


def test_empty(spark):
    assert judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_moderate_outliers_go(spark):
    """Documents with some symbols or some repeated lines, not made of them."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghijklm") for _ in range(draw.randrange(2, 9)))
    rows = [(i, " ".join(word() for _ in range(draw.randrange(60, 400))), "en", "s1") for i in range(400)]
    # Every third or fourth word carries symbols.
    rows += [(i, " ".join(word() + ("#$%" if j % (3 + i % 2) == 0 else "") for j in range(200)), "en", "s1") for i in range(400, 412)]
    # 11 to 13 lines are equal.
    rows += [(i, "\nnote\n".join(" ".join(word() for _ in range(15)) for _ in range(12 + i % 3)), "en", "s1") for i in range(412, 424)]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    odd = [r for r in got if r["doc_id"] >= 400]
    assert not any(r["base_failed"] for r in got) and max(r["distance"] for r in odd) < chi_square_cut(5, 1 - 1e-7)
    assert not any(r["kept"] for r in odd)
    assert sum(not r["kept"] for r in got if r["doc_id"] < 400) <= 4
