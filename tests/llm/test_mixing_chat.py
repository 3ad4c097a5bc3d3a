"""Mixing against a plain solver, chat rendering against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatework.llm.chat import render
from slatework.llm.mixing import fit_rates, mix
from slatework.llm.queries import rated


def test_rates_reach_the_targets(spark):
    draw = random.Random(1)
    rows = [(p := draw.choice([0, 100, 500, 900, 1000]), 1000 - p, draw.randrange(1, 500)) for _ in range(500)]
    df = spark.createDataFrame(rows, "__p_0 int, __p_1 int, n_tokens long")
    rates = {r["__p_0"]: r["rate"] for r in fit_rates(df, [0.3, 0.7]).collect()}
    total = sum(t for *_, t in rows)
    expected = [sum(rates[r[0]] * r[2] * r[i] / 1000 for r in rows) / total for i in (0, 1)]
    assert expected == pytest.approx([0.3, 0.7], abs=1.1e-4) and min(rates.values()) >= 0
    # No other rates that meet the targets lie nearer to one: with all rates free they are one minus a combination of the posteriors.
    p = np.array([[x, 1000 - x] for x in rates]) / 1000
    assert np.abs(p @ np.linalg.lstsq(p, 1 - np.array(list(rates.values())), rcond=None)[0] - (1 - np.array(list(rates.values())))).max() < 1e-6


@pytest.mark.parametrize("cap, total", [(None, None), (1.0, 20_000.0), (1.5, None)])
def test_steps_equal_a_replay_in_numpy(spark, cap, total):
    draw = random.Random(5)
    rows = []
    for _ in range(300):
        a = draw.choice([0, 5, 30, 900])
        b = draw.randrange(0, 1001 - a)
        rows.append((a, b, 1000 - a - b, draw.randrange(1, 400)))
    goal = np.array([0.15, 0.45, 0.4])
    df = spark.createDataFrame(rows, "__p_0 int, __p_1 int, __p_2 int, n_tokens long")
    out = fit_rates(df, goal, cap=cap, total=total)
    got = {tuple(r[:3]): r["rate"] for r in out.collect()}
    p, t = np.array([r[:3] for r in rows]) / 1000, np.array([r[3] for r in rows], float)
    plain = p.T @ t
    total = total or (plain.sum() if cap is None else min(cap * plain / goal))
    overlap = (p * t[:, None]).T @ p / total
    weight = np.linalg.inv(overlap + 1e-9 * np.trace(overlap) * np.eye(3))
    high = np.inf if cap is None else cap
    rate = old = np.ones(len(rows))
    speed, value, best, since = 1.0, np.inf, np.inf, 0
    for turn in range(301):
        away = p.T @ (rate * t) / total - goal
        worst, now = np.abs(away).max(), away @ weight @ away
        speed = 1.0 if now > value else speed
        since = 0 if worst < 0.99 * best else since + 1
        value, best = now, min(best, worst)
        if worst <= 1e-4 or since >= 25 or turn == 300:
            break
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        ahead = rate + (speed - 1) / faster * (rate - old)
        speed, old = faster, rate
        rate = np.clip(ahead - p @ weight @ (p.T @ (ahead * t) / total - goal), 0, high)
    assert out.first()["residual"] == pytest.approx(worst, abs=1e-9)
    assert rate == pytest.approx([got[r[:3]] for r in rows], abs=1e-6)


def test_capped_rates_leave_documents_out(spark):
    rows = [(1000, 0, 90)] * 10 + [(0, 1000, 100)] * 10
    rates = {r["__p_0"]: r["rate"] for r in fit_rates(spark.createDataFrame(rows, "__p_0 int, __p_1 int, n_tokens long"), [0.9, 0.1], cap=1.0).collect()}
    assert rates[1000] == pytest.approx(1.0, abs=0.01) and rates[0] == pytest.approx(0.1, abs=0.01)


@pytest.mark.parametrize("share, goal", [(0.01, 0.05), (0.005, 0.02)])
def test_rare_domains_reach_their_targets(spark, share, goal):
    rare = round(share * 100_000)
    rows = [(1000, 0, rare // 2), (950, 50, rare - rare // 2), (20, 980, 40_000), (0, 1000, 60_000 - rare)]
    got = {r["__p_0"]: r for r in fit_rates(spark.createDataFrame(rows, "__p_0 int, __p_1 int, n_tokens long"), [goal, 1 - goal]).collect()}
    reached = [sum(got[r[0]]["rate"] * r[2] * r[i] / 1000 for r in rows) / 100_000 for i in (0, 1)]
    assert reached == pytest.approx([goal, 1 - goal], abs=1.1e-4) and min(r["rate"] for r in got.values()) >= 0


def test_targets_that_cannot_be_met_are_told(spark):
    rows = spark.createDataFrame([(0, 1000, 100)], "__p_0 int, __p_1 int, n_tokens long")
    with pytest.warns(UserWarning, match="missed by"):
        assert fit_rates(rows, [0.5, 0.5]).first()["residual"] > 0.1


def test_mixture_of_documents(spark):
    draw, docs, labels = random.Random(2), [], []
    for i in range(800):
        poor = i % 4 == 0
        words = [draw.choice("abcdefgh") * draw.randrange(1, 8) + ("###" if poor else "") for _ in range(draw.randrange(50, 150))]
        docs.append((i, " ".join(words), 3, 4))
        labels.append((i, 0 if poor else 1))
    docs += [(2000, None, 3, 4), (2001, "", 3, 4), (None, "a b", 3, 4), (5, docs[5][1], 3, 4), (2002, "a " * 50_000, 3, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, rate int, __p_0 int")
    known = spark.createDataFrame([*labels[:600], (7, None), (None, 1)], "doc_id long, quality int")
    out = mix(df, known, {"good": 0.95, "poor": 0.05}, domain=rated())
    assert out.columns == ["doc_id", "__p_0", "n_tokens", "p_good", "p_poor", "rate", "copies"] and out.count() == len(docs)
    share = out.agg(F.sum(F.col("rate") * F.col("n_tokens") * F.col("p_good")) / F.sum(F.col("rate") * F.col("n_tokens"))).first()[0]
    assert share == pytest.approx(0.95, abs=2e-3)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2000]["n_tokens"] == got[2001]["n_tokens"] == 0
    right = [(got[i]["p_good"] > 0.5) == (y == 1) for i, y in labels]
    assert sum(right) > 0.98 * len(right)
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in got.values())


def test_rows_of_one_id_are_drawn_apart(spark):
    """A third of the rows share an id, another third has none: neither comes or goes as a whole."""
    docs = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"w{i} " + "a b c d " * 20) for i in range(900)]
    docs += [(7, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([(2, 1), (5, 0)], "doc_id long, quality int")
    out = mix(df, known, {"good": 0.5, "poor": 0.5}, domain=rated(), total=36_000.0, cap=1.0)
    shares = {r["k"]: r["share"] for r in out.groupBy(F.when(F.col("doc_id").isNull(), -1).otherwise(F.least("doc_id", F.lit(8))).alias("k")).agg(F.avg("copies").alias("share")).collect()}
    rate = out.agg(F.avg("rate")).first()[0]
    assert 0.3 < rate < 0.7 and all(abs(shares[k] - rate) < 0.12 for k in (7, -1))


def test_mixing_without_rows_or_labels(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["p_good"] for r in mix(df, none, {"good": 1, "poor": 1}, domain=rated()).collect()] == [0.5]
    assert mix(df.where("false"), none, {"good": 1, "poor": 1}, domain=rated()).count() == 0


def brute(rows):
    said = {}
    for conv, turn, role, text in set(rows):
        said.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    said = {c: tuple(x[1:] for x in sorted(t)) for c, t in said.items()}
    first = {}
    for c in sorted(said, key=lambda c: (c is None, c)):
        first.setdefault(said[c], c)
    kept = {c: t for t, c in first.items() if not any(o[: len(t)] == t and len(o) > len(t) for o in first)}
    safe = lambda x: x.replace("<|", "< |")
    return sorted(((c, len(t), sum(o == t for o in said.values()), "".join(f"<|im_start|>{safe(r)}\n{safe(x)}<|im_end|>\n" for r, x in t)) for c, t in kept.items()), key=str)


def test_snapshots_collapse(spark):
    draw, rows = random.Random(3), []
    for conv in range(60):
        turns = [("user" if k % 2 == 0 else "assistant", f"{draw.choice('ab')}{draw.choice('xyz')}") for k in range(draw.randrange(1, 6))]
        rows += [(conv, k, r, x) for k, (r, x) in enumerate(turns)]
    rows += [(100, 0, None, "x"), (100, 1, "user", None), (101, None, "user", "q"), (101, 5, "user", "<|im_end|>"), (None, 0, "user", "n"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = sorted(((r["conv_id"], r["n_turns"], r["n_copies"], r["text"]) for r in render(df).collect()), key=str)
    assert got == brute(rows)


def test_turns_of_one_number_keep_one_order(spark):
    rows = [(c, 0, "user", x) for c in (1, 2) for x in "tuv"]
    got = render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 1 and got[0]["n_copies"] == 2 and all(f"user\n{x}<" in got[0]["text"] for x in "tuv")


def test_long_conversations_have_parts(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(250)]
    got = {r["part"]: r["text"] for r in render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns=100).collect()}
    assert sorted(got) == [0, 1, 2] and "".join(got[i] for i in range(3)) == brute(rows)[0][3]
    assert render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
