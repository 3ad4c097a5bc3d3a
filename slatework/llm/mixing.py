"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A labelled table teaches a naive Bayes classifier on coarse statistics of the text (one grouped count over all labelled
documents); every document gets posteriors over the domains.  Rates are then fitted by projected-gradient least
squares: the expected tokens of each domain, summed over all documents with their rates, shall meet the targets.
Steps start from rates of one, weigh the domains' misses by their overlap and carry momentum that is dropped where it
leads upwards.  A document's rate depends on its posteriors alone, so documents with equal posteriors are summed
first, and a step is one aggregation that brings one number per domain to the driver.  Rates are nonnegative (and at
most ``cap``, where given).  Targets that stay unmet are warned of.  The whole number of copies is the rate rounded up
or down by a hash of id and text, so that rows of one id are drawn apart.

NULL and empty texts have no tokens; their posteriors come from the same statistics.  Rows with NULL labels or ids do
not teach.  A domain without documents keeps its target, which then cannot be met.  With no labelled rows all
posteriors are equal.  Repeated rows get equal rates.  An empty table gives an empty result.  Extra columns are kept;
those named like an added one are replaced by it.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from slatework.llm.common import free_of, masked, words_of, written

_BINS = 12
_GRID = 1000
ADDED = ["n_tokens", "rate", "copies"]


def _features(text: Column) -> dict[str, Column]:
    """Statistics of a text as bins 0 to _BINS - 1."""
    whole = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(whole), F.lit(1))
    without = lambda marks: (F.length(whole) - F.length(F.translate(whole, marks, ""))) / chars
    words = F.greatest("n_tokens", F.lit(1))
    log_bin = lambda x: F.floor(F.log2(x * 4096 + 1))
    raw = {
        "size": F.floor(F.log2(words) * 0.8),
        "word_size": F.floor(F.least(chars / words, F.lit(24.0)) / 2),
        "symbols": log_bin(without("#*$%&|<>@{}[]=_~^\\/")),
        "digits": log_bin(without("0123456789")),
        "marks": log_bin(without(".,;:!?")),
        "distinct": F.floor(F.col("__distinct") / words * 11),
        "lines": F.floor(F.log2((F.length(whole) - F.length(F.translate(whole, "\n", "")) + 1) / words * 1024 + 1)),
    }
    return {k: F.least(F.greatest(v, F.lit(0)), F.lit(_BINS - 1)).cast("int") for k, v in raw.items()}


FEATURES = ["size", "word_size", "symbols", "digits", "marks", "distinct", "lines"]


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens`` (words) and the binned statistics __f_*."""
    first = docs.withColumn("__words", words_of(F.col(text))).withColumns({"n_tokens": F.size("__words").cast("long"), "__distinct": F.size(F.array_distinct("__words"))})
    binned = first.withColumns({f"__f_{k}": v for k, v in _features(F.col(text)).items()})
    return binned.drop("__words", "__distinct", text)


def posteriors(rows: DataFrame, labelled: DataFrame, domains: Sequence[str]) -> DataFrame:
    """``rows`` with __p_0, __p_1, ... in thousandths that sum to 1000; ``labelled`` holds __f_* and ``domain``."""
    cells = labelled.where(F.col("domain").isin(list(domains))).select("domain", F.posexplode(F.array(*[f"__f_{k}" for k in FEATURES])).alias("feature", "bin"))
    # At most domains x features x bins rows come to the driver.
    counts = {(r["domain"], r["feature"], r["bin"]): r["count"] for r in cells.groupBy("domain", "feature", "bin").count().collect()}
    of = {d: sum(v for (x, f, _), v in counts.items() if x == d and f == 0) for d in domains}
    everyone = sum(of.values())
    # Statistics overlap in what they say, so their evidence is tempered.
    tempered = 0.7
    logs = []
    for d in domains:
        score = F.lit(math.log((of[d] + 1) / (everyone + len(domains))))
        for i, k in enumerate(FEATURES):
            values = [tempered * math.log((counts.get((d, i, b), 0) + 0.5) / (of[d] + 0.5 * _BINS)) for b in range(_BINS)]
            score = score + F.element_at(F.array(*map(F.lit, values)), F.col(f"__f_{k}") + 1)
        logs.append(score)
    rows = rows.withColumns({f"__l{i}": x for i, x in enumerate(logs)})
    best = F.greatest(*[f"__l{i}" for i in range(len(domains))]) if len(domains) > 1 else F.col("__l0")
    rows = rows.withColumns({f"__e{i}": F.exp(F.col(f"__l{i}") - best) for i in range(len(domains))})
    total = sum((F.col(f"__e{i}") for i in range(len(domains))), F.lit(0.0))
    rows = rows.withColumns({f"__p_{i}": F.round(F.col(f"__e{i}") / total * _GRID).cast("int") for i in range(1, len(domains))})
    rest = sum((F.col(f"__p_{i}") for i in range(1, len(domains))), F.lit(0))
    # Rounding is settled in the first domain.
    return rows.withColumn("__p_0", (_GRID - rest).cast("int")).drop(*[f"__{x}{i}" for x in "le" for i in range(len(domains))])


def fit_rates(rows: DataFrame, weights: Sequence[float], *, total: float | None = None, cap: float | None = None, steps: int = 300, close: float = 1e-4, patience: int = 25) -> DataFrame:
    """One row per distinct posterior, with its rate and ``residual``, the largest miss of a domain's share of the target.

    ``total`` is the target's tokens: all tokens where not given, or, with a ``cap``, as many as the scarcest
    domain allows at that rate.  Steps end when every miss is at most ``close``, or when ``patience`` steps have not
    lessened the largest miss by a hundredth.
    """
    k, goal = len(weights), np.array(weights, float) / sum(weights)
    names = [f"__p_{i}" for i in range(k)]
    p = [F.col(n) / _GRID for n in names]
    cells = written(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")).withColumns({"before": F.lit(1.0), "rate": F.lit(1.0)}))
    summed = lambda x: F.coalesce(F.sum(x * F.col("tokens")), F.lit(0.0))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = list(cells.agg(*map(summed, p), *[summed(p[i] * p[j]) for i, j in pairs]).first())
    plain = found[:k]
    if total is None:
        total = sum(plain) if cap is None else min(cap * x / g for x, g in zip(plain, goal) if g > 0)
    if total <= 0:
        return cells.select(*names, "rate", F.lit(None).cast("double").alias("residual"))
    overlap = np.zeros((k, k))
    for (i, j), x in zip(pairs, found[k:]):
        overlap[i, j] = overlap[j, i] = x / total
    # Misses are weighted by the inverse of the domains' overlap, so that rare domains move as fast as common ones
    # and the largest curvature is one: so is the step.
    weight = np.linalg.inv(overlap + 1e-9 * max(np.trace(overlap), 1e-300) * np.eye(k))
    away = np.array(plain) / total - goal
    before, value, speed = away, away @ weight @ away, 1.0
    best, since = np.abs(away).max(), 0
    for turn in range(steps):
        if np.abs(away).max() <= close or since >= patience:
            break
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        momentum, speed = (speed - 1) / faster, faster
        # Expected tokens are linear in the rates, so the miss at the point ahead needs no aggregation of its own.
        push = weight @ (away + momentum * (away - before))
        slope = sum((F.lit(float(x)) * y for x, y in zip(push, p)), F.lit(0.0))
        moved = F.greatest(F.lit(0.0), F.col("rate") + momentum * (F.col("rate") - F.col("before")) - slope)
        moved = moved if cap is None else F.least(F.lit(float(cap)), moved)
        cells = cells.select(*names, "tokens", F.col("rate").alias("before"), moved.alias("rate"))
        if turn % 8 == 7:
            cells = written(cells)
        before, away = away, np.array(cells.agg(*[summed(F.col("rate") * x) for x in p]).first()) / total - goal
        after = away @ weight @ away
        # A step that led upwards ends the momentum.
        speed, value = (1.0 if after > value else speed), after
        since = 0 if np.abs(away).max() < 0.99 * best else since + 1
        best = min(best, np.abs(away).max())
    residual = float(np.abs(away).max())
    if residual > close:
        warnings.warn(f"a domain's share of the target's tokens is missed by {residual:.4f}", stacklevel=2)
    return written(cells.select(*names, "rate", F.lit(residual).alias("residual")))


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], *, domain: Column, doc_id: str = "doc_id", text: str = "text", cap: float | None = None, total: float | None = None, draw: Sequence[str] = ()) -> DataFrame:
    """``docs`` without the text, with n_tokens, a posterior column per domain (``p_<domain>``), rate and copies.

    ``domain`` is an expression over ``labels``; ``targets`` gives each domain's share of the tokens.
    ``draw`` names the columns whose hash rounds a rate: id and text where not given.
    """
    domains, original = list(targets), docs.columns
    docs, own = masked(docs)
    rows = written(described(docs.withColumn("__hash", F.xxhash64(own[text])), own[text]))
    known = labels.select(F.col(doc_id).alias("__key"), domain.alias("domain")).where(F.col("domain").isNotNull() & F.col("__key").isNotNull())
    # One label per document: the smallest where a document has several.
    known = known.groupBy("__key").agg(F.min("domain").alias("domain"))
    labelled = rows.join(known, rows[own[doc_id]] == known["__key"]).drop("__key")
    scored = written(posteriors(rows, labelled, domains))
    names = [f"__p_{i}" for i in range(len(domains))]
    rates = fit_rates(scored, list(targets.values()), total=total, cap=cap)
    mixed = scored.join(rates, names, "left")
    drawn = F.pmod(F.xxhash64(F.lit("copies"), *([own[c] for c in draw] or [own[doc_id], "__hash"])), F.lit(1 << 30)) / float(1 << 30)
    rest = [c for c in free_of(original, [*ADDED, *[f"p_{d}" for d in domains]]) if c != text]
    return mixed.select(
        *[F.col(own[c]).alias(c) for c in rest], "n_tokens", *[(F.col(n) / _GRID).alias(f"p_{d}") for n, d in zip(names, domains)],
        "rate", F.floor(F.col("rate") + drawn).cast("int").alias("copies"),
    )
