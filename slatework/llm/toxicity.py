"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Lexicon: over a bounded sample of labelled documents (equal texts once), every word (and 5- or 6-letter word beginning) is tested for
how much oftener toxic documents hold it; those beyond chance, given the number of words tested, enter with their
log odds.  Matching: the terms form a trie, and the Levenshtein automata of all terms are run on it together, as one
table of states, so one pass over a word's letters finds whether it is a term, begins like one, or is a misspelling
(one edit from 5 letters on, two from 10 on, look-alike signs such as 0 for o free).  Words that clean training
documents hold are no misspellings.  Context: around each hit a window is read; hits inside quotation marks count as
quoted.  A logistic model on the counts of plain, misspelled and quoted hits, held near sensible
weights by its prior, gives the score.

Labels enter only through the rows given to ``fit``.  NULL and empty texts have no hits and get the score of that.
NULL labels do not train, and of two labels of one document the larger counts.  With no usable labelled row the
lexicon is empty.  Repeated rows are scored alike.  An empty table gives an empty result.  Extra columns can be
kept; those named like an added one are replaced by it, unless ``prefix`` renames what is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from slatework.llm.common import bounded_sample, free_of, written
from slatework.llm.encoding import slices

ADDED = ["score", "predicted", "plain_hits", "misspelt_hits", "quoted_hits"]
STEM = "*"
_STEMS = (5, 6)
# Signs that look like letters.
_LOOKS = str.maketrans("013457@$", "oieastas")
# Marks that open and close a quotation.
_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’"}
_EDGE = "@$"
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Prior weights: bias, log1p of plain, misspelled and quoted hits.
_PRIOR = np.array([-2.5, 4.0, 2.0, 0.5])


@dataclass
class Automaton:
    """States of all terms' Levenshtein automata on their trie.  kind: 0 none, 1 misspelt, 2 a term or its stem."""

    classes: np.ndarray  # sorted code points with a column of their own; all others share column 0
    table: np.ndarray  # state x column -> state; state 0 is dead
    kind: np.ndarray
    start: int
    longest: int

    def match(self, words: Sequence[str]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int8)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        if not len(points) or self.table.shape[0] <= 1:
            return out
        at = np.minimum(np.searchsorted(self.classes, points), len(self.classes) - 1)
        columns = np.where(self.classes[at] == points, at + 1, 0)
        live, begin = np.flatnonzero(lengths > 0), np.cumsum(lengths) - lengths
        state = np.full(len(words), self.start)
        step = 0
        while len(live):
            state[live] = self.table[state[live], columns[begin[live] + step]]
            step += 1
            live = live[(state[live] > 0) & (lengths[live] > step)]
        out[:] = self.kind[state]
        return out


def edits_of(term: str) -> int:
    return 2 if len(term) >= 10 else 1 if len(term) >= 5 else 0


def automaton(terms: Sequence[str]) -> Automaton:
    """Subset construction over (trie node, edits); terms that end in * accept every continuation."""
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    allowed: list[int] = [0]
    stems: set[int] = set()
    for term in sorted(terms):
        word, node = term.rstrip(STEM), 0
        most = 0 if term.endswith(STEM) else edits_of(word)
        allowed[0] = max(allowed[0], most)
        for letter in word:
            if letter not in children[node]:
                children[node][letter] = len(children)
                children.append({})
                ends.append(-1)
                allowed.append(0)
            node = children[node][letter]
            allowed[node] = max(allowed[node], most)
        if term.endswith(STEM):
            stems.add(node)
        else:
            ends[node] = most

    def closed(states: Mapping[int, int]) -> frozenset:
        """With letters left out; per node the fewest edits."""
        least, todo = dict(states), list(states.items())
        while todo:
            node, edits = todo.pop()
            if edits > least.get(node, 9):
                continue
            for child in children[node].values():
                if edits + 1 <= allowed[child] and edits + 1 < least.get(child, 9):
                    least[child] = edits + 1
                    todo.append((child, edits + 1))
        return frozenset(least.items())

    def after(states: frozenset, letter: str | None) -> frozenset:
        least: dict[int, int] = {}

        def put(node, edits):
            if edits <= allowed[node] and edits < least.get(node, 9) or edits == 0 and node in least:
                least[node] = min(edits, least.get(node, 9))

        for node, edits in states:
            if edits + 1 <= allowed[node]:
                put(node, edits + 1)
            for own, child in children[node].items():
                if own == letter:
                    if edits <= allowed[child] or edits == 0:
                        least[child] = min(edits, least.get(child, 9))
                elif edits + 1 <= allowed[child]:
                    put(child, edits + 1)
        return closed(least)

    letters = sorted({x for node in children for x in node})
    absorbing = frozenset([(-1, 0)])
    number: dict[frozenset, int] = {frozenset(): 0, closed({0: 0}): 1, absorbing: 2}
    order = [frozenset(), closed({0: 0}), absorbing]
    rows: list[list[int]] = []
    for states in order:
        if states == absorbing:
            rows.append([2] * (len(letters) + 1))
            continue
        row = []
        for letter in [None, *letters]:
            target = after(states, letter) if states else frozenset()
            if any(edits == 0 and node in stems for node, edits in target):
                target = absorbing
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row)
    kind = np.zeros(len(order), np.int8)
    kind[2] = 2
    for i, states in enumerate(order):
        for node, edits in states:
            if node >= 0 and ends[node] >= 0 and edits <= ends[node]:
                kind[i] = max(kind[i], 2 if edits == 0 else 1)
    longest = max((len(t) for t in terms), default=0)
    return Automaton(np.array([ord(x) for x in letters] or [0], np.uint32), np.array(rows, np.int32), kind, 1, longest)


@dataclass
class Model:
    automaton: Automaton
    benign: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=_PRIOR.copy)

    def kinds(self, words: Sequence[str]) -> np.ndarray:
        """0 none, 1 misspelt, 2 plain, for words in lower case."""
        kinds = self.automaton.match(words)
        looks = [w.translate(_LOOKS) for w in words]
        changed = [i for i, (a, b) in enumerate(zip(words, looks)) if a != b and kinds[i] == 0 and not a.isdigit()]
        if changed:
            kinds[changed] = np.minimum(self.automaton.match([looks[i] for i in changed]), 1)
        for i in np.flatnonzero(kinds == 1):
            if words[i] in self.benign:
                kinds[i] = 0
        return kinds

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(features)), np.log1p(features)])
        return 1 / (1 + np.exp(-(x @ self.weights)))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word codes of all texts in a row, offsets, and the distinct words, lower case, without signs at the edges."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN\pM@$]+")
    coded = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy()
    return coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0], [w.strip(_EDGE) for w in coded.dictionary.to_pylist()]


def quoted(text: str, begin: int, end: int, window: int = 120) -> bool:
    """Whether the window around a hit opens a quotation before it that is closed after it, on the same line."""
    left = text[max(0, begin - window) : begin].rpartition("\n")[2]
    right = text[end : end + window].partition("\n")[0]
    for opens, closes in _QUOTES.items():
        inside = left.count(opens) % 2 == 1 if opens == closes else left.rfind(opens) > left.rfind(closes)
        if inside and closes in right:
            return True
    return False


def _features(model: Model, texts: pa.Array) -> np.ndarray:
    """Per text: plain, misspelled and quoted hits."""
    codes, offsets, words = _tokens(texts)
    kinds = model.kinds(words)
    each = kinds[codes]
    plain = np.add.reduceat((each == 2).astype(np.int64), offsets[:-1])
    misspelt = np.add.reduceat((each == 1).astype(np.int64), offsets[:-1])
    out = np.column_stack([plain, misspelt, np.zeros(len(plain), np.int64)]).astype(float)
    for i in np.flatnonzero(plain + misspelt):
        text = texts[int(i)].as_py().lower()
        if not any(mark in text for mark in _QUOTES):
            continue
        hits = {words[c]: kinds[c] for c in codes[offsets[i] : offsets[i + 1]] if kinds[c]}
        for m in re.finditer("|".join(rf"(?<!\w){re.escape(h)}(?!\w)" for h in sorted(hits, key=len, reverse=True)), text):
            if quoted(text, m.start(), m.end()):
                column = 0 if hits[m[0]] == 2 else 1
                if out[i, column]:
                    out[i, column] -= 1
                    out[i, 2] += 1
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: in how many toxic and other documents each word and word beginning occurs, and, as rows of their own,
    the pairs of neighbours it has in toxic documents."""
    for whole in batches:
        for batch in slices(whole, "text"):
            codes, offsets, words = _tokens(batch.column("text"))
            # A word and its beginnings are the units; a document counts a unit once.
            units = pa.array([u for w in words for u in (w, *[w[:n] + STEM for n in _STEMS if len(w) >= n])], pa.string()).dictionary_encode()
            sizes = np.array([1 + sum(len(w) >= n for n in _STEMS) for w in words], np.int64)
            unit = units.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            each = sizes[codes]
            starts = (np.cumsum(sizes) - sizes)[codes]
            at = np.repeat(starts - (np.cumsum(each) - each), each) + np.arange(each.sum())
            pairs = np.unique(np.repeat(doc, each) * len(units.dictionary) + unit[at])
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            hit, of = pairs % len(units.dictionary), toxic[pairs // len(units.dictionary)]
            counted = [np.bincount(hit[of], minlength=len(units.dictionary)), np.bincount(hit[~of], minlength=len(units.dictionary))]
            names = ["word", "pos", "neg", "between"]
            yield pa.RecordBatch.from_arrays([units.dictionary, *map(pa.array, counted), pa.nulls(len(units.dictionary), pa.int64())], names=names)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))[codes]
            left, right = np.zeros_like(hashes), np.zeros_like(hashes)
            left[1:], right[:-1] = hashes[:-1], hashes[1:]
            left[doc != np.roll(doc, 1)] = 0
            right[doc != np.roll(doc, -1)] = 0
            with np.errstate(over="ignore"):
                between = (left * _STEP + right) ^ (right >> np.uint64(29))
            bad = np.flatnonzero(np.repeat(toxic[doc], each))
            places = np.repeat(np.arange(len(codes)), each)[bad]
            rows = pa.array(np.zeros(len(bad), np.int64))
            yield pa.RecordBatch.from_arrays([units.dictionary.take(pa.array(unit[at[bad]])), rows, rows, pa.array(between[places].view(np.int64))], names=names)


def _near(model: Model):
    def run(batches):
        for batch in batches:
            kinds = model.kinds(batch.column("word").to_pylist())
            yield batch.filter(pa.array(kinds == 1))

    return run


def _feature_rows(model: Model):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                f = _features(model, batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(f[:, i]) for i in range(3)]], names=["toxic", "a", "b", "c"])

    return run


def _telling(counts: DataFrame, tested: int, p: int, n: int, bound: int) -> list[str]:
    """Units that toxic documents hold oftener than chance gives among so many units tested, most telling first.

    Copies of one toxic document would make all its words telling.  A unit therefore counts no oftener than it has
    different neighbours, and not at all where nearly all its documents put it in the same place.
    """
    counts = counts.where(F.col("places") >= 0.3 * F.col("pos")).withColumn("pos", F.least("pos", "places"))
    share = F.lit(p / (p + n))
    seen = F.col("pos") + F.col("neg")
    part = lambda count, expected: F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)
    g2 = 2 * (
        part(F.col("pos"), seen * share) + part(F.col("neg"), seen * (1 - share))
        + part(p - F.col("pos"), (p + n - seen) * share) + part(n - F.col("neg"), (p + n - seen) * (1 - share))
    )
    rate = ((F.col("pos") + 0.5) / (p + 1)) / ((F.col("neg") + 0.5) / (n + 1))
    least = 2 * np.log(max(2, tested))
    letters = F.length(F.regexp_replace("word", r"[^\p{L}]", ""))
    good = counts.where((letters >= 4) & (rate >= 8) & (g2 >= float(least))).orderBy(F.desc(g2), "word").limit(bound)
    return [r["word"] for r in good.select("word").collect()]


def _unexplained(model: Model):
    """Drops the toxic documents that hold a term."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                explained = (_features(model, batch.column("text"))[:, [0, 2]].sum(axis=1) > 0) & (batch.column("toxic").to_numpy(zero_copy_only=False) > 0)
                yield batch.filter(pa.array(~explained))

    return run


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", fit_docs: int = 20_000, max_terms: int = 1000, rounds: int = 3) -> Model:
    """Learn from at most about ``fit_docs`` labelled rows; ``max_terms`` bounds the lexicon, best terms first."""
    usable = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("k")).agg(F.max(toxic).cast("int").alias("toxic"))
    chosen = bounded_sample(usable, "k", fit_docs)
    # The sample has at most about fit_docs rows of two numbers: a proven bound.
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")
    rows = written(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))
    terms: dict[str, None] = {}
    model, first, rest = Model(automaton([])), None, rows
    # The later rounds look at the toxic documents that no term explains yet, which few labels of a kind need.
    for _ in range(rounds):
        p, n = rest.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1)) - F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not p or not n:
            break
        counts = written(rest.mapInArrow(_word_counts, "word string, pos long, neg long, between long").groupBy("word", "between").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).groupBy("word").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count("between").alias("places")
        ))
        first = first or counts
        found = _telling(counts, counts.count(), p, n, max_terms - len(terms))
        if not set(found) - set(terms):
            break
        terms |= dict.fromkeys(found)
        model = Model(automaton(list(terms)))
        rest = written(rows.mapInArrow(_unexplained(model), "text string, toxic int"))
    if not terms:
        return model
    # Near misses that clean documents hold: bounded by what lies within the edits of the lexicon.
    near = first.where((F.col("neg") > 0) & ~F.col("word").endswith(STEM)).select("word").mapInArrow(_near(model), "word string")
    model.benign = frozenset(r["word"] for r in near.collect())
    sample = rows.mapInArrow(_feature_rows(model), "toxic int, a double, b double, c double").groupBy("toxic", "a", "b", "c").count().collect()
    x = np.array([[r["a"], r["b"], r["c"]] for r in sample])
    model.weights = _logistic(np.column_stack([np.ones(len(x)), np.log1p(x)]), np.array([r["toxic"] for r in sample], float), np.array([r["count"] for r in sample], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Newton steps for a logistic model whose weights are held near the prior."""
    w = _PRIOR.copy()
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (chance - y)) + strength * (w - _PRIOR)
        bend = (x * (weight * chance * (1 - chance))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w


def _score(model: Model, text: str, keep: list[str], added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                features = _features(model, batch.column(text))
                score = model.score(features)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *[pa.array(features[:, i].astype(np.int64)) for i in range(3)]],
                    names=[*keep, *added],
                )

    return run


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: Sequence[str] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The kept columns with ``score``, ``predicted`` (score >= 0.5) and the hits by kind."""
    added = [prefix + a for a in ADDED]
    keep = free_of(keep, added)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(
        _score(model, text, keep, added), ", ".join([schema, *[f"{a} {kind}" for a, kind in zip(added, ["double", "int", "long", "long", "long"])]])
    )
