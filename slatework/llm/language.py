"""Language identification by averaged hashed subwords.

A text's vector is the mean of the embeddings of the character 1- to 4-grams of its words (hashed to a fixed
number of rows), a linear softmax on it gives the language.  Both are trained by stochastic gradient descent in
numpy on a sample of about ``fit_docs`` different labelled texts at most, spread evenly over the languages and cut
into passages of random length, so that short texts are learnt too.  On held-out passages a temperature calibrates the
probabilities, and the least probability is found at which the accepted passages are right as often as
``precision`` asks (never less than one half): texts below it are rejected.

Prediction runs over whole texts.  As mean and softmax layer are linear, embeddings times weights is one small
table of logits per subword, distinct words are looked up once per batch, and a text is a weighted sum of words.

NULL texts and texts without a letter get ``und`` with score 0 and are rejected.  Rows with NULL labels do not
train.  With no usable labelled row, every text is ``und``.  Repeated rows are scored alike.  An empty table gives
an empty result.  Extra columns can be kept; those named like an added one are replaced by it, unless ``prefix`` renames what is added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from slatework.llm.common import free_of
from slatework.llm.encoding import slices

UNKNOWN = "und"
ADDED = ["lang_pred", "score", "rejected"]
_ROWS, _WIDTH, _SIZES = 1 << 16, 16, (1, 2, 3, 4)
_STEP = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the subwords of all words, word after word, and their count per word ('' has none)."""
    marked = [f"<{w}>" if w else "" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.repeat(np.cumsum(lengths), lengths)
    at, owner = np.arange(len(points)), np.repeat(np.arange(len(marked)), lengths)
    rows, owners, hashed = [], [], np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in _SIZES:
            shifted = np.zeros(len(points), np.uint64)
            shifted[: max(0, len(points) - n + 1)] = points[n - 1 :]
            hashed = hashed * _STEP + shifted + np.uint64(1)
            inside = at + n <= ends
            rows.append(((hashed[inside] * _MIX) >> np.uint64(48)).astype(np.int64) % _ROWS)
            owners.append(owner[inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(rows)[order], np.bincount(owners, minlength=len(marked))


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # subword row x language
    bias: np.ndarray
    temperature: float
    threshold: float

    def of_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed logits and number of subwords of each word, a few thousand words at a time."""
        parts = [self._of_few(words[i : i + 10_000]) for i in range(0, len(words), 10_000)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _of_few(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        rows, counts = subwords(words)
        sums = np.zeros((len(words), len(self.langs)))
        some = counts > 0
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            sums[some] = np.add.reduceat(self.logits[rows], starts, axis=0)
        return sums, counts

    def scores(self, summed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return softmax((summed / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _words(texts: pa.Array) -> pa.ListArray:
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+")


def train(texts: Sequence[str], labels: Sequence[str], *, epochs: int = 6, rate: float = 0.5, batch: int = 64, precision: float = 0.9, seed: int = 7) -> Model:
    """Fit on whole labelled texts, in memory: the caller bounds their number."""
    draw = np.random.default_rng(seed)
    langs = sorted(set(labels))
    number = {lang: i for i, lang in enumerate(langs)}
    parts = _words(pa.array(texts, pa.string()))
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = parts.offsets.to_numpy()
    found = [subwords(coded.dictionary.slice(i, 20_000).to_pylist()) for i in range(0, len(coded.dictionary), 20_000)]
    rows, counts = np.concatenate([f[0].astype(np.int32) for f in found]), np.concatenate([f[1] for f in found])
    starts = np.cumsum(counts) - counts
    goal = np.array([number[x] for x in labels])
    held = draw.random(len(goal)) < 0.2
    if held.all() or not held.any():
        held = np.arange(len(goal)) % 5 == 4
    table = draw.uniform(-1 / _WIDTH, 1 / _WIDTH, (_ROWS, _WIDTH))
    weights, bias = draw.normal(0, 0.1, (_WIDTH, len(langs))), np.zeros(len(langs))

    def passage(doc: int) -> np.ndarray:
        """Subword rows of a random run of words of the document."""
        begin, end = offsets[doc], offsets[doc + 1]
        n = int(min(end - begin, np.exp(draw.uniform(0, np.log(200)))) or 1)
        first = draw.integers(begin, max(begin, end - n) + 1)
        return np.concatenate([rows[starts[c] : starts[c] + counts[c]] for c in codes[first : first + n]] or [np.empty(0, np.int32)])

    def forward(docs):
        taken = [passage(d) for d in docs]
        sizes = np.array([len(t) for t in taken])
        docs, taken = docs[sizes > 0], [t for t in taken if len(t)]
        sizes = sizes[sizes > 0]
        if not len(docs):
            return docs, sizes, np.empty(0, np.int64), np.empty((0, _WIDTH))
        ids = np.concatenate(taken)
        mean = np.add.reduceat(table[ids], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return docs, sizes, ids, mean

    own = np.flatnonzero(~held)
    steps, done = max(1, epochs * -(-max(len(own), 1500) // batch)), 0
    for _ in range(steps):
        docs, sizes, ids, mean = forward(own[draw.integers(0, len(own), batch)])
        if not len(docs):
            continue
        now = rate * (1 - done / steps)
        done += 1
        error = softmax(mean @ weights + bias)
        error[np.arange(len(docs)), goal[docs]] -= 1
        back = (error @ weights.T) / sizes[:, None]
        weights -= now * mean.T @ error / len(docs) * 10
        bias -= now * error.mean(axis=0)
        owner = np.repeat(np.arange(len(docs)), sizes)
        order = np.argsort(ids, kind="stable")
        distinct, first = np.unique(ids[order], return_index=True)
        table[distinct] -= now * np.add.reduceat(back[owner[order]], first, axis=0)
    probe = np.flatnonzero(held)
    logits, right = [], []
    for _ in range(4):
        docs, _, _, mean = forward(probe)
        logits.append(mean @ weights + bias)
        right.append(goal[docs])
    logits, right = np.concatenate(logits), np.concatenate(right)
    temperature, threshold = 1.0, 0.5
    if len(right):
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(right)), right] + 1e-12).mean()
        temperature = float(min(np.exp(np.linspace(-3, 3, 61)), key=loss))
        chance = softmax(logits / temperature)
        sure, correct = chance.max(axis=1), chance.argmax(axis=1) == right
        order = np.argsort(-sure)
        good = np.flatnonzero(np.cumsum(correct[order]) >= precision * np.arange(1, len(right) + 1))
        threshold = max(0.5, float(sure[order][good[-1]])) if len(good) and good[-1] + 1 < len(right) else 0.5
    return Model(langs, (table @ weights).astype(np.float32), bias, temperature, threshold)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", fit_docs: int = 2000, fit_chars: int = 20_000) -> Model | None:
    """Train on about ``fit_docs`` labelled texts at most, as many of each language as there are.

    Texts are drawn by their hash, so ids play no part, and equal texts of a language count once, however many rows
    hold them.  Of a longer text a run of ``fit_chars`` characters is taken where it lies, from a place its hash
    names, so the driver gets ``fit_docs`` x ``fit_chars`` characters at most.  Distinct texts are counted by a
    sketch that errs by a few per cent.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.lit("language"), text).alias("h"))
    counts = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return None
    each = fit_docs / len(counts)
    share = F.lit(0.0)
    for name, texts in counts.items():
        share = F.when(F.col("l") == name, F.lit(min(1.0, each / max(texts, 1)))).otherwise(share)
    drawn = usable.where(F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    begin = F.pmod(F.shiftright("h", 30), F.greatest(F.length("t") - fit_chars, F.lit(0)) + 1) + 1
    rows = drawn.select("l", "h", F.substring("t", begin.cast("int"), F.lit(fit_chars)).alias("t")).dropDuplicates(["l", "h"]).select("l", "t").collect()
    rows = sorted(rows, key=lambda r: (r["l"], r["t"]))
    return train([r["t"] for r in rows], [r["l"] for r in rows]) if rows else None


def _predict(model: Model | None, text: str, keep: list[str], added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                parts = _words(batch.column(text))
                coded = parts.flatten().dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                offsets = parts.offsets.to_numpy()
                offsets = offsets - offsets[0]
                if model is None:
                    names = [UNKNOWN] * batch.num_rows
                    score, out = np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
                else:
                    sums, counts = model.of_words(coded.dictionary.to_pylist())
                    summed = np.add.reduceat(sums[codes], offsets[:-1], axis=0)
                    letters = np.add.reduceat(counts[codes], offsets[:-1])
                    chance = model.scores(summed, letters)
                    best = chance.argmax(axis=1)
                    score = np.where(letters > 0, chance[np.arange(len(best)), best], 0.0)
                    names = [model.langs[b] if n else UNKNOWN for b, n in zip(best, letters)]
                    out = (letters == 0) | (score < model.threshold)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(score), pa.array(out)], names=[*keep, *added]
                )

    return run


def detect(docs: DataFrame, model: Model | None, *, text: str = "text", keep: Sequence[str] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The kept columns with ``lang_pred``, ``score`` and ``rejected``."""
    added = [prefix + a for a in ADDED]
    keep = free_of(keep, added)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_predict(model, text, keep, added), f"{schema}, {added[0]} string, {added[1]} double, {added[2]} boolean")
