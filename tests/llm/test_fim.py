"""Fill-in-the-middle: outputs equal those of string slicing, and every output gives its text back."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from slatework.llm.fim import FORMS, MARKERS, fill_in_middle, flat, gather, restore, scatter, texts_of

LONG = "naïve 漢字 \U0001f600 <x> " * 200_000


def by_slicing(key, text, rate=90, suffix_first=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, s, m = (f"{x}" for x in MARKERS)
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


def rows():
    texts = ["", None, "a", "é", "<P>", "x<S>y", "<M", ">", "S>", "<P", "<", "\x00\n", "漢字" * 40, "<<S", LONG]
    made = [(i, texts[i % len(texts)] if i < 30 else f"text {i} é漢\U0001f600 " * (i % 9), 5, "f") for i in range(400)]
    return made + [(None, "no id", 5, None), (7, "twice", 5, None), (7, "twice", 5, None)]


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, n int, FORM string")


def test_outputs_equal_slicing_and_come_back(spark):
    data = rows()
    found = restore(fill_in_middle(frame(spark, data), keep=("doc_id", "text"))).collect()
    got = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found), key=repr)
    assert got == sorted(((d[0], d[1], *by_slicing(d[0], d[1])) for d in data), key=repr)
    assert all(r["restored"] == (r["text"] or "") for r in found)
    assert {r["form"] for r in found} == set(FORMS)


def test_clashing_columns_are_replaced_and_prefix_keeps_them(spark):
    df = frame(spark, rows()[:60])
    assert fill_in_middle(df, keep=("doc_id", "n", "FORM")).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    both = fill_in_middle(df, keep=("doc_id", "n"), prefix="fim_").first()
    assert both["n"] == 5 and both["fim_form"] in FORMS


def test_empty_table(spark):
    assert restore(fill_in_middle(frame(spark, []))).count() == 0


def test_what_is_no_output_is_not_restored(spark):
    odd = [("psm", "no markers"), ("psm", "<S>a<P>b<M>c"), ("spm", "x<S>a<P>b<M>c"), ("spm", "<S>a<P>b<M>c<M>"), ("else", "a"), (None, "b"), ("plain", "<P>"), ("psm", "<P><S><M>")]
    out = restore(spark.createDataFrame(odd, "form string, output string"))
    assert [r["restored"] for r in out.collect()] == [None] * 6 + ["<P>", ""]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aé漢\U0001f600<>PSM\n", max_size=12), max_size=12), st.integers(0, 2**32 - 1))
def test_any_batch_round_trips(texts, draw):
    markers = [m.encode() for m in MARKERS]
    rng = np.random.default_rng(draw)
    drawn = [rng.integers(0, 1 << 32, len(texts)) for _ in range(4)]
    made = scatter(*flat(pa.array(texts, pa.string())), drawn, 90, 50, markers)
    outputs = texts_of(made["output"], made["offsets"])
    raw, ends, bad = gather(*flat(outputs), made["form"], markers)
    assert not bad.any() and texts_of(raw, ends).to_pylist() == texts
    assert all(len(o) == len(t) + (0 if f == 0 else 9) for o, t, f in zip(outputs.to_pylist(), texts, made["form"]))


def test_markers_are_checked(spark):
    for wrong in (("P", "S", "M"), ("<P>", "<P>", "<M>"), ("<P>", "<S", "<M>"), ("<<P>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(frame(spark, []), markers=wrong)
    longer = ("<prefix>", "<suf>", "<mid>")
    out = restore(fill_in_middle(frame(spark, rows()[30:200]), keep=("text",), rate=100, markers=longer), markers=longer).collect()
    assert all(r["restored"] == (r["text"] or "") for r in out) and any(r["output"].startswith("<prefix>") for r in out)
