"""Fill in the middle against a plain cut of each text, and the list of boundaries against an array."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm import fill_middle

LONG = "\n".join(f"line {k % 97} é" for k in range(120_000))
TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb\nc\n", "a\nb\nc", "é\n😀 x\n", "has <P> in it\nb", "<S>", "x<M>y\n", "ends in <", "ends in <M", "a\r\nb\rc\x0bd e\n", "nul \x00 in\nit", LONG, LONG + "\n"]


def plainly(ident, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return len(units), "plain", None, None, text
    i, j = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if d % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, len(p), len(m), out


@pytest.mark.parametrize(("rate", "shares"), [(100, 4), (100, 10_000), (60, 4)])
def test_equals_plain_cuts(spark, monkeypatch, rate, shares):
    monkeypatch.setattr(fill_middle, "SHARES", shares)
    rows = list(enumerate(TEXTS + ["hot\ntext\n"] * 300 + ["a\nb\nc\n"] * 3)) + [(5, "again\nx"), (5, "again\nx"), (None, "a\nb"), (None, None)]
    df = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, key string, n int").repartition(3)
    made = fill_middle.filled_in_middle(df, rate=rate).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = made.collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    want = sorted(((i, *plainly(i, t, rate=rate)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == want
    texts = sorted(t or "" for _, t in rows)
    assert sorted(r.back for r in got) == texts


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    """Were all hashes equal, full comparison would still part the texts."""
    monkeypatch.setattr(fill_middle.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    texts = ["a\nb\n", "c\nd\n", "a\nb\n", "c\nd\n", "e"]
    got = fill_middle.filled_in_middle(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.output for r in got} == {k: plainly(k, t)[-1] for k, t in enumerate(texts)}


def test_an_empty_table(spark):
    assert fill_middle.filled_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_identifiers_of_text(spark):
    (row,) = fill_middle.filled_in_middle(spark.createDataFrame([("k1", "a\nb\nc\n")], "doc_id string, text string")).collect()
    assert row.output == plainly("k1", "a\nb\nc\n")[-1]


def test_equal_texts_are_indexed_once(monkeypatch):
    """The index of a text is made when its run begins, whatever the number of its documents."""
    index = fill_middle.TextIndex("a\nb\nc")
    cuts = {index.cut([a, b, 0, 0], 100, 50)[1:3] for a in range(8) for b in range(8)}
    assert cuts == {(i, j - i) for i in (0, 2, 4, 5) for j in (0, 2, 4, 5) if i <= j}


@given(st.lists(st.integers(0, 5000), max_size=400).map(sorted))
def test_the_list_gives_back_every_number(values):
    packed = fill_middle.EliasFano(np.array(values, np.int64))
    assert [packed[k] for k in range(len(packed))] == values
    with pytest.raises(IndexError):
        packed[len(values)]


def test_the_list_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 120, 50_000))
    packed = fill_middle.EliasFano(values)
    assert all(packed[k] == values[k] for k in range(0, 50_000, 97)) and packed[49_999] == values[-1]
    assert packed.nbytes * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 2
