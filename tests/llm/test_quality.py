"""The additive model: held-out accuracy, tables against a plain sum, pairs, and edge cases."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import quality, queries

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    y = np.asarray(labels)[order]
    ones = y.sum()
    return ((np.arange(1, len(y) + 1) * y).sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@needs_data
def test_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op13_quality"](spark, DATA).collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.quality is not None and got[r.doc_id].held_out]
    scores = np.array([got[i].score for i, _ in labels])
    y = np.array([v for _, v in labels])
    assert area(scores, y) > 0.97 and ((scores >= 0.5) == (y > 0)).mean() > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_scores_are_sums_of_table_entries():
    draw = np.random.default_rng(4)
    x = draw.normal(0, 1, (600, 5))
    y = ((x[:, 0] > 0.3) | (x[:, 1] * x[:, 2] > 0.5)).astype(float)
    model = quality.fitted(x, y, np.arange(600) % 5 == 0)
    assert area(model.logits(x), y) > 0.95 and (1, 2) in model.pairs
    for row in draw.normal(0, 2, (20, 5)):
        bins = [int((e <= v).sum()) for e, v in zip(model.edges, row, strict=True)]
        want = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        want += sum(t[model.coarse[a][bins[a]], model.coarse[b][bins[b]]] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert model.logits(row[None])[0] == pytest.approx(want)


def test_pairs_explain_what_single_measures_cannot():
    draw = np.random.default_rng(8)
    x = draw.uniform(-1, 1, (2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fitted(x, y, np.arange(2000) % 5 == 0)
    alone = sum(t[b] for t, b in zip(model.tables, model.bins(x).T, strict=True))
    assert area(alone, y) < 0.7 < 0.9 < area(model.logits(x), y) and model.pairs[0] == (0, 1)


def test_a_tree_cuts_where_labels_change():
    g, h = np.array([5.0, 5.0, -5.0, -5.0, 9.0]), np.full(5, 10.0)
    values = quality.shallow_tree(g, h)
    assert len(set(values)) == 3 and values[0] == values[1] > 0 > values[2] == values[3] and values[4] > 0
    assert quality.best_split(np.zeros(1), np.ones(1)) == (0.0, 0)


def test_measures_of_odd_texts():
    assert quality.measures(None) == quality.measures("") == (0.0,) * len(quality.MEASURES)
    for text in (" ", "\n\n", "x", "\x00", "é", "😀😀", "A" * 300_000, "one two\n" * 50_000):
        found = quality.measures(text)
        assert len(found) == len(quality.MEASURES) and np.isfinite(found).all()
    named = dict(zip(quality.MEASURES, quality.measures("AB ab ab ## é\nAB ab ab ## é"), strict=True))
    assert named["upper"] == pytest.approx(4 / 14) and named["same_again"] == pytest.approx(2 / 10) and named["repeated_chars"] == 0.5


def test_without_both_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(k, t, 1.0, "y") for k, t in enumerate([None, "", "a b", "A B"])], "doc_id long, text string, score double, y string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels, share in ((none, 0.5), (spark.createDataFrame([(0, None), (1, None)], "doc_id long, quality int"), 0.5)):
        assert [r.score for r in quality.quality_scores(docs, quality.fit_quality(docs, labels)).collect()] == [share] * 4
    ones = spark.createDataFrame([(k, 1) for k in range(4)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in quality.quality_scores(docs, quality.fit_quality(docs, ones)).collect())
    empty = docs.limit(0)
    assert quality.quality_scores(empty, quality.fit_quality(empty, none)).collect() == []


def test_clashing_columns_repeats_and_text_identifiers(spark):
    rows = [(f"d{k}", ("LOUD WORDS!! " if k % 2 else "calm words, ") * (3 + k % 5), k, "c") for k in range(120)]
    rows += rows[:10]
    docs = spark.createDataFrame(rows, "doc_id string, text string, of int, x string")
    labels = spark.createDataFrame([(f"d{k}", 1 - k % 2, "z") for k in range(120)], "doc_id string, quality int, label string")
    got = quality.quality_scores(docs, quality.fit_quality(docs, labels)).collect()
    assert len(got) == 130 and all(r.predicted == 1 - int(r.doc_id[1:]) % 2 for r in got)


def test_what_is_held_out(spark):
    from zlib import crc32

    got = spark.range(200).select("id", quality.set_aside(F.col("id")).alias("out")).collect()
    assert all(r.out == (crc32(str(r.id).encode()) % 3 == 1) for r in got)
