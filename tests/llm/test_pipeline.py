"""The pipeline's stages: what each keeps, against plain versions."""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidewright.llm import decontaminate, near_copies, shared, simhash, token_store
from tidewright.llm.shared import table, written

from .test_ops import DATA, LOWER, TOKENIZER, plain_fingerprint, plain_hits

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name)
        kept[name] = docs
        if name != "token_ids":
            assert docs.columns == columns
    labels = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").collect()}
    left = {r.doc_id for r in kept["toxicity"].collect()}
    toxic = [k for k, y in labels.items() if y == 1]
    clean = [k for k, y in labels.items() if y == 0]
    assert np.mean([k in left for k in clean]) > 0.9 and np.mean([k in left for k in toxic]) < 0.3

    prints = {r.doc_id: plain_fingerprint(r.text) for r in kept["toxicity"].collect()}
    forest = simhash.Forest()
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                forest.join(a, b)
    thin = {r.doc_id: r.text for r in kept["near_duplicates"].collect()}
    alone, texts = sorted({forest.find(k) for k in prints}), {r.doc_id: r.text for r in kept["toxicity"].collect()}
    near = simhash.Forest()
    for n, a in enumerate(alone):
        for b in alone[n + 1 :]:
            if alike(texts[a], texts[b]) >= 0.8:
                near.join(a, b)
    assert set(thin) == {k for k in alone if near.find(k) == k}

    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    fine = {r.doc_id: r for r in kept["decontamination"].collect()}
    assert set(fine) == {k for k, t in thin.items() if not plain_hits(t, items)[1]}

    mix = [r.doc_id for r in kept["mixing"].collect()]
    assert set(mix) <= set(fine) and max(mix.count(k) for k in set(mix)) <= 3
    sizes = {k: len((r.text or "").split()) for k, r in fine.items()}
    assert sum(sizes[k] for k in mix) == pytest.approx(sum(sizes.values()), rel=0.15)

    coder = token_store.ChunkTokens(TOKENIZER, True)
    crc = {k: zlib.crc32(np.append(coder.encode([fine[k].text])[0], 2).astype("<u4").tobytes()) for k in set(mix)}
    rows = kept["token_ids"].orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(mix) and all(r.ids_crc32 == crc[r.doc_id] for r in rows)


@functools.cache
def shingles(text):
    w = (text or "").translate(LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) else 0.0


def likeness(a, b):
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    a, b = (cut((t or "").translate(LOWER).split()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 0.0


def test_no_near_copy_stays(spark):
    rows = table(spark, DATA, "documents").where("doc_id in (1, 177, 6, 145, 2, 3)")
    text = {r.doc_id: r.text for r in rows.collect()}
    assert likeness(text[1], text[177]) >= 0.8 and likeness(text[6], text[145]) >= 0.8
    assert {177, 145} <= {r.doc_id for r in simhash.thinned(rows).collect()}
    assert not {177, 145} & {r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, DATA).collect()}


def test_near_copies_against_brute_force(spark):
    docs = table(spark, DATA, "documents").where("doc_id < 200")
    text = {r.doc_id: r.text for r in docs.collect()}
    forest = simhash.Forest()
    for a in text:
        for b in text:
            if a < b and likeness(text[a], text[b]) >= 0.8:
                forest.join(a, b)
    assert {r.doc_id for r in near_copies.without_near_copies(docs).collect()} == {k for k in text if forest.find(k) == k}


def test_a_folder_of_our_own_on_one_machine_only():
    from types import SimpleNamespace

    from tidewright.llm.shared import shared_folder

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir is unset"):
            shared_folder(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master)))


def test_recall_in_large_bands(spark):
    """Pairs of similarity 0.8 to 0.9 in bands that they share with many others of similarity 0.6 or so."""
    draw = np.random.default_rng(11)
    word = lambda n: [f"w{i}" for i in draw.integers(0, 10**9, n)]
    base, rows, pairs = word(150), [], []
    for _ in range(150):
        own = base + word(50)
        near = list(own)
        near[-int(draw.integers(1, 40))] = near[-int(draw.integers(1, 40))] = "changed"
        if alike(" ".join(own), " ".join(near)) >= 0.8:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(near))]
    assert len(pairs) > 100 and alike(rows[0][1], rows[2][1]) < 0.65
    gone = {r.id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone <= {b for _, b in pairs} and len(gone) >= 0.95 * len(pairs)


def test_bounds_on_sets_rule_out_no_pair_that_is_alike(spark):
    draw = np.random.default_rng(8)
    texts = []
    for _ in range(8):
        own = [f"w{i}" for i in draw.integers(0, 10**6, int(draw.integers(3, 900)))]
        texts.append(own)
        for n in (1, 2, 4, 8, 40, 200):
            other = list(own)
            for at in draw.integers(0, len(own), n):
                other[at] = "changed"
            texts.append(other)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = written(near_copies.sketches(spark.createDataFrame(rows, "id long, text string")), "sketches")
    all_pairs = [(a, b) for a, _ in rows for b, _ in rows if a < b]
    left = {(r.a, r.b) for r in near_copies.maybe_alike(spark.createDataFrame(all_pairs, "a long, b long"), sets, 0.8).collect()}
    assert {(a, b) for a, b in all_pairs if alike(rows[a][1], rows[b][1]) >= 0.8} <= left
    assert len(left) < 0.2 * len(all_pairs)


def test_identifiers_of_text_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("b", text, 1, "x"), ("a", text + " end", 2, "y"), ("c", "other words", 3, "z"), (None, text, 4, "n")]
    got = near_copies.without_near_copies(spark.createDataFrame(rows, "doc_id string, text string, id int, a string"))
    assert {(r.doc_id, r.id, r.a) for r in got.collect()} == {("a", 2, "y"), ("c", 3, "z"), (None, 4, "n")}


def test_large_bands_of_near_copies_and_repeated_rows(spark):
    draw = np.random.default_rng(4)
    word = lambda n: [f"w{i}" for i in draw.integers(0, 10**6, n)]
    base, rows = word(120), []
    for k in range(60):  # of one half, and of four families that agree in it
        family = draw.integers(0, 4)
        own = np.random.default_rng(int(family)).integers(0, 10**6, 60)
        text = base[:60] + [f"f{i}" for i in own]
        text[int(draw.integers(60, 120))] = "changed"
        rows.append((k, " ".join(text)))
    rows += [(0, rows[0][1]), (100, None), (101, ""), (None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    stay = [r for r in near_copies.without_near_copies(table).collect()]
    kept = sorted(r.doc_id for r in stay if r.doc_id is not None and r.doc_id < 100)
    assert kept.count(0) == 2 and len(stay) - len(kept) == 3
    texts = dict(rows[:60])
    assert all(alike(texts[a], texts[b]) < 0.8 for a in set(kept) for b in set(kept) if a < b)
    assert all(any(alike(texts[a], texts[b]) >= 0.8 for b in kept) for a in texts)
    assert near_copies.without_near_copies(table.limit(0)).count() == 0


def test_item_words_and_empty_table(spark):
    assert decontaminate.item_words("A-b 1é!") == [b"a", b"b", "1é".encode()]
    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_rows_that_match_whatever_the_filter(spark):
    rows = spark.createDataFrame([(k % 30 if k % 7 else None, str(k)) for k in range(90)], "doc_id long, text string")
    for wanted in ([3, 5, None], [3, 29], []):
        ids = spark.createDataFrame([(k,) for k in wanted], "id long")
        for bits in (8, 1 << 23):
            key = rows["doc_id"]
            some, others = shared.matching(rows, key, ids, bits), shared.not_matching(rows, key, ids, bits)
            assert some.columns == others.columns == rows.columns
            assert {r.text for r in some.collect()} == {r.text for r in rows.collect() if r.doc_id in wanted}
            assert some.count() + others.count() == 90 and not {r.text for r in others.collect()} & {r.text for r in some.collect()}


def test_near_copies_end_when_bands_are_small(spark, monkeypatch):
    rows = [(k, " ".join(f"w{(7 * k + j) if j > 20 else j}" for j in range(60))) for k in range(40)]
    rows += [(100 + k, t.replace("w5 ", "changed ")) for k, t in rows]
    table, made = spark.createDataFrame(rows, "doc_id long, text string"), []
    monkeypatch.setattr(near_copies, "new_folder", lambda spark, name, f=near_copies.new_folder: made.append(name) or f(spark, name))
    want = {b for a, x in rows for b, y in rows if a < b and alike(x, y) >= 0.8}
    assert {r.id for r in near_copies.near_copies(table).collect()} == want and made.count("bands") <= 2


def test_stages_hand_tasks_small_batches(spark, monkeypatch):
    """Texts of 3,000 characters go to Python 4 MB at a time and not 10,000 rows, also where a stage's table is only written later."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat('0123456789', 300) AS text")

    def bytes_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    monkeypatch.setattr(corpus_pipeline, "decontaminated", lambda docs, _: docs.mapInArrow(bytes_of, "bytes long"))
    try:
        sizes = [r.bytes for r in corpus_pipeline.decontamination(spark, docs, DATA).collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(sizes) > 6000 * 3000 and max(sizes) < 2 * shared.BATCH_BYTES
