"""The operators against plain versions of themselves, and their edge cases."""

from __future__ import annotations

import hashlib
import os
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import chat, components, decontaminate, exact_dedup, language, mixing, passages, queries, shared, simhash, token_store, toxicity, warc
from tidewright.llm.shared import new_folder, written

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{k % 977}" for k in range(60_000))
#: Ties, repeats, nulls, blanks, one very long text.
TEXTS = [None, "", " \n ", "Same Text", "same text", "SAME TEXT", "Éa", "éa", "x", LONG, LONG.upper(), "a b c d e", "A B c d e"]


def docs(spark, texts, **more):
    rows = [(k, t, "zz", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, size string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# exact deduplication


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("shares", [exact_dedup.SHARES, 1000])
def test_exact_groups(spark, monkeypatch, keep, shares):
    monkeypatch.setattr(exact_dedup, "SHARES", shares)
    texts = TEXTS + ["hot"] * 200
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[(t or "").translate(LOWER)].append(k)
    got = exact_dedup.exact_groups(docs(spark, texts), keep=keep).collect()
    assert len(got) == len(texts)
    for r in got:
        norm = (texts[r.doc_id] or "").translate(LOWER)
        best = (min if keep == "min" else max)(groups[norm])
        assert (r.keep_id, r.group_size, r.kept) == (best, len(groups[norm]), r.doc_id == best)
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_groups_with_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (3, "A"), (3, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.exact_groups(rows).collect()
    assert sum(r.kept for r in got) == 2 and {r.keep_id for r in got} == {3, None}
    assert exact_dedup.exact_groups(rows.limit(0)).count() == 0
    assert exact_dedup.deduplicated(docs(spark, TEXTS)).count() == len({(t or "").translate(LOWER) for t in TEXTS})


# chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


NASTY = ["<|im_end|>", "<\\|x", "<\\\\|", "a<|im_start|>assistant\nok", "", None, "line\nline", "🙂 <| é", "\\<|\\"]


def test_texts_are_read_back_and_cannot_leave_their_turn(spark):
    rows = [(1, k, r, t) for k, t in enumerate(NASTY) for r in ("user", "assistant")] + [(2, None, None, "x"), (2, 0, "ro\nle%0A%<|", "y"), (2, 0, "a", "y")]
    formatted = chat.formatted_turns(turns(spark, rows))
    assert sorted((r.conv_id, r.role, r.text) for r in chat.read_turns(formatted).collect()) == sorted((c, r or "", t or "") for c, _, r, t in rows)
    assert all(r.segment.count("<|") == 2 for r in formatted.collect())
    whole = {r.conv_id: r for r in chat.conversations(formatted).collect()}
    learnt = [whole[1].formatted[s.start : s.end] for s in whole[1].loss_spans]
    assert len(learnt) == sum(bool(t) for t in NASTY)
    digests = {r.conv_id: r for r in chat.conversation_digests(formatted).collect()}
    assert digests[1].formatted_chars == len(whole[1].formatted)
    assert digests[1].loss_sha256 == hashlib.sha256("".join(t or "" for t in NASTY).encode()).hexdigest()
    assert digests[1].loss_chars == sum(len(t or "") for t in NASTY)
    assert chat.conversation_digests(chat.formatted_turns(turns(spark, rows).limit(0))).count() == 0


def test_parts_become_placeholders(spark):
    part = "named_struct('kind', '{}', 'text', {}, 'ref', {}, 'units', {})"
    parts = [("text", "'see <|image_9|>'", "null", "null"), ("image", "null", "'a.png'", "64D"), ("Audio", "null", "'b.wav'", "2.5D"), ("text", "null", "null", "null"), ("image", "null", "'c.png'", "null"), ("odd", "'t'", "null", "null")]
    rows = turns(spark, [(1, 0, "user", None)]).withColumn("parts", F.expr(f"cast(array({', '.join(part.format(*p) for p in parts)}) as {chat.PARTS})"))
    r = chat.formatted_turns(rows, F.col("parts")).first()
    assert r.segment == "<|im_start|>user\nsee <\\|image_9|><|image_0|><|audio_1|><|image_2|>t<|im_end|>\n"
    assert [(a.nth, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 64), (1, "audio", "b.wav", 63), (2, "image", "c.png", 1)]
    assert r.n_attached_tokens == 128


# language and toxicity


def test_mixtures_find_both_languages(spark):
    texts = {"xx": "abba baba abab bab aba", "yy": "zuzu uzzu zuz uzu zzu"}
    rows = [(k, texts[lang], lang) for k, lang in enumerate(["xx", "yy"] * 20)]
    known = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = docs(spark, [texts["xx"], texts["yy"] * 3, f"{texts['xx']} {texts['yy']} {texts['xx']} " * 8, None, "", "123 --", "×", LONG])
    got = {r.doc_id: r for r in language.language_mixtures(asked, known).collect()}
    assert [got[k].lang_pred for k in range(7)] == ["xx", "yy", "xx", "und", "und", "und", "und"]
    assert got[0].langs == ["xx"] and got[2].langs == ["xx", "yy"] and got[2].shares[0] == pytest.approx(2 / 3, abs=0.1)
    assert got[3].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    nothing = language.fit_languages(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.language_mixtures(asked, nothing).collect()} == {"und"}


@needs_data
def test_language_on_held_out_documents(spark):
    found = queries.op1_language(spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95


def toxic_corpus(n=300):
    draw = np.random.default_rng(1)
    plain, bad = [f"word{k}" for k in range(80)], ["vilething", "vilely", "vilest"]
    texts, labels = [], []
    for k in range(n):
        t = [plain[i] for i in draw.integers(0, 80, 30)]
        if k % 4 == 0:
            t[int(draw.integers(0, 30))] = bad[k % 3]
        texts.append(" ".join(t))
        labels.append(int(k % 4 == 0))
    return texts, labels


def test_toxicity_learns_a_stem(spark):
    texts, labels = toxic_corpus()
    rows = docs(spark, texts)
    marks = spark.createDataFrame([(k, y) for k, y in enumerate(labels)] + [(5, None), (10**9, 1)], "doc_id long, toxic int")
    none = language.Languages([], np.zeros((0, 1)), np.zeros((0, 1)))
    model = toxicity.fit_toxicity(rows, marks, none)
    asked = docs(spark, ["word1 word2 vileness word3", "word1 word2 word3 word4", None, "", "123", LONG, LONG + " vileness"])
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(asked, model).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}
    assert {r.doc_id for r in toxicity.without_toxic(asked, model).collect()} == {1, 2, 3, 4, 5}
    blank = toxicity.fit_toxicity(rows, marks.where("toxic = 0"), none)
    assert {r.score for r in toxicity.toxicity_scores(asked, blank).collect()} == {0.0}


def test_gradient_of_the_largest_answer():
    draw = np.random.default_rng(0)
    rows = draw.normal(size=(7, 6 * toxicity.FILTERS)).astype(np.float32)
    net = toxicity.Network(np.zeros((2, toxicity.DIM)), [np.zeros((w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], np.zeros(24), np.ones(25))
    together, _ = net.pooled(rows, np.array([3, 0, 4]))
    for d, part in ((0, rows[:3]), (2, rows[3:])):
        alone, where = net.pooled(part, np.array([len(part)]))
        assert np.allclose(alone[0], together[d])
        f = toxicity.FILTERS
        two = part[:, f : 2 * f].copy()
        two[:-1] += part[1:, 2 * f : 3 * f]
        assert np.allclose(alone[0, f : 2 * f], two.max(axis=0)) and (where[0, f : 2 * f] == two.argmax(axis=0)).all()


# passages


def test_compact_windows_against_a_plain_version():
    draw = np.random.default_rng(3)
    for n in (1, 5, 40, 200):
        values = draw.integers(0, 50, n).astype(np.uint32)
        left, right = passages.nearest_smaller(values, np.arange(n))
        for c in range(n):
            a = b = c
            while a and values[a - 1] >= values[c]:
                a -= 1
            while b + 1 < n and values[b + 1] >= values[c]:
                b += 1
            assert (left[c], right[c]) == (a, b)
        for w in (1, 3, n):
            if w <= n:
                assert passages.sliding_places(values, w).tolist() == [i + int(values[i : i + w].argmin()) for i in range(n - w + 1)]


def test_repeated_passages(spark):
    draw = np.random.default_rng(5)
    text = lambda n: [f"t{i}" for i in draw.integers(0, 10**6, n)]
    shared, other = text(80), text(70)
    near = shared.copy()
    near[40] = "changed"
    made = [text(100) + shared + text(50), near + text(30), text(20) + shared, text(300), other + text(5), text(9) + other, text(30) + shared[:40], None, "", "short"]
    texts = [" ".join(t) if isinstance(t, list) else t for t in made]
    got = passages.repeated_passages(docs(spark, texts)).collect()
    classes = {r.doc_id: (r.class_id, r.kept) for r in got}
    assert classes == {0: (0, True), 1: (0, False), 2: (0, False), 4: (4, True), 5: (4, False)}
    spans = {r.doc_id: (r.start_word, r.end_word) for r in got}
    assert spans[0] == (100, 180) and spans[2] == (20, 100) and spans[5] == (9, 79)
    assert passages.repeated_passages(docs(spark, texts).limit(0)).count() == 0


def test_passages_that_share_a_line_are_told_apart(spark):
    draw = np.random.default_rng(8)
    text = lambda n: [f"t{i}" for i in draw.integers(0, 10**6, n)]
    line = text(44)
    kinds = [text(3) + line + text(3) for _ in range(25)]
    of = draw.permutation(np.repeat(np.arange(25), 3)).tolist()
    texts = [" ".join(text(40) + kinds[k] + text(40)) for k in of]
    for rows in (docs(spark, texts).coalesce(1), docs(spark, texts).repartition(8)):
        got = {r.doc_id: r.class_id for r in passages.repeated_passages(rows).collect()}
        assert got == {d: of.index(k) for d, k in enumerate(of)}


def set_likeness(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def shingles(words, k=5):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def test_a_frequent_line_loses_no_pair_and_merges_nothing(spark):
    """A line of 44 words inside 280 different passages of 50 words, two copies each, in documents of 130 words."""
    draw = np.random.default_rng(8)
    text = lambda n: [f"t{i}" for i in draw.integers(0, 10**9, n)]
    line = text(44)
    kinds = [text(3) + line + text(3) for _ in range(280)]
    of = draw.permutation(np.repeat(np.arange(280), 2)).tolist()
    rows = docs(spark, [" ".join(text(40) + kinds[k] + text(40)) for k in of]).repartition(4)
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(rows).collect()}
    assert got == {d: of.index(k) for d, k in enumerate(of)}


def test_recall_by_similarity(spark):
    """Pairs of near passages in different surroundings, all of which share a line with many others."""
    draw = np.random.default_rng(12)
    text = lambda n: [f"t{i}" for i in draw.integers(0, 10**9, n)]
    texts, pairs, line = [], [], text(30)
    while len(pairs) < 120:
        core = text(int(draw.integers(20, 60))) + line * (len(pairs) % 2) + text(int(draw.integers(35, 60)))
        near = list(core)
        for _ in range(int(draw.integers(0, 4))):
            near[int(draw.integers(0, len(near)))] = text(1)[0]
        if (alike := set_likeness(shingles(core), shingles(near))) >= passages.SIMILARITY:
            pairs.append((len(texts), len(texts) + 1, alike))
            texts += [" ".join(text(60) + core + text(30)), " ".join(text(20) + near + text(70))]
    classes = {r.doc_id: r.class_id for r in passages.repeated_passages(docs(spark, texts)).collect()}
    found = [(s, a in classes and classes[a] == classes.get(b)) for a, b, s in pairs]
    for low, high in ((0.8, 0.88), (0.88, 1.01)):
        own = [hit for s, hit in found if low <= s < high]
        assert len(own) >= 15 and np.mean(own) >= 0.9
    assert all(c // 2 == d // 2 for d, c in classes.items())


def test_passages_like_a_third_lose_no_link(spark):
    """A and B, B and C are near copies, A and C are not: B, which is like the leader, still meets C, which is not."""
    draw = np.random.default_rng(14)
    text = lambda n: [f"t{i}" for i in draw.integers(0, 10**9, n)]
    texts, line = [], text(34)
    for k in range(60):
        a = text(13) + line + text(13) if k % 2 else text(60)
        b = a[:20] + ["one"] + a[21:]
        c = b[:40] + ["two"] + b[41:]
        assert set_likeness(shingles(a), shingles(c)) < passages.SIMILARITY < min(set_likeness(shingles(a), shingles(b)), set_likeness(shingles(b), shingles(c)))
        texts += [" ".join(text(30) + x + text(30)) for x in (a, b, c)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in passages.repeated_passages(docs(spark, texts)).collect()}
    assert got == {d: (d - d % 3, 2 if d % 3 == 1 else 1) for d in range(len(texts))}


def test_pairs_of_every_similarity_are_found_in_blocks(spark, monkeypatch):
    """Near copies at the threshold, all with a frequent line; groups of any size give the same."""
    draw = np.random.default_rng(15)
    text = lambda n: [f"t{i}" for i in draw.integers(0, 10**9, n)]
    texts, line = [], text(26)
    while len(texts) < 240:
        core = text(int(draw.integers(10, 30))) + line + text(int(draw.integers(10, 30)))
        at = int(draw.integers(0, len(core)))
        near = core[:at] + text(int(draw.integers(0, 2))) + core[at + 1 :]
        if len(near) >= 50 and set_likeness(shingles(core), shingles(near)) >= passages.SIMILARITY:
            texts += [" ".join(text(60) + core + text(30)), " ".join(text(20) + near + text(70))]
    for block, leads in ((passages.BLOCK, passages.LEADS), (7, 0)):
        monkeypatch.setattr(passages, "BLOCK", block)
        monkeypatch.setattr(passages, "LEADS", leads)
        classes = {r.doc_id: r.class_id for r in passages.repeated_passages(docs(spark, texts)).collect()}
        assert classes == {d: d - d % 2 for d in range(len(texts))}


@pytest.mark.parametrize("change", ["replace", "insert", "delete"])
def test_a_changed_word_at_any_place(change):
    draw = np.random.default_rng(9)
    word = lambda n: draw.integers(0, 2**63, n, dtype=np.uint64)
    least = passages.least_tokens()
    grams = lambda w: passages.gram_hashes(w, passages.SHINGLE)
    for n in (51, 53, 60, 67, 75):
        core = word(n)
        for p in range(n):
            near = np.concatenate([core[:p], word(0 if change == "delete" else 1), core[p + (change != "insert") :]])
            a, b = grams(np.concatenate([word(30), core, word(30)])), grams(np.concatenate([word(17), near, word(40)]))
            if set_likeness(grams(core).tolist(), grams(near).tolist()) < passages.SIMILARITY:
                continue
            common = [t for t in grams(core) if t in set(grams(near).tolist())]
            for t in (common[0], common[len(common) // 2], common[-1]):
                at = (int(np.flatnonzero(a == t)[0]), int(np.flatnonzero(b == t)[0]))
                found = passages.verified(a, b, {at}, least, passages.SIMILARITY)
                assert len(found) == 1, (n, p)
                i, j, k, m, alike = found[0]
                assert min(j - i, m - k) + 1 >= least and set_likeness(a[i : j + 1].tolist(), b[k : m + 1].tolist()) == alike >= passages.SIMILARITY


def test_the_longest_stretch_against_brute_force():
    draw = np.random.default_rng(10)
    for _ in range(200):
        hits = draw.random(30) < 0.85
        at = int(draw.integers(0, 30))
        hits[at] = True
        spans = [(i, j) for i in range(at + 1) for j in range(at, 30) if hits[i] and hits[j] and hits[i : j + 1].mean() >= 8 / 9 - 1e-9]
        i, j = passages.longest(hits, at, 1, 8 / 9)
        assert (i, j) in spans and j - i == max(y - x for x, y in spans)
        x, y = passages.run_around(hits, at)
        assert hits[x : y + 1].all() and (x == 0 or not hits[x - 1]) and (y == 29 or not hits[y + 1])


@needs_data
def test_exact_runs_of_50_words_are_all_found(spark):
    seen, pairs = {}, set()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect():
        w = decontaminate.item_words(r.text)
        for k in range(len(w) - 49):
            first = seen.setdefault(tuple(w[k : k + 50]), r.doc_id)
            if first != r.doc_id:
                pairs.add((first, r.doc_id))
    classes = defaultdict(set)
    for r in queries.op5_passages(spark, DATA).collect():
        classes[r.doc_id].add((r.class_id, r.class_start))
    assert pairs and all(classes[a] & classes[b] for a, b in pairs)


def test_passages_leave_no_table_nor_shuffle_behind(spark):
    """What was only on the way is gone when the result is returned, and only texts that take part are shuffled."""
    line, rng = [f"s{k}" for k in range(60)], np.random.default_rng(11)
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 10**9, 80)), *(line if k < 6 else [])]) for k in range(300)]
    folder = shared.shared_folder(spark).removeprefix("file://")
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    tables = lambda: {x for x in os.listdir(folder) if x.startswith(("passage-rows", "passage-pairs", "passage-ids"))}
    shuffled = lambda: {str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()) if "shuffle_" in str(f)}
    rows = written(docs(spark, texts), "few-passages")
    seen, before = tables(), shuffled()
    result = passages.repeated_passages(rows)
    for _ in range(40):  # files go in the background
        if not (left := shuffled() - before):
            break
        time.sleep(0.25)
    assert not left and tables() == seen
    assert sorted(r.doc_id for r in result.collect()) == list(range(6)) and len({r.class_id for r in result.collect()}) == 1
    ids = written(spark.range(6).toDF("id"), "few-ids")
    assert 6 <= passages.texts_of(rows.withColumnRenamed("doc_id", "id"), ids)[0].count() < 20


def test_pairs_that_go_to_texts_grow_with_rows_not_pairs(spark, monkeypatch):
    """Documents with runs of the same word and different ones beside it, and versions of a passage whose first has few like it."""
    draw = np.random.default_rng(21)
    text = lambda n: [f"t{i}" for i in draw.integers(0, 10**9, n)]
    texts = [" ".join(text(60) + ["the"] * 44 + text(1) * 44 + text(60)) for _ in range(70)]
    core, first = text(80), len(texts)
    for k in range(70):
        copy = list(core)
        for at in (39, 40) if k < 5 else draw.choice([8, 20, 60, 72], 2, replace=False):
            copy[at] = text(1)[0]
        texts.append(" ".join(text(40) + (copy[20:60] if not k else copy) + text(40)))
    handed, held = [], passages.held_against
    monkeypatch.setattr(passages, "held_against", lambda rows, *a: handed.append(rows.count()) or held(rows, *a))
    found = passages.repeated_passages(docs(spark, texts)).collect()
    assert handed[-1] < len(texts)  # 2,000 and more where every two rows that have much in common go there
    assert {r.class_id for r in found if r.doc_id > first} == {min(r.doc_id for r in found)} and {r.doc_id for r in found} >= set(range(first + 5, len(texts)))


def test_no_pair_with_a_passage_in_its_surroundings_is_ruled_out():
    draw = np.random.default_rng(22)
    least, reach = passages.least_tokens(), passages.reach_of(passages.least_tokens())
    grams = lambda w: passages.gram_hashes(np.array(w, np.uint64), passages.SHINGLE)
    word, alike, seen = lambda n, most: draw.integers(1, most, n).tolist(), 0, []
    for k in range(400):
        most = 2**40 if k % 3 else 3  # words that repeat, too
        core = word(int(draw.integers(50, 110)), most) if k % 5 else word(1, 2**40) * 55
        near = list(core)
        for at in draw.integers(0, len(core), int(draw.integers(0, 4))).tolist():
            near[at : at + int(draw.integers(0, 2))] = word(int(draw.integers(0, 3)), most)
        a, b = (grams(word(int(draw.integers(0, 200)), 2**40) + x + word(int(draw.integers(0, 200)), 2**40)) for x in (core, near))
        common = [(i, j) for i, t in enumerate(a.tolist()) for j in np.flatnonzero(b == np.uint64(t))[:1].tolist()]
        for i, j in common[:: max(1, len(common) // 4)]:
            seen += [passages.around(a, i, reach), passages.around(b, j, reach)]
    near = passages.Surroundings(np.stack(seen), least, passages.SIMILARITY)
    x = np.arange(0, len(seen), 2)
    kept = set(near.may_be_alike(x, x + 1).tolist())
    for k in range(len(x)):
        if near.passage(2 * k, 2 * k + 1):
            alike += 1
            assert k in kept
    assert 300 < alike < len(x)


def test_pairs_in_rounds_give_the_same(spark, monkeypatch):
    """However many rounds the pairs are held against each other in, none takes along more than its share of the texts."""
    draw = np.random.default_rng(23)
    text = lambda n: [f"t{i}" for i in draw.integers(0, 10**9, n)]
    kinds = [text(60) for _ in range(30)]
    rows = docs(spark, [" ".join(sum((text(5) + kinds[k] for k in draw.choice(30, 4, replace=False)), [])) for _ in range(60)])
    made, counted = [], passages.rounds_of
    monkeypatch.setattr(passages, "rounds_of", lambda *a: made.append(counted(*a)) or made[-1])
    results = []
    for share in (100.0, 0.4):
        monkeypatch.setattr(passages, "ROUND", share)
        results.append(sorted(passages.repeated_passages(rows).collect()))
        made.append(None)
    assert results[0] == results[1] and len(results[0]) > 60
    assert max(made[: made.index(None)]) == 1 and made[made.index(None) + 1] >= 3


# token store


def test_chunks_give_the_ids_of_whole_texts():
    odd = [" a b\x1cc\x85d é ́x", "A<|endoftext|>B <|startoftext|>, a. <|EndOfText|>.", "ΑΣ ΣΑΣ\n", "İstanbul Ǆ ﬁ", None, "", "  \n", "don't I'LL, 123. ½", "à ̖̀", "한글 글", "abc.. x., ,x A.B. ×a a÷b ªb ĳ ŉ ß. É, D'S", LONG]
    whole, parts = token_store.ChunkTokens(TOKENIZER, True), token_store.ChunkTokens(TOKENIZER)
    for _ in range(2):
        (a, m), (b, n) = whole.encode(odd), parts.encode(odd)
        assert (a == b).all() and (m == n).all()


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_store, "TOKEN_CACHE", 3)
    whole, parts = token_store.ChunkTokens(TOKENIZER, True), token_store.ChunkTokens(TOKENIZER)
    for batch in (["one two", "three four five"], ["six seven one"], ["one six nine"]):
        assert (whole.encode(batch)[0] == parts.encode(batch)[0]).all()


def test_token_files_are_read_back(spark, monkeypatch):
    rows = docs(spark, TEXTS).union(spark.createDataFrame([(None, "null id", "", ""), (2, "again", "", "")], "doc_id long, text string, keep_id string, size string")).repartition(3)
    manifest = token_store.write_tokens(rows, new_folder(spark, "t"), TOKENIZER, 2)
    got = sorted(token_store.read_tokens(spark, manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None, 0, 1, 2, 2, *range(3, len(TEXTS))]
    at, coder = 0, token_store.ChunkTokens(TOKENIZER, True)
    for r in got:
        if r.id is not None and r.id != 2:
            ids = [*coder.encode([TEXTS[r.id]])[0].tolist(), 2]
            assert r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    one = token_store.read_tokens(spark, manifest, with_ids=True, wanted={9}).collect()
    assert [r.id for r in one] == [9] and one[0].start == next(r.start for r in got if r.id == 9)
    assert token_store.stored_tokens(rows.limit(0), TOKENIZER, 2).count() == 0


def test_only_frames_asked_for_are_read_and_damage_is_seen(tmp_path, monkeypatch):
    import io

    monkeypatch.setattr(token_store, "FRAME_IDS", 10)
    sink = io.BytesIO()
    writer = token_store.ShardWriter(sink)
    for k in range(8):
        writer.add(k, np.full(6, k, np.uint32))
    writer.close()

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = token_store.ShardReader(File(sink.getvalue()))
    assert [x.tolist() for _, x in reader.documents({3})] == [[3] * 6] and reader.frames_read == 2  # the index, and one frame
    broken = bytearray(sink.getvalue())
    broken[int(reader.at[2]) + 8] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017
        list(token_store.ShardReader(File(bytes(broken))).documents())


# archive


def pages(spark):
    rows = [(3, "http://a", "one"), (1, "http://b", "one"), (2, None, None), (5, "u\r\nX: y", ""), (4, "http://é", "ünï\r\n\r\nWARC-Type: revisit"), (None, "n", "one"), (None, "n", "alone"), (9, "c", "one")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def archived(spark, rows, least=0, id_type="long"):
    folder = new_folder(spark, "w")
    warc.write_archive(rows, folder, least)
    files = warc.export_warc(warc.original_records(spark, folder), f"{folder}/records")
    return folder, files, warc.read_archive(files, id_type)


@pytest.mark.parametrize("id_type", ["long", "string"])
@pytest.mark.parametrize("least,types", [(0, {3: 1, 1: None, 2: None, 5: 2, 4: None, 9: 1}), (1, {3: 1, 1: None, 2: None, 5: None, 4: None, 9: 1})])
def test_archive_round_trip(spark, least, types, id_type):
    import base64

    name = (lambda k: k) if id_type == "long" else (lambda k: None if k is None else f"{k}>\n é%")
    source = pages(spark) if id_type == "long" else spark.createDataFrame([(name(r.page_id), r.url, r.html, "x") for r in pages(spark).collect()], "page_id string, url string, html string, digest string")
    folder, files, found = archived(spark, source, least, id_type)
    got = found.collect()
    assert len(got) == 8 and {r.page_id: r.refers_to for r in got if r.page_id is not None} == {name(k): name(v) for k, v in types.items()}
    html = {r.page_id: r.html or "" for r in source.collect() if r.page_id is not None}
    for r in got:
        assert (r.record_type == "revisit") == (r.refers_to is not None)
        if r.page_id is not None:
            data = html[r.page_id].encode()
            assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    records = [x for f in files.collect() for x in warc.read_warc(f.path)]
    assert len(records) == 8 and sum(f.n_records for f in files.collect()) == 8
    for fields, block in records:
        page, body = warc.page_of(fields["WARC-Record-ID"]), block.split(b"\r\n\r\n", 1)[1]
        if page is not None:
            assert body == (b"" if fields["WARC-Type"] == "revisit" else html[int(page) if id_type == "long" else page].encode())


def test_a_damaged_payload_is_an_error(spark):
    folder, files, _ = archived(spark, pages(spark))
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("packed", F.lit(b"other")).collect()
    spark.createDataFrame(bad, "key string, packed binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="disagree"):
        warc.original_records(spark, folder).collect()
    record = next(r.record for r in warc.original_records(spark, archived(spark, pages(spark))[0]).collect() if r.page_id == 1)
    lying = spark.createDataFrame([(1, bytearray(bytes(record).replace(b"one", b"two")))], "page_id long, record binary")
    with pytest.raises(Exception, match="disagree"):
        warc.read_archive(warc.export_warc(lying, new_folder(spark, "lying"))).collect()
    assert archived(spark, pages(spark).limit(0))[2].count() == 0


# SimHash


def plain_fingerprint(text):
    w = [x.translate(LOWER) for x in words(text)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_against_a_plain_version():
    texts = [*TEXTS, "a b", "a  b\tc", "one two three four one two three"]
    assert simhash.fingerprints_of(texts).tolist() == [plain_fingerprint(t) for t in texts]


def test_trees_find_every_link():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**63, 12, dtype=np.uint64)
    flips = lambda n: np.bitwise_xor.reduce(np.uint64(1) << draw.integers(0, 64, (n, 12)).astype(np.uint64), axis=0)
    points = np.unique(np.concatenate([base, *[base ^ flips(1 + k % 4) for k in range(60)], draw.integers(0, 2**63, 300, dtype=np.uint64)]))
    tree, plain = simhash.Forest(), simhash.Forest()
    simhash.tree_links(points, tree, leaf=4)
    for i, x in enumerate(points):
        for y in points[i + 1 :][np.bitwise_count(points[i + 1 :] ^ x) <= 3].tolist():
            plain.join(int(x), y)
    assert all(tree.find(int(x)) == plain.find(int(x)) for x in points)


@needs_data
def test_near_duplicates_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    forest = simhash.Forest()
    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                forest.join(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, DATA).collect()}
    assert got == {k: (f"{prints[k]:016x}", forest.find(k)) for k in ids}


def test_near_duplicates_of_odd_rows(spark):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, TEXTS)).collect()}
    assert [got[k] for k in (0, 1, 2, 3, 4, 5)] == [0, 0, 0, 3, 3, 3] and got[9] == got[10] == 9
    assert simhash.near_duplicates(docs(spark, TEXTS).limit(0)).count() == 0
    assert simhash.thinned(docs(spark, TEXTS)).count() == len(set(got.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (160, 100)]
    got = {r.node: r.root for r in components.component_roots(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 100 for k in range(101, 161)}, **{k: 7 for k in range(200, 260)}}


# mixing


def test_targets_stop_at_three_times_a_source_and_the_rest_is_shared(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, None: 30, "e": 0}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip([*sorted(k for k in sizes if k is not None), None], [5, 2, 1, 5, 2], strict=True))
    want, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[k] for k in full)
        share = sum(weight[k] for k in sizes if k not in full)
        want = {k: 3.0 * sizes[k] if k in full else rest * weight[k] / share for k in sizes}
        over = {k for k in sizes if k not in full and want[k] >= 3 * sizes[k]}
        if not over:
            break
        full |= over
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_each_source_ends_near_its_target(spark):
    draw = np.random.default_rng(4)
    rows = [(k, "w " * int(draw.integers(0, 60)), ["a", "b", "c", None][k % 4] if k % 3 else "a") for k in range(900)] + [(5000, None, "z"), (5001, "", "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for preference in (None, F.col("doc_id") % 5 + 1):
        got = mixing.mixed(table, preference=preference)
        for s in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
            assert abs(s.taken - s.target) <= s.most * (1 if preference is None else 60)
        assert got.where("taken > 3 * size").count() == 0 and got.count() == len(rows)
    one, two = (sorted(map(str, mixing.mixed(t).collect())) for t in (table, table.repartition(7)))
    assert one == two
    assert mixing.mixed_documents(table).columns == table.columns
    assert mixing.mixed(table.limit(0)).count() == 0


def test_repeated_rows_are_drawn_as_often_as_planned(spark):
    rows = [(k % 40, "w w" if k % 3 else None, "a" if k % 5 else None, "x", k) for k in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, __copies string, nth long")
    got = mixing.mixed_documents(table)
    taken = [r for r in got.collect()]
    assert got.columns == table.columns and got.schema["nth"].dataType == table.schema["nth"].dataType
    planned = sum(r.copies for r in mixing.mixed(table).collect())
    assert abs(len(taken) - planned) <= 4
    assert max(taken.count(r) for r in set(taken)) <= 3
    assert mixing.mixed_documents(table.limit(0)).count() == 0


def test_the_mix_deals_its_texts_out_once(spark):
    rows = [(k % 50, "w " * (k % 7), "a" if k % 3 else None) for k in range(200)] + [(None, "w w", None)] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        got = mixing.mixed_documents(table)
        lines = got._jdf.queryExecution().executedPlan().toString().split("\n")
        at = next(k for k, line in enumerate(lines) if "Window [row_number" in line)
        assert sum("Exchange hashpartitioning(key" in line for line in lines[: next(k for k in range(at, len(lines)) if "xxhash64(text" in lines[k])]) == 1
        planned = sum(r.copies for r in mixing.mixed(table).collect())
        assert abs(got.count() - planned) <= 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_toxicity_learns_from_tables_with_clashing_columns(spark, monkeypatch):
    texts, labels = toxic_corpus()
    rows = spark.createDataFrame([(k, t, 0, "k", 1) for k, t in enumerate(texts)] + [(10**6, "a " * 5000, 0, "k", 1)], "doc_id long, text string, y int, key string, id int")
    marks = spark.createDataFrame([(k, y, 9, 9) for k, y in enumerate(labels)] + [(10**6, 1, 9, 9)], "doc_id long, toxic int, y int, id int")
    none = language.fit_languages(spark.createDataFrame([], "doc_id long, text string, lang string"))
    monkeypatch.setattr(toxicity, "FIT_LONGEST", 4000)
    model = toxicity.fit_toxicity(rows, marks, none)
    right = [r.predicted == labels[r.doc_id] for r in toxicity.toxicity_scores(rows, model).collect() if r.doc_id < 10**6]
    assert np.mean(right) > 0.95
    assert toxicity.without_toxic(rows.limit(0), model).columns == rows.columns
    monkeypatch.setattr(toxicity, "FIT_WORDS", 0)  # still documents of both labels
    assert toxicity.fit_toxicity(rows, marks, none).network is not None
    monkeypatch.setattr(toxicity, "FIT_LONGEST", 0)
    with pytest.raises(ValueError, match="no network can be fitted"):
        toxicity.fit_toxicity(rows, marks, none)


@needs_data
def test_held_out_toxicity_and_scores_by_a_plain_network(spark):
    """The registered query on labels it did not learn from, and its scores against a convolution written out word by word."""
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, DATA).collect()}
    docs_ = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(got) == set(docs_)
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    known = ~language.held_out(F.col("doc_id"))
    model = toxicity.fit_toxicity(table, spark.read.parquet(f"{DATA}/labels.parquet").where(known), language.fit_languages(table.where(known)))
    net = model.network
    for i in sorted(docs_)[:25]:
        found = toxicity.letter_words(docs_[i])
        vectors = [sum(net.embed[b] for b in toxicity.features(w)) for w in found]
        answers = []
        for width, tap in zip(toxicity.WIDTHS, net.taps, strict=True):
            spans = [sum(vectors[s + k] @ tap[k] for k in range(min(width, len(found) - s))) for s in range(len(found))]
            answers.append(np.max(spans, axis=0) if spans else np.zeros(toxicity.FILTERS))
        hidden = np.maximum(np.concatenate(answers) + net.bias, 0) if found else np.zeros(len(net.bias))
        logit = hidden @ net.out[:-1] + net.out[-1]
        rows = model.word_rows(found) if found else np.zeros((0, 1))
        lang = int(rows[:, sum(toxicity.WIDTHS) * toxicity.FILTERS :].sum(axis=0, dtype=np.float64).argmax()) if found and model.languages.names else -1
        want = 1 / (1 + np.exp(-np.clip(logit - model.cuts[lang] + toxicity.logit(toxicity.THRESHOLD), -30, 30)))
        assert got[i].score == pytest.approx(want, abs=1e-4) and got[i].predicted == int(got[i].score >= 0.3)


def test_likelier_documents_are_drawn_more_often(spark):
    rows = [(k, "w w w w", "a" if k % 2 else "b") for k in range(2000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), preference=F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0))
    rate = {r.often: r.rate for r in got.groupBy((F.col("doc_id") % 4 < 2).alias("often")).agg(F.avg("copies").alias("rate")).collect()}
    assert rate[True] / rate[False] == pytest.approx(3, rel=0.1)


# decontamination


def plain_hits(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        b = cut(t)
        n = min(10, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("bits", [decontaminate.MOST_BITS, 1 << 10, 8])
def test_decontamination_against_a_plain_version(spark, bits):
    draw = np.random.default_rng(6)
    word = lambda n: " ".join(f"Wörd{i}" for i in draw.integers(0, 6, n))
    items = [(1, word(30)), (10, word(12)), (2, word(9)), (3, "Tiny one"), (4, None), (5, "..."), (None, word(11)), (2, word(10))]
    texts = [word(200), f"{items[0][1]}", f"x {items[1][1][:40]} y", word(9), f"a tiny, ONE! {items[6][1]}", None, "", "tiny", LONG, f"{items[2][1]} {items[3][1]}"]
    got = {r.doc_id: r for r in decontaminate.benchmark_hits(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), most_bits=bits).collect()}
    for k, t in enumerate(texts):
        assert (got[k].n_words, got[k].n_hit, got[k].items) == plain_hits(t, items)
        assert sum(s.end - s.start for s in got[k].spans) == got[k].n_hit
    clean = {r.doc_id for r in decontaminate.decontaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), most_bits=bits).collect()}
    assert clean == {k for k in got if not got[k].n_hit}


def test_nothing_to_decontaminate(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.benchmark_hits(docs(spark, TEXTS), none).collect()} == {0}
    assert decontaminate.benchmark_hits(docs(spark, TEXTS).limit(0), none).count() == 0
    assert decontaminate.decontaminated(docs(spark, TEXTS), none).count() == len(TEXTS)


def test_rows_of_a_window_in_many_documents_are_split_and_all_found(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    texts = [f"n{k} {passage} m{k}" if k % 3 == 0 else f"n{k} other words {k} alone {k}" for k in range(600)]
    items = spark.createDataFrame([(1, passage), (2, f"before {passage}"), (3, "q " * 30)], "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what is too large to broadcast
    try:
        got = decontaminate.benchmark_hits(docs(spark, texts), items).collect()
        left = decontaminate.decontaminated(docs(spark, texts), items).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 600 and left == 400
    assert all((r.n_hit, r.items) == ((14, ["1", "2"]) if r.doc_id % 3 == 0 else (0, [])) for r in got)


def test_decontamination_of_repeated_rows_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(12))
    rows = [(1, text, "a"), (1, text, "a"), (1, "clean", "b"), (None, text, "c"), (None, None, "d")]
    names = "doc_id long, text string, id string"
    for extra in ("row", "found", "print", "window", "items", "n_words"):
        names += f", {extra} string"
    table = spark.createDataFrame([(*r, *"uvwxyz") for r in rows], names)
    items = spark.createDataFrame([(5, text)], "item_id long, text string")
    kept = decontaminate.decontaminated(table, items)
    assert kept.columns == table.columns and sorted(r["id"] for r in kept.collect()) == ["b", "d"]
    assert sorted(r.n_hit for r in decontaminate.benchmark_hits(table, items).collect()) == [0, 0, 12, 12, 12]
