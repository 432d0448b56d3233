"""Toxicity by a convolutional text classifier.

A word is the sum of hashed embeddings: one for the word and one for each of its first few letters, so that words that
share a stem share most of their vector.  Filters of widths 1, 2 and 3 pass over the words, the largest answer of each
is kept, and a logistic unit weighs them.  The network is trained in numpy on a bounded, documented sample of labelled
documents; a part of the sample that it never trains on calibrates a threshold for each language that the text appears
to be in (inferred from the text alone).  Scores are shifted so that every language's threshold becomes 0.3.

Tasks turn the sample's texts into rows of word codes (a word's buckets, 8 bytes), and one task trains on them; the
driver sees no text, only the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import Languages, sampled
from .shared import written
from .words import WordRows, kept_rows, letter_words, pieces

#: Labelled documents that the network is trained and calibrated on at most, on average; drawn by a hash of the identifier.
FIT_DOCUMENTS = 8_000
#: Words of them together at most, but for what it takes to have documents of both labels: of more, fewer documents are
#: drawn, by the same hash.  Documents are trained on whole.
FIT_WORDS = 4_000_000
#: Words of a document in the sample at most; a longer one is left out of the fit as a whole.
FIT_LONGEST = 400_000
#: Steps in which the sample is made smaller until its words fit.
SHARES = 1_000
THRESHOLD = 0.3
BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: First letters (in bytes) that have an embedding of their own, besides the whole word.
STEMS = (4, 5, 6)
#: Embeddings of buckets in fewer training documents than this stay zero.
LEAST_DOCUMENTS = 3
EPOCHS = 4
RATE = 0.08
#: Toxic and clean calibration documents that a language needs for a threshold of its own.
LEAST_CALIBRATION = 5


def features(word: bytes) -> list[int]:
    """Buckets of a word; a stem as long as the word, or longer, repeats the whole word's bucket 0 marker."""
    return [1 + crc32(word) % (BUCKETS - 1), *(1 + crc32(word[:k], k) % (BUCKETS - 1) if len(word) > k else 0 for k in STEMS)]


def word_codes(words: list[bytes]) -> np.ndarray:
    """The buckets of each word, packed in one number."""
    return np.array([features(w) for w in words], np.uint16).reshape(-1, 1 + len(STEMS)).view(np.uint64).ravel()


def code_buckets(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.uint16).reshape(len(codes), 1 + len(STEMS)).astype(np.int64)


@dataclass
class Network:
    embed: np.ndarray  # buckets x DIM, row 0 is zero
    taps: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: np.ndarray  # per filter
    out: np.ndarray  # weight per filter, then the constant

    def word_rows(self, buckets: np.ndarray) -> np.ndarray:
        """Every tap of every filter applied to each word, given by its buckets."""
        vectors = self.embed[buckets].sum(axis=1)
        return np.concatenate([vectors @ tap[k] for tap in self.taps for k in range(len(tap))], axis=1).astype(np.float32)

    def pooled(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest answer of each filter in each text, and at which word it begins (place in rows)."""
        full = np.flatnonzero(counts)
        pool = np.zeros((len(counts), len(WIDTHS) * FILTERS), np.float32)
        where = np.zeros_like(pool, np.int64)
        if not len(full):
            return pool, where
        ends = np.cumsum(counts)
        starts = (ends - counts)[full]
        left = np.repeat(ends, counts) - np.arange(len(rows))
        at = 0
        for j, width in enumerate(WIDTHS):
            z = rows[:, at : at + FILTERS].copy()
            for k in range(1, width):
                more = rows[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
                z[: len(rows) - k] += np.where(left[: len(rows) - k, None] > k, more, 0)
            at += width * FILTERS
            pool[full, j * FILTERS : (j + 1) * FILTERS] = np.maximum.reduceat(z, starts, axis=0)
            if len(full) == 1 and len(counts) == 1:
                where[0, j * FILTERS : (j + 1) * FILTERS] = z.argmax(axis=0)
        return pool, where

    def logits(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        pool, _ = self.pooled(rows, counts)
        hidden = np.where((counts > 0)[:, None], np.maximum(pool + self.bias, 0), 0)
        return hidden @ self.out[:-1] + self.out[-1]


def train(buckets: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Fit by AdaGrad, a document (of places in ``buckets``) at a time; the gradient of a filter flows to the words of its largest answer.

    An embedding starts with the standardised log odds of its bucket in toxic documents as its first coordinate and
    with small random numbers elsewhere; the first filter of each width starts by reading that coordinate.
    """
    draw = np.random.default_rng(seed)
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for doc, y in zip(docs, labels, strict=True):
        (toxic if y else clean)[np.unique(buckets[doc])] += 1
    n1, n0 = max(1, labels.sum()), max(1, (1 - labels).sum())
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    odds /= np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    used = toxic + clean >= LEAST_DOCUMENTS
    used[0] = False
    embed = draw.normal(0, 0.05, (BUCKETS, DIM))
    embed[:, 0] = np.clip(odds, -4, 4) / 4
    embed[~used] = 0
    taps = [draw.normal(0, 0.2, (w, DIM, FILTERS)) for w in WIDTHS]
    for tap in taps:
        tap[:, 0, 0] = 1.0 / len(tap)
    bias, out = np.zeros(len(WIDTHS) * FILTERS), draw.normal(0, 0.1, len(WIDTHS) * FILTERS + 1)
    out[[j * FILTERS for j in range(len(WIDTHS))]] = 1.0
    out[-1] = -2.0
    net = Network(embed, taps, bias, out)
    past = [np.full_like(x, 1e-3) for x in (embed, *taps, bias, out)]

    def step(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        h += g * g
        x -= RATE * g / np.sqrt(h)

    weight = float(np.clip(n0 / n1, 1, 4))
    for _ in range(EPOCHS):
        for d in draw.permutation(len(docs)).tolist():
            doc = docs[d]
            if not len(doc):
                continue
            vectors = embed[buckets[doc]].sum(axis=1)
            rows = np.concatenate([vectors @ tap[k] for tap in taps for k in range(len(tap))], axis=1)
            pool, where = net.pooled(rows, np.array([len(doc)]))
            hidden = np.maximum(pool[0] + bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ out[:-1] + out[-1], -30, 30)))
            error = (p - labels[d]) * (weight if labels[d] else 1.0)
            if abs(error) < 0.01:
                continue
            back = error * out[:-1] * (hidden > 0)
            step(out, error * np.append(hidden, 1.0), past[-1])
            step(bias, back, past[-2])
            touched: dict[int, np.ndarray] = {}
            for j, (width, tap) in enumerate(zip(WIDTHS, taps, strict=True)):
                grad = np.zeros_like(tap)
                for f in range(FILTERS):
                    b = back[j * FILTERS + f]
                    if b:
                        start = int(where[0, j * FILTERS + f])
                        for k in range(min(width, len(doc) - start)):
                            w = int(doc[start + k])
                            grad[k, :, f] += b * vectors[start + k]
                            touched[w] = touched.get(w, 0) + b * tap[k, :, f]
                step(tap, grad, past[1 + j])
            for w, g in touched.items():
                for bucket in buckets[w]:
                    if used[bucket]:
                        step(embed[bucket], g, past[0][bucket])
    return net


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit from which on the F1 of the labels is largest, less 3/4 of the gap to the next lower one.

    Toxic documents are the rarer, so it is their side of the gap that the calibration documents show less of.
    """
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(np.argmax(f1))
    low = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + 3 * low) / 4)


@dataclass
class Toxicity:
    network: Network | None
    languages: Languages
    cuts: np.ndarray  # logit of the threshold, per language and last for none

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        parts = [self.languages.word_rows(words)] if self.languages.names else []
        return np.concatenate([self.network.word_rows(code_buckets(word_codes(words))), *parts], axis=1)

    def scores(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        taps = sum(WIDTHS) * FILTERS
        logits = self.network.logits(rows[:, :taps], counts)
        return 1 / (1 + np.exp(-np.clip(logits - self.cuts[likeliest(rows[:, taps:], counts)] + logit(THRESHOLD), -30, 30)))


def likeliest(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The language of each text (-1: none), from the rows of Languages.word_rows."""
    language = np.full(len(counts), -1)
    full = np.flatnonzero(counts)
    if len(full) and rows.shape[1]:
        language[full] = np.add.reduceat(rows, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.float64).argmax(axis=1)
    return language


def training_rows(texts: DataFrame, languages: Languages) -> DataFrame:
    """texts: key (string), y, text.  The words as codes, the likeliest language, and which rows only calibrate."""
    sent = texts.sparkSession.sparkContext.broadcast(languages)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        codes = WordRows(lambda words: word_codes(words).reshape(-1, 1))
        table = WordRows(known.word_rows) if known.names else None
        for piece, texts in pieces(batches, 2, 1_000_000):
            lists = [letter_words(t) for t in texts]
            flat, counts = codes(lists)
            language = likeliest(table(lists)[0], counts) if table else np.full(len(counts), -1)
            aside = [crc32(f"calibrate {k}".encode()) % 5 == 0 for k in piece.column(0).to_pylist()]
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            words = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat.ravel().view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(language), pa.array(aside), words], names=["key", "y", "language", "aside", "words"])

    return texts.select("key", "y", "text").mapInArrow(encode, "key string, y int, language long, aside boolean, words array<bigint>")


def trained(batches: Iterator[pa.RecordBatch], languages: int) -> Iterator[pa.RecordBatch]:
    """Rows of training_rows, in one task: the network and its thresholds, an array per row; none without both kinds of label."""
    parts = [b for b in batches if b.num_rows]
    rows = pa.Table.from_batches(parts).sort_by("key") if parts else None
    y = (rows["y"].to_numpy() > 0).astype(np.int64) if parts else np.empty(0, np.int64)
    aside = rows["aside"].to_numpy() if parts else np.empty(0, bool)
    if len(set(y[~aside].tolist())) < 2:
        return
    lists = rows["words"].combine_chunks()
    codes, flat = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
    docs = np.split(flat.astype(np.int32), np.cumsum(pa.compute.list_value_length(lists).to_numpy())[:-1])
    buckets, language = code_buckets(codes), rows["language"].to_numpy()
    del rows, lists, flat
    network = train(buckets, [d for d, a in zip(docs, aside, strict=True) if not a], y[~aside])
    cuts, kept = np.full(languages + 1, logit(THRESHOLD)), np.flatnonzero(aside)
    if len(set(y[kept].tolist())) == 2:
        logits = np.concatenate([network.logits(network.word_rows(buckets[docs[k]]), np.array([len(docs[k])])) for k in kept])
        cuts[:] = best_cut(logits, y[kept])
        for k in range(languages):
            own = language[kept] == k
            if min(y[kept][own].sum(), (1 - y[kept][own]).sum()) >= LEAST_CALIBRATION:
                cuts[k] = best_cut(logits[own], y[kept][own])
    for name, array in (("embed", network.embed), *((f"tap{k}", t) for k, t in enumerate(network.taps)), ("bias", network.bias), ("out", network.out), ("cuts", cuts)):
        yield pa.RecordBatch.from_pydict({"name": [name], "shape": [list(array.shape)], "data": [array.astype(np.float64).tobytes()]})


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = FIT_DOCUMENTS
) -> Toxicity:
    """Train on about ``most`` of the labelled documents, a fifth of them for calibration only.

    A document that several rows of labels name is toxic if one of them says so; null labels are left out, and so are
    documents of more than FIT_LONGEST words.  Null, empty and wordless texts take part as texts of no words.  Rows that
    repeat an identifier all take part.  Without both toxic and clean documents (as with an empty table) there is no
    network, and every score is 0; with both, at least one of each is learnt from, or the fit is refused with an error.  Only the named columns are read, whatever else the tables hold.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("of"), F.col(label_col).alias("label")).groupBy("of").agg(F.max("label").cast("int").alias("y"))
    known = sampled(known, "of", most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(known), F.col("id") == F.col("of")).select(F.col("id").cast("string").alias("key"), "y", "text")  # a bounded sample
    rows = written(training_rows(texts, languages).where(F.size("words") <= FIT_LONGEST), "toxicity-sample")
    share = F.pmod(F.xxhash64("key", F.lit("share")), F.lit(SHARES))
    sizes = dict(rows.groupBy(share.alias("share")).agg(F.sum(F.size("words"))).collect())  # SHARES rows at most
    kinds = rows.where(~F.col("aside")).groupBy((F.col("y") > 0).alias("toxic")).agg(F.min(share).alias("first")).collect()
    fits = max((r["first"] + 1 for r in kinds), default=0) if len(kinds) == 2 else 0  # documents of both labels, whatever their length
    total = sum(n for k, n in sizes.items() if k < fits)
    while fits < SHARES and total + sizes.get(fits, 0) <= FIT_WORDS:
        total += sizes.get(fits, 0)
        fits += 1
    n_languages = len(languages.names)
    weights = rows.where(share < fits).repartition(1).mapInArrow(lambda batches: trained(batches, n_languages), "name string, shape array<bigint>, data binary").collect()
    arrays = {r.name: np.frombuffer(bytes(r.data)).reshape(r.shape) for r in weights}
    if not arrays and texts.select("y").where("y IS NOT NULL").distinct().count() == 2:
        raise ValueError(f"no network can be fitted: there is no document of each label of at most {FIT_LONGEST} words that is not set aside")
    if not arrays:
        return Toxicity(None, languages, np.full(len(languages.names) + 1, logit(THRESHOLD)))
    network = Network(arrays["embed"].astype(np.float32), [arrays[f"tap{k}"].astype(np.float32) for k in range(len(WIDTHS))], arrays["bias"], arrays["out"])
    return Toxicity(network, languages, arrays["cuts"])


def toxicity_scores(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, score (0 to 1), predicted (1 from a score of 0.3 on).

    Whole texts are scored.  Null, empty and wordless texts get what the network gives for no words.  Rows that repeat
    a text get equal scores.  An empty table gives an empty result; only the text is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        table = WordRows(known.word_rows) if known.network else None
        for piece, texts in pieces(batches, 1, 1_000_000):
            scores = known.scores(*table([letter_words(t) for t in texts])) if table else np.zeros(len(texts))
            yield pa.RecordBatch.from_pydict({"id": piece.column(0), "score": scores.astype(np.float64), "predicted": (scores >= THRESHOLD).astype(np.int32)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(score, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; nothing is joined or shuffled.

    Null, empty and wordless texts get what the network gives for no words.  Each row is judged by its whole text alone, so
    repeated rows stay or go together, however long they are.  Without a network, and on an empty table, all rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make_judge():
        known = sent.value
        table = WordRows(known.word_rows) if known.network else None
        return lambda texts: known.scores(*table([letter_words(t) for t in texts])) < THRESHOLD if table else np.ones(len(texts), bool)

    return kept_rows(docs, text_col, make_judge)
