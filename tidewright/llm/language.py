"""Language identification by multilingual mixture inference.

A language is a chain of letters: the probability of a byte after the two before it, from counts of byte trigrams
within words.  A document is a mixture of languages: each of its words is of one of them.  Expectation-maximisation
estimates the proportions from the words' n-gram likelihoods, and the set of languages is the one with the highest
likelihood less a penalty for each language in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import WordRows, letter_words, pieces

#: Documents that the n-gram counts are fitted on at most, on average; drawn by a hash of the identifier.
FIT_DOCUMENTS = 30_000
#: Buckets of the trigram counts.
BUCKETS = 1 << 17
#: Added to each count.
SMOOTH = 0.05
ROUNDS = 15
#: What a further language must add to the log-likelihood, in units of the logarithm of the number of words.
PENALTY = 3.0

LETTER = re.compile(r"[^\W\d_]")


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' bytes between spaces: bucket of each trigram, its first two bytes, and the word it is in."""
    text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    pair, code = text[:-2] | text[1:-1] << 8, text[:-2] | text[1:-1] << 8 | text[2:] << 16
    inside = text[1:-1] != 32  # the middle byte is in a word, so the trigram is of that word
    word = np.cumsum(~inside)[inside]
    return ((code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(15)).astype(np.int64), pair[inside].astype(np.int64), word


@dataclass
class Languages:
    names: list[str]
    #: log P(third byte | first two) by bucket of the trigram, less what stands for the pair: two tables, a row per language
    gram: np.ndarray
    pair: np.ndarray

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        """log P(word | language), a row per word."""
        bucket, pair, word = trigrams(words)
        out = np.zeros((len(words), len(self.names)), np.float32)
        for k in range(len(self.names)):
            out[:, k] = np.bincount(word, self.gram[k][bucket] - self.pair[k][pair], len(words))
        return out

    def mixtures(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Proportions of the languages in each text, a row per text; rows: as of word_rows, text after text."""
        out = np.zeros((len(counts), len(self.names)))
        full = np.flatnonzero(counts)
        if not len(full) or not len(self.names):
            return out
        counts = counts[full]
        top = rows.max(axis=1)
        likely = np.exp(rows - top[:, None])
        alone = np.add.reduceat(rows, _starts(counts), axis=0, dtype=np.float64)
        best = alone.argmax(axis=1)
        weights = np.zeros((len(full), len(self.names)))
        weights[np.arange(len(full)), best] = 1
        if len(self.names) > 1:
            everything, free = self._fit(likely, top, counts, np.ones_like(weights, bool))
            price = PENALTY * np.log(counts + 1.0)
            mixed = np.flatnonzero(free - alone.max(axis=1) > price)  # others are best alone, whatever set they are given
            if len(mixed):
                weights[mixed] = self._choose(likely, top, counts, mixed, everything, alone, price)
        out[full] = weights
        return out

    def _choose(self, likely, top, counts, mixed, everything, alone, price) -> np.ndarray:
        """For the texts numbered in mixed: languages are let in by falling proportion while that pays."""
        ends = np.cumsum(counts)
        words = np.concatenate([np.arange(ends[d] - counts[d], ends[d]) for d in mixed])
        likely, top, counts, price = likely[words], top[words], counts[mixed], price[mixed]
        rank = (-everything[mixed]).argsort(axis=1).argsort(axis=1)
        best_value = alone[mixed].max(axis=1) - price
        best = np.zeros_like(everything[mixed])
        best[np.arange(len(mixed)), alone[mixed].argmax(axis=1)] = 1
        for size in range(2, len(self.names) + 1):
            weights, value = self._fit(likely, top, counts, rank < size)
            better = value - size * price > best_value
            best[better], best_value = weights[better], np.where(better, value - size * price, best_value)
        return best

    @staticmethod
    def _fit(likely, top, counts, allowed) -> tuple[np.ndarray, np.ndarray]:
        """EM over all texts at once: proportions, and log-likelihood, with the languages allowed for each text."""
        doc, starts = np.repeat(np.arange(len(counts)), counts), _starts(counts)
        theta = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
        for _ in range(ROUNDS):
            joint = likely * theta[doc]
            joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
            theta = (np.add.reduceat(joint, starts, axis=0, dtype=np.float64) / counts[:, None]).astype(np.float32)
        total = np.log(np.maximum((likely * theta[doc]).sum(axis=1), 1e-30)) + top
        return theta.astype(np.float64), np.add.reduceat(total, starts, dtype=np.float64)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def held_out(id_col: Column) -> Column:
    """Documents kept from fitting: the checksum of the identifier as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """About ``most`` rows, drawn by a hash of the identifier; all of them if there are no more."""
    share = min(1.0, most / max(1, rows.count()))
    return rows if share == 1.0 else rows.where(F.pmod(F.xxhash64(id_col, F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = FIT_DOCUMENTS) -> Languages:
    """Count trigrams of the rows with a text and a language, on about ``most`` of them."""
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = sampled(usable, "id", most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for piece, texts in pieces(batches, 0):
            langs = piece.column(1).to_pylist()
            for lang in set(langs):
                words = [w for t, k in zip(texts, langs, strict=True) if k == lang for w in letter_words(t)]
                if lang not in sums:
                    sums[lang] = (np.zeros(BUCKETS, np.int64), np.zeros(1 << 16, np.int64))
                if words:
                    bucket, pair, _ = trigrams(words)
                    sums[lang][0][:] += np.bincount(bucket, minlength=BUCKETS)
                    sums[lang][1][:] += np.bincount(pair, minlength=1 << 16)
        for lang, tables in sums.items():
            for order, table in enumerate(tables):
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "order": np.full(len(at), order), "bucket": at, "n": table[at]})

    counts = usable.select("text", "lang").mapInArrow(count, "lang string, order long, bucket long, n long")
    table: pd.DataFrame = counts.groupBy("lang", "order", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    names = sorted(table["lang"].unique())
    gram, pair = np.zeros((len(names), BUCKETS)), np.zeros((len(names), 1 << 16))
    for k, name in enumerate(names):
        for order, into in enumerate((gram, pair)):
            part = table[(table["lang"] == name) & (table["order"] == order)]
            into[k, part["bucket"].to_numpy()] = part["n"].to_numpy()
    return Languages(names, np.log(gram + SMOOTH).astype(np.float32), np.log(pair + SMOOTH * 256).astype(np.float32))


def language_mixtures(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, lang_pred, score (its proportion), langs and shares (all languages found, by falling share).

    A text that is null or without a letter is ``und`` with score 0, and so is everything if no language was fitted.
    Every word of a text counts, however long the text; ties go to the name that sorts first.  Repeated rows get equal
    answers.  Only the text is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        table = WordRows(known.word_rows) if known.names else None
        for piece, texts in pieces(batches, 1):
            shares = known.mixtures(*table([letter_words(t) for t in texts])) if table else np.zeros((len(texts), 0))
            preds, scores, langs, parts = [], [], [], []
            for text, row in zip(texts, shares, strict=True):
                order = [k for k in np.argsort(-row, kind="stable").tolist() if row[k] > 1e-4]
                if not order or not LETTER.search(text):
                    order = []
                preds.append(known.names[order[0]] if order else "und")
                scores.append(min(1.0, float(row[order[0]])) if order else 0.0)
                langs.append([known.names[k] for k in order])
                parts.append([float(row[k]) for k in order])
            yield pa.RecordBatch.from_pydict(
                {
                    "id": piece.column(0),
                    "lang_pred": pa.array(preds, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                    "langs": pa.array(langs, pa.list_(pa.string())),
                    "shares": pa.array(parts, pa.list_(pa.float64())),
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, text_col).mapInArrow(infer, f"id {kind}, lang_pred string, score double, langs array<string>, shares array<double>")
    return found.withColumnRenamed("id", id_col)
