"""Texts of an Arrow batch, a bounded number of characters at a time, and what is known of each of their words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Characters that a task handles at once; one longer text makes a piece of its own.
PIECE_CHARS = 1_000_000
#: Entries of a word cache before it is emptied.
CACHE = 400_000


def pieces(batches: Iterator[pa.RecordBatch], text_at: int, most: int = PIECE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with their texts as a list; None stays None."""
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        start = size = 0
        for k, text in enumerate(texts):
            n = len(text) if text else 0
            if k > start and size + n > most:
                yield batch.slice(start, k - start), texts[start:k]
                start, size = k, 0
            size += n
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def kept_rows(docs: DataFrame, text_col: str, make_judge: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, whole, for whose text the judge (made once in each task) says True.

    A null text is judged as None.  Repeated rows are judged alike; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make_judge()
        for piece, texts in pieces(batches, at, 1_000_000):
            yield piece.filter(pa.array(judge(texts), pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


class WordHashes(dict):
    """XXH64 of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of a public multiply-xorshift mixer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hash of the k words from each start on (None: from every place where k words remain)."""
    base = np.uint64(0x9E3779B97F4A7C15)
    if starts is None:
        n = len(words) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = words[:n].copy()
        for j in range(1, k):
            out = out * base + words[j : n + j]
    else:
        out = words[starts]
        for j in range(1, k):
            out = out * base + words[starts + j]
    return mix64(out + np.uint64(k))


#: For bytes of lower-cased text: letters a-z and all bytes from 0x80 on stay, other ASCII becomes a space.
LETTER_BYTES = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters (anything beyond ASCII counts as a letter), in UTF-8."""
    return text.lower().encode().translate(LETTER_BYTES).split() if text else []


class WordRows:
    """A row of numbers for each word, computed once per distinct word of a worker.

    compute: gives the rows of a list of words.  When the table is full, what is frequent was met early and stays; the
    new words of a piece are dropped after it.
    """

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], most: int = CACHE) -> None:
        self.compute, self.most = compute, most
        self.place: dict[bytes, int] = {}
        self.rows = compute([b"a"])[:0]
        self.known = 0

    def __call__(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words of the lists one after another, and how many words each list has."""
        words = [w for x in lists for w in x]
        new = list(set(words).difference(self.place))
        before = self.known
        if new:
            self.known += len(new)
            if self.known > len(self.rows):
                grown = np.empty((max(2 * len(self.rows), self.known), self.rows.shape[1]), self.rows.dtype)
                grown[:before] = self.rows[:before]
                self.rows = grown
            self.rows[before : self.known] = self.compute(new)
            self.place.update(zip(new, range(before, self.known), strict=True))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        out = self.rows[at]
        if self.known > self.most:
            for w in new:
                del self.place[w]
            self.known = before
        return out, np.fromiter(map(len, lists), np.int64, len(lists))
