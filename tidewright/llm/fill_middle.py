"""Fill-in-the-middle over an index of distinct texts.

Documents are dealt out by a hash of their text and sorted by it, so that equal texts lie side by side.  In each run of
equal hashes texts are told apart by full comparison; a distinct text gets one index -- the boundaries of its lines as an
Elias-Fano list, and whether it holds a sentinel -- and every document of the run is joined to the index of its text and
selects its two seeded boundaries there.  Texts travel once.  A text with so many copies that they would fill a
noticeable part of a partition is dealt over several by its identifiers, and is indexed once in each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_partitions
from .words import pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text is hot if its copies make more than 1 / SHARES of an even partition; there are at most SHARES of them per partition.
SHARES = 4
#: One in so many ones of an Elias-Fano list has its place noted.
SAMPLE = 64


class EliasFano:
    """A list of ascending whole numbers in about 2 + log2(largest / count) bits each, with the k-th number at hand."""

    def __init__(self, values: np.ndarray) -> None:
        values = np.asarray(values, np.int64)
        self.count = len(values)
        spread = int(values[-1]) // max(1, self.count) if self.count else 0
        self.low_bits = max(0, spread.bit_length() - 1)
        shifts = np.arange(self.low_bits)
        self.low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel())
        ones = (values >> self.low_bits) + np.arange(self.count)
        high = np.zeros(int(ones[-1]) + 1 if self.count else 0, np.uint8)
        high[ones] = 1
        self.high = np.packbits(high)
        self.samples = ones[::SAMPLE].copy()

    def __len__(self) -> int:
        return self.count

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes

    def __getitem__(self, k: int) -> int:
        """Number k: its high part is the place of the k-th one, its low part is stored."""
        if not 0 <= k < self.count:
            raise IndexError(k)
        first, ahead = int(self.samples[k // SAMPLE]), k % SAMPLE
        byte, size = first // 8, 16
        while True:  # from the noted one on, until so many ones are seen
            bits = np.unpackbits(self.high[byte : byte + size])
            ones = np.flatnonzero(bits[first - 8 * byte :])
            if len(ones) > ahead:
                break
            size *= 2
        high = first + int(ones[ahead]) - k
        if not self.low_bits:
            return high
        at = k * self.low_bits
        stored = np.unpackbits(self.low[at // 8 : -(-(at + self.low_bits) // 8)])[at % 8 :][: self.low_bits]
        return (high << self.low_bits) | int(stored.astype(np.int64) @ (1 << np.arange(self.low_bits)))


class TextIndex:
    """What all documents of one text share: the boundaries of its lines, 0 and its end among them, and whether it has to stay plain."""

    def __init__(self, text: str) -> None:
        self.text = text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(points == 10) + 1
        if len(text) and not text.endswith("\n"):
            ends = np.append(ends, len(text))
        self.bounds = EliasFano(np.concatenate([[0], ends]))
        self.lines = len(self.bounds) - 1
        self.plain = not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE))

    def cut(self, draws: list[int], rate: int, spm: int) -> tuple[str, int | None, int | None, str]:
        """form, code points of the prefix and of the middle, and the output, for four drawn numbers."""
        if self.plain or draws[2] % 100 >= rate:
            return "plain", None, None, self.text
        i, j = sorted((draws[0] % (self.lines + 1), draws[1] % (self.lines + 1)))
        a, b = self.bounds[i], self.bounds[j]
        prefix, middle, suffix = self.text[:a], self.text[a:b], self.text[b:]
        if draws[3] % 100 < spm:
            return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def together(docs: DataFrame) -> DataFrame:
    """docs (id, text) with key: rows of equal texts side by side in a partition, hot texts dealt over several."""
    parts = shuffle_partitions(docs.sparkSession)
    keyed = docs.withColumn("key", F.xxhash64("text"))
    least = max(1, docs.count() // (SHARES * parts))
    hot = keyed.groupBy("key").agg(F.count("*").alias("copies")).where(F.col("copies") > least)  # SHARES * parts rows at most
    salt = F.when(F.col("copies").isNotNull(), F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(parts))).otherwise(0)
    dealt = keyed.join(F.broadcast(hot), "key", "left").select("id", "text", "key", salt.alias("salt"))
    return dealt.repartition("key", "salt").sortWithinPartitions("key").select("id", "text", "key")


def filled_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per row of ``docs``: id_col, n (lines), form, prefix_chars, middle_chars, output.

    Four numbers are drawn by the SHA-256 of "seed:identifier"; the first two choose the boundaries between which the
    middle lies, the third whether a text is transformed (rate in 100), the fourth its form (spm in 100, else psm).  Texts
    that are null, empty or hold a sentinel stay plain, and so do those that are not drawn; null counts are theirs.  Texts
    of any length are handled whole.  Repeated identifiers are cut alike where their texts are; a null identifier counts
    as empty text.  An empty table gives an empty result; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    drawn = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 32)
    run = together(rows).select("id", "text", "key", drawn.alias("drawn"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, indexes = None, []  # the texts of one hash: one, but for texts that share it by chance
        for piece, texts in pieces(batches, 1):
            lines, cuts = [], []
            for text, own, draws in zip(texts, piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True):
                if own != key:
                    key, indexes = own, []
                index = next((x for x in indexes if x.text == text), None)
                if index is None:
                    index = TextIndex(text)
                    indexes.append(index)
                lines.append(index.lines)
                cuts.append(index.cut([int(draws[k : k + 8], 16) for k in range(0, 32, 8)], rate, spm))
            form, prefix, middle, output = zip(*cuts, strict=True)
            columns = [piece.column(0), pa.array(lines, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    return run.mapInArrow(transform, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that filled_in_middle made an output of: the parts between its sentinels in their old order."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
