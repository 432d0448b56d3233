"""Benchmark decontamination by winnowing: fingerprints of documents and benchmark meet in a join.

Of every 10 words in a row, the smallest hash of the 5 words from each place on is the fingerprint.  Any 10 words that a
document and a benchmark item share have the same one.  Fingerprints that meet are extended: the whole window is compared,
word for word.  Items of fewer than 10 words are one window of their own length, which is its own fingerprint.

What only thins out the rows of the join is a filter of bits that every task holds: a window of a document goes on only
if its fingerprint and its own hash may be in the benchmark.  Its size follows the benchmark up to ``MOST_BITS``; a
fuller filter lets more rows through and changes no result.  Documents are read in one pass whatever the size of the
benchmark, and neither their texts nor the benchmark travel: rows of the join are windows.  Spark sends the benchmark's
windows to all tasks if they turn out smaller than spark.sql.autoBroadcastJoinThreshold, and otherwise deals both sides
out by fingerprint and window, where it splits the rows of a frequent window over tasks (spark.sql.adaptive.skewJoin).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import not_matching, written
from .words import WordHashes, gram_hashes, pieces

WINDOW = 10
GRAM = 5
#: Bits of the filter for each window of the benchmark, and of the whole filter at least and at most (64 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 29
#: Bits in one row of Spark's bitmap aggregates.
BUCKET = 32_768
#: Windows of an item in one Arrow batch.
BATCH = 20_000

#: Lower-cases A-Z; digits, a-z and all bytes from 0x80 on are word bytes, the rest becomes a space.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))

FOUND = pa.list_(pa.struct([("print", pa.int64()), ("window", pa.string()), ("length", pa.int32()), ("starts", pa.list_(pa.int64()))]))


def item_words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def fingerprints(words: np.ndarray) -> np.ndarray:
    """The smallest gram hash of the window from each place on."""
    grams = gram_hashes(words, GRAM)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    low = grams[:n]
    for j in range(1, WINDOW - GRAM + 1):
        low = np.minimum(low, grams[j : n + j])
    return low


def text_of(words: list[bytes]) -> str:
    """A window as the join compares it; words hold no spaces."""
    return b" ".join(words).decode()


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """All windows of all items: item (as a string), length, print, whole (hash of the window), window (its words)."""
    types = pa.schema([("item", pa.string()), ("length", pa.int32()), ("print", pa.int64()), ("whole", pa.int64()), ("window", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for piece, texts in pieces(batches, 1):
            for item, text in zip(piece.column(0).to_pylist(), texts, strict=True):
                words = item_words(text)
                if not words:
                    continue
                values, length = hashes.of(words), min(WINDOW, len(words))
                whole = gram_hashes(values, length)
                prints = fingerprints(values) if length == WINDOW else whole
                for a in range(0, len(whole), BATCH):
                    n = min(BATCH, len(whole) - a)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([item] * n, pa.string()),
                            pa.array([length] * n, pa.int32()),
                            pa.array(prints[a : a + n].view(np.int64)),
                            pa.array(whole[a : a + n].view(np.int64)),
                            pa.array([text_of(words[k : k + length]) for k in range(a, a + n)], pa.string()),
                        ],
                        schema=types,
                    )

    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    return items.mapInArrow(cut, "item string, length int, print long, whole long, window string")


def bit_filter(windows: DataFrame, most_bits: int) -> np.ndarray:
    """Bits, packed into bytes, at the places of all fingerprints and windows.  Spark sets them; what is collected is the filter alone."""
    wanted = max(LEAST_BITS, BITS_EACH * windows.count())
    bits = min(most_bits, 1 << (wanted - 1).bit_length())
    place = windows.select(F.explode(F.array("print", "whole")).alias("hash")).select((F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1).alias("place"))
    rows = place.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(max(bits, BUCKET) // 8, np.uint8)
    for r in rows.toLocalIterator():
        begin = (r.bucket - 1) * BUCKET // 8
        out[begin : begin + BUCKET // 8] = np.frombuffer(r.bits, np.uint8)
    return out[: max(bits // 8, 1)]


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def probe(texts: list[str | None], bits: np.ndarray, lengths: list[int], hashes: WordHashes) -> list[tuple[int, list[dict]]]:
    """Of each text: the number of its words, and its windows that may be in the benchmark, each once with all its places."""
    lists = [item_words(t) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    words = [w for x in lists for w in x]
    ends = np.cumsum(counts)
    values = hashes.of(words)
    left = np.repeat(ends, counts) - np.arange(len(words))  # words from here to the end of the text
    found: list[dict[str, dict]] = [{} for _ in texts]
    for length in lengths:
        if length == WINDOW:
            low = fingerprints(values)
            begins = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.empty(0, np.int64)
            met = np.repeat(may_hold(bits, low[begins]), np.diff(np.append(begins, len(low))))  # neighbours share fingerprints
            starts = np.flatnonzero(met)
            starts = starts[left[starts] >= length]
            prints, whole = low[starts], gram_hashes(values, length, starts)
        else:
            starts = np.flatnonzero(left >= length)
            prints = whole = gram_hashes(values, length, starts)
        yes = may_hold(bits, whole)
        docs = np.searchsorted(ends, starts[yes], side="right")
        for k, start, value in zip(docs.tolist(), starts[yes].tolist(), prints[yes].view(np.int64).tolist(), strict=True):
            window = text_of(words[start : start + length])
            new = {"print": value, "window": window, "length": length, "starts": []}
            found[k].setdefault(window, new)["starts"].append(start - int(ends[k] - counts[k]))
    return [(n, list(f.values())) for n, f in zip(counts.tolist(), found, strict=True)]


def probed(rows: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """rows (id, text, row) without their texts: id, row, n_words, found."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for piece, texts in pieces(batches, 1, 1_000_000):
            got = probe(texts, sent.value, lengths, hashes)
            columns = {"id": piece.column(0), "row": piece.column(2), "n_words": pa.array([n for n, _ in got], pa.int64()), "found": pa.array([f for _, f in got], FOUND)}
            yield pa.RecordBatch.from_pydict(columns)

    spec = "found array<struct<print:long,window:string,length:int,starts:array<long>>>"
    return rows.select("id", "text", "row").mapInArrow(search, f"id {rows.schema['id'].dataType.simpleString()}, row long, n_words long, {spec}")


def indexed(benchmark: DataFrame, item_col: str, text_col: str, most_bits: int) -> tuple[DataFrame, np.ndarray, list[int]]:
    """The benchmark's windows as a table, their filter, and the lengths that occur (10 at most)."""
    windows = written(benchmark_windows(benchmark, item_col, text_col), "benchmark-windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())
    return windows, bit_filter(windows, most_bits), lengths


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_hit (words inside windows), items (ids as strings, sorted), spans.

    spans: merged [start, end) of word places.  Null and empty texts have no words, on either side; a null item id is
    the item "null"; items that repeat an id count once.  Texts are searched whole, very long ones too; rows that repeat
    an id or a text are rows of their own.  An empty benchmark hits nothing; empty documents give an empty result.  Other
    columns are not read, whatever their names.  most_bits: a power of two, from 8 on.
    """
    windows, bits, lengths = indexed(benchmark, item_col, item_text_col, most_bits)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    seen = written(probed(rows, bits, lengths), "decontaminate")  # rows have their numbers for good
    holders = windows.groupBy("print", "window").agg(F.collect_set("item").alias("items"))
    met = seen.select("row", F.explode("found").alias("f")).select("row", "f.*").join(holders, ["print", "window"])
    return seen.join(merged(met), "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:long,end:long>>)")).alias("spans"),
    )


def merged(met: DataFrame) -> DataFrame:
    """Windows met (row, length, starts, items) by row: n_hit, items, spans.  One exchange by row serves all three steps."""
    at = met.select("row", "length", "items", F.posexplode("starts").alias("nth", "start"))
    at = at.select("row", "start", (F.col("start") + F.col("length")).alias("end"), F.when(F.col("nth") == 0, F.col("items")).alias("items"))
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("begins", (reach.isNull() | (F.col("start") > reach)).cast("long"))
    at = at.withColumn("span", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = at.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return spans.groupBy("row").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with all their columns, whatever their names.

    Equal texts stay or go together, known by SHA-256, so rows need no identifiers; null and empty texts stay.  An empty
    benchmark takes nothing away; an empty table stays empty.
    """
    windows, bits, lengths = indexed(benchmark, item_col, item_text_col, most_bits)
    digest = F.sha2(F.encode(docs[text_col], "UTF-8"), 256)
    rows = docs.select(digest.alias("id"), docs[text_col].alias("text"), F.lit(0).cast("long").alias("row"))
    seen = probed(rows, bits, lengths).select("id", F.explode("found").alias("f"))
    known = windows.select("print", "window").distinct()
    hit = seen.select("id", F.col("f.print").alias("print"), F.col("f.window").alias("window")).join(known, ["print", "window"]).select("id").distinct()
    hit = written(hit, "decontaminate")
    return not_matching(docs, F.sha2(F.encode(F.col(text_col), "UTF-8"), 256), hit)
