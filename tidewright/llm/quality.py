"""Quality by a generalised additive model with pairwise interactions.

A text becomes a row of plain measures (shares of upper case, symbols, repeated words and lines, and so on).  Each
measure is cut into bins at quantiles, and shallow trees, boosted feature by feature in turn, add to one lookup table per
measure; then the pairs of measures that explain most of what is left get a table each in the same way.  The score of a
text is the sum of its table entries, looked up for all texts of a batch at once.

The model is fitted in one task on a bounded, documented sample of labelled documents; the driver sees tables only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, islice
from math import log, log1p
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import sampled
from .words import pieces

#: Labelled documents that the model is fitted on at most, on average; drawn by a hash of the identifier.
FIT_DOCUMENTS = 20_000
BINS = 32
#: Bins of each side of a pair.
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.1
#: Splits of a tree over one measure.
SPLITS = 2
#: Added to the weight of a leaf, which shrinks what few documents say.
RIDGE = 2.0
#: Documents of a leaf at least, in units of p (1 - p).
LEAST = 1.0
#: Rounds without a lower loss on the documents set aside after which boosting ends.
PATIENCE = 10
THRESHOLD = 0.5

#: Byte classes, as places of one table: the first bytes of characters beyond ASCII are letters too.
UPPER, LOWER, DIGIT, SPACE, END, COMMA, SYMBOL, WIDE, REST = range(9)
CLASS_OF = np.full(256, SYMBOL)
CLASS_OF[65:91], CLASS_OF[97:123], CLASS_OF[48:58], CLASS_OF[0:33], CLASS_OF[0x80:0xC0], CLASS_OF[0xC0:] = UPPER, LOWER, DIGIT, SPACE, REST, WIDE
CLASS_OF[[ord(c) for c in ".!?"]], CLASS_OF[[ord(c) for c in ",;:"]] = END, COMMA
SYMBOLS = CLASS_OF == SYMBOL

MEASURES = (
    *("chars", "words", "word_chars", "word_spread", "longest_word", "upper", "digits", "blank", "ends", "commas", "symbols", "top_symbol", "wide"),
    *("distinct", "top_word", "same_again", "marked_words", "lines", "line_chars", "distinct_lines", "repeated_chars", "byte_entropy", "loud_lines"),
)


def measures(text: str | None) -> tuple[float, ...]:
    """The measures of a whole text, in the order of MEASURES; all 0 for a null or empty one."""
    if not text:
        return (0.0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(CLASS_OF, weights=counts, minlength=9)
    chars = kinds.sum() - kinds[REST]
    letters = kinds[UPPER] + kinds[LOWER] + kinds[WIDE]
    inked = max(1.0, chars - kinds[SPACE])
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    tally = Counter(words)
    again = sum(map(eq, words, islice(words, 1, None)))
    marked = sum(k for w, k in tally.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?)")
    lines = [x for x in text.split("\n") if x and not x.isspace()] or [""]
    kept = Counter(lines)
    held = sum(map(len, lines)) or 1
    doubled = sum(len(x) * (k - 1) for x, k in kept.items())
    loud = sum(len(x) * k for x, k in kept.items() if x.isupper())
    share = counts[counts > 0] / len(raw)
    return (
        *(log1p(chars), log1p(len(words)), inked / n, float(lengths.std()) if len(words) else 0.0, log1p(int(lengths.max(initial=0)))),
        *(kinds[UPPER] / max(1.0, letters), kinds[DIGIT] / inked, kinds[SPACE] / chars, kinds[END] / n, kinds[COMMA] / n),
        *(kinds[SYMBOL] / inked, counts[SYMBOLS].max() / inked, kinds[WIDE] / inked),
        *(log(len(tally) + 1) / log(n + 1), max(tally.values(), default=0) / n, again / n, marked / n),
        *(log1p(len(lines)), held / len(lines), len(kept) / len(lines), doubled / held, float(-(share * np.log2(share)).sum()), loud / held),
    )


@dataclass
class Additive:
    """A constant, a table for each measure, and a table for each chosen pair of measures; all in log odds."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)  # per measure: ascending cuts between bins
    tables: list[np.ndarray] = field(default_factory=list)  # per measure: one number per bin
    coarse: list[np.ndarray] = field(default_factory=list)  # per measure: the pair bin of each bin
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        if self.edges and len(rows):
            bins = self.bins(rows)
            for k, table in enumerate(self.tables):
                out += table[bins[:, k]]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                out += table[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))


def cuts_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts of a measure at its quantiles; equal values never part."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(x) else np.empty(0)


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of neighbouring bins in two, and the first bin of its right part (0: none)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[(left_h < LEAST) | (right_h < LEAST)] = 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1 if gain[k] > 0 else 0


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What a tree of at most SPLITS cuts over one measure's bins gives each bin, from sums of gradients and weights."""
    parts = [(0, len(g))]
    for _ in range(SPLITS):
        gains = [best_split(g[a:b], h[a:b]) for a, b in parts]
        k = max(range(len(parts)), key=lambda j: gains[j][0])
        if not gains[k][1]:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + gains[k][1]), (a + gains[k][1], b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree over a pair's bins: a cut of one measure, and one of the other in each half."""
    best, values = -1.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        whole = gg.sum() ** 2 / (hh.sum() + RIDGE)
        for cut in range(1, len(gg)):
            gain, out = -whole, np.empty_like(gg)
            for a, b in ((0, cut), (cut, len(gg))):
                side_g, side_h = gg[a:b].sum(axis=0), hh[a:b].sum(axis=0)
                k = best_split(side_g, side_h)[1] or len(side_g)
                for c, d in ((0, k), (k, len(side_g))):
                    if c < d:
                        sg, sh = side_g[c:d].sum(), side_h[c:d].sum()
                        gain += sg**2 / (sh + RIDGE)
                        out[a:b, c:d] = sg / (sh + RIDGE)
            if gain > best:
                best, values = gain, out.T if turned else out
    return best, values


def sums(at: np.ndarray, by: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    return np.bincount(at, weights=by, minlength=int(np.prod(shape))).reshape(shape)


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -logits, logits)).mean()) if len(y) else 0.0


def boosted(cells: list[np.ndarray], shapes: list[tuple[int, ...]], tables: list[np.ndarray], tree, logits: np.ndarray, y: np.ndarray, aside: np.ndarray, rounds: int) -> list[np.ndarray]:
    """Boost the tables in turn, a tree each a round, and keep the round that is best on the documents set aside.

    cells: the cell of each document in each table.  logits goes on from what is there, and is left as the kept tables give it.
    """
    fit, start = ~aside, logits.copy()
    best, kept, since = loss(logits[aside], y[aside]), [t.copy() for t in tables], 0
    for _ in range(rounds):
        for cell, shape, table in zip(cells, shapes, tables, strict=True):
            p = 1 / (1 + np.exp(-np.clip(logits[fit], -30, 30)))
            values = RATE * tree(sums(cell[fit], y[fit] - p, shape), sums(cell[fit], p * (1 - p), shape))
            table += values
            logits += values.ravel()[cell]
        now = loss(logits[aside], y[aside])
        since = 0 if now < best or not aside.any() else since + 1
        if not since:
            best, kept = now, [t.copy() for t in tables]
        if since >= PATIENCE:
            break
    logits[:] = start + sum(t.ravel()[cell] for t, cell in zip(kept, cells, strict=True))
    return kept


def fitted(rows: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Additive:
    """The model of labelled rows of measures; without both labels among those it may learn from, only the share of 1."""
    fit = ~aside
    ones = float(y[fit].sum())
    model = Additive(log((ones + 0.5) / (fit.sum() - ones + 0.5)))
    if not 0 < ones < fit.sum():
        return model
    model.edges = [cuts_of(rows[fit, k], BINS) for k in range(rows.shape[1])]
    bins = model.bins(rows)
    sizes = [len(e) + 1 for e in model.edges]
    logits = np.full(len(y), model.base)
    tables = [np.zeros(n) for n in sizes]
    model.tables = boosted(list(bins.T), [(n,) for n in sizes], tables, shallow_tree, logits, y, aside, ROUNDS)
    model.coarse = [np.arange(n) * min(PAIR_BINS, n) // n for n in sizes]
    wide = [int(c[-1]) + 1 for c in model.coarse]
    places = [c[bins[:, k]] for k, c in enumerate(model.coarse)]
    p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def left(pair: tuple[int, int]) -> float:
        a, b = pair
        cell, shape = places[a] * wide[b] + places[b], (wide[a], wide[b])
        return pair_tree(sums(cell[fit], (y - p)[fit], shape), sums(cell[fit], (p * (1 - p))[fit], shape))[0]

    usable = [k for k, n in enumerate(wide) if n > 1]
    model.pairs = sorted(combinations(usable, 2), key=lambda pair: (-left(pair), pair))[:PAIRS]
    cells = [places[a] * wide[b] + places[b] for a, b in model.pairs]
    shapes = [(wide[a], wide[b]) for a, b in model.pairs]
    model.pair_tables = boosted(cells, shapes, [np.zeros(s) for s in shapes], lambda g, h: pair_tree(g, h)[1], logits, y, aside, PAIR_ROUNDS)
    return model


def set_aside(id_col: Column) -> Column:
    """Documents whose labels are not learnt from: the checksum of the identifier as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def measured(texts: DataFrame) -> DataFrame:
    """texts (any columns, then text last): the columns before it, and the measures of the text."""
    at = len(texts.columns) - 1

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, parts in pieces(batches, at):
            found = [measures(t) for t in parts]
            yield pa.RecordBatch.from_arrays([*piece.columns[:at], pa.array(found, pa.list_(pa.float64()))], names=[*piece.schema.names[:at], "x"])

    before = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:at])
    return texts.mapInArrow(measure, f"{before}, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = FIT_DOCUMENTS) -> Additive:
    """Fit on about ``most`` of the labelled documents, a fifth of which only tell when to stop.

    A document that several rows of labels name has quality if one of them says so; null labels are left out.  Null, empty
    and very long texts take part like any other, rows that repeat an identifier all take part, and equal rows are kept.
    Without both labels the model is a constant, the share of 1 among what there is.  Only the named columns are read,
    whatever else the tables hold.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("of"), F.col(label_col).alias("label")).groupBy("of").agg(F.max("label").cast("int").alias("y"))
    known = sampled(known, "of", most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(known), F.col("id") == F.col("of")).select(F.col("id").cast("string").alias("key"), "y", "text")  # a bounded sample
    rows = measured(texts)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        key = np.array(table["key"].to_pylist())
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(key), len(MEASURES))
        y = (table["y"].to_numpy() > 0).astype(np.float64)
        order = np.lexsort((*x.T[::-1], y, key))
        aside = np.array([crc32(f"aside {k}".encode()) % 5 == 0 for k in key[order]])
        model = fitted(x[order], y[order], aside)
        arrays = [("base", 0, np.array([model.base]))]
        for name in ("edges", "tables", "coarse", "pairs", "pair_tables"):
            arrays += [(name, k, np.asarray(v)) for k, v in enumerate(getattr(model, name))]
        for name, k, v in arrays:
            yield pa.RecordBatch.from_pydict({"name": [name], "k": [k], "shape": [list(v.shape)], "data": [v.astype(np.float64).tobytes()]})

    found = sorted(rows.repartition(1).mapInArrow(fit, "name string, k long, shape array<bigint>, data binary").collect(), key=lambda r: r.k)  # tables of bins
    got = lambda name: [np.frombuffer(bytes(r.data)).reshape(r.shape) for r in found if r.name == name]
    if not found:
        return Additive(0.0)
    return Additive(float(got("base")[0][0]), got("edges"), got("tables"), [c.astype(np.int64) for c in got("coarse")], [(int(a), int(b)) for a, b in got("pairs")], got("pair_tables"))


def quality_scores(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, score (0 to 1), predicted (1 from a score of 0.5 on).

    Whole texts are scored.  Null and empty texts are those without any measure; equal texts get equal scores.  An empty
    table gives an empty result; only the text is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for piece, texts in pieces(batches, 1):
            scores = known.scores(np.array([measures(t) for t in texts]))
            yield pa.RecordBatch.from_pydict({"id": piece.column(0), "score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(score, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
