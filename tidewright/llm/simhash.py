"""SimHash near-duplicates by vantage-point trees over fingerprints.

Fingerprints that differ in at most 3 of 64 bits agree on at least one of four 16-bit bands.  Each band has a
vantage-point tree: a band's value is routed by its Hamming distances from a row of vantage points, and the triangle
inequality says that a partner within radius r of the band lies in shells at most r away.  In the band where the pair
agrees r is 0, so the shards that a query overlaps are exactly its own: four rows per fingerprint, no boundary copies.
(One tree over all 64 bits would have to visit both sides of more than half of its boundaries: distances from a
vantage point crowd around 32 with a deviation of 4, and the radius is 3.)

Inside a shard whole fingerprints are compared.  A large shard is searched by a vantage-point tree over all 64 bits,
in which the radius is 3 and boundary-overlapping branches are both visited.

Equal fingerprints collapse before any of this, and a shard reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import component_roots
from .shared import shuffle_partitions, written
from .words import mix64, pieces

SHINGLE = 3
SEED = 42
RADIUS = 3
BANDS = 4
#: Vantage points of each band's tree.
VANTAGE = mix64(np.arange(1, 13, dtype=np.uint64)).astype(np.uint16)
#: Runs of a shard up to this size are compared pair by pair in one vector step per distance in the run.
SMALL = 32


def shingle_hashes(text: str | None) -> list[int]:
    words = text.encode().lower().split() if text else []  # bytes: A-Z only, and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)]


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """A bit is set if it is set in over half of the text's shingle hashes; no words: zero."""
    lists = [shingle_hashes(t) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    hashes = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts[full])
    ones = np.zeros((len(full), 64), np.int64)
    step = 200_000  # hashes unpacked at once
    for start in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[start : start + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(ends, [start, start + len(bits) - 1], side="right")
        cuts = np.concatenate([[0], ends[first:last] - start])
        ones[first : last + 1] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    over = (2 * ones > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp: 64-bit SimHash (as a signed long) of the 3-word shingles, repeats included, of each whole text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches, 1):
            yield pa.RecordBatch.from_pydict({"id": piece.column(0), "fp": fingerprints_of(texts).view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(score, f"id {kind}, fp long")


def shells(fp: np.ndarray, band: int) -> np.ndarray:
    """The shard of each fingerprint in a band's tree: a hash of its distances from the vantage points."""
    value = (fp >> np.uint64(16 * band)).astype(np.uint16)
    path = np.full(len(fp), band + 1, np.uint64)
    for v in VANTAGE:
        path = path * np.uint64(17) + np.bitwise_count(value ^ v).astype(np.uint64)
    return mix64(path)


class Forest:
    """Union-find over fingerprints; edges() is a spanning forest of the links that were joined."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.find(x) != x]
        return nodes, [self.find(x) for x in nodes]


def tree_links(fp: np.ndarray, forest: Forest, leaf: int = SMALL) -> None:
    """Join all fingerprints within RADIUS, by vantage-point trees.  fp: distinct.

    A node splits by the median distance from its vantage point.  Those left of the boundary, and those right of it,
    are searched on their own; then those within RADIUS of the boundary on either side meet each other.  Points within
    RADIUS of the vantage point are linked with it at once, and two that are within half of RADIUS need no comparison.
    """
    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(fp, None)]
    while todo:
        a, b = todo.pop()
        if b is None and len(a) < 2 or b is not None and not (len(a) and len(b)):
            continue
        if len(a) <= leaf or b is not None and len(b) <= leaf:
            other = a if b is None else b
            for x in a.tolist() if len(a) <= len(other) else other.tolist():
                against = other if len(a) <= len(other) else a
                near = against[np.bitwise_count(against ^ np.uint64(x)) <= RADIUS]
                for y in near.tolist():
                    if x != y:
                        forest.join(x, y)
            continue
        v = a[len(a) // 2]
        da = np.bitwise_count(a ^ v).astype(np.int64)
        if b is None:
            for y in a[(da <= RADIUS) & (da > 0)].tolist():
                forest.join(int(v), y)
            if int(da.max()) <= RADIUS // 2:
                continue  # all within RADIUS of each other, and joined through the vantage point
            m = int(np.median(da))
            if m >= int(da.max()):
                m -= 1
            inside = da <= m
            todo += [(a[inside], None), (a[~inside], None)]
            todo.append((a[inside & (da > m - RADIUS)], a[~inside & (da <= m + RADIUS)]))
            continue
        # Two sets meet: only shells that the triangle inequality lets be within RADIUS.
        db = np.bitwise_count(b ^ v).astype(np.int64)
        lo, hi = max(da.min(), db.min() - RADIUS), min(da.max(), db.max() + RADIUS)
        if hi - lo <= 2 * RADIUS:  # distances no longer tell them apart: compare in blocks
            for x in a[(da >= lo) & (da <= hi)].tolist():
                near = b[np.bitwise_count(b ^ np.uint64(x)) <= RADIUS]
                for y in near.tolist():
                    if x != y:
                        forest.join(x, y)
            continue
        m = int((lo + hi) // 2)
        todo.append((a[da <= m], b[db <= m + RADIUS]))
        todo.append((a[da > m], b[db > m - RADIUS]))


def shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shard, fp) sorted by shard: a spanning forest of all links within shards."""
    forest = Forest()
    rest = (np.empty(0, np.int64), np.empty(0, np.uint64))

    def search(shard: np.ndarray, fp: np.ndarray) -> None:
        if not len(shard):
            return
        cut = np.flatnonzero(np.diff(shard)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(shard)]])
        size = np.repeat(ends - starts, ends - starts)
        small = size <= SMALL
        for k in range(1, int(size[small].max(initial=1))):
            near = small[k:] & (shard[k:] == shard[:-k]) & (np.bitwise_count(fp[k:] ^ fp[:-k]) <= RADIUS)
            for i in np.flatnonzero(near).tolist():
                if fp[i] != fp[i + k]:
                    forest.join(int(fp[i]), int(fp[i + k]))
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s > SMALL:
                tree_links(np.unique(fp[s:e]), forest)

    for batch in batches:
        shard = np.concatenate([rest[0], batch.column(0).to_numpy()])
        fp = np.concatenate([rest[1], batch.column(1).to_numpy().view(np.uint64)])
        whole = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0  # the last shard may go on
        search(shard[:whole], fp[:whole])
        rest = (shard[whole:], fp[whole:])
    search(*rest)
    nodes, roots = forest.edges()
    for start in range(0, len(nodes), 50_000):
        part = slice(start, start + 50_000)
        yield pa.RecordBatch.from_pydict({"a": np.array(nodes[part], np.uint64).view(np.int64), "b": np.array(roots[part], np.uint64).view(np.int64)})


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """a, b: links that join all fingerprints of the column fp (distinct) that differ in at most RADIUS bits."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for band in range(BANDS):
                yield pa.RecordBatch.from_pydict({"shard": shells(fp, band).view(np.int64), "fp": fp.view(np.int64)})

    parts = shuffle_partitions(distinct.sparkSession)
    sharded = distinct.select("fp").mapInArrow(route, "shard long, fp long").repartition(parts, "shard").sortWithinPartitions("shard")
    return sharded.mapInArrow(shard_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, fp (signed long), component_id (smallest identifier reachable).

    Links join fingerprints that differ in at most 3 bits, and carry on through other documents.  Null, empty and
    blank texts have the fingerprint zero, which is linked like any other.  Texts are read whole.  Repeated rows stay
    repeated.  A null identifier never names a component unless all of its identifiers are null.  An empty table
    gives an empty result; other columns are not read.
    """
    hashed = written(simhash(docs, id_col, text_col), "simhash")
    distinct = written(hashed.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    roots = component_roots(fingerprint_links(distinct), "a", "b")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy(F.col("root").alias("of")).agg(F.min("low").alias("component_id"))
    by_fp = rooted.join(named, F.col("root") == F.col("of")).select(F.col("fp").alias("print"), "component_id")
    return hashed.join(by_fp, F.col("fp") == F.col("print")).select(F.col("id").alias(id_col), "fp", "component_id")


def staying(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id: the identifier of one document of each group of near-duplicates, the smallest, as a table of its own.  Null stands for rows without one, if a group has no other."""
    stay = near_duplicates(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("id"))
    return written(stay.distinct(), "simhash-stay")


def thinned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest identifier.

    Rows that repeat an identifier stay or go together, and stay if one of their texts does.
    """
    stay = staying(docs, id_col, text_col)
    return docs.join(stay, docs[id_col].eqNullSafe(stay["id"]), "left_semi")
