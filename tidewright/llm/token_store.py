"""Token ids in a binary store that is read document by document.

A shard is a row of independent zstandard frames in ascending order of identifiers, an index frame, and the trailing
seek table of the public seekable format (a skippable frame with the size of each frame, compressed and not, and the
low 32 bits of the XXH64 of its content).  A reader fetches the table and the index, then only the frames that hold
the documents asked for, and checks each against its checksum.

Texts are range-partitioned by identifier, so shard after shard ids stand in the order of identifiers.  A task writes
one shard under a name of its own and reports it; the manifest of reported shards is what counts, so a task that is
run again after an executor is lost leaves at most a file that nobody reads.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_file, write_once
from .shared import new_folder, written
from .words import pieces

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
#: A frame is closed once it holds so many ids; a longer document makes a longer frame.
FRAME_IDS = 65_536
LEVEL = 3

#: Lower-case letters that the tokenizer surely sees as one word: a-z, and U+00C0 to U+024F without the two signs among them.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
#: Bytes: 1 a letter a-z, 2 a stop or comma, 3 white space, 0 others.
KINDS = np.array([1 if 0x61 <= b <= 0x7A else 2 if b in b".," else 3 if b == 0x20 or 9 <= b <= 13 else 0 for b in range(256)], np.uint8)
#: Chunks whose ids a worker remembers.
TOKEN_CACHE = 600_000

INDEX = np.dtype([("id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("start", "<u4"), ("count", "<u4")])


class ChunkTokens:
    """Ids of texts by the tokenizers library.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its chunks between
    white space, one after another.  Chunks repeat; each is encoded by the library once and remembered.
    whole=True encodes whole texts instead, for tokenizers that keep white space.
    """

    def __init__(self, path: str, whole: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.place: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts, self.lengths = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.known = self.used = 0

    def _encode(self, chunks: list[bytes]) -> Iterator[list[int]]:
        """Ids of each chunk.  All are plain letters, or none are.  Plain letters go to the library together: each ends with the only id that ends a word."""
        texts = [c.decode() for c in chunks]
        if LETTERS.fullmatch(chunks[0]):
            ids = self.tokenizer.encode(" ".join(texts), add_special_tokens=False).ids
            cuts = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(cuts) == len(texts) and cuts[-1] == len(ids):
                return (ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False))
        return (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _learn(self, chunks: list[bytes]) -> None:
        plain, other = [], []
        for c in chunks:
            (plain if LETTERS.fullmatch(c) else other).append(c)
        chunks = [*plain, *other]
        lists = [*(self._encode(plain) if plain else ()), *(self._encode(other) if other else ())]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum()))
        known, used = self.known + len(lists), self.used + len(flat)
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while known > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : used] = flat
        self.lengths[self.known : known] = lengths
        self.starts[self.known : known] = self.used + np.cumsum(lengths) - lengths
        self.place.update(zip(chunks, range(self.known, known), strict=True))
        self.known, self.used = known, used

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if self.whole:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)
        chunks, counts = chunked(texts)
        at = np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0)
        before, new = (self.known, self.used), []
        if len(missing):
            absent = [chunks[k] for k in missing.tolist()]
            new = list(set(absent))
            self._learn(new)
            at[missing] = np.fromiter(map(self.place.__getitem__, absent), np.int64, len(absent))
        sizes, starts = self.lengths[at], self.starts[at]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(starts - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        if len(self.place) > TOKEN_CACHE:  # full: what is frequent was met early and stays, this piece's rare chunks go
            for c in new:
                del self.place[c]
            self.known, self.used = before
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(upto)


def chunked(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """Chunks between ASCII white space of all texts, and how many each has.

    A-Z are lowered, as the tokenizer does, except in texts that may name a special token.  A stop or comma between an
    ASCII letter and white space is a chunk of its own, as it is a token of its own.
    """
    parts = [(b if b"<|" in b else b.lower()) for b in (t.encode() if t else b"" for t in texts)]
    text = np.frombuffer(b"\n".join([b"", *parts, b""]), np.uint8)
    kind = KINDS[text]
    cuts = np.flatnonzero((kind[1:-1] == 2) & (kind[:-2] == 1) & (kind[2:] == 3)) + 1
    text = np.insert(text, cuts, 32)
    begins = np.cumsum([1, *(len(p) + 1 for p in parts)])
    begins += np.searchsorted(cuts, begins)
    space = KINDS[text] == 3
    words = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    return text.tobytes().split(), np.diff(np.searchsorted(words, begins))


_tokens: dict[tuple[str, bool], ChunkTokens] = {}


def tokens(path: str, whole: bool) -> ChunkTokens:
    """One per worker, kept from task to task."""
    if (path, whole) not in _tokens:
        _tokens[path, whole] = ChunkTokens(path, whole)
    return _tokens[path, whole]


class ShardWriter:
    """Appends documents to a sink in the format above."""

    def __init__(self, sink) -> None:
        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []
        self.open: list[bytes] = []
        self.held = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.held + len(ids) > FRAME_IDS:
            self.flush()
        self.index.append((doc_id or 0, doc_id is not None, len(self.table), self.held, len(ids)))
        self.open.append(ids.astype("<u4").tobytes())
        self.held += len(ids)
        self.total += len(ids)

    def _frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.sink.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.open:
            self._frame(b"".join(self.open))
            self.open, self.held = [], 0

    def close(self) -> None:
        self.flush()
        self._frame(np.array(self.index, INDEX).tobytes())
        entries = b"".join(struct.pack("<III", *row) for row in self.table)
        tail = struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(tail)) + entries + tail)


class ShardReader:
    """Reads single documents, or all, of a shard."""

    def __init__(self, file) -> None:
        self.file, self.frames_read = file, 0
        size = file.size()
        count, flags, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        table = np.frombuffer(self._bytes(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3)
        head = struct.unpack("<II", self._bytes(size - 17 - 12 * count, 8))
        if head != (SKIPPABLE_MAGIC, 12 * count + 9):
            raise ValueError("the seek table is damaged")
        self.table = table.astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.index = np.frombuffer(self._frame(count - 1), INDEX)

    def _bytes(self, start: int, n: int) -> bytes:
        self.file.seek(int(start))
        return self.file.read(int(n))

    def _frame(self, k: int) -> bytes:
        packed, size, check = self.table[k]
        content = zstandard.ZstdDecompressor().decompress(self._bytes(self.at[k], packed), max_output_size=int(size))
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not match its checksum")
        self.frames_read += 1
        return content

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, token ids) in the order of the shard; of frames that hold none of wanted, nothing is read."""
        held, content = -1, b""
        for doc_id, known, frame, start, count in self.index.tolist():
            doc_id = doc_id if known else None
            if wanted is not None and doc_id not in wanted:
                continue
            if frame != held:
                held, content = frame, np.frombuffer(self._frame(frame), "<u4")
            yield doc_id, content[start : start + count]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Encode every whole text, append end_id, and write shards into folder, in ascending order of identifiers.

    Returns the manifest: shard, path, n_docs, n_tokens, first (ids of all shards before it).  Null and empty texts are
    the end id alone.  A null identifier comes first.  Rows that repeat an identifier are documents of their own.  An
    empty table writes no shard.  Other columns are not read.  whole: see ChunkTokens.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(tokenizer, whole)
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.zst"
        counts = [0, 0]

        def fill(first, rest, sink) -> None:
            writer = ShardWriter(sink)
            for piece, texts in chain([first], rest):
                flat, sizes = encoder.encode(texts)
                start = 0
                for doc_id, n in zip(piece.column(0).to_pylist(), sizes.tolist(), strict=True):
                    writer.add(doc_id, np.append(flat[start : start + n], np.uint32(end_id)))
                    start += n
            writer.close()
            counts[:] = len(writer.index), writer.total

        parts = pieces(batches, 1)
        first = next(parts, None)
        if first is None:
            return
        write_once(path, lambda sink: fill(first, parts, sink))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [counts[0]], "n_tokens": [counts[1]]})

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id")
    shards = written(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "token-manifest")
    spark, first, rows = docs.sparkSession, 0, []
    for r in sorted(shards.collect(), key=lambda r: r.shard):  # one row per shard
        rows.append((*r, first))
        first += r.n_tokens
    return spark.createDataFrame(rows, "shard long, path string, n_docs long, n_tokens long, first long")


def read_tokens(spark: SparkSession, manifest: DataFrame, with_ids: bool = False, wanted: set | None = None) -> DataFrame:
    """Read shards back: id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids themselves on request.

    Every frame that is read is checked.  wanted: identifiers to read; frames without them are not decompressed, and
    start is still counted over all documents.
    """
    shards = manifest.select("path", "first").collect()  # one row per shard
    if not shards:
        return spark.createDataFrame([], "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(path) as file:
                    reader = ShardReader(file)
                    known = reader.index["known"].tolist()
                    starts = first + np.cumsum(reader.index["count"], dtype=np.int64) - reader.index["count"]
                    chosen = [k for k, i in enumerate(reader.index["id"].tolist()) if wanted is None or (i if known[k] else None) in wanted]
                    found = reader.documents(wanted)
                    for a in range(0, len(chosen), 2000):
                        rows = [next(found) for _ in chosen[a : a + 2000]]
                        out = {
                            "id": pa.array([i for i, _ in rows], pa.int64()),
                            "start": pa.array(starts[chosen[a : a + 2000]]),
                            "n_tokens": pa.array([len(x) for _, x in rows], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for _, x in rows], pa.int64()),
                        }
                        if with_ids:
                            out["ids"] = pa.array([x.astype(np.int64) for _, x in rows], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(out)

    listed = spark.sparkContext.parallelize([tuple(r) for r in shards], len(shards)).toDF("path string, first long")
    return listed.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def stored_tokens(docs: DataFrame, tokenizer: str, end_id: int, **names) -> DataFrame:
    """Write docs into a new folder of the shared one, and read the files back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, new_folder(spark, "tokens"), tokenizer, end_id, **names))
