"""Token-ID output: binary shards of independent zstandard frames with a trailing seek table.

A shard is
  * frames: each holds whole documents' ids, little-endian unsigned (2 or 4 bytes each, as the vocabulary needs), with zstandard's own
    content checksum;
  * a skippable frame (magic 0x184D2A50): the document index, little-endian: width of an id (u32), documents (u32), then doc_id
    (i64), number of ids (u32) and frame (u32) of each;
  * a skippable frame (magic 0x184D2A5E) in the public seekable format: per frame compressed size, decompressed size and the low
    32 bits of XXH64 of its content, then the footer (number of frames, descriptor 0x80, magic 0x8F92EAB1).
Any zstandard decompressor reads the ids of the whole shard; ``read_documents`` opens only the frames of the documents asked for.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import blocks, materialise, ragged, shared_folder, text_buffer
from .tokens import coder

#: Fixed values of the public formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class ShardWriter:
    """Writes documents' ids to ``stream``; memory holds one frame."""

    def __init__(self, stream, width: int, frame_ids: int = 1 << 18, level: int = 3):
        self.stream, self.width, self.frame_ids = stream, width, frame_ids
        self.coder = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting: list[bytes] = []
        self.held = self.total = 0

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Documents in order; a frame ends at the first document's end after ``frame_ids`` ids."""
        at, n = 0, len(doc_ids)
        ids = ids.astype("<u2" if self.width == 2 else "<u4")
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + max(1, self.frame_ids - self.held), "left"))))
            self.waiting.append(ids[offsets[at] : offsets[to]].tobytes())
            self.index.append((doc_ids[at:to], np.diff(offsets[at : to + 1]), np.full(to - at, len(self.frames))))
            self.held += int(offsets[to] - offsets[at])
            self.total += int(offsets[to] - offsets[at])
            if self.held >= self.frame_ids:
                self.flush()
            at = to

    def flush(self) -> None:
        if self.index and (not self.frames or self.held):
            content = b"".join(self.waiting)
            packed = self.coder.compress(content)
            self.stream.write(packed)
            self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        self.flush()
        parts = [np.concatenate(x) for x in zip(*self.index)] if self.index else [np.zeros(0)] * 3
        body = struct.pack("<II", self.width, len(parts[0])) + b"".join(x.astype(t).tobytes() for x, t in zip(parts, ("<i8", "<u4", "<u4")))
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class ShardReader:
    """Reads a shard through a seekable binary file."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the shard")
        file.seek(size - 9 - 12 * count - 8)
        seek = file.read(8 + 12 * count)
        if struct.unpack("<II", seek[:8]) != (SKIPPABLE_SEEK, 12 * count + 9):
            raise ValueError("damaged seek table")
        self.frames = np.frombuffer(seek[8:], "<u4").reshape(count, 3).astype(np.int64)
        self.at = np.append(0, np.cumsum(self.frames[:, 0]))
        file.seek(int(self.at[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index")
        body = file.read(length)
        self.width, n = struct.unpack("<II", body[:8])
        self.doc_ids = np.frombuffer(body, "<i8", n, 8)
        self.lengths = np.frombuffer(body, "<u4", n, 8 + 8 * n).astype(np.int64)
        self.frame_of = np.frombuffer(body, "<u4", n, 8 + 12 * n).astype(np.int64)

    def frame(self, k: int) -> np.ndarray:
        """Ids of frame k, checked against its checksum."""
        self.file.seek(int(self.at[k]))
        content = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.frames[k, 0])))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(content, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def documents(self):
        """(rows of the index, ids, offsets) by frame, in order."""
        for k in range(len(self.frames)):
            rows = np.flatnonzero(self.frame_of == k)
            yield rows, self.frame(k), np.append(0, np.cumsum(self.lengths[rows]))

    def read(self, doc_ids) -> dict[int, np.ndarray]:
        """Ids of the documents asked for; of documents that share an id, the last."""
        return dict(self.rows(doc_ids))

    def rows(self, doc_ids):
        """(doc_id, ids) of each document that has one of these ids; opens only their frames."""
        wanted = np.flatnonzero(np.isin(self.doc_ids, np.asarray(list(doc_ids), np.int64)))
        for k in np.unique(self.frame_of[wanted]):
            rows, ids = np.flatnonzero(self.frame_of == k), self.frame(int(k))
            ends = np.cumsum(self.lengths[rows])
            for r in wanted[self.frame_of[wanted] == k]:
                j = int(np.searchsorted(rows, r))
                yield int(self.doc_ids[r]), ids[ends[j] - self.lengths[r] : ends[j]]


def write_token_shards(docs: DataFrame, tokenizer: str, kind: str = "byte", end: int = 0, id_col: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes ``text`` of every row and writes the ids, ``end`` after each document, in ascending ``id_col`` to shards in ``folder``.

    Rows are dealt by ranges of the id, so shards follow one another in id order. Returns the manifest, one row per shard: shard long,
    path string, n_docs, n_tokens, start (ids in the shards before it). A null text is empty; a null id is stored as the smallest
    integer, before all others; an empty table gives an empty manifest. Other columns are ignored. A repeated task writes another file, and only the
    file named by the manifest counts.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    lowest = F.lit(-(1 << 63)).cast("long")
    dealt = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("id"), F.col(text).cast("string").alias("text")).repartitionByRange("id").sortWithinPartitions("id")

    def write(batches):
        import uuid

        task, writer, n, made = TaskContext.get(), None, 0, None
        code = coder(tokenizer, kind)
        for batch in blocks(batches, "text"):
            if writer is None:
                fs, root = pyarrow.fs.FileSystem.from_uri(folder)
                fs.create_dir(root)
                name = f"shard-{task.partitionId():06d}-{uuid.uuid4().hex}.tok.zst"
                made = fs.open_output_stream(f"{root}/{name}", compression=None)
                writer = ShardWriter(made, 2 if code.width <= 1 << 16 else 4)
            ids, offsets = code(*text_buffer(batch.column("text")), end)
            writer.add(batch.column("id").to_numpy(), ids, offsets)
            n += batch.num_rows
        if writer is not None:
            writer.close()
            made.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [f"{folder}/{name}"], "n_docs": [n], "n_tokens": [writer.total]}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    shards = materialise(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one short row for each shard, not for each document
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """One row per stored document, read from the shards' files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers), shard, frame."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(row["path"])
                with fs.open_input_file(path) as file:
                    shard, start = ShardReader(file, file.size()), row["start"]
                    for rows, ids, offsets in shard.documents():
                        raw = memoryview(ids.tobytes())
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[rows]), pa.array(start + offsets[:-1]), pa.array(shard.lengths[rows]), pa.array(crc, pa.int64()), pa.array(np.full(len(rows), row["shard"])), pa.array(shard.frame_of[rows])], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "frame"])
                        start += int(offsets[-1])

    files = manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism)
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, frame long")


def read_documents(manifest: DataFrame, doc_ids) -> DataFrame:
    """(doc_id, ids) of a few documents, a row for each stored one that has an id of ``doc_ids``; each shard decompresses only the frames that hold them."""
    wanted = [int(x) for x in doc_ids]

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(row["path"])
                with fs.open_input_file(path) as file:
                    got = list(ShardReader(file, file.size()).rows(wanted))
                    yield pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in got], "ids": [x.tolist() for _, x in got]}, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return manifest.mapInArrow(read, "doc_id long, ids array<bigint>")
