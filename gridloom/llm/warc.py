"""WARC archives with dictionary compression.

An archive (``.warc.zst``) starts with a skippable frame (magic 0x184D2A5D) that embeds a Zstandard dictionary built from a bounded sample of all records; each record after it
is a frame of its own, compressed with the dictionary, so any record can be read alone. Payloads that occur again are written as
``revisit`` records that refer to the record which keeps them.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, shared_folder

DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: High half of record ids; the low half is the page's id.
_SPACE = 0x6772_6964_6C6F_4F6D << 64 | 1 << 64
_FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string())])
_TYPES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_SPACE | (page & (1 << 64) - 1))}>" if page is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page without id')}>"


def page_of(record: str) -> int | None:
    """The page id inside a record id."""
    number = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if number >> 64 != _SPACE >> 64:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def make_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record of an HTTP response; a revisit keeps the HTTP header only."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC header fields in lower case, HTTP header, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def build_dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records, or from their bytes as they are where there are too few to train on."""
    parts = [r[i : i + 8192] for r in records for i in range(0, len(r), 8192)]
    try:
        return zstandard.train_dictionary(size, parts, k=256, d=8, level=3)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:]) if sum(map(len, records)) >= 8 else None


class WarcWriter:
    """Embeds a dictionary (its bytes, none if empty), then streams records, each a frame of its own."""

    def __init__(self, stream, dictionary: bytes = b"", level: int = 3):
        self.stream = stream
        book = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        stream.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        self.coder = zstandard.ZstdCompressor(level=level, dict_data=book, write_checksum=True)

    def write(self, record: bytes) -> None:
        self.stream.write(self.coder.compress(record))


def read_records(file, step: int = 1 << 14):
    """Records of an archive, in order, from a binary stream; memory holds one record."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start")
    body = file.read(size)
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body) if body else None)
    rest = file.read(step)
    while rest:
        frame, out = coder.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := file.read(step)):
                raise ValueError("the archive ends inside a record")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(out)
        rest = rest or file.read(step)


def mark_revisits(pages: DataFrame, least: int = 0, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): of rows with equal payloads of at least ``least`` bytes, that with the largest id keeps the payload.

    Digests alone are grouped, before any shuffle; groups of one are dropped, and the rest meets the pages in a join whose hot keys Spark can split. A null payload is empty, a null id
    counts as the smallest; rows that repeat both id and payload are all kept.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    same = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "keeper")
    joined = rows.join(materialise(same, "payloads"), "sha", "left")
    keeps = F.col("keeper").isNull() | F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "payload", F.when(~keeps, F.col("keeper")).alias("refers_to"))


def train_book(records: DataFrame, most: int, size: int) -> bytes:
    """A dictionary for ``records`` (page_id, url, payload, refers_to), made in one task from about ``most`` bytes of them, picked by a hash from all over the table."""
    held = records.agg(F.sum(F.octet_length("payload") + 400).alias("n")).first()["n"] or 0  # headers have some 400 bytes
    share = min(1.0, most / held) if held else 1.0
    part = records.where(F.pmod(F.xxhash64("page_id", "payload"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).repartition(1)

    def train(batches):
        made = [make_record(page, url, text.as_buffer().to_pybytes(), "A" * 32, refers, DATE) for batch in batches for page, url, text, refers in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("payload"), batch.column("refers_to").to_pylist())]
        book = build_dictionary(sorted(made), size) if made else None
        yield pa.RecordBatch.from_arrays([pa.array([book.as_bytes() if book else b""], pa.binary())], ["book"])

    return bytes((part.mapInArrow(train, "book binary").collect() or [{"book": b""}])[0]["book"])  # ``size`` bytes


def write_archives(pages: DataFrame, least: int = 0, folder: str | None = None, date: str = DATE, train_bytes: int = 4 << 20, dictionary_bytes: int = 32 << 10, **columns) -> DataFrame:
    """Writes a record per row and returns the manifest (path string, records long), one archive per task that had rows.

    All archives embed the dictionary that is trained on about ``train_bytes`` of records from all over the table. A repeated task writes another file; only the file that the manifest names counts. Empty tables give an empty manifest; extra columns are ignored.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    records = mark_revisits(pages, least, **columns)
    book = train_book(records, train_bytes, dictionary_bytes)

    def write(batches):
        writer = file = None
        n = 0
        for batch in batches:
            for page, url, text, refers in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("payload"), batch.column("refers_to").to_pylist()):
                if writer is None:
                    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
                    fs.create_dir(root)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    file = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = WarcWriter(file, book)
                payload = text.as_buffer().to_pybytes()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                writer.write(make_record(page, url, payload, digest, refers, date))
                n += 1
        if writer is not None:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], ["path", "records"])

    return materialise(records.mapInArrow(write, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record, read from the archives' files: page_id, url, payload_bytes and payload_digest of the full payload, record_type, refers_to, archive.
    Payloads are checked against their digests."""

    def read(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                rows = []
                with fs.open_input_stream(path, compression=None) as file:
                    for raw in read_records(io.BufferedReader(file) if isinstance(file, io.RawIOBase) else file):
                        fields, http, payload = parse_record(raw)
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            length = len(payload)
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                        else:
                            length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                        rows.append({"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "archive": uri.rpartition("/")[2]})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    return manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism).mapInArrow(read, _TYPES)
