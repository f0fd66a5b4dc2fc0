"""Media columns: ISO base media (MP4 family) containers in a binary column.

``mux`` stores bytes losslessly as 8-bit samples, ``probe`` walks any container's nested boxes and decodes the sample tables to codec, duration,
sample counts and the byte ranges of the key frames. Payloads are located, never decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import blocks, text_buffer

#: Boxes that hold boxes, and the fixed identity matrix of the format's headers.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
SAMPLE = 192
#: A box's path names so many of the boxes around it.
DEEPEST = 15


def _box(kind: bytes, *body: bytes) -> bytes:
    body = b"".join(body)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *body)


def mux(payload: bytes, sample: int = SAMPLE, key_every: int = 16, chunk: int = 64, rate: int = 8000) -> bytes:
    """An audio track of 8-bit samples ("raw ", one channel): frames of ``sample`` bytes, every ``key_every``-th of them a sync
    sample, ``chunk`` frames a chunk. The payload's length must be a multiple of ``sample``."""
    if len(payload) % sample:
        raise ValueError("the payload is no multiple of the sample size")
    n = len(payload) // sample
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def movie(base: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16))
        offsets = [base + i * chunk * sample for i in range(-(-n // chunk))]
        keys = range(1, n + 1, key_every)
        runs = [(1, chunk, 1)] if n >= chunk else []
        if n % chunk:
            runs.append((n // chunk + 1, n % chunk, 1))
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, sample)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", sample, n)),
            _full(b"stco", struct.pack(f">I{len(offsets)}I", len(offsets), *offsets)),
        )
        length = n * sample
        track = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), MATRIX, struct.pack(">II", 0, 0), flags=7)
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, length, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            _box(b"minf", _full(b"smhd", struct.pack(">I", 0)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, rate, length, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2)), _box(b"trak", track, media))

    size = len(head) + len(movie(0)) + 8
    return head + movie(size) + _box(b"mdat", payload)


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, start of the body, end) of each box, containers before what they hold, however deep. Understands 64-bit and to-the-end sizes; a damaged size ends
    the walk of the box that holds it."""
    todo = [(start, len(data) if end is None else end, path)]
    while todo:
        start, end, path = todo.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            continue
        here = (*path[-DEEPEST:], kind.decode("latin-1"))
        yield here, body, start + size
        todo.append((start + size, end, path))
        if kind in CONTAINERS:
            todo.append((body, start + size, here))


def _ints(data: memoryview, at: int, end: int, columns: int, kind: str = ">u4") -> np.ndarray:
    """A table of a count and so many rows; a count that the box has no room for is cut to what is there."""
    if end - at < 4:
        return np.zeros((0, columns), np.int64)
    n = struct.unpack_from(">I", data, at)[0]
    n = min(n, (end - at - 4) // (columns * int(kind[-1])))
    return np.frombuffer(data, kind, n * columns, at + 4).astype(np.int64).reshape(n, columns)


def _fragment(view: memoryview, at: int, end: int, base: int, default: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, sizes) of the samples of a ``trun`` box whose data begin at ``base`` where it names no offset of its own."""
    if end - at < 8:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flags, n = struct.unpack_from(">II", view, at)
    at += 8
    if flags & 1 and end - at >= 4:
        base, at = base + struct.unpack_from(">i", view, at)[0], at + 4
    at += 4 if flags & 4 else 0
    present = [bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800)]
    width = sum(present)
    if not width:
        n = min(n, (len(view) - base) // default if default > 0 and base >= 0 else 0)  # no more samples than the file has bytes for
        sizes = np.full(max(n, 0), default, np.int64)
    else:
        n = max(0, min(n, (end - at) // (4 * width)))
        table = np.frombuffer(view, ">u4", n * width, at).astype(np.int64).reshape(n, width)
        sizes = table[:, int(present[0])] if present[1] else np.full(n, default, np.int64)
    return base + np.cumsum(sizes) - sizes, sizes


def probe(data: bytes) -> list[dict]:
    """Of each track: codec, handler, timescale, duration, samples' sizes, offsets, and sync samples, from the sample tables and movie fragments alone. Short, empty and
    contradicting tables give what they hold: samples that would lie outside of the file are left out. Samples of a fragment count as sync samples where its first does."""
    view, tracks, by_id, defaults = memoryview(data), [], {}, {}
    none = lambda *shape: np.zeros(shape, np.int64)
    moof, target, more = 0, None, {}
    for path, at, end in walk(view):
        kind, room = path[-1], end - at
        if kind == "trak":
            tracks.append({"codec": None, "handler": None, "timescale": 0, "duration": 0, "sizes": none(0), "sync": None, "chunks": none(0), "runs": none(0, 3), "times": none(0, 2)})
        elif kind == "moof":
            moof = at - 8
        elif kind == "tfhd" and room >= 8:
            flags, track = struct.unpack_from(">II", view, at)
            base, place = moof, at + 8
            if flags & 1 and end - place >= 8:
                base, place = struct.unpack_from(">Q", view, place)[0], place + 8
            place += (4 if flags & 2 else 0) + (4 if flags & 8 else 0)
            size = struct.unpack_from(">I", view, place)[0] if flags & 0x10 and end - place >= 4 else defaults.get(track, 0)
            target = (track, min(base, len(view)), size)
        elif kind == "trex" and room >= 24:
            track, size = struct.unpack_from(">I", view, at + 4)[0], struct.unpack_from(">I", view, at + 16)[0]
            defaults[track] = size
        elif kind == "trun" and target:
            offsets, sizes = _fragment(view, at, end, target[1], target[2])
            more.setdefault(target[0], []).append((offsets, sizes))
            if len(offsets):
                target = (target[0], int(offsets[-1] + sizes[-1]), target[2])
        if not tracks or "trak" not in path:
            continue
        t = tracks[-1]
        if kind == "tkhd" and room >= (24 if view[at] else 16):
            by_id[struct.unpack_from(">I", view, at + (20 if view[at] else 12))[0]] = t
        elif kind == "mdhd" and room >= (32 if view[at] else 20):
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", view, at + 20) if view[at] else struct.unpack_from(">II", view, at + 12)
        elif kind == "hdlr" and room >= 12:
            t["handler"] = bytes(view[at + 8 : at + 12]).decode("latin-1")
        elif kind == "stsd" and room >= 16:
            t["codec"] = bytes(view[at + 12 : at + 16]).decode("latin-1").strip()
        elif kind == "stsz" and room >= 12:
            size, n = struct.unpack_from(">II", view, at + 4)
            t["sizes"] = np.full(min(n, len(view) // size), size, np.int64) if size else _ints(view, at + 8, end, 1)[:, 0]
        elif kind == "stss":
            t["sync"] = _ints(view, at + 4, end, 1)[:, 0]
        elif kind == "stsc":
            t["runs"] = _ints(view, at + 4, end, 3)
        elif kind == "stts":
            t["times"] = _ints(view, at + 4, end, 2)
        elif kind in ("stco", "co64"):
            t["chunks"] = _ints(view, at + 4, end, 1, ">u4" if kind == "stco" else ">u8")[:, 0]
    for t in tracks:
        runs = t["runs"][(t["runs"][:, 0] >= 1) & (t["runs"][:, 0] <= len(t["chunks"]))]
        first = np.maximum.accumulate(runs[:, 0]) if len(runs) else none(0)
        sizes = t["sizes"]
        per = np.repeat(np.minimum(runs[:, 1], len(sizes)), np.diff(np.append(first, len(t["chunks"]) + 1))) if len(first) else none(0)
        chunks = t["chunks"][int(first[0]) - 1 :] if len(first) else none(0)
        ends = np.minimum(np.cumsum(per), len(sizes))
        per = np.diff(np.append(0, ends))  # no more samples than have a size
        n = int(ends[-1]) if len(ends) else 0
        chunk = np.repeat(np.arange(len(per)), per)
        before = np.cumsum(sizes[:n]) - sizes[:n]
        starts = np.cumsum(per) - per
        offsets = chunks[chunk] + before - before[np.minimum(starts[chunk], max(n - 1, 0))] if n else none(0)
        sync = np.arange(1, n + 1) if t["sync"] is None else t["sync"]
        key = np.zeros(n, bool)
        key[sync[(sync >= 1) & (sync <= n)] - 1] = True
        sizes = sizes[:n]
        for place, part in more.get(next((k for k, v in by_id.items() if v is t), None), ()):
            offsets, sizes = np.append(offsets, place), np.append(sizes, part)
            key = np.append(key, np.arange(len(part)) == 0)
        inside = (offsets >= 0) & (offsets <= len(view)) & (sizes >= 0) & (sizes <= len(view) - offsets)
        t["offsets"], t["sizes"], t["keys"] = offsets[inside], sizes[inside], np.flatnonzero(key[inside])
    return tracks


def samples(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track's samples, in order, read where the tables say they are."""
    offsets, sizes = track["offsets"], track["sizes"][: len(track["offsets"])]
    if not len(offsets):
        return b""
    gap = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    a = offsets[np.append(0, gap)]
    last = np.append(gap - 1, len(offsets) - 1)
    return b"".join(data[x:y] for x, y in zip(a.tolist(), (offsets[last] + sizes[last]).tolist()))


def describe(tracks: list[dict]) -> str:
    """Codec, duration and key frames' byte ranges as text. Adjacent tracks are separated by a bar."""
    return "|".join(f"codec={t['codec']};handler={t['handler']};timescale={t['timescale']};duration={t['duration']};samples={len(t['offsets'])};chunks={len(t['chunks'])};keyframes=" + ",".join(f"{t['offsets'][k]}+{t['sizes'][k]}" for k in t["keys"].tolist()) for t in tracks)


def to_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Adds binary column ``out``: the text in UTF-8 (null: empty), padded by blanks to a positive multiple of 192, in a
    container. Columns other than ``text`` and ``out`` pass through, nulls included; an empty table stays empty."""

    def pack(batches):
        for batch in blocks(batches, text):
            data, offsets = text_buffer(batch.column(text))
            made = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                n = max(1, -(-(b - a) // SAMPLE)) * SAMPLE
                made.append(mux(data[a:b].tobytes().ljust(n)))
            yield pa.RecordBatch.from_arrays([*(c for c, k in zip(batch.columns, batch.schema.names) if k != out), pa.array(made, pa.binary())], [*(k for k in batch.schema.names if k != out), out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    return df.mapInArrow(pack, f"{schema}, `{out}` binary")


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Replaces ``media`` by payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, codec, duration (of the first track's timescale),
    keyframes (array of structs offset, length) and feature. Bytes that are no container give no codec and an empty payload;
    null stays null. Columns of ``df`` that have one of these names are replaced; others pass through."""
    new = {"payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "duration", "keyframes", "feature"}
    kept = [f for f in df.schema if f.name != media and f.name not in new]
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("duration", pa.float64()), ("keyframes", ranges), ("feature", pa.string())]

    def unpack(batches):
        for batch in batches:
            rows = []
            for cell in batch.column(media):
                if not cell.is_valid:
                    rows.append(dict.fromkeys(k for k, _ in fields))
                    continue
                raw = cell.as_py()
                tracks = probe(raw)
                payload = b"".join(samples(raw, t) for t in tracks)
                t = tracks[0] if tracks else None
                keys = [{"offset": int(t["offsets"][k]), "length": int(t["sizes"][k])} for k in t["keys"]] if t else []
                rows.append(dict(zip((k for k, _ in fields), (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), t and t["codec"], t["duration"] / t["timescale"] if t and t["timescale"] else None, keys, describe(tracks)))))
            new = pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *new.columns], [*(f.name for f in kept), *new.schema.names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInArrow(unpack, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration double, keyframes array<struct<offset:bigint,length:bigint>>, feature string")


def media_table(docs: DataFrame) -> DataFrame:
    """op1's rows: writes each text as a container, reads it back, computes its features."""
    base = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return media_features(to_media(base).drop("text"))
