"""ISO media containers: write uncompressed samples, walk boxes, decode sample tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of one stored sample; payloads are padded to a multiple of it.
SAMPLE = 576
TIMESCALE = 8000
#: One sample in so many is marked as a sync sample (a keyframe); the first always is.
SYNC_EVERY = 8
#: Samples of one chunk.
CHUNK_SAMPLES = 64
#: Boxes that hold boxes, and the bytes of their own before the first of these.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4, b"stsd": 8}

_META = "codec string, handler string, timescale long, duration long, n_samples long, keyframes array<struct<lo:long,hi:long>>, payload_ranges array<struct<lo:long,hi:long>>, error string"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return struct.pack(">I", size) + kind + body if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + body


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(payload: bytes) -> bytes:
    """The payload with bytes 255 up to a positive multiple of ``SAMPLE``."""
    size = max(1, -(-len(payload) // SAMPLE)) * SAMPLE
    return payload + b"\xff" * (size - len(payload))


def store(payload: bytes) -> bytes:
    """An ISO media file that holds a padded payload as unsigned 8-bit PCM samples (codec ``raw ``).

    Equal payloads give equal files: all times are zero.
    """
    count = len(payload) // SAMPLE
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    start = len(ftyp) + (8 if len(payload) + 8 < 1 << 32 else 16)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    offsets = range(start, start + len(payload), SAMPLE * CHUNK_SAMPLES)
    rest = count % CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES)] if count >= CHUNK_SAMPLES else []
    runs += [(len(offsets), rest)] if rest else []
    wide = start + len(payload) >= 1 << 32
    syncs = range(1, count + 1, SYNC_EVERY)
    entry = box(b"raw ", b"\0" * 6, struct.pack(">HHIHHHHI", 1, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    stbl = box(
        b"stbl",
        full_box(b"stsd", 0, 0, struct.pack(">I", 1), entry),
        full_box(b"stts", 0, 0, struct.pack(">III", 1, count, SAMPLE)),
        full_box(b"stss", 0, 0, struct.pack(f">{len(syncs) + 1}I", len(syncs), *syncs)),
        full_box(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
        full_box(b"stsz", 0, 0, struct.pack(">II", SAMPLE, count)),
        full_box(b"co64" if wide else b"stco", 0, 0, struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets)),
    )
    minf = box(b"minf", full_box(b"smhd", 0, 0, b"\0" * 4), box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), full_box(b"url ", 0, 1))), stbl)
    mdia = box(b"mdia", full_box(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, TIMESCALE, len(payload), 0x55C4, 0)), full_box(b"hdlr", 0, 0, b"\0" * 4, b"soun", b"\0" * 13), minf)
    tkhd = full_box(b"tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), b"\0" * 16, matrix, b"\0" * 8)
    mvhd = full_box(b"mvhd", 1, 0, struct.pack(">QQIQ", 0, 0, TIMESCALE, len(payload)), struct.pack(">IH", 0x10000, 0x100), b"\0" * 10, matrix, b"\0" * 24, struct.pack(">I", 2))
    return b"".join([ftyp, box(b"mdat", payload), box(b"moov", mvhd, box(b"trak", tkhd, mdia))])


@dataclass
class Track:
    """What a track's boxes say; sample ranges are byte ranges of the file."""

    codec: str | None = None
    handler: str | None = None
    timescale: int = 0
    duration: int = 0
    sizes: list[int] | tuple[int, int] = (0, 0)
    syncs: list[int] | None = None
    to_chunk: list[tuple[int, int]] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)

    def n_samples(self) -> int:
        return self.sizes[1] if isinstance(self.sizes, tuple) else len(self.sizes)

    def samples(self) -> Iterator[tuple[int, int]]:
        """Byte range of every sample in order."""
        at, total = 0, self.n_samples()
        bounds = [*[first for first, _ in self.to_chunk[1:]], len(self.offsets) + 1]
        for (first, per_chunk), end in zip(self.to_chunk, bounds, strict=True):
            for chunk in range(first, end):
                place = self.offsets[chunk - 1]
                for _ in range(min(per_chunk, total - at)):
                    size = self.sizes[0] if isinstance(self.sizes, tuple) else self.sizes[at]
                    yield place, place + size
                    place += size
                    at += 1


def walk(data: bytes | memoryview, lo: int = 0, hi: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path and body range of each box, parents first; payload bodies are passed over, not read.

    A box that claims less than its header or more than its parent raises ``ValueError``.
    """
    todo = [(lo, len(data) if hi is None else hi, path)]
    while todo:
        lo, hi, path = todo.pop()
        inner = []
        while lo + 8 <= hi:
            size, kind = struct.unpack_from(">I4s", data, lo)
            head = 8
            if size == 1:
                if lo + 16 > hi:
                    raise ValueError(f"short header of {kind!r} at {lo}")
                size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
            elif size == 0:
                size = hi - lo
            if size < head or lo + size > hi:
                raise ValueError(f"box {kind!r} at {lo} has size {size}")
            yield (*path, kind), lo + head, lo + size
            if kind in CONTAINERS and len(path) < 32:
                inner.append((lo + head + CONTAINERS[kind], lo + size, (*path, kind)))
            lo += size
        if lo != hi:
            raise ValueError(f"{hi - lo} bytes are left at {lo}")
        todo += reversed(inner)


def _table(data: bytes | memoryview, lo: int, hi: int, shape: str, at: int = 4) -> list[tuple[int, ...]]:
    count = struct.unpack_from(">I", data, lo + at)[0]
    row = struct.Struct(f">{shape}")
    if lo + at + 4 + count * row.size > hi:
        raise ValueError("a sample table is longer than its box")
    return list(row.iter_unpack(data[lo + at + 4 : lo + at + 4 + count * row.size]))


def tracks(data: bytes | memoryview) -> list[Track]:
    """The tracks of a file, from its box headers and sample tables alone."""
    found: list[Track] = []
    for path, lo, hi in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append(Track())
        elif not found:
            continue
        elif kind == b"mdhd":
            long = data[lo] == 1
            found[-1].timescale, found[-1].duration = struct.unpack_from(">IQ" if long else ">II", data, lo + (20 if long else 12))
        elif kind == b"hdlr":
            found[-1].handler = bytes(data[lo + 8 : lo + 12]).decode("latin-1")
        elif len(path) > 1 and path[-2] == b"stsd" and found[-1].codec is None:
            found[-1].codec = kind.decode("latin-1")
        elif kind == b"stsz":
            size, count = struct.unpack_from(">II", data, lo + 4)
            found[-1].sizes = (size, count) if size else [x[0] for x in _table(data, lo, hi, "I", 8)]
        elif kind == b"stss":
            found[-1].syncs = [x[0] for x in _table(data, lo, hi, "I")]
        elif kind == b"stsc":
            found[-1].to_chunk = [x[:2] for x in _table(data, lo, hi, "III")]
        elif kind in (b"stco", b"co64"):
            found[-1].offsets = [x[0] for x in _table(data, lo, hi, "I" if kind == b"stco" else "Q")]
    return found


def joined(ranges: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Adjacent byte ranges put together."""
    out: list[tuple[int, int]] = []
    for lo, hi in ranges:
        if out and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def describe(data: bytes | None) -> dict:
    """One row about a file's first track; what can't be read is null, with the reason in ``error``."""
    row: dict = dict.fromkeys(("codec", "handler", "timescale", "duration", "n_samples", "keyframes", "payload_ranges", "error"))
    try:
        found = tracks(data or b"")
        if not found:
            return row | {"error": "no track"}
        track = found[0]
        samples = list(track.samples())
        if any(hi > len(data) for _, hi in samples):
            raise ValueError("a sample lies beyond the file")
        keys = samples if track.syncs is None else [samples[i - 1] for i in track.syncs if 0 < i <= len(samples)]
        as_rows = lambda x: [{"lo": lo, "hi": hi} for lo, hi in x]
        return row | {"codec": track.codec, "handler": track.handler, "timescale": track.timescale, "duration": track.duration, "n_samples": len(samples), "keyframes": as_rows(keys), "payload_ranges": as_rows(joined(iter(samples)))}
    except (ValueError, struct.error, IndexError) as broken:
        return row | {"error": str(broken)[:200]}


def media_metadata(rows: DataFrame, key: str = "media_id", media: str = "media") -> DataFrame:
    """Codec, duration and keyframe byte ranges of a binary column of ISO media files, one row for each row.

    Only box headers and sample tables are decoded. Null, empty, cut off or foreign bytes give nulls and an
    ``error``; repeated rows are described alike; an empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            for at in range(len(batch)):
                told = describe(batch.column(1)[at].as_py())
                kinds = kinds or pa.schema([("codec", pa.string()), ("handler", pa.string()), *[(x, pa.int64()) for x in ("timescale", "duration", "n_samples")], *[(x, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))) for x in ("keyframes", "payload_ranges")], ("error", pa.string())])
                one = pa.RecordBatch.from_pylist([told], schema=kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 1], *one.columns], [key, *kinds.names])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, media).mapInArrow(scan, f"{key} {kind}, {_META}")


def stored_texts(docs: DataFrame) -> DataFrame:
    """Each text as a media file, described and read back: ``doc_id, n_bytes, media`` and digests of both.

    The file is built, its boxes are walked, and the payload is taken from the sample ranges that the walk found.
    Null texts are empty, an empty text still fills one sample, repeated rows are stored alike, an empty table
    gives no rows. ``feature`` is codec, timescale, duration, samples, keyframes and bytes in keyframes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            texts = batch.column(1).cast(pa.large_binary())
            for text in texts:
                raw = text.as_buffer() if text.is_valid else b""
                raw = bytes(raw) if raw is not None else b""
                media = store(padded(raw))
                track = tracks(media)[0]
                samples = list(track.samples())
                payload = b"".join(media[lo:hi] for lo, hi in joined(iter(samples)))
                keys = [samples[i - 1] for i in track.syncs or ()]
                feature = f"codec={track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={len(samples)};keyframes={len(keys)};keyframe_bytes={sum(hi - lo for lo, hi in keys)}"
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
