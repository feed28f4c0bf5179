"""Media columns of ISO base media files, read from their boxes without decoding a payload.

:func:`store_as_media` writes a text as an uncompressed 8-bit track: samples of
SAMPLE bytes in chunks of CHUNK, the first sample of a chunk a sync sample.
:func:`media_columns` takes any such file, walks the nested boxes, decodes the
sample tables (stts, stsc, stsz, stco or co64, stss) and gives codec, duration and
the byte range of every keyframe; the payload is only ever copied or hashed.

Null and empty texts become one sample of spaces. A file that can't be walked, or
is null, has null columns. Equal texts give equal files. Rows may repeat, other
columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import append_columns, bytes_of, table

SAMPLE, CHUNK, RATE = 192, 8, 8000
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


#: The unity matrix of movie and track headers.
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
_SOUND = full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0")
_DINF = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
_STSD = full(b"stsd", struct.pack(">I", 1), box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16)))


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // SAMPLE)) * SAMPLE, b" ")


def write_media(payload: bytes) -> bytes:
    """An ISO media file of payload, whose length is a positive multiple of SAMPLE."""
    n = len(payload) // SAMPLE
    chunks, rest = -(-n // CHUNK), n % CHUNK
    wide = len(payload) > 0xF0000000
    runs = [(1, CHUNK)] if n >= CHUNK else []
    runs += [(chunks, rest)] if rest else []
    ticks = n * SAMPLE
    duration = (">Q", 1) if ticks >= 1 << 32 else (">I", 0)
    ends = bytes(16) if duration[1] else bytes(8)

    def moov(at: int) -> bytes:
        offsets = at + np.arange(chunks, dtype=np.int64) * (SAMPLE * CHUNK)
        stbl = box(
            b"stbl",
            _STSD,
            full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, per, 1) for first, per in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
            full(b"stss", struct.pack(">I", chunks), np.arange(1, n + 1, CHUNK).astype(">u4").tobytes()),
        )
        mdhd = full(b"mdhd", ends, struct.pack(">I", RATE), struct.pack(duration[0], ticks), struct.pack(">HH", 0x55C4, 0), version=duration[1])
        tkhd = full(b"tkhd", ends, struct.pack(">II", 1, 0), struct.pack(duration[0], ticks), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=duration[1], flags=7)
        mvhd = full(b"mvhd", ends, struct.pack(">I", RATE), struct.pack(duration[0], ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=duration[1])
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, _SOUND, box(b"minf", full(b"smhd", bytes(4)), _DINF, stbl))))

    mdat = box(b"mdat", payload)
    head = len(_FTYP) + len(moov(0)) + len(mdat) - len(payload)
    return _FTYP + moov(head) + mdat


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Kind, body's start and end of every box from start to end, containers' contents included, in file order."""
    todo = [(start, len(data) if end is None else end)]
    while todo:
        at, stop = todo.pop()
        while at < stop:
            if stop - at < 8:
                raise ValueError("a box header is cut short")
            size, kind = struct.unpack_from(">I4s", data, at)
            body = at + 8
            if size == 1:
                (size,) = struct.unpack_from(">Q", data, body)
                body += 8
            elif size == 0:
                size = stop - at
            if size < body - at or at + size > stop:
                raise ValueError("a box leaves its container")
            yield kind, body, at + size
            if kind in CONTAINERS:
                todo.append((at + size, stop))
                at, stop = body, at + size
            else:
                at += size


def _table(data: memoryview, at: int, end: int, width: str, columns: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + 4)
    size = n * columns * int(width[-1])
    if at + 8 + size > end:
        raise ValueError("a sample table leaves its box")
    return np.frombuffer(data[at + 8 : at + 8 + size], width).astype(np.int64).reshape(n, columns)


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    starts: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    def keyframes(self) -> list[tuple[int, int]]:
        at = self.starts[self.keys]
        return list(zip(at.tolist(), (at + self.sizes[self.keys]).tolist(), strict=True))

    def payload(self, data: memoryview) -> bytes:
        """The samples' bytes, neighbours read together."""
        ends = self.starts + self.sizes
        cuts = np.flatnonzero(ends[:-1] != self.starts[1:]) + 1
        firsts, lasts = np.r_[0, cuts], np.r_[cuts, len(ends)] - 1
        return b"".join(data[self.starts[a] : ends[b]] for a, b in zip(firsts, lasts, strict=True)) if len(ends) else b""


def read_track(data: memoryview) -> Track:
    """The first track that has a sample table; ValueError where there is none or it doesn't fit the file."""
    found: dict[bytes, tuple[int, int]] = {}
    for kind, at, end in boxes(data):
        if kind == b"trak" and b"stsz" in found:
            break
        found[kind] = (at, end)
    try:
        at, end = found[b"mdhd"]
        timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        codec = bytes(data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]).decode("latin-1")
        at, end = found[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, at + 4)
        if n > len(data):
            raise ValueError("more samples than bytes")
        sizes = np.full(n, fixed, np.int64) if fixed else _table(data, at + 4, end, ">u4")[:, 0]
        runs = _table(data, *found[b"stsc"], ">u4", 3)
        offsets = _table(data, *found[b"co64"], ">u8") if b"co64" in found else _table(data, *found[b"stco"], ">u4")
    except (KeyError, IndexError, struct.error) as e:
        raise ValueError("a track without sample table") from e
    steps = np.diff(np.r_[runs[:, 0], len(offsets) + 1])
    if len(runs) == 0 and n or (steps < 0).any() or (runs[:1, 0] != 1).any() or (runs[:, 1] < 0).any():
        raise ValueError("chunks out of order")
    if int((steps * np.minimum(runs[:, 1], len(data) + 1)).sum()) != n:
        raise ValueError("chunks and samples differ in number")
    per = np.repeat(runs[:, 1], steps)
    chunk = np.repeat(np.arange(len(per)), per)
    before = np.cumsum(sizes) - sizes
    firsts = np.cumsum(per) - per
    starts = offsets[:, 0][chunk] + before - before[firsts[chunk]] if n else sizes
    if n and ((starts < 0).any() or (starts + sizes).max() > len(data)):
        raise ValueError("a sample leaves the file")
    keys = _table(data, *found[b"stss"], ">u4")[:, 0] - 1 if b"stss" in found else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("a sync sample that isn't there")
    return Track(codec, timescale, duration, starts, sizes, keys)


def store_as_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with n_bytes (the text's UTF-8) and the text as a media file (binary)."""

    def factory():
        def compute(batch):
            rows = [(len(raw), write_media(padded(raw))) for raw in bytes_of(batch, text)]
            return [[n for n, _ in rows], [m for _, m in rows]]

        return compute

    return append_columns(df, [("n_bytes", "long"), (media, "binary")], factory)


def media_columns(df: DataFrame, media: str = "media", ranges: bool = True, digests: bool = False) -> DataFrame:
    """df with codec, duration_s, n_samples, n_keyframes and keyframes (byte ranges, end exclusive).

    digests adds what reading the stored samples back gives: payload_bytes,
    payload_sha256, tail_crc32 (of its last 16 bytes), media_bytes, media_sha256
    and feature, a line of text of the track's figures.
    """
    fields = [("codec", "string"), ("duration_s", "double"), ("n_samples", "long"), ("n_keyframes", "long")]
    fields += [("keyframes", "array<struct<start:long,end:long>>")] * ranges
    fields += [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")] * digests

    def factory():
        def row(raw: bytes) -> list:
            data = memoryview(raw)
            try:
                t = read_track(data)
            except (ValueError, struct.error, OverflowError):
                return [None] * len(fields)
            keys = t.keyframes()
            out = [t.codec, t.duration / t.timescale if t.timescale else None, len(t.sizes), len(keys)]
            out += [[{"start": a, "end": b} for a, b in keys]] * ranges
            if digests:
                payload = t.payload(data)
                places = hashlib.sha256(np.array(keys, "<i8").tobytes()).hexdigest()[:16]
                feature = f"codec={t.codec.strip()};timescale={t.timescale};duration={t.duration};samples={len(t.sizes)};keyframes={len(keys)};first={keys[0][0] if keys else -1};last={keys[-1][1] if keys else -1};ranges={places}"
                out += [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature]
            return out

        def compute(batch):
            rows = [row(raw) for raw in bytes_of(batch, media)]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in fields]

        return compute

    return append_columns(df, fields, factory)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_as_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = media_columns(stored.drop("text"), digests=True)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "n_samples", "n_keyframes", "keyframes")
