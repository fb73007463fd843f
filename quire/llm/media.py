"""Matroska columns: packet tables of media held in a binary column.

``elements`` walks variable-length EBML elements (known and unknown sizes); ``read_media`` turns clusters,
simple blocks and block groups, with no, Xiph, fixed-size or EBML lacing, into packets with track,
timestamp and byte range, and reads the cue points. ``write_media`` stores 8-bit PCM samples as such
a file, losslessly. ``packet_table`` explodes a binary column into one row for each packet.

Edge cases: a null text is stored as an empty one (64 padding bytes); null media give no packets; a
file that is cut short gives the packets that are whole; an empty table gives an empty result; repeated
rows stay; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_stage, table

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, TIME_SCALE = 0xE7, 0xA3, 0xA0, 0xA1, 0x2AD7B1
TRACK_ENTRY, TRACK_NUMBER, CODEC, DEFAULT_DURATION = 0xAE, 0xD7, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that may stand right below a segment: they end a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367, SEGMENT, EBML}

RATE = 8000  # samples a second
FRAME, LACE, BLOCKS = 512, 8, 8  # samples in a frame, frames in a block, blocks in a cluster


class Element(NamedTuple):
    id: int
    start: int
    data: int
    end: int
    sized: bool


class Packet(NamedTuple):
    track: int
    timestamp: int
    start: int
    size: int
    key: bool
    cluster: int
    block: int


def vint(n: int, width: int | None = None) -> bytes:
    """A size as EBML writes it; the all-ones value of a width means "unknown" and is left out."""
    w = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return (n | 1 << (7 * w)).to_bytes(w, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def whole(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def read_vint(buf: bytes, at: int, end: int) -> tuple[int, int]:
    """Value and width; ValueError if it is cut short."""
    if at >= end or not buf[at]:
        raise ValueError("no variable-length number here")
    w = 9 - buf[at].bit_length()
    if at + w > end:
        raise ValueError("cut short")
    return int.from_bytes(buf[at : at + w], "big") & ((1 << (7 * w)) - 1), w


def head(buf: bytes, at: int, end: int) -> tuple[int, int, int | None] | None:
    """Id, place of the data and size (None: unknown) of the element at ``at``; None if it is cut short."""
    w = 9 - buf[at].bit_length()
    if w > 4 or at + w >= end:
        return None
    try:
        size, sw = read_vint(buf, at + w, end)
    except ValueError:
        return None
    return int.from_bytes(buf[at : at + w], "big"), at + w + sw, None if size == (1 << (7 * sw)) - 1 else size


def cluster_end(buf: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: before the first element that cannot stand inside."""
    while at < end and (got := head(buf, at, end)) is not None and got[0] not in TOP:
        at = end if got[2] is None else got[1] + got[2]
    return min(at, end) if at >= end or got is not None else end


def elements(buf: bytes, at: int, end: int) -> Iterator[Element]:
    """The elements in buf[at:end]; one cut short ends the walk."""
    while at < end and (got := head(buf, at, end)) is not None:
        ident, data, size = got
        if size is None:
            stop = cluster_end(buf, data, end) if ident == CLUSTER else end
            yield Element(ident, at, data, stop, False)
            at = stop
        else:
            yield Element(ident, at, data, min(end, data + size), data + size <= end)
            at = data + size


def number(buf: bytes, e: Element) -> int:
    return int.from_bytes(buf[e.data : e.end], "big")


def real(buf: bytes, e: Element) -> float:
    """A float of 4 or 8 bytes; none, or of another width: 0."""
    return struct.unpack({4: ">f", 8: ">d"}[e.end - e.data], buf[e.data : e.end])[0] if e.end - e.data in (4, 8) else 0.0


def frame_times(buf: bytes, tracks: Element) -> dict[int, Callable[[int], float]]:
    """For each track the nanoseconds that a frame of so many bytes lasts: its default duration, or what its PCM samples take; 0 where
    neither is known."""
    out: dict[int, Callable[[int], float]] = {}
    for entry in elements(buf, tracks.data, tracks.end):
        if entry.id != TRACK_ENTRY:
            continue
        own = {x.id: x for x in elements(buf, entry.data, entry.end)}
        audio = {x.id: x for x in elements(buf, own[AUDIO].data, own[AUDIO].end)} if AUDIO in own else {}
        lasts = number(buf, own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0
        rate = real(buf, audio[SAMPLING]) if SAMPLING in audio else RATE
        wide = (number(buf, audio[CHANNELS]) if CHANNELS in audio else 1) * (number(buf, audio[BIT_DEPTH]) if BIT_DEPTH in audio else 0)
        pcm = CODEC in own and buf[own[CODEC].data : own[CODEC].end].startswith(b"A_PCM") and rate > 0 and wide > 0
        per_byte = 8e9 / (rate * wide) if pcm else 0.0
        out[number(buf, own[TRACK_NUMBER]) if TRACK_NUMBER in own else 0] = (lambda size, d=lasts, b=per_byte: d or size * b)
    return out


def laces(buf: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Start and size of each frame of a block's data."""
    if kind == 0:
        return [(at, end - at)]
    n = buf[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 2:  # fixed size
        sizes = [(end - at) // n] * n
    elif kind == 1:  # Xiph: sums of bytes, 255 goes on
        for _ in range(n - 1):
            size = 0
            while True:
                size += buf[at]
                at += 1
                if buf[at - 1] != 255:
                    break
            sizes.append(size)
    else:  # EBML: a size, then signed differences
        for i in range(n - 1):
            value, w = read_vint(buf, at, end)
            at += w
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << (7 * w - 1)) - 1))
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError("laces beyond their block")
        out.append((at, size))
        at += size
    return out


def read_media(buf: bytes, rate: int = RATE) -> tuple[list[Packet], list[tuple[int, int, int]]]:
    """Packets in file order, and the cues as (time, track, byte of the cluster). A lace's later frames follow its block's time by what
    the frames before them last, as their track tells; ``rate``: samples a second, a byte each, of tracks that are not described."""
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    clusters = blocks = 0
    for top in elements(buf, 0, len(buf)):
        if top.id != SEGMENT:
            continue
        scale, lasts = 1_000_000, {}
        for e in elements(buf, top.data, top.end):
            if e.id == INFO:
                scale = next((int.from_bytes(buf[x.data : x.end], "big") for x in elements(buf, e.data, e.end) if x.id == TIME_SCALE), scale)
            elif e.id == TRACKS:
                lasts = frame_times(buf, e)
            elif e.id == CLUSTER:
                base = 0
                for x in elements(buf, e.data, e.end):
                    if x.id == TIMESTAMP:
                        base = int.from_bytes(buf[x.data : x.end], "big")
                    own = [x] if x.id == SIMPLE_BLOCK else [y for y in elements(buf, x.data, x.end) if y.id == BLOCK] if x.id == BLOCK_GROUP else []
                    for b in own:
                        if not b.sized:
                            continue
                        try:
                            track, w = read_vint(buf, b.data, b.end)
                            at = b.data + w
                            shift, flags = struct.unpack_from(">hB", buf, at)
                            frames = laces(buf, at + 3, b.end, flags >> 1 & 3)
                        except (ValueError, struct.error, IndexError):
                            continue
                        time, passed = base + shift, 0.0
                        for start, size in frames:
                            packets.append(Packet(track, time + int(passed / scale + 1e-6), start, size, bool(flags & 128), clusters, blocks))
                            passed += lasts[track](size) if track in lasts else size * 1e9 / rate
                        blocks += 1
                clusters += 1
            elif e.id == CUES:
                for point in elements(buf, e.data, e.end):
                    got = {x.id: x for x in elements(buf, point.data, point.end)}
                    if CUE_TIME in got and CUE_POSITIONS in got:
                        p = {x.id: int.from_bytes(buf[x.data : x.end], "big") for x in elements(buf, got[CUE_POSITIONS].data, got[CUE_POSITIONS].end)}
                        cues.append((int.from_bytes(buf[got[CUE_TIME].data : got[CUE_TIME].end], "big"), p.get(CUE_TRACK, 0), top.data + p.get(CUE_CLUSTER, 0)))
    return packets, cues


def seek(cues: list[tuple[int, int, int]], time: int, track: int | None = None) -> int:
    """The byte of the last cluster that a cue places at or before ``time``; 0, the file's start, where none does."""
    return max(((t, at) for t, own, at in cues if t <= time and track in (None, own)), default=(0, 0))[1]


HEADER = element(EBML, element(0x4286, b"\1") + element(0x42F7, b"\1") + element(0x42F2, b"\4") + element(0x42F3, b"\x08") + element(0x4282, b"matroska") + element(0x4287, b"\4") + element(0x4285, b"\2"))
TRACK = element(
    TRACKS,
    element(TRACK_ENTRY, element(TRACK_NUMBER, b"\1") + element(0x73C5, b"\1") + element(0x83, b"\2") + element(CODEC, b"A_PCM/INT/LIT") + element(0xE1, element(0xB5, struct.pack(">d", RATE)) + element(0x9F, b"\1") + element(0x6264, b"\x08"))),
)


def write_media(samples: bytes) -> bytes:
    """One audio track of 8-bit samples: frames laced into blocks, blocks gathered in clusters, a cue for each."""
    info = element(INFO, element(TIME_SCALE, whole(1_000_000)) + element(0x4489, struct.pack(">d", len(samples) * 1000 / RATE)) + element(0x4D80, b"quire") + element(0x5741, b"quire"))
    parts, cues, at = [info, TRACK], [], len(info) + len(TRACK)
    for c in range(0, len(samples), FRAME * LACE * BLOCKS):
        time = c * 1000 // RATE
        body = [element(TIMESTAMP, whole(time))]
        for b in range(c, min(len(samples), c + FRAME * LACE * BLOCKS), FRAME * LACE):
            data = samples[b : b + FRAME * LACE]
            frames = -(-len(data) // FRAME)
            head = b"\x81" + struct.pack(">h", b * 1000 // RATE - time)
            if frames == 1:
                block = head + b"\x80" + data
            elif len(data) % FRAME == 0:
                block = head + bytes([0x80 | 2 << 1, frames - 1]) + data
            else:  # a shorter last frame: EBML lacing, whose differences are all zero
                zero = bytes([0x80 | 63])
                block = head + bytes([0x80 | 3 << 1, frames - 1]) + vint(FRAME) + zero * (frames - 2) + data
            body.append(element(SIMPLE_BLOCK, block))
        cues.append((time, at))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(element(CUE_POINT, element(CUE_TIME, whole(t)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\1") + element(CUE_CLUSTER, whole(p)))) for t, p in cues)))
    return HEADER + element(SEGMENT, b"".join(parts))


def padded(data: bytes, to: int = 64) -> bytes:
    """Zeros up to a positive multiple of ``to``."""
    return data.ljust(max(to, -(-len(data) // to) * to), b"\0")


def feature(packets: list[Packet], cues: list, samples: bytes) -> str:
    """Packets, blocks, clusters, cues, milliseconds, then mean and mean absolute step of the samples."""
    a = np.frombuffer(samples, np.uint8)
    step = int(np.abs(np.diff(a.astype(np.int16))).sum()) / max(1, len(a) - 1)
    return f"packets={len(packets)};blocks={packets[-1].block + 1};clusters={packets[-1].cluster + 1};cues={len(cues)};ms={packets[-1].timestamp};mean={a.mean():.4f};step={step:.4f}"


def packet_table(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """id, packet, track, timestamp (ms), start, size, key_frame, cluster, block for each packet of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = read_media(media)[0] if media else []
                if got:
                    track, time, start, size, key, cluster, block = (list(x) for x in zip(*got))
                    yield pa.record_batch([pa.array([ident] * len(got), pa.int64()), pa.array(range(len(got)), pa.int64()), *(pa.array(x, pa.int64()) for x in (track, time, start, size)), pa.array(key), *(pa.array(x, pa.int64()) for x in (cluster, block))], ["doc_id", "packet", "track", "timestamp", "start", "size", "key_frame", "cluster", "block"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return arrow_stage(rows, each, "doc_id long, packet long, track long, timestamp long, start long, size long, key_frame boolean, cluster long, block long")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a Matroska file."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_media(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return arrow_stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), each, "doc_id long, n_bytes long, media binary")


def digest(stored: DataFrame) -> DataFrame:
    """What is read back from each stored file: its packets' byte ranges, joined, and features of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2).to_pylist():
                packets, cues = read_media(media)
                payload = b"".join(media[p.start : p.start + p.size] for p in packets)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(packets, cues, payload)))
            a, b, c, d, e, f = zip(*rows) if rows else ((),) * 6
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.string()), pa.array(f, pa.string())], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return arrow_stage(stored, each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(table(spark, sf_dir, "documents")))
