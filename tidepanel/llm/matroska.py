"""Matroska columns: bytes stored as a PCM track, and packet tables parsed from stored files.

``mux`` writes a deterministic file: EBML header, Segment with Info, Tracks (one
8-bit PCM track), Clusters of SimpleBlocks whose frames are laced, and Cues.
``parse`` reads any Matroska file of these elements: variable-length element ids
and sizes (unknown sizes too), SimpleBlocks and BlockGroups, the four kinds of
lacing, and Cues, as a table of packets with track, timestamp and byte range.
The payload is whatever the packet table addresses, so that a wrong byte range
shows in its digest.

Defined cases: null text is empty; every payload is padded with zeros to a
positive multiple of 64 bytes; equal bytes give equal files; files cut short or
damaged yield the packets before the damage; duplicate rows repeat; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
RATE = 8000  # samples of one byte a second
FRAME = 512
LACED = 8  # frames a block
CLUSTER = 32768  # bytes

# Element ids of the Matroska specification (RFC 9559).
EBML, SEGMENT, INFO, TRACKS, CLUSTER_ID, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, CLUSTER_ID, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER_ID, CUES}


class Packet(NamedTuple):
    cluster: int
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    lacing: int


class Media(NamedTuple):
    packets: list[Packet]
    tracks: list[dict]
    cues: list[tuple[int, int, int]]
    timestamp_scale: int


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], kind: int) -> bytes:
    """The sizes of all frames but the last, ahead of the frames: Xiph (1), fixed (2) or EBML (3) lacing."""
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
    elif kind == 3:
        head += _size(sizes[0])
        for before, n in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = 1
            while not -(1 << 7 * width - 1) < n - before < 1 << 7 * width - 1:
                width += 1
            head += (n - before + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return head + b"".join(frames)


def _block(payload: bytes, relative: int) -> bytes:
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    kind = 0 if len(frames) == 1 else 2 if len({*map(len, frames)}) == 1 else 3
    body = frames[0] if not kind else _lace(frames, kind)
    return _element(SIMPLE_BLOCK, b"\x81" + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + body)


def mux(payload: bytes) -> bytes:
    """A Matroska file whose only track has the payload as 8-bit PCM samples; one timestamp unit is one sample."""
    header = _element(EBML, _number(EBML_VERSION, 1) + _number(EBML_READ_VERSION, 1) + _number(EBML_MAX_ID, 4) + _number(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _number(DOC_TYPE_VERSION, 4) + _number(DOC_TYPE_READ_VERSION, 2))
    info = _element(INFO, _number(TIMESTAMP_SCALE, 10**9 // RATE) + _element(MUXING_APP, b"columns") + _element(WRITING_APP, b"columns") + _element(DURATION, np.array(len(payload), ">f8").tobytes()))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, np.array(RATE, ">f8").tobytes()) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    entry = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(FLAG_LACING, 1) + _number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    head = info + _element(TRACKS, _element(TRACK_ENTRY, entry))
    clusters, cues, at = [], [], len(head)
    for lo in range(0, len(payload), CLUSTER):
        part = payload[lo : lo + CLUSTER]
        blocks = [_block(part[i : i + FRAME * LACED], i) for i in range(0, len(part), FRAME * LACED)]
        clusters.append(_element(CLUSTER_ID, _number(TIMESTAMP, lo) + b"".join(blocks)))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, lo) + _element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER_POSITION, at))))
        at += len(clusters[-1])
    return header + _element(SEGMENT, head + b"".join(clusters) + _element(CUES, b"".join(cues)))


class _Cut(Exception):
    """The file ends inside an element."""


def _vint(data, at: int, end: int, marked: bool) -> tuple[int, int, bool]:
    """(value, position behind it, whether all value bits are ones) of a variable-length integer; ``marked`` keeps its length mark, as ids do."""
    if at >= end or not data[at]:
        raise _Cut
    width = 9 - int(data[at]).bit_length()
    if at + width > end:
        raise _Cut
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return raw if marked else value, at + width, value == (1 << 7 * width) - 1


def _children(data, at: int, end: int, inside: int):
    """(id, start, end) of the elements of a parent; an element of unknown size ends where one of a level above it starts, or with its parent."""
    while at < end:
        try:
            kind, body, _ = _vint(data, at, end, True)
            n, body, unknown = _vint(data, body, end, False)
        except _Cut:
            return
        if inside == CLUSTER_ID and kind in TOP_LEVEL:
            return
        stop = end if unknown else min(end, body + n)
        if unknown and kind == CLUSTER_ID:
            last = body
            for _, _, last in _children(data, body, end, CLUSTER_ID):  # noqa: B007
                pass
            stop = last
        yield kind, body, stop
        at = stop


def _frames(data, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """(start, size) of the frames of a block's body."""
    lacing = flags >> 1 & 3
    if not lacing:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        while len(sizes) < n - 1:
            size = 0
            while True:
                if at >= end:
                    raise _Cut
                size, at, more = size + data[at], at + 1, data[at] == 255
                if not more:
                    break
            sizes.append(size)
    elif lacing == 3:
        while len(sizes) < n - 1:
            start = at
            size, at, _ = _vint(data, at, end, False)
            width = at - start
            sizes.append(size if not sizes else sizes[-1] + size - (1 << 7 * width - 1) + 1)
    else:
        sizes = [(end - at) // n] * (n - 1)
    found = []
    for size in [*sizes, end - at - sum(sizes)]:
        if size < 0 or at + size > end:
            raise _Cut
        found.append((at, size))
        at += size
    return found


def parse(data: bytes) -> Media:
    media = Media([], [], [], 10**6)
    scale, durations = 10**6, {}
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    cluster = -1
    try:
        for top, a, b in _children(data, 0, len(data), 0):
            if top != SEGMENT:
                continue
            for kind, c, d in _children(data, a, b, SEGMENT):
                if kind == INFO:
                    scale = next((uint(e, f) for k, e, f in _children(data, c, d, INFO) if k == TIMESTAMP_SCALE), scale)
                elif kind == TRACKS:
                    for k, e, f in _children(data, c, d, TRACKS):
                        if k == TRACK_ENTRY:
                            fields = {x: (y, z) for x, y, z in _children(data, e, f, TRACK_ENTRY)}
                            track = {"number": uint(*fields[TRACK_NUMBER]), "type": uint(*fields[TRACK_TYPE]), "codec": data[slice(*fields[CODEC_ID])].decode("latin-1")}
                            durations[track["number"]] = uint(*fields[DEFAULT_DURATION]) if DEFAULT_DURATION in fields else 0
                            media.tracks.append(track)
                elif kind == CLUSTER_ID:
                    cluster += 1
                    base = 0
                    for k, e, f in _children(data, c, d, CLUSTER_ID):
                        if k == TIMESTAMP:
                            base = uint(e, f)
                        elif k in (SIMPLE_BLOCK, BLOCK_GROUP):
                            group = [(e, f)] if k == SIMPLE_BLOCK else [(x, y) for z, x, y in _children(data, e, f, BLOCK_GROUP) if z == BLOCK]
                            for x, y in group:
                                track, x, _ = _vint(data, x, y, False)
                                if x + 3 > y:
                                    raise _Cut
                                relative, flags = int.from_bytes(data[x : x + 2], "big", signed=True), data[x + 2]
                                for i, (start, size) in enumerate(_frames(data, x + 3, y, flags)):
                                    when = (base + relative) * scale + i * durations.get(track, 0)
                                    media.packets.append(Packet(cluster, track, when, start, size, k != SIMPLE_BLOCK or bool(flags & 0x80), flags >> 1 & 3))
                elif kind == CUES:
                    for k, e, f in _children(data, c, d, CUES):
                        if k == CUE_POINT:
                            fields = {x: (y, z) for x, y, z in _children(data, e, f, CUE_POINT)}
                            spot = {x: uint(y, z) for x, y, z in _children(data, *fields[CUE_TRACK_POSITIONS], CUE_TRACK_POSITIONS)}
                            media.cues.append((uint(*fields[CUE_TIME]), spot[CUE_TRACK], a + spot[CUE_CLUSTER_POSITION]))
    except (_Cut, KeyError, IndexError):
        pass
    return media._replace(timestamp_scale=scale)


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def _feature(media: Media, payload: bytes, data: bytes) -> str:
    """Packets, clusters, laced packets, cues that point at a cluster, last timestamp in ms, mean and deviation of the samples."""
    x = np.frombuffer(payload, np.uint8)
    hits = sum(data[at : at + 4] == CLUSTER_ID.to_bytes(4, "big") for _, _, at in media.cues)
    mean = int(x.sum(dtype=np.int64)) / len(x)
    spread = (max(0.0, int((x.astype(np.int32) ** 2).sum(dtype=np.int64)) / len(x) - mean * mean)) ** 0.5
    p = media.packets
    return f"packets={len(p)};clusters={p[-1].cluster + 1};laced={sum(q.lacing > 0 for q in p)};cues={hits};last_ms={p[-1].timestamp_ns // 10**6};mean={mean:.4f};sd={spread:.4f}"


def _store(batches):
    for batch in batches:
        rows = [[] for _ in range(8)]
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            data = mux(pad(raw))
            media = parse(data)
            payload = b"".join([data[p.offset : p.offset + p.size] for p in media.packets])
            for column, value in zip(rows, (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), _feature(media, payload, data), len(media.packets)), strict=True):
                column.append(value)
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names=["doc_id", *names])


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text stored as a Matroska file, read back through its packet table, with digests of both."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long")


def _mux_rows(batches):
    for batch in batches:
        media = pa.array([mux(pad((t or "").encode())) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), media], names=["doc_id", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the stored files themselves."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_mux_rows, "doc_id long, media binary")


def _packet_rows(batches):
    for batch in batches:
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            packets = parse(data or b"").packets
            if packets:
                columns = list(zip(*packets, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(packets), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *Packet._fields])


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of the files (doc_id, media)."""
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(_packet_rows, "doc_id long, cluster int, track int, timestamp_ns long, offset long, size long, keyframe boolean, lacing int")
