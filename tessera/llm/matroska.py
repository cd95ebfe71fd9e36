"""Media columns: texts as 8-bit PCM in Matroska, parsed back into packet tables.

``mux`` writes an audio track of 192-byte frames (24 ms of 8-bit samples at 8 kHz),
laced into SimpleBlocks, in clusters with a cue each. ``demux`` parses any such file
from its bytes: variable-length EBML ids and sizes (unknown sizes too), clusters,
SimpleBlocks and BlockGroups, no, Xiph, fixed-size and EBML lacing, and cues; it gives
a row per packet with timestamp, track and byte range.

``media_digests`` writes the media column to the shared folder, reads the stored bytes
back and takes the packets from them; no file is muxed and parsed in one breath.

Defined cases: a null text is an empty one; an empty payload is one frame of blanks;
a null id stays null; very long texts are one file of many clusters; other columns are
ignored; each row is handled by itself, so repeats, ties and empty tables need no care.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, give_back, materialize, slices

FRAME = 192
RATE = 8000
FRAME_MS = 24
LACE = 8
CLUSTER_FRAMES = 128
PAD = b" "

#: Element ids of the Matroska and EBML specifications.
EBML, VOID = 0x1A45DFA3, 0xEC
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, KIND, CODEC, AUDIO, HERTZ, CHANNELS, DEPTH, FRAME_NS = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE, GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_PLACE, INFO}
TOP = {INFO, TRACKS, CLUSTER, CUES}
NO_LACE, XIPH_LACE, FIXED_LACE, EBML_LACE = 0, 1, 2, 3


def ident(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int) -> bytes:
    n = 1
    while x >= (1 << 7 * n) - 1:
        n += 1
    return (x | 1 << 7 * n).to_bytes(n, "big")


def element(name: int, data: bytes) -> bytes:
    return ident(name) + vint(len(data)) + data


def number(name: int, x: int) -> bytes:
    return element(name, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def real(name: int, x: float) -> bytes:
    return element(name, struct.pack(">d", x))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """Lacing header and frames."""
    if lacing == NO_LACE:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == XIPH_LACE:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACE and len(sizes) > 1:
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            n, d = 1, b - a
            while not -(1 << 7 * n - 1) < d < 1 << 7 * n - 1:
                n += 1
            head += (d + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return head + b"".join(frames)


_HEAD = element(
    EBML,
    number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK,
        number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(FRAME_NS, FRAME_MS * 1_000_000)
        + element(AUDIO, real(HERTZ, float(RATE)) + number(CHANNELS, 1) + number(DEPTH, 8)),
    ),
)


def mux(payload: bytes, lace: int = LACE, lacing: int = FIXED_LACE) -> bytes:
    """A Matroska file of the payload, whose length is a multiple of the frame."""
    frames = len(payload) // FRAME
    info = element(INFO, number(SCALE, 1_000_000) + element(MUXER, b"tessera") + element(WRITER, b"tessera") + real(DURATION, float(frames * FRAME_MS)))
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    for first in range(0, frames, CLUSTER_FRAMES):
        body = [number(TIMESTAMP, first * FRAME_MS)]
        last = min(frames, first + CLUSTER_FRAMES)
        for a in range(first, last, lace):
            b = min(last, a + lace)
            kind = lacing if b - a > 1 else NO_LACE
            data = laced([payload[i * FRAME : (i + 1) * FRAME] for i in range(a, b)], kind)
            body.append(element(SIMPLE, b"\x81" + struct.pack(">h", (a - first) * FRAME_MS) + bytes([0x80 | kind << 1]) + data))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE, number(CUE_TIME, first * FRAME_MS) + element(CUE_PLACE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in ms, offset, length, keyframe)."""

    packets: list = field(default_factory=list)
    clusters: list = field(default_factory=list)
    cues: list = field(default_factory=list)
    tracks: list = field(default_factory=list)
    scale: int = 1_000_000
    duration: float = 0.0


def _read_id(data: bytes, at: int) -> tuple[int, int]:
    n = 9 - data[at].bit_length()
    if n > 4:
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def _read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """Value (None: unknown) and the byte behind it."""
    first = data[at]
    if not first:
        raise ValueError(f"no size at byte {at}")
    n = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def _block(data: bytes, at: int, end: int, base: int, step_ms: float, key: bool | None, out: Media) -> None:
    track, at = _read_size(data, at)
    offset = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    at += 3
    key = bool(flags & 0x80) if key is None else key
    lacing = flags >> 1 & 3
    if lacing == NO_LACE:
        sizes = [end - at]
    else:
        count = data[at] + 1
        at += 1
        if lacing == FIXED_LACE:
            sizes = [(end - at) // count] * count
            if sum(sizes) != end - at:
                raise ValueError("a block with fixed lacing has frames of uneven size")
        else:
            sizes = []
            for i in range(count - 1):
                if lacing == XIPH_LACE:
                    size = 0
                    while data[at] == 255:
                        size, at = size + 255, at + 1
                    size, at = size + data[at], at + 1
                else:
                    width = 9 - data[at].bit_length()
                    value, at = _read_size(data, at)
                    value = (1 << 7 * width) - 1 if value is None else value
                    size = value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
            if min(sizes) < 0:
                raise ValueError("a block's lacing runs over its end")
    time = (base + offset) * out.scale / 1e6
    for i, size in enumerate(sizes):
        out.packets.append((track, time + i * step_ms, at, size, key))
        at += size


def demux(data: bytes) -> Media:
    """Packets, clusters, cues and tracks of a Matroska file."""
    out = Media()
    step: dict[int, float] = {}
    state = {"time": 0, "track": {}, "cue": {}}

    def walk(at: int, end: int, parent: int) -> int:
        while at < end:
            start = at
            name, at = _read_id(data, at)
            size, at = _read_size(data, at)
            if parent in (CLUSTER, SEGMENT) and name in (TOP if parent == CLUSTER else {EBML, SEGMENT}):
                return start  # ends a parent of unknown size
            stop = end if size is None else at + size
            if stop > end:
                raise ValueError(f"the element at byte {start} runs over its parent's end")
            if name in MASTERS:
                if name == CLUSTER:
                    out.clusters.append(start)
                elif name == TRACK:
                    state["track"] = {}
                elif name == CUE:
                    state["cue"] = {}
                if name == GROUP:
                    group(at, stop)
                    at = stop
                else:
                    at = walk(at, stop, name) if size is None else (walk(at, stop, name), stop)[1]
                if name == TRACK:
                    t = state["track"]
                    out.tracks.append(t)
                    step[t.get(NUMBER, 1)] = t.get(FRAME_NS, 0) / 1e6
                elif name == CUE:
                    out.cues.append((state["cue"].get(CUE_TIME, 0), state["cue"].get(CUE_TRACK, 1), state["cue"].get(CUE_CLUSTER, 0) + segment[0]))
                continue
            if name == SIMPLE:
                track, _ = _read_size(data, at)
                _block(data, at, stop, state["time"], step.get(track, 0.0), None, out)
            elif name == TIMESTAMP:
                state["time"] = int.from_bytes(data[at:stop], "big")
            elif name == SCALE:
                out.scale = int.from_bytes(data[at:stop], "big")
            elif name == DURATION:
                out.duration = struct.unpack(">d" if stop - at == 8 else ">f", data[at:stop])[0]
            elif name in (NUMBER, UID, KIND, FRAME_NS, CHANNELS, DEPTH):
                state["track"][name] = int.from_bytes(data[at:stop], "big")
            elif name == CODEC:
                state["track"][name] = data[at:stop].decode()
            elif name == HERTZ:
                state["track"][name] = struct.unpack(">d" if stop - at == 8 else ">f", data[at:stop])[0]
            elif name in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                state["cue"][name] = int.from_bytes(data[at:stop], "big")
            at = stop
        return at

    def group(at: int, end: int) -> None:
        """A BlockGroup; its block is a key frame if it refers to no other."""
        place, refers = None, False
        while at < end:
            name, at = _read_id(data, at)
            size, at = _read_size(data, at)
            size = end - at if size is None else size  # unknown: all that is left of the group
            if at + size > end:
                raise ValueError("a block group's element runs over its end")
            if name == BLOCK:
                place = (at, at + size)
            refers |= name == 0xFB
            at += size
        if place:
            track, _ = _read_size(data, place[0])
            _block(data, *place, state["time"], step.get(track, 0.0), not refers, out)

    at, segment = 0, [0]
    while at < len(data):
        name, behind = _read_id(data, at)
        size, behind = _read_size(data, behind)
        stop = len(data) if size is None else behind + size
        if stop > len(data):
            raise ValueError("the file is cut off")
        if name == SEGMENT:
            segment[0] = behind
            at = walk(behind, stop, SEGMENT)
        else:
            at = stop
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    """Payload, and its length before it was padded."""
    data = b"" if text is None else text.encode()
    want = max(FRAME, -(-len(data) // FRAME) * FRAME)
    return data + PAD * (want - len(data)), len(data)


def features(payload: bytes, media: Media) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] ^ x[:-1]) < 0))
    energy = (x * x).reshape(-1, FRAME).sum(1)
    return (
        f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};duration_ms={media.duration:.0f};"
        f"sum={int(x.sum())};energy={int(energy.sum())};peak_frame={int(energy.argmax())};crossings={crossings}"
    )


def _slim(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))


def muxed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media column."""

    def run(batches):
        for batch in slices(batches):
            parts = [padded(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in parts], pa.int64()), pa.array([mux(p) for p, _ in parts], pa.binary())], ["doc_id", "n_bytes", "media"])
        give_back()

    return _slim(docs, id_col, text).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """A row per packet of a (doc_id, media) table: packet number, track, timestamp_ms, offset, length, keyframe."""
    kinds = [("packet", pa.int64()), ("track", pa.int64()), ("timestamp_ms", pa.float64()), ("offset", pa.int64()), ("length", pa.int64()), ("keyframe", pa.bool_())]

    def run(batches):
        for batch in slices(batches, 50):
            found = [demux(m).packets for m in batch.column(1).to_pylist()]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            rows = [(i, *p) for x in found for i, p in enumerate(x)]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True))], ["doc_id", *(n for n, _ in kinds)])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, packet long, track long, timestamp_ms double, offset long, length long, keyframe boolean")


def described(stored: bytes) -> tuple:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of a stored file, by its packets."""
    media = demux(stored)
    if [c[2] for c in media.cues] != media.clusters:
        raise ValueError("a cue does not point at its cluster")
    back = b"".join([stored[o : o + k] for _, _, o, k, _ in media.packets])
    return (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back, media))


def media_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the media column, reads the stored bytes back packet by packet, and describes both."""
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    stored = materialize(muxed(docs, id_col, text), "media", "zstd")

    def run(batches):
        for batch in slices(batches):
            rows = [described(m) for m in batch.column(2).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *(n for n, _ in kinds)])
        give_back()

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(run, schema)
