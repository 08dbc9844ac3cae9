"""Media columns: Matroska files in binary columns, written and read as packet tables.

The reader walks EBML elements (variable-length ids and sizes, unknown sizes included), tracks, clusters, simple blocks and block
groups, undoes all four lacings and gives each packet its track, timestamp and byte range in the stored bytes; payload bytes are only
sliced when asked for. The writer stores a byte payload losslessly as 8-bit PCM samples.

Defined results: a null text is the empty text, whose payload is one padded frame; a null media value has no packets; damaged
media raises ValueError in ``parse`` and gives null columns in ``read_media`` and ``packet_table``. Each row stands alone, so repeated rows give
equal files; a text of any length is one file, in memory whole; an empty table gives an empty result; output names in ``keep`` raise
ValueError, other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.llm import words as W
from quillon.llm.store import Written

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, CUES, CUE, CUE_AT = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7
SCALE, DURATION, NUMBER, UID, KIND, CODEC, RATE, CHANNELS, DEPTH, DEFAULT_DURATION = 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264, 0x23E383
TIMECODE, SIMPLE, GROUP, BLOCK, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xA3, 0xA0, 0xA1, 0xB3, 0xF7, 0xF1
DOCTYPE, DOCVERSION, DOCREAD = 0x4282, 0x4287, 0x4285
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME, HERTZ, LACED, BLOCKS = 192, 8000, 8, 32


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    size: int
    cluster: int
    keyframe: bool


class Media(NamedTuple):
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time, track, byte position of the cluster
    duration: float


# --- writing


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int, width: int = 0) -> bytes:
    """A size: the least width that holds it and isn't the reserved all-ones value."""
    n = width or next(n for n in range(1, 9) if x < (1 << 7 * n) - 1)
    return (x | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return _id(ident) + vint(len(body)) + body


def uint(ident: int, x: int) -> bytes:
    return element(ident, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def block(track: int, time: int, frames: list[bytes], lacing: int, keyframe: bool = True) -> bytes:
    """Body of a simple block."""
    if len(frames) == 1:
        lacing = NO_LACING
    sizes = [len(f) for f in frames]
    head = vint(track) + struct.pack(">hB", time, 0x80 * keyframe | lacing << 1)
    if lacing:
        head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            n = next(n for n in range(1, 9) if abs(b - a) < 1 << (7 * n - 1))
            head += vint(b - a + (1 << (7 * n - 1)) - 1, n)
    elif lacing == FIXED and len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


_HEAD = element(EBML, element(DOCTYPE, b"matroska") + uint(DOCVERSION, 4) + uint(DOCREAD, 2))
_TRACKS = element(TRACKS, element(TRACK, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME * 10**9 // HERTZ) + element(AUDIO, element(RATE, struct.pack(">d", HERTZ)) + uint(CHANNELS, 1) + uint(DEPTH, 8))))


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % FRAME or (0 if data else FRAME))


def write(payload: bytes, lacing: int = FIXED) -> bytes:
    """A file with one track of 8-bit samples, FRAME samples a packet."""
    ms = FRAME * 1000 // HERTZ
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / HERTZ)))
    body, cues = info + _TRACKS, b""
    for c in range(0, len(frames), LACED * BLOCKS):
        blocks = [element(SIMPLE, block(1, (b - c) * ms, frames[b : min(b + LACED, c + LACED * BLOCKS)], lacing)) for b in range(c, min(c + LACED * BLOCKS, len(frames)), LACED)]
        cues += element(CUE, uint(CUE_TIME, c * ms) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, len(body))))
        body += element(CLUSTER, uint(TIMECODE, c * ms) + b"".join(blocks))
    return _HEAD + element(SEGMENT, body + element(CUES, cues))


# --- reading


def read_id(data: bytes, at: int) -> tuple[int, int]:
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise ValueError("bad element id")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_vint(data: bytes, at: int) -> tuple[int, int, int]:
    """Value (-1: unknown size), next position, width."""
    n = 9 - data[at].bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError("bad size")
    x = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return (-1 if x == (1 << 7 * n) - 1 else x), at + n, n


_TOP = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML}


def children(data: bytes, at: int, end: int, parent: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements; one of unknown size ends where an element of its own level or above starts."""
    while at < end:
        ident, body = read_id(data, at)
        size, body, _ = read_vint(data, body)
        if size < 0:
            stop = body
            if ident == SEGMENT:
                stop = end
            else:
                while stop < end:
                    inner, x = read_id(data, stop)
                    if inner in _TOP:
                        break
                    n, x, _ = read_vint(data, x)
                    stop = x + max(0, n)
        else:
            stop = body + size
        if stop > end:
            raise ValueError("an element passes the end of its parent")
        yield ident, body, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return {0: lambda: 0.0, 4: lambda: struct.unpack(">f", data[a:b])[0], 8: lambda: struct.unpack(">d", data[a:b])[0]}[b - a]()


def laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Offsets and sizes of a block's frames."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError("bad fixed lacing")
        sizes = [(end - at) // count] * count
    else:
        if lacing == XIPH:
            for _ in range(count - 1):
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + data[at], at + 1
                sizes.append(n)
        elif count > 1:
            n, at, _ = read_vint(data, at)
            sizes.append(n)
            for _ in range(count - 2):
                x, at, width = read_vint(data, at)
                sizes.append(sizes[-1] + x - (1 << (7 * width - 1)) + 1)
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise ValueError("bad lacing")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def parse(data: bytes) -> Media:
    try:
        return _parse(data)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"damaged media: {e!r}") from e


def _parse(data: bytes) -> Media:
    tracks: list[dict] = []
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    scale, duration, cluster, seen = 1_000_000, 0.0, -1, False
    for top, a, b in children(data, 0, len(data), 0):
        seen |= top == EBML
        if top != SEGMENT:
            continue
        for kind, s, e in children(data, a, b, SEGMENT):
            if kind == INFO:
                for x, p, q in children(data, s, e, kind):
                    scale = _uint(data, p, q) if x == SCALE else scale
                    duration = _float(data, p, q) if x == DURATION else duration
            elif kind == TRACKS:
                for x, p, q in children(data, s, e, kind):
                    if x == TRACK:
                        tracks.append(_track(data, p, q))
            elif kind == CUES:
                for x, p, q in children(data, s, e, kind):
                    if x == CUE:
                        cues += _cue(data, p, q, a)
            elif kind == CLUSTER:
                cluster += 1
                base = 0
                lengths = {t["number"]: t.get("frame_ns", 0) for t in tracks}
                for x, p, q in children(data, s, e, kind):
                    if x == TIMECODE:
                        base = _uint(data, p, q)
                    elif x == SIMPLE:
                        _block(data, p, q, base, scale, cluster, lengths, packets, None)
                    elif x == GROUP:
                        for y, u, v in children(data, p, q, x):
                            if y == BLOCK:
                                _block(data, u, v, base, scale, cluster, lengths, packets, False)
    if not seen:
        raise ValueError("no header")
    return Media(tracks, packets, cues, duration * scale / 1e9)


def _block(data, at, end, base, scale, cluster, lengths, packets, keyframe) -> None:
    track, at, _ = read_vint(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    step = lengths.get(track, 0)
    start = (base + time) * scale
    key = bool(flags & 0x80) if keyframe is None else keyframe
    for i, (o, n) in enumerate(laced(data, at + 3, end, flags >> 1 & 3)):
        packets.append(Packet(track, start + i * step, o, n, cluster, key))


def _track(data: bytes, a: int, b: int) -> dict:
    out: dict = {"number": 0, "type": 0, "codec": "", "rate": 0.0, "channels": 1, "depth": 0, "frame_ns": 0}
    for x, p, q in children(data, a, b, TRACK):
        if x == AUDIO:
            for y, u, v in children(data, p, q, x):
                out |= {"rate": _float(data, u, v)} if y == RATE else {"channels": _uint(data, u, v)} if y == CHANNELS else {"depth": _uint(data, u, v)} if y == DEPTH else {}
        else:
            out |= {"number": _uint(data, p, q)} if x == NUMBER else {"type": _uint(data, p, q)} if x == KIND else {"codec": data[p:q].decode("latin-1")} if x == CODEC else {"frame_ns": _uint(data, p, q)} if x == DEFAULT_DURATION else {}
    return out


def _cue(data: bytes, a: int, b: int, segment: int) -> list[tuple[int, int, int]]:
    time, out = 0, []
    for x, p, q in children(data, a, b, CUE):
        if x == CUE_TIME:
            time = _uint(data, p, q)
        elif x == CUE_AT:
            got = {y: _uint(data, u, v) for y, u, v in children(data, p, q, x)}
            out.append((time, got.get(CUE_TRACK, 0), segment + got.get(CUE_CLUSTER, 0)))
    return out


def payload(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[p.offset : p.offset + p.size] for p in media.packets if p.track == track])


def feature(media: Media, samples: bytes) -> str:
    """Packets, clusters, cues, milliseconds, sum, energy about 128 and sign changes, all whole numbers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return f"packets={len(media.packets)};clusters={len({p.cluster for p in media.packets})};cues={len(media.cues)};ms={round(media.duration * 1000)};sum={int(x.sum())};energy={int((x * x).sum())};turns={int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())}"


def _write(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batches, text):
        data, bounds = W.raw(W.column(part, text))
        whole = data.tobytes()
        own = {"n_bytes": pa.array(np.diff(bounds), pa.int64()), "media": pa.array([write(padded(whole[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())}
        yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else part.column(f.name) for f in schema], schema=schema)


def write_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_bytes and media, the file that holds the text's padded bytes."""
    taken = docs.select(*dict.fromkeys([*keep, text]))
    own = T._parse_datatype_string("n_bytes bigint, media binary")
    if clash := {*keep} & {*own.fieldNames()}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in taken.schema if f.name in keep), *own])
    return taken.mapInArrow(partial(_write, text=text, schema=to_arrow_schema(schema)), schema)


COLUMNS = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch], media: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in COLUMNS.split(", ")]
    for part in W.slices(batches, media):
        rows = []
        for stored in W.column(part, media):
            data = stored.as_py()
            try:
                found = parse(data) if data is not None else None
            except ValueError:
                found = None
            if found is None:
                rows.append((None,) * len(names))
                continue
            back = payload(data, found)
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(found, back)))
        own = {n: pa.array([r[i] for r in rows], schema.field(n).type) for i, n in enumerate(names)}
        yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else part.column(f.name) for f in schema], schema=schema)


def read_media(files: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """keep columns and what the stored bytes of the first track say; nulls for null or damaged media."""
    own = T._parse_datatype_string(COLUMNS)
    if clash := {*keep} & {*own.fieldNames()}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    taken = files.select(*dict.fromkeys([*keep, media]))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in taken.schema if f.name in keep), *own])
    return taken.mapInArrow(partial(_read, media=media, schema=to_arrow_schema(schema)), schema)


def store_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_media: bool = True) -> DataFrame:
    """keep columns, n_bytes, the media file of each text (with_media) and what is read back from it, once the files are written to the shared folder."""
    if clash := {*keep} & {"n_bytes", "media", *T._parse_datatype_string(COLUMNS).fieldNames()}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    files = Written(write_media(docs, text, keep), "media")
    if with_media:
        return read_media(files.read(), keep=(*keep, "n_bytes", "media"))
    out = Written(read_media(files.read(), keep=(*keep, "n_bytes")), "features")
    files.drop()
    return out.read()


def _packets(batches: Iterator[pa.RecordBatch], media: str, kept: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, data in enumerate(batch.column(media)):
            data = data.as_py()
            if data is None:
                continue
            row = batch.slice(i, 1)
            try:
                packets = parse(data).packets
            except ValueError:
                packets = None
            count = 1 if packets is None else len(packets)
            own = {n: pa.nulls(1, schema.field(n).type) if packets is None else pa.array([getattr(p, n) for p in packets], schema.field(n).type) for n in Packet._fields}
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else row.column(f.name).take(pa.array([0] * count)) for f in schema], schema=schema)


def packet_table(files: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each packet: track, timestamp_ns, offset, size, cluster, keyframe; one row of nulls for damaged media."""
    own = T._parse_datatype_string("track bigint, timestamp_ns bigint, offset bigint, size bigint, cluster bigint, keyframe boolean")
    taken = files.select(*dict.fromkeys([*keep, media]))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in taken.schema if f.name in keep), *own])
    return taken.where(F.col(media).isNotNull()).mapInArrow(partial(_packets, media=media, kept=list(keep), schema=to_arrow_schema(schema)), schema)
