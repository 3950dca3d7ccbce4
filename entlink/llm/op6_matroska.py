"""Matroska media columns: write samples as packets, parse files into packet tables.

The parser reads any file of EBML elements: identifiers and sizes of one to eight bytes, sizes
left unknown (live streams), clusters, simple blocks and block groups, all four kinds of lacing,
and cues. It never copies frames; a packet is a byte range of the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, table, text_batches

# Element identifiers of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3
LACING_NAMES = ("none", "xiph", "fixed", "ebml")

FRAME = 192  # bytes of a frame of the query's track: 24 ms of 8-bit mono samples at 8 kHz
FRAME_MS = 24


@dataclass
class Packet:
    track: int
    timestamp: int  # ns
    offset: int
    length: int
    keyframe: bool
    cluster: int
    block: int
    lacing: int


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # ns, track, byte offset of the cluster
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: int = 0
    blocks: int = 0
    doc_type: str = ""


def size_code(n: int, width: int = 0) -> bytes:
    """``n`` as a variable-length size; the all-ones value of a width is reserved."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_code(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], mixed: int = EBML_LACING) -> tuple[int, bytes]:
    """Kind of lacing and body of a block of ``frames``; ``mixed`` is used for unequal sizes."""
    sizes = [len(x) for x in frames]
    if len(frames) == 1:
        return NO_LACING, frames[0]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        kind = FIXED_LACING
    elif mixed == XIPH_LACING:
        kind = XIPH_LACING
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    else:
        kind = EBML_LACING
        head += size_code(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += size_code(b - a + (1 << 7 * width - 1) - 1, width)
    return kind, head + b"".join(frames)


def mux(frames: list[bytes], frame_ms: int = FRAME_MS, per_block: int = 8, per_cluster: int = 64, mixed: int = EBML_LACING) -> bytes:
    """A Matroska file with one 8-bit PCM track of ``frames``, each ``frame_ms`` long."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(len(frames) * frame_ms))) + element(MUXING_APP, b"entlink") + element(WRITING_APP, b"entlink"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", 8000.0)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, frame_ms * 1_000_000) + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    step = per_block * per_cluster
    for first in range(0, len(frames), step):
        begin = first * frame_ms
        body = [uint(CLUSTER_TIMESTAMP, begin)]
        for i in range(first, min(first + step, len(frames)), per_block):
            kind, data = lace(frames[i : min(i + per_block, first + step)], mixed)
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", i * frame_ms - begin, 0x80 | kind << 1) + data))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, begin) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    if cues:
        parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def _vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """Value (-1: unknown), width and next offset."""
    if at >= len(data):
        raise ValueError("file ends within an element")
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length number at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, width, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), width, at + width


def elements(data: bytes, at: int, end: int, stop: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """Identifier, offset, begin and end of the body of each child; unknown sizes end where ``stop`` begins."""
    while at < end:
        begin = at
        ident, _, at = _vint(data, at, keep_marker=True)
        n, _, at = _vint(data, at)
        if n < 0:
            until, inner = end, at
            if ident != SEGMENT:
                while inner < end:
                    child, _, x = _vint(data, inner, keep_marker=True)
                    if child in stop:
                        until = inner
                        break
                    m, _, x = _vint(data, x)
                    inner = x + m if m >= 0 else end
        else:
            until = at + n
            if until > end:
                raise ValueError(f"element at byte {begin} passes the end of its parent")
        yield ident, begin, at, until
        at = until


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _block(data: bytes, a: int, b: int, media: Media, base: int, scale: int, keyframe: bool | None, duration: int) -> None:
    track, _, a = _vint(data, a)
    relative, flags = struct.unpack_from(">hB", data, a)
    a += 3
    kind, sizes = flags >> 1 & 3, []
    if kind:
        count = data[a] + 1
        a += 1
        if kind == XIPH_LACING:
            for _ in range(count - 1):
                n = 0
                while data[a] == 255:
                    n, a = n + 255, a + 1
                sizes.append(n + data[a])
                a += 1
        elif kind == EBML_LACING:
            n, _, a = _vint(data, a)
            sizes = [n][: count - 1]
            for _ in range(count - 2):
                code, width, a = _vint(data, a)
                if code < 0:
                    code = (1 << 7 * width) - 1
                n += code - ((1 << 7 * width - 1) - 1)
                sizes.append(n)
        else:
            if (b - a) % count:
                raise ValueError("frames of fixed lacing differ in size")
            sizes = [(b - a) // count] * (count - 1)
    sizes.append(b - a - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing passes the end of its block")
    each = media.tracks.get(track, {}).get("default_duration", 0) or (duration * scale // len(sizes) if duration else 0)
    key = bool(flags & 0x80) if keyframe is None else keyframe
    if (base + relative) * scale + len(sizes) * each >= 1 << 63:
        raise ValueError("a timestamp needs more than 64 bits")
    for i, n in enumerate(sizes):
        media.packets.append(Packet(track, (base + relative) * scale + i * each, a, n, key, media.clusters - 1, media.blocks, kind))
        a += n
    media.blocks += 1


def parse(data: bytes) -> Media:
    """All packets, cues and tracks of a file; an empty file has none. Raises ValueError on damage, and nothing else."""
    try:
        return _parse(data)
    except (KeyError, IndexError, struct.error) as e:  # a needed element, a lace's size or a block's head is missing
        raise ValueError(f"damaged or incomplete element: {e!r}") from e


def _parse(data: bytes) -> Media:
    media, scale = Media(), 1_000_000
    for ident, _, a, b in elements(data, 0, len(data)):
        if ident == EBML:
            for k, _, c, d in elements(data, a, b):
                if k == DOC_TYPE:
                    media.doc_type = data[c:d].decode("ascii", "replace")
        elif ident == SEGMENT:
            cues = []
            for k, _, c, d in elements(data, a, b, TOP_LEVEL):
                if k == INFO:
                    for m, _, e, f in elements(data, c, d):
                        if m == TIMESTAMP_SCALE:
                            scale = _number(data, e, f)
                elif k == TRACKS:
                    for m, _, e, f in elements(data, c, d):
                        if m == TRACK_ENTRY:
                            found = {n: (g, h) for n, _, g, h in elements(data, e, f)}
                            number = _number(data, *found[TRACK_NUMBER])
                            media.tracks[number] = {
                                "codec": data[slice(*found[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in found else "",
                                "default_duration": _number(data, *found[DEFAULT_DURATION]) if DEFAULT_DURATION in found else 0,
                            }
                elif k == CLUSTER:
                    media.clusters += 1
                    base = 0
                    for m, _, e, f in elements(data, c, d):
                        if m == CLUSTER_TIMESTAMP:
                            base = _number(data, e, f)
                        elif m == SIMPLE_BLOCK:
                            _block(data, e, f, media, base, scale, None, 0)
                        elif m == BLOCK_GROUP:
                            inner = {n: (g, h) for n, _, g, h in elements(data, e, f)}
                            if BLOCK in inner:
                                length = _number(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else 0
                                _block(data, *inner[BLOCK], media, base, scale, 0xFB not in inner, length)
                elif k == CUES:
                    for m, _, e, f in elements(data, c, d):
                        if m == CUE_POINT:
                            when, places = 0, []
                            for n, _, g, h in elements(data, e, f):
                                if n == CUE_TIME:
                                    when = _number(data, g, h)
                                elif n == CUE_POSITIONS:
                                    got = {o: _number(data, i, j) for o, _, i, j in elements(data, g, h)}
                                    places.append((got.get(CUE_TRACK, 0), a + got.get(CUE_CLUSTER, 0)))
                            cues += [(when, *x) for x in places]
            media.cues += [(t * scale, track, at) for t, track, at in cues]
    return media


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with spaces to a positive multiple of a frame, and the length before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` and ``media``: each whole text as the frames of a Matroska file (null: empty text).

    One row for each row, of null and repeated ids too; equal texts give equal files; other columns are ignored.
    """
    need(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [payload(x) for x in batch.column(1).to_pylist()]
            files = [mux([data[i : i + FRAME] for i in range(0, len(data), FRAME)]) for data, _ in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "media"])

    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: its file's id, number, track, timestamp (ns), byte range, cluster, lacing and cue flag.

    Null, empty and packet-free files give no rows. ``cued``: a cue points to the packet's cluster
    at its time. A damaged file raises an error. Rows that repeat an id give the packets of each file,
    null ids stay null, packets of equal timestamps keep the order of the file; other columns are ignored.
    """
    need(media, [id_col, media_col])
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "packet", "track", "timestamp_ns", "offset", "length", "keyframe", "cluster", "lacing", "cued"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                got = parse(data or b"")
                cued = {(t, track) for t, track, _ in got.cues}
                rows = [(i, p.track, p.timestamp, p.offset, p.length, p.keyframe, p.cluster, LACING_NAMES[p.lacing], (p.timestamp, p.track) in cued) for i, p in enumerate(got.packets)]
                for k in range(0, len(rows), 65_536):
                    part = rows[k : k + 65_536]
                    columns = [pa.array([ident.as_py()] * len(part), batch.schema.field(0).type)]
                    columns += [pa.array(x, t) for x, t in zip(zip(*part, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{id_col} {kind}, packet int, track int, timestamp_ns long, offset long, length long, keyframe boolean, cluster int, lacing string, cued boolean"
    return media.select(id_col, media_col).mapInArrow(run, schema)


def digest(data: bytes) -> tuple:
    """Payload joined from the packets' byte ranges, and what the file's structure shows."""
    got = parse(data)
    view = memoryview(data)
    joined = b"".join(view[p.offset : p.offset + p.length] for p in got.packets)
    kinds = "+".join(sorted({LACING_NAMES[p.lacing] for p in got.packets}))
    last = got.packets[-1].timestamp // 1_000_000 if got.packets else 0
    feature = f"packets={len(got.packets)};blocks={got.blocks};clusters={got.clusters};cues={len(got.cues)};lacing={kinds};last_ms={last};mean={int(np.frombuffer(joined, np.uint8).sum(dtype=np.uint64)) / max(1, len(joined)):.6f}"
    return len(joined), hashlib.sha256(joined).hexdigest(), zlib.crc32(joined[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a Matroska column, read back packet by packet; a null text is an empty one."""
    media = media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(x) for x in batch.column(2).to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").select(
        F.col("doc_id").cast("long").alias("doc_id"), *names[1:]
    )
