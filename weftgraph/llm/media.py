"""Media columns: ISO base media files, written, walked and indexed without decoding.

`mux` stores a payload as the samples of one 8-bit PCM track, with a sync sample wherever
a line starts; `walk` lists the nested boxes of any ISO media file; `tracks` decodes sample
tables, plain or compact, and movie fragments into codec, duration, sample and keyframe
byte ranges. Payload bytes are only sliced, never decoded.

Defined results: null text is empty and stores 64 zero bytes; a file without a readable
track gives codec '' and no ranges; truncated boxes end the walk at the last whole box; a
track whose tables are cut off, contradict each other or point outside the file is left
out, and a fragment that does ends its track's fragments.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftgraph.llm.common import map_texts, table

UNIT = 64  # bytes that a payload is padded to; also one media sample
CHUNK = 64  # samples in a chunk
RATE = 8000  # media timescale: 8-bit samples a second
#: Boxes that hold boxes, by the container format.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"})

FIELDS = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("codec", T.StringType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("keyframe_ranges", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, version_flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version_flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
_DINF = _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1)))
_STSD = _full(b"stsd", 0, struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16)))
_HDLR = _full(b"hdlr", 0, bytes(4), b"soun", bytes(12), b"bytes\0")
_SMHD = _full(b"smhd", 0, bytes(4))


def padded(data: bytes) -> bytes:
    return data + bytes(max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def sync_samples(payload: bytes) -> list[int]:
    """Numbers, from 1, of the samples in which a line starts."""
    starts = np.flatnonzero(np.frombuffer(payload[:-1], np.uint8) == 10) + 1
    return (np.unique(np.append(starts, 0) // UNIT) + 1).tolist()


def mux(payload: bytes) -> bytes:
    """A file of one track whose samples are the payload's UNIT-byte pieces."""
    n = len(payload) // UNIT
    ticks = len(payload)
    chunks = -(-n // CHUNK)
    rest = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, rest, 1)] * (chunks == 1 or rest != CHUNK)
    keys = sync_samples(payload)
    long = ticks >= 2**32 or len(payload) >= 2**31

    def moov(start: int) -> bytes:
        offsets = range(start, start + len(payload), CHUNK * UNIT)
        co = _full(b"co64", 0, struct.pack(f">I{chunks}Q", chunks, *offsets)) if long else _full(b"stco", 0, struct.pack(f">I{chunks}I", chunks, *offsets))
        stbl = _box(
            b"stbl",
            _STSD,
            _full(b"stts", 0, struct.pack(">III", 1, n, UNIT)),
            _full(b"stss", 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", 0, struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", 0, struct.pack(">II", UNIT, n)),
            co,
        )
        time = struct.pack(">QQIQ", 0, 0, RATE, ticks)
        mdhd = _full(b"mdhd", 1 << 24, time, struct.pack(">HH", 0x55C4, 0))
        mvhd = _full(b"mvhd", 1 << 24, time, struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        tkhd = _full(b"tkhd", 1 << 24 | 7, struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, _HDLR, _box(b"minf", _SMHD, _DINF, stbl))))

    head = len(_FTYP) + len(moov(0)) + (16 if len(payload) >= 2**32 - 8 else 8)
    return _FTYP + moov(head) + _box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, start, body start, end) of each box, parents first, of any depth."""
    open_ends = [len(data) if end is None else end]
    while open_ends:
        if start + 8 > open_ends[-1]:
            start = open_ends.pop()
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > open_ends[-1]:
                start = open_ends.pop()
                continue
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = open_ends[-1] if size == 0 else start + size
        if stop > open_ends[-1] or stop < body:
            start = open_ends.pop()
            continue
        yield kind, start, body, stop
        if kind in CONTAINERS:
            open_ends.append(stop)
            start = body
        else:
            start = stop


class Broken(Exception):
    """Tables that cannot be."""


class _Reader:
    """Big-endian numbers of a file, by box."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def number(self, at: int, code: str = "I") -> int:
        try:
            return struct.unpack_from(">" + code, self.data, at)[0]
        except struct.error:
            raise Broken from None

    def numbers(self, box: tuple[int, int], skip: int, count: int, dtype: str) -> np.ndarray:
        """`count` numbers that must lie in their box."""
        start, end = box
        width = np.dtype(dtype).itemsize
        if start + skip + count * width > end:
            raise Broken
        return np.frombuffer(self.data, dtype, count, start + skip)

    def counted(self, box: tuple[int, int], dtype: str, columns: int = 1) -> np.ndarray:
        """The entries of a table that begins with their number, as 64-bit integers."""
        n = self.number(box[0] + 4)
        return self.numbers(box, 8, n * columns, dtype).astype(np.int64).reshape(n, columns) if columns > 1 else self.numbers(box, 8, n, dtype).astype(np.int64)


def _sizes(r: _Reader, boxes: dict) -> tuple[int, int, np.ndarray | None]:
    """(samples, the size of all or 0, sizes of each)."""
    if b"stsz" in boxes:
        same, n = r.number(boxes[b"stsz"][0] + 4), r.number(boxes[b"stsz"][0] + 8)
        return n, same, None if same else r.numbers(boxes[b"stsz"], 12, n, ">u4").astype(np.int64)
    bits, n = r.number(boxes[b"stz2"][0] + 7, "B"), r.number(boxes[b"stz2"][0] + 8)
    if bits not in (4, 8, 16):
        raise Broken
    if bits == 4:
        pairs = r.numbers(boxes[b"stz2"], 12, (n + 1) // 2, ">u1")
        return n, 0, np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1)[:n].astype(np.int64)
    return n, 0, r.numbers(boxes[b"stz2"], 12, n, f">u{bits // 8}").astype(np.int64)


def _table_samples(r: _Reader, boxes: dict) -> tuple[int, np.ndarray, np.ndarray]:
    """(samples, chunk ranges, keyframe ranges) by the sample tables."""
    n, same, sizes = _sizes(r, boxes)
    offsets = r.counted(boxes[b"co64"], ">u8") if b"co64" in boxes else r.counted(boxes[b"stco"], ">u4")
    runs = r.counted(boxes[b"stsc"], ">u4", 3)
    if same * n > len(r.data) or len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any()):
        raise Broken
    first = np.append(runs[:, 0] - 1, max(len(offsets), runs[-1, 0] - 1 if len(runs) else 0))
    per = np.repeat(runs[:, 1], np.diff(np.minimum(first, len(offsets))))
    upto = np.minimum(np.cumsum(np.minimum(per, n)), n)  # a chunk holds at most what samples are left
    before = np.concatenate(([0], upto[:-1])) if len(upto) else upto
    if (upto[-1] if len(upto) else 0) != n:
        raise Broken
    total = None if sizes is None else np.concatenate(([0], np.cumsum(sizes)))
    at = lambda k: k * same if total is None else total[k]  # bytes of the samples before k
    starts = offsets[: len(per)]
    chunks = np.stack([starts, starts + at(upto) - at(before)], axis=1)
    if (chunks < 0).any() or (chunks > len(r.data)).any():
        raise Broken
    if b"stss" in boxes:
        keys = r.counted(boxes[b"stss"], ">u4") - 1
        keys = np.unique(keys[(keys >= 0) & (keys < n)])
    else:
        keys = np.arange(n)
    in_chunk = np.searchsorted(upto, keys, side="right")
    begin = starts[in_chunk] + at(keys) - at(before[in_chunk])
    return n, chunks, np.stack([begin, begin + at(keys + 1) - at(keys)], axis=1)


# Flags of fragment headers, track runs and samples.
_TFHD = {"base": 0x1, "description": 0x2, "duration": 0x8, "size": 0x10, "flags": 0x20, "from_moof": 0x20000}
_TRUN = {"offset": 0x1, "first_flags": 0x4, "duration": 0x100, "size": 0x200, "flags": 0x400, "time": 0x800}
_NOT_SYNC = 0x10000


def _fragment(r: _Reader, traf: list, moof: int, after: int, defaults: dict) -> tuple[int, int, np.ndarray, np.ndarray, int]:
    """(samples, duration, run ranges, keyframe ranges, end of data) of one track fragment."""
    head = next(b for k, b in traf if k == b"tfhd")
    flags, at = r.number(head[0]) & 0xFFFFFF, head[0] + 8
    base = moof if flags & _TFHD["from_moof"] or after < 0 else after
    if flags & _TFHD["base"]:
        base, at = r.number(at, "Q"), at + 8
    at += 4 * bool(flags & _TFHD["description"])
    own = dict(defaults)
    for name in ("duration", "size", "flags"):
        if flags & _TFHD[name]:
            own[name], at = r.number(at), at + 4
    total = ticks = 0
    chunks, keys, data_at = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)], base
    for kind, box in traf:
        if kind != b"trun":
            continue
        flags, n, at = r.number(box[0]) & 0xFFFFFF, r.number(box[0] + 4), box[0] + 8
        if flags & _TRUN["offset"]:
            data_at, at = base + r.number(at, "i"), at + 4
        first_flags = None
        if flags & _TRUN["first_flags"]:
            first_flags, at = r.number(at), at + 4
        fields = [f for f in ("duration", "size", "flags", "time") if flags & _TRUN[f]]
        if not fields and (n > len(r.data) or own["size"] * n > len(r.data)):
            raise Broken
        rows = r.numbers(box, at - box[0], n * len(fields), ">u4").astype(np.int64).reshape(n, len(fields))
        column = lambda f: rows[:, fields.index(f)] if f in fields else np.full(n, own[f], np.int64)  # noqa: B023, E731
        sizes, marks = column("size"), column("flags").copy()
        if first_flags is not None and n:
            marks[0] = first_flags
        ends = data_at + np.cumsum(sizes)
        if data_at < 0 or n and ends[-1] > len(r.data):
            raise Broken
        sync = (marks & _NOT_SYNC) == 0
        chunks.append(np.array([[data_at, ends[-1] if n else data_at]]))
        keys.append(np.stack([ends - sizes, ends], axis=1)[sync])
        total, ticks, data_at = total + n, ticks + int(column("duration").sum()), int(ends[-1]) if n else data_at
    return total, ticks, np.concatenate(chunks), np.concatenate(keys), data_at


def _track(r: _Reader, boxes: dict[bytes, tuple[int, int]]) -> dict | None:
    """One track from the places of its boxes; None where its tables are absent or broken."""
    if not {b"stsd", b"mdhd", b"stsc"} <= boxes.keys() or not {b"stco", b"co64"} & boxes.keys() or not {b"stsz", b"stz2"} & boxes.keys():
        return None
    try:
        p = boxes[b"mdhd"][0]
        wide = r.number(p, "B") == 1
        scale, length = r.number(p + (20 if wide else 12)), r.number(p + (24 if wide else 16), "Q" if wide else "I")
        codec = r.data[(q := boxes[b"stsd"][0]) + 12 : q + 16].decode("latin-1")
        n, chunks, keys = _table_samples(r, boxes)
        tkhd = boxes.get(b"tkhd")
        number = r.number(tkhd[0] + (20 if r.number(tkhd[0], "B") == 1 else 12)) if tkhd else None
    except Broken:
        return None
    length = 0 if length == (1 << 64 if wide else 1 << 32) - 1 else length  # all ones: not known
    return {"id": number, "codec": codec, "ticks": length, "scale": scale, "n_samples": n, "chunks": [chunks], "keyframes": [keys]}


def tracks(data: bytes) -> list[dict]:
    """All tracks: codec, duration in seconds, sample count, chunk and keyframe ranges (start, end)."""
    r = _Reader(data)
    found: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, dict] = {}
    fragments: list[tuple[int, int, list]] = []  # moof start, number of the moof, boxes of a traf
    trak_end = traf_end = moof = -1
    nth = 0
    for kind, box, start, end in walk(data):
        if kind == b"trak":
            found.append({})
            trak_end = end
        elif kind == b"moof":
            moof, nth = box, nth + 1
        elif kind == b"traf":
            fragments.append((moof, nth, []))
            traf_end = end
        elif kind == b"trex" and end - start >= 24:
            defaults[r.number(start + 4)] = {"duration": r.number(start + 12), "size": r.number(start + 16), "flags": r.number(start + 20)}
        elif start <= traf_end and end <= traf_end:
            fragments[-1][2].append((kind, (start, end)))
        elif start <= trak_end and end <= trak_end:
            found[-1].setdefault(kind, (start, end))
    out = [t for t in (_track(r, boxes) for boxes in found) if t is not None]
    by_id = {t["id"]: t for t in out if t["id"] is not None}
    broken, after, last = set(), -1, -1
    for moof, nth, traf in fragments:
        after, last = (after if nth == last else -1), nth
        try:
            number = r.number(next(b for k, b in traf if k == b"tfhd")[0] + 4)
            t = by_id.get(number)
            n, ticks, chunks, keys, after = _fragment(r, traf, moof, after, defaults.get(number, {"duration": 0, "size": 0, "flags": 0}))
        except (Broken, StopIteration):
            broken |= {number for k, b in traf if k == b"tfhd" and b[0] + 8 <= b[1] for number in [r.number(b[0] + 4)]}
            continue
        if t is not None and number not in broken:
            t["n_samples"] += n
            t["ticks"] += ticks
            t["chunks"].append(chunks)
            t["keyframes"].append(keys)
    return [
        {"codec": t["codec"], "duration": t["ticks"] / t["scale"] if t["scale"] else 0.0, "n_samples": t["n_samples"], "chunks": np.concatenate(t["chunks"]).tolist(), "keyframes": np.concatenate(t["keyframes"]).tolist()}
        for t in out
    ]


def index_media(data: bytes) -> dict:
    """The first track, or one without samples."""
    return next(iter(tracks(data)), {"codec": "", "duration": 0.0, "n_samples": 0, "chunks": [], "keyframes": []})


def payload_of(data: bytes, index: dict) -> bytes:
    return b"".join(data[a:b] for a, b in index["chunks"])


def _store():
    def store(texts):
        out: dict[str, list] = {f.name: [] for f in FIELDS}
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            media = mux(padded(raw))
            index = index_media(media)
            back = payload_of(media, index)
            keys = index["keyframes"]
            digest = hashlib.sha256(",".join(f"{a}-{b}" for a, b in keys).encode()).hexdigest()[:16]
            feature = f"{index['codec'].strip()};{index['duration']:.3f}s;{index['n_samples']} samples;{len(keys)} keyframes;{digest}"
            row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, index["codec"], index["duration"], index["n_samples"], keys)
            for f, v in zip(FIELDS, row, strict=True):
                out[f.name].append(v)
        return out

    return store


def media_columns(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with the columns of FIELDS, read back from the stored media file of each text."""
    return map_texts(docs, text_col, FIELDS, _store, keep)


TRACKS = T.StructType(
    [
        T.StructField(
            "tracks",
            T.ArrayType(T.StructType([T.StructField("codec", T.StringType()), T.StructField("duration_s", T.DoubleType()), T.StructField("n_samples", T.LongType()), T.StructField("keyframe_ranges", T.ArrayType(T.ArrayType(T.LongType())))])),
        )
    ]
)


def _index_files():
    def index(files):
        def one(f):
            return [{"codec": t["codec"], "duration_s": t["duration"], "n_samples": t["n_samples"], "keyframe_ranges": t["keyframes"]} for t in tracks(bytes(f or b""))]

        return {"tracks": [one(f) for f in files]}

    return index


def index_files(files: DataFrame, content_col: str = "content", keep: list[str] | None = None) -> DataFrame:
    """`files` with `tracks` of each ISO media file in a binary column; no payload is decoded or kept.

    Null, empty and broken files have no tracks.
    """
    return map_texts(files, content_col, TRACKS, _index_files, keep)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_columns(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", *FIELDS.names)
