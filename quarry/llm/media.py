"""ISO media containers in a column: store bytes losslessly as raw 8-bit video, and read any such file's tables.

``build`` writes ftyp, moov and mdat; frames are 64x1 grey pixels of 8 bits, every eighth one a sync frame.
``tracks`` walks the nested boxes and decodes the sample tables (stsd, stts, stsc, stsz/stz2, stco/co64, stss) and
those of movie fragments (trex, tfhd, trun) to codec, duration and the byte ranges of all and of sync samples,
without touching what the samples hold.  ``store`` keeps container, codec, duration and keyframe ranges as columns,
``digests`` reads such a table.

Edge cases: null text is empty and is padded to one frame of zeros; a null or damaged container gives a row with
``error`` and no tables, and boxes nested deeper than ``DEPTH``, places outside the file and a timescale of 0 are
damage; texts of any length are stored; equal bytes give equal containers; null and repeated ids are rows like others;
extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized

FRAME, GOP, PER_CHUNK, RATE = 64, 8, 256, 25
DEPTH = 32  # boxes within boxes
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < (1 << 32) - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")
_STSD = _full(b"stsd", struct.pack(">I", 1), box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", FRAME, 1, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1)))
_HEAD = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0")
_VMHD = _full(b"vmhd", bytes(8), flags=1)
_DINF = box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))


def build(payload: bytes) -> bytes:
    """A container whose frames are ``payload``, a positive multiple of FRAME bytes."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise ValueError("the payload must be a positive multiple of the frame size")
    whole, last = divmod(n, PER_CHUNK)
    chunks = whole + bool(last)
    runs = ([(1, PER_CHUNK, 1)] if whole else []) + ([(whole + 1, last, 1)] if last else [])
    stsc = _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs))
    sync = np.arange(1, n + 1, GOP, dtype=">u4")
    wide = len(payload) + (1 << 20) + 4 * len(sync) + 8 * chunks >= 1 << 32
    head = 16 if wide else 8

    def moov(first: int) -> bytes:
        at = (first + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * FRAME)).astype(">u8" if wide else ">u4").tobytes()
        stbl = box(b"stbl", _STSD, _full(b"stts", struct.pack(">III", 1, n, 1)), stsc, _full(b"stsz", struct.pack(">II", FRAME, n)), _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at), _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()))
        mdia = box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, n, 0x55C4, 0), version=1), _HEAD, box(b"minf", _VMHD, _DINF, stbl))
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhh", 0, 0, 0, 0), _MATRIX, struct.pack(">II", FRAME << 16, 1 << 16), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    made = moov(len(_FTYP) + len(moov(0)) + head)
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    return _FTYP + made + mdat + payload


class Malformed(ValueError):
    pass


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Kind, body start and body end of the boxes between two offsets."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise Malformed("box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise Malformed("box header is cut off")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise Malformed(f"box {kind!r} runs over its parent")
        yield kind, start + head, start + size
        start += size


def _walk(data: bytes, start: int, end: int, depth: int = 0) -> dict:
    """Bodies of the boxes by kind; for those that nest, the same of what they hold."""
    if depth > DEPTH:
        raise Malformed("boxes are nested too deep")
    into: dict = {}
    for kind, a, b in boxes(data, start, end):
        into.setdefault(kind, []).append(_walk(data, a, b, depth + 1) if kind in _NESTED else (a, b))
    return into


def _ints(data: bytes, at: int, n: int, kind: str) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > len(data):
        raise Malformed("table is cut off")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def tracks(data: bytes) -> list[dict]:
    """Codec, timescale, duration, and offset, size and sync flag of each sample, for each track."""
    try:
        movie, fragments = None, []
        at = 0
        for kind, a, b in boxes(data):
            if kind == b"moov" and movie is None:
                movie = _walk(data, a, b)
            elif kind == b"moof":
                fragments.append((at, _walk(data, a, b)))
            at = b
        if movie is None:
            raise Malformed("no moov box")
        found = {_track_id(data, t): _track(data, t) for t in movie.get(b"trak", [])}
        defaults = {}
        for a, _ in (x for m in movie.get(b"mvex", []) for x in m.get(b"trex", [])):
            i, _, *rest = struct.unpack_from(">5I", data, a + 4)
            defaults[i] = rest  # duration, size, flags
        for start, moof in fragments:
            _fragment(data, start, moof, found, defaults)
        return list(found.values())
    except (KeyError, IndexError, struct.error) as e:
        raise Malformed(f"missing or short box: {e}") from None


def _track_id(data: bytes, trak: dict) -> int:
    a = trak[b"tkhd"][0][0]
    return struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]


def _fragment(data: bytes, start: int, moof: dict, found: dict[int, dict], defaults: dict[int, list[int]]) -> None:
    """Add the samples of a movie fragment to its tracks."""
    after = start
    for traf in moof.get(b"traf", []):
        a = traf[b"tfhd"][0][0]
        flags, track = struct.unpack_from(">II", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
        if track not in found:
            raise Malformed("a fragment of a track that is not there")
        at, base = a + 8, start if flags & 0x20000 else after
        if flags & 1:
            (base,), at = struct.unpack_from(">Q", data, at), at + 8
        at += 4 * bool(flags & 2)
        own = list(defaults.get(track, [0, 0, 0]))
        for k, bit in enumerate((8, 0x10, 0x20)):
            if flags & bit:
                (own[k],), at = struct.unpack_from(">I", data, at), at + 4
        for a, _ in traf.get(b"trun", []):
            run, n = struct.unpack_from(">II", data, a)
            run &= 0xFFFFFF
            at, place = a + 8, after if a != traf[b"trun"][0][0] else base
            if run & 1:
                (shift,), at = struct.unpack_from(">i", data, at), at + 4
                place = base + shift
            first = own[2]
            if run & 4:
                (first,), at = struct.unpack_from(">I", data, at), at + 4
            fields = [k for k, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if run & bit]
            if not fields and n > len(data):
                raise Malformed("more samples than bytes")
            table = _ints(data, at, n * len(fields), ">u4").reshape(n, len(fields))
            of = lambda k: table[:, fields.index(k)] if k in fields else np.full(n, own[k], np.int64)  # noqa: B023, E731
            sizes, marks = of(1), of(2)
            if n and run & 4 and 2 not in fields:
                marks[0] = first
            offsets = place + np.cumsum(sizes) - sizes
            after = int(place + sizes.sum())
            if n and (int(offsets.min()) < 0 or after > len(data)):
                raise Malformed("a sample lies outside the file")
            t = found[track]
            t["offsets"], t["sizes"], t["sync"] = (np.concatenate((t[k], v)) for k, v in (("offsets", offsets), ("sizes", sizes), ("sync", marks & 0x10000 == 0)))
            t["played"] += int(of(0).sum())


def _track(data: bytes, trak: dict) -> dict:
    mdia = trak[b"mdia"][0]
    stbl = mdia[b"minf"][0][b"stbl"][0]
    a = mdia[b"mdhd"][0][0]
    scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    if not scale:
        raise Malformed("a timescale of 0")
    codec = data[(a := stbl[b"stsd"][0][0]) + 12 : a + 16].decode("latin-1")
    if b"stsz" in stbl:
        a = stbl[b"stsz"][0][0]
        fixed, n = struct.unpack_from(">II", data, a + 4)
        if not fixed:
            sizes = _ints(data, a + 12, n, ">u4")
        elif n > len(data):
            raise Malformed("more samples than bytes")
        else:
            sizes = np.full(n, fixed, np.int64)
    else:
        a = stbl[b"stz2"][0][0]
        bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits == 4:
            raw = _ints(data, a + 12, (n + 1) // 2, "u1")
            sizes = np.column_stack((raw >> 4, raw & 15)).ravel()[:n]
        else:
            sizes = _ints(data, a + 12, n, ">u2" if bits == 16 else "u1")
    if b"co64" in stbl:
        a = stbl[b"co64"][0][0]
        chunks = _ints(data, a + 8, struct.unpack_from(">I", data, a + 4)[0], ">u8")
    else:
        a = stbl[b"stco"][0][0]
        chunks = _ints(data, a + 8, struct.unpack_from(">I", data, a + 4)[0], ">u4")
    a = stbl[b"stsc"][0][0]
    runs = _ints(data, a + 8, 3 * struct.unpack_from(">I", data, a + 4)[0], ">u4").reshape(-1, 3)
    ends = np.append(runs[1:, 0], len(chunks) + 1) if len(runs) else np.zeros(0, np.int64)
    if np.any(ends <= runs[:, 0]) or (len(runs) and runs[0, 0] != 1):
        raise Malformed("stsc runs are out of order")
    per = np.repeat(runs[:, 1], ends - runs[:, 0])
    if per.sum() != n or len(per) != len(chunks):
        raise Malformed("stsc and stsz disagree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    if np.any(per < 1):
        raise Malformed("a chunk without samples")
    offsets = np.repeat(chunks - before[first], per) + before if n else before
    if n and (int(offsets.min()) < 0 or int((offsets + sizes).max()) > len(data)):
        raise Malformed("a sample lies outside the file")
    sync = np.ones(n, bool)
    if b"stss" in stbl:
        a = stbl[b"stss"][0][0]
        k = _ints(data, a + 8, struct.unpack_from(">I", data, a + 4)[0], ">u4")
        if len(k) and (k.min() < 1 or k.max() > n):
            raise Malformed("a sync sample that is not there")
        sync[:] = False
        sync[k - 1] = True
    a = stbl[b"stts"][0][0]
    times = _ints(data, a + 8, 2 * struct.unpack_from(">I", data, a + 4)[0], ">u4").reshape(-1, 2)
    if times[:, 0].sum() != n:
        raise Malformed("stts and stsz disagree")
    return {"codec": codec, "timescale": scale, "duration": duration, "played": int((times[:, 0] * times[:, 1]).sum()), "offsets": offsets, "sizes": sizes, "sync": sync}


def _merge(offsets: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    if not len(offsets):
        return []
    new = np.flatnonzero(np.append(True, offsets[1:] != offsets[:-1] + sizes[:-1]))
    return list(zip(offsets[new].tolist(), np.add.reduceat(sizes, new).tolist(), strict=True))


def stored(data: bytes, track: dict) -> bytes:
    """What the samples of a track hold, in their order, as the tables locate it."""
    return b"".join(data[a : a + n] for a, n in _merge(track["offsets"], track["sizes"]))


def sync_ranges(track: dict) -> list[tuple[int, int]]:
    """Offset and length of each sync sample."""
    return list(zip(track["offsets"][track["sync"]].tolist(), track["sizes"][track["sync"]].tolist(), strict=True))


def feature(track: dict) -> str:
    ranges = np.column_stack((track["offsets"][track["sync"]], track["sizes"][track["sync"]])).astype("<i8")
    return f"codec={track['codec']};seconds={track['played'] / track['timescale']:.2f};samples={len(track['sizes'])};sync={len(ranges)};first={ranges[0, 0] if len(ranges) else -1};last={ranges[-1, 0] if len(ranges) else -1};ranges={zlib.crc32(ranges.tobytes()):08x}"


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % FRAME or (FRAME if not raw else 0))


_RANGES = "array<struct<offset:long,length:long>>"
_RANGE = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))


def to_media(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_bytes, media: each text's UTF-8, padded with zero bytes to whole frames, as a container."""
    t = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sized(batch, 1):
                raw = [(x or "").encode() for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array([build(pad(x)) for x in raw], pa.binary())], [id_col, "n_bytes", "media"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {t}, n_bytes long, media binary")


def probe(df: DataFrame, id_col: str, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, track, codec, timescale, duration, n_samples, keyframes (offset, length), error; and columns to keep."""
    kinds = dict(df.dtypes)
    names = [id_col, *keep, "track", "codec", "timescale", "duration", "n_samples", "keyframes", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sized(batch, 1 + len(keep)):
                rows = []
                for i, data in enumerate(b.column(1 + len(keep)).to_pylist()):
                    try:
                        rows += [(i, k, x["codec"], x["timescale"], x["played"], len(x["sizes"]), [{"offset": o, "length": n} for o, n in sync_ranges(x)], None) for k, x in enumerate(tracks(data or b""))]
                    except Malformed as e:
                        rows.append((i, None, None, None, None, None, None, str(e)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
                at = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(1 + len(keep))), *(pa.array(c, k) for c, k in zip(cols[1:], (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _RANGE, pa.string()), strict=True))], names)

    own = "".join(f"`{c}` {kinds[c]}, " for c in (id_col, *keep))
    return df.select(id_col, *keep, media_col).mapInArrow(run, f"{own}track long, codec string, timescale long, duration long, n_samples long, keyframes {_RANGES}, error string")


def store(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_bytes, media, and what ``probe`` says of it: codec, timescale, duration, n_samples, keyframes."""
    return probe(to_media(df, id_col, text_col), id_col, keep=("n_bytes", "media")).drop("track", "error")


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(table: DataFrame, id_col: str, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, columns to keep, and digests of what the first track of each container of a stored table holds."""
    kinds = dict(table.dtypes)
    names = [id_col, *keep, *(x.split()[0] for x in DIGEST.split(", "))]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sized(batch, 1 + len(keep)):
                rows = []
                for media in b.column(1 + len(keep)).to_pylist():
                    track = tracks(media)[0]
                    back = stored(media, track)
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(1 + len(keep))), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], names)

    own = "".join(f"`{c}` {kinds[c]}, " for c in (id_col, *keep))
    return table.select(id_col, *keep, F.col(media_col)).mapInArrow(run, own + DIGEST)
