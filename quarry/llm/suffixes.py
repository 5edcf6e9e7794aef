"""Exact removal of repeated substrings: bytes covered by a ``depth``-byte string that starts anywhere else as well.

Partition.  Every window of ``depth`` bytes has an anchor, its k-gram of least hash (the leftmost on ties), which
depends on the window's bytes alone; so equal windows meet under equal anchors.  Neighbouring windows with the same
anchor occurrence form one segment.  Anchors that start one window only need no more work.  Equal segments (by a
128-bit hash of their bytes) become one that stands for several, and all that is left goes to the merge.

Method.  Segments are dealt by anchor into tasks of bounded size; each task sorts the suffixes of its shards, and
merges the shards' Burrows-Wheeler transforms by interleave refinement (``bwt``) into common prefixes and repeated
intervals.

Hot anchors.  Where the different segments of one anchor exceed ``HOT_BYTES``, they are cut by where the anchor stands
in a window: windows with the anchor at one of ``SPANS[0]`` neighbouring places share a core of bytes, and equal windows
have equal cores, so (anchor, place, core) deals them further; what is still hot is cut again to single windows, where
equal keys mean equal strings.  Pieces go through the same merge, and its intervals are carried back to the segments.
So no group is larger than a task should hold, and nothing is capped or sampled.

Edge cases: null text is empty; texts shorter than ``depth`` keep all bytes; null and repeated doc_ids are rows like
others, each judged against all; invalid UTF-8 cannot occur in strings; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import Shard, repeats
from .common import CHUNK, Rolling, Scratch, sized

DEPTH = 200
GRAM = 32
TASK_BYTES = 1 << 20
SHARD_BYTES = 1 << 18
HOT_BYTES = 1 << 19
SPANS = (16, 1)  # places of the anchor that pieces of a hot anchor share, level by level
LONG = 1 << 22  # longer texts are read in overlapping parts


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Where the least key of each ``width`` neighbouring keys stands, the leftmost on ties."""
    # high bits of the key, then the place
    bits = max(1, int(len(key)).bit_length())
    packed = (key >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64)
    low, have = packed, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return (low & np.uint64((1 << bits) - 1)).astype(np.int64)


def segments(data: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """anchor, start, length and place of the anchor, of the segments of one buffer of at least ``depth`` bytes.

    A segment of length n starts n - depth + 1 windows.
    """
    i = np.arange(len(data) - gram + 1)
    key = Rolling(data, 5).ranges(i, i + gram)
    at = _least(key, depth - gram + 1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    length = np.diff(np.append(first, len(at))) + depth - 1
    return key[at[first]], first, length, at[first] - first


def _hashes(parts: list[bytes]) -> np.ndarray:
    """128 bits of each string, as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)


def _parts(raw: bytes, depth: int) -> Iterator[tuple[int, bytes]]:
    """Overlapping parts of a text, so that memory is bounded; each window lies in exactly one."""
    for lo in range(0, max(1, len(raw) - depth + 1), LONG):
        if len(part := raw[lo : lo + LONG + depth - 1]) >= depth:
            yield lo, part


def occurrences(base: DataFrame, depth: int, gram: int) -> DataFrame:
    """doc, k, anchor, c1, c2, start, span, length, place, n: segments; runs of equal neighbours (periodic text) are one row."""
    names = ["doc", "k", "anchor", "c1", "c2", "start", "span", "length", "place", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sized(batch, 2, 1 << 18):
                rows: list[list] = []
                for i, text in enumerate(b.column(2).to_pylist()):
                    for lo, part in _parts(text.encode("utf-8", "replace"), depth):
                        anchor, start, length, place = segments(np.frombuffer(part, np.uint8), depth, gram)
                        c = _hashes([part[x : x + n] for x, n in zip(start.tolist(), length.tolist(), strict=True)])
                        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (c[1:] != c[:-1]).any(axis=1)))
                        last = np.append(new[1:], len(anchor)) - 1
                        rows.append([np.full(len(new), i), anchor[new].view(np.int64), c[new, 0], c[new, 1], lo + start[new], (start + length)[last] - start[new], length[new], place[new], last - new + 1])
                if rows:
                    c = [np.concatenate(x) for x in zip(*rows, strict=True)]
                    at = pa.array(c[0])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(x) for x in c[1:5]), *(pa.array(x, pa.int32()) for x in c[5:])], names)

    return base.where(F.octet_length("text") >= depth).select("doc", "k", "text").mapInArrow(run, "doc long, k long, anchor long, c1 long, c2 long, start long, span int, length int, place int, n int")


def _runs(string: np.ndarray, offset: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """string, lo and hi of the runs of neighbouring windows."""
    key = np.sort(string.astype(np.int64) << 32 | offset)
    new = np.append(True, np.diff(key) > 1)[: len(key)]
    string, offset = key >> 32, key & ((1 << 32) - 1)
    return string[new], offset[new], offset[np.append(new[1:], True)[: len(key)]] + depth


_MARKS = "anchor long, c1 long, c2 long, lo int, hi int"
_KEY = ["anchor", "c1", "c2"]


def merge_task(depth: int):
    """Repeated intervals among the strings (anchor, c1, c2, n, bytes) of one task, by merged transforms."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in _KEY])
        strings, times = table.column("bytes").to_pylist(), table.column("n").to_pylist()
        shards, cut, size = [], [0], 0
        for i, s in enumerate(strings, 1):
            size += len(s)
            if size >= SHARD_BYTES or i == len(strings):
                shards.append(Shard(strings[cut[-1] : i], times[cut[-1] : i], depth))
                cut.append(i)
                size = 0
        found = [(first + string, offset) for first, (string, offset, _) in zip(cut[:-1], repeats(shards, depth), strict=True)]
        at, lo, hi = _runs(*(np.concatenate(x) for x in zip(*found, strict=True)), depth)
        took = table.select(_KEY).take(pa.array(at, pa.int64()))
        return pa.table([*took.columns, pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], [*_KEY, "lo", "hi"])

    return run


def _merged(strings: DataFrame, depth: int) -> DataFrame:
    """Repeated intervals of ``strings(anchor, c1, c2, n, bytes)``, dealt by anchor into tasks."""
    size = strings.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).collect()[0][0]
    tasks = max(1, -(-int(size) // TASK_BYTES))
    return strings.select(*_KEY, "n", "bytes", F.pmod(F.xxhash64("anchor"), F.lit(tasks)).alias("task")).groupBy("task").applyInArrow(merge_task(depth), _MARKS)


def _pieces(strings: DataFrame, depth: int, span: int) -> DataFrame:
    """Strings (anchor, c1, c2, place, n, bytes) cut where the anchor stands in a window, ``span`` places a piece.

    up, u1, u2, lo: the string it is from and where; anchor: key of anchor, place and core; c1, c2: hash of the piece.
    """
    names = ["up", "u1", "u2", "lo", "anchor", "c1", "c2", "place", "n", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sized(batch, 5, 1 << 16):
                own, lo, key, place, parts = [], [], [], [], []
                for i, (anchor, p, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)):
                    windows = len(raw) - depth + 1
                    first = 0
                    while first < windows:  # window w has the anchor at p - w
                        low = (p - first) // span * span
                        after = min(windows, p - low + 1)
                        core = raw[p - low : p - low - span + 1 + depth]
                        own.append(i)
                        lo.append(first)
                        place.append(p - first)
                        key.append(xxhash.xxh3_64_intdigest(core, seed=xxhash.xxh3_64_intdigest(f"{anchor} {low}")))
                        parts.append(raw[first : after - 1 + depth])
                        first = after
                at = pa.array(own, pa.int64())
                c = _hashes(parts)
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(3)), pa.array(lo, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(place, pa.int32()), b.column(4).take(at), pa.array(parts, pa.binary())], names)

    return strings.select(*_KEY, "place", "n", "bytes").mapInArrow(run, "up long, u1 long, u2 long, lo int, anchor long, c1 long, c2 long, place int, n long, bytes binary")


def _repeated(strings: DataFrame, scratch: Scratch, depth: int, spans: tuple[int, ...]) -> DataFrame:
    """Repeated intervals of ``strings(anchor, c1, c2, place, n, bytes)``; strings of hot anchors go on as pieces."""
    if not spans:
        return _merged(strings, depth)
    hot = strings.groupBy("anchor").agg(F.sum(F.octet_length("bytes")).alias("size")).where(F.col("size") > HOT_BYTES).select("anchor")
    hot = scratch.put(hot)
    if hot.isEmpty():
        return _merged(strings, depth)
    marks = _merged(strings.join(hot, "anchor", "left_anti"), depth)
    pieces = scratch.put(_pieces(strings.join(hot, "anchor"), depth, spans[0]))
    one = scratch.put(pieces.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.first("place").alias("place"), F.first("bytes").alias("bytes")))
    again = one.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor")
    inner = scratch.put(_repeated(scratch.put(one.join(again, "anchor")), scratch, depth, spans[1:]))
    back = pieces.drop("bytes").withColumnRenamed("lo", "from").join(inner, _KEY)
    return marks.unionByName(back.select(F.col("up").alias("anchor"), F.col("u1").alias("c1"), F.col("u2").alias("c2"), (F.col("lo") + F.col("from")).alias("lo"), (F.col("hi") + F.col("from")).alias("hi")))


def covered(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, depth: int = DEPTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The texts (doc, k, text) and, for each (doc, k), the intervals of bytes that repeat (spans of lo, hi)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    seen = scratch.put(occurrences(base, depth, gram))
    often = scratch.put(seen.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor"))
    found = scratch.put(seen.join(often, "anchor"))
    scratch.drop(seen, often)
    kinds = found.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min(F.struct("doc", "k", "start", "length", "place")).alias("at"))
    lists = kinds.groupBy(F.col("at.doc").alias("doc"), F.col("at.k").alias("k")).agg(F.collect_list(F.struct("at.start", "at.length", "at.place", *_KEY, "n")).alias("segs"))
    cut = scratch.put(_cut(base.join(lists, base.doc.eqNullSafe(lists.doc) & (base.k == lists.k)).select(base.text, "segs")).dropDuplicates(_KEY))
    marks = scratch.put(_repeated(cut, scratch, depth, SPANS))
    scratch.drop(cut)
    # a run of equal neighbours is repeated as a whole if it is one of more than one, or if its one segment is in all
    spans = found.join(marks, _KEY).select("doc", "k", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.when(F.col("n") > 1, F.col("span")).otherwise(F.col("hi"))).alias("hi"))
    spans = spans.groupBy("doc", "k").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return base, spans


def _cut(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sized(batch, 0):
                rows = []
                for text, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    raw = text.encode("utf-8", "replace")
                    rows += [(s["anchor"], s["c1"], s["c2"], s["place"], s["n"], raw[s["start"] : s["start"] + s["length"]]) for s in segs]
                c = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], [*_KEY, "place", "n", "bytes"])

    return df.mapInArrow(run, "anchor long, c1 long, c2 long, place int, n long, bytes binary")


def _union(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["lo"], x["hi"]) for x in spans or []):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, z) for a, z in out]


def deduplicated(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM, extra: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document, and with keep_text what remains of it.

    Remaining bytes are made text by leaving out characters that a removal cut in two.
    """
    base, spans = covered(docs, scratch, id_col, text_col, depth, gram)
    if extra:
        base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"), *(F.col(c).alias(f"x_{c}") for c in extra)).withColumn("k", F.xxhash64("text"))
    spans = spans.select(F.col("doc").alias("d2"), F.col("k").alias("k2"), "spans")
    joined = base.join(spans, base.doc.eqNullSafe(F.col("d2")) & (base.k == F.col("k2")), "left")
    joined = joined.select("doc", "text", "spans", *(f"x_{c}" for c in extra))
    kinds = dict(joined.dtypes)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if keep_text else []), *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sized(batch, 1, 4 * CHUNK):
                rows = []
                for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    raw = text.encode("utf-8", "replace")
                    gone = _union(found)
                    edges = [0, *(e for s in gone for e in s), len(raw)]
                    kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None))
                c = list(zip(*rows, strict=True)) if rows else [[]] * 5
                cols = [b.column(0), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string()), *([pa.array(c[4], pa.string())] if keep_text else []), *(b.column(3 + i) for i in range(len(extra)))]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if keep_text else "") + "".join(f", `{c}` {kinds[f'x_{c}']}" for c in extra)
    return joined.mapInArrow(run, schema)
