"""Best-fit packing of token sequences: large items are matched, small ones fill the tightest gap that holds them.

Lengths are whole numbers up to the capacity, so a plan needs only the histogram of lengths: it says, for the
r-th piece of each length, which sequence it goes to and where.  The histogram (at most ``capacity`` rows) is
all that reaches the driver.  Pieces get their rank from counts per task and length, so no length, however
common, is gathered in one task, and whole texts are read once and never shuffled.

Edge cases: null text is empty and packs as its end token alone; longer documents are cut into pieces of
``capacity``, the last may be shorter; null and repeated doc_ids are packed row by row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import WordIds

CAPACITY = 2048
END_ID = 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, rank_from, n, sequence_from, offset): piece rank_from + i goes to sequence_from + i at offset.

    Items over a third of the capacity share a sequence with at most one other such item: from the largest
    down, each takes the largest partner that fits.  The rest go, largest first, into the smallest gap that
    holds them; as many of a length as fit go into a gap at once, as they would one by one.
    """
    left = {k: int(n) for k, n in counts.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    keys: list[int] = []
    total = 0

    def put(length: int, n: int, first: int, at: int) -> None:
        slots.append((length, rank[length], n, first, at))
        rank[length] += n
        left[length] -= n

    def keep(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(keys, gap)
            gaps[gap].append((first, n))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left[a]:
            mate = next((b for b in large if b <= capacity - a and b <= a and (left[b] if b != a else left[a] > 1)), None)
            n = left[a] if mate is None else left[a] // 2 if mate == a else min(left[a], left[mate])
            put(a, n, total, 0)
            if mate is not None:
                put(mate, n, total, a)
            keep(capacity - a - (mate or 0), total, n)
            total += n
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            i = bisect.bisect_left(keys, s)
            if i == len(keys):
                each = capacity // s
                n = max(1, left[s] // each)
                keep(capacity, total, n)
                total += n
                continue
            gap = keys[i]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], keys[i]
            each = min(gap // s, left[s])
            use = min(n, left[s] // each)
            keep(gap, first + use, n - use)
            for j in range(each):
                put(s, use, first, capacity - gap + j * s)
            keep(gap - each * s, first, use)
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the task and the place in it among pieces of that length."""
    kind = dict(docs.dtypes)[id_col]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", *(["ids"] if keep_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = _shared(tokenizer)
        task, seen, end = TaskContext.get().partitionId(), [0] * (capacity + 1), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                b = batch.slice(at, 200)
                rows = []
                for i, ids in enumerate(tok.ids([x or "" for x in b.column(1).to_pylist()])):
                    ids += end
                    for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[lo : lo + 4 * capacity]
                        n = len(part) // 4
                        rows.append((i, k, lo // 4, n, zlib.crc32(part), seen[n], part))
                        seen[n] += 1
                c = list(zip(*rows, strict=True))
                cols = [b.column(0).take(pa.array(c[0])), *(pa.array(x, pa.int32() if k == 1 else pa.int64()) for k, x in enumerate(c[1:5], 1)), pa.array([task] * len(rows), pa.int32()), pa.array(c[5], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(c[6], pa.binary())] if keep_ids else []), names)

    return docs.select(id_col, text_col).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, place long" + (", ids binary" if keep_ids else ""))


_TOKENIZERS: dict[str, WordIds] = {}


def _shared(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def pack(docs: DataFrame, tokenizer: str, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Each piece of each document with its sequence_id and its offset there."""
    cut = scratch.put(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, keep_ids=keep_ids))
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    slots = plan(counts, capacity)
    before = by_task.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = cut.join(before, ["task", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kinds = dict(cut.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = slots[:, 0] << 44 | slots[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            s = slots[at]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(out))), pa.array(s[:, 3] + rank - s[:, 1]), pa.array(s[:, 4])], [*out, "sequence_id", "offset"])

    return ranked.select(*out, "rank").mapInArrow(place, ", ".join(f"{k} {kinds[k]}" for k in out) + ", sequence_id long, offset long")
