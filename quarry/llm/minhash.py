"""Near-duplicate documents by BagMinHash signatures of word-shingle multisets, banding and exact verification.

Signature (BagMinHash): a shingle with multiplicity w owns, for every register, a Poisson process over
weight x time restricted to weights up to w; the register keeps the earliest point.  Weights are discretised to
whole numbers and split into the dyadic strips (0,1], (1,2], (2,4], ...; in the strip that w cuts, a point's
cell is found by halving the strip bit by bit, so every w sees the same points.  Two registers are equal with
probability weighted Jaccard, sum(min) / sum(max).  Points are drawn in time order and a process stops once
its next point is later than the latest register of its document.

Search: bands of registers are hashed to buckets.  Members of a bucket are compared with its smallest member,
and components are formed.  What then still lies in one bucket but in different components is compared in full:
pair by pair in small buckets; in larger ones block by block, as products of 0/1 matrices with a column for each
copy of a shingle, whose rows give back a spanning forest of links.  Blocks are bounded by rows and by bytes, and of
buckets with the same members one is compared.  So no link between candidates is lost, and no stage emits the pairs of
a large group.
Pairs are verified on the shingle counts themselves.

Edge cases: texts of fewer words than a shingle are one shingle; texts without words (null, empty) are near
only to texts with the same bytes (null counts as empty); rows that repeat a text share a class whose id is
its smallest doc_id, and different texts under one doc_id are different classes; of a component the text with the
smallest class id (then hash) is kept, in each of the rows that have it under that id; rows with a null doc_id have
null class and component and are kept; texts of any length are read whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _GOLD, Rolling, Scratch, components, mix, sized, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
PAIRED, BLOCK, BLOCK_BYTES = 16, 1024, 4 << 20  # larger buckets are compared as matrices, in blocks of members


def shingles(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, hash and count of each distinct shingle, ordered by index and hash."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    start, end = words(lower)
    tok = Rolling(lower, 11).ranges(start, end)
    ends = np.cumsum([len(r) + 1 for r in raw])
    doc = np.searchsorted(ends, start, side="right")
    n = np.bincount(doc, minlength=len(raw))
    first = np.cumsum(n) - n
    per = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    owner = np.repeat(np.arange(len(raw)), per)
    at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + first[owner]
    stop = (first + n)[owner]
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = at + j < stop
        h = mix(h * np.uint64(0x100000001B3) + np.where(inside, tok[np.minimum(at + j, max(len(tok) - 1, 0))] if len(tok) else np.uint64(0), _GOLD))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def signatures(n_docs: int, doc: np.ndarray, item: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """n_docs x m register times (inf where a document has no item)."""
    reg = np.full((n_docs, m), np.inf)
    flat = reg.ravel()
    top = np.where(weight > 0, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), -1)
    strips = top + 1
    own = np.repeat(np.arange(len(item)), strips)
    strip = np.arange(len(own)) - np.repeat(np.cumsum(strips) - strips, strips)
    width = np.where(strip > 0, 1 << np.maximum(strip - 1, 0), 1)
    above = np.where(strip > 0, width, 0)  # weights of a strip begin above this
    d, w = doc[own], weight[own] - above
    key = mix(item[own] + strip.astype(np.uint64) * _GOLD)
    scale = 1.0 / (m * width)
    now, drawn = np.zeros(len(own)), np.zeros(len(own), np.uint64)
    step = 1
    while len(key):
        c = drawn[:, None] + np.arange(1, step + 1, dtype=np.uint64)
        r = mix(key[:, None] ^ (c * _GOLD))
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))
        t = now[:, None] + np.cumsum(-np.log(u) * scale[:, None], axis=1)
        r = mix(r + _GOLD)
        slot = ((r >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        cell = (r & np.uint64(0xFFFFFFFF)).astype(np.int64) & (width - 1)[:, None]  # its bits, read as halvings
        inside = cell < w[:, None]
        place = d[:, None] * m + slot.astype(np.int64)
        np.minimum.at(flat, place[inside], t[inside])
        now, drawn = t[:, -1], drawn + np.uint64(step)
        go = now < reg.max(axis=1)[d]
        key, d, w, width, scale, now, drawn = key[go], d[go], w[go], width[go], scale[go], now[go], drawn[go]
        step = max(1, min(64, (1 << 17) // max(1, len(key)), step * 2))
    return reg


def bands(reg: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """n x n_bands bucket keys, the band number hashed in."""
    bits = np.ascontiguousarray(reg[:, : n_bands * rows]).view(np.uint64).reshape(len(reg), n_bands, rows)
    h = np.broadcast_to(mix(np.arange(1, n_bands + 1, dtype=np.uint64) * _GOLD), bits.shape[:2])
    for j in range(rows):
        h = mix(h * np.uint64(0x100000001B3) + mix(bits[:, :, j]))
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted hashes, counts)."""
    total = a[1].sum() + b[1].sum()
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (total - common)) if total > common else 0.0


def sign(docs: DataFrame, id_col: str, text_col: str, shingle: int, n_bands: int, rows: int) -> DataFrame:
    """doc_id, digest (of the whole text), size in bytes, and bands, null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sized(batch, 2):
                doc, item, count = shingles(b.column(2).to_pylist(), shingle)
                reg = signatures(b.num_rows, doc, item, count, n_bands * rows)
                keys = bands(reg, n_bands, rows)
                has = np.bincount(doc, minlength=b.num_rows) > 0
                offsets = pa.array(np.append(0, np.cumsum(np.full(b.num_rows, n_bands))), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel(), pa.int64()), mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), lists], ["doc_id", "digest", "size", "bands"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(F.encode(F.coalesce(text_col, F.lit("")), "utf-8"), 256)).alias("digest"), F.coalesce(text_col, F.lit("")).alias("text"))
    return base.withColumn("size", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, digest binary, size long, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least ``threshold`` similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, 2):
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                both = list(dict.fromkeys([*left, *right]))
                at = {t: i for i, t in enumerate(both)}
                doc, item, count = shingles(both, shingle)
                cut = np.searchsorted(doc, np.arange(len(both) + 1))
                bag = [(item[x:y], count[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                ok = [similarity(bag[at[x]], bag[at[y]]) >= threshold for x, y in zip(left, right, strict=True)]
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    ta = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _open(wide: DataFrame, comp: DataFrame) -> DataFrame:
    """Of ``wide(key, id, size)``, the buckets that hold several components: with c, the commonest of them, members and bytes.

    Buckets of the same members, as a large group has in many bands, are told by number, ends and hashes of these, and one is left.
    """
    label = wide.join(comp, F.col("id") == F.col("node"), "left").select("key", "id", "size", F.coalesce("component", "id").alias("c"))
    sizes = label.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("h"))
    most = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.sum("n").alias("k"), F.sum("size").alias("bytes"), F.count("*").alias("cs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_xor("h").alias("h")).where("cs > 1")
    most = most.groupBy("k", "lo", "hi", "h").agg(F.min(F.struct("key", "most", "bytes")).alias("x")).select("x.*", "k")
    return label.join(most, "key")


def _blocks(texts: list[str], shingle: int, threshold: float) -> np.ndarray:
    """Which texts are at least ``threshold`` similar, as a matrix."""
    doc, item, count = shingles(texts, shingle)
    total = np.bincount(doc, count, len(texts))
    copies = np.repeat(np.arange(len(doc)), count)
    nth = np.arange(len(copies)) - np.repeat(np.cumsum(count) - count, count)
    _, col, n = np.unique(mix(item[copies] + nth.astype(np.uint64) * _GOLD), return_inverse=True, return_counts=True)
    both = n[col] > 1
    row, (_, col) = doc[copies][both], np.unique(col[both], return_inverse=True)
    common = np.zeros((len(texts), len(texts)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, z = np.searchsorted(col, (lo, lo + 4096))
        m = np.zeros((len(texts), 4096), np.float32)
        m[row[a:z], col[a:z] - lo] = 1
        common += m @ m.T
    return (common >= threshold * (total[:, None] + total[None, :] - common) - 1e-6) & (common > 0)


def _dense(open_: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links (a, b) between different components inside large buckets ``open_(key, id, c, k)``, enough of them to join what they join."""

    def run(table: pa.Table) -> pa.Table:
        ids, c = table.column("id").to_numpy(), table.column("c").to_numpy()
        like = _blocks(table.column("text").to_pylist(), shingle, threshold) & (c[:, None] != c[None, :])
        root, out = list(range(len(ids))), []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(like))), strict=True):
            while root[i] != i:
                root[i] = i = root[root[i]]
            x = j
            while root[x] != x:
                root[x] = x = root[root[x]]
            if i != x:
                root[max(i, x)] = min(i, x)
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})

    n = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))
    own = F.pmod(F.xxhash64("id"), n)
    rows = open_.withColumn("n", n).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.select("key", "id", "c", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"))
    rows = rows.join(texts.select(F.col("cid").alias("id"), "text"), "id")
    return rows.groupBy("key", "b1", "b2").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS, keep_digest: bool = False) -> DataFrame:
    """doc_id, class_id (equal texts), component_id (texts linked by near copies) and kept, for each row.

    With keep_digest also the SHA-256 of the text, which tells apart rows of one id.
    """
    signed = scratch.put(sign(docs, id_col, text_col, shingle, n_bands, rows))
    classes = signed.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = scratch.put(classes.withColumn("cid", F.monotonically_increasing_id()))  # ids hold once they are written
    member = classes.where("class_id is not null and bands is not null").select(F.col("cid").alias("id"), "size", F.explode("bands").alias("key"))
    hubs = member.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = scratch.put(member.join(hubs, "key"))
    tried = scratch.put(shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    ids = tried.select(F.col("a").alias("cid")).union(tried.select(F.col("b").alias("cid"))).union(shared.where("n > 2").select("id")).distinct()
    rep = classes.select("class_id", "digest", "cid")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = text.withColumn("digest", F.unhex(F.sha2(F.encode("text", "utf-8"), 256))).join(ids.join(rep, "cid").select(F.col("class_id").alias("doc_id"), "digest", "cid"), ["doc_id", "digest"])
    texts = scratch.put(texts.dropDuplicates(["cid"]).select("cid", "text"))
    links = scratch.put(verify(tried, texts, shingle, threshold))
    comp = scratch.put(components(links, scratch))
    # What shares a bucket but not a component, and was not compared yet.
    open_ = scratch.put(_open(shared.where("n > 2").select("key", "id", "size"), comp))
    few, lot = open_.where(F.col("k") <= PAIRED), open_.where(F.col("k") > PAIRED)
    rest = few.where("c <> most").select("key", F.col("id").alias("i"), F.col("c").alias("ci"))
    pairs = rest.join(few.select("key", F.col("id").alias("j"), F.col("c").alias("cj"), F.col("most")), "key")
    pairs = pairs.where("ci <> cj and (cj = most or i < j)").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    more = verify(pairs.join(tried, ["a", "b"], "left_anti"), texts, shingle, threshold)
    more = scratch.put(more.unionByName(_dense(lot, texts, shingle, threshold)))
    if more.limit(1).count():
        comp = scratch.put(components(links.unionByName(more), scratch))
    scratch.drop(shared, tried, texts, links, open_, more)
    # the first text of each component, of which the components of one text need no telling
    first = comp.join(rep, F.col("node") == F.col("cid")).groupBy("component").agg(F.min(F.struct("class_id", "digest")).alias("first"))
    named = rep.join(comp.join(first, "component").select("node", "first"), F.col("cid") == F.col("node"), "left")
    named = named.select("digest", "class_id", F.coalesce("first", F.struct("class_id", "digest")).alias("first"))
    out = signed.select("doc_id", "digest").join(named, "digest")
    known = F.col("doc_id").isNotNull()
    kept = ~known | ((F.col("doc_id") == F.col("first.class_id")) & (F.col("digest") == F.col("first.digest")))
    return out.select("doc_id", F.when(known, F.col("class_id")).alias("class_id"), F.when(known, F.col("first.class_id")).alias("component_id"), kept.alias("kept"), *(["digest"] if keep_digest else []))
