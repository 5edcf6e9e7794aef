"""Near-duplicate vectors: a navigable small-world graph per shard, every shard searched, links verified.

Only vectors with one label and dimension are compared.  Equal vectors form a class.  Classes are dealt to shards of
bounded size; a graph is built for each, and every class of the label searches every shard, in blocks of bounded size.
A task holds one shard and one block, so what a label ships is its rows times its shards and its blocks.  A search
whose beam is full of links is widened, at last to the whole shard; every sixteenth query of a block is audited against
all vectors of the shard, and more of them, at last all, until ``POSITIVE`` have a link besides themselves.  The whole
block's beam is widened until the mean recall of these queries reaches ``RECALL``.  Cosines of what is found are taken
in double precision.  A task sends counts and a spanning forest of its links, so a cluster costs its size, not its
square; and what its audits measured, which ``audit=True`` adds to each row as the mean over its label.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and those with a null label or
null id, link with nothing (their component is their own id) and are kept; equal vectors link with one another.  Rows
that repeat id, label and vector are one vector; different vectors under one id each count as a vector, and are one
node in components.  Ties go to the smallest id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components
from .hnsw import Graph

COSINE = 0.98
SHARD = 16384
BLOCK = 16384
BLOCK_BYTES = 64 << 20  # of a shard or block of wide vectors, as doubles
BEAM, RECALL, AUDIT, POSITIVE = 32, 0.995, 16, 32


class Forest:
    """Smallest member of each set of linked places; sets are joined many at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            go = a != b
            a, b = a[go], b[go]
            if not len(a):
                break
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def found_links(g: Graph, x: np.ndarray, q: np.ndarray, cosine: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, shard place) with at least that cosine, in blocks of queries; x and q are unit rows in double."""
    low = cosine - 1e-4
    for at in range(0, len(q), 256):
        todo, w = np.arange(at, min(at + 256, len(q))), width
        while len(todo):
            if 2 * w >= len(x):
                for i in range(0, len(todo), 64):
                    a, b = np.nonzero(q[todo[i : i + 64]] @ x.T >= cosine)
                    yield todo[i : i + 64][a], b
                break
            ids, sims = g.search(q[todo].astype(np.float32), w)
            full = (sims >= low).all(axis=1)
            a, b = np.nonzero((sims >= low) & ~full[:, None])
            a, b = todo[a], ids[a, b]
            ok = np.einsum("ij,ij->i", q[a], x[b]) >= cosine
            yield a[ok], b[ok]
            todo, w = todo[full], w * 4


def audited(x: np.ndarray, q: np.ndarray, own: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Audited queries that have links besides themselves, and all their links (queries x shard places)."""
    some, links, step, n = [], [], AUDIT, len(q)
    while step:
        new = np.arange(0, n, step) if step == AUDIT else np.arange(step, n, 2 * step)
        for i in range(0, len(new), 64):
            at = new[i : i + 64]
            true = q[at] @ x.T >= cosine
            here = np.flatnonzero(own[at] >= 0)
            true[here, own[at[here]]] = False
            some.append(at[true.any(axis=1)])
            links.append(true[true.any(axis=1)])
        if sum(map(len, some)) >= POSITIVE:
            break
        step //= 2
    return np.concatenate([np.zeros(0, int), *some]), np.concatenate([np.zeros((0, len(x)), bool), *links])


def search_block(g: Graph, x: np.ndarray, mult: np.ndarray, q: np.ndarray, cosine: float, own: np.ndarray | None = None) -> tuple[np.ndarray, Forest, np.ndarray]:
    """Links of each query into the shard, counted with multiplicity; sets over queries and then shard places; recalls.

    own: the place of each query itself in the shard, or -1; a query is no link of its own.
    """
    own = np.full(len(q), -1) if own is None else own
    audit, true = audited(x, q, own, cosine)
    is_audit = np.full(len(q), -1)
    is_audit[audit] = np.arange(len(audit))
    width = BEAM
    while True:
        n, sets, hits = np.zeros(len(q), np.int64), Forest(len(q) + len(x)), np.zeros(len(audit))
        for a, b in found_links(g, x, q, cosine, width):
            other = own[a] != b
            n += np.bincount(a[other], mult[b[other]], len(q)).astype(np.int64)
            sets.link(a, len(q) + b)
            known = is_audit[a] >= 0
            i = is_audit[a[known]]
            hits += np.bincount(i, true[i, b[known]], len(audit))
        recalls = hits / true.sum(axis=1)
        if not len(audit) or recalls.mean() >= RECALL or 2 * width >= len(x):
            return n, sets, recalls
        width *= 2


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


_FOUND = "kind int, label string, a long, b long, x double"
COUNT, LINK, AUDIT_ROW = 0, 1, 2


def near_vectors(df: DataFrame, scratch: Scratch, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, shard: int = SHARD, block: int = BLOCK, audit: bool = False) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row; with audit also audit_recall, null where nothing was audited."""
    v = F.col("v")
    kind = dict(df.dtypes)[vector_col]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite, F.lit(False))
    once = rows.where(good).distinct()
    classes = once.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    classes = scratch.put(classes.withColumn("cid", F.monotonically_increasing_id()))  # ids hold once they are written
    size = classes.withColumn("dim", F.size("v")).groupBy("label", "dim").agg(F.count("*").alias("n"))
    room = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
    dealt = classes.withColumn("dim", F.size("v")).join(size, ["label", "dim"]).withColumn("shards", F.ceil(F.col("n") / F.least(F.lit(shard), room))).withColumn("blocks", F.ceil(F.col("n") / F.least(F.lit(block), room)))
    dealt = scratch.put(dealt.select("label", "dim", "cid", "rep", "mult", "v", "shards", "blocks", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("shards")).alias("shard"), F.pmod(F.xxhash64("cid", F.lit(4)), F.col("blocks")).alias("block")))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        raw = _matrix(table.column("v"))
        raw = raw.astype(np.float32) if kind == "array<float>" else raw  # exact: components are as they came
        one = table.slice(0, 1)
        lists = {k: pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for k, c in (("cids", "cid"), ("reps", "rep"), ("mults", "mult"))}
        return pa.table({"label": one.column("label"), "dim": one.column("dim"), "shard": one.column("shard"), "blocks": one.column("blocks")} | lists | {"raw": pa.array([raw.tobytes()], pa.binary()), "graph": pa.array([Graph(_unit(raw.astype(float)).astype(np.float32)).dump()], pa.binary())})

    graphs = dealt.groupBy("label", "dim", "shard").applyInArrow(build, "label string, dim int, shard long, blocks long, cids array<long>, reps array<long>, mults array<long>, raw binary, graph binary")
    graphs = scratch.put(graphs)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            cids, shard_reps, mult = (np.array(left.column(k)[0].as_py()) for k in ("cids", "reps", "mults"))
            x = _unit(np.frombuffer(left.column("raw")[0].as_py(), "<f4" if kind == "array<float>" else "<f8").astype(float).reshape(len(cids), -1))
            g = Graph.load(left.column("graph")[0].as_py(), x)
            right = right.sort_by("cid")
            q, asked, reps = _unit(_matrix(right.column("v"))), right.column("cid").to_numpy(), right.column("rep").to_numpy()
            at = np.minimum(np.searchsorted(cids, asked), len(cids) - 1)
            n, sets, recalls = search_block(g, x, mult, q, cosine, np.where(cids[at] == asked, at, -1))
            names = np.concatenate((reps, shard_reps))
            moved = np.flatnonzero(sets.root != np.arange(len(names)))
            a, b = names[moved], names[sets.root[moved]]
            a, b = a[a != b], b[a != b]
            out = [(COUNT, asked, n, np.zeros(len(n))), (LINK, a, b, np.zeros(len(a))), (AUDIT_ROW, np.array([len(recalls)]), np.zeros(1, int), np.array([recalls.sum()]))]
        label = left.column("label")[0].as_py() if left.num_rows else None
        a, b, x = (np.concatenate([r[k] for r in out]) if out else np.zeros(0) for k in (1, 2, 3))
        kinds = np.repeat([r[0] for r in out], [len(r[1]) for r in out]) if out else np.zeros(0)
        return pa.table({"kind": pa.array(kinds.astype(np.int32)), "label": pa.array([label] * len(a), pa.string()), "a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "x": pa.array(x.astype(float))})

    keys = ["label", "dim", "shard", "block"]
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks").groupBy(*keys)
    right = dealt.select("label", "dim", "cid", "rep", "v", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")).groupBy(*keys)
    found = scratch.put(left.cogroup(right).applyInArrow(search, _FOUND))
    # an id with several vectors is one node: it joins their classes
    several = once.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    joins = once.join(several, "vec_id").join(classes.select("label", "v", "rep"), ["label", "v"]).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    comp = components(found.where(F.col("kind") == LINK).select("a", "b").unionByName(joins), scratch)
    counts = found.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("hits"))
    result = classes.join(counts, "cid").join(comp, F.col("rep") == F.col("node"), "left").select("label", "v", (F.col("hits") + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    result = scratch.put(result.withColumnRenamed("label", "l2").withColumnRenamed("v", "v2"))
    recall = found.where(F.col("kind") == AUDIT_ROW).groupBy(F.col("label").alias("l3")).agg((F.sum("x") / F.nullif(F.sum("a"), F.lit(0))).alias("audit_recall"))
    if audit:
        recall = scratch.put(recall)
    scratch.drop(classes, dealt, graphs, found)
    out = rows.withColumn("good", good).join(result, F.col("good") & (F.col("label") == F.col("l2")) & (v == F.col("v2")), "left")
    if audit:
        out = out.join(recall, F.col("good") & (F.col("label") == F.col("l3")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"), *(["audit_recall"] if audit else []))
