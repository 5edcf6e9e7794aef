"""Toxicity by a classifier chain: linear models in a row, each fed the probabilities of those before it.

The chain's categories come from ``labels``: first low quality, then toxic.  A later model is trained on
out-of-fold probabilities of the earlier ones, so it sees them as wrong as they will be on new texts.  Features
are a text's distinct words (letters, lower case), each as itself, its first five and its last three letters,
hashed; a feature's value is the number of distinct words that have it.  The ``SELECTED`` features that tell a
category best are kept.

Training takes a bounded sample, the ``SAMPLE`` labelled documents whose ids hash lowest; each fold is a task of its own.  Features are counted and chosen before the folds, which get the chosen ones only.
Scoring reads all texts whole, in one pass without a shuffle.

Edge cases: null and empty text have no features and get the base rate; null labels and null doc_ids do not
train; of labels that repeat a doc_id the largest holds, of documents that repeat one the first text by code point;
without labels, or with one class only, the rate stands for the model; texts of any length are read whole; repeated
rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized

SAMPLE = 12_000
BUCKETS = 1 << 20
SELECTED = 4096
RARE = 3
BLOCK = 1 << 17
FOLDS = 5
THRESHOLD = 0.5
CHAIN = ("low_quality", "toxic")
_IS = {"low_quality": "quality = 0", "toxic": "toxic <> 0"}
KEPT_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in ("=" + word, "<" + word[:5], ">" + word[-3:])]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    ids = [f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)]
    at, n = np.unique(np.array(ids, np.int64), return_counts=True)
    return at, n


def sums(to: np.ndarray, size: int, weights: Callable[[slice], np.ndarray | None]) -> np.ndarray:
    """Sums of the weights of slices by ``to``, ``BLOCK`` entries at a time, so that no array of all weights is made; None counts."""
    out = np.zeros(size)
    for a in range(0, len(to), BLOCK):
        z = slice(a, a + BLOCK)
        out += np.bincount(to[z], weights(z), size)
    return out


def select(docs: np.ndarray, positive: np.ndarray, n: int, ones: int, k: int = SELECTED) -> np.ndarray:
    """Places of the k features whose document frequencies in the two classes differ most, in standard errors; from documents and positive ones with each."""
    n1, n0 = max(1, ones), max(1, n - ones)
    d1, d0 = positive, docs - positive
    rate = (d1 + d0) / (n1 + n0)
    z = np.abs(d1 / n1 - d0 / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / n0))
    z[docs < RARE] = 0
    best = np.argsort(-z, kind="stable")[:k]
    return np.sort(best[z[best] > 0])


def places(chosen: np.ndarray) -> np.ndarray:
    """For every feature its place among the chosen ones, or -1."""
    at = np.full(BUCKETS, -1, np.int32)
    at[chosen] = np.arange(len(chosen))
    return at


def fit_linear(doc: np.ndarray, col: np.ndarray, val: np.ndarray, scale: np.ndarray, extra: np.ndarray, y: np.ndarray, rows: np.ndarray, steps: int = 120) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on the given rows: weights of sparse columns, whose values are to be scaled, of dense ones, and the bias."""
    n, width, use = len(y), len(scale), np.zeros(len(y), bool)
    use[rows] = True
    rate = min(max(y[rows].mean() if len(rows) else 0.5, 1e-3), 1 - 1e-3)
    w, e, b = np.zeros(width), np.zeros(extra.shape[1]), float(np.log(rate / (1 - rate)))
    if rate <= 1e-3 or rate >= 1 - 1e-3:
        return w, e, b
    state = [np.zeros(width + len(e) + 1) for _ in range(2)]
    for t in range(1, steps + 1):
        scaled = w * scale
        s = sums(doc, n, lambda z: val[z] * scaled[col[z]]) + extra @ e + b  # noqa: B023
        err = np.where(use, 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y, 0.0) / len(rows)
        g = np.concatenate((scale * sums(col, width, lambda z: val[z] * err[doc[z]]) + 1e-5 * w, extra.T @ err, [err.sum()]))  # noqa: B023
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        step = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-9)
        w, e, b = w - step[:width], e - step[width:-1], b - step[-1]
    return w, e, b


def fit_category(doc: np.ndarray, col: np.ndarray, val: np.ndarray, width: int, y: np.ndarray, earlier: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Weights of the chosen features, those of earlier categories, the bias, fitted on some rows; and all rows' probabilities."""
    mean = sums(col, width, lambda z: val[z].astype(float) ** 2) / np.maximum(sums(col, width, lambda z: None), 1)
    scale = 1 / np.maximum(np.sqrt(mean), 1)
    w, e, b = fit_linear(doc, col, val, scale, earlier, y, rows)
    w = w * scale
    s = sums(doc, len(y), lambda z: val[z] * w[col[z]]) + earlier @ e + b
    return w, e, b, 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def fit_chain(doc: np.ndarray, ids: np.ndarray, val: np.ndarray, labels: dict[str, np.ndarray], fold: np.ndarray) -> list[dict]:
    """For each category of the chain: selected features and their weights, weights of earlier ones, bias."""
    earlier, chain = np.zeros((len(fold), 0)), []
    for name, y in labels.items():
        chosen = select(sums(ids, BUCKETS, lambda z: None), sums(ids, BUCKETS, lambda z: y[doc[z]]), len(y), int(y.sum()))  # noqa: B023
        col = places(chosen)[ids]
        keep = col >= 0
        hits = (doc[keep], col[keep], val[keep], len(chosen), y, earlier)
        out = np.zeros(len(y))
        for f in range(FOLDS):
            out[fold == f] = fit_category(*hits, np.flatnonzero(fold != f))[3][fold == f]
        w, e, b, _ = fit_category(*hits, np.arange(len(y)))
        chain.append({"name": name, "ids": chosen, "w": w, "e": e, "b": b})
        earlier = np.column_stack((earlier, out))
    return chain


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[dict]:
    """Fit the chain on the features of at most ``sample`` documents, category by category, a task for each fold and for the whole."""
    lab = labels.select(F.col(id_col).alias("doc_id"), "quality", "toxic").where("doc_id is not null and quality is not null and toxic is not null")
    lab = lab.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "doc_id")  # ``sample`` rows
    text = text.groupBy("doc_id", "quality", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sized(batch, 1):
                pairs = [features(t.as_py()) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array([x[0].astype(np.int32) for x in pairs], pa.list_(pa.int32())), pa.array([x[1].astype(np.int32) for x in pairs], pa.list_(pa.int32()))], ["doc_id", *CHAIN, "ids", "n"])

    found = text.select("doc_id", "text", *(F.expr(f"int({_IS[c]})").alias(c) for c in CHAIN))
    found = found.mapInArrow(extract, "doc_id long, " + ", ".join(f"{c} int" for c in CHAIN) + ", ids array<int>, n array<int>")
    found = Scratch(docs.sparkSession, "toxicity").put(found)  # at most ``sample`` rows
    n, *ones = found.agg(F.count("*"), *(F.sum(c) for c in CHAIN)).first()
    if not n:
        return [{"name": c, "ids": [], "w": [], "e": [0.0] * i, "b": 0.0} for i, c in enumerate(CHAIN)]

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, count = table.column("id").to_numpy(), table.column("docs").to_numpy()
        chosen = [ids[select(count, table.column(c).to_numpy(), n, k)] for c, k in zip(CHAIN, ones, strict=True)]
        return pa.table({"name": list(CHAIN), "ids": pa.array(chosen, pa.list_(pa.int32()))})

    # One row for a feature, so at most BUCKETS; what is chosen does not depend on the fold.
    counts = found.select(F.explode("ids").alias("id"), *CHAIN).groupBy("id").agg(F.count("*").alias("docs"), *(F.sum(c).alias(c) for c in CHAIN)).where(F.col("docs") >= RARE)
    chosen_of = {r["name"]: np.array(r["ids"], np.int32) for r in counts.groupBy().applyInArrow(pick, "name string, ids array<int>").collect()}
    chain: list[dict] = []
    earlier: list[np.ndarray] = []
    for name in CHAIN:
        chosen = chosen_of.get(name, np.zeros(0, np.int32))

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = places(chosen)  # noqa: B023
            for b in batches:
                lists = b.column(2)
                col = place[lists.flatten().to_numpy()]
                keep = col >= 0
                at = pa.array(np.concatenate(([0], np.cumsum(keep)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.ListArray.from_arrays(at, pa.array(col[keep])), pa.ListArray.from_arrays(at, pa.array(b.column(3).flatten().to_numpy()[keep]))], ["doc_id", "y", "col", "n"])

        def fit(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            table = table.select(["doc_id", "y", "col", "n"]).sort_by("doc_id")
            col, val, n = table.column("col").combine_chunks(), table.column("n").combine_chunks(), len(table)
            doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(col.offsets.to_numpy()))
            before = np.column_stack([np.zeros((n, 0)), *earlier])  # noqa: B023
            fold = np.arange(n) % FOLDS
            w, e, b, p = fit_category(doc, col.flatten().to_numpy(), val.flatten().to_numpy(), len(chosen), table.column("y").to_numpy().astype(float), before, np.flatnonzero(fold != part))  # noqa: B023
            out = p[fold == part] if part < FOLDS else np.zeros(0)
            return pa.table({"part": pa.array([part], pa.int32()), "w": pa.array([w], pa.list_(pa.float64())), "e": pa.array([e], pa.list_(pa.float64())), "b": [float(b)], "p": pa.array([out], pa.list_(pa.float64()))})

        # A fold's task gets the chosen features only: beside them its memory is a few arrays of ``sample`` and of BLOCK values.
        few = found.select("doc_id", name, "ids", "n").mapInArrow(hits, "doc_id long, y int, col array<int>, n array<int>")
        parts = few.withColumn("part", F.explode(F.array(*map(F.lit, range(FOLDS + 1))))).groupBy("part").applyInArrow(fit, "part int, w array<double>, e array<double>, b double, p array<double>").collect()
        of = {r["part"]: r for r in parts}
        chain.append({"name": name, "ids": chosen.tolist()} | {k: of[FOLDS][k] for k in ("w", "e", "b")})
        out = np.zeros(n)
        for f in range(FOLDS):
            out[f::FOLDS] = of[f]["p"]
        earlier.append(out)
    return chain


def classify(docs: DataFrame, chain: list[dict], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_<category> of each category in chain order, and <last category>, a boolean."""
    kind = dict(docs.dtypes)[id_col]
    weight: dict[int, np.ndarray] = {}
    for k, m in enumerate(chain):
        for i, w in zip(m["ids"], m["w"], strict=True):
            weight.setdefault(int(i), np.zeros(len(chain)))[k] += w
    names = ["doc_id", *(f"p_{m['name']}" for m in chain), chain[-1]["name"]]
    later = [(np.array(m["e"], float), float(m["b"])) for m in chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero, kept = np.zeros(len(chain)), {}

        def of(word: str) -> np.ndarray | None:
            s = zero
            for f in word_features(word):
                if (x := weight.get(f)) is not None:
                    s = s + x
            return s if s is not zero else None

        for batch in batches:
            for b in sized(batch, 1):
                sums = np.zeros((b.num_rows, len(chain)))
                for i, text in enumerate(b.column(1).to_pylist()):
                    found = set(_WORD.findall((text or "").lower()))
                    for w in found.difference(kept):
                        kept[w] = of(w)
                    hits = [x for x in map(kept.__getitem__, found) if x is not None]
                    if hits:
                        sums[i] = np.sum(np.array(hits), axis=0)
                    if len(kept) > KEPT_WORDS:
                        kept.clear()
                p = np.zeros((b.num_rows, 0))
                for k, (e, bias) in enumerate(later):
                    p = np.column_stack((p, 1 / (1 + np.exp(-np.clip(sums[:, k] + p @ e + bias, -30, 30)))))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names)

    schema = f"doc_id {kind}, " + ", ".join(f"p_{m['name']} double" for m in chain) + f", {chain[-1]['name']} boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
