"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, and a unigram base.

Tokens are runs of bytes other than ASCII white space, A-Z lowered, and one end for each document.  Counts of all
tokens are taken over every training document.  The ``head`` most frequent tokens that occur twice or more have vectors
of their own, as context and as output: that many vectors is what a task's memory is asked to hold.  All other tokens
are dealt by hash to cells, whose number grows with the root of how many there are; a cell has vectors like a word, and
its members share it by count, (c + 1) / (N_cell + V_cell + 1), with one more unit for all that training never saw.  So
every token has its probability, and they sum to 1 after every context (``logbilinear``).

Training passes once over every training text, in ``rounds`` slices.  In a round each task makes its steps on its own
texts, and what the tasks learnt is averaged row by row, weighted by how often a row was moved; so steps and draws
grow with the corpus, and no task sees more than its share.  The head and the vectors are broadcast: at most ``head``
tokens of at most ``TOKEN_BYTES`` bytes and 2 * WIDTH + 1 floats a token.  Counts of all other tokens are joined.

Edge cases: null text is one end token; a null doc_id reads as the empty text for the split; repeated rows are
scored alike; tokens of any length count, those over ``TOKEN_BYTES`` in cells; without training tokens all counts are 0
and the score equals the base; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logbilinear as L
from .common import CHUNK, SPACE, Scratch, sized

HEAD = 100_000
TOKEN_BYTES = 256
ROUNDS = 2
TRAINER_TOKENS = 8_000_000  # what one task trains on in a round, if there is enough
FAN_IN = 64  # tasks whose moves are averaged at once
HELD_OUT, FOLDS = 2, 7
FLUSH, FLUSH_BYTES = 400_000, 1 << 26
END = L.END
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of all tokens of ``texts``, one text after the other: the place of each among the different ones; these; and how many a text has."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(raw):
        return np.zeros(0, np.int32), pa.array([], pa.binary()), np.zeros(0, np.int64)
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = at[at < len(data)]
    begin[edge] = inside[edge]  # no token goes on in the next text
    kept = _LOWER[data[inside]]
    cut = np.append(np.flatnonzero(begin[inside]), len(kept)).astype(np.int32)
    kinds = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(kept)]).dictionary_encode()
    return kinds.indices.to_numpy(), kinds.dictionary, np.diff(np.searchsorted(np.flatnonzero(begin), at))


def token_counts(train: DataFrame) -> DataFrame:
    """token (binary, the end is empty), n: over all texts of ``train(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.Table] = []
        rows, size = 0, 0
        for batch in batches:
            for b in sized(batch, 0, 2 * CHUNK):
                codes, kinds, _ = _tokens(b.column(0))
                n = np.append(np.bincount(codes, minlength=len(kinds)), b.num_rows)
                seen.append(pa.table({"token": pa.concat_arrays([kinds, pa.array([END], pa.binary())]), "n": pa.array(n, pa.int64())}))
                rows, size = rows + len(n), size + kinds.nbytes
                if rows > 2 * FLUSH or size > FLUSH_BYTES:
                    seen = [_summed(seen)]
                    rows, size = seen[0].num_rows, seen[0].nbytes
                    if rows > FLUSH or 2 * size > FLUSH_BYTES:
                        yield from seen[0].to_batches()
                        seen, rows, size = [], 0, 0
        if seen:
            yield from _summed(seen).to_batches()

    return train.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _summed(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])


def _symbols(s: L.Symbols, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Symbols of all tokens, the number of each text, and where the tokens in cells are, with their places among ``kinds``."""
    codes, kinds, n = _tokens(texts)
    ids, away = s.ids(kinds.to_numpy(zero_copy_only=False).tolist())
    cell = np.zeros(len(kinds), bool)
    cell[away] = True
    far = np.flatnonzero(cell.take(codes))
    return ids.take(codes), n, far, kinds, codes[far]


@dataclass
class Model:
    symbols: L.Symbols
    vectors: dict[str, np.ndarray]
    log_counts: np.ndarray  # log10(c + 1) of words, by symbol; 0 of cells
    n_all: int
    v_all: int


def _vocabulary(counts: DataFrame, n_all: int, v_all: int, head: int) -> Model:
    level = F.floor(F.log2("n") * 64)
    wanted = (F.col("n") > 1) & (F.octet_length("token") <= TOKEN_BYTES)
    sizes, cut, many = counts.where(wanted).groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect(), None, 0  # a few thousand levels at most
    for x in sizes:
        many += x[1]
        if many > head:
            break
        cut = x[0]
    own = (F.octet_length("token") == 0) | (wanted & (level >= cut) if cut is not None else F.lit(False))
    top = counts.where(own).toArrow()  # at most ``head`` rows and the end
    words = {bytes(t): n for t, n in zip(top.column("token").to_pylist(), top.column("n").to_pylist(), strict=True)}
    cells = 1 << max(4, int(np.ceil(np.log2(max(1, v_all - len(words))) / 2)))
    n, v = np.zeros(cells), np.zeros(cells)
    for r in counts.where(~own).groupBy((F.crc32("token") % cells).alias("cell")).agg(F.sum("n"), F.count("*")).collect():  # a row a cell
        n[r[0]], v[r[0]] = r[1], r[2]
    s = L.Symbols(words, n, v)
    logs = np.zeros(len(s.p))
    for w, i in s.at.items():
        logs[i] = np.log10(words[w] + 1)
    return Model(s, L.start(s), logs, n_all, v_all)


_MOVES = "name string, block int, task int, rows binary, weights binary, moves binary"


def _round(train: DataFrame, model: Model, shared, number: int, trainers: int) -> None:
    """One slice of the texts: every task's steps, and their average."""
    spark = train.sparkSession
    vectors = spark.sparkContext.broadcast(model.vectors)
    width = {k: v.shape[1] for k, v in model.vectors.items()}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s, task = shared.value, TaskContext.get().partitionId()
        t = L.Trainer(vectors.value, s, 7919 * number + task)
        for batch in batches:
            for b in sized(batch, 0, 1 << 18):
                ids, at, _ = L.laid_out(*_symbols(s, b.column(0))[:2], s.end)
                t.text(ids, at)
        c = list(zip(*L.deltas(vectors.value, t), strict=True))
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1], pa.int32()), pa.array([task] * len(c[0]), pa.int32()), *(pa.array(x, pa.binary()) for x in c[2:])], [x.split()[0] for x in _MOVES.split(", ")])

    def average(table: pa.Table) -> pa.Table:
        name = table.column("name")[0].as_py()
        parts = list(zip(*(table.column(k).to_pylist() for k in ("rows", "weights", "moves")), strict=True))
        rows, weights, moves = L.merged(parts, width[name])
        one = table.slice(0, 1)
        return pa.table({"name": one.column("name"), "block": one.column("block"), "task": one.column("task"), "rows": pa.array([rows], pa.binary()), "weights": pa.array([weights], pa.binary()), "moves": pa.array([moves], pa.binary())})

    moves = train.select("text").coalesce(trainers).mapInArrow(learn, _MOVES)
    while True:
        groups = -(-trainers // FAN_IN)
        moves = moves.groupBy("name", "block", (F.col("task") % groups).alias("part")).applyInArrow(average, _MOVES)
        if groups == 1:
            break
        trainers = groups
    for r in moves.toArrow().to_pylist():  # the model itself
        rows = np.frombuffer(r["rows"], "<u2").astype(np.int64) + L.BLOCK * r["block"]
        model.vectors[r["name"]][rows] += np.frombuffer(r["moves"], "<f2").reshape(len(rows), -1).astype(np.float32)
    vectors.unpersist()


def fit(train: DataFrame, counts: DataFrame, *, head: int = HEAD, rounds: int = ROUNDS) -> Model | None:
    """The model of ``train(doc_id, text)``, or None without a training token."""
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).collect()[0]
    if not n_all:
        return None
    model = _vocabulary(counts, int(n_all), int(v_all), head)
    sc = train.sparkSession.sparkContext
    shared = sc.broadcast(model.symbols)
    trainers = max(sc.defaultParallelism, -(-int(n_all) // (TRAINER_TOKENS * rounds)))
    for k in range(rounds):
        part = train.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(rounds)) == k)
        _round(part, model, shared, k, trainers)
    shared.unpersist()
    return model


def score(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and mean_score (a token's) of each row."""
    fold = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")) % FOLDS
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold == HELD_OUT).alias("held_out"))
    counts = scratch.put(token_counts(base.where("not held_out")))
    return apply(base, counts, fit(base.where("not held_out"), counts, head=head, rounds=rounds), scratch)


def apply(base: DataFrame, counts: DataFrame, model: Model | None, scratch: Scratch) -> DataFrame:
    """Scores of ``base(doc_id, text, held_out)``."""
    n_all, divisor = (model.n_all, float(np.log10(model.n_all + model.v_all + 1))) if model else (0, 0.0)
    scored = scratch.put(_score_head(base, model))
    tail = scored.select("rid", F.explode("tail").alias("t")).select("rid", F.col("t.token").alias("token"), F.col("t.n").alias("times"))
    added = tail.join(counts, "token").groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    out = scored.drop("tail").join(added, "rid", "left").withColumn("logs", F.coalesce("logs", F.lit(0.0)))
    base_score = F.col("log_counts") + F.col("logs") - F.col("n_tokens") * F.lit(divisor)
    value = F.col("log_model") + F.col("logs") if model else base_score
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        base_score.alias("base_score"), value.alias("score"), (value / F.col("n_tokens")).alias("mean_score"),
    )


def _score_head(base: DataFrame, model: Model | None) -> DataFrame:
    """What the tasks know: sums over words, the model's terms, and the counts of all tokens in cells."""
    kind = dict(base.dtypes)["doc_id"]
    shared = base.sparkSession.sparkContext.broadcast(model)
    names = ["rid", "doc_id", "held_out", "n_tokens", "n_head", "log_counts", "log_model", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        rid = TaskContext.get().partitionId() << 40
        if model:
            s = model.symbols
            vectors = model.vectors | {"G": L.group_outputs(model.vectors, s)}
            word = np.ones(len(s.p), bool)
            word[s.cells] = False
        for batch in batches:
            for b in sized(batch, 1, 1 << 19):
                known, logs, value = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), np.zeros(b.num_rows)
                if model:
                    symbols, size, far, kinds, codes = _symbols(s, b.column(1))
                    ids, at, first = L.laid_out(symbols, size, s.end)
                    y = ids[at]
                    value = np.add.reduceat(L.log_probs(vectors, s, ids, at) + s.own[y], first)
                    known = np.add.reduceat(word[y].astype(np.int64), first)
                    logs = np.add.reduceat(model.log_counts[y], first)
                else:
                    _, kinds, size = _tokens(b.column(1))
                    far = codes = np.zeros(0, np.int64)
                tails = _tails(np.searchsorted(np.cumsum(size), far, side="right"), codes, kinds, b.num_rows)
                n = size + 1
                rid_now = pa.array(np.arange(rid, rid + b.num_rows))
                rid += b.num_rows
                yield pa.RecordBatch.from_arrays([rid_now, b.column(0), b.column(2), pa.array(n), pa.array(known), pa.array(logs), pa.array(value), tails], names)

    return base.select("doc_id", "text", "held_out").mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_head long, log_counts double, log_model double, tail array<struct<token:binary,n:long>>")


def _tails(owner: np.ndarray, codes: np.ndarray, kinds: pa.Array, rows: int) -> pa.Array:
    """For each of ``rows`` texts its different tokens (token, n) of those given by text and place among ``kinds``."""
    key, times = np.unique(owner.astype(np.int64) * len(kinds) + codes, return_counts=True)
    owner, codes = np.divmod(key, max(1, len(kinds)))
    entries = pa.StructArray.from_arrays([kinds.take(pa.array(codes)), pa.array(times, pa.int64())], ["token", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), entries)
