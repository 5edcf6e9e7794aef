"""Language identification by Bayesian evidence fusion.

Evidence on a text: its byte trigrams under each language's model; the language its markup declares; the suffix of
its address; its host.  Trigram models are counted over all labelled texts.  What declared values, suffixes and
hosts say is counted over all texts too, as sums of the text-only posteriors by grouped aggregation, and smoothed
in a hierarchy: a host's counts lean on its suffix, a suffix's on the whole.  A text does not vote for itself
in its host's prior.  Posterior log odds add up: prior, tempered text likelihood (long texts saturate, as
trigrams are not independent), and the log ratios that the other evidence gives to the prior.

A row is rejected if its text has no letters, or if the best posterior is under ``LEAST``.

Edge cases: null and empty texts are rejected with language 'und'; null or malformed declared, suffix and host
are no evidence; null and repeated ids are rows like others; ties go to the first language by code point; with no
labelled text every row is rejected; a label that is no tag is a language of its own, as it is written; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized

BUCKETS = 1 << 14
BLOCK = 64  # languages summed in one aggregate, or counted by one task before it hands on what it has
SATURATION = 200.0
SMOOTHING = 0.5
DECLARED_WEIGHT, SUFFIX_WEIGHT, HOST_WEIGHT = 10.0, 50.0, 20.0
LEAST = 0.5
UNKNOWN = "und"

_CLASS = np.full(256, 32, np.uint8)  # letters stay, A-Z are lowered, bytes of longer characters stay
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams with two letters or more (others get BUCKETS), where each text's begin, and its letters."""
    raw = [b"  " + (t or "").encode("utf-8", "replace") + b"  " for t in texts]
    data = _CLASS[np.frombuffer(b"".join(raw) + b"  ", np.uint8)]
    gap = (data == 32).astype(np.int8)
    wide = data.astype(np.uint32)
    code = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    at = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    at[gap[:-2] + gap[1:-1] + gap[2:] > 1] = BUCKETS
    starts = np.cumsum([0, *map(len, raw[:-1])])
    ends = starts + [len(r) - 2 for r in raw]
    for e in (ends, ends + 1):  # trigrams over the border of two texts
        at[e[e < len(at)]] = BUCKETS
    return at, starts, np.add.reduceat(1 - gap[: len(at)].astype(np.int64), starts)


def model(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors by rows, and log probabilities of buckets (languages x BUCKETS + 1, the last 0).

    Every primary subtag has a model, and every other label that is not empty: 64 KB each in the driver and the tasks.
    """
    label = F.col(label_col)
    rows = labelled.select(F.coalesce(subtag(label), F.lower(F.trim(label))).alias("lang"), F.col(text_col).alias("text")).where("lang <> '' and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k, n in total.items():
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(n[hit], pa.int64())], ["lang", "bucket", "n"])
            total.clear()

        for batch in batches:
            for b in sized(batch, 1):
                at, starts, _ = trigrams(b.column(1).to_pylist())
                parts = np.split(at, starts[1:])
                of: dict[str, list[np.ndarray]] = {}
                for k, part in zip(b.column(0).to_pylist(), parts, strict=True):
                    of.setdefault(k, []).append(part)
                for k, own in of.items():
                    total[k] = total.get(k, 0) + np.bincount(np.concatenate(own), minlength=BUCKETS + 1)[:BUCKETS]
                    if len(total) > BLOCK:
                        yield from out()
        yield from out()

    seen = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(seen)
    if not langs:
        return [], np.zeros(0), np.zeros((0, BUCKETS + 1), np.float32)
    counts = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    place = {k: i for i, k in enumerate(langs)}
    table = np.full((len(langs), BUCKETS + 1), -np.log(BUCKETS), np.float32)  # a label whose texts have no trigram says nothing
    for r in counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).toLocalIterator():  # BUCKETS pairs a row
        x = np.array([(p[0], p[1]) for p in r[1]], np.int64)
        n = np.full(BUCKETS, SMOOTHING)
        n[x[:, 0]] += x[:, 1]
        table[place[r[0]], :BUCKETS] = np.log(n / n.sum())
    table[:, BUCKETS] = 0
    prior = np.array([seen[k] for k in langs], float)
    return langs, np.log(prior / prior.sum()), table


def text_evidence(df: DataFrame, found: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """Columns of df but text, with logs (tempered text log likelihoods), own (text-only posterior) and readable."""
    langs, prior, table = found
    keep = [c for c in df.columns if c != "text"]
    kinds = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(table)
    step = max(1, (1 << 20) // len(langs))  # rows whose arrays are built at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for b in (x.slice(k, step) for x in sized(batch, len(keep)) for k in range(0, x.num_rows, step)):
                at, starts, letters = trigrams(b.column(len(keep)).to_pylist())
                n = np.add.reduceat((at < BUCKETS).astype(np.int64), starts)
                sums = np.stack([np.add.reduceat(t[at], starts, dtype=np.float64) for t in table], axis=1)
                mean = sums / np.maximum(n, 1)[:, None]
                logs = mean * (n / (1 + n / SATURATION))[:, None]
                own = np.exp((s := logs + prior) - s.max(axis=1, keepdims=True))
                own /= own.sum(axis=1, keepdims=True)
                own[n == 0] = 0
                ok = letters > 0
                width = pa.array(np.arange(b.num_rows + 1) * len(langs), pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *(pa.ListArray.from_arrays(width, pa.array(x.ravel())) for x in (logs, own)), pa.array(ok)], [*keep, "logs", "own", "readable"])

    return df.select(*keep, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", logs array<double>, own array<double>, readable boolean")


def identify(df: DataFrame, found: tuple[list[str], np.ndarray, np.ndarray], scratch: Scratch, least: float = LEAST) -> DataFrame:
    """Adds language, probability, text_language and kept to ``df(..., text, declared, suffix, host)``, less these inputs."""
    langs, prior, _ = found
    if not langs:
        zero = F.lit(0.0)
        return df.drop("text", "declared", "suffix", "host").withColumn("language", F.lit(UNKNOWN)).withColumn("probability", zero).withColumn("text_language", F.lit(UNKNOWN)).withColumn("kept", F.lit(False))
    base = F.array(*(F.lit(float(np.exp(p))) for p in prior))
    ev = scratch.put(text_evidence(df, found))
    blocks = [(at, min(BLOCK, len(langs) - at)) for at in range(0, len(langs), BLOCK)]

    def votes(by: str) -> DataFrame:
        """Sums of own, one aggregate of at most BLOCK languages a row, however many languages there are."""
        rows = ev.where(F.col(by).isNotNull() & F.col("readable"))
        if len(blocks) > 1:
            rows = rows.select(by, F.posexplode(F.array(*(F.slice("own", at + 1, n) for at, n in blocks))).alias("part", "own"))
        else:
            rows = rows.select(by, F.lit(0).alias("part"), "own")
        size = range(blocks[0][1])
        # the last block is shorter: its missing sums are null
        sums = rows.groupBy(by, "part").agg(*(F.sum(F.get("own", F.lit(i))).alias(f"v{i}") for i in size))
        part = F.filter(F.array(*(F.col(f"v{i}") for i in size)), lambda x: x.isNotNull())
        if len(blocks) == 1:
            return sums.select(by, part.alias(f"{by}_votes"))
        whole = sums.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("part", part.alias("v")))).alias("all"))
        return whole.select(by, F.flatten(F.col("all.v")).alias(f"{by}_votes"))

    # declared values and suffixes are short codes: two or three letters, or the last label of a host
    joined = ev.join(votes("declared"), "declared", "left").join(votes("suffix"), "suffix", "left").join(votes("host"), "host", "left")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    once = lambda c, f: F.transform(F.array(c), f)[0]  # c is worked out once, not for every language
    lean = lambda v, parent, w: once(total(v), lambda n: F.transform(F.arrays_zip(v.alias("a"), parent.alias("b")), lambda x: (F.greatest(x["a"], F.lit(0.0)) + w * x["b"]) / (F.greatest(n, F.lit(0.0)) + w)))
    zeros = F.array(*(F.lit(0.0) for _ in langs))
    joined = joined.withColumn("at_declared", F.when(F.col("declared_votes").isNull(), base).otherwise(lean(F.coalesce("declared_votes", zeros), base, F.lit(DECLARED_WEIGHT))))
    joined = joined.withColumn("at_suffix", F.when(F.col("suffix_votes").isNull(), base).otherwise(lean(F.coalesce("suffix_votes", zeros), base, F.lit(SUFFIX_WEIGHT))))
    others = F.when(F.col("host_votes").isNull(), zeros).otherwise(F.zip_with("host_votes", "own", lambda a, b: a - b))
    joined = joined.withColumn("others", others).withColumn("at_host", lean(F.col("others"), F.col("at_suffix"), F.lit(HOST_WEIGHT)))
    priors = F.array(*(F.lit(float(p)) for p in prior))
    logs = F.transform(F.arrays_zip("logs", "at_host", "at_declared", priors.alias("prior")), lambda x: x["logs"] + F.log(x["at_host"]) + F.log(x["at_declared"]) - x["prior"])
    joined = joined.withColumn("sum", logs).withColumn("top", F.array_max("sum"))
    joined = joined.withColumn("rate", F.exp(F.lit(0.0)) / once(F.col("top"), lambda t: total(F.transform("sum", lambda x: F.exp(x - t)))))
    names = F.array(*map(F.lit, langs))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    sure = F.col("readable") & (F.col("rate") >= least)
    joined = joined.withColumn("language", F.when(F.col("readable"), best(F.col("sum"))).otherwise(F.lit(UNKNOWN))).withColumn("probability", F.when(F.col("readable"), F.col("rate")).otherwise(F.lit(0.0)))
    joined = joined.withColumn("text_language", F.when(F.col("readable"), F.when(F.array_max("own") > 0, best(F.col("own"))).otherwise(F.lit(UNKNOWN))).otherwise(F.lit(UNKNOWN))).withColumn("kept", sure)
    return joined.select(*[c for c in df.columns if c not in {"text", "declared", "suffix", "host"}], "language", "probability", "text_language", "kept")


def subtag(column) -> F.Column:
    """The primary subtag of a declared language, or null."""
    x = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(x != "", x)


def from_documents(docs: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents as evidence: their language column is what they declare, their source is their host."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col("text"), subtag(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), *keep)


def from_pages(pages: DataFrame) -> DataFrame:
    """Pages as evidence: text without markup, the html element's lang, the host of the address and its last label."""
    html = F.col("html")
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>", " ")
    declared = subtag(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1))
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    suffix = F.regexp_extract(host, r"\.([a-z][a-z0-9-]{1,23})$", 1)
    return pages.select("page_id", text.alias("text"), declared.alias("declared"), F.when(suffix != "", suffix).alias("suffix"), F.when(host != "", host).alias("host"))
