"""The queries of this package, by name, over the tables of a folder; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, media, minhash, mixing, packing, scoring, suffixes, toxicity, vectors, warc
from .common import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is a table of its own; digests and ranges are read from it."""
    table = Scratch(spark, "op2").put(media.store(_read(spark, sf_dir, "documents"), "doc_id", "text"), "zstd")
    found = media.digests(table, "doc_id", keep=("n_bytes", "codec", "timescale", "duration", "n_samples", "keyframes"))
    return found.select("doc_id", "n_bytes", *(x.split()[0] for x in media.DIGEST.split(", ")), "codec", (F.col("duration") / F.col("timescale")).alias("seconds"), "n_samples", "keyframes")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_read(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages, by models counted over all documents; rows of documents have doc_id, of pages page_id."""
    docs, pages = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    rows = language.from_documents(docs).withColumn("page_id", none).unionByName(language.from_pages(pages).withColumn("doc_id", none))
    return language.identify(rows, language.model(docs), Scratch(spark, "op4"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), Scratch(spark, "op6"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_read(spark, sf_dir, "embeddings"), Scratch(spark, "op7"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), Scratch(spark, "op8"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(_read(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op10")
    archives = scratch.put(warc.write_archives(warc.mark_revisits(_read(spark, sf_dir, "pages"))))
    whole = F.when(F.col("kind") == "record", F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("a gap in"), "archive", F.lit("at"), "offset", F.lit(":"), "reason")).cast("boolean"))
    return warc.read_archives(archives).where(whole).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_media_columns, op3_lm_scoring, op4_language_id, op5_toxicity, op6_best_fit_packing, op7_embedding_near_dedup, op8_source_mixing, op9_suffix_dedup, op10_warc)}

ORACLES: dict[str, str] = {
    # All pairs that share a shingle; for small tables.
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        c AS (SELECT text, min(doc_id) AS class_id, row_number() OVER (ORDER BY min(doc_id), sha256(text)) AS k FROM d GROUP BY text),
        w AS (SELECT k, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM c WHERE class_id IS NOT NULL),
        s AS (SELECT k, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE len(w) > 0),
        n AS (SELECT k, g, count(*) AS n FROM s GROUP BY ALL),
        t AS (SELECT k, sum(n) AS t FROM n GROUP BY k),
        p AS (SELECT a.k AS a, b.k AS b, sum(least(a.n, b.n)) AS i FROM n a JOIN n b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN t x ON x.k = a JOIN t y ON y.k = b WHERE i::DOUBLE / (x.t + y.t - i) >= 0.8::DOUBLE),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT k AS node, k AS low FROM c WHERE class_id IS NOT NULL UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node),
        m AS (SELECT node, min(low) AS low FROM r GROUP BY node)
        SELECT doc_id, CASE WHEN doc_id IS NOT NULL THEN c.class_id END AS class_id, CASE WHEN doc_id IS NOT NULL THEN f.class_id END AS component_id, doc_id IS NULL OR (doc_id = f.class_id AND c.k = f.k) AS kept
        FROM d JOIN c USING (text) LEFT JOIN m ON m.node = c.k LEFT JOIN c f ON f.k = m.low""",
    # All pairs; for small tables.
    "op7_embedding_near_dedup": """
        WITH RECURSIVE d AS (SELECT DISTINCT vec_id, label, embedding FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        v AS (SELECT *, embedding::DOUBLE[] AS v, row_number() OVER () AS k FROM d),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b, a.k AS k FROM v a JOIN v b ON a.label = b.label AND a.k <> b.k AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        r AS (SELECT vec_id AS node, vec_id AS low FROM embeddings WHERE vec_id IS NOT NULL UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node),
        m AS (SELECT node, min(low) AS component_id FROM r GROUP BY node), n AS (SELECT k, count(*) AS n FROM l GROUP BY k)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id IS NULL OR e.vec_id = component_id AS kept
        FROM embeddings e LEFT JOIN m ON m.node = e.vec_id LEFT JOIN v ON v.vec_id = e.vec_id AND v.label = e.label AND v.embedding = e.embedding LEFT JOIN n ON n.k = v.k""",
    "op10_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS first FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f""",
}
