"""The corpus pipeline: each stage takes documents and returns what it keeps of them; the last packs sequences.

Every stage is called with the stage before it written and reread.  A stage sees only what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import language, minhash, mixing, packing, suffixes
from quarry.llm.common import Scratch
from quarry.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure enough, with that language; those that language ID rejects go.

    A row is known by its id and a hash of its evidence, so repeated and null ids are judged row by row.  Null, empty
    and letterless texts go; an empty table gives no rows; other columns are left out.
    """
    docs = _columns(docs)
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text", "lang", "source"))
    rows = language.from_documents(docs, keep=("row",))
    found = language.identify(rows, language.model(docs), Scratch(spark, "language"))
    kept = found.where("kept").groupBy("row").agg(F.first("language").alias("language"))
    return docs.join(kept, "row").select("doc_id", "text", F.col("language").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; rows with a null id stay.

    Rows are known by id and text: of two texts under one id each is judged by itself, and of rows that repeat both one
    stays.  Null and empty texts are one group; an empty table gives no rows; other columns are left out.
    """
    docs = _columns(docs)
    kept = minhash.near_duplicates(docs, Scratch(spark, "minhash"), keep_digest=True).where("kept and doc_id is not null").select("doc_id", "digest").distinct()
    known = docs.where("doc_id is not null").withColumn("digest", F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)))
    one = known.join(kept, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    return one.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages of 200 bytes or more that occur elsewhere too.

    Every document stays, if with an empty text; a null text becomes an empty one; null and repeated ids are rows like
    others; an empty table gives no rows; other columns are left out.
    """
    out = suffixes.deduplicated(_columns(docs), Scratch(spark, "suffixes"), keep_text=True, extra=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them; a part that is taken is a document of its own.

    Null and empty texts have no words to take and go; null sources are a source; null and repeated ids are rows like
    others; an empty table gives no rows; other columns are left out.
    """
    mixed = mixing.mix(docs, Scratch(spark, "mix"), keep_text=True, extra=("lang",))
    return mixing.expand(mixed, COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of at most 2048 tokens.

    Null and empty texts are packed as their end token; null and repeated ids are packed row by row; an empty table
    gives no rows; other columns are ignored.
    """
    return packing.pack(docs, tokenizer_path(), Scratch(spark, "pack"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None  # signatures, suffix sorting and the tokenizer are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and reread in the shared scratch folder."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
