"""Canonical tables derived from a folder of generic test tables, and the same derivations as SQL for a second engine.

Documents stand in for extracted layouts: each line is a block, twelve lines make a page, short lines are headings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES_PER_PAGE = 12
HEADING_CHARS = 40


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, reading_order, page_no, label, heading_level, text and a box with a bottom-left origin."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("reading_order", "text")).where("text <> ''")
    n = F.length("text")
    row = F.col("reading_order") % LINES_PER_PAGE
    return lines.select(
        "doc_id",
        "reading_order",
        (F.lit(1) + F.floor(F.col("reading_order") / LINES_PER_PAGE)).cast("int").alias("page_no"),
        F.when(n <= HEADING_CHARS, "section_header").otherwise("text").alias("label"),
        (F.lit(1) + n % 3).cast("int").alias("heading_level"),
        "text",
        F.lit(50.0).alias("x0"),
        (F.lit(50.0) + F.least(n, F.lit(100)) * 5).alias("x1"),
        (F.lit(780.0) - row * 60).alias("top"),
        (F.lit(770.0) - row * 60).alias("bottom"),
    )


BLOCKS_SQL = f"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS reading_order FROM documents),
blocks AS (SELECT doc_id, CAST(reading_order AS INTEGER) AS reading_order, CAST(1 + reading_order // {LINES_PER_PAGE} AS INTEGER) AS page_no,
  CASE WHEN length(text) <= {HEADING_CHARS} THEN 'section_header' ELSE 'text' END AS label, CAST(1 + length(text) % 3 AS INTEGER) AS heading_level, text,
  50.0::DOUBLE AS x0, 50.0::DOUBLE + least(length(text), 100) * 5 AS x1, 780.0::DOUBLE - (reading_order % {LINES_PER_PAGE}) * 60 AS top, 770.0::DOUBLE - (reading_order % {LINES_PER_PAGE}) * 60 AS bottom
  FROM lines WHERE text <> '')"""


def outline(blocks: DataFrame) -> DataFrame:
    """The headings of each document as its outline: pos (from 0), level, title, page_no, anchor."""
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("reading_order")) - 1
    heads = blocks.where("label = 'section_header' and trim(text) <> ''")
    return heads.select("doc_id", pos.cast("int").alias("pos"), F.col("heading_level").alias("level"), F.trim("text").alias("title"), "page_no", F.col("reading_order").alias("anchor"))


OUTLINE_SQL = """
outline AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY reading_order) - 1 AS INTEGER) AS pos, heading_level AS level, trim(text) AS title, page_no, reading_order AS anchor
  FROM blocks WHERE label = 'section_header' AND trim(text) <> '')"""


def findings(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    """Checked items: source, section, page, item, result and severity; version 2 has items flipped and missing."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    passed = F.col("quality") == 1 if version == 1 else ((F.col("quality") == 1) != (F.col("doc_id") % 11 == 0))
    sev = F.when(F.col("toxic") == 1, "critical").when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low")
    d = d if version == 1 else d.where("doc_id % 7 <> 3")
    return d.select("source", F.format_string("sec_%06d", "doc_id").alias("section_id"), (F.col("doc_id") % 50 + 1).cast("int").alias("page"), F.col("lang").alias("item"), F.when(passed, "PASS").otherwise("FAIL").alias("result"), F.when(~passed, sev).alias("severity"))


def findings_sql(name: str, version: int = 1) -> str:
    passed = "quality = 1" if version == 1 else "((quality = 1) <> (doc_id % 11 = 0))"
    return f"""
{name} AS (SELECT source, printf('sec_%06d', doc_id) AS section_id, CAST(doc_id % 50 + 1 AS INTEGER) AS page, lang AS item, CASE WHEN {passed} THEN 'PASS' ELSE 'FAIL' END AS result,
  CASE WHEN NOT ({passed}) THEN CASE WHEN toxic = 1 THEN 'critical' WHEN doc_id % 3 = 0 THEN 'high' WHEN doc_id % 3 = 1 THEN 'medium' ELSE 'low' END END AS severity
  FROM documents JOIN labels USING (doc_id){'' if version == 1 else ' WHERE doc_id % 7 <> 3'})"""
