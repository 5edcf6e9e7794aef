"""Samples of pages by strata: chapters share a quota by their pages, pages are spread evenly, and each says why it is there.

Edge cases: a document without a top-level entry is one chapter; a chapter never gets more pages than it has; a page
taken for several reasons is one row; documents without pages give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import quality, sequences


def chapters(tree: DataFrame, pages: DataFrame, top: int = 1) -> DataFrame:
    """doc_id, chapter, first, last: page ranges of the entries of level ``top``, each up to the page before the next; or one for all."""
    heads = tree.where(F.col("level") == top)
    nxt = F.lead("page_no").over(Window.partitionBy("doc_id").orderBy("pos"))
    own = heads.withColumn("_next", nxt).join(pages, "doc_id")
    last = F.when(F.col("_next").isNull(), F.col("total")).otherwise(F.greatest("page_no", F.col("_next") - 1))
    own = own.select("doc_id", F.col("pos").alias("chapter"), F.col("page_no").alias("first"), F.least(last, F.col("total")).alias("last"))
    none = pages.join(heads.select("doc_id").distinct(), "doc_id", "left_anti").where("total > 0")
    return own.unionByName(none.select("doc_id", F.lit(-1).alias("chapter"), F.lit(1).alias("first"), F.col("total").alias("last")))


def plan(tree: DataFrame, pages: DataFrame, share: float) -> DataFrame:
    """doc_id, page, reasons: a share of each document's pages (rounded up) over its chapters, and each chapter's first page."""
    ch = chapters(tree, pages).withColumn("size", (F.col("last") - F.col("first") + 1).cast("long"))
    ch = ch.join(pages.select("doc_id", F.ceil(F.col("total") * F.lit(float(share))).alias("seats")), "doc_id")
    quota = quality.largest_remainder(ch, ["doc_id"], "chapter", "size", F.col("seats"))
    granted = quality.within_capacity(quota, ["doc_id"], "chapter", "quota", "size")
    spread = quality.even_positions(granted.withColumnRenamed("granted", "n")).select("doc_id", F.col("position").alias("page"), F.lit("share").alias("reason"))
    opening = ch.select("doc_id", F.col("first").cast("long").alias("page"), F.lit("opening").alias("reason"))
    return sequences.with_reasons([spread, opening], ["doc_id", "page"])
