"""Entries against pages: page texts, best page nearby, one shift for a whole list, rising anchors, and joined parts.

A score is a function of two text columns (title, page text).  Candidates are exploded pages and one equi-join, so a
page's text is shipped once for each entry that asks for it, and no page is compared with all entries.

Edge cases: a null or missing page and a null title score 0; rows with a null key have no pages; ties go to the lowest
page, or the smallest shift, the negative one first; repeated pages count with their best score; empty tables give no
rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Score = Callable[[Column, Column], Column]
PLACES = 9  # decimals to which means are compared, whatever the order of summation


def page_texts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page_no, text: the texts of a page's blocks in reading order, joined by spaces; nulls are left out."""
    rows = blocks.groupBy(*keys, "page_no").agg(F.array_sort(F.collect_list(F.struct("reading_order", "text"))).alias("b"))
    return rows.select(*keys, "page_no", F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("text"))


def _scored(asked: DataFrame, pages: DataFrame, keys: list[str], by: list[str], score: Score) -> DataFrame:
    """Best score of every row of asked(keys, by, title, page) with the text of its page, 0 without one."""
    text = pages.select(*keys, F.col("page_no").alias("page"), F.col("text").alias("_text"))
    joined = asked.join(text, [*keys, "page"], "left").withColumn("score", F.coalesce(score(F.col("title"), F.col("_text")), F.lit(0.0)))
    return joined.groupBy(*keys, *by).agg(F.max("score").alias("score"))


def best_nearby(entries: DataFrame, pages: DataFrame, score: Score, reach: int, keys: list[str]) -> DataFrame:
    """keys, pos, page, score: of the pages that exist within reach of an entry's own, the one with the best score."""
    near = F.explode(F.sequence(F.col("page_no") - reach, F.col("page_no") + reach))
    asked = entries.select(*keys, "pos", "title", near.alias("page")).join(pages.select(*keys, F.col("page_no").alias("page")).distinct(), [*keys, "page"], "left_semi")
    found = _scored(asked, pages, keys, ["pos", "page"], score)
    best = found.groupBy(*keys, "pos").agg(F.max(F.struct("score", (-F.col("page")).alias("low"))).alias("b"))
    return best.select(*keys, "pos", (-F.col("b.low")).alias("page"), F.col("b.score").alias("score"))


def best_shift(entries: DataFrame, pages: DataFrame, score: Score, shifts: list[int], first: int, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """keys, group, shift, mean: the shift of pages with the best mean score of a group's first entries by pos."""
    by = [*keys, *(group or [])]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    asked = entries.withColumn("_r", rank).where(F.col("_r") <= first).withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))
    asked = asked.select(*by, "_r", "shift", "title", (F.col("page_no") + F.col("shift")).alias("page"))
    means = _scored(asked, pages, keys, [*(group or []), "_r", "shift"], score).groupBy(*by, "shift").agg(F.round(F.avg("score"), PLACES).alias("mean"))
    best = means.groupBy(*by).agg(F.max(F.struct("mean", (-F.abs("shift")).alias("near"), (-F.col("shift")).alias("low"))).alias("b"))
    return best.select(*by, (-F.col("b.low")).alias("shift"), F.col("b.mean").alias("mean"))


def shift_support(entries: DataFrame, pages: DataFrame, shifts: DataFrame, score: Score, least: float, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """keys, group, shift, entries, matched: how many of a group's entries score enough on their shifted pages."""
    by = [*keys, *(group or [])]
    asked = entries.join(shifts.select(*by, "shift"), by).select(*by, "pos", "shift", "title", (F.col("page_no") + F.col("shift")).alias("page"))
    found = _scored(asked, pages, keys, [*(group or []), "pos", "shift"], score)
    return found.groupBy(*by, "shift").agg(F.count("*").alias("entries"), F.count_if(F.col("score") >= least).alias("matched"))


def rising(rows: DataFrame, keys: list[str], wanted: str, start: int = 0) -> DataFrame:
    """rows with anchor: the place wanted, but at least one after the entry before it; a null wants none.

    With n the entry's number, anchor - n never falls, so it is the running maximum of wanted - n: a window, no fold.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    n = F.row_number().over(order) - 1
    most = F.max("_d").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_n", n).withColumn("_d", F.col(wanted) - F.col("_n"))
    return out.withColumn("anchor", F.col("_n") + F.greatest(F.coalesce(most, F.lit(start)), F.lit(start))).drop("_n", "_d")


def part_starts(rows: DataFrame, keys: list[str], part: str) -> DataFrame:
    """keys, part, start, size: where the rows of each part begin once the parts are joined in order."""
    sizes = rows.groupBy(*keys, part).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(*keys, part, F.coalesce(before, F.lit(0)).alias("start"), "size")


def relinked(refs: DataFrame, starts: DataFrame, keys: list[str], part: str, index: str) -> DataFrame:
    """refs with position: a pointer to a part's row, by its place there from 0, as a place among all; else null."""
    out = refs.join(starts, [*keys, part], "left")
    inside = (F.col(index) >= 0) & (F.col(index) < F.col("size"))
    return out.withColumn("position", F.when(inside, F.col("start") + F.col(index))).drop("start", "size")
