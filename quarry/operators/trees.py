"""Level-coded trees: parents, subtree ends, page ranges, paths, ownership, validation and statistics.

A tree is an ordered list of entries with levels, per document.  All operators are running windows and equi joins by
document, linear in the entries.  Operators that need the levels in use take them as ``levels``; without it they ask
the tree, which costs a scan.

Edge cases: an entry with a null level has no parent and is nobody's parent; documents are told apart by equality, so
rows with a null doc_id form a document of their own in windows and are left out by joins; equal anchors belong to the
entry that comes first; empty tables give no rows; other columns pass through where the docstring says "adds".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _levels(tree: DataFrame, levels: list[int] | None = None) -> list[int]:
    """The levels in use, lowest first; outlines have a handful."""
    return sorted(levels if levels is not None else (r[0] for r in tree.select("level").where("level is not null").distinct().collect()))


def _last(column, level: int, window) -> Column:
    return F.last(F.when(F.col("level") == level, column), ignorenulls=True).over(window)


def _before():
    return Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def _after():
    """Read backwards, so that it stays linear."""
    return Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)


def parents(tree: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Adds parent_pos: the nearest entry before with a lower level, null for roots.

    It is the latest of the last entries of each lower level: one sort and a running value for each level.
    """
    at = [F.when(F.col("level") > k, _last(F.col("pos"), k, _before())) for k in _levels(tree, levels)]
    return tree.withColumn("parent_pos", F.array_max(F.array(*at)) if at else F.lit(None).cast("int"))


def subtree_ends(tree: DataFrame, pages: DataFrame | None = None, levels: list[int] | None = None) -> DataFrame:
    """Adds end_pos (exclusive end of the subtree, null at the end of the document); with ``pages(doc_id, total)`` also page_end."""
    entry = F.struct("pos", "page_no")
    at = [F.when(F.col("level") >= k, _last(entry, k, _after())) for k in _levels(tree, levels)]
    out = tree.withColumn("_next", F.array_min(F.array_compact(F.array(*at))) if at else F.lit(None).cast("struct<pos:int,page_no:int>"))
    if pages is None:
        return out.withColumn("end_pos", F.col("_next.pos")).drop("_next")
    out = out.join(pages, "doc_id")
    end = F.when(F.col("_next").isNull(), F.col("total")).otherwise(F.greatest("page_no", F.col("_next.page_no") - 1))
    return out.withColumn("end_pos", F.col("_next.pos")).withColumn("page_end", F.least(end, F.col("total"))).drop("_next", "total")


def _chain(tree: DataFrame, column: str, levels: list[int] | None) -> list[Column]:
    """A column's value in each ancestor, from the root down, null where a level has none.

    The last entry of a lower level is an ancestor if no entry of a still lower level came after it.
    """
    parts, lower = [], F.lit(-1).cast("long")
    for k in _levels(tree, levels):
        pos = _last(F.col("pos"), k, _before())
        parts.append(F.when((F.col("level") > k) & (pos > lower), _last(F.col(column), k, _before())))
        lower = F.greatest(lower, pos)
    return parts


def paths(tree: DataFrame, sep: str = " > ", levels: list[int] | None = None) -> DataFrame:
    """Adds path: titles from the root down, without recursion."""
    return tree.withColumn("path", F.array_join(F.array_compact(F.array(*_chain(tree, "title", levels), F.col("title"))), sep))


def ancestors(tree: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """doc_id, pos, ancestor, distance: every proper ancestor of every entry, the parent at distance 1."""
    chain = F.array_compact(F.array(*_chain(tree, "pos", levels))) if _levels(tree, levels) else F.array().cast("array<int>")
    rows = tree.select("doc_id", "pos", chain.alias("_chain")).select("doc_id", "pos", F.posexplode(F.reverse("_chain")).alias("distance", "ancestor"))
    return rows.select("doc_id", "pos", "ancestor", (F.col("distance") + 1).alias("distance"))


def context(tree: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """doc_id, pos, previous, following, parent_pos, children: neighbours in order, and children as positions joined by commas."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = parents(tree, levels).select("doc_id", "pos", "parent_pos", F.lag("pos").over(w).alias("previous"), F.lead("pos").over(w).alias("following"))
    kids = t.where("parent_pos is not null").groupBy("doc_id", F.col("parent_pos").alias("pos")).agg(F.array_join(F.array_sort(F.collect_list(F.col("pos"))), ",").alias("children"))
    return t.join(kids, ["doc_id", "pos"], "left").select("doc_id", "pos", "previous", "following", "parent_pos", F.coalesce("children", F.lit("")).alias("children"))


def clusters(tree: DataFrame, top: int = 1) -> DataFrame:
    """Adds cluster: the position of the nearest entry at or before with level ``top`` or above it, null ahead of the first."""
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tree.withColumn("cluster", F.last(F.when(F.col("level") <= top, F.col("pos")), ignorenulls=True).over(upto))


def owners(blocks: DataFrame, tree: DataFrame) -> DataFrame:
    """Adds owner_pos: the last entry whose anchor is at or before the block (an as-of join by one sort), null before the first.

    Of entries with one anchor the first owns.  If the tree has a column ``boundary``, what follows an entry where that is
    true, up to the next entry, has no owner.
    """
    owner = F.when(~F.coalesce("boundary", F.lit(False)), F.col("pos")) if "boundary" in tree.columns else F.col("pos")
    mark = F.struct(F.col("pos").alias("at"), owner.alias("owner"))
    marks = tree.where("anchor is not null").select("doc_id", F.col("anchor").alias("reading_order"), mark.alias("mark"), F.lit(0).alias("_kind"), F.lit(None).cast(blocks.schema["page_no"].dataType).alias("page_no"))
    both = marks.unionByName(blocks.select("doc_id", "reading_order", F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), F.lit(1).alias("_kind"), "page_no"))
    w = Window.partitionBy("doc_id").orderBy("reading_order", "_kind", F.desc("mark.at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("owner_pos", F.last("mark", ignorenulls=True).over(w)["owner"]).where("_kind = 1").select("doc_id", "reading_order", "page_no", "owner_pos")


def deepest_on_page(tree: DataFrame) -> DataFrame:
    """doc_id, page, pos: the deepest entry whose page range holds the page, the first on ties.  Ranges become an equi key."""
    rows = tree.select("doc_id", "pos", "level", F.explode(F.sequence("page_no", "page_end")).alias("page"))
    best = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("level"), "pos"))
    return rows.withColumn("_r", best).where("_r = 1").select("doc_id", "page", "pos")


def coverage(owned: DataFrame) -> DataFrame:
    """Per document: nodes, owned nodes, nodes owned twice, orphans and the verdict."""
    one = owned.groupBy("doc_id", "reading_order").agg(F.count("owner_pos").alias("n"))
    out = one.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("n") > 0).alias("owned"), F.count_if(F.col("n") > 1).alias("twice"))
    return out.withColumn("orphans", F.col("nodes") - F.col("owned")).withColumn("status", F.when((F.col("twice") == 0) & (F.col("orphans") == 0), "PASS").otherwise("FAIL"))


def precision(owned: DataFrame, tree: DataFrame, tolerance: int = 1) -> DataFrame:
    """Per document: owned nodes, and how many lie outside their owner's pages by more than the tolerance."""
    j = owned.where("owner_pos is not null").join(tree.select("doc_id", F.col("pos").alias("owner_pos"), F.col("page_no").alias("first"), "page_end"), ["doc_id", "owner_pos"])
    off = (F.col("page_no") < F.col("first") - tolerance) | (F.col("page_no") > F.col("page_end") + tolerance)
    return j.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if(off).alias("misplaced")).withColumn("status", F.when(F.col("misplaced") == 0, "PASS").otherwise("FAIL"))


def structure(tree: DataFrame) -> DataFrame:
    """Per document of a tree with parent_pos: entries, roots, missing parents, parents not before or not above, deepest level."""
    up = tree.select("doc_id", F.col("pos").alias("parent_pos"), F.col("level").alias("parent_level"), F.lit(1).alias("_there"))
    j = tree.join(up, ["doc_id", "parent_pos"], "left")
    has = F.col("parent_pos").isNotNull()
    out = j.groupBy("doc_id").agg(
        F.count("*").alias("entries"),
        F.count_if(~has).alias("roots"),
        F.count_if(has & F.col("_there").isNull()).alias("missing_parents"),
        F.count_if(has & ((F.col("parent_pos") >= F.col("pos")) | (F.col("parent_level") >= F.col("level")))).alias("bad_parents"),
        F.max("level").alias("depth"),
    )
    return out.withColumn("status", F.when((F.col("missing_parents") == 0) & (F.col("bad_parents") == 0), "PASS").otherwise("FAIL"))


def front_matter(owned: DataFrame) -> DataFrame:
    """Per document: nodes, those that stand before the first owned one, and the orphans that are left without them."""
    first = Window.partitionBy("doc_id")
    rows = owned.withColumn("first", F.min(F.when(F.col("owner_pos").isNotNull(), F.col("reading_order"))).over(first))
    ahead = F.col("owner_pos").isNull() & (F.col("first").isNull() | (F.col("reading_order") < F.col("first")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if(ahead).alias("front"), F.count_if(F.col("owner_pos").isNull() & ~ahead).alias("orphans"))


def misplaced(owned: DataFrame, tree: DataFrame, tolerance: int = 1, limit: int = 20) -> DataFrame:
    """The first ``limit`` nodes of each document that lie outside their owner's pages by more than the tolerance."""
    j = owned.where("owner_pos is not null").join(tree.select("doc_id", F.col("pos").alias("owner_pos"), F.col("page_no").alias("first"), "page_end"), ["doc_id", "owner_pos"])
    off = j.where((F.col("page_no") < F.col("first") - tolerance) | (F.col("page_no") > F.col("page_end") + tolerance))
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy("reading_order"))
    return off.withColumn("_r", r).where(F.col("_r") <= limit).select("doc_id", "reading_order", "page_no", "owner_pos")


def compared(tree: DataFrame, outline: DataFrame) -> DataFrame:
    """Per document of either side: entries, expected entries, and entries whose level is not that of the outline at their place."""
    t = tree.select("doc_id", "pos", F.col("level").alias("has"), F.lit(1).alias("_t"))
    o = outline.select("doc_id", "pos", F.col("level").alias("wants"), F.lit(1).alias("_o"))
    j = t.join(o, ["doc_id", "pos"], "full_outer").groupBy("doc_id").agg(
        F.count("_t").alias("entries"), F.count("_o").alias("expected"), F.count_if(F.col("_t").isNotNull() & F.col("_o").isNotNull() & ~F.col("has").eqNullSafe(F.col("wants"))).alias("level_mismatches")
    )
    return j.withColumn("status", F.when((F.col("entries") == F.col("expected")) & (F.col("level_mismatches") == 0), "PASS").otherwise("FAIL"))


def unreached(tree: DataFrame, depth: int = 100) -> DataFrame:
    """Per document of a tree with parent_pos: entries that no root leads to within ``depth`` levels: those on and below cycles or missing parents."""
    spark = tree.sparkSession
    edges = tree.select("doc_id", "pos", "parent_pos")
    reached = spark.sql(
        f"""WITH RECURSIVE up MAX RECURSION LEVEL {int(depth)} AS (
            SELECT doc_id, pos FROM {{edges}} WHERE parent_pos IS NULL
            UNION ALL SELECT e.doc_id, e.pos FROM {{edges}} e JOIN up ON e.doc_id = up.doc_id AND e.parent_pos = up.pos)
        SELECT doc_id, pos FROM up""",
        edges=edges,
    )
    return edges.join(reached.distinct().withColumn("_there", F.lit(1)), ["doc_id", "pos"], "left").groupBy("doc_id").agg(F.count_if(F.col("_there").isNull()).alias("unreached"))


def overall(*checks: DataFrame) -> DataFrame:
    """Per document: PASS if every check that covers it passes."""
    rows = checks[0].select("doc_id", "status")
    for c in checks[1:]:
        rows = rows.unionByName(c.select("doc_id", "status"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("checks"), F.when(F.bool_and(F.col("status") == "PASS"), "PASS").otherwise("FAIL").alias("status"))


def statistics(tree: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Entries, roots, leaves and depth by level and, in the row with a null level, of each whole document."""
    t = parents(tree, levels)
    kids = t.where("parent_pos is not null").select("doc_id", F.col("parent_pos").alias("pos")).distinct().withColumn("_inner", F.lit(1))
    j = t.join(kids, ["doc_id", "pos"], "left")
    g = j.rollup("doc_id", "level").agg(F.count("*").alias("entries"), F.count_if(F.col("parent_pos").isNull()).alias("roots"), F.count_if(F.col("_inner").isNull()).alias("leaves"), F.max("level").alias("depth"))
    return g.where("doc_id is not null")
