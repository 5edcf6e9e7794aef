"""More queries over a folder of test tables: validation to the end, review analytics, context and order; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import alignment, geometry, quality, sampling, sequences, trees
from quarry.plans import catalog as K
from quarry.sources import canonical as C
from quarry.sources import files

LEVELS = K.LEVELS
REACH, FIRST, SHIFTS = 2, 4, [-3, -2, -1, 0, 1, 2, 3]
CAP, SHARE, AUDIT, AUDIT_LEAST = 75.0, 0.25, 0.1, 2


def section_context(spark, d):
    return trees.context(K._tree(spark, d), LEVELS)


def ancestors(spark, d):
    return trees.ancestors(K._tree(spark, d), LEVELS)


def chapter_of(spark, d):
    return trees.clusters(K._tree(spark, d)).select("doc_id", "pos", "cluster")


def misplaced_blocks(spark, d):
    """With no tolerance, so that there are some."""
    return trees.misplaced(K.block_owner(spark, d), K._ranged(spark, d).withColumn("page_end", F.col("page_no")), 0)


def front_matter(spark, d):
    return trees.front_matter(K.block_owner(spark, d))


def bounded_owner(spark, d):
    """Every fifth entry bounds the one before it and owns nothing."""
    t = K._tree(spark, d).withColumn("boundary", F.col("pos") % 5 == 4)
    return trees.owners(C.blocks(spark, d), t)


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """Parents that come later, are missing or form a cycle, levels that are off, entries that are gone."""
    t = trees.parents(K._tree(spark, d), LEVELS)
    k = F.col("doc_id") % 7
    parent = F.when((k == 1) & (F.col("pos") % 5 == 3), F.col("pos") + 1).when((k == 2) & (F.col("pos") % 5 == 4), 9999).when((k == 4) & (F.col("pos") < 2), 1 - F.col("pos")).otherwise(F.col("parent_pos"))
    level = F.col("level") + F.when((k == 3) & (F.col("pos") % 4 == 2), 1).otherwise(0)
    return t.where(~((k == 5) & (F.col("pos") % 6 == 5))).withColumn("parent_pos", parent.cast("int")).withColumn("level", level.cast("int"))


def tree_audit(spark, d):
    t = _damaged(spark, d)
    out = trees.compared(t, K._tree(spark, d)).drop("status")
    out = out.join(trees.structure(t).select("doc_id", "missing_parents", "bad_parents"), "doc_id").join(trees.unreached(t), "doc_id")
    return out.select("doc_id", "entries", "expected", "level_mismatches", "missing_parents", "bad_parents", "unreached")


def page_counts(spark, d):
    """Blocks and headings of each page up to a document's last, also of pages without any."""
    pages = K._pages(spark, d).select("doc_id", F.explode(F.sequence(F.lit(1), "total")).alias("page"))
    n = C.blocks(spark, d).groupBy("doc_id", F.col("page_no").alias("page")).agg(F.count("*").alias("blocks"), F.count_if(F.col("label") == "section_header").alias("headings"))
    return pages.join(n, ["doc_id", "page"], "left").na.fill(0, ["blocks", "headings"])


def column_bands(spark, d):
    li = C.read(spark, d, "lineitem")
    low = (F.col("l_partkey") % 50).cast("double")
    return geometry.bands(li.select("l_orderkey", (F.col("l_linenumber") % 3).alias("col"), low.alias("a"), (low + F.col("l_quantity")).alias("b")), ["l_orderkey"], "col", "a", "b")


def unique_boxes(spark, d):
    b = K._row_boxes(spark, d, 0.0).withColumn("x0", F.floor(F.col("x0") / 40) + F.col("id") / 16).withColumn("y0", F.floor(F.col("y0") / 60))
    return geometry.unique_boxes(b, ["page"], ["id"]).select("page", "id")


def unmatched_items(spark, d):
    li = C.read(spark, d, "lineitem")
    return sequences.unmatched(li, li.where("l_linenumber % 2 = 0"), ["l_partkey", "l_returnflag"])


def capped_index(spark, d):
    s = quality.weighted_index(C.findings(spark, d), ["source"])
    out = quality.capped_index(s, F.col("evaluated") % 2 == 0, F.col("weighted") % 3, CAP)
    return out.select("source", F.round("final", 6).alias("final"), "cap_applied", "state")


def failure_groups(spark, d):
    return quality.groups_of_failures(C.findings(spark, d), "item", "source", "section_id")


def failure_names(spark, d):
    return quality.numbered(C.findings(spark, d).where("result = 'FAIL'"), ["source", "item"], "group")


def cause_deltas(spark, d):
    targets = spark.createDataFrame([("en",), ("nobody",)], "item string")
    return quality.deltas(C.findings(spark, d), C.findings(spark, d, 2), K.PAIR_KEYS, "item", targets)


def latest_version(spark, d):
    v = F.concat(F.lit("v"), F.col("doc_id") % 13, F.lit("."), F.col("doc_id") % 11)
    rows = C.read(spark, d, "documents").select("source", v.alias("version"), (F.col("doc_id") % 4 != 0).alias("final"))
    return sequences.latest_version(rows, ["source"], F.col("final")).select("source", "version")


def standing_failures(spark, d):
    """What fails in the newest version that looked at it."""
    rows = C.findings(spark, d).withColumn("version", F.lit(1)).unionByName(C.findings(spark, d, 2).where("page % 3 <> 0").withColumn("version", F.lit(2)))
    return sequences.latest(rows, K.PAIR_KEYS, [F.desc("version")]).where("result = 'FAIL'").select(*K.PAIR_KEYS, "version", "severity")


def review_order(spark, d):
    f = C.findings(spark, d)
    rules = [("failed", F.col("result") == "FAIL"), ("page", F.col("page") % 10 == 0)]
    out = sequences.prioritized(f, ["source"], "section_id", rules, F.col("result") == "PASS", AUDIT, AUDIT_LEAST)
    return out.select("source", "section_id", "why", "place")


def finding_audit(spark, d):
    return sequences.set_audit(C.findings(spark, d).where("page % 5 <> 0"), C.findings(spark, d, 2), K.PAIR_KEYS, "result")


def sample_plan(spark, d):
    return sampling.plan(K._tree(spark, d), K._pages(spark, d), SHARE)


def nested_tree(spark, d):
    owned = K.block_owner(spark, d).where("owner_pos is not null").select("doc_id", F.col("owner_pos").alias("pos"), "reading_order", "page_no")
    out = files.nested(K._tree(spark, d).select("doc_id", "pos", "title"), owned, ["doc_id", "pos"], "reading_order")
    return out.select("doc_id", "pos", F.size("nodes").alias("n"), F.array_join(F.transform("nodes", lambda x: F.concat_ws("/", x["reading_order"].cast("string"), x["page_no"].cast("string"))), ",").alias("nodes"))


def page_texts(spark, d):
    return alignment.page_texts(C.blocks(spark, d), ["doc_id"])


def _printed(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose page numbers are too high, by as much as is left of the document's number by 3."""
    return K._tree(spark, d).withColumn("page_no", F.col("page_no") + (F.col("doc_id") % 3).cast("int"))


def nearby_page(spark, d):
    out = alignment.best_nearby(_printed(spark, d), page_texts(spark, d), X.word_share, REACH, ["doc_id"])
    return out.withColumn("score", F.round("score", 6))


def page_shift(spark, d):
    e, p = _printed(spark, d), page_texts(spark, d)
    best = alignment.best_shift(e, p, X.word_share, SHIFTS, FIRST, ["doc_id"])
    return alignment.shift_support(e, p, best, X.word_share, 1.0, ["doc_id"]).join(best.select("doc_id", F.round("mean", 6).alias("mean")), "doc_id")


def rising_anchors(spark, d):
    """Anchors found for some entries only, and not in order."""
    wanted = F.when(F.col("pos") % 3 != 1, F.col("anchor") - F.col("pos") % 4 * 3)
    return alignment.rising(K._tree(spark, d).withColumn("wanted", wanted), ["doc_id"], "wanted").select("doc_id", "pos", "anchor")


def relinked(spark, d):
    """Every block of a window points to the one before it there, which is told as a place among all blocks that stay."""
    rows = K.overlap_trim(spark, d)
    refs = rows.withColumn("index", F.row_number().over(Window.partitionBy("doc_id", "window").orderBy("reading_order")) - 2)
    return alignment.relinked(refs, alignment.part_starts(rows, ["doc_id"], "window"), ["doc_id"], "window", "index").select("doc_id", "reading_order", "position")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        section_context, ancestors, chapter_of, misplaced_blocks, front_matter, bounded_owner, tree_audit, page_counts, column_bands, unique_boxes, unmatched_items, capped_index, failure_groups,
        failure_names, cause_deltas, latest_version, standing_failures, review_order, finding_audit, sample_plan, nested_tree, page_texts, nearby_page, page_shift, rising_anchors, relinked,
    )
}

_T, _KEYS = K._TREE, K._KEYS
_REC = _T.replace("WITH ", "WITH RECURSIVE ", 1)
_DAMAGED = "dam AS (SELECT doc_id, pos, CAST(level + CASE WHEN doc_id % 7 = 3 AND pos % 4 = 2 THEN 1 ELSE 0 END AS INTEGER) AS level, CASE WHEN doc_id % 7 = 1 AND pos % 5 = 3 THEN pos + 1 WHEN doc_id % 7 = 2 AND pos % 5 = 4 THEN 9999 WHEN doc_id % 7 = 4 AND pos < 2 THEN 1 - pos ELSE parent_pos END AS parent_pos FROM parent WHERE NOT (doc_id % 7 = 5 AND pos % 6 = 5))"
_WEIGH = "CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 4 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"

_TEXTS = "texts AS (SELECT doc_id, page_no, string_agg(text, ' ' ORDER BY reading_order) AS text FROM blocks GROUP BY doc_id, page_no)"
_PRINTED = "printed AS (SELECT doc_id, pos, title, CAST(page_no + doc_id % 3 AS INTEGER) AS page_no FROM outline)"
_SHARE = "CAST(len(list_intersect(list_distinct(string_split(p.title, ' ')), string_split(t.text, ' '))) AS DOUBLE) / len(list_distinct(string_split(p.title, ' ')))"
_SHIFTED = "shifted AS (SELECT p.doc_id, p.pos, s.shift, coalesce(" + _SHARE + ", 0) AS score FROM printed p CROSS JOIN (SELECT CAST(unnest(range(-3, 4)) AS INTEGER) AS shift) s LEFT JOIN texts t ON t.doc_id = p.doc_id AND t.page_no = p.page_no + s.shift)"

ORACLES: dict[str, str] = {
    "section_context": f"{_T}, {K._PARENT}, k AS (SELECT doc_id, parent_pos AS pos, string_agg(pos, ',' ORDER BY pos) AS children FROM parent WHERE parent_pos IS NOT NULL GROUP BY ALL) SELECT doc_id, pos, lag(pos) OVER w AS previous, lead(pos) OVER w AS following, parent_pos, coalesce(children, '') AS children FROM parent LEFT JOIN k USING (doc_id, pos) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)",
    "ancestors": f"{_REC}, {K._PARENT}, up AS (SELECT doc_id, pos, parent_pos AS ancestor, 1 AS distance FROM parent WHERE parent_pos IS NOT NULL UNION ALL SELECT up.doc_id, up.pos, p.parent_pos, distance + 1 FROM up JOIN parent p ON p.doc_id = up.doc_id AND p.pos = up.ancestor WHERE p.parent_pos IS NOT NULL) SELECT * FROM up",
    "chapter_of": f"{_T} SELECT o.doc_id, o.pos, (SELECT max(c.pos) FROM outline c WHERE c.doc_id = o.doc_id AND c.pos <= o.pos AND c.level <= 1) AS cluster FROM outline o",
    "misplaced_blocks": f"{_T}, {K._OWNED} SELECT doc_id, reading_order, page_no, owner_pos FROM (SELECT w.*, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.reading_order) AS r FROM owned w JOIN outline o ON w.doc_id = o.doc_id AND w.owner_pos = o.pos WHERE w.page_no <> o.page_no) WHERE r <= 20",
    "front_matter": f"{_T}, {K._OWNED}, f AS (SELECT doc_id, min(reading_order) AS first FROM owned WHERE owner_pos IS NOT NULL GROUP BY doc_id) SELECT doc_id, count(*) AS nodes, count(*) FILTER (owner_pos IS NULL AND (first IS NULL OR reading_order < first)) AS front, count(*) FILTER (owner_pos IS NULL AND reading_order >= first) AS orphans FROM owned LEFT JOIN f USING (doc_id) GROUP BY doc_id",
    "bounded_owner": f"{_T}, {K._OWNED} SELECT doc_id, reading_order, page_no, CASE WHEN owner_pos % 5 <> 4 THEN owner_pos END AS owner_pos FROM owned",
    "tree_audit": f"{_REC}, {K._PARENT}, {_DAMAGED}, up AS (SELECT doc_id, pos FROM dam WHERE parent_pos IS NULL UNION ALL SELECT e.doc_id, e.pos FROM dam e JOIN up ON e.doc_id = up.doc_id AND e.parent_pos = up.pos), n AS (SELECT doc_id, count(*) AS expected FROM outline GROUP BY ALL) SELECT d.doc_id, count(*) AS entries, any_value(expected) AS expected, count(*) FILTER (d.level <> o.level) AS level_mismatches, count(*) FILTER (d.parent_pos IS NOT NULL AND p.pos IS NULL) AS missing_parents, count(*) FILTER (d.parent_pos >= d.pos OR p.level >= d.level) AS bad_parents, count(*) FILTER (u.pos IS NULL) AS unreached FROM dam d JOIN n USING (doc_id) JOIN outline o ON o.doc_id = d.doc_id AND o.pos = d.pos LEFT JOIN dam p ON p.doc_id = d.doc_id AND p.pos = d.parent_pos LEFT JOIN up u ON u.doc_id = d.doc_id AND u.pos = d.pos GROUP BY d.doc_id",
    "page_counts": f"{_T}, {K._PAGES}, p AS (SELECT doc_id, CAST(unnest(range(1, total + 1)) AS INTEGER) AS page FROM pages_of) SELECT p.doc_id, p.page, count(b.text) AS blocks, count(*) FILTER (b.label = 'section_header') AS headings FROM p LEFT JOIN blocks b ON b.doc_id = p.doc_id AND b.page_no = p.page GROUP BY ALL",
    "column_bands": "SELECT l_orderkey, l_linenumber % 3 AS col, CAST(min(l_partkey % 50) AS DOUBLE) AS low, max(l_partkey % 50 + l_quantity) AS high FROM lineitem GROUP BY ALL",
    "unique_boxes": f"WITH {K._ROW_BOX('a', '0.0')} SELECT page, id FROM (SELECT page, id, row_number() OVER (PARTITION BY page, round_even(floor(x0 / 40) + id / 16.0::DOUBLE, 0), floor(y0 / 60) ORDER BY id) AS r FROM a) WHERE r = 1",
    "unmatched_items": "SELECT l_partkey, l_returnflag, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING sum(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END) > 0",
    "capped_index": f"{K._F}, s AS (SELECT source, count(*) AS evaluated, sum(CASE WHEN result = 'FAIL' THEN {_WEIGH} ELSE 0 END) AS w FROM f1 GROUP BY source), x AS (SELECT *, greatest(0.0::DOUBLE, 100.0::DOUBLE - 100.0::DOUBLE * w / evaluated) AS score FROM s) SELECT source, round(CASE WHEN evaluated % 2 = 0 THEN least(score, {CAP}) ELSE score END, 6) AS final, evaluated % 2 = 0 AND score > {CAP} AS cap_applied, CASE WHEN w % 3 > 0 THEN 'pending' ELSE 'final' END AS state FROM x",
    "failure_groups": f"{K._F} SELECT item AS cause, count(*) AS failures, count(DISTINCT source) AS places, arg_max(severity, {_WEIGH}) AS top, string_agg(DISTINCT section_id, ',' ORDER BY section_id) AS sections FROM f1 WHERE result = 'FAIL' GROUP BY item",
    "failure_names": f"{K._F} SELECT source, item, printf('group-%03d', row_number() OVER (ORDER BY source, item)) AS name FROM (SELECT DISTINCT source, item FROM f1 WHERE result = 'FAIL')",
    "cause_deltas": f"{K._F}, b AS (SELECT f1.item, true AS base, f1.result, f2.section_id IS NOT NULL AS paired FROM f1 LEFT JOIN f2 USING ({_KEYS}) UNION ALL SELECT f2.item, false, f2.result, f1.section_id IS NOT NULL FROM f2 LEFT JOIN f1 USING ({_KEYS})), t AS (SELECT unnest(['en', 'nobody']) AS item), c AS (SELECT item FROM t UNION SELECT item FROM b WHERE result = 'FAIL') SELECT c.item AS cause, c.item IN (SELECT item FROM t) AS target, count(*) FILTER (base AND result = 'FAIL') AS before, count(*) FILTER (NOT base AND result = 'FAIL') AS after, count(*) FILTER (base AND paired AND result = 'FAIL') AS paired_before, count(*) FILTER (NOT base AND paired AND result = 'FAIL') AS paired_after FROM c LEFT JOIN b ON b.item = c.item GROUP BY ALL",
    "latest_version": "SELECT source, 'v' || (top // 100) || '.' || (top % 100) AS version FROM (SELECT source, max(doc_id % 13 * 100 + doc_id % 11) AS top FROM documents WHERE doc_id % 4 <> 0 GROUP BY source)",
    "standing_failures": f"{K._F}, n AS (SELECT * FROM f2 WHERE page % 3 <> 0) SELECT {_KEYS}, CAST(CASE WHEN n.result IS NULL THEN 1 ELSE 2 END AS INTEGER) AS version, CASE WHEN n.result IS NULL THEN f1.severity ELSE n.severity END AS severity FROM f1 FULL JOIN n USING ({_KEYS}) WHERE coalesce(n.result, f1.result) = 'FAIL'",
    "review_order": f"{K._F}, r AS (SELECT *, row_number() OVER (PARTITION BY source, result ORDER BY sha256(section_id), section_id) AS r, count(*) FILTER (result = 'PASS') OVER (PARTITION BY source) AS n FROM f1), w AS (SELECT source, section_id, CASE WHEN result = 'FAIL' THEN 'failed' WHEN page % 10 = 0 THEN 'page' WHEN r <= greatest({AUDIT_LEAST}, ceil(n * {AUDIT}::DOUBLE)) THEN 'audit' ELSE 'rest' END AS why FROM r) SELECT *, CAST(list_position(['failed', 'page', 'audit', 'rest'], why) AS INTEGER) AS place FROM w",
    "finding_audit": f"{K._F}, e AS (SELECT * FROM f1 WHERE page % 5 <> 0) SELECT {_KEYS}, 'missing' AS issue FROM e ANTI JOIN f2 USING ({_KEYS}) UNION ALL SELECT {_KEYS}, 'extra' FROM f2 ANTI JOIN e USING ({_KEYS}) UNION ALL SELECT {_KEYS}, 'differs' FROM e JOIN f2 USING ({_KEYS}) WHERE e.result <> f2.result",
    "nested_tree": f"{_T}, {K._OWNED} SELECT o.doc_id, o.pos, CAST(count(w.reading_order) AS INTEGER) AS n, coalesce(string_agg(w.reading_order || '/' || w.page_no, ',' ORDER BY w.reading_order), '') AS nodes FROM outline o LEFT JOIN owned w ON w.doc_id = o.doc_id AND w.owner_pos = o.pos GROUP BY o.doc_id, o.pos",
    "page_texts": f"{_T}, {_TEXTS} SELECT * FROM texts",
    "nearby_page": f"{_T}, {_TEXTS}, {_PRINTED}, c AS (SELECT p.doc_id, p.pos, t.page_no AS page, {_SHARE} AS score FROM printed p JOIN texts t ON t.doc_id = p.doc_id AND abs(t.page_no - p.page_no) <= 2) SELECT doc_id, pos, page, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, page) AS r FROM c) WHERE r = 1",
    "page_shift": f"{_T}, {_TEXTS}, {_PRINTED}, {_SHIFTED}, f AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM printed) WHERE r <= 4), m AS (SELECT doc_id, shift, round(avg(score), 9) AS mean FROM shifted JOIN f USING (doc_id, pos) GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mean DESC, abs(shift), shift) AS r FROM m) WHERE r = 1) SELECT doc_id, shift, count(*) AS entries, count(*) FILTER (score >= 1) AS matched, round(any_value(mean), 6) AS mean FROM shifted JOIN b USING (doc_id, shift) GROUP BY doc_id, shift",
    "rising_anchors": f"{_REC}, w AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, CASE WHEN pos % 3 <> 1 THEN anchor - pos % 4 * 3 END AS wanted FROM outline), up AS (SELECT doc_id, pos, i, CAST(greatest(coalesce(wanted, 0), 0) AS INTEGER) AS anchor FROM w WHERE i = 1 UNION ALL SELECT w.doc_id, w.pos, w.i, CAST(greatest(coalesce(w.wanted, 0), up.anchor + 1) AS INTEGER) FROM w JOIN up ON w.doc_id = up.doc_id AND w.i = up.i + 1) SELECT doc_id, pos, anchor FROM up",
    "relinked": f"{_T}, {K._PAGES}, {K._WINDOWS}, k AS (SELECT b.doc_id, w.window, b.reading_order FROM blocks b JOIN windows w ON b.doc_id = w.doc_id AND b.page_no BETWEEN w.first AND w.last LEFT JOIN windows v ON v.doc_id = w.doc_id AND v.window = w.window - 1 WHERE v.last IS NULL OR b.page_no > v.last), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k.window, reading_order) - 1 AS place FROM k) SELECT doc_id, reading_order, lag(place) OVER (PARTITION BY doc_id, g.window ORDER BY reading_order) AS position FROM g",
}
