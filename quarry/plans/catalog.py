"""The library's own queries over a folder of test tables, and each one again as SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import geometry, quality, sequences, trees
from quarry.sources import canonical as C
from quarry.streaming import events as S

PAIR_KEYS = ["source", "section_id", "page", "item"]
LEVELS = [1, 2, 3]  # of the outlines that the test tables stand in for


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return C.outline(C.blocks(spark, d))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return C.blocks(spark, d).groupBy("doc_id").agg(F.max("page_no").alias("total"))


def _ranged(spark: SparkSession, d: str) -> DataFrame:
    return trees.subtree_ends(_tree(spark, d), _pages(spark, d), LEVELS)


def outline(spark, d):
    return _tree(spark, d)


def hierarchy_parent(spark, d):
    return trees.parents(_tree(spark, d), LEVELS).select("doc_id", "pos", "level", "parent_pos")


def subtree_end(spark, d):
    return trees.subtree_ends(_tree(spark, d), levels=LEVELS).select("doc_id", "pos", "level", "end_pos")


def page_ranges(spark, d):
    return _ranged(spark, d).select("doc_id", "pos", F.col("page_no").alias("page_start"), "page_end")


def hierarchy_path(spark, d):
    return trees.paths(_tree(spark, d), levels=LEVELS).select("doc_id", "pos", "path")


def block_owner(spark, d):
    return trees.owners(C.blocks(spark, d), _tree(spark, d))


def deepest_section(spark, d):
    return trees.deepest_on_page(_ranged(spark, d))


def tree_coverage(spark, d):
    return trees.coverage(block_owner(spark, d))


def tree_precision(spark, d):
    return trees.precision(block_owner(spark, d), _ranged(spark, d))


def tree_structure(spark, d):
    return trees.structure(trees.parents(_tree(spark, d), LEVELS))


def tree_status(spark, d):
    return trees.overall(tree_coverage(spark, d), tree_precision(spark, d), tree_structure(spark, d))


def tree_statistics(spark, d):
    return trees.statistics(_tree(spark, d), LEVELS)


def page_windows(spark, d):
    return sequences.page_windows(_pages(spark, d), 6, 2)


def overlap_trim(spark, d):
    w = page_windows(spark, d)
    rows = C.blocks(spark, d).join(w, "doc_id").where("page_no between first and last").select("doc_id", "window", "reading_order", "page_no")
    return sequences.trim_overlap(rows, w)


def continued_runs(spark, d):
    rows = C.blocks(spark, d).select("doc_id", "reading_order", "label", (F.col("reading_order") % 5 + 1).alias("value"))
    return sequences.continue_runs(rows, "reading_order", "label", "value")


def nearest_above(spark, d):
    b = C.blocks(spark, d).withColumnRenamed("reading_order", "id")
    t, h = b.where("label = 'text'"), b.where("label = 'section_header'")
    return geometry.nearest_above(t.select("doc_id", "page_no", "id", "x0", "x1", "top", "bottom"), h.select("doc_id", "page_no", "id", "x0", "x1", "top", "bottom"), ["doc_id", "page_no"])


def _row_boxes(spark, d, shift):
    li = C.read(spark, d, "lineitem")
    x, y, q = (F.col("l_partkey") % 37).cast("double") * 10 + shift, (F.col("l_suppkey") % 11).cast("double") * 10 + shift, F.col("l_quantity")
    # line numbers repeat in an order; rows that agree in all of these have equal boxes
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return li.select(F.col("l_orderkey").alias("page"), row.alias("id"), x.alias("x0"), y.alias("y0"), (x + q).alias("x1"), (y + q * 2).alias("y1"))


def iou_match_rows(spark, d):
    """A box for every row of the table, an order being a page, so that the match grows with it."""
    out = geometry.best_overlap(_row_boxes(spark, d, 0.0), _row_boxes(spark, d, 4.0), ["page"])
    return out.withColumn("score", F.round("score", 6))


def hamilton_allocation(spark, d):
    per = _pages(spark, d).join(C.read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return quality.largest_remainder(per, ["source"], "doc_id", "total", F.lit(25)).select("source", "doc_id", "total", "quota")


def even_sample(spark, d):
    r = hamilton_allocation(spark, d).select("doc_id", F.lit(1).alias("first"), F.col("total").alias("last"), F.col("quota").alias("n"))
    return quality.even_positions(r).select("doc_id", F.col("position").alias("page"))


def confidence_index(spark, d):
    return quality.weighted_index(C.findings(spark, d), ["source"]).withColumn("score", F.round("score", 6))


def version_pairs(spark, d):
    p = quality.paired(C.findings(spark, d), C.findings(spark, d, 2), PAIR_KEYS)
    return p.groupBy("source", "change").agg(F.count("*").alias("n"))


def version_diff(spark, d):
    return quality.differences(C.findings(spark, d), C.findings(spark, d, 2), PAIR_KEYS, ["result", "severity"])


def latest_event(spark, d):
    e = C.read(spark, d, "events")
    return sequences.latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


RULES = [("licence", r"(?i)licen[sc]e"), ("contact", r"[a-z0-9.]+@[a-z0-9.]+"), ("number", r"[0-9]{4,}"), ("table", r"\|")]


def first_rule(spark, d):
    b = C.blocks(spark, d)
    return b.withColumn("rule", sequences.first_rule(b, "text", RULES)).groupBy("rule").agg(F.count("*").alias("n"))


def normal_titles(spark, d):
    t = _tree(spark, d)
    return t.select("doc_id", "pos", X.normal(F.col("title")).alias("title"))


def roman_words(spark, d):
    """Every whole word of a title, its letters replaced by those of numerals, with its value or null."""
    letters = F.translate(F.lower("title"), "abefghjknopqrstuwyz", "ivxlcdmivxlcdmivxlc")
    t = _tree(spark, d).select("doc_id", "pos", F.posexplode(F.split(letters, " ")).alias("word", "token"))
    return t.withColumn("value", X.roman(F.col("token")))


def filled_drafts(spark, d):
    base = C.findings(spark, d).withColumn("result", F.when(F.substring("section_id", -1, 1).isin("0", "5"), "").otherwise(F.col("result")))
    drafts = C.findings(spark, d, 2).withColumn("batch", F.lit(1)).unionByName(C.findings(spark, d).where("page % 2 = 0").withColumn("batch", F.lit(2)))
    return sequences.filled(base, drafts, PAIR_KEYS, ["result", "severity"], "batch")


def key_changes(spark, d):
    return sequences.set_changes(C.findings(spark, d), C.findings(spark, d, 2), ["section_id"])


def event_windows(spark, d):
    return S.windowed(C.read(spark, d, "events"), "1 hour", ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def missing_words(spark, d):
    t = _tree(spark, d)
    rows = t.select("doc_id", "pos", F.split("title", " ").alias("a"), F.split(F.lower("title"), " ").alias("b"))
    n = sequences.multiset_minus(rows, ["doc_id", "pos"], "a", "b").groupBy("doc_id", "pos").agg(F.sum("n").cast("int").alias("missing"))
    return t.select("doc_id", "pos").join(n, ["doc_id", "pos"], "left").na.fill(0, ["missing"])


def title_similarity(spark, d):
    t = _tree(spark, d)
    nxt = t.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("title").alias("other"))
    return t.join(nxt, ["doc_id", "pos"]).select("doc_id", "pos", F.round(X.indel_similarity("title", "other"), 6).alias("ratio"), F.round(X.partial_similarity("title", "other"), 6).alias("partial"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        outline, hierarchy_parent, subtree_end, page_ranges, hierarchy_path, block_owner, deepest_section, tree_coverage, tree_precision, tree_structure, tree_status, tree_statistics,
        page_windows, overlap_trim, continued_runs, nearest_above, iou_match_rows, hamilton_allocation, even_sample, confidence_index, version_pairs, version_diff, filled_drafts, key_changes, latest_event, event_windows, first_rule,
        normal_titles, roman_words, missing_words, title_similarity,
    )
}

_B, _T = C.BLOCKS_SQL.strip(), C.OUTLINE_SQL.strip()
_TREE = f"WITH {_B}, {_T}"
_PAGES = "pages_of AS (SELECT doc_id, max(page_no) AS total FROM blocks GROUP BY doc_id)"
_PARENT = "parent AS (SELECT c.*, (SELECT max(p.pos) FROM outline p WHERE p.doc_id = c.doc_id AND p.pos < c.pos AND p.level < c.level) AS parent_pos FROM outline c)"
_RANGED = "nxt AS (SELECT c.*, (SELECT min(n.pos) FROM outline n WHERE n.doc_id = c.doc_id AND n.pos > c.pos AND n.level <= c.level) AS end_pos FROM outline c), ranged AS (SELECT c.*, CAST(least(CASE WHEN n.pos IS NULL THEN total ELSE greatest(c.page_no, n.page_no - 1) END, total) AS INTEGER) AS page_end FROM nxt c JOIN pages_of USING (doc_id) LEFT JOIN outline n ON n.doc_id = c.doc_id AND n.pos = c.end_pos)"
_OWNED = "owned AS (SELECT b.doc_id, b.reading_order, b.page_no, o.pos AS owner_pos FROM blocks b ASOF LEFT JOIN outline o ON b.doc_id = o.doc_id AND b.reading_order >= o.anchor)"
_COVER = "cover AS (SELECT doc_id, count(*) AS nodes, count(*) FILTER (n > 0) AS owned, count(*) FILTER (n > 1) AS twice, count(*) - count(*) FILTER (n > 0) AS orphans FROM (SELECT doc_id, reading_order, count(owner_pos) AS n FROM owned GROUP BY ALL) GROUP BY doc_id)"
_PREC = "prec AS (SELECT w.doc_id, count(*) AS nodes, count(*) FILTER (w.page_no < r.page_no - 1 OR w.page_no > r.page_end + 1) AS misplaced FROM owned w JOIN ranged r ON w.doc_id = r.doc_id AND w.owner_pos = r.pos GROUP BY w.doc_id)"
_STRUCT = "struct AS (SELECT c.doc_id, count(*) AS entries, count(*) FILTER (c.parent_pos IS NULL) AS roots, count(*) FILTER (c.parent_pos IS NOT NULL AND p.pos IS NULL) AS missing_parents, count(*) FILTER (c.parent_pos IS NOT NULL AND (c.parent_pos >= c.pos OR p.level >= c.level)) AS bad_parents, max(c.level) AS depth FROM parent c LEFT JOIN outline p ON p.doc_id = c.doc_id AND p.pos = c.parent_pos GROUP BY c.doc_id)"
_WINDOWS = "windows AS (SELECT doc_id, CAST(i AS INTEGER) AS window, CAST(i * 4 + 1 AS INTEGER) AS first, CAST(least(i * 4 + 6, total) AS INTEGER) AS last FROM (SELECT doc_id, total, unnest(range(0, CASE WHEN total <= 6 THEN 1 ELSE CAST(ceil((total - 6) / 4.0) AS BIGINT) + 1 END)) AS i FROM pages_of))"
_HAM = "share AS (SELECT source, doc_id, total, 25 * total::DOUBLE / sum(total) OVER (PARTITION BY source) AS s FROM pages_of JOIN documents USING (doc_id)), ham AS (SELECT source, doc_id, total, CAST(floor(s) + CASE WHEN row_number() OVER (PARTITION BY source ORDER BY s - floor(s) DESC, doc_id) <= 25 - sum(floor(s)) OVER (PARTITION BY source) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM share)"
_STATUS = lambda bad: f"CASE WHEN {bad} THEN 'FAIL' ELSE 'PASS' END AS status"
_ROW_BOX = lambda name, s: f"{name} AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS id, CAST(l_partkey % 37 AS DOUBLE) * 10 + {s} AS x0, CAST(l_suppkey % 11 AS DOUBLE) * 10 + {s} AS y0, x0 + l_quantity AS x1, y0 + l_quantity * 2 AS y1 FROM lineitem)"
_F = f"WITH {C.findings_sql('f1').strip()}, {C.findings_sql('f2', 2).strip()}"
_KEYS = ", ".join(PAIR_KEYS)
_VALUE = lambda i: f"CASE substr(token, {i}, 1) WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 WHEN 'm' THEN 1000 ELSE 0 END"

ORACLES: dict[str, str] = {
    "outline": f"{_TREE} SELECT * FROM outline",
    "hierarchy_parent": f"{_TREE}, {_PARENT} SELECT doc_id, pos, level, parent_pos FROM parent",
    "subtree_end": f"{_TREE}, {_PAGES}, {_RANGED} SELECT doc_id, pos, level, end_pos FROM ranged",
    "page_ranges": f"{_TREE}, {_PAGES}, {_RANGED} SELECT doc_id, pos, page_no AS page_start, page_end FROM ranged",
    "hierarchy_path": f"WITH RECURSIVE {_B}, {_T}, {_PARENT}, up AS (SELECT doc_id, pos, title AS path FROM parent WHERE parent_pos IS NULL UNION ALL SELECT c.doc_id, c.pos, up.path || ' > ' || c.title FROM parent c JOIN up ON up.doc_id = c.doc_id AND up.pos = c.parent_pos) SELECT * FROM up",
    "block_owner": f"{_TREE}, {_OWNED} SELECT * FROM owned",
    "deepest_section": f"{_TREE}, {_PAGES}, {_RANGED} SELECT doc_id, page, pos FROM (SELECT doc_id, CAST(page AS INTEGER) AS page, pos, row_number() OVER (PARTITION BY doc_id, page ORDER BY level DESC, pos) AS r FROM (SELECT doc_id, pos, level, unnest(range(page_no, page_end + 1)) AS page FROM ranged)) WHERE r = 1",
    "tree_coverage": f"{_TREE}, {_OWNED}, {_COVER} SELECT *, {_STATUS('twice > 0 OR orphans > 0')} FROM cover",
    "tree_precision": f"{_TREE}, {_PAGES}, {_RANGED}, {_OWNED}, {_PREC} SELECT *, {_STATUS('misplaced > 0')} FROM prec",
    "tree_structure": f"{_TREE}, {_PARENT}, {_STRUCT} SELECT *, {_STATUS('missing_parents > 0 OR bad_parents > 0')} FROM struct",
    "tree_status": f"{_TREE}, {_PAGES}, {_PARENT}, {_RANGED}, {_OWNED}, {_COVER}, {_PREC}, {_STRUCT} SELECT doc_id, count(*) AS checks, CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT doc_id, twice = 0 AND orphans = 0 AS ok FROM cover UNION ALL SELECT doc_id, misplaced = 0 FROM prec UNION ALL SELECT doc_id, missing_parents = 0 AND bad_parents = 0 FROM struct) GROUP BY doc_id",
    "tree_statistics": f"{_TREE}, {_PARENT} SELECT c.doc_id, c.level, count(*) AS entries, count(*) FILTER (c.parent_pos IS NULL) AS roots, count(*) FILTER (NOT EXISTS (SELECT 1 FROM parent k WHERE k.doc_id = c.doc_id AND k.parent_pos = c.pos)) AS leaves, max(c.level) AS depth FROM parent c GROUP BY GROUPING SETS ((c.doc_id, c.level), (c.doc_id))",
    "page_windows": f"{_TREE}, {_PAGES}, {_WINDOWS} SELECT * FROM windows",
    "overlap_trim": f"{_TREE}, {_PAGES}, {_WINDOWS} SELECT b.doc_id, w.window, b.reading_order, b.page_no FROM blocks b JOIN windows w ON b.doc_id = w.doc_id AND b.page_no BETWEEN w.first AND w.last LEFT JOIN windows v ON v.doc_id = w.doc_id AND v.window = w.window - 1 WHERE v.last IS NULL OR b.page_no > v.last",
    "continued_runs": f"{_TREE}, c AS (SELECT doc_id, reading_order, label, CAST(reading_order % 5 + 1 AS INTEGER) AS value, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY doc_id ORDER BY reading_order) THEN 1 ELSE 0 END AS s FROM blocks), r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY reading_order ROWS UNBOUNDED PRECEDING) AS run FROM c), m AS (SELECT doc_id, run, max(value) AS top FROM r GROUP BY ALL), b AS (SELECT doc_id, run, coalesce(sum(top) OVER (PARTITION BY doc_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM m) SELECT doc_id, reading_order, label, value, CAST(base + value AS BIGINT) AS absolute FROM r JOIN b USING (doc_id, run)",
    "nearest_above": f"{_TREE} SELECT doc_id, page_no, id, above FROM (SELECT t.doc_id, t.page_no, t.reading_order AS id, h.reading_order AS above, row_number() OVER (PARTITION BY t.doc_id, t.page_no, t.reading_order ORDER BY CASE WHEN h.x0 < t.x1 AND t.x0 < h.x1 THEN 0 ELSE 1 END, h.bottom - t.top, h.reading_order) AS r FROM blocks t JOIN blocks h ON t.doc_id = h.doc_id AND t.page_no = h.page_no AND h.label = 'section_header' AND h.bottom >= t.top - 2 WHERE t.label = 'text') WHERE r = 1",
    "iou_match_rows": f"WITH {_ROW_BOX('a', '0.0')}, {_ROW_BOX('b', '4.0')}, j AS (SELECT a.page, a.id, b.id AS match, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM a JOIN b USING (page)), k AS (SELECT page, id, match, i / (s - i) AS score FROM j WHERE s - i > 0 AND i / (s - i) >= 0.5) SELECT page, id, match, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY score DESC, match) AS r FROM k) WHERE r = 1",
    "hamilton_allocation": f"{_TREE}, {_PAGES}, {_HAM} SELECT source, doc_id, total, quota FROM ham",
    "even_sample": f"{_TREE}, {_PAGES}, {_HAM}, n AS (SELECT doc_id, total, least(quota, total) AS n FROM ham), e AS (SELECT doc_id, total, n, unnest(range(0, n)) AS i FROM n WHERE n > 0) SELECT doc_id, CAST(least(CASE WHEN n = 1 THEN 1 ELSE round_even(1 + (total - 1)::DOUBLE * i / (n - 1), 0) END, total) AS BIGINT) AS page FROM e",
    "confidence_index": f"{_F} SELECT source, count(*) AS evaluated, CAST(sum(CASE WHEN result = 'FAIL' THEN CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 4 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS weighted, round(greatest(least(100.0::DOUBLE * (1.0::DOUBLE - sum(CASE WHEN result = 'FAIL' THEN CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 4 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END ELSE 0 END)::DOUBLE / count(*)), 100.0), 0.0), 6) AS score FROM f1 GROUP BY source",
    "version_pairs": f"{_F} SELECT source, CASE WHEN f1.result = f2.result THEN 'same' WHEN f2.result = 'PASS' THEN 'fixed' ELSE 'regressed' END AS change, count(*) AS n FROM f1 JOIN f2 USING ({_KEYS}) GROUP BY ALL",
    "version_diff": f"{_F}, j AS (SELECT {_KEYS}, f1.result AS r1, f2.result AS r2, f1.severity AS s1, f2.severity AS s2 FROM f1 FULL JOIN f2 USING ({_KEYS})) SELECT {_KEYS}, 'result' AS field, r1 AS before, r2 AS after FROM j WHERE r1 IS DISTINCT FROM r2 UNION ALL SELECT {_KEYS}, 'severity', s1, s2 FROM j WHERE s1 IS DISTINCT FROM s2 UNION ALL SELECT {_KEYS}, 'row', 'present', NULL FROM f1 ANTI JOIN f2 USING ({_KEYS}) UNION ALL SELECT {_KEYS}, 'row', NULL, 'present' FROM f2 ANTI JOIN f1 USING ({_KEYS})",
    "filled_drafts": f"{_F}, b AS (SELECT source, section_id, page, item, CASE WHEN right(section_id, 1) IN ('0', '5') THEN '' ELSE result END AS result, severity FROM f1), d AS (SELECT *, 1 AS batch FROM f2 UNION ALL SELECT *, 2 FROM f1 WHERE page % 2 = 0), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY batch DESC) AS r FROM d) WHERE r = 1) SELECT {_KEYS}, CASE WHEN b.result = '' AND l.r = 1 THEN l.result ELSE b.result END AS result, CASE WHEN b.result = '' AND l.r = 1 THEN l.severity ELSE b.severity END AS severity, CASE WHEN b.result <> '' THEN 'official' WHEN l.r = 1 THEN 'draft' ELSE 'none' END AS origin FROM b LEFT JOIN l USING ({_KEYS})",
    "key_changes": f"{_F} SELECT section_id, 'removed' AS change FROM (SELECT section_id FROM f1 EXCEPT SELECT section_id FROM f2) UNION ALL SELECT section_id, 'added' FROM (SELECT section_id FROM f2 EXCEPT SELECT section_id FROM f1)",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "latest_event": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "first_rule": f"{_TREE} SELECT CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' WHEN regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') THEN 'contact' WHEN regexp_matches(text, '[0-9]{{4,}}') THEN 'number' WHEN regexp_matches(text, '\\|') THEN 'table' END AS rule, count(*) AS n FROM blocks GROUP BY ALL",
    "normal_titles": f"{_TREE}, w AS (SELECT doc_id, pos, list_transform(string_split_regex(lower(title), '[\\p{{Z}}\\x09-\\x0d\\x1c-\\x1f\\x{{85}}]+'), lambda x: array_to_string(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]'), '')) AS w FROM outline) SELECT doc_id, pos, array_to_string(list_filter(w, lambda x: x <> ''), ' ') AS title FROM w",
    "roman_words": f"{_TREE}, s AS (SELECT doc_id, pos, string_split(translate(lower(title), 'abefghjknopqrstuwyz', 'ivxlcdmivxlcdmivxlc'), ' ') AS w FROM outline), t AS (SELECT doc_id, pos, CAST(unnest(range(0, len(w))) AS INTEGER) AS word, unnest(w) AS token FROM s), l AS (SELECT doc_id, pos, word, unnest(range(1, length(trim(token)) + 1)) AS i, unnest(string_split(trim(token), '')) AS token FROM t WHERE trim(token) <> '' AND regexp_matches(trim(token), '{X.ROMAN}')), v AS (SELECT doc_id, pos, word, i, {_VALUE(1)} AS a FROM l), n AS (SELECT doc_id, pos, word, a, lead(a, 1, 0) OVER (PARTITION BY doc_id, pos, word ORDER BY i) AS b FROM v), x AS (SELECT doc_id, pos, word, CAST(sum(CASE WHEN a < b THEN -a ELSE a END) AS INTEGER) AS value FROM n GROUP BY ALL) SELECT doc_id, pos, word, token, value FROM t LEFT JOIN x USING (doc_id, pos, word)",
    "missing_words": f"{_TREE}, a AS (SELECT doc_id, pos, w, count(*) AS n FROM (SELECT doc_id, pos, unnest(string_split(title, ' ')) AS w FROM outline) GROUP BY ALL), b AS (SELECT doc_id, pos, w, count(*) AS n FROM (SELECT doc_id, pos, unnest(string_split(lower(title), ' ')) AS w FROM outline) GROUP BY ALL) SELECT doc_id, pos, CAST(sum(greatest(a.n - coalesce(b.n, 0), 0)) AS INTEGER) AS missing FROM a LEFT JOIN b USING (doc_id, pos, w) GROUP BY ALL",
}
