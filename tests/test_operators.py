"""Operators on tiny inputs and against plain-Python models."""

import functools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import alignment, geometry, quality, sampling, sequences, trees


def lcs(a, b):
    @functools.cache
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

    return f(0, 0)


@given(st.text("abc ", max_size=14), st.text("abc ", max_size=14))
@settings(max_examples=200, deadline=None)
def test_indel_is_the_lcs_ratio(a, b):
    want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
    assert abs(X.indel(a, b) - want) < 1e-9


@given(st.text("abc", max_size=8), st.text("abc", max_size=12))
@settings(max_examples=100, deadline=None)
def test_best_window_is_the_best_stretch(a, b):
    s, t = sorted((a, b), key=len)
    n = len(s)
    want = max([X.indel(s, t[max(0, i) : i + n]) for i in range(1 - n, len(t))], default=100.0 if not t else 0.0) if n else (100.0 if not t else 0.0)
    assert abs(X.best_window(a, b) - want) < 1e-9


def test_similarity_columns_pass_nulls(spark):
    r = spark.createDataFrame([("abc", "abd"), (None, "x")], "a string, b string").select(X.indel_similarity("a", "b"), X.partial_similarity("a", "b")).collect()
    assert abs(r[0][0] - 200 * 2 / 6) < 1e-9 and r[1][0] is None and r[1][1] is None


def test_roman(spark):
    r = spark.createDataFrame([("iv",), ("MCMXCIV",), ("iiii",), ("",), ("abc",), (" xl ",), (None,)], "t string").select(X.roman(F.col("t"))).collect()
    assert [x[0] for x in r] == [4, 1994, None, None, None, 40, None]


def test_tree_against_a_stack(spark):
    rng = random.Random(3)
    rows = [(d, i, rng.randint(1, 4), f"t{i}", i + 1) for d in range(5) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, level int, title string, page_no int")
    up = {(r.doc_id, r.pos): r.parent_pos for r in trees.parents(df).collect()}
    path = {(r.doc_id, r.pos): r.path for r in trees.paths(df).collect()}
    end = {(r.doc_id, r.pos): r.end_pos for r in trees.subtree_ends(df).collect()}
    for d in range(5):
        stack = []
        mine = [r for r in rows if r[0] == d]
        for _, i, level, title, _ in mine:
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert up[d, i] == (stack[-1][0] if stack else None)
            stack.append((i, level, title))
            assert path[d, i] == " > ".join(x[2] for x in stack)
            assert end[d, i] == next((r[1] for r in mine if r[1] > i and r[2] <= level), None)


def test_owner_is_the_tightest_range(spark):
    tree = spark.createDataFrame([(1, 0, 3), (1, 1, 5), (2, 0, 0)], "doc_id long, pos int, anchor int")
    blocks = spark.createDataFrame([(1, i, 1) for i in range(7)] + [(3, 0, 1)], "doc_id long, reading_order int, page_no int")
    got = {(r.doc_id, r.reading_order): r.owner_pos for r in trees.owners(blocks, tree).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): None, (1, 3): 0, (1, 4): 0, (1, 5): 1, (1, 6): 1, (3, 0): None}


def test_structure_reports_bad_parents(spark):
    t = spark.createDataFrame([(1, 0, 1, None), (1, 1, 2, 0), (1, 2, 2, 9), (1, 3, 1, 1), (2, 0, 1, None)], "doc_id long, pos int, level int, parent_pos int")
    got = {r.doc_id: (r.missing_parents, r.bad_parents, r.status) for r in trees.structure(t).collect()}
    assert got == {1: (1, 2, "FAIL"), 2: (0, 0, "PASS")}  # a parent that is missing also does not come before


def test_boxes(spark):
    one = spark.range(1).select(geometry.iou(tuple(map(F.lit, (0.0, 0.0, 2.0, 2.0))), tuple(map(F.lit, (1.0, 1.0, 3.0, 3.0)))).alias("i"), *(c.alias(n) for n, c in zip(("t", "b"), geometry.top_left(F.lit(10.0), F.lit(30.0), F.lit(100.0), F.lit("bottomleft")))))
    r = one.collect()[0]
    assert abs(r.i - 1 / 7) < 1e-12 and (r.t, r.b) == (70.0, 90.0)


def test_windows_and_trim(spark):
    w = sequences.page_windows(spark.createDataFrame([(1, 14), (2, 3), (3, 6)], "doc_id long, total int"), 6, 2).orderBy("doc_id", "window")
    assert [tuple(r) for r in w.collect()] == [(1, 0, 1, 6), (1, 1, 5, 10), (1, 2, 9, 14), (2, 0, 1, 3), (3, 0, 1, 6)]


def test_allocation_sums_to_the_seats(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 9)) for g in range(6) for i in range(7)] + [(9, 0, 0), (9, 1, 0)]
    got = quality.largest_remainder(spark.createDataFrame(rows, "g long, i long, v long"), ["g"], "i", "v", F.lit(11)).groupBy("g").agg(F.sum("quota").alias("n")).collect()
    assert {r.n for r in got} == {11}


def test_index_vectors(spark):
    """Known counts and scores: 57.02 of 456 items, clamped 0, and nothing evaluated."""
    rows = [("a", "FAIL", "critical")] * 19 + [("a", "FAIL", "medium")] * 5 + [("a", "FAIL", "low")] * 34 + [("a", "PASS", None)] * 398
    rows += [("b", "FAIL", "critical")] * 2 + [("c", "", None)]
    got = {r.k: (r.evaluated, r.score) for r in quality.weighted_index(spark.createDataFrame(rows, "k string, result string, severity string"), ["k"]).collect()}
    assert got["a"][0] == 456 and round(got["a"][1], 2) == 57.02 and got["b"] == (2, 0.0) and got["c"] == (0, None)


def test_multiset_difference(spark):
    r = spark.createDataFrame([(["a", "a", "b"], ["a", "c"])], "a array<string>, b array<string>").select(sequences.missing_from(F.col("a"), F.col("b"))).collect()
    assert r[0][0] == {"a": 1, "b": 1}


def test_rules_first_match_wins(spark):
    r = spark.createDataFrame([("xa",), ("b",), ("c",), (None,)], "t string").select(sequences.first_rule(None, "t", [("one", "a"), ("two", "x|b")])).collect()
    assert [x[0] for x in r] == ["one", "two", None, None]


def test_equal_anchors_belong_to_the_first(spark):
    tree = [(1, 0, 3), (1, 1, 3), (1, 2, 5)]
    blocks = spark.createDataFrame([(1, i, 1) for i in range(7)], "doc_id long, reading_order int, page_no int")
    for rows in (tree, tree[::-1]):
        got = {r.reading_order: r.owner_pos for r in trees.owners(blocks, spark.createDataFrame(rows, "doc_id long, pos int, anchor int")).collect()}
        assert got == {0: None, 1: None, 2: None, 3: 0, 4: 0, 5: 2, 6: 2}


def test_boundaries_own_nothing(spark):
    tree = spark.createDataFrame([(1, 0, 1, False), (1, 1, 3, True), (1, 2, 5, None)], "doc_id long, pos int, anchor int, boundary boolean")
    blocks = spark.createDataFrame([(1, i, 1) for i in range(7)], "doc_id long, reading_order int, page_no int")
    assert {r.reading_order: r.owner_pos for r in trees.owners(blocks, tree).collect()} == {0: None, 1: 0, 2: 0, 3: None, 4: None, 5: 2, 6: 2}


def test_rows_of_one_side_are_reported_without_fields(spark):
    rows = lambda x: spark.createDataFrame(x, "k string, a string, b string")
    got = {tuple(r) for r in quality.differences(rows([("x", None, None), ("y", "1", None), ("w", "2", "3")]), rows([("y", "1", None), ("z", None, None), ("w", "2", None)]), ["k"], ["a", "b"]).collect()}
    assert got == {("x", "row", "present", None), ("z", "row", None, "present"), ("w", "b", "3", None)}


def test_normal_form_of_any_script(spark):
    texts = ["A\u00a0b", " Cr\u00edtica  \u2003 X!", "a - b", "\u3000\u00bf1.2?", "", None, "tab\tand\x1cmore"]
    want = ["a b", "cr\u00edtica x", "a b", "12", "", None, "tab and more"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.normal(F.col("t"))).collect()] == want


def test_levels_of_any_number(spark):
    rows = [(1, i, i % 100 + 1, f"t{i}", 1) for i in range(150)]
    got = {r.pos: r.parent_pos for r in trees.parents(spark.createDataFrame(rows, "doc_id long, pos int, level int, title string, page_no int").where("level < 71")).collect()}
    assert got[0] is None and got[69] == 68 and got[100] is None and got[149] == 148


def test_allocation_against_ranking(spark):
    """Quotas as by sorting all remainders, with many ties, nulls, zero totals and null groups; a negative vote is an error."""
    rng = random.Random(2)
    rows = [(g, i, rng.choice((0, 1, 1, 2, 50, None))) for g in (None, 1, 2, 3) for i in range(200)] + [(9, i, 0) for i in range(7)] + [(8, i, 1) for i in range(300)]
    got = {(r.g, r.i): r.quota for r in quality.largest_remainder(spark.createDataFrame(rows, "g long, i long, v long"), ["g"], "i", "v", F.lit(37)).collect()}
    for g in (None, 1, 2, 3, 9, 8):
        mine = [(i, v or 0) for h, i, v in rows if h == g]
        total = sum(v for _, v in mine)
        share = {i: 37.0 * v / total if total else 37.0 / len(mine) for i, v in mine}
        quota = {i: int(s) for i, s in share.items()}
        for i in sorted(share, key=lambda i: (-(share[i] - int(share[i])), i))[: 37 - sum(quota.values())]:
            quota[i] += 1
        assert {i: got[g, i] for i, _ in mine} == quota
    try:
        quality.largest_remainder(spark.createDataFrame([(1, 1, -1)], "g long, i long, v long"), ["g"], "i", "v", F.lit(3)).collect()
        raise AssertionError("no error")
    except Exception as e:  # noqa: BLE001
        assert "negative votes" in str(e)


def test_capacity_goes_round_by_round(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randint(0, 9), rng.randint(0, 9)) for g in range(40) for i in range(rng.randint(1, 8))]
    got = {(r.g, r.i): r.granted for r in quality.within_capacity(spark.createDataFrame(rows, "g long, i long, q long, c long"), ["g"], "i", "q", "c").collect()}
    for g in range(40):
        mine = [(i, q, c) for h, i, q, c in rows if h == g]
        have = {i: min(q, c) for i, q, c in mine}
        over = sum(q - have[i] for i, q, _ in mine)
        while over and any(have[i] < c for i, _, c in mine):
            for i, _, c in mine:
                if over and have[i] < c:
                    have[i] += 1
                    over -= 1
        assert {i: got[g, i] for i, *_ in mine} == have, g


def test_sample_plan_covers_chapters(spark):
    tree = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 2, 3), (1, 2, 1, 11)], "doc_id long, pos int, level int, page_no int")
    pages = spark.createDataFrame([(1, 20), (2, 8), (3, 0)], "doc_id long, total int")
    assert {tuple(r) for r in sampling.chapters(tree, pages).collect()} == {(1, 0, 1, 10), (1, 2, 11, 20), (2, -1, 1, 8)}
    got = {(r.doc_id, r.page): r.reasons for r in sampling.plan(tree, pages, 0.25).collect()}
    assert got == {(1, 1): "opening,share", (1, 6): "share", (1, 10): "share", (1, 11): "opening,share", (1, 20): "share", (2, 1): "opening,share", (2, 8): "share"}


def test_cycles_are_not_reached(spark):
    t = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 3), (1, 3, 2), (1, 4, 3), (1, 5, 9), (2, 0, None)], "doc_id long, pos int, parent_pos int")
    assert {r.doc_id: r.unreached for r in trees.unreached(t).collect()} == {1: 4, 2: 0}


def test_priorities_and_versions(spark):
    rows = [("a", f"k{i}", i < 3) for i in range(40)] + [("b", "x", False), ("b", None, None)]
    got = sequences.prioritized(spark.createDataFrame(rows, "s string, k string, bad boolean"), ["s"], "k", [("bad", F.col("bad"))], ~F.col("bad"), 0.1, 3).collect()
    assert len(got) == 42 and sum(r.why == "audit" for r in got if r.s == "a") == 4 and sum(r.why == "bad" and r.place == 1 for r in got) == 3
    assert {r.k: r.why for r in got if r.s == "b"} == {"x": "audit", None: "rest"}
    v = spark.createDataFrame([("m", "v1.9", True), ("m", "v1.10", True), ("m", "v2", False), ("n", "draft", True), ("n", "v0", True), ("o", None, True)], "m string, version string, final boolean")
    assert {(r.m, r.version) for r in sequences.latest_version(v, ["m"], F.col("final")).collect()} == {("m", "v1.10"), ("n", "v0")}


def test_empty_tables_and_nulls(spark):
    tree = spark.createDataFrame([], "doc_id long, pos int, level int, title string, page_no int, anchor int")
    pages = spark.createDataFrame([], "doc_id long, total int")
    for df in (trees.parents(tree), trees.paths(tree), trees.ancestors(tree), trees.context(tree), trees.clusters(tree), trees.subtree_ends(tree, pages), trees.statistics(tree), sampling.plan(tree, pages, 0.5)):
        assert df.count() == 0
    rows = spark.createDataFrame([(1, 0, None, None, 1, 0), (1, 1, 1, "a", 1, 1), (None, 0, 1, None, None, None)], tree.schema)
    assert {(r.doc_id, r.pos): r.parent_pos for r in trees.parents(rows).collect()} == {(1, 0): None, (1, 1): None, (None, 0): None}
    two = spark.createDataFrame([(1, ["a", None, "a"], ["a", None]), (2, None, ["x"]), (3, [], [])], "k long, a array<string>, b array<string>")
    assert [tuple(r) for r in sequences.multiset_minus(two, ["k"], "a", "b").collect()] == [(1, "a", 1)]


def _share(a, b):
    w = set(a.split(" "))
    return len(w & set(b.split(" "))) / len(w)


def test_pages_nearby_and_shifts_against_loops(spark):
    rng = random.Random(8)
    pages = [(d, p, " ".join(rng.choices("abcde", k=2))) for d in range(6) for p in range(1, 9) if rng.random() < 0.9]
    entries = [(d, i, rng.choice(("a", "b c", "d a", None)), rng.choice((1, 4, 8, 30, None))) for d in range(6) for i in range(6)] + [(None, 0, "a", 1)]
    p = spark.createDataFrame([*pages, *pages[:3]], "doc_id long, page_no int, text string")
    e = spark.createDataFrame(entries, "doc_id long, pos int, title string, page_no int")
    at = {(d, n): t for d, n, t in pages}
    score = lambda d, t, n: _share(t, at[d, n]) if t is not None and (d, n) in at else 0.0
    want = {}
    for d, i, t, n in entries:
        near = [m for m in range(n - 2, n + 3) if (d, m) in at] if n is not None else []
        if near:
            s, m = max((score(d, t, m), -m) for m in near)
            want[d, i] = (-m, s)
    assert {(r.doc_id, r.pos): (r.page, r.score) for r in alignment.best_nearby(e, p, X.word_share, 2, ["doc_id"]).collect()} == want
    best = alignment.best_shift(e, p, X.word_share, [-1, 0, 1], 3, ["doc_id"])
    got = {r.doc_id: (r["shift"], r["mean"]) for r in best.collect()}
    for d in {x[0] for x in entries}:
        mine = [x for x in entries if x[0] == d]
        means = {k: round(sum(score(d, t, n + k) if n is not None else 0.0 for _, _, t, n in mine[:3]) / len(mine[:3]), 9) for k in (-1, 0, 1)}
        shift = max(means, key=lambda k: (means[k], -abs(k), -k))
        assert got[d] == (shift, means[shift])
    for r in alignment.shift_support(e, p, best, X.word_share, 0.5, ["doc_id"]).collect():
        mine = [x for x in entries if x[0] == r.doc_id]
        assert (r.entries, r.matched) == (len(mine), sum(n is not None and score(r.doc_id, t, n + r["shift"]) >= 0.5 for _, _, t, n in mine))


def test_rising_anchors_against_a_fold(spark):
    rng = random.Random(4)
    rows = [(d, i, rng.choice((None, rng.randint(-3, 30)))) for d in range(8) for i in range(20)]
    got = {(r.doc_id, r.pos): r.anchor for r in alignment.rising(spark.createDataFrame(rows, "doc_id long, pos int, wanted int"), ["doc_id"], "wanted", 2).collect()}
    for d in range(8):
        last = 1
        for _, i, w in [x for x in rows if x[0] == d]:
            last = max(last + 1, w if w is not None else 0)
            assert got[d, i] == last


def test_pointers_are_places_among_all(spark):
    rows = spark.createDataFrame([(1, 0)] * 3 + [(1, 2)] * 2 + [(2, 0)], "doc_id long, part int")
    refs = spark.createDataFrame([(1, 2, 1), (1, 0, 2), (1, 0, 3), (1, 2, -1), (1, 1, 0), (2, 0, 0), (None, 0, 0), (2, 0, None)], "doc_id long, part int, i int")
    got = alignment.relinked(refs, alignment.part_starts(rows, ["doc_id"], "part"), ["doc_id"], "part", "i").collect()
    assert {(r.doc_id, r.part, r.i): r.position for r in got} == {(1, 2, 1): 4, (1, 0, 2): 2, (1, 0, 3): None, (1, 2, -1): None, (1, 1, 0): None, (2, 0, 0): 0, (None, 0, 0): None, (2, 0, None): None}


def test_texts_of_pages_and_empty_alignments(spark):
    b = spark.createDataFrame([(1, 2, 1, "b"), (1, 1, 1, "a"), (1, 3, 1, None), (1, 4, 2, None)], "doc_id long, reading_order int, page_no int, text string")
    assert {(r.page_no, r.text) for r in alignment.page_texts(b, ["doc_id"]).collect()} == {(1, "a b"), (2, "")}
    e, p = spark.createDataFrame([], "doc_id long, pos int, title string, page_no int"), alignment.page_texts(b, ["doc_id"]).where("false")
    for df in (alignment.best_nearby(e, p, X.word_share, 1, ["doc_id"]), alignment.best_shift(e, p, X.word_share, [0], 2, ["doc_id"]), alignment.rising(e, ["doc_id"], "page_no"), alignment.part_starts(e, ["doc_id"], "pos")):
        assert df.count() == 0
