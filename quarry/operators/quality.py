"""Quality analytics: weighted scores, largest-remainder allocation, even positions, version comparison.

Edge cases: keys are compared by equality, so rows with a null key have no partner (``differences`` reports them as added
or removed); results other than PASS and FAIL are not evaluated; unknown severities weigh nothing; rows that repeat a
key are each paired with each of the other side; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"critical": 8, "high": 4, "medium": 2, "low": 1}  # fixed values


def weighted_index(rows: DataFrame, by: list[str], weights: dict[str, int] | None = None) -> DataFrame:
    """by, evaluated, weighted, score: 100 (1 - weighted failures / evaluated), clamped to 0..100, null if nothing is evaluated."""
    w = F.lit(0)
    for name, value in (weights or WEIGHTS).items():
        w = F.when(F.col("severity") == name, value).otherwise(w)
    out = rows.groupBy(*by).agg(F.count_if(F.col("result").isin("PASS", "FAIL")).alias("evaluated"), F.coalesce(F.sum(F.when(F.col("result") == "FAIL", w)), F.lit(0)).alias("weighted"))
    raw = F.lit(100.0) * (F.lit(1.0) - F.col("weighted") / F.col("evaluated"))
    return out.withColumn("score", F.when(F.col("evaluated") > 0, F.greatest(F.least(raw, F.lit(100.0)), F.lit(0.0))))


def capped_index(scores: DataFrame, failed: Column, unevaluated: Column, cap: float) -> DataFrame:
    """Adds final, cap_applied and state to rows with a score: at most ``cap`` where a check failed; pending while items are not evaluated."""
    over = failed & (F.col("score") > cap)
    out = scores.withColumn("final", F.when(over, F.lit(float(cap))).otherwise(F.col("score"))).withColumn("cap_applied", F.coalesce(over, F.lit(False)))
    return out.withColumn("state", F.when(F.col("score").isNull(), "empty").when(unevaluated > 0, "pending").otherwise("final"))


REMAINDER_BINS = 1 << 12


def largest_remainder(parts: DataFrame, by: list[str], order: str, votes: str, seats: Column) -> DataFrame:
    """Adds quota: Hamilton's method within ``by``; ties go to the first in order; without votes all parts count alike.

    Totals are aggregates.  Remainders are counted in bins, and only those of the bin in which the seats run out are
    ranked, so that a large group is not gathered in one task.  A negative vote is an error, a null one counts as none.
    """
    v = F.coalesce(F.col(votes), F.lit(0))
    v = F.when(v < 0, F.raise_error(F.lit("negative votes")).cast("double")).otherwise(v)
    rows = parts.withColumn("_votes", v)
    keys = [F.col(k).alias(f"_g{i}") for i, k in enumerate(by)]
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(by)]
    total = rows.groupBy(*keys).agg(F.sum("_votes").alias("_total"), F.count("*").cast("double").alias("_n"))
    share = F.when(F.col("_total") > 0, seats * F.col("_votes") / F.col("_total")).otherwise(seats / F.col("_n"))
    rows = rows.join(total, same).drop(*(f"_g{i}" for i in range(len(by)))).withColumn("_share", share.cast("double"))
    rows = rows.withColumn("_floor", F.floor("_share")).withColumn("_bin", F.floor((F.col("_share") - F.col("_floor")) * REMAINDER_BINS))
    bins = rows.groupBy(*keys, F.col("_bin").alias("_b")).agg(F.count("*").alias("_m"), F.sum("_floor").alias("_f"), F.max(seats).alias("_seats"))
    whole = Window.partitionBy(*(f"_g{i}" for i in range(len(by))))
    above = whole.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    left = F.col("_seats") - F.sum("_f").over(whole)
    bins = bins.withColumn("_room", left - F.coalesce(F.sum("_m").over(above), F.lit(0))).drop("_f", "_seats")
    rows = rows.join(bins, [*same, F.col("_bin") == F.col("_b")]).drop(*(f"_g{i}" for i in range(len(by))), "_b")
    some = (F.col("_room") > 0) & (F.col("_room") < F.col("_m"))
    rank = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(F.desc(F.col("_share") - F.col("_floor")), order))
    ranked = rows.where(some).withColumn("_more", (rank <= F.col("_room")).cast("int"))
    sure = rows.where(~some).withColumn("_more", (F.col("_room") >= F.col("_m")).cast("int"))
    return ranked.unionByName(sure).withColumn("quota", (F.col("_floor") + F.col("_more")).cast("long")).drop("_votes", "_total", "_n", "_share", "_floor", "_bin", "_m", "_room", "_more")


def within_capacity(parts: DataFrame, by: list[str], order: str, quota: str, capacity: str) -> DataFrame:
    """Adds granted: the quota up to the capacity; what is over goes round by round, in order, to parts with room.

    After t rounds a part has got min(room, t).  The number of whole rounds follows from the rooms in order of size.
    """
    w = Window.partitionBy(*by)
    d = parts.withColumn("_own", F.least(quota, capacity)).withColumn("_room", F.col(capacity) - F.col("_own"))
    d = d.withColumn("_over", F.sum(F.col(quota) - F.col("_own")).over(w))
    upto = w.orderBy("_room").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count("*").over(w)
    d = d.withColumn("_m", n - F.count("*").over(upto)).withColumn("_given", F.sum("_room").over(upto) + F.col("_room") * F.col("_m"))
    full = F.max(F.when(F.col("_given") <= F.col("_over"), F.struct(F.col("_room").alias("t"), F.col("_given").alias("given"), F.col("_m").alias("m")))).over(w)
    d = d.withColumn("_full", F.coalesce(full, F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("given"), n.alias("m"))))
    rest, m = F.col("_over") - F.col("_full.given"), F.col("_full.m")
    d = d.withColumn("_t", F.col("_full.t") + F.when(m > 0, F.floor(rest / m)).otherwise(0)).withColumn("_rest", F.when(m > 0, rest % m).otherwise(0))
    turn = F.sum((F.col("_room") > F.col("_t")).cast("int")).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    more = F.when((F.col("_room") > F.col("_t")) & (turn <= F.col("_rest")), 1).otherwise(0)
    return d.withColumn("granted", (F.col("_own") + F.least("_room", "_t") + more).cast("long")).drop("_own", "_room", "_over", "_m", "_given", "_full", "_t", "_rest")


def even_positions(ranges: DataFrame) -> DataFrame:
    """ranges(.., first, last, n) to one row for each of n positions spread evenly from first to last, ends included."""
    n = F.least(F.col("n"), F.col("last") - F.col("first") + 1)
    out = ranges.withColumn("_n", n.cast("int")).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = F.when(F.col("_n") == 1, F.col("first")).otherwise(F.rint(F.col("first") + (F.col("last") - F.col("first")) * F.col("_i") / (F.col("_n") - 1)))
    return out.withColumn("position", F.least(at, F.col("last")).cast("long")).drop("_n", "_i")


def paired(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Items reviewed in both versions, with their change."""
    b = base.where("result is not null").select(*keys, F.col("result").alias("before"))
    o = other.where("result is not null").select(*keys, F.col("result").alias("after"))
    change = F.when(F.col("before") == F.col("after"), "same").when(F.col("after") == "PASS", "fixed").otherwise("regressed")
    return b.join(o, keys).withColumn("change", change)


def differences(base: DataFrame, other: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, before, after: one row for each field that differs, null-safe; and for a row that only one side has,
    one with the field ``row`` and ``present`` on that side, whatever its fields hold.
    """
    b = base.select(*keys, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("b"))
    o = other.select(*keys, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("o"))
    j = b.join(o, keys, "full_outer")
    there = F.struct(F.lit("row").alias("field"), F.when(F.col("b").isNotNull(), "present").alias("before"), F.when(F.col("o").isNotNull(), "present").alias("after"))
    rows = F.array(there, *(F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").alias("before"), F.col(f"o.{f}").alias("after")) for f in fields))
    return j.select(*keys, F.inline(F.filter(rows, lambda x: ~x["before"].eqNullSafe(x["after"]))))


def deltas(base: DataFrame, other: DataFrame, keys: list[str], cause: str, targets: DataFrame) -> DataFrame:
    """cause, target, before, after, paired_before, paired_after: FAIL rows of two versions by cause, of all rows and of
    those reviewed in both; causes that are targets are listed even where they have none.
    """
    b, o = (d.where(F.col("result").isin("PASS", "FAIL")) for d in (base, other))
    fails = lambda d, name: d.where("result = 'FAIL'").groupBy(F.col(cause).alias("cause")).agg(F.count("*").alias(name))
    both = b.select(*keys).intersect(o.select(*keys))
    parts = [fails(b, "before"), fails(o, "after"), fails(b.join(both, keys, "left_semi"), "paired_before"), fails(o.join(both, keys, "left_semi"), "paired_after")]
    out = targets.select(F.col(cause).alias("cause"), F.lit(True).alias("target")).distinct()
    for p in parts:
        out = out.join(p, "cause", "full_outer")
    return out.where("cause is not null").select("cause", F.coalesce("target", F.lit(False)).alias("target"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("before", "after", "paired_before", "paired_after")))


def groups_of_failures(rows: DataFrame, cause: str, where: str, section: str, ranks: dict[str, int] | None = None) -> DataFrame:
    """cause, failures, places, top, sections: FAIL rows by cause with the worst severity and the sections in order."""
    rank = F.lit(0)
    for name, value in (ranks or WEIGHTS).items():
        rank = F.when(F.col("severity") == name, value).otherwise(rank)
    g = rows.where("result = 'FAIL'").groupBy(F.col(cause).alias("cause")).agg(
        F.count("*").alias("failures"), F.countDistinct(where).alias("places"), F.max_by("severity", rank).alias("top"), F.array_join(F.array_sort(F.collect_set(section)), ",").alias("sections")
    )
    return g


def numbered(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """keys, name: distinct keys named prefix-001, prefix-002, ... in their order; a table of names, ranked in one task."""
    return rows.select(*keys).distinct().withColumn("name", F.format_string(f"{prefix}-%03d", F.row_number().over(Window.orderBy(*keys))))
