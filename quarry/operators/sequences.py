"""Ordered sequences: overlapping windows and their trimming, runs, latest rows, first matching rules, multisets.

Edge cases: null keys group together and join with nothing, but for ``multiset_minus`` and ``unmatched``, which compare
them like values; an order that does not tell two rows apart leaves open which is first, so callers add a tiebreak;
null texts match no rule; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_windows(totals: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, window, first, last: windows over pages 1..total that overlap, up to the first that reaches the end."""
    step = size - overlap
    n = F.when(F.col("total") <= size, 1).otherwise(F.ceil((F.col("total") - size) / step) + 1).cast("int")
    w = totals.where("total > 0").select("doc_id", "total", F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    first = F.col("window") * step + 1
    return w.select("doc_id", "window", first.cast("int").alias("first"), F.least(first + size - 1, F.col("total")).cast("int").alias("last"))


def trim_overlap(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of windows without those on pages that the window before already covers."""
    prev = windows.withColumn("prev_last", F.lag("last").over(Window.partitionBy("doc_id").orderBy("window"))).select("doc_id", "window", "prev_last")
    return rows.join(prev, ["doc_id", "window"]).where("prev_last is null or page_no > prev_last").drop("prev_last")


def continue_runs(rows: DataFrame, order: str, scheme: str, value: str) -> DataFrame:
    """Adds absolute: values of a sequence that restarts when its scheme changes, continued after the largest value of each run before."""
    w = Window.partitionBy("doc_id").orderBy(order)
    changed = F.coalesce(~F.col(scheme).eqNullSafe(F.lag(scheme).over(w)), F.lit(True)).cast("int")
    run = rows.withColumn("_run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tops = run.where(F.col(value).isNotNull()).groupBy("doc_id", "_run").agg(F.max(value).alias("_top"))
    base = tops.withColumn("_base", F.coalesce(F.sum("_top").over(Window.partitionBy("doc_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_top")
    return run.join(base, ["doc_id", "_run"], "left").withColumn("absolute", F.col("_base") + F.col(value)).drop("_run", "_base")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order (a total order, descending)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def first_rule(rows: DataFrame, text: str, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule whose pattern the text matches, or null; rules are few and become one CASE."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(F.col(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def missing_from(a: Column, b: Column) -> Column:
    """Multiset difference of two arrays as a map of element to how many more times a holds it."""
    count = lambda arr: F.transform(F.array_distinct(arr), lambda x: F.struct(x.alias("key"), F.size(F.filter(arr, lambda y: y == x)).alias("n")))
    of = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.map_from_entries(F.filter(F.transform(count(a), lambda e: F.struct(e["key"].alias("key"), (e["n"] - of(b, e["key"])).alias("value"))), lambda e: e["value"] > 0))


def multiset_minus(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, element, n: how many more times array a holds an element than array b, where it does; linear in the elements."""
    side = lambda c, n: rows.select(*keys, F.explode(c).alias("element"), F.lit(n).alias("n"))
    return side(a, 1).unionByName(side(b, -1)).groupBy(*keys, "element").agg(F.sum("n").alias("n")).where("n > 0")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: rows of the left that find no partner if each row of the right may serve once."""
    side = lambda d, n: d.select(*keys, F.lit(n).alias("n"))
    return side(left, 1).unionByName(side(right, -1)).groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def latest_version(versions: DataFrame, keys: list[str], eligible: Column) -> DataFrame:
    """The newest eligible row of each key by version ``major.minor`` as numbers; none if no row is eligible or reads so."""
    rows = versions.where(eligible).withColumn("_major", F.expr("try_cast(nullif(regexp_extract(version, '^v?([0-9]+)([.][0-9]+)?$', 1), '') as long)")).withColumn("_minor", F.coalesce(F.expr("try_cast(nullif(regexp_extract(version, '^v?[0-9]+[.]([0-9]+)$', 1), '') as long)"), F.lit(0)))
    return latest(rows.where("_major is not null"), keys, [F.desc("_major"), F.desc("_minor"), F.desc("version")]).drop("_major", "_minor")


def prioritized(rows: DataFrame, by: list[str], key: str, rules: list[tuple[str, Column]], audit: Column, fraction: float, least: int) -> DataFrame:
    """Adds place and why: the first rule that holds, else ``audit`` for the lowest SHA-256 of the key among rows where
    ``audit`` holds (a fraction of them, ``least`` at least), else ``rest``.
    """
    hit = F.lit(None).cast("string")
    for name, cond in reversed(rules):
        hit = F.when(cond, F.lit(name)).otherwise(hit)
    d = rows.withColumn("_audit", F.coalesce(audit, F.lit(False)))
    n = d.where("_audit").groupBy(*by).agg(F.greatest(F.lit(least), F.ceil(F.count("*") * F.lit(float(fraction)))).alias("_n"))
    d = d.join(n, by, "left")
    r = F.row_number().over(Window.partitionBy(*by, "_audit").orderBy(F.sha2(key, 256), key))
    d = d.withColumn("_r", r)
    why = F.coalesce(hit, F.when(F.col("_audit") & (F.col("_r") <= F.col("_n")), "audit").otherwise("rest"))
    names = [*(name for name, _ in rules), "audit", "rest"]
    return d.withColumn("why", why).withColumn("place", F.array_position(F.array(*map(F.lit, names)), F.col("why")).cast("int")).drop("_audit", "_n", "_r")


def with_reasons(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys, reasons: union of ``(keys, reason)``, the reasons of a key as a sorted set joined by commas."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def set_audit(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, issue: keys that are missing, extra, or have another value; nothing for those that agree."""
    e = expected.select(*keys, F.struct(value).alias("e"))
    a = actual.select(*keys, F.struct(value).alias("a"))
    j = e.join(a, keys, "full_outer")
    issue = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(~F.col(f"e.{value}").eqNullSafe(F.col(f"a.{value}")), "differs")
    return j.select(*keys, issue.alias("issue")).where("issue is not null")


def filled(official: DataFrame, drafts: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """Official rows, with blank fields taken together from the latest draft of the same key; ``origin`` says from where."""
    d = latest(drafts, keys, [F.desc(order)]).select(*keys, F.struct(*fields).alias("_draft"))
    j = official.join(d, keys, "left")
    blank = F.coalesce(F.trim(F.col(fields[0])), F.lit("")) == ""
    use = blank & F.col("_draft").isNotNull()
    out = j.select(*keys, *(F.when(use, F.col(f"_draft.{f}")).otherwise(F.col(f)).alias(f) for f in fields), F.when(use, "draft").when(blank, "none").otherwise("official").alias("origin"))
    return out


def set_changes(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change: what only one side has, as 'removed' or 'added'."""
    gone = base.select(*keys).distinct().join(other.select(*keys), keys, "left_anti").withColumn("change", F.lit("removed"))
    new = other.select(*keys).distinct().join(base.select(*keys), keys, "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(new)
