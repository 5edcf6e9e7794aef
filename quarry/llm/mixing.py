"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Sizes are words.  Sources share all words by weight; a target stops at ``max_epochs`` times its source and the
excess is shared again.  Equal blocks of ``block`` words are dealt to the sources by highest quotients
target / (2k + 1), and each source's blocks likewise to its shards.  In a shard the documents stand in seeded
order; the quota takes whole passes, then a run of blocks from a seeded start, so no document is taken more
than ``max_epochs`` times and a rerun takes the same words.

Shards and their order come from a hash of id, source and text, so a null or repeated id is spread like any other.

Edge cases: null text has size 0; a null source is a source of its own, the last; null and repeated doc_ids are
rows like others; rows equal in id, source and text may take each other's place; sources without words have target 0;
texts of any length count whole; empty tables give no rows; other columns are ignored.
Nothing is collected but single rows of sums; sources, shards and quotients are ranked and summed by range
partitions, not in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BLOCK = 16
SHARD_WORDS = 250_000
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def rank_rows(df: DataFrame, order: list, name: str, scratch: Scratch, sums: tuple[str, ...] = ()) -> DataFrame:
    """0-based place of each row in a total order, and with ``sums`` the totals of columns up to and with the row.

    Range partitions, then places and running totals inside them, then offsets.
    """
    placed = scratch.put(df.sort(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_n_{c}") for c in sums))
    past = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = sizes.select("_pid", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"), *(F.coalesce(F.sum(f"_n_{c}").over(past), F.lit(0)).alias(f"_before_{c}") for c in sums))
    out = placed.join(before, "_pid").withColumn(name, F.col("_at") + F.col("_before"))
    for c in sums:
        run = F.sum(c).over(Window.partitionBy("_pid").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn(f"to_{c}", run + F.col(f"_before_{c}"))
    return out.drop("_pid", "_at", "_before", *(f"_before_{c}" for c in sums))


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds place, weight and target to ``sources(source, source_size)``.

    With sources by cap per weight, those that stop at their cap come first.  A source stops if its cap per weight is
    within the level that is left once all before it have stopped; the level after the last of them is everybody's.
    """
    ranked = rank_rows(sources, [F.col("source").isNull(), F.encode("source", "utf-8")], "place", scratch)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = scratch.put(ranked.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * max_epochs))
    total, weight, n = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.coalesce(F.sum("weight"), F.lit(0.0)), F.count("*")).collect()[0]
    by_cap = rank_rows(ranked.withColumn("ratio", F.col("cap") / F.col("weight")), ["ratio", "place"], "at", scratch, ("cap", "weight"))
    level = lambda cap, left: (F.lit(total) - cap) / left
    before = level(F.col("to_cap") - F.col("cap"), F.lit(weight) - (F.col("to_weight") - F.col("weight")))
    full = by_cap.where(F.col("ratio") <= before)
    last = full.agg(F.max(F.struct("at", F.col("to_cap").alias("cap"), F.col("to_weight").alias("weight"))).alias("x"), F.count("*").alias("full")).collect()[0]
    if last.full == n:
        return ranked.withColumn("target", F.col("cap"))
    top = (total - last.x.cap) / (weight - last.x.weight) if last.full else total / weight
    return ranked.withColumn("target", F.least("cap", F.col("weight") * F.lit(top)))


def apportion(df: DataFrame, votes: str, seats, ties: list, name: str, scratch: Scratch, by: list[str] | None = None) -> DataFrame:
    """Sainte-Lague: ``seats`` (a number, or a column that is constant within ``by``) dealt by highest quotients.

    Rather than one by one, all quotients above a divisor that is surely high enough are granted at once; the
    few between it and one that is surely low enough, at most one or two a party, are ranked.
    """
    keys = by or []
    sums = [F.count(F.when(F.col(votes) > 0, 1)).cast("double").alias("_n"), F.coalesce(F.sum(votes), F.lit(0.0)).cast("double").alias("_v")]
    if by:
        d = df.withColumn("_s", seats.cast("double")).join(df.groupBy(*keys).agg(*sums), keys)
    else:
        n, total = df.agg(*sums).collect()[0]
        d = df.withColumn("_s", F.lit(float(seats))).withColumn("_n", F.lit(n)).withColumn("_v", F.lit(total))
    half = F.col("_n") / 2
    low = F.when(F.col("_s") > half, F.floor(F.col(votes) * (F.col("_s") - half) / F.col("_v") + 0.5 - 1e-9)).otherwise(F.lit(0))
    high = F.floor(F.col(votes) * (F.col("_s") + half) / F.col("_v") + 0.5 + 1e-9)
    ok = (F.col(votes) > 0) & (F.col("_s") > 0)
    d = d.withColumn("_low", F.when(ok, F.greatest(low, F.lit(0))).otherwise(F.lit(0)).cast("long")).withColumn("_high", F.when(ok, high).otherwise(F.lit(0)).cast("long"))
    own = [*keys, *[t for t in ties if t not in keys]]
    tried = d.where("_high > _low").select(*own, votes, "_s", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k")).withColumn("_q", F.col(votes) / (2 * F.col("_k") - 1))
    ranked = rank_rows(tried, [*keys, F.desc("_q"), *ties, "_k"], "_r", scratch)
    if by:
        granted = d.groupBy(*keys).agg(F.sum("_low").alias("_granted"))
        first = ranked.groupBy(*keys).agg(F.min("_r").alias("_first"))
        ranked = ranked.join(first, keys).join(granted, keys).where(F.col("_r") - F.col("_first") < F.col("_s") - F.col("_granted"))
    else:
        left = int(seats) - int(d.agg(F.coalesce(F.sum("_low"), F.lit(0))).collect()[0][0])
        ranked = ranked.where(F.col("_r") < left)
    extra = ranked.groupBy(*own).agg(F.count("*").alias("_extra"))
    return d.join(extra, own, "left").withColumn(name, F.col("_low") + F.coalesce("_extra", F.lit(0))).drop("_n", "_v", "_s", "_low", "_high", "_extra")


def mix(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED, keep_text: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and how: passes, part_from, part_to, wrap_to (word ranges).

    A document is taken ``passes`` whole times, plus its words [part_from, part_to) and [0, wrap_to).  With
    keep_text the text comes along; the plan then moves texts once, by shard.
    """
    body = F.col(text_col)
    size = F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), id_col, source_col, body).alias("row"), *([body.alias("text")] if keep_text else []), *(F.col(c).alias(f"x_{c}") for c in extra))
    light = scratch.put(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = scratch.put(targets(light, scratch, weights, max_epochs))
    total = int(goal.agg(F.coalesce(F.sum("source_size"), F.lit(0))).collect()[0][0])
    by_source = apportion(goal, "target", total // block, ["place"], "blocks", scratch)
    by_source = scratch.put(by_source.withColumn("shards", F.ceil(F.col("source_size") / shard_words).cast("long")).select(F.col("source").alias("_source"), "place", "source_size", "target", "blocks", F.greatest("shards", F.lit(1)).alias("shards")))
    dealt = base.join(by_source, base.source.eqNullSafe(by_source._source)).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "row"), F.col("shards")))
    cells = scratch.put(dealt.groupBy("place", "shard", "blocks").agg(F.sum("size").cast("double").alias("words")))
    quota = apportion(cells, "words", F.col("blocks"), ["shard"], "quota", scratch, by=["place"]).select("place", "shard", "words", "quota")
    length, b = F.col("words").cast("long"), F.lit(block)
    n = F.ceil(F.col("words") / block)
    quota = (
        quota.withColumn("length", length)
        .withColumn("passes", F.when(n > 0, F.least(F.floor(F.col("quota") / n), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.when((n > 0) & (F.col("passes") < max_epochs), F.col("quota") - F.col("passes") * n).otherwise(F.lit(0)).cast("long"))
        .withColumn("first", F.when(n > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "place", "shard"), F.greatest(n, F.lit(1)))).otherwise(F.lit(0)).cast("long"))
        .withColumn("a", F.col("first") * b)
        .withColumn("z", F.least(F.greatest(F.col("a") + F.col("rest") * b, F.col("a")), F.col("length") + F.col("a")))
        .select("place", "shard", "length", "passes", "a", "z")
    )
    cell = Window.partitionBy("place", "shard").orderBy("row", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lo = (F.sum("size").over(cell) - F.col("size")).cast("long")
    out = dealt.withColumn("lo", lo).join(quota, ["place", "shard"])
    lo, hi, end = F.col("lo"), F.col("lo") + F.col("size"), F.least("z", "length")
    wrapped = F.greatest(F.col("z") - F.col("length"), F.lit(0))
    cut = lambda x: F.least(F.greatest(x - lo, F.lit(0)), F.col("size"))
    return (
        out.withColumn("part_from", cut(F.col("a")))
        .withColumn("part_to", cut(end))
        .withColumn("wrap_to", F.when(hi > lo, F.least(cut(wrapped), F.col("size"))).otherwise(F.lit(0)))
        .withColumn("taken", (F.col("passes") * F.col("size") + (F.col("part_to") - F.col("part_from")) + F.col("wrap_to")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "part_from", "part_to", "wrap_to", *(["text"] if keep_text else []), *(F.col(f"x_{c}").alias(c) for c in extra))
    )


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the mix itself: a whole text for each pass, then the partly taken words, joined by single spaces."""
    toks = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    cut = lambda a, z: F.array_join(F.slice(toks, (a + 1).cast("int"), (z - a).cast("int")), " ")
    zero = F.lit(0).cast("long")
    part = F.array_compact(F.array(F.when(F.col("part_to") > F.col("part_from"), cut(F.col("part_from"), F.col("part_to"))), F.when(F.col("wrap_to") > 0, cut(zero, F.col("wrap_to")))))
    texts = F.concat(F.array_repeat("text", F.col("passes").cast("int")), part)
    return mixed.where("taken > 0").withColumn("text", F.explode(texts)).withColumn("n_chars", F.length("text").cast("long")).select(*columns)
