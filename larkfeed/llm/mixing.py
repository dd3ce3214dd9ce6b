"""Mixing sources to target weights (operator 4): Pareto order sampling within sources.

A document of a source whose target is f times its size is expected f times: floor(f) whole copies are
certain, the rest is an inclusion probability p. With a column `weight`, a document's expected copies are in
proportion to it within its source, so documents of one source have different p. Documents are ranked by the odds of a fixed random
number over the odds of p, and taken in that order until the source's remaining words are filled; the
one that crosses the target is taken if that comes nearer than leaving it.

The order is found without sorting a source: ranks fall into bins, words are summed per source and
bin, and only the bin in which the target is reached is put in exact order, equal rows as one with a count. What is
taken is then a bound for each source, against which every row is held by itself.

Cases: null text has size 0; a null source is a source of its own, last in order; sources without
words have target 0; rows that share a doc_id are drawn with the same number and so follow each other, smaller ones
first, and of equal rows at the bound just as many are taken as fit; an empty table gives no rows; further columns, of whatever
name, pass through `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bins for each source; the exact order is needed in one of them.
BINS = 1 << 14
#: Bins whose words are summed up together first.
GROUP = 1 << 7


def target_sizes(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row for each source (source, source_size).

    Targets share `share` times all words by weight; a source stops at `most` times its size and
    what it can't take is shared again. In order of cap over weight the stopped sources are a
    prefix, so running sums over the sources settle it: a source is stopped if the level, with all
    before it stopped, reaches its cap. The table has a row for each source, not for documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    w = w.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    w = w.withColumn("level", (F.col("total") * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    w = w.withColumn("below", F.col("level") * F.col("weight") < F.col("cap"))
    w = w.withColumn("n_below", F.sum(F.col("below").cast("int")).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)))
    w = w.withColumn("open", F.max(F.when(F.col("below") & (F.col("n_below") == 1), F.col("level"))).over(whole))
    return w.select("source", "source_size", F.when(F.col("n_below") == 0, F.col("cap").cast("double")).otherwise(F.col("open") * F.col("weight")).alias("target"))


def draw(*key: Column, seed: str = "") -> Column:
    """A fixed random number below 2 ** 48 for each key, the same in each run of one seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.concat_ws("|", *(k.cast("string") for k in key)))), 1, 12), 16, 10).cast("long")


def ranked(docs: DataFrame, targets: DataFrame, bins: int = BINS, most: int = MOST) -> DataFrame:
    """docs (source, draw, weight, ...) with source_size and target, and certain, rank and bin: the copies that are sure, the place in
    Pareto's order, and a coarse form of it. targets has mass, the source's size with each document weighed."""
    d = docs.withColumnRenamed("source", "of").join(targets, F.col("of").eqNullSafe(F.col("source"))).drop("source").withColumnRenamed("of", "source")
    expected = F.least(F.when(F.col("mass") > 0, F.col("target") / F.col("mass")).otherwise(0.0) * F.col("weight"), F.lit(float(most)))
    d = d.withColumn("certain", F.floor(expected)).withColumn("p", expected - F.floor(expected))
    u = (F.col("draw") + F.lit(0.5)) / F.lit(float(1 << 48))
    # the odds of u over those of p, carried onto 0..1 (x / (1 + x) keeps the order)
    odds = u / (1 - u) * (1 - F.col("p")) / F.col("p")
    d = d.withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)))
    return d.withColumn("bin", F.when(F.col("rank").isNotNull(), F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1)).cast("int"))).drop("p", "mass")


def bounds(d: DataFrame) -> DataFrame:
    """One row for each source (source, full, edge, last, m, n) of ranked rows with their size: bins up to `full` are taken, and of bin
    `edge` the rows up to `last` (rank, draw, size), of the n that equal it the first m."""
    fine = d.where("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("bin") / GROUP).cast("int"))
    fine = materialize(fine, "mix-bins")
    earlier = lambda words, order, *of: F.coalesce(F.sum(words).over(Window.partitionBy(*of).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # words before a bin: those of earlier groups of bins and those of earlier bins of its group
    groups = fine.groupBy("source", "group").agg(F.sum("words").alias("group_words")).select(F.col("source").alias("s"), F.col("group").alias("g"), earlier("group_words", ["group"], "source").alias("outer"))
    goals = d.groupBy("source").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("left")).select(F.col("source").alias("t"), "left")
    sums = fine.withColumn("inner", earlier("words", ["bin"], "source", "group")).join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g"))).join(goals, F.col("source").eqNullSafe(F.col("t")))
    sums = materialize(sums.select("source", "bin", "words", "left", (F.col("outer") + F.col("inner")).alias("before")), "mix-sums")
    full = sums.groupBy("source").agg(F.max(F.when(F.col("before") + F.col("words") <= F.col("left"), F.col("bin"))).alias("full"))
    edge = sums.where("before < left and before + words > left").select(F.col("source").alias("s"), F.col("bin").alias("edge"), "before", "left")
    e = d.join(edge, d["source"].eqNullSafe(F.col("s")) & (d["bin"] == F.col("edge")))
    e = e.groupBy("source", "edge", "before", "left", "rank", "draw", "size").agg(F.count("*").alias("n"))
    e = e.withColumn("words", F.col("n") * F.col("size"))
    e = e.withColumn("room", F.col("left") - F.col("before") - earlier("words", ["rank", "draw", "size"], "source"))
    # a document that crosses the target is taken if that comes nearer than leaving it
    fits = F.when(F.col("size") > 0, F.floor((2 * F.col("room") + F.col("size")) / (2 * F.col("size")))).when(F.col("room") >= 0, F.col("n")).otherwise(0)
    e = e.withColumn("m", F.least(F.col("n"), fits)).where("m > 0")
    last = F.struct("rank", "draw", "size").alias("last")
    e = e.groupBy("source").agg(F.max(F.struct(last, "m", "n", "edge")).alias("x")).select(F.col("source").alias("s"), "x.*")
    return materialize(full.join(e, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-bounds")


def copied(d: DataFrame, bounds: DataFrame, size: Column, most: int = MOST) -> DataFrame:
    """Ranked rows with `copies`. The size is looked at only where rank and draw are those of the bound."""
    b = bounds.select(F.col("source").alias("s"), "full", "edge", "last", "m", "n")
    d = d.join(b, F.col("source").eqNullSafe(F.col("s")), "left")
    tie = (F.col("rank") == F.col("last.rank")) & (F.col("draw") == F.col("last.draw"))
    within = (F.col("rank") < F.col("last.rank")) | ((F.col("rank") == F.col("last.rank")) & (F.col("draw") < F.col("last.draw")))
    state = F.when(F.col("bin") <= F.col("full"), 1).when(F.col("bin") == F.col("edge"), F.when(within, 1).when(tie, F.when(size < F.col("last.size"), 1).when(size == F.col("last.size"), F.when(F.col("m") < F.col("n"), 2).otherwise(1)).otherwise(0)).otherwise(0)).otherwise(0)
    d = d.withColumn("more", F.coalesce(state, F.lit(0)))
    if not bounds.where("m < n").isEmpty():
        # equal rows at a bound of which some are taken: numbered within a partition, and partitions one after the other
        tied = materialize(d.where("more = 2").withColumn("part", F.spark_partition_id()), "mix-ties")
        ahead = tied.groupBy("s", "part").agg(F.count("*").alias("k")).withColumn("ahead", F.coalesce(F.sum("k").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ahead = ahead.select(F.col("s").alias("s_"), F.col("part").alias("part_"), "ahead")
        own = F.row_number().over(Window.partitionBy("s", "part").orderBy("draw"))
        tied = tied.join(ahead, F.col("s").eqNullSafe(F.col("s_")) & (F.col("part") == F.col("part_"))).withColumn("more", (F.col("ahead") + own <= F.col("m")).cast("int"))
        d = d.where("more <> 2").unionByName(tied.select(d.columns))
    return d.withColumn("copies", F.least(F.col("certain") + F.col("more"), F.lit(most)))


def sized() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def drawn(seed: str) -> Column:
    return draw(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed=seed)


def weighed(docs: DataFrame, weight: str | None) -> Column:
    return F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)


def plan_mix(docs: DataFrame, weight: str | None = None, seed: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, source, size, draw, weight, certain, rank, bin and targets of each row, targets, bounds)."""
    slim = materialize(docs.select("doc_id", "source", sized().alias("size"), drawn(seed).alias("draw"), weighed(docs, weight).alias("weight")), "sizes")
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("mass"))
    sums = materialize(sums, "sources")
    targets = target_sizes(sums.select("source", "source_size")).join(sums.select(F.col("source").alias("s"), "mass"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = materialize(targets, "targets")
    d = materialize(ranked(slim, targets), "mix")
    return d, targets, bounds(d)


def op4(docs: DataFrame) -> DataFrame:
    d, _, cut = plan_mix(docs)
    return copied(d, cut, F.col("size")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weight: str | None = None, seed: str = "") -> DataFrame:
    """The mixed documents: each row as often as it is taken, with all its columns. No row is joined with another."""
    _, targets, cut = plan_mix(docs, weight, seed)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), "source", drawn(seed).alias("draw"), weighed(docs, weight).alias("weight"), F.col("text"))
    out = copied(ranked(rows, targets), cut, sized())
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
