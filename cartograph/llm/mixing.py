"""Mixing sources to target weights by entropy balancing.

The rates of documents stay as close to 1 as the token constraints allow, by Kullback-Leibler divergence: for each
source, minimise ``sum r log r - r + 1`` subject to ``sum r * size = target`` and ``r <= cap``. The dual has one variable
per source; its solution tilts rates exponentially by size, ``r = min(cap, exp(lambda * size / mean size))``. Newton
steps on all sources at once, each safeguarded by a bracket, need one aggregate over the documents per round: sums for
gradient and curvature, pre-aggregated before the shuffle. Rates are then rounded into copies systematically along a
fixed pseudo-random order, and two small correcting passes bring the taken tokens to the target, within (source, salt):
a source has one salt for each so many documents, so one with a third of all rows is dealt over many tasks.

Cases: a null or empty text has size 0 and is taken once at no cost; a null source is a source of its own, last in
order; an empty table gives no rows; repeated rows are mixed row by row; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize, n_words

KEY = "_key"


def keyed(source: Column) -> Column:
    """Never null: one leading letter keeps null apart from any name."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Adds target to (KEY, source_size): weights repeat over the sources by code point and share the sum of sizes;
    no target exceeds cap times its source's size, and the excess goes to the others by weight.

    This is water filling: ``target = min(cap * size, weight * level)``. The level follows from cumulative sums over the
    sources ordered by the level at which each is full. One row per source.
    """
    order = Window.orderBy(KEY)
    t = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("limit", F.lit(float(cap)) * F.col("source_size")).withColumn("full_at", F.col("limit") / F.col("w"))
    by_level = Window.orderBy("full_at", KEY)
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / F.sum("w").over(rest))
    # the first source in this order that its level doesn't fill sets the level for all
    level = F.first(F.when(F.col("level") <= F.col("full_at"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return t.withColumn("at", level).select(KEY, "source_size", F.least("limit", F.col("w") * F.coalesce("at", F.lit(math.inf))).alias("target"))


def rates(docs: DataFrame, goals: DataFrame, cap: float = 3.0, rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """Adds lambda and mean to ``goals`` (KEY, source_size, target) by safeguarded Newton steps on the dual."""
    state = docs.groupBy(KEY).agg(F.avg("size").alias("mean"), F.count("*").alias("n_docs")).join(goals, KEY).withColumn("mean", F.greatest("mean", F.lit(1e-9)))
    state = materialize(state.select(KEY, "mean", "n_docs", "target", "source_size", F.lit(0.0).alias("lam"), F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi"), F.lit(False).alias("done")), partitions=1)
    log_cap = math.log(cap)
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        r = F.exp(F.least(F.col("lam") * x, F.lit(log_cap)))
        # sums in whole micro-units: addition order cannot change them, so reruns agree
        step = join_small(docs, state.where(~F.col("done")), [KEY]).groupBy(KEY).agg(
            F.sum((r * x).cast("decimal(24,9)")).cast("double").alias("g"),
            F.sum(F.when(F.col("lam") * x < log_cap, r * x * x).otherwise(0.0).cast("decimal(24,9)")).cast("double").alias("h"),
        )
        goal = F.col("target") / F.col("mean")
        s = state.join(step, KEY, "left").withColumn("over", F.col("g") - goal)
        s = s.withColumn("lo", F.when(F.col("over") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("over") > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.col("over") / F.when(F.col("h") > 1e-12, F.col("h"))
        middle = (F.col("lo") + F.col("hi")) / 2
        at = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(middle)
        close = F.col("done") | F.col("over").isNull() | (F.abs("over") <= tolerance * F.greatest(goal, F.lit(1.0))) | (F.col("hi") - F.col("lo") < 1e-9)
        state = materialize(s.select(KEY, "mean", "n_docs", "target", "source_size", F.when(close, F.col("lam")).otherwise(at).alias("lam"), "lo", "hi", close.alias("done")), partitions=1)
        if state.where(~F.col("done")).isEmpty():
            break
    return state


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_salt: int = 2_000) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, rate, copies, taken (copies times size)."""
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), keyed(F.col(source_col).cast("string")).alias(KEY), n_words(F.col(text_col)).alias("size")))
    sizes = rows.groupBy(KEY).agg(F.sum("size").alias("source_size"))
    state = rates(rows, materialize(targets(sizes, weights, cap), partitions=1), cap)
    return copies(rows, state, cap, rows_per_salt)


def copies(rows: DataFrame, state: DataFrame, cap: int, rows_per_salt: int) -> DataFrame:
    full = F.col("target") >= F.lit(cap) * F.col("source_size")
    rate = F.when(full, F.lit(float(cap))).otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap)))))
    r = join_small(rows, state.select(KEY, "mean", "n_docs", "lam", "target", "source_size"), [KEY]).withColumn("rate", F.least(rate, F.lit(float(cap))))
    r = r.withColumn("u", F.xxhash64("doc_id", "size")).withColumn("salt", F.pmod("u", F.ceil(F.col("n_docs") / rows_per_salt)))
    part = [KEY, "salt"]
    along = Window.partitionBy(*part).orderBy("u", "doc_id", "size")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*part)
    r = r.withColumn("low", F.floor("rate")).withColumn("frac", (F.round((F.col("rate") - F.floor("rate")) * 1_000_000)).cast("long"))
    r = r.withColumn("cum", F.sum("frac").over(so_far))
    r = r.withColumn("copies", F.least(F.col("low") + (F.floor(F.col("cum") / 1_000_000) > F.floor((F.col("cum") - F.col("frac")) / 1_000_000)).cast("long"), F.lit(cap)))
    for order in (["u", "doc_id", "size"], ["size", "u", "doc_id"]):
        run = Window.partitionBy(*part, "can").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        due = F.sum((F.col("rate") * F.col("size")).cast("decimal(24,6)")).over(whole) - F.sum((F.col("copies") * F.col("size")).cast("decimal(24,6)")).over(whole)
        r = r.withColumn("due", due.cast("double"))
        r = r.withColumn("can", F.when(F.col("size") == 0, F.lit(False)).when(F.col("due") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0))
        r = r.withColumn("cum", F.sum("size").over(run))
        r = r.withColumn("copies", F.col("copies") + F.when(F.col("can") & (F.col("cum") <= F.abs("due")), F.signum("due").cast("long")).otherwise(F.lit(0)))
    return r.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "rate", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), KEY)
