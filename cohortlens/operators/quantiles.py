"""Exact quantiles that scale: distributed selection in three passes over the input.

Spark's exact ``percentile`` merges a value→count map per group in one task, so a
continuous measure over billions of rows (or one group holding a third of them) does not
fit. Here the exact answer (linear interpolation, pandas/DuckDB ``quantile_cont``) always
comes from the same path:

1. First pass, per group: ``count``, min, max and ``percentile_approx`` at p ± δ (a mergeable sketch, δ = 3/accuracy);
   these values are edges that cut the group's values into intervals (fewer than ``accuracy`` values: one
   interval). Only sketches are shuffled.
2. Second pass: every row is counted in one of ``CUTS`` equal ranges of its interval. Running counts over the ranges
   tell exactly which range holds a wanted rank, and how many rows are before it. Only counts are shuffled.
3. Third pass: the values of the ranges that hold a wanted rank are counted, combined before the shuffle, whose key
   holds the value, and ranked one by one. So no group is in one task.

The sketch only chooses the edges: its ranks are not exact (merged from many tasks they miss their error bound now and
then), and edges that miss a rank make its range wider, never the answer wrong.

Nothing is written and no job runs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
CUTS = 1024
PARTS = 32


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    accuracy: int = ACCURACY) -> DataFrame:
    """One row per group: ``by`` columns, ``n`` and ``q`` (array aligned with ``probs``).

    Groups without a non-NULL value produce no row. Without ``by`` edges and wanted ranges are scalar
    subqueries; with ``by`` they have ``PARTS`` rows per group and AQE picks broadcast or a
    (skew-split) shuffle join at run time.
    """
    by = list(by)
    probs = [float(p) for p in probs]
    delta = 3.0 / accuracy
    base = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    v = F.col("_v")

    def beside(one: DataFrame) -> DataFrame:
        """The rows with the one row of their group as struct ``_s``. The join is dealt by group and value, so that
        neither it nor the counts behind it have a group in one task."""
        one = one.select(*by, F.struct(*[c for c in one.columns if c not in by]).alias("_s"))
        if not by:
            return base.withColumn("_s", one.select("_s").scalar())
        many = one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        return base.withColumn("_part", F.pmod(F.hash("_v"), F.lit(PARTS))).join(many, [*by, "_part"]).drop("_part")

    def cut_of(low, high):
        cut = F.least(F.floor((v - low) / (high - low) * CUTS).cast("int"), F.lit(CUTS - 1))
        return F.when(high.isNotNull(), cut).otherwise(F.lit(0))

    ends = sorted({max(0.0, p - delta) for p in probs} | {min(1.0, p + delta) for p in probs})
    narrow = F.col("n") >= accuracy  # below, three ranks do not fit in the margin: all values
    bounds = F.array("_mn", "_mx")
    sketch = (base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"),
                                    F.percentile_approx("_v", ends, accuracy).alias("_b"))
              .select(*by, "n", F.array_sort(F.array_distinct(F.when(narrow, F.concat(bounds, "_b")).otherwise(bounds)))
                      .alias("edges")))

    # the interval's edges go along with the counts, so that both passes cut by the same ones; the maximum is an
    # interval of its own, without an upper edge
    x = beside(sketch).withColumn("_at", F.size(F.filter("_s.edges", lambda e: e <= v)))
    x = x.select(*by, "_v", F.col("_s.n").alias("n"), F.get("_s.edges", F.col("_at") - 1).alias("low"),
                 F.get("_s.edges", F.col("_at")).alias("high"))
    in_order = Window.partitionBy(*by, "n").orderBy("low", "cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = (x.groupBy(*by, "n", "low", "high", cut_of(F.col("low"), F.col("high")).alias("cut"))
              .agg(F.count(F.lit(1)).alias("rows")).withColumn("before", F.sum("rows").over(in_order) - F.col("rows")))
    rank = [F.lit(p) * (F.col("n") - 1) for p in probs]
    slots = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(h).cast("bigint").alias("k"), (h - F.floor(h)).alias("frac"))
                      for i, h in enumerate(rank)])
    held = F.filter(slots, lambda s: (F.col("before") + F.col("rows") > s["k"])
                    & (F.col("before") <= s["k"] + F.when(s["frac"] > 0, 1).otherwise(0)))
    cell = ["low", "high", "cut", "rows", "before"]
    wanted = (ranges.where(F.size(held) > 0).groupBy(*by, "n").agg(F.collect_list(F.struct(*cell)).alias("wanted")))

    def mine(r):
        inside = F.when(r["high"].isNull(), v == r["low"]).otherwise((v >= r["low"]) & (v < r["high"]))
        return inside & (cut_of(r["low"], r["high"]) == r["cut"])

    counted = (beside(wanted).select(*by, F.col("_s.n").alias("n"), "_v", F.inline(F.filter("_s.wanted", mine)))
               .groupBy(*by, "n", *cell, "_v").agg(F.count(F.lit(1)).alias("_cnt")))
    by_value = (Window.partitionBy(*by, "n", *cell).orderBy("_v")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (counted.withColumn("_upto", F.col("before") + F.sum("_cnt").over(by_value))
              .select(*by, "n", "_v", "_upto", "rows", "before", F.inline(held)))
    picks = ranked.groupBy(*by, "n", "i", "k", "frac").agg(
        F.min(F.when(F.col("_upto") > F.col("k"), v)).alias("_v0"),
        F.min(F.when(F.col("_upto") > F.col("k") + 1, v)).alias("_v1"),
        # the last value brings the running count to the end of its range: both passes saw the same rows
        F.max(F.col("_upto")).alias("_end"), F.max(F.col("before") + F.col("rows")).alias("_due"))
    ok = (F.col("_end") == F.col("_due")) & F.col("_v0").isNotNull() & ((F.col("frac") == 0) | F.col("_v1").isNotNull())
    val = F.when(F.col("frac") == 0, F.col("_v0")).otherwise(F.col("_v0") + F.col("frac") * (F.col("_v1") - F.col("_v0")))
    changed = F.raise_error(F.lit("the input of a quantile changed between two scans")).cast("double")
    one = picks.select(*by, "n", "i", F.when(ok, val).otherwise(changed).alias("_q"))
    return (one.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("i", "_q"))).alias("_a"))
            .select(*by, "n", F.transform("_a", lambda s: s["_q"]).alias("q")))
