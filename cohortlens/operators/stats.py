"""

Quantiles are exact (linear interpolation, pandas' rule), by the distributed selection of
``quantiles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import col_


def ols_columns(y: str | Column, x: str | Column, prefix: str = "") -> list[Column]:
    """N, slope, intercept, R² of y on x (pairs with a NULL are skipped)."""
    y, x = col_(y).cast("double"), col_(x).cast("double")
    return [
        F.regr_count(y, x).alias(f"{prefix}n"),
        F.regr_slope(y, x).alias(f"{prefix}slope"),
        F.regr_intercept(y, x).alias(f"{prefix}intercept"),
        F.regr_r2(y, x).alias(f"{prefix}r2"),
    ]


def impact(y: str | Column, x: str | Column, multiplier: float = 1.0) -> Column:
    """Slope × multiplier; 0 when at most one valid pair; NULL for constant x."""
    y, x = col_(y).cast("double"), col_(x).cast("double")
    return F.when(F.regr_count(y, x) > 1, F.regr_slope(y, x) * F.lit(float(multiplier))).otherwise(F.lit(0.0))


def five_number(df: DataFrame, by: str | list[str], value: str, approx: bool = False) -> DataFrame:
    """Per group n, min, q1, median, q3, max, IQR fences and the outlier count.

    Quantiles come from ``exact_quantiles`` (distributed selection; p=0 and p=1 are the
    exact min and max). The fence table has one row per group and is joined back for a
    conditional count, which is partial-aggregated on the map side.
    """
    from cohortlens.operators.quantiles import exact_quantiles
    by = [by] if isinstance(by, str) else list(by)
    v = F.col(value).cast("double")
    base = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
    if approx:
        q = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                  F.percentile_approx("_v", [0.0, 0.25, 0.5, 0.75, 1.0], 100000).alias("q"))
    else:
        q = exact_quantiles(base, "_v", [0.0, 0.25, 0.5, 0.75, 1.0], by)
    q = (q.select(*by, "n", *[F.col("q")[i].alias(c) for i, c in
                              enumerate(("minimum", "q1", "median", "q3", "maximum"))])
          .withColumn("lower_fence", F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1")))
          .withColumn("upper_fence", F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))))
    out = (base.join(q.select(*by, "lower_fence", "upper_fence"), by)
               .groupBy(*by)
               .agg(F.count_if((F.col("_v") < F.col("lower_fence")) | (F.col("_v") > F.col("upper_fence")))
                    .alias("outliers")))
    return q.join(out, by, "left").fillna({"outliers": 0})


def scalar_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> Column:
    """Exact quantiles of ``value`` as a struct-valued scalar subquery (fields named by the
    ``probs`` keys; NULL fields when ``df`` has no value)."""
    from cohortlens.operators.quantiles import exact_quantiles
    names = list(probs)
    q = exact_quantiles(df, value, [probs[n] for n in names])
    return q.select(F.struct(*[F.col("q")[i].alias(n) for i, n in enumerate(names)]).alias("_s")).scalar()


def scalars(df: DataFrame, *aggs: Column) -> Column:
    """Global aggregates as ONE struct-valued scalar subquery column.

    The subquery runs once per query (AQE reuses identical subqueries) and its value is
    inlined into the consuming projection: no join, no nested loop, nothing broadcast.
    Fields are read with ``s["name"]``.
    """
    one = df.agg(*aggs)
    return one.select(F.struct(*one.columns).alias("_s")).scalar()


def first_row(df: DataFrame) -> Column:
    """A 0/1-row frame (e.g. a top-1) as a struct-valued scalar subquery (NULL if empty)."""
    return df.select(F.struct(*df.columns).alias("_s")).limit(1).scalar()


def min_max_scale(df: DataFrame, value: str, out: str, lo: float = 0.0, hi: float = 100.0,
                  basis: DataFrame | None = None) -> DataFrame:
    """Scale to [lo, hi] using the min/max of ``basis`` (default ``df``).

    A constant column maps to ``lo`` (the scikit-learn convention, not pyspark.ml's 0.5).
    """
    b = scalars(basis if basis is not None else df,
                F.min(F.col(value).cast("double")).alias("mn"), F.max(F.col(value).cast("double")).alias("mx"))
    rng = b["mx"] - b["mn"]
    scaled = F.when(rng > 0, (F.col(value) - b["mn"]) / rng * F.lit(hi - lo) + F.lit(lo)).otherwise(F.lit(lo))
    return df.withColumn(out, F.when(F.col(value).isNull(), None).otherwise(scaled))


def quantile_bins(df: DataFrame, value: str, q: int = 4, min_distinct: int = 4) -> DataFrame:
    """W6 (``pd.qcut(q, duplicates='drop')``): exact quantile edges, duplicates dropped,
    right-closed bins with the minimum in the first. When fewer than ``min_distinct``
    distinct values exist each value is its own bracket. NULL values get no bracket.

    Adds ``bracket`` (0-based), ``bracket_lower``, ``bracket_upper``.
    """
    v = F.col(value).cast("double")
    probs = [i / q for i in range(q + 1)]
    from cohortlens.operators.quantiles import exact_quantiles
    some = df.where(v.isNotNull())
    e = {"edges": exact_quantiles(some, value, probs).select(F.array_distinct("q")).scalar(),
         "nd": some.agg(F.count_distinct(v)).scalar()}
    inner = F.slice(F.col("_edges"), 2, q)
    idx = F.size(F.filter(inner, lambda x: x < v))
    single = F.size(F.col("_edges")) <= 1
    by_edges = F.when(single, F.lit(0)).otherwise(idx)
    res = df.where(v.isNotNull()).withColumn("_edges", e["edges"]).withColumn("_nd", e["nd"])
    res = (res.withColumn("_by_value", F.col("_nd") < F.lit(min_distinct))
              .withColumn("bracket", F.when(F.col("_by_value"), F.lit(None).cast("int")).otherwise(by_edges))
              .withColumn("bracket_lower", F.when(F.col("_by_value"), v)
                          .otherwise(F.element_at(F.col("_edges"), F.col("bracket") + 1)))
              .withColumn("bracket_upper", F.when(F.col("_by_value"), v)
                          .otherwise(F.when(single, F.element_at(F.col("_edges"), 1))
                                     .otherwise(F.element_at(F.col("_edges"), F.col("bracket") + 2)))))
    return res.drop("_edges", "_nd", "_by_value")


def share_pct(df: DataFrame, count_col: str, out: str = "share_pct") -> DataFrame:
    """A15 on already-aggregated rows: count / total ×100."""
    tot = scalars(df, F.sum(count_col).alias("tot"))
    return df.withColumn(out, F.try_divide(F.col(count_col).cast("double"), tot["tot"].cast("double")) * 100.0)
