"""Growth tab: active window, enrolment velocity, cumulative history and linear forecast.

The window is a scalar subquery (one row); the month grid comes from ``sequence`` over it
(its length is the span in months, independent of data volume); enrolments are counted
per month with a partial aggregate and accumulated with a running ``sum`` — no range
join, no per-month scan, no cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.exprs import month_start, whole_days_between
from cohortlens.operators.scope import ALL, Scope
from cohortlens.operators.stats import first_row, scalars

FALLBACK_DAYS = 180
MIN_DAYS = 30
DAYS_PER_MONTH = 30.44
HORIZON = (2030, 12)


def _enrolled(t, scope: Scope = ALL) -> DataFrame:
    return scope.apply(t.view("roster")).where(F.col("enrollment_date").isNotNull())


def active_window(t) -> DataFrame:
    """1 row: start = first enrolment (all students), end = last event, else start + 180 d."""
    e = scalars(t.view("learn_events"), F.max("event_datetime").alias("end"))
    return (_enrolled(t).agg(F.min("enrollment_date").alias("start_date"))
            .select("start_date", F.coalesce(e["end"], F.col("start_date")
                                             + F.make_interval(days=F.lit(FALLBACK_DAYS))).alias("end_date")))


def _window(t) -> Column:
    return first_row(active_window(t))


def _velocity(df: DataFrame, w: Column, by: list[str]) -> DataFrame:
    days = F.greatest(whole_days_between(w["start_date"], w["end_date"]), F.lit(MIN_DAYS))
    g = (df.groupBy(*by) if by else df.groupBy()).agg(F.count(F.lit(1)).alias("students"))
    return (g.where(F.col("students") > 0)
             .withColumn("days_elapsed", days)
             .withColumn("months_elapsed", F.col("days_elapsed") / F.lit(DAYS_PER_MONTH))
             .withColumn("velocity", F.col("students") / F.col("months_elapsed")))


def enrollment_velocity(t, scope: Scope = ALL) -> DataFrame:
    """rows ÷ (max(whole days, 30) / 30.44)."""
    return _velocity(_enrolled(t, scope), _window(t), []).select(
        "students", "days_elapsed", "months_elapsed", "velocity")


def _history(df: DataFrame, w: Column, by: list[str]) -> DataFrame:
    """Cumulative enrolments with a date on or before each calendar month's last day."""
    months = F.explode(F.sequence(month_start(w["start_date"]), month_start(w["end_date"]),
                                  F.expr("INTERVAL 1 MONTH"))).alias("month")
    # one row per key (or one row), then the month sequence generated per row
    keys = df.select(*by).distinct() if by else df.sparkSession.range(1)
    grid = keys.select(*by, months)
    per = df.groupBy(*by, month_start("enrollment_date").alias("month")).agg(F.count(F.lit(1)).alias("_n"))
    win = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("month") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # months before the grid start cannot exist (start = first enrolment); later months are
    # outside every grid row and so never counted
    return (grid.join(per, by + ["month"], "left")
                .withColumn("cumulative", F.sum(F.coalesce("_n", F.lit(0))).over(win)).drop("_n"))


def enrollment_history(t, scope: Scope = ALL) -> DataFrame:
    return _history(_enrolled(t, scope), _window(t), [])


def _forecast(df: DataFrame, w: Column, by: list[str], horizon=HORIZON) -> DataFrame:
    v = _velocity(df, w, by)
    h = _history(df, w, by)
    end = F.make_date(F.lit(horizon[0]), F.lit(horizon[1]), F.lit(1))
    if by:
        last = h.groupBy(*by).agg(F.max_by("cumulative", "month").alias("_last"))
        base = v.join(last, by, "left")
    else:
        last = scalars(h, F.max_by("cumulative", "month").alias("last"))["last"]
        base = v.withColumn("_last", last)
    base = base.withColumn("_base", F.coalesce(F.col("_last"), F.col("students")).cast("double"))
    m0 = month_start(w["end_date"])
    steps = F.when(m0 <= end, F.sequence(m0, end, F.expr("INTERVAL 1 MONTH"))) \
             .otherwise(F.array().cast("array<date>"))
    return (base.select(*by, "_base", "velocity", F.posexplode(steps).alias("step", "month"))
                .withColumn("cumulative", F.col("_base") + F.col("step") * F.col("velocity"))
                .select(*by, "month", "step", "cumulative"))


def enrollment_forecast(t, scope: Scope = ALL) -> DataFrame:
    """From the end month to Dec 2030: last history value + i·velocity (i=0 joins history)."""
    return _forecast(_enrolled(t, scope), _window(t), [])


def enrollment_projection(t, scope: Scope = ALL) -> DataFrame:
    """1 row: current total, velocity, projected total (truncated), multiplier."""
    p = scalars(enrollment_forecast(t, scope), F.max_by("cumulative", "step").alias("p"))["p"]
    v = enrollment_velocity(t, scope)
    return v.select(F.col("students").alias("current_total"), "velocity",
                    p.cast("bigint").alias("projected_total"),
                    F.try_divide(p.cast("bigint").cast("double"), F.col("students").cast("double")).alias("multiplier"))


def course_forecast(t, scope: Scope = ALL) -> DataFrame:
    """History and forecast per course over the GLOBAL window, one job partitioned by
    course (no per-course loop)."""
    df = _enrolled(t, scope).where(F.col("course_name").isNotNull())
    w = _window(t)
    h = _history(df, w, ["course_name"]).select("course_name", "month", F.lit("history").alias("kind"),
                                                F.col("cumulative").cast("double").alias("cumulative"))
    f = _forecast(df, w, ["course_name"]).select("course_name", "month", F.lit("forecast").alias("kind"),
                                                 "cumulative")
    return h.unionByName(f)
