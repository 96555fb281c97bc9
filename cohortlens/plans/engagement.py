"""Engagement tab: profile, group attendance, effort→grade slopes, submission timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import hours_between, is_attended, pct
from cohortlens.operators.scope import ALL, Scope
from cohortlens.operators.stats import five_number, impact, ols_columns, scalar_quantiles, scalars
from cohortlens.plans import profile


def engagement_profile(t, scope: Scope = ALL) -> DataFrame:
    return scope.apply(profile.engagement_profile(t))


def platform_attendance(t):
    """Scalar: attended share of ALL attendance rows ×100 (0 when empty)."""
    return scalars(t.view("attendance"), F.coalesce(
        pct(F.count_if(is_attended("status")), F.count(F.lit(1))), F.lit(0.0)).alias("platform_avg"))["platform_avg"]


def group_attendance(t, scope: Scope = ALL) -> DataFrame:
    """Label ``group (course)``, mean of student attendance rates, flag ``>=`` platform avg."""
    p = engagement_profile(t, scope)
    g = (p.withColumn("group_label", F.concat("group_id", F.lit(" ("), "course_name", F.lit(")")))
          .where(F.col("group_label").isNotNull())
          .groupBy("group_label").agg(F.avg("attendance_rate").alias("attendance_rate")))
    return (g.withColumn("platform_avg", platform_attendance(t))
             .withColumn("at_or_above_platform", F.coalesce(F.col("attendance_rate") >= F.col("platform_avg"),
                                                           F.lit(False))))


def engagement_impact(t, scope: Scope = ALL) -> DataFrame:
    """Three OLS fits on the mean grade in one pass: attendance ×10, logins ×10, video ×1."""
    p = engagement_profile(t, scope)
    specs = [("attendance_rate", 10.0), ("total_logins", 10.0), ("video_hours", 1.0)]
    aggs = []
    for i, (x, m) in enumerate(specs):
        aggs += ols_columns("avg_grade", x, prefix=f"m{i}_") + [impact("avg_grade", x, m).alias(f"m{i}_impact")]
    one = p.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(x).alias("measure"), F.lit(m).alias("multiplier"),
                              F.col(f"m{i}_n").alias("n"), F.col(f"m{i}_slope").alias("slope"),
                              F.col(f"m{i}_intercept").alias("intercept"), F.col(f"m{i}_r2").alias("r2"),
                              F.col(f"m{i}_impact").alias("impact"))
                     for i, (x, m) in enumerate(specs)])
    return one.select(F.inline(rows))


def submission_timing(t, quantile_cap: float = 0.98) -> DataFrame:
    """Assignments with both timestamps; hours before the deadline; rows above the p98 of
    that measure dropped; ``< 0`` labelled late. Unscoped, as in the reference."""
    a = (t.view("assessments")
          .where((F.col("type") == "assignment") & F.col("deadline").isNotNull() & F.col("submitted_at").isNotNull())
          .withColumn("hours_before_deadline", hours_between("submitted_at", "deadline")))
    cap = scalar_quantiles(a, "hours_before_deadline", {"cap": quantile_cap})
    return (a.where(F.col("hours_before_deadline") <= cap["cap"])
             .select("assessment_id", "student_id", "score", "hours_before_deadline",
                     F.when(F.col("hours_before_deadline") < 0, F.lit("Late Submission"))
                      .otherwise(F.lit("On-Time")).alias("submission_status")))


def late_vs_ontime_spread(t) -> DataFrame:
    """Five-number summaries of the two groups. The narrow input, itself cut at a quantile and read three
    times, is written once (building the plan runs the write)."""
    s = t.materialize("timed_scores", lambda: submission_timing(t).select("submission_status", "score"))
    return five_number(s, "submission_status", "score")


def early_submission_impact(t) -> DataFrame:
    """On-time rows only: OLS of score on hours early; points per day early = slope × 24."""
    s = submission_timing(t).where(F.col("hours_before_deadline") >= 0)
    return s.agg(*ols_columns("score", "hours_before_deadline"),
                 impact("score", "hours_before_deadline", 24.0).alias("points_per_day_early"))
