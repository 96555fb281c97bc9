"""Trends tab: weekly activity, score by type, month-of-year absence effect, age brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import is_attended, lower_eq, title_case, week_ending_monday, whole_days_between
from cohortlens.operators.joins import asof_backward
from cohortlens.operators.scope import ALL, Scope
from cohortlens.operators.stats import ols_columns, quantile_bins
from cohortlens.plans import profile

EVENT_KIND = "Platform Event (Login/Video)"
ASSESSMENT_KIND = "Assessments Taken (All Types)"


def weekly_activity(t) -> DataFrame:
    """Event times ∪ assessment times (submitted, else scheduled), counted per
    week-ending-Monday × kind. Only weeks with rows appear."""
    ev = t.view("learn_events").select(F.col("event_datetime").alias("ts"), F.lit(EVENT_KIND).alias("action_type"))
    a = t.view("assessments").select(F.coalesce("submitted_at", "date").alias("ts"),
                                     F.lit(ASSESSMENT_KIND).alias("action_type"))
    return (ev.unionByName(a).where(F.col("ts").isNotNull())
              .groupBy(week_ending_monday("ts").alias("week"), "action_type")
              .agg(F.count(F.lit(1)).alias("total_actions")))


def score_by_type(t) -> DataFrame:
    """Mean score per type, descending; title-cased label; ``Assignment`` flagged."""
    s = (t.view("assessments").where(F.col("type").isNotNull())
          .groupBy("type").agg(F.avg("score").alias("avg_score")))
    return (s.select(title_case("type").alias("assessment_type"), "avg_score")
             .withColumn("is_assignment", F.col("assessment_type") == "Assignment")
             .orderBy(F.desc("avg_score")))


def month_absence_rows(t, month: int = 3) -> DataFrame:
    """Assignments dated in ``month`` (any year), each with the latest attended session at
    or before its date for the same student (as-of backward) and whole days since.
    Unmatched assignments are dropped."""
    a = (t.view("assessments").where(lower_eq("type", "assignment") & F.col("date").isNotNull()
                                     & (F.month("date") == month))
          .select("assessment_id", "student_id", "date", "score"))
    names = t.view("roster_core").select("student_id", "full_name")
    a = a.join(names, "student_id", "left")
    s = t.view("attendance").where(is_attended("status") & F.col("session_datetime").isNotNull()) \
                            .select("student_id", "session_datetime")
    m = asof_backward(a, s, "student_id", "date", "session_datetime")
    return (m.where(F.col("session_datetime").isNotNull())
             .withColumn("days_since_last_attended", whole_days_between("session_datetime", "date"))
             .withColumnRenamed("session_datetime", "last_attended"))


def march_absence_effect(t, month: int = 3) -> DataFrame:
    return month_absence_rows(t, month)


def march_absence_trend(t, month: int = 3) -> DataFrame:
    """1 row: OLS of score on days since the last attended session."""
    return month_absence_rows(t, month).agg(*ols_columns("score", "days_since_last_attended"))


def age_bracket_outcomes(t, scope: Scope = ALL) -> DataFrame:
    """Quartile age brackets (right-closed, duplicate edges dropped) when more than three
    distinct ages exist, else one bracket per age; mean grade, attendance, uncapped video."""
    p = scope.apply(profile.demographic_profile(t))
    b = quantile_bins(p, "age", q=4, min_distinct=4)
    return (b.groupBy("bracket_lower", "bracket_upper")
             .agg(F.count(F.lit(1)).alias("students"), F.avg("avg_grade").alias("avg_grade"),
                  F.avg("attendance_rate").alias("avg_attendance"), F.avg("video_hours").alias("avg_watch_hours")))
