"""Admin tab: phantom seats, small groups and merge candidates, monthly trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import month_start
from cohortlens.operators.joins import nearest_other
from cohortlens.operators.scope import ALL, Scope

SMALL_GROUP_MAX = 3
SHIFT_DOWN, SHIFT_UP = -1.0, 1.0


def _roster(t, scope: Scope) -> DataFrame:
    return scope.apply(t.view("roster_core"))


def _assessments(t, scope: Scope) -> DataFrame:
    """A course scope keeps assessments of the scoped roster's course ids (semi join on
    the distinct ids, well-defined where the reference took the first row's id)."""
    a = t.view("assessments")
    if scope.course is not None:
        ids = _roster(t, Scope(course=scope.course)).select("course_id").distinct()
        # the number of course ids is not bounded by construction: AQE decides at run time
        a = a.join(ids, "course_id", "left_semi")
    if scope.group is not None:
        a = a.where(F.col("group_id") == scope.group)
    return a


def phantom_seats(t, scope: Scope = ALL) -> DataFrame:
    """J6 folded into one aggregate: verified rows, max stated size, difference."""
    return (_roster(t, scope).where(F.col("group_id").isNotNull()).groupBy("group_id")
            .agg(F.count(F.lit(1)).alias("verified_count"), F.max("stated_num_students").alias("stated_count"))
            .withColumn("phantom_seats", F.col("stated_count") - F.col("verified_count")))


def phantom_seat_problems(t, scope: Scope = ALL) -> DataFrame:
    return phantom_seats(t, scope).where(F.col("phantom_seats") > 0).orderBy(F.desc("phantom_seats"), "group_id")


def small_groups(t, scope: Scope = ALL, max_size: int = SMALL_GROUP_MAX) -> DataFrame:
    return (_roster(t, scope).where(F.col("group_id").isNotNull()).groupBy("group_id")
            .agg(F.count(F.lit(1)).alias("group_size"), F.min("course_name").alias("course_name"))
            .where(F.col("group_size") <= max_size))


def group_mastery(t, scope: Scope = ALL) -> DataFrame:
    """Mean concept score per group (concepts ⋈ scoped roster)."""
    r = _roster(t, scope).select("student_id", "group_id")
    return (t.view("concepts").join(r, "student_id").where(F.col("group_id").isNotNull())
            .groupBy("group_id").agg(F.avg("score_pct").alias("mastery")))


def merge_candidates(t, scope: Scope = ALL, max_size: int = SMALL_GROUP_MAX) -> DataFrame:
    """For each small group the other scoped group with the nearest mean concept score.

    A target without concept data counts as 0; groups without data are never candidates.
    A merge is advised only when both groups study the same course. The search is the
    neighbour lookup of ``nearest_other`` (no pairs of groups are formed).
    """
    sg = small_groups(t, scope, max_size)
    gm = group_mastery(t, scope)
    courses = _roster(t, scope).groupBy("group_id").agg(F.min("course_name").alias("course_name"))
    targets = (sg.join(gm, "group_id", "left")
                 .select(F.col("group_id"), "group_size", F.col("course_name").alias("target_course"),
                         F.coalesce("mastery", F.lit(0.0)).alias("target_mastery")))
    cands = gm.join(courses.select("group_id"), "group_id", "left_semi")
    n = nearest_other(targets.withColumnRenamed("target_mastery", "mastery"), cands, "group_id", "mastery")
    cc = courses.select(F.col("group_id").alias("nearest_key"), F.col("course_name").alias("closest_course"))
    return (n.join(cc, "nearest_key", "left")
             .select(F.col("group_id").alias("target_group"), "group_size", "target_course",
                     F.col("mastery").alias("target_mastery"), F.col("nearest_key").alias("closest_group"),
                     "closest_course", F.col("nearest_value").alias("closest_mastery"),
                     F.abs(F.col("mastery") - F.col("nearest_value")).alias("mastery_diff"),
                     F.coalesce(F.col("target_course") == F.col("closest_course"), F.lit(False)).alias("merge_advised")))


def monthly_group_scores(t, scope: Scope = ALL) -> DataFrame:
    """Mean score per group × calendar month (NULL dates dropped)."""
    return (_assessments(t, scope).where(F.col("date").isNotNull() & F.col("group_id").isNotNull())
            .groupBy("group_id", month_start("date").alias("month"))
            .agg(F.avg("score").alias("avg_score")))


def cohort_trajectories(t, scope: Scope = ALL) -> DataFrame:
    """First vs last month mean per group; shift ≤ −1 sliding down, ≥ 1 trending up,
    else stable (a single month has shift 0). ``min_by``/``max_by`` — no window, no sort."""
    m = monthly_group_scores(t, scope)
    s = (m.groupBy("group_id")
          .agg(F.min("month").alias("start_month"), F.max("month").alias("end_month"),
               F.min_by("avg_score", "month").alias("start_score"), F.max_by("avg_score", "month").alias("end_score"),
               F.count(F.lit(1)).alias("months")))
    shift = F.when(F.col("months") > 1, F.col("end_score") - F.col("start_score")).otherwise(F.lit(0.0))
    return (s.withColumn("total_shift", shift)
             .withColumn("trend_status", F.when(F.col("total_shift") <= SHIFT_DOWN, "Sliding Down")
                         .when(F.col("total_shift") >= SHIFT_UP, "Trending Up").otherwise("Stable"))
             .drop("months"))


def monthly_group_trends(t, scope: Scope = ALL) -> DataFrame:
    """Each group's monthly means with its start-to-end shift and status attached
    (the data behind the coloured trajectory lines)."""
    tr = cohort_trajectories(t, scope).select("group_id", "total_shift", "trend_status")
    return monthly_group_scores(t, scope).join(tr, "group_id")


def trajectories_by_status(t, status: str, scope: Scope = ALL) -> DataFrame:
    """The per-direction tables: trajectories with one status, largest move first."""
    tr = cohort_trajectories(t, scope).where(F.col("trend_status") == status)
    order = F.asc("total_shift") if status == "Sliding Down" else F.desc("total_shift")
    return tr.orderBy(order, "group_id")
