"""Scale and grades (academics tab): KPIs, sizes, course and assessment-type spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from cohortlens.functions.exprs import is_attended, pct, title_case
from cohortlens.operators.scope import ALL, Scope
from cohortlens.operators.quantiles import exact_quantiles
from cohortlens.operators.stats import five_number, scalars


def filter_options(t, scope: Scope = ALL) -> DataFrame:
    """P25: sorted distinct courses and groups (NULL dropped); ``kind`` is course/group."""
    r = t.view("roster_core").select("course_name", "group_id")
    c = r.select(F.lit("course").alias("kind"), F.col("course_name").alias("value"))
    g = r.select(F.lit("group").alias("kind"), F.col("group_id").alias("value"))
    return c.unionByName(g).where(F.col("value").isNotNull()).distinct().orderBy("kind", "value")


def scoped_roster(t, scope: Scope = ALL, enrollment: bool = False) -> DataFrame:
    return scope.apply(t.view("roster" if enrollment else "roster_core"))


def graded(t, scope: Scope = ALL) -> DataFrame:
    """Assessments ⟕ roster(course_name, instructor); scoped on course and group."""
    r = t.view("roster_core").select("student_id", "course_name", "instructor")
    a = t.view("assessments").join(r, "student_id", "left")
    return scope.apply(a).withColumn("assessment_type", title_case("type"))


def platform_kpis(t, scope: Scope = ALL) -> DataFrame:
    """1 row: distinct students/instructors/courses/groups, mean age, attendance % over all
    attendance rows, video hours per distinct student (0 when none)."""
    r = scoped_roster(t, scope)
    ro = r.agg(F.count_distinct("student_id").alias("n_students"),
               F.count_distinct("instructor").alias("n_instructors"),
               F.count_distinct("course_name").alias("n_courses"),
               F.count_distinct("group_id").alias("n_groups"),
               F.avg(F.col("age").cast("double")).alias("avg_age"))
    at = scalars(t.view("attendance"), F.coalesce(pct(F.count_if(is_attended("status")), F.count(F.lit(1))),
                                                  F.lit(0.0)).alias("attendance_pct"))
    ev = scalars(t.view("learn_events").where(F.col("event_type") == "video_watch"),
                 F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("vsec"))
    return ro.select("n_students", "n_instructors", "n_courses", "n_groups", "avg_age",
                     at["attendance_pct"].alias("attendance_pct"),
                     F.coalesce(F.try_divide(ev["vsec"] / 3600.0, F.col("n_students").cast("double")),
                                F.lit(0.0)).alias("video_hours_per_student"))


def students_per_course(t, scope: Scope = ALL) -> DataFrame:
    return (scoped_roster(t, scope).where(F.col("course_name").isNotNull())
            .groupBy("course_name").agg(F.count(F.lit(1)).alias("students")))


def students_per_group(t, scope: Scope = ALL) -> DataFrame:
    return (scoped_roster(t, scope).where(F.col("group_id").isNotNull())
            .groupBy("group_id").agg(F.count(F.lit(1)).alias("students")))


def _course_means(t, scope: Scope) -> DataFrame:
    return (graded(t, scope).where(F.col("course_name").isNotNull())
            .groupBy("course_name")
            .agg(F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_score")))


def course_grade_stats(t, scope: Scope = ALL) -> DataFrame:
    """Mean and sample std of score per course, mean descending."""
    return _course_means(t, scope).orderBy(F.desc("mean_score"), "course_name")


def course_grade_extremes(t, scope: Scope = ALL) -> DataFrame:
    """Highest and lowest mean-score course (ties → smallest course name).
    Each side is a top-1 (TakeOrderedAndProject), no global sort."""
    m = _course_means(t, scope).select("course_name", "mean_score").where(F.col("mean_score").isNotNull())
    hi = m.orderBy(F.desc("mean_score"), "course_name").limit(1).withColumn("extreme", F.lit("highest"))
    lo = m.orderBy(F.asc("mean_score"), "course_name").limit(1).withColumn("extreme", F.lit("lowest"))
    return hi.unionByName(lo).select("extreme", "course_name", "mean_score")


def course_grade_spread(t, scope: Scope = ALL, approx: bool = False) -> DataFrame:
    """Five-number summary, IQR fences and outlier count of score per course. The narrow input, read
    three times, is written once (building the plan runs the write)."""
    g = t.materialize(f"course_scores_{scope}", lambda: graded(t, scope).where(F.col("course_name").isNotNull())
                      .select("course_name", "score"))
    return five_number(g, "course_name", "score", approx=approx)


def assessment_volatility(t, scope: Scope = ALL) -> DataFrame:
    """A8 + W8: sample std per title-cased type, ascending; the maximum flagged (all ties)."""
    v = (graded(t, scope).where(F.col("assessment_type").isNotNull())
         .groupBy("assessment_type").agg(F.stddev_samp("score").alias("std_score")))
    # the flag compares each aggregated row with the maximum of the SAME rows (a window over
    # one row per type), so both sides are the identical doubles
    mx = F.max("std_score").over(Window.partitionBy())
    return (v.withColumn("is_most_volatile", F.coalesce(F.col("std_score") == mx, F.lit(False)))
             .orderBy("std_score", "assessment_type"))


def assessment_distribution(t, scope: Scope = ALL, bins: int = 10) -> DataFrame:
    """Per raw type the quartiles plus an equal-width histogram over [min, max].

    One row per (type, bin) that holds values: ``bin`` 0..bins-1 (the maximum falls in the
    last bin), its bounds, its count, and the type's q1/median/q3.
    """
    g = t.materialize(f"type_scores_{scope}", lambda: graded(t, scope).where(
        F.col("type").isNotNull() & F.col("score").isNotNull()).select("type", F.col("score").cast("double").alias("score")))
    s = exact_quantiles(g, "score", [0.0, 0.25, 0.5, 0.75, 1.0], ["type"]) \
        .select("type", F.col("q")[0].alias("_mn"), F.col("q")[4].alias("_mx"),
                F.slice("q", 2, 3).alias("_q"))
    width = (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))
    b = F.when(F.col("_mx") > F.col("_mn"),
               F.least(F.floor((F.col("score") - F.col("_mn")) / (F.col("_mx") - F.col("_mn")) * bins),
                       F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    h = (g.select("type", "score").join(s, "type").withColumn("bin", b)
          .groupBy("type", "bin", "_mn", "_mx", "_q").agg(F.count(F.lit(1)).alias("n")))
    return h.select("type", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"),
                    "bin", (F.col("_mn") + width * F.col("bin")).alias("bin_lower"),
                    (F.col("_mn") + width * (F.col("bin") + 1)).alias("bin_upper"), "n")
