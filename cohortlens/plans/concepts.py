"""Concepts tab: failure ranking, the weakest concept by group and by week, its trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import is_failed, is_passed, pct, week_start_monday
from cohortlens.operators.scope import ALL, Scope
from cohortlens.operators.stats import first_row, impact, scalars

TREND_UP, TREND_DOWN = 0.15, -0.15


def concept_log(t, scope: Scope = ALL) -> DataFrame:
    """Concepts ⟕ roster(course_name, group_id), scoped."""
    r = t.view("roster_core").select("student_id", "course_name", "group_id")
    return scope.apply(t.view("concepts").join(r, "student_id", "left"))


def concept_failure_rates(t, scope: Scope = ALL, min_attempts: int = 5) -> DataFrame:
    """A11 + P12: attempts (non-null record ids), fails, fail % per concept × course;
    only cells with more than ``min_attempts`` attempts."""
    c = concept_log(t, scope).where(F.col("concept_name").isNotNull() & F.col("course_name").isNotNull())
    s = (c.groupBy("concept_name", "course_name")
          .agg(F.count("record_id").alias("total_attempts"), F.count_if(is_failed()).alias("fails")))
    return (s.where(F.col("total_attempts") > min_attempts)
             .withColumn("fail_rate", pct("fails", "total_attempts")))


def _ranked(t, scope: Scope, min_attempts: int) -> DataFrame:
    return concept_failure_rates(t, scope, min_attempts).orderBy(
        F.desc("fail_rate"), F.asc("concept_name"), F.asc("course_name"))


def weakest_concept(t, scope: Scope = ALL, min_attempts: int = 5) -> DataFrame:
    """Top row of the failure ranking (ties → concept, then course name)."""
    return _ranked(t, scope, min_attempts).limit(1)


def hardest_concepts_top10(t, scope: Scope = ALL, min_attempts: int = 5) -> DataFrame:
    """Ten highest fail rates; rows whose concept is the weakest one flagged."""
    top = _ranked(t, scope, min_attempts).limit(10)
    w = first_row(weakest_concept(t, scope, min_attempts).select("concept_name"))["concept_name"]
    return top.withColumn("is_weakest", F.col("concept_name") == w)


def _weakest_rows(t, scope: Scope, min_attempts: int) -> DataFrame:
    """Every scoped attempt of the weakest concept, matched on the name (all courses)."""
    w = F.broadcast(weakest_concept(t, scope, min_attempts).select("concept_name"))
    return concept_log(t, scope).join(w, "concept_name", "left_semi")


def weakest_concept_by_group(t, scope: Scope = ALL, min_attempts: int = 5) -> DataFrame:
    return (_weakest_rows(t, scope, min_attempts).where(F.col("group_id").isNotNull())
            .groupBy("group_id")
            .agg(F.count("record_id").alias("attempts"), F.count_if(is_failed()).alias("fails"))
            .withColumn("fail_rate", pct("fails", "attempts")))


def weakest_concept_weekly(t, scope: Scope = ALL, min_attempts: int = 5) -> DataFrame:
    """Monday-start week: attempts, passes, pass %."""
    return (_weakest_rows(t, scope, min_attempts).where(F.col("timestamp").isNotNull())
            .groupBy(week_start_monday("timestamp").alias("week"))
            .agg(F.count("record_id").alias("total"), F.count_if(is_passed()).alias("passed"))
            .withColumn("pass_rate", pct("passed", "total")))


def concept_trend_status(t, scope: Scope = ALL, min_attempts: int = 5) -> DataFrame:
    """Slope of weekly pass % on days since the first week: > 0.15 improving, < −0.15
    degrading, else flat; one week or none: not enough data. One row."""
    wk = weakest_concept_weekly(t, scope, min_attempts)
    first = scalars(wk, F.min("week").alias("w0"))
    x = wk.withColumn("days_elapsed", F.datediff("week", first["w0"]))
    s = x.groupBy().agg(F.count(F.lit(1)).alias("weeks"),
                        impact("pass_rate", "days_elapsed", 1.0).alias("slope"))
    name = first_row(weakest_concept(t, scope, min_attempts).select("concept_name"))["concept_name"]
    st = (F.when(F.coalesce(F.col("weeks"), F.lit(0)) <= 1, F.lit("not enough data"))
           .when(F.col("slope") > TREND_UP, F.lit("improving"))
           .when(F.col("slope") < TREND_DOWN, F.lit("degrading"))
           .otherwise(F.lit("flat")))
    return (s.select(name.alias("concept_name"), F.coalesce("weeks", F.lit(0)).alias("weeks"),
                     F.when(F.col("weeks") > 1, F.col("slope")).alias("slope"), st.alias("trend_status"))
             .where(F.col("concept_name").isNotNull()))
