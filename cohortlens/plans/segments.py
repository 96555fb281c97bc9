"""Advanced tab: segments by medians, the at-risk score, top-10 list and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.scope import ALL, Scope
from cohortlens.operators.stats import first_row, scalar_quantiles, scalars, share_pct
from cohortlens.plans import profile

SEGMENTS = ("High Achievers", "Struggling but Engaged", "Independent / Coasting", "Disengaged & At-Risk")
TOP_K = 10


def student_profile(t, scope: Scope = ALL) -> DataFrame:
    """Min–max scaling uses every roster row; the scope applies after it (as the reference)."""
    return scope.apply(profile.student_profile(t))


def student_segments(t, scope: Scope = ALL) -> DataFrame:
    """Medians of grade and effort within the scope split the 2×2 segments (≥ is high)."""
    p = student_profile(t, scope)
    mg = scalar_quantiles(p, "avg_grade", {"m": 0.5})["m"]
    me = scalar_quantiles(p, "effort_score", {"m": 0.5})["m"]
    hg = F.col("avg_grade") >= mg
    he = F.col("effort_score") >= me
    seg = (F.when(hg & he, SEGMENTS[0]).when(~hg & he, SEGMENTS[1])
            .when(hg & ~he, SEGMENTS[2]).otherwise(SEGMENTS[3]))
    return p.withColumn("segment", seg)


def segment_profiles(t, scope: Scope = ALL) -> DataFrame:
    return (student_segments(t, scope).groupBy("segment")
            .agg(F.avg("avg_grade").alias("avg_grade"), F.avg("attendance_rate").alias("avg_attendance")))


def segment_shares(t, scope: Scope = ALL) -> DataFrame:
    c = student_segments(t, scope).groupBy("segment").agg(F.count(F.lit(1)).alias("students"))
    return share_pct(c, "students")


def risk_scores(t, scope: Scope = ALL) -> DataFrame:
    """((100−grade)/100·30 + (100−att)/100·25 + fails/max_fails·25 + drop/max_drop·20)·100,
    maxima within the scope (1 when not positive)."""
    p = student_profile(t, scope)
    mx = scalars(p, F.max("failed_concepts").alias("mf"), F.max("engagement_drop").alias("md"))
    mf = F.when(mx["mf"] > 0, mx["mf"]).otherwise(F.lit(1)).cast("double")
    md = F.when(mx["md"] > 0, mx["md"]).otherwise(F.lit(1)).cast("double")
    risk = (((F.lit(100.0) - F.col("avg_grade")) / 100.0 * 30.0)
            + ((F.lit(100.0) - F.col("attendance_rate")) / 100.0 * 25.0)
            + (F.col("failed_concepts") / mf * 25.0)
            + (F.col("engagement_drop") / md * 20.0)) * 100.0
    return p.withColumn("risk_score", risk)


def _top(r: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k by risk (ties → student id): per-partition top-k then one merge, no global sort."""
    return r.orderBy(F.desc("risk_score"), F.asc("student_id")).limit(k)


def at_risk_top10(t, scope: Scope = ALL, k: int = TOP_K) -> DataFrame:
    """Top 10 by risk; contact email blank when NULL or shared by several scoped rows.

    The duplicate test only needs the k listed emails: the scoped rows are semi-joined to
    those (a k-row broadcast) and counted, so no shuffle on ``email`` over all rows.
    """
    r = risk_scores(t, scope)
    top = _top(r, k)
    emails = F.broadcast(top.select("email").where(F.col("email").isNotNull()).distinct())
    dup = (r.select("email").join(emails, "email", "left_semi").groupBy("email")
            .agg((F.count(F.lit(1)) > 1).alias("_dup")))
    return (top.join(F.broadcast(dup), "email", "left")
               .select("student_id", "full_name",
                       F.when(F.col("email").isNull() | F.coalesce(F.col("_dup"), F.lit(False)), F.lit(""))
                        .otherwise(F.col("email")).alias("contact_email"),
                       "group_id", "avg_grade", "attendance_rate", "failed_concepts", "engagement_drop",
                       "risk_score"))


def _flagged(t, scope: Scope, k: int) -> DataFrame:
    r = risk_scores(t, scope)
    ids = F.broadcast(_top(r, k).select("student_id").distinct().withColumn("is_top", F.lit(True)))
    return r.join(ids, "student_id", "left").withColumn("is_top", F.coalesce("is_top", F.lit(False)))


def at_risk_vs_rest(t, scope: Scope = ALL, k: int = TOP_K) -> DataFrame:
    f = _flagged(t, scope, k)
    return (f.groupBy("is_top")
             .agg(F.avg("avg_grade").alias("avg_grade"), F.avg("attendance_rate").alias("avg_attendance"),
                  F.avg("effort_score").alias("avg_effort"))
             .select(F.when(F.col("is_top"), "Top 10 At-Risk").otherwise("Rest of Platform").alias("cohort"),
                     "avg_grade", "avg_attendance", "avg_effort"))


def at_risk_group_focus(t, scope: Scope = ALL, k: int = TOP_K, min_hits: int = 3) -> DataFrame:
    """Mode group of the top 10 (ties → smallest id). With at least ``min_hits`` of them:
    mean grade and fails of at-risk vs classmates inside it; else mean effort top vs rest.
    ``branch`` tells which comparison the rows hold."""
    f = _flagged(t, scope, k)
    top = f.where("is_top")
    mode = first_row(top.groupBy("group_id").agg(F.count(F.lit(1)).alias("hits"))
                     .orderBy(F.desc("hits"), F.asc("group_id")).limit(1)
                     .select(F.col("group_id").alias("mode_group"), "hits"))
    f = f.withColumn("mode_group", mode["mode_group"]).withColumn("hits", mode["hits"])
    inside = (f.where((F.col("hits") >= min_hits) & (F.col("group_id") == F.col("mode_group")))
               .groupBy("mode_group", "hits", "is_top")
               .agg(F.avg("avg_grade").alias("avg_grade"), F.avg("failed_concepts").alias("avg_fails"))
               .select("mode_group", "hits", F.lit("group").alias("branch"),
                       F.when(F.col("is_top"), "At-Risk Target").otherwise("Healthy Classmates").alias("status"),
                       "avg_grade", "avg_fails", F.lit(None).cast("double").alias("avg_effort")))
    effort = (f.where(F.col("hits") < min_hits)
               .groupBy("mode_group", "hits", "is_top").agg(F.avg("effort_score").alias("avg_effort"))
               .select("mode_group", "hits", F.lit("effort").alias("branch"),
                       F.when(F.col("is_top"), "Top 10 At-Risk").otherwise("Rest of Platform").alias("status"),
                       F.lit(None).cast("double").alias("avg_grade"), F.lit(None).cast("double").alias("avg_fails"),
                       "avg_effort"))
    return inside.unionByName(effort)
