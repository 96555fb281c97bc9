"""Integrity audit over the raw (uncleaned) tables: test ids, garbled text, clone saves,
negative durations, multi-device minutes, ghost submissions, the 60% boundary and
phantom quiz grades. Every check is a filter, an aggregate or an anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import floor_ntz, lower_eq
from cohortlens.operators.joins import null_safe_anti
from cohortlens.sources import nested

# Fixed patterns (values the reference uses).
RECORD_ID_PATTERN = "^CP[0-9]+$"
MOJIBAKE_CLASS = "[ÃÂ¤â‚¬@?]"


def input_status(t) -> DataFrame:
    """Whether each required raw table has at least one row (a LIMIT 1 probe per table,
    not a count)."""
    probes = [("students", t.view("roster_core")), ("concepts", t.view("raw_concepts")),
              ("events", t.view("raw_events"))]
    out = None
    for name, df in probes:
        p = df.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows")).select(F.lit(name).alias("source_table"), "has_rows")
        out = p if out is None else out.unionByName(p)
    return out


def dummy_ids(t) -> DataFrame:
    """Record ids that are not ``CP`` + digits (NULL ids count as dummy)."""
    c = t.view("raw_concepts")
    ok = F.coalesce(F.col("record_id").cast("string").rlike(RECORD_ID_PATTERN), F.lit(False))
    return c.where(~ok).select("record_id", "student_id", "concept_name", "timestamp")


def corrupted_text(t) -> DataFrame:
    """Concept names holding mojibake characters (``@`` and ``?`` included)."""
    c = t.view("raw_concepts")
    return (c.where(F.coalesce(F.col("concept_name").rlike(MOJIBAKE_CLASS), F.lit(False)))
             .select("record_id", "student_id", "concept_name"))


def clones(t) -> DataFrame:
    """(student, concept, timestamp) saved more than once; copies and surplus rows."""
    c = t.view("raw_concepts").where(F.col("student_id").isNotNull() & F.col("concept_name").isNotNull()
                                     & F.col("timestamp").isNotNull())
    return (c.groupBy("student_id", "concept_name", "timestamp").agg(F.count(F.lit(1)).alias("copies"))
             .where(F.col("copies") > 1).withColumn("surplus", F.col("copies") - 1))


def negative_durations(t) -> DataFrame:
    e = t.view("raw_events").withColumn("duration_seconds", F.col("duration_seconds").try_cast("double"))
    return e.where(F.col("duration_seconds") < 0).select("event_id", "student_id", "event_type",
                                                         "duration_seconds", "event_datetime")


def multi_device(t) -> DataFrame:
    """(student, minute) with more than one distinct device."""
    e = t.view("raw_events").where(F.col("student_id").isNotNull() & F.col("event_datetime").isNotNull())
    return (e.groupBy("student_id", floor_ntz("event_datetime", "minute").alias("minute"))
             .agg(F.count_distinct("device").alias("device_count")).where(F.col("device_count") > 1))


def _active_days(t, event_types) -> DataFrame:
    e = t.view("raw_events")
    if event_types:
        e = e.where(F.col("event_type").isin(list(event_types)))
    return e.select("student_id", F.to_date("event_datetime").alias("event_date"))


def ghost_submissions(t, event_types: tuple[str, ...] | None = None) -> DataFrame:
    """Submissions with no event of ``event_types`` (default any) by the same student
    on the same day; NULL days match NULL days."""
    s = t.view("raw_submissions").withColumn("sub_date", F.to_date("submitted_at"))
    return (null_safe_anti(s, _active_days(t, event_types), [("student_id", "student_id"), ("sub_date", "event_date")],
                           null_safe=("sub_date",))
            .select("student_id", "submitted_at"))


def exploit_summary(t, event_types: tuple[str, ...] | None = None) -> DataFrame:
    """The three exploit counts with a clean/alert status."""
    counts = [("Negative Watch Time", negative_durations(t)), ("Simultaneous Web & Mobile", multi_device(t)),
              ("Ghost Submissions", ghost_submissions(t, event_types))]
    out = None
    for label, df in counts:
        c = df.agg(F.count(F.lit(1)).alias("flags")).select(F.lit(label).alias("exploit"), "flags")
        out = c if out is None else out.unionByName(c)
    return out.withColumn("status", F.when(F.col("flags") == 0, "clean").otherwise("alert"))


def sixty_boundary(t, score: float = 60.0) -> DataFrame:
    """P11 + A11: rows scoring exactly 60.0, passed vs failed."""
    c = t.view("raw_concepts").where(F.col("score_pct") == score)
    return c.agg(F.count_if(lower_eq("mastery_status", "passed")).alias("passed"),
                 F.count_if(lower_eq("mastery_status", "failed")).alias("failed"))


def raw_grades(t) -> DataFrame:
    """The nested grade export: written once as JSON Lines in the shared folder, read back
    with its declared schema and flattened."""
    spark = t.spark
    if "raw_grades_path" not in t._views:
        t._views["raw_grades_path"] = nested.write_nested_grades(spark, t.view("raw_quiz_grades"))
    return nested.flatten_grades(nested.read_nested_grades(spark, t._views["raw_grades_path"]))


def phantom_quizzes(t, event_types: tuple[str, ...] = ("quiz_attempt",)) -> DataFrame:
    """Quiz grades with no ``quiz_attempt`` event by the student that day."""
    q = raw_grades(t).where(lower_eq("type", "quiz")).withColumn("grade_date", F.to_date("date"))
    return (null_safe_anti(q, _active_days(t, event_types), [("student_id", "student_id"), ("grade_date", "event_date")],
                           null_safe=("grade_date",))
            .select("student_id", "type", "date", "score"))
