"""Dirtied inputs for the 33 data-quality rules (FIXTURES.md §4).

The driver's tables are clean, so each rule runs on a view derived from them in which the
defect is planted by a fixed rule (an id-modulo recipe). These are value derivations over
whole tables; no row is subset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.joins import dealt

# Fixed recipe values.
UNKNOWN_STUDENT_MOD = 50
CHAIN_BREAK_MOD, CHAIN_BREAK_COURSE = 40, "HOUSEHOLD"
FOREIGN_CONCEPT_MOD, FOREIGN_CONCEPT_COURSE = 60, "SMALL"
BAD_PREFIX_MOD, BAD_PREFIX = 70, "ZZ"
RENAMED_BEFORE = "1998-01-01 00:00:00"
GARBLED_MOD = 97
STATUS_FORMAT_MOD = 3
NEG_AGE_MOD, HIGH_AGE_MOD, HIGH_AGE_ADD = 45, 60, 150
BAD_EMAIL_MOD, BAD_EMAIL = 33, "missing@"
GENDER_FLIP_MOD = 70
LATE_FLIP_MOD = 30
TEN_POINT_MOD = 25
NULL_SCORE_MOD, NEG_SCORE_MOD, HIGH_SCORE_MOD = 90, 91, 92
WATCH_SCALE = 10
TWICE_MOD = 85
FIRST_PLAN, SECOND_PLAN, LATER_DAYS = "1992-06-01", "1995-01-01", 20
WEEKDAYS, TUESDAY_ON = 0b0111110, 0b1111100  # bit 0: Sunday
LAST_COURSE_END, EARLIER_DAYS = "1998-12-01", 30
OTHER_GENDER_MOD = 41


def known_students(t) -> DataFrame:
    """The students table with every 50th customer missing."""
    return (t.read("customer").where(F.col("c_custkey") % UNKNOWN_STUDENT_MOD != 0)
             .select(F.col("c_custkey").alias("student_id")))


def assessments_logged_course(t) -> DataFrame:
    a = t.view("assessments")
    return a.withColumn("logged_course_id", F.when(F.col("assessment_id") % CHAIN_BREAK_MOD == 0,
                                                   F.lit(CHAIN_BREAK_COURSE)).otherwise(F.col("course_id")))


def lineitem_logged_course(t) -> DataFrame:
    """Each line logs the course of its concept (part); every 60th order logs SMALL."""
    li = t.read("lineitem").select("l_orderkey", "l_partkey")
    p = t.read("part").select("p_partkey", "p_type")
    logged = F.when(F.col("l_orderkey") % FOREIGN_CONCEPT_MOD == 0, F.lit(FOREIGN_CONCEPT_COURSE))
    # the logged course is only known relative to the part's own course, so the derivation
    # reads it through the part key
    return (li.join(p, li.l_partkey == p.p_partkey, "left")
              .select("l_orderkey", "l_partkey", F.coalesce(logged, F.col("p_type")).alias("logged_course")))


def attendance_batches(t) -> tuple[DataFrame, DataFrame]:
    """Monthly batches: sessions before 1998 arrive with the column named ``datetime``."""
    a = t.view("attendance")
    cut = F.lit(RENAMED_BEFORE).cast("timestamp_ntz")
    old = a.where(F.col("session_datetime") < cut).withColumnRenamed("session_datetime", "datetime")
    new = a.where(~(F.col("session_datetime") < cut) | F.col("session_datetime").isNull())
    return old, new


def attendance_mixed_status(t) -> DataFrame:
    a = t.view("attendance")
    return a.withColumn("raw_status", F.when(F.col("record_id") % STATUS_FORMAT_MOD == 0,
                                             F.upper(F.concat("status", F.lit(" ")))).otherwise(F.col("status")))


def roster_dirty(t) -> DataFrame:
    r = t.view("roster_core")
    sid = F.col("student_id")
    age = (F.when(sid % NEG_AGE_MOD == 0, -F.col("age"))
            .when(sid % HIGH_AGE_MOD == 0, F.col("age") + HIGH_AGE_ADD).otherwise(F.col("age")))
    return (r.withColumn("raw_age_neg", F.when(sid % NEG_AGE_MOD == 0, -F.col("age")).otherwise(F.col("age")))
             .withColumn("raw_age_high", F.when(sid % HIGH_AGE_MOD == 0, F.col("age") + HIGH_AGE_ADD)
                         .otherwise(F.col("age")))
             .withColumn("raw_age", age)
             .withColumn("raw_email", F.when(sid % BAD_EMAIL_MOD == 0, F.lit(BAD_EMAIL)).otherwise(F.col("email")))
             .withColumn("gender", F.when(sid % GENDER_FLIP_MOD == 0, F.lit(1) - sid % 2).otherwise(sid % 2)))


def name_gender_lookup(t) -> DataFrame:
    """Name → gender reference (parity of the id stands in for the true gender), one row per
    name; names that stand for both genders are left out."""
    g = t.read("customer").select(F.col("c_name").alias("full_name"), (F.col("c_custkey") % 2).alias("g"))
    return (g.groupBy("full_name").agg(F.min("g").alias("true_gender"), F.max("g").alias("_other"))
             .where(F.col("true_gender") == F.col("_other")).drop("_other"))


def concepts_garbled(t) -> DataFrame:
    """Concept log with garbled names for the students of every 97th id."""
    return t.view("concepts").withColumn(
        "raw_concept_name", F.when(F.col("student_id") % GARBLED_MOD == 0, F.concat("concept_name", F.lit("Ã¤")))
        .otherwise(F.col("concept_name")))


def assessments_dirty(t) -> DataFrame:
    a = t.view("assessments")
    aid = F.col("assessment_id")
    late = F.col("submitted_at") > F.col("deadline")
    return (a.withColumn("is_late", F.when(aid % LATE_FLIP_MOD == 0, F.col("submitted_at") <= F.col("deadline"))
                         .otherwise(late))
             .withColumn("max_score", F.when(aid % TEN_POINT_MOD == 0, F.lit(10.0)).otherwise(F.lit(100.0)))
             .withColumn("raw_score", F.when(aid % NULL_SCORE_MOD == 0, F.lit(None).cast("double"))
                         .when(aid % NEG_SCORE_MOD == 0, F.lit(-5.0))
                         .when(aid % HIGH_SCORE_MOD == 0, F.lit(140.0)).otherwise(F.col("score"))))


def events_long_watch(t) -> DataFrame:
    return t.view("learn_events").withColumn("raw_duration", F.col("duration_seconds") * WATCH_SCALE)


# Combined raw exports: every recipe of a table planted at once (input of the cleaning jobs).
def raw_roster(t) -> DataFrame:
    """Roster export: ages negated / inflated, malformed emails, stated gender, a
    redundant ``course_id`` and a constant ``is_active``."""
    r = roster_dirty(t)
    return r.select("student_id", "full_name", F.col("raw_email").alias("email"), F.col("raw_age").alias("age"),
                    "course_id", "course_name", "group_id", "instructor", "stated_num_students", "gender",
                    F.lit(True).alias("is_active"))


def raw_assessments(t) -> DataFrame:
    """Assessment export: logged course and id prefix, flipped ``is_late``, ten-point
    scores, blank / negative / over-range scores, missing ``submitted_at`` as is."""
    a = t.view("assessments")
    aid = F.col("assessment_id")
    score = (F.when(aid % NULL_SCORE_MOD == 0, F.lit(None).cast("double"))
              .when(aid % NEG_SCORE_MOD == 0, F.lit(-5.0))
              .when(aid % HIGH_SCORE_MOD == 0, F.lit(140.0))
              .when(aid % TEN_POINT_MOD == 0, F.col("score") / 10)
              .otherwise(F.col("score")))
    return a.select(
        "assessment_id", "student_id",
        F.when(aid % CHAIN_BREAK_MOD == 0, F.lit(CHAIN_BREAK_COURSE)).otherwise(F.col("course_id")).alias("course_id"),
        F.when(aid % BAD_PREFIX_MOD == 0, F.lit(BAD_PREFIX)).otherwise(F.substring("course_id", 1, 2)).alias("id_prefix"),
        "group_id", "type", score.alias("score"),
        F.when(aid % TEN_POINT_MOD == 0, F.lit(10.0)).otherwise(F.lit(100.0)).alias("max_score"),
        "date", "deadline", "submitted_at",
        F.when(aid % LATE_FLIP_MOD == 0, F.col("submitted_at") <= F.col("deadline"))
         .otherwise(F.col("submitted_at") > F.col("deadline")).alias("is_late"))


def raw_attendance_batches(t) -> tuple[DataFrame, DataFrame]:
    """Attendance export in two schema generations, status written in mixed formats."""
    old, new = attendance_batches(t)

    def fmt(d: DataFrame) -> DataFrame:
        return d.withColumn("status", F.when(F.col("record_id") % STATUS_FORMAT_MOD == 0,
                                             F.upper(F.concat("status", F.lit(" ")))).otherwise(F.col("status")))
    return fmt(old), fmt(new)


def raw_events(t) -> DataFrame:
    """Event export: watch time stored in tenths of a second (×10), negatives as is."""
    return t.view("learn_events").withColumn("duration_seconds", F.col("duration_seconds") * WATCH_SCALE)


def raw_lines(t) -> DataFrame:
    """Concept submissions: lines with their student and logged course; every 85th order arrives twice."""
    li = dealt(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"), "l_orderkey")
    o = dealt(t.read("orders").select("o_orderkey", F.col("o_custkey").alias("student_id")), "o_orderkey")
    p = t.read("part").select("p_partkey", "p_type")
    logged = F.when(F.col("l_orderkey") % FOREIGN_CONCEPT_MOD == 0, F.lit(FOREIGN_CONCEPT_COURSE))
    copies = F.sequence(F.lit(1), F.when(F.col("l_orderkey") % TWICE_MOD == 0, 2).otherwise(1))
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey, "left")
              .select("l_orderkey", "l_linenumber", "l_partkey", "student_id", F.coalesce(logged, F.col("p_type")).alias("logged_course"),
                      "l_quantity", "l_shipdate", F.explode(copies).alias("_copy")).drop("_copy"))


def group_schedules(t) -> DataFrame:
    """``group_id, valid_from, days``: every group's weekdays, which change once, at another time for
    each nation's groups; one weekday differs by nation."""
    nation = F.col("stated_num_students").cast("int") - 5
    groups = t.view("roster_core").where(F.col("group_id").isNotNull()).select("group_id", nation.alias("k")).distinct()
    off = F.col("k") % 5
    first = F.struct(F.lit(FIRST_PLAN).cast("timestamp_ntz").alias("valid_from"),
                     (F.lit(WEEKDAYS) - F.pow(F.lit(2), off + 1).cast("int")).alias("days"))
    second = F.struct((F.lit(SECOND_PLAN).cast("timestamp_ntz") + F.make_interval(days=F.col("k") * LATER_DAYS)).alias("valid_from"),
                      (F.lit(TUESDAY_ON) - F.pow(F.lit(2), off + 2).cast("int")).alias("days"))
    return groups.select("group_id", F.inline(F.array(first, second)))


def course_ends(t) -> DataFrame:
    """``course_id, course_end``: courses with longer names end earlier."""
    courses = t.view("roster_core").where(F.col("course_id").isNotNull()).select("course_id").distinct()
    early = F.make_interval(days=F.length("course_id") * EARLIER_DAYS)
    return courses.select("course_id", (F.lit(LAST_COURSE_END).cast("timestamp_ntz") - early).alias("course_end"))


def raw_session_texts(t) -> DataFrame:
    """Session times as text; the monthly batches take turns in ISO, day-first and month-first form."""
    a = t.view("attendance")
    s = F.col("session_datetime")
    turn = (F.year(s) * 12 + F.month(s)) % 3
    text = (F.when(turn == 0, F.date_format(s, "yyyy-MM-dd HH:mm:ss")).when(turn == 1, F.date_format(s, "dd/MM/yyyy HH:mm:ss"))
             .otherwise(F.date_format(s, "MM/dd/yyyy HH:mm:ss")))
    return a.select("record_id", F.date_format(s, "yyyy-MM").alias("batch"), text.alias("session_text"))


def raw_gender_labels(t) -> DataFrame:
    """Gender as the systems write it: letters, words with stray spaces and capitals, digits; some unknown."""
    sid = F.col("student_id")
    male = sid % 2 == 1

    def one(m: str, f: str):
        return F.when(male, F.lit(m)).otherwise(F.lit(f))

    text = (F.when(sid % OTHER_GENDER_MOD == 0, F.lit("n/a")).when(sid % 3 == 0, one("M", "f"))
             .when(sid % 3 == 1, one(" male", "FEMALE ")).otherwise(one("1", "0")))
    return t.view("roster_core").select("student_id", text.alias("gender_text"))
