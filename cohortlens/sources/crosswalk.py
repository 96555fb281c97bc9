"""Crosswalk: the driver's TPC-H-style tables re-read as the learning-analytics domain.

Each view is a lazy DataFrame over whole tables; the derivation text is the common subset
of Spark SQL and DuckDB, so the oracle uses the very same expressions (FIXTURES.md §2).
The modulo expressions below derive values (which email is missing, which duration is
negative); they never subset rows.

Join shapes at scale: ``nation``/``region`` are 25/5-row dimensions whose scanned size the
planner checks against the broadcast threshold (so they are broadcast without a hint);
every other join is fact-to-fact on its key and left to AQE (sort-merge with skew
splitting, or broadcast when the runtime size of one side is under the threshold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed derivation rules (must equal the oracle's text).
ROSTER_COLS = [
    "c_custkey AS student_id",
    "c_name AS full_name",
    "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('u', CAST(c_custkey % 970 AS VARCHAR(20)), '@example.org') END AS email",
    "18 + c_custkey % 37 AS age",
    "c_mktsegment AS course_id",
    "c_mktsegment AS course_name",
    "concat(c_mktsegment, '-', n_name) AS group_id",
    "r_name AS instructor",
    "5 + n_nationkey AS stated_num_students",
]
ASSESSMENT_COLS = [
    "o_orderkey AS assessment_id",
    "o_custkey AS student_id",
    "c_mktsegment AS course_id",
    "concat(c_mktsegment, '-', n_name) AS group_id",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'assignment' WHEN '2-HIGH' THEN 'quiz' "
    "WHEN '3-MEDIUM' THEN 'exam' ELSE 'practical' END AS type",
    "o_totalprice / 5000 AS score",
    "o_orderdate AS date",
    "o_orderdate AS deadline",
]
ATTENDANCE_COLS = [
    "l_orderkey * 10 + l_linenumber AS record_id",
    "o_custkey AS student_id",
    "CASE l_returnflag WHEN 'N' THEN 'Absent' ELSE 'Attended' END AS status",
    "l_shipdate AS session_datetime",
]
CONCEPT_COLS = [
    "concat(CASE WHEN l_orderkey % 500 = 0 THEN 'CPX' ELSE 'CP' END, CAST(l_orderkey AS VARCHAR(20))) AS record_id",
    "o_custkey AS student_id",
    "p_name AS concept_name",
    "l_quantity * 2 AS score_pct",
    "CASE WHEN l_discount >= 0.06 THEN 'Failed' ELSE 'Passed' END AS mastery_status",
    "l_shipdate AS timestamp",
]
EVENT_COLS = [
    "event_id",
    "user_id AS student_id",
    "CASE event_type WHEN 'view' THEN 'video_watch' WHEN 'click' THEN 'login' "
    "WHEN 'signup' THEN 'quiz_attempt' ELSE event_type END AS event_type",
    "CASE WHEN event_id % 97 = 0 THEN -value * 60 ELSE value * 60 END AS duration_seconds",
    "ts AS event_datetime",
    "CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 = 0 THEN 'web' ELSE 'mobile' END AS device",
]


def _geo(t) -> DataFrame:
    """customer ⋈ nation ⋈ region. The two dimensions are tiny files; the planner
    broadcasts them after checking their scanned size against the broadcast threshold."""
    c = t.read("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = t.read("nation")
    r = t.read("region")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey))


def roster(t) -> DataFrame:
    """One row per customer; ``enrollment_date`` = the customer's first order date."""
    fo = (t.read("orders").groupBy("o_custkey")
          .agg(F.min("o_orderdate").alias("first_order")))
    g = _geo(t)
    return (g.join(fo, g.c_custkey == fo.o_custkey, "left")
             .selectExpr(*ROSTER_COLS, "first_order AS enrollment_date"))


def roster_core(t) -> DataFrame:
    """Roster without the enrollment lookup (saves the orders aggregate where unused)."""
    return _geo(t).selectExpr(*ROSTER_COLS)


def assessments(t) -> DataFrame:
    o = t.read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = t.read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t.read("nation").select("n_nationkey", "n_name")
    sh = (t.read("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped")))
    base = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return (base.join(sh, base.o_orderkey == sh.l_orderkey, "left")
                .selectExpr(*ASSESSMENT_COLS, "shipped AS submitted_at"))


def attendance(t) -> DataFrame:
    li = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    o = t.read("orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).selectExpr(*ATTENDANCE_COLS)


def concepts(t) -> DataFrame:
    li = t.read("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_shipdate")
    o = t.read("orders").select("o_orderkey", "o_custkey")
    p = t.read("part").select("p_partkey", "p_name")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(p, li.l_partkey == p.p_partkey)
              .selectExpr(*CONCEPT_COLS))


def learn_events(t) -> DataFrame:
    return t.read("events").selectExpr(*EVENT_COLS)


def raw_submissions(t) -> DataFrame:
    return (t.read("events").where(F.col("event_type") == "purchase")
             .selectExpr("user_id AS student_id", "ts AS submitted_at"))


def raw_quiz_grades(t) -> DataFrame:
    return (t.read("events").where(F.col("event_type") == "error")
             .selectExpr("user_id AS student_id", "'quiz' AS type", "ts AS date", "value AS score"))


# The reference's raw audit tables are the same derivations before cleaning.
raw_concepts = concepts
raw_events = learn_events
