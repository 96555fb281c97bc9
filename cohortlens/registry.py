"""Registered queries (name → plan over a ``Tables`` handle) and their DuckDB oracles.

Every oracle is written independently in SQL over the driver's tables, with the crosswalk
views as leading CTEs (``cohortlens.oracle.VIEWS``).
"""

from __future__ import annotations

from cohortlens.oracle import with_views as W
from cohortlens.plans import grades

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def reg(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = sql


# ---------------------------------------------------------------- scale and grades
_G = ("g AS (SELECT a.*, r.course_name, r.instructor FROM assessments a "
      "LEFT JOIN roster r ON a.student_id = r.student_id)")
_MEANS = ("m AS (SELECT course_name, avg(score) AS mean_score, stddev_samp(score) AS std_score "
          "FROM g WHERE course_name IS NOT NULL GROUP BY course_name)")

reg("filter_options", grades.filter_options, W(
    "SELECT DISTINCT 'course' AS kind, course_name AS value FROM roster WHERE course_name IS NOT NULL "
    "UNION SELECT DISTINCT 'group' AS kind, group_id AS value FROM roster WHERE group_id IS NOT NULL",
    "roster"))

reg("platform_kpis", grades.platform_kpis, W(
    """SELECT r.n_students, r.n_instructors, r.n_courses, r.n_groups, r.avg_age, a.attendance_pct,
       COALESCE(CASE WHEN r.n_students > 0 THEN v.vsec / 3600 / r.n_students END, 0) AS video_hours_per_student
    FROM (SELECT count(DISTINCT student_id) AS n_students, count(DISTINCT instructor) AS n_instructors,
                 count(DISTINCT course_name) AS n_courses, count(DISTINCT group_id) AS n_groups,
                 avg(CAST(age AS DOUBLE)) AS avg_age FROM roster) r,
         (SELECT COALESCE(CASE WHEN count(*) > 0 THEN CAST(count_if(lower(status) = 'attended') AS DOUBLE)
                 / count(*) * 100 END, 0) AS attendance_pct FROM attendance) a,
         (SELECT COALESCE(sum(duration_seconds), 0) AS vsec FROM learn_events WHERE event_type = 'video_watch') v""",
    "roster", "attendance", "learn_events", round_cols=("avg_age", "attendance_pct", "video_hours_per_student")))

reg("students_per_course", grades.students_per_course, W(
    "SELECT course_name, count(*) AS students FROM roster WHERE course_name IS NOT NULL GROUP BY course_name",
    "roster"))

reg("students_per_group", grades.students_per_group, W(
    "SELECT group_id, count(*) AS students FROM roster WHERE group_id IS NOT NULL GROUP BY group_id",
    "roster"))

reg("course_grade_stats", grades.course_grade_stats, W(
    f", {_G}, {_MEANS} SELECT * FROM m", "roster", "assessments",
    round_cols=("mean_score", "std_score")))

reg("course_grade_extremes", grades.course_grade_extremes, W(
    f""", {_G}, {_MEANS}
    (SELECT 'highest' AS extreme, course_name, mean_score FROM m WHERE mean_score IS NOT NULL
     ORDER BY mean_score DESC, course_name LIMIT 1)
    UNION ALL
    (SELECT 'lowest' AS extreme, course_name, mean_score FROM m WHERE mean_score IS NOT NULL
     ORDER BY mean_score ASC, course_name LIMIT 1)""", "roster", "assessments", round_cols=("mean_score",)))

_FIVE = ("SELECT {k}, count(v) AS n, min(v) AS minimum, quantile_cont(v, 0.25) AS q1, "
         "quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS maximum "
         "FROM {src} WHERE v IS NOT NULL GROUP BY {k}")
_FIVE_OUT = ("SELECT s.*, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence, "
             "(SELECT count(*) FROM {src} x WHERE x.{k} = s.{k} AND x.v IS NOT NULL "
             "AND (x.v < q1 - 1.5 * (q3 - q1) OR x.v > q3 + 1.5 * (q3 - q1))) AS outliers FROM s")
_FIVE_ROUND = ("minimum", "q1", "median", "q3", "maximum", "lower_fence", "upper_fence")

reg("course_grade_spread", grades.course_grade_spread, W(
    f""", {_G}, src AS (SELECT course_name, CAST(score AS DOUBLE) AS v FROM g WHERE course_name IS NOT NULL),
    s AS ({_FIVE.format(k='course_name', src='src')})
    {_FIVE_OUT.format(k='course_name', src='src')}""", "roster", "assessments", round_cols=_FIVE_ROUND))

_TITLE = "upper(substr(type, 1, 1)) || lower(substr(type, 2))"
reg("assessment_volatility", grades.assessment_volatility, W(
    f""", {_G}, v AS (SELECT {_TITLE} AS assessment_type, stddev_samp(score) AS std_score FROM g
        WHERE type IS NOT NULL GROUP BY 1)
    SELECT assessment_type, std_score, COALESCE(std_score = max(std_score) OVER (), false) AS is_most_volatile FROM v""",
    "roster", "assessments", round_cols=("std_score",)))

reg("assessment_distribution", grades.assessment_distribution, W(
    f""", {_G}, s AS (SELECT type, min(score) AS mn, max(score) AS mx, quantile_cont(score, 0.25) AS q1,
          quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3
        FROM g WHERE type IS NOT NULL AND score IS NOT NULL GROUP BY type),
    h AS (SELECT g.type, CAST(CASE WHEN mx > mn THEN least(floor((score - mn) / (mx - mn) * 10), 9) ELSE 0 END
          AS INTEGER) AS bin FROM g JOIN s ON g.type = s.type WHERE g.score IS NOT NULL)
    SELECT s.type, q1, median, q3, bin, mn + (mx - mn) / 10 * bin AS bin_lower,
           mn + (mx - mn) / 10 * (bin + 1) AS bin_upper, count(*) AS n
    FROM h JOIN s ON h.type = s.type GROUP BY s.type, q1, median, q3, bin, mn, mx""",
    "roster", "assessments", round_cols=("q1", "median", "q3", "bin_lower", "bin_upper")))

# ---------------------------------------------------------------- engagement
from cohortlens.plans import engagement, trends  # noqa: E402

_FACTS = """gr AS (SELECT student_id, avg(score) AS avg_grade FROM assessments GROUP BY student_id),
    att AS (SELECT student_id, CAST(count_if(lower(status) = 'attended') AS DOUBLE) / count(record_id) * 100
            AS attendance_rate FROM attendance GROUP BY student_id),
    lg AS (SELECT student_id, count(*) AS logins FROM learn_events WHERE event_type = 'login' GROUP BY student_id),
    vd AS (SELECT student_id, COALESCE(sum(duration_seconds), 0) / 3600 AS video_hours FROM learn_events
           WHERE event_type = 'video_watch' GROUP BY student_id)"""
_EP = _FACTS + """,
    cap AS (SELECT quantile_cont(video_hours, 0.98) AS cap FROM vd),
    ep AS (SELECT r.student_id, r.course_name, r.group_id, gr.avg_grade, att.attendance_rate,
                  COALESCE(lg.logins, 0) AS total_logins,
                  CASE WHEN vd.video_hours IS NULL THEN 0 ELSE least(vd.video_hours, cap.cap) END AS video_hours
           FROM roster r LEFT JOIN gr ON r.student_id = gr.student_id LEFT JOIN att ON r.student_id = att.student_id
           LEFT JOIN lg ON r.student_id = lg.student_id LEFT JOIN vd ON r.student_id = vd.student_id CROSS JOIN cap)"""
_EV = ("roster", "assessments", "attendance", "learn_events")
_PLATFORM = ("pa AS (SELECT COALESCE(CASE WHEN count(*) > 0 THEN CAST(count_if(lower(status) = 'attended') AS DOUBLE)"
             " / count(*) * 100 END, 0) AS platform_avg FROM attendance)")

reg("engagement_profile", engagement.engagement_profile, W(
    f", {_EP} SELECT * FROM ep", *_EV, round_cols=("avg_grade", "attendance_rate", "video_hours")))

reg("group_attendance", engagement.group_attendance, W(
    f""", {_EP}, {_PLATFORM},
    g AS (SELECT group_id || ' (' || course_name || ')' AS group_label, avg(attendance_rate) AS attendance_rate
          FROM ep WHERE group_id || ' (' || course_name || ')' IS NOT NULL GROUP BY 1)
    SELECT g.*, pa.platform_avg, COALESCE(g.attendance_rate >= pa.platform_avg, false) AS at_or_above_platform
    FROM g CROSS JOIN pa""", *_EV, round_cols=("attendance_rate", "platform_avg")))

_OLS = ("CAST(regr_count({y}, {x}) AS BIGINT) AS n, regr_slope({y}, {x}) AS slope, "
        "regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2")
_IMPACT = "CASE WHEN regr_count({y}, {x}) > 1 THEN regr_slope({y}, {x}) * {m} ELSE 0 END"
_OLS_ROUND = ("slope", "intercept", "r2")

reg("engagement_impact", engagement.engagement_impact, W(
    f", {_EP} " + " UNION ALL ".join(
        f"SELECT '{x}' AS measure, CAST({m} AS DOUBLE) AS multiplier, {_OLS.format(y='avg_grade', x=x)}, "
        f"{_IMPACT.format(y='avg_grade', x=x, m=m)} AS impact FROM ep"
        for x, m in (("attendance_rate", 10), ("total_logins", 10), ("video_hours", 1))),
    *_EV, round_cols=_OLS_ROUND + ("impact",)))

_TIMING = """ta AS (SELECT assessment_id, student_id, score,
           (epoch_us(deadline) - epoch_us(submitted_at)) / 3600000000 AS hours_before_deadline
           FROM assessments WHERE type = 'assignment' AND deadline IS NOT NULL AND submitted_at IS NOT NULL),
    tc AS (SELECT quantile_cont(hours_before_deadline, 0.98) AS cap FROM ta),
    timing AS (SELECT assessment_id, student_id, score, hours_before_deadline,
           CASE WHEN hours_before_deadline < 0 THEN 'Late Submission' ELSE 'On-Time' END AS submission_status
           FROM ta CROSS JOIN tc WHERE hours_before_deadline <= cap)"""

reg("submission_timing", engagement.submission_timing, W(
    f", {_TIMING} SELECT * FROM timing", "roster", "assessments",
    round_cols=("score", "hours_before_deadline")))

reg("late_vs_ontime_spread", engagement.late_vs_ontime_spread, W(
    f""", {_TIMING}, src AS (SELECT submission_status, CAST(score AS DOUBLE) AS v FROM timing),
    s AS ({_FIVE.format(k='submission_status', src='src')})
    {_FIVE_OUT.format(k='submission_status', src='src')}""", "roster", "assessments", round_cols=_FIVE_ROUND))

reg("early_submission_impact", engagement.early_submission_impact, W(
    f""", {_TIMING} SELECT {_OLS.format(y='score', x='hours_before_deadline')},
    {_IMPACT.format(y='score', x='hours_before_deadline', m=24)} AS points_per_day_early
    FROM timing WHERE hours_before_deadline >= 0""", "roster", "assessments",
    round_cols=_OLS_ROUND + ("points_per_day_early",)))

# ---------------------------------------------------------------- trends
reg("weekly_activity", trends.weekly_activity, W(
    """, u AS (SELECT event_datetime AS ts, 'Platform Event (Login/Video)' AS action_type FROM learn_events
         UNION ALL SELECT COALESCE(submitted_at, date) AS ts, 'Assessments Taken (All Types)' AS action_type
         FROM assessments)
    SELECT CAST(date_trunc('week', ts - INTERVAL 1 DAY) AS DATE) + 7 AS week, action_type,
           count(*) AS total_actions FROM u WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "assessments", "learn_events"))

reg("score_by_type", trends.score_by_type, W(
    f"""SELECT {_TITLE} AS assessment_type, avg(score) AS avg_score, ({_TITLE}) = 'Assignment' AS is_assignment
    FROM assessments WHERE type IS NOT NULL GROUP BY type""", "assessments", round_cols=("avg_score",)))

_MARCH = """ma AS (SELECT a.assessment_id, a.student_id, a.date, a.score, r.full_name FROM assessments a
           LEFT JOIN roster r ON a.student_id = r.student_id
           WHERE lower(a.type) = 'assignment' AND a.date IS NOT NULL AND month(a.date) = 3),
    ms AS (SELECT student_id, session_datetime FROM attendance
           WHERE lower(status) = 'attended' AND session_datetime IS NOT NULL),
    mm AS (SELECT ma.*, (SELECT max(ms.session_datetime) FROM ms WHERE ms.student_id = ma.student_id
           AND ms.session_datetime <= ma.date) AS last_attended FROM ma),
    march AS (SELECT *, CAST(floor((epoch_us(date) - epoch_us(last_attended)) / 86400000000) AS BIGINT)
           AS days_since_last_attended FROM mm WHERE last_attended IS NOT NULL)"""

reg("march_absence_effect", trends.march_absence_effect, W(
    f", {_MARCH} SELECT * FROM march", "roster", "assessments", "attendance", round_cols=("score",)))

reg("march_absence_trend", trends.march_absence_trend, W(
    f", {_MARCH} SELECT {_OLS.format(y='score', x='days_since_last_attended')} FROM march",
    "roster", "assessments", "attendance", round_cols=_OLS_ROUND))

reg("age_bracket_outcomes", trends.age_bracket_outcomes, W(
    f""", {_FACTS},
    p AS (SELECT CAST(r.age AS DOUBLE) AS age, gr.avg_grade, att.attendance_rate,
                 COALESCE(vd.video_hours, 0) AS video_hours
          FROM roster r LEFT JOIN gr ON r.student_id = gr.student_id LEFT JOIN att ON r.student_id = att.student_id
          LEFT JOIN vd ON r.student_id = vd.student_id WHERE r.age IS NOT NULL),
    e AS (SELECT list_sort(list_distinct(quantile_cont(age, [0, 0.25, 0.5, 0.75, 1]))) AS edges,
                 count(DISTINCT age) AS nd FROM p),
    b AS (SELECT p.*,
            CASE WHEN nd < 4 THEN age WHEN age <= edges[1] THEN edges[1]
                 ELSE list_max(list_filter(edges, lambda x: x < age)) END AS bracket_lower,
            CASE WHEN nd < 4 THEN age WHEN len(edges) = 1 THEN edges[1] WHEN age <= edges[1] THEN edges[2]
                 ELSE list_min(list_filter(edges, lambda x: x >= age)) END AS bracket_upper
          FROM p CROSS JOIN e)
    SELECT bracket_lower, bracket_upper, count(*) AS students, avg(avg_grade) AS avg_grade,
           avg(attendance_rate) AS avg_attendance, avg(video_hours) AS avg_watch_hours
    FROM b GROUP BY bracket_lower, bracket_upper""", *_EV,
    round_cols=("bracket_lower", "bracket_upper", "avg_grade", "avg_attendance", "avg_watch_hours")))

# ---------------------------------------------------------------- concepts
from cohortlens.plans import concepts, segments  # noqa: E402

_CL = """cl AS (SELECT c.*, r.course_name, r.group_id FROM concepts c LEFT JOIN roster r ON c.student_id = r.student_id),
    cr AS (SELECT concept_name, course_name, count(record_id) AS total_attempts,
                  count_if(lower(mastery_status) = 'failed') AS fails,
                  CAST(count_if(lower(mastery_status) = 'failed') AS DOUBLE) / count(record_id) * 100 AS fail_rate
           FROM cl WHERE concept_name IS NOT NULL AND course_name IS NOT NULL
           GROUP BY concept_name, course_name HAVING count(record_id) > 5),
    wk AS (SELECT * FROM cr ORDER BY fail_rate DESC, concept_name, course_name LIMIT 1)"""
_WEEKLY = """weekly AS (SELECT CAST(date_trunc('week', timestamp) AS DATE) AS week, count(record_id) AS total,
           count_if(lower(mastery_status) = 'passed') AS passed,
           CAST(count_if(lower(mastery_status) = 'passed') AS DOUBLE) / count(record_id) * 100 AS pass_rate
           FROM cl WHERE concept_name = (SELECT concept_name FROM wk) AND timestamp IS NOT NULL GROUP BY 1)"""
_CV = ("roster", "concepts")

reg("concept_failure_rates", concepts.concept_failure_rates, W(
    f", {_CL} SELECT * FROM cr", *_CV, round_cols=("fail_rate",)))
reg("weakest_concept", concepts.weakest_concept, W(f", {_CL} SELECT * FROM wk", *_CV, round_cols=("fail_rate",)))
reg("hardest_concepts_top10", concepts.hardest_concepts_top10, W(
    f""", {_CL} SELECT cr.*, cr.concept_name = (SELECT concept_name FROM wk) AS is_weakest FROM cr
    ORDER BY fail_rate DESC, concept_name, course_name LIMIT 10""", *_CV, round_cols=("fail_rate",)))
reg("weakest_concept_by_group", concepts.weakest_concept_by_group, W(
    f""", {_CL} SELECT group_id, count(record_id) AS attempts, count_if(lower(mastery_status) = 'failed') AS fails,
    CAST(count_if(lower(mastery_status) = 'failed') AS DOUBLE) / count(record_id) * 100 AS fail_rate
    FROM cl WHERE concept_name = (SELECT concept_name FROM wk) AND group_id IS NOT NULL GROUP BY group_id""",
    *_CV, round_cols=("fail_rate",)))
reg("weakest_concept_weekly", concepts.weakest_concept_weekly, W(
    f", {_CL}, {_WEEKLY} SELECT * FROM weekly", *_CV, round_cols=("pass_rate",)))
reg("concept_trend_status", concepts.concept_trend_status, W(
    f""", {_CL}, {_WEEKLY}, x AS (SELECT *, date_diff('day', min(week) OVER (), week) AS days FROM weekly)
    SELECT (SELECT concept_name FROM wk) AS concept_name, count(*) AS weeks,
           CASE WHEN count(*) > 1 THEN regr_slope(pass_rate, days) END AS slope,
           CASE WHEN count(*) <= 1 THEN 'not enough data' WHEN regr_slope(pass_rate, days) > 0.15 THEN 'improving'
                WHEN regr_slope(pass_rate, days) < -0.15 THEN 'degrading' ELSE 'flat' END AS trend_status
    FROM x""", *_CV, round_cols=("slope",)))

# ---------------------------------------------------------------- segments and risk
_SP_T = _FACTS + """,
    mid AS (SELECT min(event_datetime) + (max(event_datetime) - min(event_datetime)) / 2 AS mid FROM learn_events),
    ec AS (SELECT student_id, count(*) AS events, count_if(event_datetime < mid) AS h1,
                  count_if(event_datetime >= mid) AS h2 FROM learn_events CROSS JOIN mid GROUP BY student_id),
    fl AS (SELECT student_id, count_if(lower(mastery_status) = 'failed') AS fails FROM concepts GROUP BY student_id),
    sp0 AS (SELECT r.student_id, r.full_name, r.email, r.course_name, r.group_id,
                   COALESCE(gr.avg_grade, 0) AS avg_grade, COALESCE(att.attendance_rate, 0) AS attendance_rate,
                   COALESCE(ec.events, 0) AS platform_events, COALESCE(fl.fails, 0) AS failed_concepts,
                   COALESCE(ec.h1, 0) AS h1_events, COALESCE(ec.h2, 0) AS h2_events,
                   greatest(COALESCE(ec.h1, 0) - COALESCE(ec.h2, 0), 0) AS engagement_drop
            FROM roster r LEFT JOIN gr ON r.student_id = gr.student_id LEFT JOIN att ON r.student_id = att.student_id
            LEFT JOIN ec ON r.student_id = ec.student_id LEFT JOIN fl ON r.student_id = fl.student_id),
    mm AS (SELECT min(platform_events) AS mn, max(platform_events) AS mx FROM sp0),
    sp1 AS (SELECT sp0.*, CASE WHEN mx > mn THEN (platform_events - mn) / (mx - mn) * 100 ELSE 0 END
            AS normalized_events FROM sp0 CROSS JOIN mm),
    spa AS (SELECT sp1.*, attendance_rate * 0.6 + normalized_events * 0.4 AS effort_score FROM sp1),
    sp AS (SELECT * FROM spa WHERE {scope}),
    med AS (SELECT quantile_cont(avg_grade, 0.5) AS mg, quantile_cont(effort_score, 0.5) AS me FROM sp),
    seg AS (SELECT sp.*, CASE WHEN avg_grade >= mg AND effort_score >= me THEN 'High Achievers'
                 WHEN avg_grade < mg AND effort_score >= me THEN 'Struggling but Engaged'
                 WHEN avg_grade >= mg AND effort_score < me THEN 'Independent / Coasting'
                 ELSE 'Disengaged & At-Risk' END AS segment FROM sp CROSS JOIN med),
    rmax AS (SELECT CAST(CASE WHEN max(failed_concepts) > 0 THEN max(failed_concepts) ELSE 1 END AS DOUBLE) AS mf,
                    CAST(CASE WHEN max(engagement_drop) > 0 THEN max(engagement_drop) ELSE 1 END AS DOUBLE) AS md FROM sp),
    rs AS (SELECT sp.*, (((100 - avg_grade) / 100 * 30) + ((100 - attendance_rate) / 100 * 25)
                  + (failed_concepts / mf * 25) + (engagement_drop / md * 20)) * 100 AS risk_score
           FROM sp CROSS JOIN rmax),
    top AS (SELECT * FROM rs ORDER BY risk_score DESC, student_id LIMIT 10),
    flagged AS (SELECT rs.*, rs.student_id IN (SELECT student_id FROM top) AS is_top FROM rs)"""
_SP = _SP_T.replace("{scope}", "true")
_SPV = ("roster", "assessments", "attendance", "learn_events", "concepts")
_SP_ROUND = ("avg_grade", "attendance_rate", "normalized_events", "effort_score")

reg("student_profile", segments.student_profile, W(f", {_SP} SELECT * FROM sp", *_SPV, round_cols=_SP_ROUND))
reg("student_segments", segments.student_segments, W(f", {_SP} SELECT * FROM seg", *_SPV, round_cols=_SP_ROUND))
reg("segment_profiles", segments.segment_profiles, W(
    f", {_SP} SELECT segment, avg(avg_grade) AS avg_grade, avg(attendance_rate) AS avg_attendance FROM seg GROUP BY segment",
    *_SPV, round_cols=("avg_grade", "avg_attendance")))
reg("segment_shares", segments.segment_shares, W(
    f""", {_SP} SELECT segment, students, CAST(students AS DOUBLE) / sum(students) OVER () * 100 AS share_pct
    FROM (SELECT segment, count(*) AS students FROM seg GROUP BY segment) c""", *_SPV, round_cols=("share_pct",)))
reg("risk_scores", segments.risk_scores, W(f", {_SP} SELECT * FROM rs", *_SPV,
                                          round_cols=_SP_ROUND + ("risk_score",)))
reg("at_risk_top10", segments.at_risk_top10, W(
    f""", {_SP} SELECT student_id, full_name,
       CASE WHEN email IS NULL OR (SELECT count(*) FROM rs x WHERE x.email = top.email) > 1 THEN '' ELSE email END
       AS contact_email, group_id, avg_grade, attendance_rate, failed_concepts, engagement_drop, risk_score FROM top""",
    *_SPV, round_cols=("avg_grade", "attendance_rate", "risk_score")))
reg("at_risk_vs_rest", segments.at_risk_vs_rest, W(
    f""", {_SP} SELECT CASE WHEN is_top THEN 'Top 10 At-Risk' ELSE 'Rest of Platform' END AS cohort,
       avg(avg_grade) AS avg_grade, avg(attendance_rate) AS avg_attendance, avg(effort_score) AS avg_effort
    FROM flagged GROUP BY is_top""", *_SPV, round_cols=("avg_grade", "avg_attendance", "avg_effort")))
reg("at_risk_group_focus", segments.at_risk_group_focus, W(
    f""", {_SP}, md AS (SELECT group_id AS mode_group, count(*) AS hits FROM top GROUP BY group_id
                      ORDER BY hits DESC, group_id LIMIT 1)
    SELECT mode_group, hits, 'group' AS branch,
           CASE WHEN is_top THEN 'At-Risk Target' ELSE 'Healthy Classmates' END AS status,
           avg(avg_grade) AS avg_grade, avg(failed_concepts) AS avg_fails, CAST(NULL AS DOUBLE) AS avg_effort
    FROM flagged CROSS JOIN md WHERE hits >= 3 AND group_id = mode_group GROUP BY mode_group, hits, is_top
    UNION ALL
    SELECT mode_group, hits, 'effort' AS branch,
           CASE WHEN is_top THEN 'Top 10 At-Risk' ELSE 'Rest of Platform' END AS status,
           CAST(NULL AS DOUBLE) AS avg_grade, CAST(NULL AS DOUBLE) AS avg_fails, avg(effort_score) AS avg_effort
    FROM flagged CROSS JOIN md WHERE hits < 3 GROUP BY mode_group, hits, is_top""",
    *_SPV, round_cols=("avg_grade", "avg_fails", "avg_effort")))

# ---------------------------------------------------------------- cohorts
from functools import partial  # noqa: E402

from cohortlens.plans import cohorts, growth  # noqa: E402

reg("phantom_seats", cohorts.phantom_seats, W(
    """SELECT group_id, count(*) AS verified_count, max(stated_num_students) AS stated_count,
       max(stated_num_students) - count(*) AS phantom_seats FROM roster WHERE group_id IS NOT NULL GROUP BY group_id""",
    "roster"))
reg("phantom_seat_problems", cohorts.phantom_seat_problems, W(
    """SELECT group_id, count(*) AS verified_count, max(stated_num_students) AS stated_count,
       max(stated_num_students) - count(*) AS phantom_seats FROM roster WHERE group_id IS NOT NULL GROUP BY group_id
       HAVING max(stated_num_students) - count(*) > 0""", "roster"))


def _small_sql(n: int) -> str:
    return W(f"""SELECT group_id, count(*) AS group_size, min(course_name) AS course_name FROM roster
        WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(*) <= {n}""", "roster")


def _merge_sql(n: int) -> str:
    return W(f""", sg AS (SELECT group_id, count(*) AS group_size, min(course_name) AS course_name FROM roster
              WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(*) <= {n}),
    gm AS (SELECT r.group_id, avg(c.score_pct) AS mastery FROM concepts c JOIN roster r ON c.student_id = r.student_id
           WHERE r.group_id IS NOT NULL GROUP BY r.group_id),
    gc AS (SELECT group_id, min(course_name) AS course_name FROM roster GROUP BY group_id),
    tg AS (SELECT sg.group_id, sg.group_size, sg.course_name AS target_course,
                  COALESCE(gm.mastery, 0) AS target_mastery FROM sg LEFT JOIN gm ON sg.group_id = gm.group_id),
    pairs AS (SELECT tg.group_id AS tgt, gm.group_id AS cand, gm.mastery AS cm,
                     abs(tg.target_mastery - gm.mastery) AS d
              FROM tg JOIN gm ON gm.group_id <> tg.group_id WHERE gm.group_id IN (SELECT group_id FROM gc)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tgt ORDER BY d, cand) AS rn FROM pairs) b
             WHERE rn = 1)
    SELECT tg.group_id AS target_group, tg.group_size, tg.target_course, tg.target_mastery,
           best.cand AS closest_group, gc.course_name AS closest_course, best.cm AS closest_mastery,
           abs(tg.target_mastery - best.cm) AS mastery_diff,
           COALESCE(tg.target_course = gc.course_name, false) AS merge_advised
    FROM tg LEFT JOIN best ON tg.group_id = best.tgt LEFT JOIN gc ON best.cand = gc.group_id""",
             "roster", "concepts", round_cols=("target_mastery", "closest_mastery", "mastery_diff"))


reg("small_groups", cohorts.small_groups, _small_sql(3))
reg("merge_candidates", cohorts.merge_candidates, _merge_sql(3))
# FIXTURES.md: at sf0.01 no group has ≤ 3 rows, so the limit 6 also runs the search itself.
reg("small_groups_6", partial(cohorts.small_groups, max_size=6), _small_sql(6))
reg("merge_candidates_6", partial(cohorts.merge_candidates, max_size=6), _merge_sql(6))

_MG = """mg AS (SELECT group_id, CAST(date_trunc('month', date) AS DATE) AS month, avg(score) AS avg_score
           FROM assessments WHERE date IS NOT NULL AND group_id IS NOT NULL GROUP BY 1, 2)"""
reg("monthly_group_scores", cohorts.monthly_group_scores, W(
    f", {_MG} SELECT * FROM mg", "assessments", round_cols=("avg_score",)))
reg("cohort_trajectories", cohorts.cohort_trajectories, W(
    f""", {_MG}, s AS (SELECT group_id, min(month) AS start_month, max(month) AS end_month,
           arg_min(avg_score, month) AS start_score, arg_max(avg_score, month) AS end_score,
           CASE WHEN count(*) > 1 THEN arg_max(avg_score, month) - arg_min(avg_score, month) ELSE 0 END AS total_shift
           FROM mg GROUP BY group_id)
    SELECT s.*, CASE WHEN total_shift <= -1.0 THEN 'Sliding Down' WHEN total_shift >= 1.0 THEN 'Trending Up'
                ELSE 'Stable' END AS trend_status FROM s""", "assessments",
    round_cols=("start_score", "end_score", "total_shift")))

_TRAJ = f""", {_MG}, s AS (SELECT group_id, min(month) AS start_month, max(month) AS end_month,
           arg_min(avg_score, month) AS start_score, arg_max(avg_score, month) AS end_score,
           CASE WHEN count(*) > 1 THEN arg_max(avg_score, month) - arg_min(avg_score, month) ELSE 0 END AS total_shift
           FROM mg GROUP BY group_id),
    tr AS (SELECT s.*, CASE WHEN total_shift <= -1.0 THEN 'Sliding Down' WHEN total_shift >= 1.0 THEN 'Trending Up'
           ELSE 'Stable' END AS trend_status FROM s)"""
reg("monthly_group_trends", cohorts.monthly_group_trends, W(
    f"{_TRAJ} SELECT mg.*, tr.total_shift, tr.trend_status FROM mg JOIN tr ON mg.group_id = tr.group_id",
    "assessments", round_cols=("avg_score", "total_shift")))
reg("cohorts_sliding_down", partial(cohorts.trajectories_by_status, status="Sliding Down"), W(
    f"{_TRAJ} SELECT * FROM tr WHERE trend_status = 'Sliding Down'", "assessments",
    round_cols=("start_score", "end_score", "total_shift")))
reg("cohorts_trending_up", partial(cohorts.trajectories_by_status, status="Trending Up"), W(
    f"{_TRAJ} SELECT * FROM tr WHERE trend_status = 'Trending Up'", "assessments",
    round_cols=("start_score", "end_score", "total_shift")))

# ---------------------------------------------------------------- growth
_WIN = """w AS (SELECT min(enrollment_date) AS start_date,
           COALESCE((SELECT max(event_datetime) FROM learn_events), min(enrollment_date) + INTERVAL 180 DAY) AS end_date
           FROM roster WHERE enrollment_date IS NOT NULL),
    en AS (SELECT * FROM roster WHERE enrollment_date IS NOT NULL),
    vel AS (SELECT count(*) AS students,
           greatest(CAST(floor((epoch_us(end_date) - epoch_us(start_date)) / 86400000000) AS BIGINT), 30) AS days_elapsed
           FROM en CROSS JOIN w GROUP BY start_date, end_date),
    v AS (SELECT students, days_elapsed, days_elapsed / CAST(30.44 AS DOUBLE) AS months_elapsed,
          students / (days_elapsed / CAST(30.44 AS DOUBLE)) AS velocity FROM vel),
    grid AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('month', start_date) AS TIMESTAMP),
                 CAST(date_trunc('month', end_date) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM w),
    hist AS (SELECT month, (SELECT count(*) FROM en WHERE CAST(en.enrollment_date AS DATE) <= last_day(month))
             AS cumulative FROM grid),
    fm AS (SELECT CAST(date_trunc('month', end_date) AS DATE) AS m0 FROM w),
    fgrid AS (SELECT m0, CAST(unnest(generate_series(CAST(m0 AS TIMESTAMP), TIMESTAMP '2030-12-01 00:00:00',
              INTERVAL 1 MONTH)) AS DATE) AS month FROM fm),
    fc AS (SELECT fgrid.month, CAST(date_diff('month', m0, fgrid.month) AS INTEGER) AS step,
           CAST(COALESCE((SELECT cumulative FROM hist ORDER BY month DESC LIMIT 1), v.students) AS DOUBLE)
           + date_diff('month', m0, fgrid.month) * v.velocity AS cumulative FROM fgrid CROSS JOIN v)"""
_GV = ("roster", "learn_events")

reg("active_window", growth.active_window, W(f", {_WIN} SELECT * FROM w", *_GV))
reg("enrollment_velocity", growth.enrollment_velocity, W(
    f", {_WIN} SELECT * FROM v", *_GV, round_cols=("months_elapsed", "velocity")))
reg("enrollment_history", growth.enrollment_history, W(f", {_WIN} SELECT * FROM hist", *_GV))
reg("enrollment_forecast", growth.enrollment_forecast, W(
    f", {_WIN} SELECT * FROM fc", *_GV, round_cols=("cumulative",)))
reg("enrollment_projection", growth.enrollment_projection, W(
    f""", {_WIN}, p AS (SELECT CAST(trunc(cumulative) AS BIGINT) AS pt FROM fc ORDER BY step DESC LIMIT 1)
    SELECT students AS current_total, velocity, pt AS projected_total, CAST(pt AS DOUBLE) / students AS multiplier
    FROM v CROSS JOIN p""", *_GV, round_cols=("velocity", "multiplier")))
reg("course_forecast", growth.course_forecast, W(
    f""", {_WIN}, cs AS (SELECT course_name, count(*) AS students FROM en WHERE course_name IS NOT NULL
                         GROUP BY course_name),
    cv AS (SELECT cs.course_name, cs.students / (vel.days_elapsed / CAST(30.44 AS DOUBLE)) AS velocity
           FROM cs CROSS JOIN vel),
    ch AS (SELECT cs.course_name, grid.month, (SELECT count(*) FROM en WHERE en.course_name = cs.course_name
                  AND CAST(en.enrollment_date AS DATE) <= last_day(grid.month)) AS cumulative FROM cs CROSS JOIN grid),
    cl AS (SELECT course_name, arg_max(cumulative, month) AS last_cum FROM ch GROUP BY course_name)
    SELECT course_name, month, 'history' AS kind, CAST(cumulative AS DOUBLE) AS cumulative FROM ch
    UNION ALL
    SELECT cv.course_name, fgrid.month, 'forecast' AS kind,
           CAST(cl.last_cum AS DOUBLE) + date_diff('month', fgrid.m0, fgrid.month) * cv.velocity AS cumulative
    FROM cv JOIN cl ON cv.course_name = cl.course_name CROSS JOIN fgrid""", *_GV, round_cols=("cumulative",)))

# ---------------------------------------------------------------- integrity audit
from cohortlens.plans import integrity  # noqa: E402

_GHOST = """SELECT student_id, submitted_at FROM raw_submissions s WHERE NOT EXISTS (SELECT 1 FROM learn_events e
    WHERE e.event_type = 'login' AND e.student_id = s.student_id
    AND CAST(e.event_datetime AS DATE) IS NOT DISTINCT FROM CAST(s.submitted_at AS DATE))"""
_NEG = """SELECT event_id, student_id, event_type, duration_seconds, event_datetime FROM learn_events
    WHERE TRY_CAST(duration_seconds AS DOUBLE) < 0"""
_MULTI = """SELECT student_id, date_trunc('minute', event_datetime) AS minute, count(DISTINCT device) AS device_count
    FROM learn_events WHERE student_id IS NOT NULL AND event_datetime IS NOT NULL GROUP BY 1, 2
    HAVING count(DISTINCT device) > 1"""

reg("audit_input_status", integrity.input_status, W(
    """SELECT 'students' AS source_table, (SELECT count(*) FROM roster) > 0 AS has_rows
    UNION ALL SELECT 'concepts', (SELECT count(*) FROM concepts) > 0
    UNION ALL SELECT 'events', (SELECT count(*) FROM learn_events) > 0""", "roster", "concepts", "learn_events"))
reg("audit_dummy_ids", integrity.dummy_ids, W(
    """SELECT record_id, student_id, concept_name, timestamp FROM concepts
    WHERE NOT COALESCE(regexp_matches(CAST(record_id AS VARCHAR), '^CP[0-9]+$'), false)""", "concepts"))
reg("audit_corrupted_text", integrity.corrupted_text, W(
    """SELECT record_id, student_id, concept_name FROM concepts
    WHERE COALESCE(regexp_matches(concept_name, '[ÃÂ¤â‚¬@?]'), false)""", "concepts"))
reg("audit_clones", integrity.clones, W(
    """SELECT student_id, concept_name, timestamp, count(*) AS copies, count(*) - 1 AS surplus FROM concepts
    WHERE student_id IS NOT NULL AND concept_name IS NOT NULL AND timestamp IS NOT NULL
    GROUP BY 1, 2, 3 HAVING count(*) > 1""", "concepts"))
reg("audit_negative_durations", integrity.negative_durations, W(_NEG, "learn_events", round_cols=("duration_seconds",)))
reg("audit_multi_device", integrity.multi_device, W(_MULTI, "learn_events"))
reg("audit_ghost_submissions", partial(integrity.ghost_submissions, event_types=("login",)), W(
    _GHOST, "raw_submissions", "learn_events"))
reg("audit_exploit_summary", partial(integrity.exploit_summary, event_types=("login",)), W(
    f""", c AS (SELECT 'Negative Watch Time' AS exploit, (SELECT count(*) FROM ({_NEG}) a) AS flags
         UNION ALL SELECT 'Simultaneous Web & Mobile', (SELECT count(*) FROM ({_MULTI}) b)
         UNION ALL SELECT 'Ghost Submissions', (SELECT count(*) FROM ({_GHOST}) g))
    SELECT exploit, flags, CASE WHEN flags = 0 THEN 'clean' ELSE 'alert' END AS status FROM c""",
    "raw_submissions", "learn_events"))
_GHOST_ANY = _GHOST.replace("e.event_type = 'login' AND ", "")
reg("audit_ghost_submissions_any", integrity.ghost_submissions, W(_GHOST_ANY, "raw_submissions", "learn_events"))
reg("audit_sixty_boundary", integrity.sixty_boundary, W(
    """SELECT count_if(lower(mastery_status) = 'passed') AS passed, count_if(lower(mastery_status) = 'failed') AS failed
    FROM concepts WHERE score_pct = 60""", "concepts"))
reg("audit_phantom_quizzes", integrity.phantom_quizzes, W(
    """SELECT student_id, type, date, score FROM raw_quiz_grades g WHERE lower(type) = 'quiz' AND NOT EXISTS (
      SELECT 1 FROM learn_events e WHERE e.event_type = 'quiz_attempt' AND e.student_id = g.student_id
      AND CAST(e.event_datetime AS DATE) IS NOT DISTINCT FROM CAST(g.date AS DATE))""",
    "raw_quiz_grades", "learn_events", round_cols=("score",)))

# ---------------------------------------------------------------- data-quality rules
from cohortlens.plans import quality  # noqa: E402

# Findings SQL per rule (FIXTURES.md §4), over the crosswalk CTEs.
_RULE_SQL: dict[int, tuple[str, tuple[str, ...]]] = {
    1: ("SELECT event_id FROM learn_events WHERE NOT (student_id IN (SELECT c_custkey FROM customer "
        "WHERE c_custkey % 50 <> 0))", ("learn_events",)),
    2: ("SELECT * FROM raw_submissions s WHERE NOT EXISTS (SELECT 1 FROM raw_quiz_grades g WHERE "
        "g.student_id = s.student_id AND CAST(g.date AS DATE) = CAST(s.submitted_at AS DATE))",
        ("raw_submissions", "raw_quiz_grades")),
    3: ("SELECT * FROM raw_quiz_grades g WHERE NOT EXISTS (SELECT 1 FROM learn_events e WHERE e.event_type IN "
        "('login','video_watch','quiz_attempt') AND e.student_id = g.student_id AND CAST(e.event_datetime AS DATE) "
        "= CAST(g.date AS DATE))", ("raw_quiz_grades", "learn_events")),
    4: ("SELECT * FROM raw_submissions s WHERE NOT EXISTS (SELECT 1 FROM learn_events e WHERE e.event_type = 'login' "
        "AND e.student_id = s.student_id AND CAST(e.event_datetime AS DATE) = CAST(s.submitted_at AS DATE))",
        ("raw_submissions", "learn_events")),
    5: ("SELECT a.assessment_id FROM assessments a WHERE NOT EXISTS (SELECT 1 FROM roster r WHERE r.student_id = "
        "a.student_id AND r.course_id = CASE WHEN a.assessment_id % 40 = 0 THEN 'HOUSEHOLD' ELSE a.course_id END)",
        ("roster", "assessments")),
    6: ("SELECT l_orderkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey "
        "AND p.p_type = CASE WHEN l.l_orderkey % 60 = 0 THEN 'SMALL' ELSE p.p_type END)", ()),
    7: ("SELECT assessment_id FROM assessments WHERE CASE WHEN assessment_id % 70 = 0 THEN 'ZZ' ELSE "
        "substr(course_id, 1, 2) END <> substr(course_id, 1, 2)", ("assessments",)),
    8: ("SELECT record_id FROM attendance WHERE date_trunc('week', session_datetime) <> "
        "date_trunc('week', session_datetime + INTERVAL 2 DAY)", ("attendance",)),
    9: ("SELECT record_id FROM attendance WHERE session_datetime > TIMESTAMP '2001-01-01 00:00:00'", ("attendance",)),
    10: ("SELECT student_id, session_datetime FROM attendance GROUP BY student_id, session_datetime "
         "HAVING count(*) > 1", ("attendance",)),
    11: ("SELECT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
         "GROUP BY o_custkey, l_partkey HAVING count(*) > 1", ()),
    12: ("SELECT a.assessment_id FROM assessments a WHERE EXISTS (SELECT 1 FROM attendance t WHERE t.status = "
         "'Absent' AND t.student_id = a.student_id AND CAST(t.session_datetime AS DATE) = CAST(a.date AS DATE))",
         ("assessments", "attendance")),
    13: ("SELECT 1 AS redundant FROM roster HAVING sum(CASE WHEN course_id = course_name THEN 0 ELSE 1 END) = 0",
         ("roster",)),
    14: ("SELECT 1 AS static_col FROM (SELECT course_name, count(DISTINCT course_id) AS n FROM roster "
         "GROUP BY course_name) x HAVING max(n) <= 1", ("roster",)),
    15: ("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1", ()),
    16: ("SELECT text FROM documents GROUP BY text, lang, source, n_chars HAVING count(*) > 1", ()),
    17: ("SELECT student_id FROM roster WHERE group_id = 'BUILDING-NATION_9'", ("roster",)),
    18: ("SELECT record_id FROM concepts WHERE NOT regexp_matches(record_id, '^CP[0-9]+$')", ("concepts",)),
    19: ("SELECT record_id FROM attendance WHERE session_datetime < TIMESTAMP '1998-01-01 00:00:00'", ("attendance",)),
    20: ("SELECT record_id FROM attendance WHERE CASE WHEN record_id % 3 = 0 THEN upper(concat(status, ' ')) "
         "ELSE status END <> status", ("attendance",)),
    21: ("SELECT student_id FROM roster WHERE CASE WHEN student_id % 45 = 0 THEN -age ELSE age END < 0", ("roster",)),
    22: ("SELECT student_id FROM roster WHERE CASE WHEN student_id % 60 = 0 THEN age + 150 ELSE age END > 100",
         ("roster",)),
    23: ("SELECT student_id FROM roster WHERE email IS NULL OR trim(full_name) = ''", ("roster",)),
    24: ("SELECT student_id FROM roster WHERE NOT regexp_matches(CASE WHEN student_id % 33 = 0 THEN 'missing@' "
         "ELSE email END, '^[^@ ]+@[^@ ]+[.][^@ ]+$')", ("roster",)),
    25: ("SELECT student_id FROM roster WHERE CASE WHEN student_id % 70 = 0 THEN 1 - student_id % 2 ELSE "
         "student_id % 2 END <> student_id % 2", ("roster",)),
    26: ("SELECT assessment_id FROM assessments WHERE submitted_at IS NULL", ("assessments",)),
    27: ("SELECT assessment_id FROM assessments WHERE submitted_at IS NOT NULL AND CASE WHEN assessment_id % 30 = 0 "
         "THEN submitted_at <= deadline ELSE submitted_at > deadline END <> (submitted_at > deadline)",
         ("assessments",)),
    28: ("SELECT event_id FROM learn_events WHERE duration_seconds < 0", ("learn_events",)),
    29: ("SELECT event_id FROM learn_events WHERE duration_seconds * 10 > 97200", ("learn_events",)),
    30: ("SELECT assessment_id FROM assessments WHERE CASE WHEN assessment_id % 25 = 0 THEN 10 ELSE 100 END <> 100",
         ("assessments",)),
    31: ("SELECT assessment_id FROM (SELECT assessment_id, CASE WHEN assessment_id % 90 = 0 THEN NULL "
         "WHEN assessment_id % 91 = 0 THEN -5 WHEN assessment_id % 92 = 0 THEN 140 ELSE score END AS score "
         "FROM assessments) t WHERE score IS NULL OR score < 0 OR score > 100", ("assessments",)),
    32: ("SELECT event_id FROM learn_events WHERE event_datetime < TIMESTAMP '2024-01-03 00:00:00' OR "
         "event_datetime >= TIMESTAMP '2024-01-28 00:00:00'", ("learn_events",)),
    33: ("SELECT record_id FROM concepts WHERE student_id % 97 = 0 OR regexp_matches(concept_name, '[ÃÂ¤â‚¬@?]')",
         ("concepts",)),
}
_RULE_ROUND = {3: ("score",)}


def _rule_views(views: tuple[str, ...]) -> tuple[str, ...]:
    order = ("roster", "assessments", "attendance", "concepts", "learn_events", "raw_submissions", "raw_quiz_grades")
    return tuple(v for v in order if v in views)


for _r in quality.RULES:
    _sql, _views = _RULE_SQL[_r.rule_id]
    reg(f"dq_rule_{_r.rule_id:02d}", _r.findings,
        W(_sql, *_rule_views(_views), round_cols=_RULE_ROUND.get(_r.rule_id, ())))

_all_views = _rule_views(tuple(v for _s, vs in _RULE_SQL.values() for v in vs))
reg("dq_report", quality.dq_report, W(
    " UNION ALL ".join(
        f"SELECT {r.rule_id} AS rule_id, '{r.name}' AS rule, '{r.table}' AS source_table, "
        f"'{r.disposition}' AS disposition, (SELECT count(*) FROM ({_RULE_SQL[r.rule_id][0]}) x) AS findings"
        for r in quality.RULES), *_all_views))

# ---------------------------------------------------------------- cleaning jobs
from cohortlens.plans import cleaning  # noqa: E402

reg("clean_roster", cleaning.clean_roster, W(
    """, rr AS (SELECT student_id, full_name,
           CASE WHEN student_id % 33 = 0 THEN 'missing@' ELSE email END AS email,
           CASE WHEN student_id % 45 = 0 THEN -age WHEN student_id % 60 = 0 THEN age + 150 ELSE age END AS age,
           course_name, group_id, instructor, stated_num_students,
           CASE WHEN student_id % 70 = 0 THEN 1 - student_id % 2 ELSE student_id % 2 END AS gender
         FROM roster WHERE group_id IS NULL OR group_id <> 'BUILDING-NATION_9'),
    fx AS (SELECT student_id, COALESCE(NULLIF(trim(full_name), ''), 'Unknown') AS full_name,
           CASE WHEN regexp_matches(NULLIF(trim(email), ''), '^[^@ ]+@[^@ ]+[.][^@ ]+$') THEN NULLIF(trim(email), '')
           END AS email, CASE WHEN abs(age) > 100 THEN NULL ELSE abs(age) END AS age,
           course_name, group_id, instructor, stated_num_students, gender FROM rr)
    SELECT fx.student_id, fx.full_name, fx.email, fx.age, fx.course_name, fx.group_id, fx.instructor,
           fx.stated_num_students, COALESCE(lk.true_gender, fx.gender) AS gender
    FROM fx LEFT JOIN (SELECT c_name AS full_name, min(c_custkey % 2) AS true_gender FROM customer
      GROUP BY c_name HAVING count(DISTINCT c_custkey % 2) = 1) lk
      ON lk.full_name = fx.full_name AND lk.full_name <> 'Unknown'""", "roster"))

reg("clean_assessments", cleaning.clean_assessments, W(
    """, ra AS (SELECT assessment_id, student_id,
           CASE WHEN assessment_id % 40 = 0 THEN 'HOUSEHOLD' ELSE course_id END AS course_id,
           CASE WHEN assessment_id % 70 = 0 THEN 'ZZ' ELSE substr(course_id, 1, 2) END AS id_prefix, group_id, type,
           CASE WHEN assessment_id % 90 = 0 THEN NULL WHEN assessment_id % 91 = 0 THEN -5
                WHEN assessment_id % 92 = 0 THEN 140 WHEN assessment_id % 25 = 0 THEN score / 10 ELSE score END AS score,
           CASE WHEN assessment_id % 25 = 0 THEN 10 ELSE 100 END AS max_score, date, deadline, submitted_at
         FROM assessments)
    SELECT assessment_id, student_id, course_id, group_id, type,
           CASE WHEN score IS NULL THEN NULL ELSE least(greatest(CASE WHEN max_score > 0
                THEN score * 100 / max_score ELSE score END, 0), 100) END AS score,
           CAST(100 AS DOUBLE) AS max_score, date, deadline, submitted_at, submitted_at > deadline AS is_late
    FROM ra WHERE submitted_at IS NOT NULL AND id_prefix = substr(course_id, 1, 2)
      AND EXISTS (SELECT 1 FROM roster r WHERE r.student_id = ra.student_id AND r.course_id = ra.course_id)""",
    "roster", "assessments", round_cols=("score",)))

reg("clean_attendance", cleaning.clean_attendance, W(
    """, a0 AS (SELECT record_id, student_id, CASE WHEN record_id % 3 = 0 THEN upper(concat(status, ' '))
           ELSE status END AS raw_status, session_datetime FROM attendance),
    a1 AS (SELECT record_id, student_id, COALESCE(CASE lower(trim(raw_status)) WHEN 'attended' THEN 'Attended'
           WHEN 'absent' THEN 'Absent' END, raw_status) AS status, session_datetime AS planted FROM a0),
    a2 AS (SELECT record_id, student_id, status, CASE dayofweek(planted) WHEN 0 THEN planted - INTERVAL 2 DAY
                WHEN 6 THEN planted - INTERVAL 1 DAY ELSE planted END AS session_datetime
           FROM (SELECT *, row_number() OVER (PARTITION BY student_id, date_trunc('second', planted)
                 ORDER BY record_id, status) AS rn FROM a1) x WHERE rn = 1),
    gd AS (SELECT DISTINCT student_id, CAST(date AS DATE) AS d FROM assessments)
    SELECT record_id, student_id, status, session_datetime,
           COALESCE(session_datetime > TIMESTAMP '2001-01-01 00:00:00', false) AS after_course_end,
           COALESCE(status = 'Absent' AND EXISTS (SELECT 1 FROM gd WHERE gd.student_id = a2.student_id
                    AND gd.d = CAST(a2.session_datetime AS DATE)), false) AS graded_while_absent
    FROM a2""", "assessments", "attendance"))

reg("clean_events", cleaning.clean_events, W(
    """SELECT event_id, student_id, event_type,
           CASE WHEN duration_seconds IS NULL THEN NULL ELSE least(abs(duration_seconds * 10), 97200) END
           AS duration_seconds, event_datetime, device
    FROM learn_events WHERE event_datetime >= TIMESTAMP '2024-01-03 00:00:00'
      AND event_datetime < TIMESTAMP '2024-01-28 00:00:00'
      AND student_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)""",
    "learn_events", round_cols=("duration_seconds",)))

reg("clean_concepts", cleaning.clean_concepts, W(
    """SELECT * FROM concepts WHERE COALESCE(regexp_matches(record_id, '^CP[0-9]+$'), false)
      AND COALESCE(student_id % 97 <> 0, true) AND NOT COALESCE(regexp_matches(concept_name, '[ÃÂ¤â‚¬@?]'), false)""", "concepts", round_cols=("score_pct",)))

reg("clean_documents", cleaning.clean_documents, W(
    """SELECT min(doc_id) AS doc_id, text, lang, source, n_chars FROM documents
    GROUP BY text, lang, source, n_chars"""))

# -- submissions, grades and lines; rules 8 and 9 per group and course; rule 20 per batch
_NO_GRADE = ("NOT EXISTS (SELECT 1 FROM raw_quiz_grades g WHERE g.student_id = s.student_id "
             "AND CAST(g.date AS DATE) = CAST(s.submitted_at AS DATE))")
_NO_LOGIN = ("NOT EXISTS (SELECT 1 FROM learn_events e WHERE e.event_type = 'login' AND e.student_id = s.student_id "
             "AND CAST(e.event_datetime AS DATE) = CAST(s.submitted_at AS DATE))")
_NO_ACTIVITY = ("NOT EXISTS (SELECT 1 FROM learn_events e WHERE e.event_type IN ('login', 'video_watch', 'quiz_attempt') "
                "AND e.student_id = g.student_id AND CAST(e.event_datetime AS DATE) = CAST(g.date AS DATE))")
reg("clean_submissions", cleaning.clean_submissions, W(
    f"SELECT student_id, submitted_at, {_NO_GRADE} AS no_grade, {_NO_LOGIN} AS no_login FROM raw_submissions s",
    "learn_events", "raw_submissions", "raw_quiz_grades"))
reg("clean_grades", cleaning.clean_grades, W(
    f"SELECT student_id, type, date, CASE WHEN score IS NOT NULL THEN least(greatest(score, 0), 100) END AS score, "
    f"{_NO_ACTIVITY} AS no_activity FROM raw_quiz_grades g", "learn_events", "raw_quiz_grades", round_cols=("score",)))
_LINES = """l0 AS (SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS student_id, l_quantity, l_shipdate,
        CASE WHEN l_orderkey % 60 = 0 THEN 'SMALL' ELSE p_type END AS logged_course, p_type
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey),
    l1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l0 WHERE l_orderkey % 85 = 0),
    l2 AS (SELECT * FROM l1 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
             ORDER BY l_partkey, student_id, logged_course, l_quantity, l_shipdate) = 1),
    l3 AS (SELECT * EXCLUDE (p_type) FROM l2 WHERE logged_course = p_type)"""
reg("clean_lines", cleaning.clean_lines, W(
    f"""WITH {_LINES} SELECT * FROM l3 QUALIFY row_number() OVER (PARTITION BY student_id, l_partkey
        ORDER BY l_orderkey, l_linenumber, logged_course, l_quantity, l_shipdate) = 1""", round_cols=("l_quantity",)))
reg("rejected_lines", cleaning.rejected_lines, W(
    f"""WITH {_LINES} SELECT * EXCLUDE (p_type), 6 AS dropped_by FROM l2
        WHERE NOT COALESCE(logged_course = p_type, false)""", round_cols=("l_quantity",)))

# Effective-dated schedules: the period in force, and the nearest earlier day of its weekdays.
_PLANS = """gk AS (SELECT DISTINCT group_id, CAST(stated_num_students - 5 AS INT) AS k FROM roster WHERE group_id IS NOT NULL),
    pl AS (SELECT group_id, TIMESTAMP '1992-06-01' AS valid_from, 62 - (1 << (k % 5 + 1)) AS days FROM gk
      UNION ALL SELECT group_id, TIMESTAMP '1995-01-01' + to_days(k * 20), 124 - (1 << (k % 5 + 2)) FROM gk),
    pr AS (SELECT *, lead(valid_from) OVER (PARTITION BY group_id ORDER BY valid_from) AS valid_to FROM pl),
    ce AS (SELECT DISTINCT course_id, TIMESTAMP '1998-12-01' - to_days(CAST(length(course_id) * 30 AS INT)) AS course_end FROM roster
      WHERE course_id IS NOT NULL)"""
_MOVED = """s.session_datetime - to_days(CAST(list_filter([0, 1, 2, 3, 4, 5, 6], lambda i:
      ((pr.days >> CAST((dayofweek(s.session_datetime) - i + 7) % 7 AS INT)) & 1) = 1)[1] AS INT))"""
_IN_FORCE = """LEFT JOIN roster r ON r.student_id = s.student_id
    LEFT JOIN pr ON pr.group_id = r.group_id AND s.session_datetime >= pr.valid_from
      AND (pr.valid_to IS NULL OR s.session_datetime < pr.valid_to) LEFT JOIN ce ON ce.course_id = r.course_id"""
reg("dq_rule_08_by_group", cleaning.off_group_schedule, W(
    f""", {_PLANS} SELECT s.record_id, s.student_id, s.session_datetime, {_MOVED} AS scheduled FROM attendance s {_IN_FORCE}
    WHERE s.session_datetime <> {_MOVED}""", "roster", "attendance"))
reg("dq_rule_09_by_course", cleaning.after_own_course_end, W(
    f""", {_PLANS} SELECT s.record_id, s.student_id, s.session_datetime, ce.course_end FROM attendance s
    JOIN roster r ON r.student_id = s.student_id JOIN ce ON ce.course_id = r.course_id
    WHERE s.session_datetime > ce.course_end""", "roster", "attendance"))
_ONE_SECOND = """a1 AS (SELECT record_id, student_id, COALESCE(CASE lower(trim(raw_status)) WHEN 'attended' THEN 'Attended'
           WHEN 'absent' THEN 'Absent' END, raw_status) AS status, session_datetime, raw_status FROM
         (SELECT *, CASE WHEN record_id % 3 = 0 THEN upper(concat(status, ' ')) ELSE status END AS raw_status FROM attendance)),
    a2 AS (SELECT * FROM a1 QUALIFY row_number() OVER (PARTITION BY student_id, date_trunc('second', session_datetime)
           ORDER BY record_id, status, session_datetime) = 1),
    gd AS (SELECT DISTINCT student_id, CAST(date AS DATE) AS d FROM assessments)"""
_BY_GROUP = f"""bg AS (SELECT s.record_id, s.student_id, s.status, s.session_datetime AS planted, ce.course_end,
      COALESCE({_MOVED}, s.session_datetime) AS session_datetime FROM a2 s {_IN_FORCE})"""
_WHILE_ABSENT = """COALESCE(status = 'Absent' AND EXISTS (SELECT 1 FROM gd WHERE gd.student_id = x.student_id
    AND gd.d = CAST(x.session_datetime AS DATE)), false)"""
reg("clean_attendance_by_group", cleaning.clean_attendance_by_group, W(
    f""", {_PLANS}, {_ONE_SECOND}, {_BY_GROUP}
    SELECT record_id, student_id, status, session_datetime, COALESCE(session_datetime > course_end, false) AS after_course_end,
           {_WHILE_ABSENT} AS graded_while_absent FROM bg x""", "roster", "assessments", "attendance"))

_TEXTS = """tx AS (SELECT record_id, strftime(session_datetime, '%Y-%m') AS batch, 
      CASE (year(session_datetime) * 12 + month(session_datetime)) % 3 WHEN 0 THEN strftime(session_datetime, '%Y-%m-%d %H:%M:%S')
      WHEN 1 THEN strftime(session_datetime, '%d/%m/%Y %H:%M:%S') ELSE strftime(session_datetime, '%m/%d/%Y %H:%M:%S') END
      AS session_text FROM attendance),
    tp AS (SELECT record_id, batch, session_text, try_strptime(session_text, '%Y-%m-%d %H:%M:%S') AS t0,
      try_strptime(session_text, '%d/%m/%Y %H:%M:%S') AS t1, try_strptime(session_text, '%m/%d/%Y %H:%M:%S') AS t2 FROM tx),
    tb AS (SELECT batch, count(session_text) AS n_values, count(t0) AS c0, count(t1) AS c1, count(t2) AS c2,
      greatest(count(t0), count(t1), count(t2)) AS n_parsed FROM tp GROUP BY batch),
    tf AS (SELECT batch, n_values, n_parsed, CASE WHEN n_parsed = 0 THEN NULL WHEN c0 = n_parsed THEN 'iso'
        WHEN c1 = n_parsed THEN 'day first' ELSE 'month first' END AS time_format,
      n_parsed > 0 AND (c0 = n_parsed)::INT + (c1 = n_parsed)::INT + (c2 = n_parsed)::INT > 1 AS ambiguous FROM tb)"""
reg("session_time_formats", cleaning.session_time_formats, W(
    f", {_TEXTS} SELECT batch, n_values, time_format, n_parsed, ambiguous FROM tf", "attendance"))
reg("clean_session_times", cleaning.clean_session_times, W(
    f""", {_TEXTS} SELECT record_id, tp.batch, time_format, ambiguous,
      CASE time_format WHEN 'iso' THEN t0 WHEN 'day first' THEN t1 WHEN 'month first' THEN t2 END AS session_datetime
    FROM tp JOIN tf ON tp.batch IS NOT DISTINCT FROM tf.batch""", "attendance"))
reg("clean_gender_labels", cleaning.clean_gender_labels, W(
    """SELECT student_id, CASE WHEN student_id % 41 = 0 THEN NULL WHEN student_id % 2 = 1 THEN 'male' ELSE 'female' END AS gender
    FROM roster""", "roster"))

# What each rule meets in its place of the order: rows an earlier rule dropped do not count.
_NAMES = """lk AS (SELECT c_name AS full_name, min(c_custkey % 2) AS true_gender FROM customer
      GROUP BY c_name HAVING count(DISTINCT c_custkey % 2) = 1)"""
_ORDERED = f"""{_PLANS}, {_ONE_SECOND}, {_BY_GROUP}, {_LINES}, {_NAMES},
    r0 AS (SELECT *, CASE WHEN student_id % 33 = 0 THEN 'missing@' ELSE email END AS mail, CASE WHEN student_id % 45 = 0 THEN -age
        WHEN student_id % 60 = 0 THEN age + 150 ELSE age END AS raw_age, CASE WHEN student_id % 70 = 0 THEN 1 - student_id % 2
        ELSE student_id % 2 END AS gender FROM roster),
    r1 AS (SELECT * FROM r0 WHERE NOT COALESCE(group_id = 'BUILDING-NATION_9', false)),
    s0 AS (SELECT assessment_id, student_id, submitted_at, deadline,
        CASE WHEN assessment_id % 40 = 0 THEN 'HOUSEHOLD' ELSE course_id END AS logged,
        CASE WHEN assessment_id % 70 = 0 THEN 'ZZ' ELSE substr(course_id, 1, 2) END AS id_prefix,
        CASE WHEN assessment_id % 90 = 0 THEN NULL WHEN assessment_id % 91 = 0 THEN -5 WHEN assessment_id % 92 = 0 THEN 140
             WHEN assessment_id % 25 = 0 THEN score / 10 ELSE score END
          * CASE WHEN assessment_id % 25 = 0 THEN 10 ELSE 1 END AS scaled FROM assessments),
    s1 AS (SELECT * FROM s0 WHERE submitted_at IS NOT NULL),
    s2 AS (SELECT * FROM s1 WHERE COALESCE(id_prefix = substr(logged, 1, 2), false)),
    a3 AS (SELECT *, CASE dayofweek(session_datetime) WHEN 0 THEN session_datetime - INTERVAL 2 DAY
        WHEN 6 THEN session_datetime - INTERVAL 1 DAY ELSE session_datetime END AS moved FROM a2),
    e1 AS (SELECT * FROM learn_events WHERE event_datetime >= TIMESTAMP '2024-01-03 00:00:00'
        AND event_datetime < TIMESTAMP '2024-01-28 00:00:00')"""
_SEEN: list[tuple[str, int, str, str]] = [
    ("roster", 17, "drop", "FROM r0 WHERE group_id = 'BUILDING-NATION_9'"),
    ("roster", 21, "fix", "FROM r1 WHERE raw_age < 0"),
    ("roster", 22, "fix", "FROM r1 WHERE abs(raw_age) > 100"),
    ("roster", 23, "fix", "FROM r1 WHERE NULLIF(trim(full_name), '') IS NULL OR NULLIF(trim(mail), '') IS NULL"),
    ("roster", 24, "fix", "FROM r1 WHERE NOT regexp_matches(NULLIF(trim(mail), ''), '^[^@ ]+@[^@ ]+[.][^@ ]+$')"),
    ("roster", 25, "fix", "FROM r1 JOIN lk ON lk.full_name = trim(r1.full_name) WHERE gender <> true_gender"),
    ("assessments", 26, "drop", "FROM s0 WHERE submitted_at IS NULL"),
    ("assessments", 27, "fix", "FROM s1 WHERE assessment_id % 30 = 0"),
    ("assessments", 30, "fix", "FROM s1 WHERE assessment_id % 25 = 0"),
    ("assessments", 31, "fix", "FROM s1 WHERE scaled IS NULL OR scaled < 0 OR scaled > 100"),
    ("assessments", 7, "drop", "FROM s1 WHERE NOT COALESCE(id_prefix = substr(logged, 1, 2), false)"),
    ("assessments", 5, "drop", "FROM s2 WHERE NOT EXISTS (SELECT 1 FROM roster r WHERE r.student_id = s2.student_id AND r.course_id = s2.logged)"),
    *[(name, rule, does, sql) for name in ("attendance", "attendance_by_group") for rule, does, sql in (
        (19, "fix", "FROM attendance WHERE session_datetime < TIMESTAMP '1998-01-01'"),
        (20, "fix", "FROM a1 WHERE raw_status <> status"),
        (10, "dedupe", "FROM (SELECT * FROM a1 EXCEPT ALL SELECT * FROM a2)"))],
    ("attendance", 8, "fix", "FROM a3 WHERE moved <> session_datetime"),
    ("attendance", 9, "flag", "FROM a3 WHERE moved > TIMESTAMP '2001-01-01 00:00:00'"),
    ("attendance", 12, "flag", f"FROM (SELECT student_id, status, moved AS session_datetime FROM a3) x WHERE {_WHILE_ABSENT}"),
    ("attendance_by_group", 8, "fix", "FROM bg WHERE planted <> session_datetime"),
    ("attendance_by_group", 9, "flag", "FROM bg WHERE session_datetime > course_end"),
    ("attendance_by_group", 12, "flag", f"FROM bg x WHERE {_WHILE_ABSENT}"),
    ("events", 32, "drop", "FROM (SELECT * FROM learn_events EXCEPT ALL SELECT * FROM e1)"),
    ("events", 28, "fix", "FROM e1 WHERE duration_seconds < 0"),
    ("events", 29, "fix", "FROM e1 WHERE abs(duration_seconds * 10) > 97200"),
    ("events", 1, "drop", "FROM e1 WHERE NOT COALESCE(student_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0), false)"),
    ("concepts", 18, "drop", "FROM concepts WHERE NOT COALESCE(regexp_matches(record_id, '^CP[0-9]+$'), false)"),
    ("concepts", 33, "drop", "FROM concepts WHERE COALESCE(regexp_matches(record_id, '^CP[0-9]+$'), false) AND (student_id % 97 = 0 "
     "OR regexp_matches(concept_name, '[ÃÂ¤â‚¬@?]'))"),
    ("submissions", 2, "flag", f"FROM raw_submissions s WHERE {_NO_GRADE}"),
    ("submissions", 4, "flag", f"FROM raw_submissions s WHERE {_NO_LOGIN}"),
    ("grades", 31, "fix", "FROM raw_quiz_grades WHERE score IS NULL OR score < 0 OR score > 100"),
    ("grades", 3, "flag", f"FROM raw_quiz_grades g WHERE {_NO_ACTIVITY}"),
    ("lines", 15, "dedupe", "FROM (SELECT * FROM l1 EXCEPT ALL SELECT * FROM l2)"),
    ("lines", 6, "drop", "FROM l2 WHERE NOT COALESCE(logged_course = p_type, false)"),
    ("lines", 11, "dedupe", "FROM (SELECT row_number() OVER (PARTITION BY student_id, l_partkey) AS i FROM l3) WHERE i > 1"),
]
reg("cleaning_findings", cleaning.cleaning_findings, W(
    f", {_ORDERED} " + " UNION ALL ".join(
        f"SELECT '{name}' AS source_table, {rule} AS rule_id, '{does}' AS disposition, (SELECT count(*) {sql}) AS findings"
        for name, rule, does, sql in _SEEN), "roster", "assessments", "attendance", "concepts", "learn_events", "raw_submissions",
    "raw_quiz_grades"))

reg("export_load_report", cleaning.export_load_report, W(" UNION ALL ".join(
    f"SELECT '{v}' AS source_table, (SELECT count(*) FROM {v} WHERE student_id % 500 <> 0) AS accepted, "
    f"(SELECT count(*) FROM {v} WHERE student_id % 500 = 0) AS rejected"
    for v in ("roster", "assessments", "attendance", "concepts", "learn_events", "raw_submissions", "raw_quiz_grades")),
    "roster", "assessments", "attendance", "concepts", "learn_events", "raw_submissions", "raw_quiz_grades"))

# -- rules 13, 14 and 19 by inspection: every pair of columns of one type is compared here
_RAW_ROSTER = """rx AS (SELECT student_id, full_name, CASE WHEN student_id % 33 = 0 THEN 'missing@' ELSE email END AS email,
      CASE WHEN student_id % 45 = 0 THEN -age WHEN student_id % 60 = 0 THEN age + 150 ELSE age END AS age, course_id, course_name,
      group_id, instructor, stated_num_students, CASE WHEN student_id % 70 = 0 THEN 1 - student_id % 2 ELSE student_id % 2 END
      AS gender, true AS is_active FROM roster)"""
_TEXT, _LONG = ("full_name", "email", "course_id", "course_name", "group_id", "instructor"), ("student_id", "age", "gender")
reg("found_redundant_columns", cleaning.found_redundant_columns, W(
    f", {_RAW_ROSTER}, eq AS (" + " UNION ALL ".join(
        f"SELECT '{b}' AS dup, '{a}' AS duplicate_of, {i} AS pos, bool_and({a} IS NOT DISTINCT FROM {b}) AS same FROM rx"
        for kind in (_TEXT, _LONG) for i, a in enumerate(kind) for b in kind[i + 1:])
    + ") SELECT dup AS column, duplicate_of FROM eq WHERE same QUALIFY row_number() OVER (PARTITION BY dup ORDER BY pos) = 1", "roster"))
reg("found_constant_columns", cleaning.found_constant_columns, W(
    f", {_RAW_ROSTER} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column FROM rx HAVING count(*) > 1 AND count(DISTINCT {c}) <= 1"
        for c in (*_TEXT, *_LONG, "stated_num_students", "is_active")), "roster"))
reg("found_renamed_columns", cleaning.found_renamed_columns, W(
    "SELECT 'datetime' AS old_name, 'session_datetime' AS new_name FROM attendance HAVING count(*) > 0", "attendance"))


# ---------------------------------------------------------------- scoped variants
from cohortlens.operators.scope import Scope  # noqa: E402

_BUILDING = Scope(course="BUILDING")
_SPB = _SP_T.replace("{scope}", "course_name = 'BUILDING'")
reg("student_segments_building", partial(segments.student_segments, scope=_BUILDING), W(
    f", {_SPB} SELECT * FROM seg", *_SPV, round_cols=_SP_ROUND))
reg("risk_scores_building", partial(segments.risk_scores, scope=_BUILDING), W(
    f", {_SPB} SELECT * FROM rs", *_SPV, round_cols=_SP_ROUND + ("risk_score",)))
reg("concept_failure_rates_building", partial(concepts.concept_failure_rates, scope=_BUILDING), W(
    f", {_CL.replace('FROM concepts c LEFT JOIN roster r ON c.student_id = r.student_id', 'FROM concepts c LEFT JOIN roster r ON c.student_id = r.student_id WHERE r.course_name = ' + chr(39) + 'BUILDING' + chr(39))} "
    "SELECT * FROM cr", *_CV, round_cols=("fail_rate",)))
reg("students_per_group_building", partial(grades.students_per_group, scope=_BUILDING), W(
    "SELECT group_id, count(*) AS students FROM roster WHERE group_id IS NOT NULL AND course_name = 'BUILDING' "
    "GROUP BY group_id", "roster"))

_GROUP = Scope(group="BUILDING-NATION_3")
_EPC = _EP.replace("ep AS (", "ep_all AS (") + ", ep AS (SELECT * FROM ep_all WHERE {where})"
reg("engagement_profile_building", partial(engagement.engagement_profile, scope=_BUILDING), W(
    f", {_EPC.replace('{where}', 'course_name = ' + chr(39) + 'BUILDING' + chr(39))} SELECT * FROM ep", *_EV,
    round_cols=("avg_grade", "attendance_rate", "video_hours")))
reg("group_attendance_one_group", partial(engagement.group_attendance, scope=_GROUP), W(
    f""", {_EPC.replace('{where}', 'group_id = ' + chr(39) + 'BUILDING-NATION_3' + chr(39))}, {_PLATFORM},
    g AS (SELECT group_id || ' (' || course_name || ')' AS group_label, avg(attendance_rate) AS attendance_rate
          FROM ep WHERE group_id || ' (' || course_name || ')' IS NOT NULL GROUP BY 1)
    SELECT g.*, pa.platform_avg, COALESCE(g.attendance_rate >= pa.platform_avg, false) AS at_or_above_platform
    FROM g CROSS JOIN pa""", *_EV, round_cols=("attendance_rate", "platform_avg")))
reg("phantom_seats_building", partial(cohorts.phantom_seats, scope=_BUILDING), W(
    """SELECT group_id, count(*) AS verified_count, max(stated_num_students) AS stated_count,
       max(stated_num_students) - count(*) AS phantom_seats FROM roster
    WHERE group_id IS NOT NULL AND course_name = 'BUILDING' GROUP BY group_id""", "roster"))
reg("monthly_group_scores_one_group", partial(cohorts.monthly_group_scores, scope=_GROUP), W(
    f", {_MG} SELECT * FROM mg WHERE group_id = 'BUILDING-NATION_3'", "assessments", round_cols=("avg_score",)))
reg("enrollment_history_building", partial(growth.enrollment_history, scope=_BUILDING), W(
    f", {_WIN.replace('en AS (SELECT * FROM roster WHERE enrollment_date IS NOT NULL)', 'en AS (SELECT * FROM roster WHERE enrollment_date IS NOT NULL AND course_name = ' + chr(39) + 'BUILDING' + chr(39) + ')')} "
    "SELECT * FROM hist", *_GV))
