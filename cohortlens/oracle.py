"""Oracle SQL scaffolding: the crosswalk views as DuckDB CTEs built from the SAME
derivation text the Spark views use (``sources.crosswalk``)."""

from __future__ import annotations

from cohortlens.sources import crosswalk as cw

VIEWS: dict[str, str] = {
    "roster": (
        f"SELECT {', '.join(cw.ROSTER_COLS)}, first_order AS enrollment_date "
        "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
        "LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) fo "
        "ON o_custkey = c_custkey"),
    "assessments": (
        f"SELECT {', '.join(cw.ASSESSMENT_COLS)}, shipped AS submitted_at "
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
        "LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey) sh "
        "ON l_orderkey = o_orderkey"),
    "attendance": f"SELECT {', '.join(cw.ATTENDANCE_COLS)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "concepts": (f"SELECT {', '.join(cw.CONCEPT_COLS)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
                 "JOIN part ON l_partkey = p_partkey"),
    "learn_events": f"SELECT {', '.join(cw.EVENT_COLS)} FROM events",
    "raw_submissions": "SELECT user_id AS student_id, ts AS submitted_at FROM events WHERE event_type = 'purchase'",
    "raw_quiz_grades": ("SELECT user_id AS student_id, 'quiz' AS type, ts AS date, value AS score "
                        "FROM events WHERE event_type = 'error'"),
}


def _bigint_count_if(sql: str) -> str:
    """DuckDB's ``count_if`` returns HUGEINT; Spark's returns BIGINT. Wrap each call."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        out.append(sql[i:j])
        out.append(f"CAST({sql[j:k + 1]} AS BIGINT)")
        i = k + 1


def with_views(body: str, *names: str, round_cols: tuple[str, ...] = (), digits: int = 9) -> str:
    """``WITH <views> <body>``; doubles listed in ``round_cols`` are rounded in an outer select."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if not names:
        sql = body.lstrip().lstrip(",")
        if sql.lstrip().startswith(("WITH", "SELECT", "(")):
            pass
        else:
            sql = "WITH " + sql
    elif body.lstrip().startswith(","):
        sql = f"WITH {ctes}{body}"
    else:
        sql = f"WITH {ctes}\n{body}"
    sql = _bigint_count_if(sql)
    if round_cols:
        rep = ", ".join(f"round({c}, {digits}) AS {c}" for c in round_cols)
        sql = f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _q"
    return sql
