"""URL filters by a path-template tree.

Fixed rules judge first. Their verdicts are also the labels from which the tree judges all
other urls: per host, paths form a tree of segments.

1. Variable segments become wildcards: runs of digits and long hexadecimal names by their form.
2. Sibling branches whose share of blocked labels does not differ from the other siblings'
   (two-proportion test, ``Z_LIMIT``; no label: no difference to show) merge into one branch,
   however many they are. (``judge_sql`` also merges all children
   beyond ``FANOUT`` and reads ``LEVELS`` segments only: the same where neither is exceeded.)
   The first ``LEVELS`` levels are always built; below them a branch goes on as deep as its paths
   do while its labels disagree, and ends where they all agree or none is left.
3. A template's purity is its share of blocked labels, smoothed towards its parent's with
   ``STRENGTH`` pseudo-labels (the host's towards the corpus share, or one half if that is less,
   so that a host without labels is not rejected). From ``REJECT`` on, the template is rejected
   and its urls are blocked.

The tree is built from counts per (host, generalised path); the pages themselves only meet the
finished templates in one equi-join, which may be split on a hot host.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import ascii_lower, columns
from cohortlens.session import materialize

# Host and path prefix with the verdict, longest match wins.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
LEVELS = 3  # at least so many segments are walked, whatever their purity
Z_LIMIT = 1.96
STRENGTH = 5.0
REJECT = 0.8
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _rule(rules) -> Column:
    """The longest rule that fits ``host`` and ``path``, else null."""
    ordered = sorted((r for r, _ in rules), key=lambda r: (-len(r), -len(r.split("/")[0]), r))
    fits = []
    for r in ordered:
        host, path = r.split("/", 1)
        on = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits.append(F.when(on & F.col("path").startswith("/" + path), F.lit(r)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _segments() -> Column:
    """The path's segments, variable forms generalised, without the empty ones at its end."""
    parts = F.split(F.rtrim("path", F.lit("/")), "/")
    return F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.when(
        x.rlike("^[0-9a-f]{8,}$"), F.lit("<hex>")).otherwise(F.regexp_replace(x, "[0-9]+", "<n>")))


def _templates(paths: DataFrame) -> DataFrame:
    """``(host, segs, labelled, blocked)`` per path to ``(host, segs, template, purity)``."""
    total = paths.agg(F.least((F.sum("blocked") + 1) / (F.sum("labelled") + 2), F.lit(0.5)).alias("q"))
    hosts = paths.groupBy("host").agg(((F.sum("blocked") + STRENGTH * F.coalesce(total.scalar(), F.lit(0.5)))
                                       / (F.sum("labelled") + STRENGTH)).alias("q"))
    tree = paths.join(hosts, "host").select("*", F.array().cast("array<string>").alias("t"))
    ended, k = [], 0
    while True:
        k += 1
        child = tree.groupBy("host", "t", F.coalesce(F.get("segs", F.lit(k - 1)), F.lit("")).alias("seg")).agg(
            F.sum("labelled").alias("lab"), F.sum("blocked").alias("bad"), F.max(F.size("segs")).alias("depth"), F.min("q").alias("q"))
        whole = child.groupBy("host", "t").agg(F.count("*").alias("fan"), F.sum("lab").alias("all_lab"),
                                               F.sum("bad").alias("all_bad"))
        named = child.join(whole, ["host", "t"]).withColumn("differs", F.expr(f"""
            case when lab = 0 or all_lab = lab or all_bad = 0 or all_bad = all_lab then false
                 else abs(bad / lab - (all_bad - bad) / (all_lab - lab))
                      >= {Z_LIMIT} * sqrt((all_bad / all_lab) * (1 - all_bad / all_lab)
                                          * (1 / lab + 1 / (all_lab - lab))) end"""))
        named = named.withColumn("name", F.when(F.col("seg") == "", "").when(
            (F.col("fan") > 1) & ~F.col("differs"), "*").otherwise(F.col("seg")))
        node = named.groupBy("host", "t", "name").agg(
            ((F.sum("bad") + STRENGTH * F.min("q")) / (F.sum("lab") + STRENGTH)).alias("q"),
            (F.lit(k < LEVELS) | ((F.max("depth") > k) & (F.sum("bad") > 0) & (F.sum("bad") < F.sum("lab")))).alias("open"))
        named = named.select("host", "t", "seg", "name").join(node, ["host", "t", "name"])
        tree = tree.withColumn("seg", F.coalesce(F.get("segs", F.lit(k - 1)), F.lit(""))).drop("q").join(
            named, ["host", "t", "seg"])
        tree = materialize(tree.select("host", "segs", "labelled", "blocked", "q", "open",
                                       F.concat("t", F.array("name")).alias("t")), "url_tree")
        if k >= LEVELS:
            ended.append(tree.where("not open"))
            tree = tree.where("open")
            if tree.isEmpty():
                break
        tree = tree.drop("open")
    path = F.regexp_replace(F.concat_ws("/", F.lit(""), F.col("t")), "/+$", "/")
    return functools.reduce(DataFrame.unionByName, ended).select("host", "segs", path.alias("template"), F.col("q").alias("purity"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, template, purity``.

    ``verdict`` is the longest fitting rule's, else ``block`` if the url's template is rejected,
    else ``allow``. Null urls and urls without ``://`` have an empty host and path and are judged
    as one template. Repeated rows are judged alike; rules of equal length: the longer host,
    then the text decides; an empty table gives an empty result; extra columns are ignored.
    """
    p = columns(pages, page_id="long", url="string")
    p = p.select("page_id", ascii_lower(F.regexp_extract(F.coalesce("url", F.lit("")), URL, 1)).alias("host"),
                 F.regexp_extract(F.coalesce("url", F.lit("")), URL, 2).alias("path"))
    p = p.withColumn("rule", _rule(rules))
    verdict = F.create_map(*[F.lit(x) for r in rules for x in r])
    p = p.withColumn("verdict", F.when(F.col("rule").isNotNull(), F.try_element_at(verdict, F.col("rule"))))
    p = p.withColumn("segs", _segments())
    keys = ["host", "segs"]
    paths = materialize(p.groupBy(*keys).agg(
        F.count("verdict").alias("labelled"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked")), "url_paths")
    templates = materialize(_templates(paths), "url_templates")
    return p.join(templates, keys).select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        "template", F.round("purity", 9).alias("purity"))


def judge_sql(rules=RULES) -> str:
    """DuckDB SQL for ``judge`` over ``pages``."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), -len(r[0].split("/")[0]), r[0]))

    def fits(r: str) -> str:
        host, path = r.split("/", 1)
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ordered) + " END"
    said = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules) + " END"
    return f"""WITH RECURSIVE
p0 AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
p1 AS (SELECT *, {rule} AS rule, list_transform(string_split(rtrim(path, '/'), '/')[2:], lambda x:
         CASE WHEN regexp_matches(x, '^[0-9a-f]{{8,}}$') THEN '<hex>' ELSE regexp_replace(x, '[0-9]+', '<n>', 'g') END) AS segs FROM p0),
p AS (SELECT page_id, host, path, rule, {said} AS said, segs FROM p1),
paths AS (SELECT host, segs, count(said)::DOUBLE AS labelled, count(CASE WHEN said = 'block' THEN 1 END)::DOUBLE AS blocked
          FROM p GROUP BY host, segs),
hosts AS (SELECT host, (sum(blocked) + {STRENGTH} * (SELECT least((sum(blocked) + 1) / (sum(labelled) + 2), 0.5) FROM paths))
                 / (sum(labelled) + {STRENGTH}) AS q FROM paths GROUP BY host),
-- one round a level: children under the templates so far, wildcards where they do not differ, smoothed purity
tree AS (
  SELECT host, segs, labelled, blocked, 0 AS k, []::VARCHAR[] AS t, q, true AS open FROM paths JOIN hosts USING (host)
  UNION ALL
  SELECT host, segs, labelled, blocked, k + 1, list_append(t, name), (node_bad + {STRENGTH} * q) / (node_lab + {STRENGTH}),
         k + 1 < {LEVELS} OR (depth > k + 1 AND node_bad > 0 AND node_bad < node_lab)
  FROM (SELECT *, sum(labelled) OVER n AS node_lab, sum(blocked) OVER n AS node_bad, max(len(segs)) OVER n AS depth
        FROM (SELECT *, CASE WHEN seg = '' THEN '' WHEN first_seg <> last_seg AND (lab = 0 OR al = lab OR ab = 0 OR ab = al OR
                abs(bad / lab - (ab - bad) / (al - lab)) < {Z_LIMIT} * sqrt((ab / al) * (1 - ab / al) * (1 / lab + 1 / (al - lab))))
                THEN '*' ELSE seg END AS name
              FROM (SELECT *, sum(labelled) OVER c AS lab, sum(blocked) OVER c AS bad, sum(labelled) OVER u AS al,
                           sum(blocked) OVER u AS ab, min(seg) OVER u AS first_seg, max(seg) OVER u AS last_seg
                    FROM (SELECT *, coalesce(segs[k + 1], '') AS seg FROM tree WHERE open)
                    WINDOW c AS (PARTITION BY host, t, seg), u AS (PARTITION BY host, t)))
        WINDOW n AS (PARTITION BY host, t, name)))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN q >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
  regexp_replace(array_to_string(list_prepend('', t), '/'), '/+$', '/') AS template, round(q, 9) AS purity
FROM p JOIN (SELECT * FROM tree WHERE NOT open) USING (host, segs)"""
