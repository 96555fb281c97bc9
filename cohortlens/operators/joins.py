"""Joins Spark has no single operator for: as-of, null-safe anti, nearest value.

None of them uses a cross join or emits pairs within a key: the as-of join is two
windowed passes over time buckets, the nearest-value search is neighbour lookup in value
order over one row per candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.exprs import day_number
from cohortlens.session import materialize


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into ``spark.sql.shuffle.partitions`` parts that AQE does not merge. For a join whose output
    is sorted several times more by the same keys: merged parts would hold all those sorts in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str,
                  bucket: str = "day") -> DataFrame:
    """``merge_asof(direction='backward', allow_exact_matches=True)`` by key.

    Every ``left`` row is kept (its ``left_on`` must be non-NULL) with ``right_on`` set to
    the latest right timestamp at or before it for the same ``by`` key, NULL if none.

    Skew: a key's rows are split by time bucket. (1) Inside one (key, bucket) a running
    ``last`` over the union of both sides finds a same-bucket match; (2) over the
    bucket-level maxima of the right side — one row per (key, bucket), so bounded by the
    time span, not by row volume — a running ``max`` over strictly earlier buckets gives
    the fallback. A key holding a third of all rows is spread over its buckets, and the
    right side is reduced to the keys and buckets the left side needs before any window.
    """
    def bkt(c: str) -> Column:
        d = day_number(c).cast("bigint")
        if bucket == "day":
            return d
        h = d * 24 + F.hour(c)
        return h if bucket == "hour" else h * 60 + F.minute(c)

    lcols = left.columns
    lt = left.withColumn("_b", bkt(left_on))
    rt = (right.select(F.col(by), F.col(right_on).alias("_rts")).where(F.col("_rts").isNotNull())
               .withColumn("_b", bkt("_rts")))
    keys = lt.select(by, "_b").distinct()
    students = lt.select(by).distinct()
    # the right side reduced once to the left's keys; both passes below read this same
    # subtree, so its scan and shuffle are planned once and reused
    rt = rt.join(students, by, "left_semi")

    # (1) same-bucket match: union of the two sides restricted to the left's (key, bucket).
    r_same = rt.join(keys, [by, "_b"], "left_semi")
    u = (lt.select(*[F.col(c) for c in lcols], "_b", F.col(left_on).alias("_ts"),
                   F.lit(None).cast(rt.schema["_rts"].dataType).alias("_rts"), F.lit(1).alias("_side"))
           .unionByName(r_same.select(*[F.lit(None).cast(left.schema[c].dataType).alias(c)
                                        for c in lcols if c != by], F.col(by), "_b",
                                      F.col("_rts").alias("_ts"), "_rts", F.lit(0).alias("_side"))))
    w = (Window.partitionBy(by, "_b").orderBy("_ts", "_side")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = (u.withColumn("_m", F.last("_rts", ignorenulls=True).over(w))
              .where(F.col("_side") == 1).drop("_side", "_ts", "_rts"))

    # (2) earlier-bucket fallback over bucket-level maxima (one row per key and bucket).
    rmax = (rt.groupBy(by, "_b").agg(F.max("_rts").alias("_bm"))
              .withColumn("_k", F.lit(0)))
    kk = keys.withColumn("_bm", F.lit(None).cast(rt.schema["_rts"].dataType)).withColumn("_k", F.lit(1))
    w2 = Window.partitionBy(by).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    prev = (rmax.unionByName(kk).withColumn("_prev", F.max("_bm").over(w2))
                .where(F.col("_k") == 1).select(by, "_b", "_prev"))

    return (same.join(prev, [by, "_b"], "left")
                .withColumn(right_on, F.coalesce(F.col("_m"), F.col("_prev")))
                .drop("_m", "_prev", "_b"))


def null_safe_anti(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]],
                   null_safe: tuple[str, ...] = ()) -> DataFrame:
    """Left rows with no right row on all key pairs.

    Pairs named in ``null_safe`` compare with ``<=>`` (pandas merges NULL to NULL); the rest
    with ``=``. Spark plans both forms as an equi-join, so this is a shuffle (or AQE
    broadcast) anti join, never a nested loop. The right side is first reduced to its distinct
    keys (a partial aggregate below the exchange), so a hot key is one row there.
    """
    r = right.select(*[F.col(rc).alias(f"_r_{i}") for i, (_, rc) in enumerate(keys)]).distinct()
    cond = None
    for i, (lc, _) in enumerate(keys):
        c = (F.col(lc).eqNullSafe(F.col(f"_r_{i}")) if lc in null_safe
             else F.col(lc) == F.col(f"_r_{i}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left_anti")


def nearest_other(targets: DataFrame, candidates: DataFrame, key: str, value: str) -> DataFrame:
    """For each target row (key, value) the candidate with the nearest value, other than the
    target itself (J12). Ties: smallest |diff|, then smallest candidate key.

    Candidates are first reduced to one row per distinct value carrying its smallest and
    second-smallest key (an equi-join on the value, no pairs). Those rows and the targets are
    partitioned by ranges of the value; running ``last`` windows inside a range give the two candidate values
    below and above each target, and what lies beyond a range's ends is carried over as one
    small aggregate, two candidates for each end of each range (building the plan writes the ranges). When the neighbour is the target itself, the second key at
    that value or the next value over is used.
    Output: target columns + ``nearest_key``, ``nearest_value``.
    """
    c = candidates.select(F.col(key).alias("_ck"), F.col(value).cast("double").alias("_v")) \
                  .where(F.col("_v").isNotNull())
    g1 = c.groupBy("_v").agg(F.min("_ck").alias("_g1"))
    g2 = (c.join(g1, "_v").where(F.col("_ck") > F.col("_g1"))
           .groupBy("_v").agg(F.min("_ck").alias("_g2")))
    d = g1.join(g2, "_v", "left")

    t = targets.withColumn("_tv", F.col(value).cast("double"))
    # same value: the smallest key other than the target itself, at distance 0
    eq = (t.select(key, "_tv").join(d.select(F.col("_v").alias("_tv"), "_g1", "_g2"), "_tv")
           .select(key, F.when(F.col("_g1") != F.col(key), F.col("_g1")).otherwise(F.col("_g2")).alias("_eqk")))

    cand = F.struct(F.col("_v").alias("v"), F.col("_g1").alias("k"), F.col("_g2").alias("k2"))
    cand_rows = d.select(F.col("_v").alias("_o"), cand.alias("_c"), F.lit(None).cast("string").alias("_tk"))
    shape = cand_rows.schema["_c"].dataType
    tgt_rows = t.select(F.col("_tv").alias("_o"), F.lit(None).cast(shape).alias("_c"), F.col(key).cast("string").alias("_tk"))
    # written once: the ranges come from a sample, and both readers below must see the same ones
    u = materialize(cand_rows.unionByName(tgt_rows).repartitionByRange("_o").withColumn("_p", F.spark_partition_id()), "ranges")

    # inside a range: the candidate before and after every row (targets sort first at equal value, either way)
    before = Window.unboundedPreceding, -1
    up = Window.partitionBy("_p").orderBy(F.col("_o").asc(), F.col("_tk").isNull().asc()).rowsBetween(*before)
    down = Window.partitionBy("_p").orderBy(F.col("_o").desc(), F.col("_tk").isNull().asc()).rowsBetween(*before)
    one = u.withColumns({"_lo": F.last("_c", ignorenulls=True).over(up), "_hi": F.last("_c", ignorenulls=True).over(down)})
    both = lambda side: F.when(F.col("_c").isNotNull(), F.array("_c", side))
    two = one.withColumns({"_los": F.coalesce(F.last(both("_lo"), ignorenulls=True).over(up), F.array().cast(f"array<{shape.simpleString()}>")),
                           "_his": F.coalesce(F.last(both("_hi"), ignorenulls=True).over(down), F.array().cast(f"array<{shape.simpleString()}>"))})
    # beyond it: two candidates at each end of each range, one row per range
    ends = (one.where("_c is not null").groupBy("_p").agg(F.max_by(F.array("_c", "_lo"), "_o").alias("top"), F.min_by(F.array("_c", "_hi"), "_o").alias("bottom"))
            .agg(F.collect_list(F.struct("_p", "top", "bottom"))).scalar())

    def beyond(side: str, earlier: bool) -> Column:
        ranges = F.filter("_ends", lambda x: (x["_p"] < F.col("_p")) if earlier else (x["_p"] > F.col("_p")))
        found = F.filter(F.flatten(F.transform(ranges, lambda x: x[side])), lambda x: x.isNotNull())
        return F.sort_array(found, asc=not earlier)

    near = (two.where(F.col("_tk").isNotNull()).withColumn("_ends", ends)
            .select(F.col("_tk").alias(key), F.filter(F.concat("_los", beyond("top", True)), lambda x: x.isNotNull()).alias("_lo"),
                    F.filter(F.concat("_his", beyond("bottom", False)), lambda x: x.isNotNull()).alias("_hi")))

    res = t.join(near, key, "left").join(eq, key, "left")
    me = F.col(key)

    def skip_self(side: str):
        """(value, key) of the nearest candidate on a side, stepping past the target itself."""
        first, second = F.get(side, F.lit(0)), F.get(side, F.lit(1))
        own = first["k"] == me
        k = F.when(~own, first["k"]).when(first["k2"].isNotNull(), first["k2"]).otherwise(second["k"])
        v = F.when(~own, first["v"]).when(first["k2"].isNotNull(), first["v"]).otherwise(second["v"])
        return v, k

    (lo_v, lo_k), (hi_v, hi_k) = skip_self("_lo"), skip_self("_hi")
    res = res.withColumn("_lv", lo_v).withColumn("_lk", lo_k).withColumn("_hv", hi_v).withColumn("_hk", hi_k)
    dlo = F.abs(F.col("_tv") - F.col("_lv"))
    dhi = F.abs(F.col("_tv") - F.col("_hv"))
    pick_lo = F.col("_hk").isNull() | (dlo < dhi) | ((dlo == dhi) & (F.col("_lk") < F.col("_hk")))
    has_lo = F.col("_lk").isNotNull()
    nk = (F.when(F.col("_eqk").isNotNull(), F.col("_eqk"))
           .when(has_lo & pick_lo, F.col("_lk")).otherwise(F.col("_hk")))
    nv = (F.when(F.col("_eqk").isNotNull(), F.col("_tv"))
           .when(has_lo & pick_lo, F.col("_lv")).otherwise(F.col("_hv")))
    return (res.withColumn("nearest_key", nk).withColumn("nearest_value", nv)
               .drop("_tv", "_lo", "_hi", "_eqk", "_lv", "_lk", "_hv", "_hk"))


def periods(dim: DataFrame, by: str, valid_from: str) -> DataFrame:
    """Effective-dated rows with ``valid_to``: each row of a key holds until the key's next one (null: still).
    Rows without a start are left out; of several with one start the greatest counts."""
    rest = [c for c in dim.columns if c not in (by, valid_from)]
    one = (dim.where(F.col(valid_from).isNotNull()).groupBy(by, valid_from)
           .agg(F.max(F.struct(*rest)).alias("_rest")).select(by, valid_from, *[F.col(f"_rest.{c}").alias(c) for c in rest]))
    return one.withColumn("valid_to", F.lead(valid_from).over(Window.partitionBy(by).orderBy(valid_from)))


def effective_at(facts: DataFrame, dim: DataFrame, by: str, on: str, valid_from: str, bucket_days: int = 64) -> DataFrame:
    """``facts`` with the columns of the ``dim`` row that is in force for key ``by`` at time ``on`` (null: none).

    No range join: the periods of a key are listed for each bucket of ``bucket_days`` days that they touch
    (clipped to the span of the facts, so open periods end), and facts meet them on (key, bucket);
    the exact bounds are tested on the few periods of one bucket. Periods of a key do not
    overlap, so no row is multiplied. Facts without a key or time have no period.
    """
    rest = [c for c in dim.columns if c not in (by, valid_from)]
    span = facts.agg(F.struct(F.min(on).alias("low"), F.max(on).alias("high"))).scalar()
    p = (periods(dim, by, valid_from).withColumn("_span", span)
         .where((F.col(valid_from) <= F.col("_span.high")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_span.low")))))

    def bucket(c: Column) -> Column:
        return F.floor(day_number(c) / bucket_days).cast("long")

    first = bucket(F.greatest(F.col(valid_from), F.col("_span.low")))
    last = bucket(F.least(F.coalesce("valid_to", F.col("_span.high")), F.col("_span.high")))
    listed = p.select(F.col(by).alias("_by"), F.col(valid_from).alias("_from"), F.col("valid_to").alias("_to"),
                      *[F.col(c).alias(f"_x_{c}") for c in rest], F.explode(F.sequence(first, last)).alias("_b"))
    hit = ((F.col(by) == F.col("_by")) & (bucket(F.col(on)) == F.col("_b")) & (F.col(on) >= F.col("_from"))
           & (F.col("_to").isNull() | (F.col(on) < F.col("_to"))))
    return facts.join(listed, hit, "left").select(*[facts[c] for c in facts.columns], *[F.col(f"_x_{c}").alias(c) for c in rest])
