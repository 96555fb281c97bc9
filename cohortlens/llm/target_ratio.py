"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

The n-grams (``ORDER`` words) of a text are hashed to ``BUCKETS`` buckets. Two multinomials are
counted: the raw one from all documents, the target from documents that labels call good
(quality 1, not toxic), smoothed towards the raw one with ``PRIOR`` times its own size, which
keeps scores comparable whatever share of the corpus is trusted. A document's score is the
sum of log(target / raw) over its n-grams, divided by their number; it is kept if it passes
the base rules and its score reaches the threshold.

Threshold: ``MARGIN`` of the way from the 99th percentile of the documents labelled bad (quality
0) to the 1st percentile of the trusted ones, over all labelled documents that pass the base
rules, in steps of 1 / ``STEPS``. It lies nearer to the bad ones since a trusted document's own
words are in the target. Without documents of both kinds it is ``MIN_SCORE``.

The raw counts cover every n-gram of every document, the target's every n-gram of every trusted one.
Documents meet the trusted ids by doc_id, with the buckets of their n-grams (two bytes each): their number is not
bounded, so nothing is broadcast. Both count tables have ``BUCKETS`` rows at most and
reach the scoring pass as one array in a scalar subquery. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import SPACE, columns, split_words
from cohortlens.session import materialize

BUCKETS = 1 << 16
MARGIN = 0.25
STEPS = 1000
ORDER = 1
PRIOR = 1.0
MIN_SCORE = -0.25
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"


def _gram_buckets(order: int) -> str:
    """SQL for the hash buckets of all runs of ``order`` words."""
    if order == 1:
        return f"transform(words, w -> cast(pmod(xxhash64(w), {BUCKETS}) as int))"
    run = ", ".join(f"get(words, i + {k})" for k in range(order))
    return (f"case when size(words) >= {order} then transform(sequence(0, size(words) - {order}), "
            f"i -> cast(pmod(xxhash64({run}), {BUCKETS}) as int)) else cast(array() as array<int>) end")


def counts(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """``(bucket, raw, good)`` for every bucket: n-grams in all and in trusted documents."""
    trusted = (columns(labels, doc_id="long", quality="int", toxic="int")
               .where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
               .select(F.col("doc_id").alias("trusted_id")).distinct())
    small = f"transform({_gram_buckets(order)}, b -> cast(b - {BUCKETS // 2} as smallint))"
    # rows without a doc_id are dealt by their text; words are named twice and the explode is an outer one, so that the
    # planner does not split texts several times
    grams = (columns(docs, doc_id="long", text="string")
             .select(F.coalesce("doc_id", F.xxhash64("text")).alias("id"), F.col("doc_id").isNotNull().alias("named"),
                     split_words(F.col("text")).alias("words"))
             .select("id", "named", F.expr(f"case when size(words) > 0 then {small} end").alias("grams")))
    seen = (grams.join(trusted.hint("merge"), (F.col("id") == F.col("trusted_id")) & F.col("named"), "left")
            .select(F.col("trusted_id").isNotNull().cast("long").alias("good"), F.explode_outer("grams").alias("gram"))
            .where("gram is not null").groupBy("gram").agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
            .select((F.col("gram") + F.lit(BUCKETS // 2)).alias("bucket"), "raw", "good"))
    return (docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
            .join(seen, "bucket", "left")
            .select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")))


def _ratios(table: DataFrame, prior: float = PRIOR) -> Column:
    """log(target share / raw share) of all buckets, in order, as one array.

    With p the raw share and n trusted n-grams, the target share is
    (good + prior * n * p) / (n + prior * n). Without a trusted document every ratio is zero.
    """
    listed = table.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("b"),
                       F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    return listed.select(F.expr(f"""
        transform(b, x -> case when n_good = 0 then 0.0D else
          ln((x.good / ((x.raw + 1) / (n_raw + {BUCKETS})) + {prior} * n_good) / ((1 + {prior}) * n_good)) end)
        """)).scalar()


def _repeat_words() -> str:
    """SQL for the words inside a three-word window found twice or more in the text.

    Windows are compared by a 64-bit hash of their words; repeated ones are found by sorting
    (hash, position), and the union of the windows is added up from their sorted starts."""
    return """
      case when size(words) < 4 or size(array_distinct(windows)) = size(windows) then 0L else
        aggregate(
          zip_with(repeated, slice(repeated, 2, size(repeated)), (a, b) -> least(3, coalesce(b - a, 3))),
          0L, (acc, x) -> acc + x) end"""


def threshold(judged: DataFrame, labels: DataFrame) -> float:
    """The smallest score to keep, from ``(doc_id, base_failed, score)`` and the labels; documents
    labelled both ways count as neither."""
    kinds = (columns(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.expr("coalesce(quality = 1 and coalesce(toxic, 0) = 0, false)")).alias("good"),
        F.max(F.expr("coalesce(quality = 0, false)")).alias("bad")).where("good <> bad"))
    found = (judged.where("not base_failed").select("doc_id", F.floor(F.col("score") * STEPS).alias("step"))
             .join(kinds, "doc_id").groupBy("good", "step").agg(F.count("*").alias("n")).collect())

    def percentile(good: bool, share: float) -> float | None:
        steps = sorted((x["step"], x["n"]) for x in found if x["good"] == good)
        left = share * sum(n for _, n in steps)
        for step, n in steps:
            left -= n
            if left <= 0:
                return step / STEPS
        return None

    bad, good = percentile(False, 0.99), percentile(True, 0.01)
    return MIN_SCORE if bad is None or good is None else bad + MARGIN * (good - bad)


def judge(docs: DataFrame, labels: DataFrame, min_score: float | None = None, order: int = ORDER) -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, kept``.

    Null and wordless texts have zero counts, score 0 and fail the base rules (too few words).
    Repeated rows are judged each on their own; equal scores behave alike (the threshold is
    inclusive); with no usable labels every score is 0, so only the base rules reject; empty
    tables give an empty result; extra columns are ignored.
    """
    base = columns(docs, doc_id="long", text="string")
    judged = materialize(_judged(base, docs, labels, order).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "score"), "judged")
    return judged.withColumn("kept", _kept(judged, labels, min_score))


def _kept(judged: DataFrame, labels: DataFrame, min_score: float | None) -> Column:
    return ~F.col("base_failed") & (F.col("score") >= (threshold(judged, labels) if min_score is None else min_score))


def _judged(rows: DataFrame, docs: DataFrame, labels: DataFrame, order: int) -> DataFrame:
    ratio = _ratios(counts(docs, labels, order))
    text = F.coalesce(F.col("text"), F.lit(""))
    r = rows.withColumns({"words": split_words(F.col("text")), "ratio": ratio})
    r = r.withColumn("windows", F.expr(
        "transform(sequence(0, greatest(size(words) - 3, 0)), "
        "i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)))"))
    r = r.withColumn("ordered", F.expr(
        "case when size(words) >= 4 and size(array_distinct(windows)) < size(windows) then "
        "sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))) end"))
    r = r.withColumn("repeated", F.expr(
        "sort_array(transform(filter(ordered, (x, j) -> "
        "coalesce(get(ordered, j - 1).h = x.h, false) or coalesce(get(ordered, j + 1).h = x.h, false)), x -> x.i))"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    r = r.withColumn("lines", lines)
    n = F.size("words").cast("long")
    return r.withColumns({
        "n_words": n,
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.expr(_repeat_words()).cast("long"),
        "grams": F.expr(_gram_buckets(order)),
    }).withColumn("score", F.when(F.size("grams") > 0, F.expr(
        "aggregate(grams, 0.0D, (acc, g) -> acc + cast(ratio[g] as double))") / F.size("grams")).otherwise(F.lit(0.0))
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def keep_good(docs: DataFrame, labels: DataFrame, min_score: float | None = None) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects, all columns unchanged."""
    names = docs.columns
    carried = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].alias("doc_id"),
                          docs["text"].alias("text"))
    # written before the filter, which would otherwise be pushed into the verdict's expressions
    judged = materialize(_judged(carried, docs, labels, ORDER).select("row", "doc_id", "base_failed", "score"), "judged", compression="zstd")
    return judged.where(_kept(judged, labels, min_score)).select("row.*")
