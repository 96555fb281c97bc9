"""Rule 20, mixed formats: each batch's own time format is inferred from all its values, then applied.

A format is a pattern and the ISO text that it stands for, so that parsing is a replacement and a cast:
zone-free, null for impossible dates. One aggregate counts, per batch and format, the values that
parse; a date such as 03/04 fits two formats, but a batch with a day over 12 fits only one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIME = r"[ T]([0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]+)?)"
FORMATS: Mapping[str, tuple[str, str]] = {
    "iso": (rf"^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}){_TIME}$", "$1 $2"),
    "day first": (rf"^([0-9]{{2}})/([0-9]{{2}})/([0-9]{{4}}){_TIME}$", "$3-$2-$1 $4"),
    "month first": (rf"^([0-9]{{2}})/([0-9]{{2}})/([0-9]{{4}}){_TIME}$", "$3-$1-$2 $4"),
}


def parse(c: Column, name: str, formats: Mapping[str, tuple[str, str]] = FORMATS) -> Column:
    """The text as a timestamp in the named format, null if it is not one."""
    pattern, iso = formats[name]
    text = F.trim(c)
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, iso)).try_cast("timestamp_ntz")


def batch_formats(df: DataFrame, batch: str, column: str, formats: Mapping[str, tuple[str, str]] = FORMATS) -> DataFrame:
    """``batch, n_values, time_format, n_parsed, ambiguous``: the format that parses most values of the
    batch (ties: the first listed, ambiguous if it parses any). Null batches are one batch; null texts do not count."""
    names = list(formats)
    one = df.groupBy(batch).agg(F.count(column).alias("n_values"),
                                *[F.count(parse(F.col(column), f, formats)).alias(f"_f{i}") for i, f in enumerate(names)])
    most = F.greatest(*[F.col(f"_f{i}") for i in range(len(names))]) if len(names) > 1 else F.col("_f0")
    chosen = F.coalesce(*[F.when(F.col(f"_f{i}") == F.col("n_parsed"), F.lit(f)) for i, f in enumerate(names)])
    ties = sum((F.when(F.col(f"_f{i}") == F.col("n_parsed"), 1).otherwise(0) for i in range(len(names))), F.lit(0))
    any_ = F.col("n_parsed") > 0
    return (one.withColumn("n_parsed", most)
            .select(batch, "n_values", F.when(any_, chosen).alias("time_format"), "n_parsed",
                    (any_ & (ties > 1)).alias("ambiguous")))


def parse_by_batch(df: DataFrame, batch: str, column: str, out: str,
                   formats: Mapping[str, tuple[str, str]] = FORMATS) -> DataFrame:
    """``df`` with ``time_format``, ``ambiguous`` and ``out``: the text parsed in its batch's format. Batches are
    few against rows; the join is left to the planner's size check."""
    verdict = batch_formats(df, batch, column, formats).select(F.col(batch).alias("_batch"), "time_format", "ambiguous")
    joined = df.join(verdict, F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch")
    value = F.coalesce(*[F.when(F.col("time_format") == f, parse(F.col(column), f, formats)) for f in formats])
    return joined.withColumn(out, value)


def canonical_label(c: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """The label whose spellings hold the trimmed, case-folded text; null if none does."""
    key = F.lower(F.trim(c.cast("string")))
    return F.coalesce(*[F.when(key.isin(list(spellings)), F.lit(label)) for label, spellings in vocabulary.items()])
