"""Rules 13, 14 and 19 without naming columns: equal, constant and renamed columns are found.

One pass gives every column a fingerprint that does not depend on the order of rows: the sum and the xor of a
hash of the value (null-safe) with a hash of the whole row. Two columns that hold the same values row by row have the same
fingerprint, whatever their number, so no pairs of columns are compared. The pass returns one
row per column; everything after it is small.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATTERNS = ("[0-9]", "[A-Za-z]", "[^0-9A-Za-z]")
MIN_SCORE = 0.6


def _per_column(df: DataFrame, columns: Sequence[str], fields) -> DataFrame:
    """One row per column: ``column, type, position`` and the aggregates that ``fields(name)`` gives it, in one pass."""
    types = dict(df.dtypes)
    aggs = [a.alias(f"c{i}_{k}") for i, c in enumerate(columns) for k, a in fields(c).items()]
    names = list(fields(columns[0]))
    row = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.lit(i).alias("position"),
                    *[F.col(f"c{i}_{k}").alias(k) for k in names]) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*row)))


def column_profiles(df: DataFrame) -> DataFrame:
    """``column, type, position, n, n_null, constant, fp_xor, fp_sum`` per column. constant: at most one distinct
    value beside nulls, in a table of two rows at least."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])

    def fields(c: str) -> dict[str, Column]:
        value = F.col(f"`{c}`")
        h = F.xxhash64("_row", value, value.isNull())
        return {"n": F.count(F.lit(1)), "n_null": F.count_if(value.isNull()),
                "high": F.max(F.when(value.isNotNull(), F.xxhash64(value))), "least": F.min(F.when(value.isNotNull(), F.xxhash64(value))),
                "fp_xor": F.bit_xor(h), "fp_sum": F.sum(h.cast("decimal(20,0)"))}

    p = _per_column(df.withColumn("_row", row), df.columns, fields)
    constant = (F.col("n") > 1) & F.coalesce(F.col("least") == F.col("high"), F.lit(True))
    return p.select("column", "type", "position", "n", "n_null", constant.alias("constant"), "fp_xor", "fp_sum")


def equal_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``column, duplicate_of``: columns that repeat another of the same type in every row (rule 13). Of equal columns one
    named in ``keep`` stays, else the first of the table. An empty table has none."""
    p = column_profiles(df).where("n > 0")
    first = F.when(F.col("column").isin(list(keep)), -1).otherwise(F.col("position")) if keep else F.col("position")
    same = Window.partitionBy("type", "n_null", "fp_xor", "fp_sum").orderBy(first, "position")
    of = p.withColumn("duplicate_of", F.first("column").over(same))
    return of.where("column <> duplicate_of").select("column", "duplicate_of")


def constant_columns(df: DataFrame) -> DataFrame:
    """``column`` of the columns with one value at most (rule 14)."""
    return column_profiles(df).where("constant").select("column")


def _shapes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, type, shape``: the share of nulls and, of the values as text, the shares of digits, letters and other
    characters and the mean length against 20."""

    def fields(c: str) -> dict[str, Column]:
        text = F.col(f"`{c}`").cast("string")
        size = F.sum(F.length(text))
        shares = {f"s{k}": F.coalesce(F.try_divide(F.sum(F.regexp_count(text, F.lit(p))), size), F.lit(0.0)) for k, p in enumerate(PATTERNS)}
        return {"nulls": F.coalesce(F.try_divide(F.count_if(text.isNull()), F.count(F.lit(1))), F.lit(0.0)), **shares,
                "long": F.coalesce(F.least(F.try_divide(size, F.count(text)) / 20.0, F.lit(1.0)), F.lit(0.0))}

    p = _per_column(df, columns, fields)
    return p.select("column", "type", F.array("nulls", *[f"s{k}" for k in range(len(PATTERNS))], "long").alias("shape"))


def _tokens(name: str) -> set[str]:
    return set(re.findall("[a-z]+|[0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", name).lower()))


def renamed_columns(old: DataFrame, new: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``old_name, new_name, score``: columns of one batch that the other has under another name (rule 19).

    Only columns that one batch lacks are compared, those of one type. The score is the mean of the share of words that the shorter name has
    in common with the other, and of how alike the values look; batches of different months share no values. A pair is
    a rename if each is the other's best (ties: by name) and the score reaches ``min_score``.
    """
    gone, come = ([c for c in a.columns if c not in b.columns] for a, b in ((old, new), (new, old)))
    spark = old.sparkSession
    pairs = [(a, b, len(_tokens(a) & _tokens(b)) / max(1, min(len(_tokens(a)), len(_tokens(b))))) for a in gone for b in come]
    if not pairs:
        return spark.createDataFrame([], "old_name string, new_name string, score double")
    named = spark.createDataFrame(pairs, "old_name string, new_name string, name_score double")
    a = _shapes(old, gone).select(F.col("column").alias("old_name"), F.col("type").alias("a_type"), F.col("shape").alias("a"))
    b = _shapes(new, come).select(F.col("column").alias("new_name"), F.col("type").alias("b_type"), F.col("shape").alias("b"))
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("a")
    scored = (named.join(a, "old_name").join(b, "new_name").where("a_type = b_type")
              .select("old_name", "new_name", ((F.col("name_score") + 1 - apart) / 2).alias("score")))
    by_old = Window.partitionBy("old_name").orderBy(F.desc("score"), "new_name")
    by_new = Window.partitionBy("new_name").orderBy(F.desc("score"), "old_name")
    best = scored.withColumns({"i": F.row_number().over(by_old), "j": F.row_number().over(by_new)})
    return best.where((F.col("i") == 1) & (F.col("j") == 1) & (F.col("score") >= min_score)).select("old_name", "new_name", "score")
