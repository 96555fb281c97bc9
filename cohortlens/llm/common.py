"""Small helpers the operators share: table reads and text-to-words expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import freed_shuffles

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = "\x20\t\n\x0b\x0c\r"
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; installed on every machine with its package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; other columns (whatever their names) are left out."""
    return df.select(*[df[c].cast(t).alias(c) for c, t in types.items()])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def split_words(c: Column, separators: str = ASCII_SPACE) -> Column:
    """Words between separator runs (null text: no words). ``split`` leaves an empty string
    before a leading and after a trailing separator only; those two are sliced off."""
    parts = F.split(F.coalesce(c, F.lit("")), separators)
    head = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    tail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, head + 1, F.greatest(F.size(parts) - head - tail, F.lit(0)))


def bit_plane(rows: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits (a multiple of 64) with the rows' slots set. Its size, and the one row per word of it that
    comes to the driver as Arrow batches, do not depend on the number of rows."""
    with freed_shuffles(rows.sparkSession):
        words = (rows.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow())
    plane = np.zeros(bits // 64, np.int64)
    plane[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return plane.view(np.uint64)


def in_plane(plane: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which slots are set."""
    return (plane.view(np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & np.uint8(1) == 1  # little-endian words


BATCH_CHARS = 1 << 21


def text_batches(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``BATCH_CHARS`` together (a longer text is alone)."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > BATCH_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


class Memo:
    """A dict bounded in bytes: when the younger half is full it becomes the older half, whose
    entries return to the younger one when they are asked for."""

    def __init__(self, limit: int):
        self.young: dict = {}
        self.old: dict = {}
        self.limit, self.size = limit // 2, 0

    def get(self, key: str, default=None):
        if key in self.young:
            return self.young[key]
        if key in self.old:
            value = self.old[key]
            self.put(key, value, 64)
            return value
        return default

    def put(self, key: str, value, n_bytes: int) -> None:
        self.size += 2 * len(key) + n_bytes + 200
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
