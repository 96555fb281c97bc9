"""Filter interaction audit: what five filters remove in every order, from counts per failure mask.

Each document has a mask of the filters that it fails. Counts per part and mask are additive, and what
any order of the filters removes at any step follows from them, so the corpus is read for the
masks alone and never again per order.

Filter E (a smaller doc_id has the identical text) needs a comparison across the table. A counting
Bloom filter of text hashes goes first: every task counts its own slots (the partial
aggregate), the shuffle merges the counters, and the slots counted twice or more become a bit
plane. A text one of whose ``PROBES`` slots was counted once is guaranteed unique; only the
others, the possible repeats, are shuffled with their whole texts for the exact minimum doc_id per text.

A sketch has ``SLOTS_PER_ROW`` counters a row within ``MIN_SLOTS`` and ``MAX_SLOTS`` (a plane of 32 MB
at most); more rows than one sketch can hold are dealt by hash to several, one after the other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import bit_plane, in_plane
from cohortlens.session import materialize

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
CONTINUATION = bytes(range(0x80, 0xC0))  # bytes that do not begin a code point
ROW = ("doc_id", "part", "h", "key")
MIN_WORDS = 100
SLOTS_PER_ROW = 8
PROBES = 2
MIN_SLOTS = 1 << 20
MAX_SLOTS = 1 << 28
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that one text (UTF-8) fails."""
    words = text.split()  # bytes split at ASCII white space
    upper = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, CONTINUATION))
    return ((len(words) < MIN_WORDS) * _bit("A") + (100 * len(set(words)) < 80 * len(words)) * _bit("B")
            + (100 * upper > 10 * points) * _bit("C") + (len(text) > len(text.translate(None, SYMBOLS))) * _bit("D"))


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks = pa.array([text_mask(x.as_py()) for x in b.column("text")], pa.int32())
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ROW], masks], [*ROW, "mask"])


def _sketch_slots(rows: int) -> tuple[int, int]:
    """(slots, number of sketches) for so many rows."""
    slots = min(MAX_SLOTS, max(MIN_SLOTS, 1 << (SLOTS_PER_ROW * max(rows, 1) - 1).bit_length()))
    return slots, -(-SLOTS_PER_ROW * max(rows, 1) // slots)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(48)) % np.uint64(parts)


def _probe(h: np.ndarray, slots: int) -> list[np.ndarray]:
    return [((h.view(np.uint64) * np.uint64(f)) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)
            for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[:PROBES]]


def _hashes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("h").to_numpy(zero_copy_only=False)


def repeated_slots(hashes: DataFrame, slots: int, parts: int, part: int) -> np.ndarray:
    """The merged sketch of one part as a bit plane: slots counted at least twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _hashes(b)
            h = h[_part(h, parts) == part]
            slot, n = np.unique(np.concatenate(_probe(h, slots)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], ["slot", "n"])

    merged = hashes.select("h").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    return bit_plane(merged.where("n > 1"), F.col("slot"), slots)


def possible_repeats(rows: DataFrame, hashes: DataFrame, n_rows: int) -> DataFrame:
    """The rows (with a column ``h``) that the sketches of all ``hashes`` do not clear as unique."""
    slots, parts = _sketch_slots(n_rows)
    out = None
    for part in range(parts):
        plane = rows.sparkSession.sparkContext.broadcast(repeated_slots(hashes, slots, parts, part))

        def keep(batches: Iterator[pa.RecordBatch], part=part, plane=plane) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = _hashes(b)
                hit = _part(h, parts) == part
                for slot in _probe(h, slots):
                    hit &= in_plane(plane.value, slot)
                yield b.filter(pa.array(hit))

        found = rows.mapInArrow(keep, rows.schema)
        out = found if out is None else out.unionByName(found)
    return out


def failure_masks(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, part, mask`` (bit i: filter i fails)."""
    body = F.coalesce(docs["text"].cast("string"), F.lit(""))
    doc_id = docs["doc_id"].cast("long").alias("doc_id")
    read = docs.select(doc_id, F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), F.xxhash64(body).alias("h"),
                       F.sha2(body, 256).alias("key"), body.cast("binary").alias("text"))
    rows = materialize(read.mapInArrow(_masked, "doc_id long, part string, h long, key string, mask int"), "masks")
    n_rows = rows.count()
    texts = docs.select(doc_id, body.alias("text"), F.xxhash64(body).alias("h"))
    first = (possible_repeats(texts, rows, n_rows).groupBy("text")
             .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
             .select(F.sha2("text", 256).alias("key"), "first"))
    later = (possible_repeats(rows.select("doc_id", "key", "h"), rows, n_rows).join(first, "key").where("doc_id > first")
             .select("doc_id", "key").distinct().withColumn("again", F.lit(_bit("E"))))
    return rows.join(later, ["doc_id", "key"], "left").select(
        "doc_id", "part", (F.col("mask") + F.coalesce("again", F.lit(0))).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, docs, good, toxic``: documents per part and mask, and how many of them are labelled
    good or toxic."""
    marks = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"),
                           labels["toxic"].cast("int").alias("toxic")).where("quality = 1 or toxic = 1")
             .groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
                                    F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic")))
    zero = F.lit(0).cast("long")
    marked = (masks.join(marks, "doc_id").groupBy("part", "mask")
              .agg(zero.alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")))
    every = masks.groupBy("part", "mask").agg(F.count("*").alias("docs"), zero.alias("good"), zero.alias("toxic"))
    return every.unionByName(marked).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])


def _steps() -> Column:
    """All 600 (order, step) pairs with the bits of the step's filter and of the filters before it."""
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    step = F.explode(F.lit([f"{o}{i}" for o in orders for i in range(1, len(FILTERS) + 1)]))
    return step.alias("at")


def audit(counts: DataFrame) -> DataFrame:
    """``mask_counts`` to one row per part, order and step with the counts of the contract."""
    cell = F.struct(*[F.col(c).cast("long").alias(c) for c in ("mask", "docs", "good", "toxic")])
    parts = counts.groupBy("part").agg(F.collect_list(cell).alias("cells"))  # at most 32
    rows = parts.select("part", "cells", _steps()).selectExpr(
        "part", "cells", "left(at, 5) AS filter_order", "cast(substr(at, 6) AS int) AS step")
    own = F.element_at(F.lit([_bit(x) for x in FILTERS]), F.expr(f"instr('{FILTERS}', substr(filter_order, step, 1))"))
    before = sum((F.expr(f"if(instr(filter_order, '{x}') < step, {_bit(x)}, 0)") for x in FILTERS), F.lit(0))
    rows = rows.withColumns({"own": own.cast("long"), "before": before.cast("long")})

    def total(value: str, where: str) -> Column:
        return F.expr(f"aggregate(cells, 0L, (acc, x) -> acc + if({where}, {value}, 0L))")

    fails, gone = "x.mask & own <> 0", "x.mask & before <> 0"
    removed = f"{fails} and not ({gone})"
    orders = factorial(len(FILTERS))
    return rows.select(
        "part", "filter_order", "step",
        total("x.docs", "x.mask & (own | before) = 0").alias("kept"),
        total("x.docs", removed).alias("removed"),
        total("x.docs", f"{fails} and {gone}").alias("redundant"),
        total("x.docs", "x.mask = own").alias("unique_fails"),
        total("x.good", removed).alias("good_lost"),
        total("x.toxic", removed).alias("toxic_lost"),
        # a document that fails k filters is removed by each of them in one k-th of the orders
        total(f"x.docs * ({orders} div bit_count(x.mask))", fails).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang; null: empty string), order of the five filters and step: ``part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A null text is an empty one (and identical to other empty ones); a row without doc_id is
    never later than another, so never fails E, and has no label; rows of one doc_id with the same
    text fail E only if a smaller doc_id has the text, too; a document with several label rows is
    good or toxic if one of them says so; an empty table has no parts, so no rows; without labels
    the lost counts are zero; extra columns are ignored.
    """
    masks = materialize(failure_masks(docs), "masks")
    return audit(materialize(mask_counts(masks, labels), "mask_counts"))


def audit_sql() -> str:
    """The same in DuckDB's SQL: the flags by their definitions, every order counted anew."""
    flags = " ".join(f"""WHEN '{x}' THEN f{x}""" for x in FILTERS)
    before = " OR ".join(f"(f{x} AND instr(filter_order, '{x}') < step)" for x in FILTERS)
    others = " + ".join(f"f{x}::INT" for x in FILTERS)
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
flags AS (
  SELECT part, len(w) < {MIN_WORDS} AS fA, 100 * len(list_distinct(w)) < 80 * len(w) AS fB,
         100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) AS fC,
         regexp_matches(body, '[{SYMBOLS.decode()}]') AS fD,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS fE,
         coalesce(g.quality = 1, false) AS good, coalesce(g.toxic = 1, false) AS toxic
  FROM words LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic
                        FROM labels GROUP BY doc_id) g USING (doc_id)),
orders AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || x FROM orders, (SELECT unnest(string_split('{",".join(FILTERS)}', ',')) AS x)
  WHERE NOT contains(filter_order, x)),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step) WHERE length(filter_order) = 5),
judged AS (
  SELECT part, filter_order, step, letter, good, toxic, CASE letter {flags} END AS fails,
         ({before}) AS gone, {others} AS n_fails
  FROM flags, steps),
counted AS (
  SELECT part, filter_order, step, letter,
         count(*) FILTER (NOT fails AND NOT gone) AS kept,
         count(*) FILTER (fails AND NOT gone) AS removed,
         count(*) FILTER (fails AND gone) AS redundant,
         count(*) FILTER (fails AND n_fails = 1) AS unique_fails,
         count(*) FILTER (fails AND NOT gone AND good) AS good_lost,
         count(*) FILTER (fails AND NOT gone AND toxic) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted"""
