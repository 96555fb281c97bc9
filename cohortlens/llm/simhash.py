"""SimHash near-duplicates by pivot distance tables.

Fingerprints: one bit per position, set if more than half of a text's shingle hashes have it.
Links: fingerprints within ``max_bits`` = 2 differing bits. A table of Hamming distances to
reference fingerprints (pivots) finds them without comparing all pairs:

* Pivots are a base word and the base with one segment of bits inverted, for every segment,
  plus further pseudo-random words. The difference of two distances gives, per segment,
  how many bits differ from the base there. One changed bit moves one of these counts by one.
* So two fingerprints within two bits have count vectors at most two single steps apart, and
  share a vector that is at most one step from either. Every fingerprint is filed under its
  own vector and all one-step neighbours (an equi-join key, no all-pairs step).
* Pairs that meet are discarded if any coordinate of their distance tables differs by more
  than two (the triangle inequality), and survivors are verified on the bits.
* A cell with more than ``cell_limit`` fingerprints is refined exactly: its members are filed
  again with one pivot per bit (segments of one bit). A cell of that finest table holds at most
  65 fingerprints, all within two bits of each other, which link to their smallest.

Equal fingerprints are one node, so exact copies never meet in a cell.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import columns
from cohortlens.llm.components import components
from cohortlens.session import materialize, used_up

SEED = 42
SEGMENT_BITS = 4
EXTRA_PIVOTS = 16
CELL_LIMIT = 64
BLOCK = 1 << 15  # shingles unpacked to bits at a time


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pseudo_random(i: int) -> int:
    return xxhash.xxh64_intdigest(b"pivot %d" % i, 7)


BASE = _pseudo_random(0)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text: A-Z lower-cased, words between ASCII white
    space, ``shingle``-word shingles with repeats; fewer words: the whole sequence; none: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams: list[bytes] = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*[words[i:] for i in range(shingle)])]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(grams)
    for at in range(0, n, BLOCK):
        block = grams[at:at + BLOCK]
        h = np.fromiter((digest(g, SEED) for g in block), np.uint64, len(block))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return sum(1 << i for i in range(64) if 2 * int(ones[i]) > n)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row per input row; fp is the fingerprint's 64 bits as a long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.array([fingerprint(t, shingle) for t in f["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": f["doc_id"], "fp": fp})

    return columns(docs, doc_id="long", text="string").mapInPandas(run, "doc_id long, fp long")


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot))))


def _segments(width: int) -> list[int]:
    """Masks of consecutive ``width``-bit segments."""
    return [((1 << width) - 1) << at for at in range(0, 64, width)]


def pivots(width: int = SEGMENT_BITS, extra: int = EXTRA_PIVOTS) -> list[int]:
    """Base, base with one segment inverted (for each), and pseudo-random references."""
    return [BASE, *[BASE ^ m for m in _segments(width)], *[_pseudo_random(i + 1) for i in range(extra)]]


def distance_table(fps: DataFrame) -> DataFrame:
    """``fps`` with ``d``: the Hamming distances of ``fp`` to all pivots, in their order."""
    return fps.withColumn("d", F.array(*[_distance(F.col("fp"), p).cast("int") for p in pivots()]))


def _cells(fps: DataFrame, width: int = SEGMENT_BITS) -> DataFrame:
    """``(fp, cell)``: the own count vector and all vectors one step away, packed in a long.

    Segment counts come from distance differences: inverting a segment of ``width`` bits in
    the pivot turns its count c into width - c, so c = (d(base) - d(inverted) + width) / 2.
    """
    bits = width.bit_length()  # a count is 0..width
    count = [F.expr(f"(d[0] - d[{i + 1}] + {width}) div 2") for i in range(64 // width)]
    step = [F.lit(1 << (i * bits)) for i in range(len(count))]
    own = functools.reduce(Column.bitwiseOR, [F.shiftleft(c, i * bits) for i, c in enumerate(count)])
    up = [F.when(c < width, F.col("own") + s) for c, s in zip(count, step)]
    down = [F.when(c > 0, F.col("own") - s) for c, s in zip(count, step)]
    near = F.filter(F.array(F.col("own"), *up, *down), lambda x: x.isNotNull())
    return distance_table(fps).withColumn("own", own).select("fp", F.explode(near).alias("cell"))


def _bit_cells(fps: DataFrame) -> DataFrame:
    """The finest table, one pivot per bit: a fingerprint and its 64 one-bit neighbours."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    return fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("cell"))


def _verified(members: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, cell, d)`` to the links among a cell's members: table test, then the bits."""
    a = members.select("cell", F.col("fp").alias("src"), F.col("d").alias("da"))
    b = members.select("cell", F.col("fp").alias("dst"), F.col("d").alias("db"))
    spread = F.array_max(F.zip_with("da", "db", lambda x, y: F.abs(x - y)))
    return (a.join(b, "cell").where("src < dst").where(spread <= max_bits)
            .where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits)
            .select("src", "dst"))


def links(fps: DataFrame, max_bits: int = 2, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Distinct ``fp`` to links ``(src, dst)`` that connect all fingerprints within ``max_bits``.

    Cells of up to ``cell_limit`` members give all their verified pairs; members of fuller cells
    go through the one-bit table (at most 65 to a cell), so no link is lost and no cell is
    quadratic in the input.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("count vectors meet half-way for at most two differing bits")
    sized = materialize(
        _cells(fps).withColumn("n", F.count("*").over(Window.partitionBy("cell"))).where("n > 1"), "cells")
    near = _verified(distance_table(sized.where(F.col("n") <= cell_limit)), max_bits)
    crowded = sized.where(F.col("n") > cell_limit).select("fp").distinct()
    fine = materialize(_bit_cells(crowded), "bits")
    if max_bits < 2:
        return near.union(_verified(distance_table(fine), max_bits))
    centre = fine.groupBy("cell").agg(F.min("fp").alias("src"))
    star = fine.join(centre, "cell").where("fp <> src").select("src", F.col("fp").alias("dst"))
    return near.union(star)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row.

    component_id is the smallest doc_id reachable over links of at most ``max_bits`` differing
    bits, the document's own included. Null and wordless texts have fingerprint zero and link
    like any other; rows without a doc_id take no part in the minimum (their component_id is
    that of the other members, or null if there are none); repeated rows are one node and
    come back as often as they came in; an empty table gives an empty result.
    """
    fp = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    comp = components(links(nodes.select("fp"), max_bits))
    named = (nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", "first_doc", F.coalesce("component", "fp").alias("class_fp")))
    named = materialize(named, "classes")
    smallest = named.groupBy("class_fp").agg(F.min("first_doc").alias("component_id"))
    ids = named.join(smallest, "class_fp").select("fp", "component_id")
    return fp.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` without the near-duplicates: of each class the smallest doc_id stays.

    Rows with the same doc_id are one document and stay or go together; rows without a
    doc_id stay.
    """
    with used_up() as keep:
        gone = keep(materialize(near_duplicates(docs, shingle, max_bits).where("doc_id <> component_id")
                                .select(F.col("doc_id").alias("gone_id")).distinct(), "gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
