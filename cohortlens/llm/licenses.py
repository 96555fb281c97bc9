"""License scan: an exact set-similarity join of text blocks against notice templates.

A block is a window of ``BLOCK_WORDS`` consecutive words, started every half window, so any
run of up to half a window lies whole in some block, whatever the line breaks. A block matches
a template when the template's word set is contained in the block's to ``THRESHOLD``.

The join is exact and prefix-filtered: template words are ordered by their document frequency
in the corpus (rarest first); a block that shares ``alpha`` of a template's ``n`` words must
hold one of the template's first ``n - alpha + 1`` (prefix filter), must hold at least ``alpha``
template words (length filter), and the words left after the first shared one must still
reach ``alpha`` on both sides (positional filter). Words outside all templates cannot
contribute, so blocks are cut down to the template vocabulary first. Survivors are verified.

The template side is a parameter of the operator (a few dozen short notices), hence its prefix
index is small whatever the corpus; the corpus side is never shuffled as text.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import ascii_lower, columns, split_words

# Words are runs of letters, digits and non-ASCII characters of the A-Z lower-cased text;
# splitting before lower-casing needs both cases in the class.
WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_WORDS = 64
THRESHOLD = 0.9

# Phrases the scan must find wherever their words stand consecutively.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Opening words of well-known public license notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed "
                   "under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms "
            "of the gnu general public license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _needed(n: int, threshold: float) -> int:
    """Words of an n-word template a block must hold."""
    return max(1, math.ceil(n * threshold - 1e-9))


def _template_rows(templates, threshold: float) -> list[tuple]:
    rows = []
    for i, (label, text) in enumerate(templates):
        words = sorted(set(re.findall(r"[a-z0-9]+", text.lower())))
        if not words or len(words) > BLOCK_WORDS // 2 + 1:
            raise ValueError(f"a template needs 1 to {BLOCK_WORDS // 2 + 1} words: {text[:40]!r}")
        rows.append((i, label, words, _needed(len(words), threshold)))
    return rows


def _phrase_starts(phrase: str) -> str:
    """SQL for the positions in ``words`` at which the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    here = " and ".join(f"words[i + {k}] = '{p}'" for k, p in enumerate(parts))
    return (f"case when array_contains(words, '{parts[-1]}') and size(words) >= {len(parts)} then "
            f"filter(sequence(0, size(words) - {len(parts)}), i -> {here}) "
            f"else cast(array() as array<int>) end")


def _template_index(low: DataFrame, templates, phrases, threshold: float) -> Column:
    """One struct (a scalar subquery): ``ranked`` template words, rarest in the corpus first;
    ``rare`` words of all template prefixes; ``templates`` with words in the global order."""
    rows = _template_rows(templates, threshold)
    vocab = sorted({w for r in rows for w in r[2]})
    spark = low.sparkSession
    df = (low.select(F.explode(F.array_intersect("low", F.array(*map(F.lit, vocab)))).alias("token"))
          .groupBy("token").agg(F.count("*").alias("df")))
    order = (spark.createDataFrame([(w,) for w in vocab], "token string").join(df, "token", "left")
             .select(F.coalesce("df", F.lit(0)).alias("df"), "token"))
    ranked = order.agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))),
                                   lambda s: s["token"])).scalar()
    index = (spark.createDataFrame(rows, "template int, label string, words array<string>, alpha int")
             .withColumn("ranked", ranked)
             .select("label", "alpha", "ranked", F.size("words").alias("n"),
                     F.array_intersect("ranked", "words").alias("words"))
             .withColumn("head", F.slice("words", 1, F.col("n") - F.col("alpha") + 1)))
    return index.agg(F.struct(
        F.first("ranked").alias("ranked"),
        F.array_union(F.array_distinct(F.flatten(F.collect_list("head"))),
                      F.array(*[F.lit(p.split(" ")[-1]) for p, _ in phrases])).alias("rare"),
        F.collect_list(F.struct("label", "alpha", "n", "words", "head")).alias("templates"))).scalar()


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score`` and ``n_matches`` (block and template pairs that meet the threshold).

    ``n_base`` counts the places of all phrases; ``first_word``/``last_word`` are their smallest
    and largest start (null if none). ``labels`` joins phrase and template labels, distinct and
    sorted. ``score`` is the largest containment met (1 for a phrase, 0 for no match).
    Null text counts as empty; an empty table gives an empty result; repeated rows are
    scanned each on their own; extra columns are ignored; templates tie freely (all are kept).

    Two passes over the text: template-word frequencies (one row per template word leaves a
    task), then a row-local probe of the bounded template index; no text is shuffled.
    """
    base = columns(docs, doc_id="long", text="string")
    low = base.select("doc_id", "text", split_words(F.lower("text"), WORD_BREAK).alias("low"))
    rows = low.withColumn("ix", _template_index(low, templates, phrases, threshold))
    words = F.when(F.arrays_overlap("low", "ix.rare"), split_words(ascii_lower(F.col("text")), WORD_BREAK)
                   ).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", F.size("low").cast("long").alias("n_words"), words.alias("words"), "ix")
    half = BLOCK_WORDS // 2
    rows = rows.withColumn("blocks", F.expr(f"""
        transform(filter(transform(sequence(0, greatest(size(words) - {half + 1}, 0), {half}),
                                   s -> slice(words, s + 1, {BLOCK_WORDS})),
                         b -> arrays_overlap(b, ix.rare)),
                  b -> array_intersect(ix.ranked, b))"""))
    # b: a block's template words in the global order. Length, prefix and positional filters,
    # then the exact overlap.
    rows = rows.withColumn("matches", F.expr("""
        flatten(transform(blocks, b -> transform(
          filter(
            filter(
              transform(filter(ix.templates, t -> size(b) >= t.alpha),
                        t -> struct(t AS t, try_element_at(array_intersect(
                               slice(b, 1, size(b) - t.alpha + 1), t.head), 1) AS meet)),
              c -> c.meet is not null),
            c -> 1 + least(size(b) - array_position(b, c.meet),
                           c.t.n - array_position(c.t.words, c.meet)) >= c.t.alpha
                 and size(array_intersect(c.t.words, b)) >= c.t.alpha),
          c -> struct(c.t.label AS label, size(array_intersect(c.t.words, b)) / c.t.n AS containment))))"""))
    rows = rows.withColumns({f"at_{i}": F.expr(_phrase_starts(p)) for i, (p, _) in enumerate(phrases)})
    at = [F.col(f"at_{i}") for i in range(len(phrases))]
    every = F.concat(*at)
    none = F.array().cast("array<string>")
    said = F.array_sort(F.array_distinct(F.concat(
        *[F.when(F.size(a) > 0, F.array(F.lit(label))).otherwise(none) for a, (_, label) in zip(at, phrases)])))
    both = F.array_sort(F.array_union(said, F.transform("matches", lambda m: m["label"])))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(said, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(best).alias("score"),
        F.size("matches").cast("long").alias("n_matches"))


def scan_sql(phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan`` over ``documents``: every block against every template, no filters."""
    half = BLOCK_WORDS // 2
    tmpl = ", ".join(f"({i}, '{label}', {_needed(len(w), threshold)}, {w!r})"
                     for i, label, w, _ in _template_rows(templates, threshold))
    phr = ", ".join(f"('{label}', {p.split(' ')!r})" for p, label in phrases)
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
phrase(label, p) AS (VALUES {phr}),
tmpl(t, label, alpha, tw) AS (VALUES {tmpl}),
hit AS (
  SELECT r, label, i FROM w, phrase, unnest(range(len(words) - len(p) + 1)) AS u(i)
  WHERE list_contains(words, p[-1]) AND words[i + 1:i + len(p)] = p),
base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
  FROM hit GROUP BY r),
block AS (
  SELECT r, list_distinct(words[s + 1:s + {BLOCK_WORDS}]) AS b
  FROM w, unnest(range(0, greatest(len(words) - {half}, 1), {half})) AS u(s) WHERE len(words) > 0),
match AS (
  SELECT r, label, len(list_intersect(tw, b)) AS shared, len(tw) AS n
  FROM block, tmpl WHERE len(list_intersect(tw, b)) >= alpha),
met AS (
  SELECT r, count(*) AS n_matches, list(DISTINCT label) AS labels, max(shared / n) AS best
  FROM match GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(
    list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score,
  CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches
FROM w LEFT JOIN base USING (r) LEFT JOIN met USING (r)"""
