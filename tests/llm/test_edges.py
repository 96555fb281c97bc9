"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from cohortlens.llm import (chunk_bpe, fuzzy_lines, language, leak_search, licenses, pseudonyms, simhash,
                            target_ratio, trie_counts, url_templates)
from cohortlens.llm.common import tokenizer_file

CLASH = ("words", "row", "doc", "id", "key", "line", "fp", "cell", "band", "ratio", "ix", "low", "values", "matches", "h")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
BPE = tokenizer_file("byte_bpe_50k.json")
PIECES = tokenizer_file("piece_bpe_32k.model")
ROWS = [(1, "one line\nanother line here"), (1, "one line\nanother line here"), (2, None), (3, ""), (4, " \n\t "),
        (5, LONG), (6, LONG + " tail"), (None, "text of nobody one line"), (None, None), (7, "one line"),
        (8, "\n\n"), (9, "naïve café 漢字\nmail a1@b.org"), (10, "x" * 20_000)]


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, "en" if i else None, "src", None) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"'clash' as {c}" for c in CLASH])


def labels(spark, rows=((1, 1, 0), (5, 0, 1), (None, 1, 0), (7, None, None), (1, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").selectExpr("*", "1 as bucket", "2 as h")


def items(spark, rows=((1, "one line"), (1, "one line"), (2, None), (None, "x"), (3, ""), (4, " ".join(LONG.split()[500:560])))):
    return spark.createDataFrame(list(rows), "item_id long, text string").selectExpr("*", "1 as key", "2 as at")


PER_ROW = {
    "licenses": lambda s, d: licenses.scan(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "pseudonyms": lambda s, d: pseudonyms.replace_private(d),
    "trie_counts": lambda s, d: trie_counts.count_tokens(d, PIECES),
    "chunk_bpe": lambda s, d: chunk_bpe.encode(d, BPE),
    "digests": lambda s, d: chunk_bpe.digests(d, BPE),
    "target_ratio": lambda s, d: target_ratio.judge(d, labels(s)),
    "language": lambda s, d: language.identify(d, language.train(d)),
    "fuzzy_lines": lambda s, d: fuzzy_lines.line_classes(d),
    "kept_lines": lambda s, d: fuzzy_lines.keep_first_lines(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row(spark, name):
    got = PER_ROW[name](spark, frame(spark, ROWS)).collect()
    ids = sorted((r.doc_id or -1) for r in got)
    assert ids == sorted((i or -1) for i, _ in ROWS)
    twice = [r for r in got if r.doc_id == 1]
    assert twice[0] == twice[1]
    assert PER_ROW[name](spark, frame(spark, [])).count() == 0


def test_simhash_of_wordless_texts(spark):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(frame(spark, ROWS)).collect()]
    assert {(i, c) for i, f, c in got if f == 0} == {(2, 2), (3, 2), (4, 2), (8, 2), (None, 2)}
    kept = simhash.keep_first(frame(spark, ROWS))
    assert sorted(kept.columns) == sorted(frame(spark, ROWS).columns)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 1, 2, 5, 7, 9, 10]


def test_line_dedup_of_odd_rows(spark):
    got = fuzzy_lines.keep_first_lines(frame(spark, ROWS)).collect()
    text = {r.doc_id: r.text for r in got}
    assert text[1] == ROWS[0][1] and text[2] is None and text[4] == " \n\t " and text[8] == "\n\n"
    assert text[5] == LONG and text[6] == "" and text[7] == ""
    dropped = {r.doc_id: r.dropped for r in fuzzy_lines.line_classes(frame(spark, ROWS)).collect()}
    assert [tuple(x) for x in dropped[7]] == [(0, 1, 0)] and [tuple(x) for x in dropped[6]] == [(0, 5, 0)]


def test_lines_of_negative_ids(spark):
    d = spark.createDataFrame([(-5, "b\na common line"), (-2, "x\ny\na common line")], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.dropped] for r in fuzzy_lines.line_classes(d).collect()}
    assert got == {-5: [], -2: [(2, -5, 1)]}


def test_quality_of_odd_rows(spark):
    got = {r.doc_id: r for r in target_ratio.judge(frame(spark, ROWS), labels(spark)).collect()}
    assert got[2].n_words == got[3].n_words == got[4].n_words == 0 and not got[2].kept and got[2].score == 0
    assert got[5].n_words == 60_000
    none = target_ratio.judge(frame(spark, ROWS), labels(spark, ())).collect()
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in none)
    kept = target_ratio.keep_good(frame(spark, ROWS), labels(spark))
    assert kept.columns == frame(spark, ROWS).columns


def test_leaks_of_odd_rows(spark):
    d = frame(spark, ROWS)
    got = {(r.doc_id, r.item_id) for r in leak_search.find(d, items(spark)).collect()}
    assert got == {(1, 1), (7, 1), (None, 1), (5, 4), (6, 4)}
    assert leak_search.find(frame(spark, []), items(spark)).count() == 0
    assert leak_search.find(d, items(spark, ())).count() == 0
    left = leak_search.drop_leaked(d, items(spark))
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {None, 2, 3, 4, 8, 9, 10}
    assert left.where("doc_id is null").select("text").collect() == [(None,)]


def test_only_the_leaked_row_of_an_id_goes(spark):
    """Rows without a doc_id, or with one doc_id, go one by one."""
    leak = " ".join(LONG.split()[500:560])
    rows = [(None, leak), (None, "a clean text of nobody"), (5, "clean"), (6, leak + " and more"), (6, "another text of six"), (2**63 - 1, "last")]
    d = frame(spark, rows)
    left = sorted(r.text for r in leak_search.drop_leaked(d, items(spark)).collect())
    assert left == sorted(["a clean text of nobody", "clean", "another text of six", "last"])
    assert {(r.doc_id, r.item_id) for r in leak_search.find(d, items(spark)).collect()} == {(None, 4), (6, 4)}


def test_language_of_odd_rows(spark):
    d = frame(spark, ROWS)
    got = {r.doc_id: r for r in language.identify(d, language.train(d)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 8))
    assert got[9].lang_pred == "en" and 0 <= got[9].score <= 1
    unlabelled = d.withColumn("lang", d["lang"].substr(9, 1)).where("doc_id is null")
    assert {r.lang_pred for r in language.identify(d, language.train(unlabelled)).collect()} == {"und"}


def test_urls_of_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "http://a.org/x"), (3, "http://" + "h" * 5000 + "/" + "p/" * 5000), (4, "a\nb://C.COM/fr/\n")]
    d = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as s1", "3 as q", "4 as template")
    got = url_templates.judge(d).collect()
    assert len(got) == 6 and {r.verdict for r in got} == {"allow"}
    assert [r.path for r in got if r.page_id == 4] == ["/fr/\n"]
    assert url_templates.judge(d.where("page_id > 99")).count() == 0
