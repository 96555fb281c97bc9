"""The signature-tree join, the filter audit and the spelling groups against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortlens.llm import filter_audit, signature_trees, spelling
from cohortlens.llm.common import table
from tests.llm import reference

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ n-gram Jaccard join
def shingle_set(text):
    w = reference.words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def jaccard_classes(docs):
    sets = [(i, shingle_set(t)) for i, t in docs]
    classes, holders = reference.Sets(), defaultdict(list)
    for at, (i, s) in enumerate(sets):
        classes.find(i)
        for o, k in Counter(o for g in s for o in holders[g]).items():
            if 100 * k >= 90 * (len(s) + len(sets[o][1]) - k):
                classes.join(i, sets[o][0])
        for g in s:
            holders[g].append(at)
    return {i: (len(s), classes.find(i)) for i, s in sets}


def joined(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in signature_trees.near_copies(df).collect()}


def test_signature_join(docs, texts):
    assert joined(docs) == jaccard_classes(texts)


def family(rnd, base, count, most):
    """Copies of a text with up to ``most`` words replaced."""
    for _ in range(count):
        words = list(base)
        for _ in range(rnd.randrange(most + 1)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("leaf", [2, 16])
def test_signature_trees_of_large_groups(spark, monkeypatch, leaf):
    """Groups around the threshold, larger than a leaf, with links the first pass cannot see."""
    monkeypatch.setattr(signature_trees, "LEAF", leaf)
    rnd = random.Random(leaf)
    texts = []
    for size, most in ((300, 5), (300, 14), (60, 2), (40, 1), (14, 1)):
        base = [f"w{rnd.randrange(500)}" for _ in range(size)]
        texts += family(rnd, base, 60, most)
        texts += [" ".join(base[:k]) for k in range(size - 8, size)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = joined(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got == jaccard_classes(rows)
    assert 20 < len({c for _, c in got.values()}) < len(rows)


def test_class_keys_meet_for_every_link():
    """Two sets at the limit share a key, whatever their size and the place of the difference."""
    rnd = np.random.default_rng(3)
    for n in [*range(9, 80), 333, 2000]:
        for _ in range(6):
            h = np.unique(rnd.integers(0, 1 << 63, n + n // 9, dtype=np.uint64))
            d = n // 9
            out = int(rnd.integers(0, d + 1))  # h[:n] loses `out` shingles and gains the rest of d
            a, b = h[:n], np.sort(np.concatenate([h[out:n], h[n:n + d - out]]))
            k = n - out
            if 100 * k >= 90 * (len(a) + len(b) - k):
                assert set(signature_trees.class_keys(a)) & set(signature_trees.class_keys(b)), (n, d, out)


def test_no_tree_link_is_discarded():
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    sets = [signature_trees.shingle_hashes(t) for t in family(rnd, base, 30, 6)]
    got = signature_trees.leaf_links(list(range(30)), sets, list(range(30)), sets, 90)
    united = reference.Sets()
    for a, b in got:
        united.join(a, b)
    want = reference.Sets()
    for a, b in itertools.combinations(range(30), 2):
        k = len(set(sets[a]) & set(sets[b]))
        if 100 * k >= 90 * (len(sets[a]) + len(sets[b]) - k):
            want.join(a, b)
    assert [united.find(i) for i in range(30)] == [want.find(i) for i in range(30)]


def test_signature_join_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, long), (7, long + " tail"), (None, long),
            (None, "lone words here"), (8, "a b c d"), (8, "another text of the same id"), (8, "a b c d"), (9, "one two three")]
    df = spark.createDataFrame([(i, t, "x", -1) for i, t in rows], "doc_id long, text string, keys string, cluster int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in signature_trees.near_copies(df).collect())
    assert got == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 1, 4): 1, (5, 1, 4): 1, (6, 29998, 6): 1,
                           (7, 29999, 6): 1, (None, 29998, 6): 1, (None, 1, None): 1, (8, 2, 8): 2, (8, 4, 8): 1, (9, 1, 9): 1})
    assert signature_trees.near_copies(df.limit(0)).collect() == []


# ------------------------------------------------------------------ filter interaction audit
def test_sketch_clears_unique_texts_only(spark):
    rows = [(i, i % 3, f"text {i}") for i in range(3000)] + [(9000 + i, 0, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, part int, text string").selectExpr("doc_id", "text", "xxhash64(text) AS h")
    for n_rows in (3100, (filter_audit.MAX_SLOTS // filter_audit.SLOTS_PER_ROW) * 3):
        if n_rows > 3100:  # three sketches, of a smaller size
            filter_audit.MAX_SLOTS, whole = 1 << 20, filter_audit.MAX_SLOTS
            n_rows = (1 << 20) // filter_audit.SLOTS_PER_ROW * 3
        left = {r.doc_id for r in filter_audit.possible_repeats(df, df, n_rows).collect()}
        assert {*range(100), *range(9000, 9100)} <= left and len(left) < 400
    filter_audit.MAX_SLOTS = whole


def test_filter_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None, "en"), (2, "", None), (3, long, "en"), (4, long, ""), (None, long, "en"), (5, "A#", "en"),
            (5, "A#", "en"), (6, "x " * 200, "fr"), (7, "A#", "fr")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, mask int, key string")
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    masks = Counter((r.doc_id, r.part, r.mask) for r in filter_audit.failure_masks(df).collect())
    assert masks == Counter({(1, "en", 1): 1, (2, "", 1 | 16): 1, (3, "en", 0): 1, (4, "", 16): 1, (None, "en", 0): 1,
                             (5, "en", 1 | 4 | 8): 2, (6, "fr", 2): 1, (7, "fr", 1 | 4 | 8 | 16): 1})
    out = filter_audit.audit_filters(df, labels).collect()
    assert len(out) == 3 * 600
    one = {(r.part, r.filter_order, r.step): r for r in out}
    first = one["en", "ABCDE", 1]
    assert (first.kept, first.removed, first.good_lost, first.toxic_lost, first.shapley) == (2, 3, 2, 2, 120 + 2 * 40)
    assert one["en", "CADBE", 2].redundant == 2 and one["en", "CADBE", 2].unique_fails == 1
    assert filter_audit.audit_filters(df.limit(0), labels).collect() == []
    assert len(filter_audit.audit_filters(df, labels.limit(0)).collect()) == 3 * 600


# ------------------------------------------------------------------ spelling variants
def one_letter_apart(v):
    """Pairs of words one edit apart, by shared one-letter deletions."""
    holders = defaultdict(set)
    for w in v:
        for i in range(len(w)):
            holders[i, w[:i] + w[i + 1:]].add(w)  # a replacement at place i
    near = defaultdict(set)
    for group in holders.values():
        for a in group:
            near[a] |= group - {a}
    for w in v:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            if short in v:
                near[w].add(short)
                near[short].add(w)
    return near


def spelling_groups(counts):
    near = one_letter_apart(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def spelling_counts(texts):
    out = Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 3}


def grouped(df):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_spelling_groups(docs, texts):
    got = grouped(spelling.group_spellings(docs))
    assert got == spelling_groups(spelling_counts(texts))
    assert any(f and r != f for f, r, *_ in got.values())


def test_spelling_of_dense_words(spark):
    """Words over two letters of lengths 1 to 7: every kind of edit at every place, repeated letters."""
    rnd = random.Random(4)
    counts = {"".join(w): rnd.randrange(1, 60) for n in range(1, 8) for w in itertools.product("aé", repeat=n) if rnd.random() < 0.7}
    counts |= {"z" * 24: 5, "z" * 25: 11, "z" * 22 + "yz": 2}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert grouped(spelling.variants(df)) == spelling_groups(counts)


def test_spelling_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "letter Letter LETTER"), (3, "lettér ÉCOLES École9" * 3), (4, "a b c 12345 .....")]
    rows += [(5, "x" * 5000 + " lettre lettres lettres lettres lettres")] * 3
    df = spark.createDataFrame([(*r, "w", 9) for r in rows], "doc_id long, text string, word string, n int")
    got = grouped(spelling.group_spellings(df))
    assert got == spelling_groups(spelling_counts(rows)) and "x" * 5000 in got
    assert spelling.group_spellings(df.limit(0)).collect() == []
