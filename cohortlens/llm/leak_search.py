"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of words (runs of letters, digits and non-ASCII characters, A-Z lower-cased). The CGK random
walk reads a window word by word: at every step it emits the word under its pointer, and a random
bit that depends on the step and on that word decides whether the pointer advances. Windows at
small edit distance give walks at small Hamming distance, since the pointers meet again soon
after an edit. Bit-sampling LSH takes a few steps of a walk as a key; ``walks``
with ``SAMPLES`` samples each find items at the edit limit with at least ``TARGET_RECALL``.

Windows are item-sized by class: an item of L words has window size w, the largest power of two
up to 2 L / 5 (1 at least). Documents are cut into windows of each size at every half
window, items at every word; so whatever a leaked passage's offset in its document, several
document windows inside it stand opposite one of the item's.

1. Items: (class, table, key) of all their windows: a small table, one row per key and item. A
   bitmap of ``BITMAP`` bits over the keys has a fixed size and goes to every task.
2. Documents: tasks compute their windows' keys and emit only those that the bitmap may know,
   with the window's place and bit sets of its words and word pairs. Text never leaves the task here.
3. Keys meet in an equi-join (a hot key is split by AQE). Windows that differ by more words and word pairs
   than their share of the edits allows are cut there, on the bit sets; per document the distinct (item, place) are kept.
4. Candidates are verified exactly, in texts read again behind a fixed-size bitmap of their documents: the smallest
   edit distance, in words, between the item and any passage of the document. An item is found if it is at
   most ``MAX_EDITS`` of its length.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import bit_plane, in_plane
from cohortlens.session import materialize, used_up

WALKS = 3  # for windows of up to 16 words
SAMPLES = 5
SAMPLE_STEPS = 5
TARGET_RECALL = 0.99  # of items with MAX_EDITS edits, per item length; tested
BITMAP = 1 << 25
MAX_EDITS = 0.2
PIECE = 1 << 20  # bytes hashed at a time
AT_ONCE = 1 << 13  # windows walked at a time: what a step reads and writes stays in the processor's cache
ROW_BITS = 1 << 26  # bits of the bitmap of documents with candidates, whatever their number
PAIR_SETS = 2  # longs of a window's set of word pairs
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def _word_bytes() -> np.ndarray:
    """Per byte: its lower-cased value if it may be in a word, else 0."""
    t = np.zeros(256, np.uint64)
    for b in range(256):
        if b >= 0x80 or chr(b).isalnum():
            t[b] = ord(chr(b).lower()) if b < 0x80 else b
    return t


WORD_BYTES = _word_bytes()


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR ** i and its inverses modulo 2 ** 64, for i < n."""
    up, down = np.full(n, FACTOR, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start byte of every word. A word's hash is a polynomial in its bytes, from
    differences of running sums; long data go in pieces cut between words."""
    raw = np.frombuffer(data, np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and WORD_BYTES[raw[end]]:
            end += 1
        v = WORD_BYTES[raw[at:end]]
        up, down = _powers(max(PIECE, 1 << int(len(v) + 1).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * up[:len(v)], dtype=np.uint64)])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], v != 0, [False]])))
        first, last = edge[::2], edge[1::2]
        hashes.append(_mix((total[last] - total[first]) * down[first]))
        starts.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def text_words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "surrogatepass"))[0]


def window_size(n_words: int) -> int:
    """The class of an item: the largest power of two up to two fifths of its words."""
    return 1 << max(0, (2 * n_words // 5).bit_length() - 1)


def walks(size: int) -> int:
    """Longer windows hold more edits: as many more walks as ``TARGET_RECALL`` needs."""
    return WALKS * max(1, size // 16)


@functools.lru_cache(maxsize=256)
def _plan(size: int, walk: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """A walk's random bits per step, and the sampled steps and salt of each table."""
    rng = np.random.default_rng([size, walk, 20240229])
    steps = 2 * size
    salt = rng.integers(0, 1 << 63, steps, dtype=np.uint64)
    picks = [np.sort(rng.choice(steps, min(SAMPLE_STEPS, steps), replace=False)) for _ in range(SAMPLES)]
    return salt, picks, rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def _walk_keys(words: np.ndarray, starts: np.ndarray, size: int, out: np.ndarray) -> None:
    """``window_keys`` of a run of windows into ``out``, step by step in place."""
    at, word, end = np.empty(len(starts), np.int64), np.empty(len(starts), np.uint64), starts + size
    factor = np.uint64(FACTOR)
    for walk in range(walks(size)):
        salt, picks, seeds = _plan(size, walk)
        keys = out[walk * SAMPLES:(walk + 1) * SAMPLES]
        keys[:] = seeds[:, None]
        taken = [set(p.tolist()) for p in picks]
        last = max(int(p[-1]) for p in picks)
        at[:] = starts
        for step in range(last + 1):
            np.take(words, at, out=word, mode="clip")
            if step >= size:  # the pointer may have left the window
                word[at >= end] = 0
            for key, steps in zip(keys, taken):
                if step in steps:
                    np.bitwise_xor(key, word, out=key)
                    np.multiply(key, factor, out=key)
            if step < last:
                np.bitwise_xor(word, salt[step], out=word)
                np.multiply(word, factor, out=word)
                np.right_shift(word, np.uint64(63), out=word)
                np.add(at, word.view(np.int64), out=at)
        for k, key in enumerate(keys):
            keys[k] = _mix(key)


def window_keys(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The LSH keys, one row per table, of the windows of ``size`` words at ``starts``."""
    out = np.empty((walks(size) * SAMPLES, len(starts)), np.uint64)
    for first in range(0, len(starts), AT_ONCE):
        run = slice(first, first + AT_ONCE)
        _walk_keys(words, starts[run], size, out[:, run])
    return out


def best_passage(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """``(edits, start, end)`` of the passage of ``text`` closest to ``item`` in word edits; of
    equally close ones the first to end, then the shortest."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        ramp = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else ramp.copy()
        for i, x in enumerate(a, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
            row = np.minimum.accumulate(new - ramp) + ramp
        return row

    ends = last_row(item, text, True)
    end = int(np.argmin(ends))
    back = last_row(item[::-1], text[:end][::-1], False)
    return int(ends[end]), end - int(np.argmin(back)), end


def window_sets(words: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """Bit sets of the windows: one long of their words, ``PAIR_SETS`` of their word pairs."""
    at = starts[:, None] + np.arange(size)
    w = words[at]
    one = np.uint64(1)
    out = [np.bitwise_or.reduce(one << (w >> np.uint64(58)), axis=1)]
    pair = _mix(w[:, :-1] * np.uint64(FACTOR) + w[:, 1:])
    bit, which = one << (pair & np.uint64(63)), (pair >> np.uint64(32)) % np.uint64(PAIR_SETS)
    return out + [np.bitwise_or.reduce(np.where(which == k, bit, np.uint64(0)), axis=1) for k in range(PAIR_SETS)]


def window_edits(size: int) -> int:
    """Edits allowed in a window: its share of the most edits, rounded up; some window of a passage has no more."""
    return -int(-MAX_EDITS * size // 1)


def _alike(size: str) -> str:
    """SQL: may windows with sets b0.. and c0.. be as few edits apart? An edit takes at most one word and two pairs."""
    most = f"cast(ceil({MAX_EDITS} * {size}) as int)"
    pairs = {(x, y): " + ".join(f"bit_count({x}{k} & ~{y}{k})" for k in range(1, PAIR_SETS + 1)) for x, y in (("b", "c"), ("c", "b"))}
    return " and ".join([f"bit_count({x}0 & ~{y}0) <= {most} and {lost} <= 2 * {most}" for (x, y), lost in pairs.items()])


def intervals(places: list[int], reach: int) -> list[tuple[int, int]]:
    """Sorted places to runs ``(first, last)`` whose gaps are at most ``reach``."""
    out: list[list[int]] = []
    for p in places:
        if out and p - out[-1][1] <= reach:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def closest_passage(item: np.ndarray, text: np.ndarray, places, most: int) -> tuple[int, int, int] | None:
    """The closest passage of at most ``most`` edits that begins near one of ``places``, or none.

    A passage within the limit lies at most that far beside its place. It holds all but that many of the item's words and all
    but twice as many of its word pairs; this is tested first, as it needs no alignment.
    """
    best = None
    own, own_pairs = set(item.tolist()), set(zip(item[:-1].tolist(), item[1:].tolist()))
    for first, last in intervals(sorted(places), most + 1):
        low, high = max(0, first - most - 1), min(len(text), last + len(item) + most + 1)
        if high <= low:
            continue
        here = text[low:high].tolist()
        if len(own.difference(here)) > most or len(own_pairs.difference(zip(here, here[1:]))) > 2 * most:
            continue
        edits, start, end = best_passage(item, text[low:high])
        if edits <= most and (best is None or edits < best[0]):
            best = (edits, low + start, low + end)
            if not edits:
                break
    return best


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


SETS = [*range(PAIR_SETS + 1)]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``(item_id, words, size, key, offset, c0..)``: the keys of every window of every item; words are the item's word hashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, text in zip(f["item_id"], f["text"]):
                words = text_words(text)
                if not len(words):
                    continue
                size = window_size(len(words))
                starts = np.arange(len(words) - size + 1)
                keys = window_keys(words, starts, size)
                sets = window_sets(words, starts, size)
                yield pd.DataFrame({"item_id": i, "words": pd.Series([_signed(words)] * keys.size, dtype=object), "size": size,
                                    "key": _signed(keys.ravel()), "offset": np.tile(starts, len(keys)),
                                    **{f"c{k}": _signed(np.tile(sets[k], len(keys))) for k in SETS}})

    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"),
                             benchmark["text"].cast("string").alias("text")).where("item_id is not null").distinct()
    return items.mapInPandas(run, "item_id long, words array<long>, size int, key long, offset int, " + ", ".join(f"c{k} long" for k in SETS))


def _rows(docs: DataFrame) -> DataFrame:
    """``(none, doc, row, text)``: none tells that there is no doc_id; row is a hash of doc_id and text, which tells the
    rows of one doc_id (or of none) apart."""
    doc, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    return docs.select(doc.isNull().alias("none"), F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64(doc, text).alias("row"), text.alias("text"))


def _document_windows(rows: DataFrame, plane, sizes: list[int]) -> DataFrame:
    """``(none, doc, row, key, size, at, b0..)``: the document windows whose key the bitmap may know."""

    def batch(f: pd.DataFrame, bits: np.ndarray) -> Iterator[pd.DataFrame]:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in f["text"]]
        words, where = word_hashes(b"\n".join(data))
        border = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
        edge = np.searchsorted(where, border)
        length = np.diff(edge)
        none, doc, row = (f[c].to_numpy() for c in ("none", "doc", "row"))
        for size in sizes:
            stride = max(1, size // 2)
            n = np.where(length >= size, (length - size) // stride + 1, 0)
            owner = np.repeat(np.arange(len(n)), n)
            local = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride
            keys = window_keys(words, edge[owner] + local, size)
            hit = np.stack([in_plane(bits, (key & np.uint64(BITMAP - 1)).view(np.int64)) for key in keys])
            _, w = np.nonzero(hit)
            sets = window_sets(words, edge[owner[w]] + local[w], size)
            yield pd.DataFrame({"none": none[owner[w]], "doc": doc[owner[w]], "row": row[owner[w]], "key": _signed(keys[hit]),
                                "size": size, "at": local[w], **{f"b{k}": _signed(sets[k]) for k in SETS}})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = f["text"].str.len().fillna(0).cumsum().to_numpy()
            cut = np.searchsorted(size, np.arange(0, size[-1] + 1, PIECE)) if len(size) else []
            for a, b in zip(cut, [*cut[1:], len(f)]):
                if b > a:
                    yield from batch(f.iloc[a:b], plane.value)

    return rows.mapInPandas(run, "none boolean, doc long, row long, key long, size int, at int, " + ", ".join(f"b{k} long" for k in SETS))


ROW = ["none", "doc", "row"]


def _found(docs: DataFrame, benchmark: DataFrame, max_edits: float) -> DataFrame:
    """``(none, doc, row, item_id, start_word, end_word, edits, item_words)`` per row and item text found in it."""
    spark = docs.sparkSession
    windows = materialize(item_windows(benchmark), "item_windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # one per power of two
    rows = _rows(docs)
    hits = _document_windows(rows, spark.sparkContext.broadcast(bit_plane(windows, F.pmod("key", F.lit(BITMAP)), BITMAP)), sizes)
    met = materialize(hits.join(windows.drop("words"), ["key", "size"]).where(_alike("size"))
                      .select(*ROW, "item_id", (F.col("at") - F.col("offset")).alias("at")).distinct(), "leak_candidates")
    # the candidates' texts: rows behind a bitmap, so that no other text is shuffled
    wanted = spark.sparkContext.broadcast(bit_plane(met, F.pmod("row", F.lit(ROW_BITS)), ROW_BITS))

    def likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[in_plane(wanted.value, f["row"].to_numpy() % ROW_BITS)]

    texts = rows.mapInPandas(likely, rows.schema)
    places = met.groupBy(*ROW, "item_id").agg(F.collect_set("at").alias("places"))
    items = windows.select("item_id", "words").distinct()
    of_row = places.join(items, "item_id").groupBy(*ROW).agg(F.collect_list(F.struct("item_id", "words", "places")).alias("items"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for none, doc, row, candidates, text in zip(*[f[c] for c in (*ROW, "items", "text")]):
                words = text_words(text)
                for c in candidates:
                    item = np.array(c["words"], np.int64).view(np.uint64)
                    best = closest_passage(item, words, c["places"], int(max_edits * len(item)))
                    if best:
                        out.append((none, doc, row, c["item_id"], *best[1:], best[0], len(item)))
            yield pd.DataFrame(out, columns=[*ROW, "item_id", "start_word", "end_word", "edits", "item_words"])

    return (of_row.join(texts, ROW).select(*ROW, "items", "text").mapInPandas(
        verify, "none boolean, doc long, row long, item_id long, start_word int, end_word int, edits int, item_words int"))


def find(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """One row per document and benchmark item found in it: ``doc_id, item_id, start_word,
    end_word, edits, item_words`` (the closest passage, words counted from 0, end exclusive).

    Null and wordless items and texts never match; rows without item_id are ignored; repeated
    rows give one result, as do repeated items of one item_id and rows of one doc_id; rows without a doc_id are documents of
    their own where their texts differ; of equally close passages the first to end counts; empty tables give an empty
    result; extra columns are ignored. ``max_edits`` may be at most ``MAX_EDITS``, for which the keys are made.
    """
    if max_edits > MAX_EDITS:
        raise ValueError(f"the keys are made for at most {MAX_EDITS} edits a word")
    found = _found(docs, benchmark, max_edits).withColumn("own", F.when(F.col("none"), F.col("row")))
    first = F.min(F.struct("edits", "end_word", "start_word", "item_words")).alias("x")
    return (found.groupBy("none", "doc", "own", "item_id").agg(first)
            .select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "item_id", "x.start_word", "x.end_word",
                    "x.edits", "x.item_words"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """``docs`` without the rows in which a benchmark item is found; other rows of their doc_id (or without one) stay."""
    with used_up() as keep:
        gone = keep(materialize(_found(docs, benchmark, max_edits).select(*[F.col(c).alias(f"_{c}") for c in ROW]).distinct(), "gone"))
    doc = docs["doc_id"].cast("long")
    same = ((F.xxhash64(doc, docs["text"].cast("string")) == gone["_row"]) & (F.coalesce(doc, F.lit(0)) == gone["_doc"])
            & (doc.isNull() == gone["_none"]))
    return docs.join(gone, same, "left_anti")
