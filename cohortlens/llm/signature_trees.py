"""N-gram Jaccard join with signature trees.

A document's set is its distinct word shingles, as 64-bit hashes; equal sets are one node. Two sets
link at Jaccard similarity 0.9 or more.

**Roots.** A bitmap of thousands of unrelated sets is full and prunes nothing, so the top of the hierarchy
is exact in place of a bitmap: trees are only built over sets that could be linked at all. Linked sets
with the smaller one of n shingles differ in at most n / 9 of them. Within a band of sizes the
hash space is dealt into classes, ``SPARE`` more than the most that can differ and one, so linked sets
have at least ``SPARE`` + 1 classes with the very same shingles, one of which is not empty unless
both sets have more than ``SPARE`` empty classes (those are filed under each combination of so
many empty classes as well). Sets that share a class's content are joined; the components of that
relation are the clusters, and each set is in at most one tree.

**Trees.** A set's path is a row of six-bit digits: its size, two of its MinHash values, then its id. A
node with up to ``LEAF`` sets is a leaf; any other has up to 64 children. Nodes hold the
OR of their sets' token bitmaps, the range of set sizes, the fewest bits of a set and the most tokens that
a set has beyond its bits.

**Dual traversal.** First every leaf is joined with itself, every set with the best of its cluster, and every node's best
set with the best of its parent, where the best shares class contents with most others (as an original does with its
copies): a number of tests linear in the sets, which unites most groups of copies. Then the clusters that are not
one class yet get a tree in which the class so far comes first, and pairs of nodes are followed from (root, root) to pairs of leaves. A pair is
discarded if sizes alone exclude a link, if the maximum possible overlap
min(max size, slack + bits in both bitmaps) is too small, or if both hold one and the same class only. Pairs
of leaves are joined by the same bound per pair of sets, then exactly on the hashes.

Texts never move: they are read once for the class contents and once more, behind a fixed-size
bitmap of wanted rows, for the hashes of sets that are in a cluster.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import bit_plane, columns, in_plane
from cohortlens.llm.components import components
from cohortlens.session import materialize

SHINGLE = 3
PERCENT = 90
SPARE = 2
BAND_GROWTH = 1.25
LEAF = 16
DIGITS, DIGIT = 10, 6  # digits of a path, bits of a digit
MIN_HASHES, CLASS_DIGITS = 2, 2
BITS_PER_TOKEN = 8
MIN_BITS = 512
WANTED_BITS = 1 << 26
_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED2701 * i) for i in range(MIN_HASHES + 2)]


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z lower-cased, words between ASCII white space; fewer
    words than ``shingle``: the whole sequence; none: an empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = {b" ".join(words)} if len(words) <= shingle else set(map(b" ".join, zip(*[words[i:] for i in range(shingle)])))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g) for g in grams), np.uint64, len(grams))
    h.sort()
    return h


def max_difference(n: int, percent: int = PERCENT) -> int:
    """Most shingles in which a set of n may differ from a linked set that is not smaller."""
    return n * (100 - percent) // percent


def bands(most: int, percent: int = PERCENT) -> np.ndarray:
    """First sizes of the bands up to ``most``; smaller sets link with equal ones only."""
    starts, low = [], 100 // (100 - percent) - 1
    while low <= most:
        starts.append(low)
        low = int(low * BAND_GROWTH) + 1
    return np.array(starts, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def class_keys(h: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of one set's class contents, in its own band and in those of smaller sets it may link with."""
    n = len(h)
    starts = bands(n, percent)
    first = np.searchsorted(starts, -(-n * percent // 100), "right") - 1
    keys = []
    for band in range(max(first, 0), len(starts)):
        last_size = int(starts[band] * BAND_GROWTH)
        count = max_difference(last_size, percent) + 1 + SPARE
        dealt = _mix(h * _ODD[0] + np.uint64(band))
        of_class = ((dealt >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        order = np.argsort(of_class, kind="stable")
        of_class = of_class[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], np.diff(of_class) != 0]))
        content = np.add.reduceat(_mix(dealt[order] * _ODD[1]), at)
        salt = np.uint64(band * 1_000_003)
        keys.append(_mix(content + _mix((of_class[at] + 1).astype(np.uint64) * _ODD[0] + salt)))
        empty = sorted(set(range(count)) - set(of_class[at].tolist()))
        for c in itertools.combinations(empty, SPARE + 1):
            keys.append(np.array([xxhash.xxh64_intdigest(repr((band, c)).encode())], np.uint64))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def path_of(h: np.ndarray, set_id: int) -> int:
    """The set's place in its tree: ``DIGITS`` digits of ``DIGIT`` bits, the first in the highest."""
    digits = [int(np.log(len(h)) / 0.05) % (1 << DIGIT)]
    digits += [int(_mix(np.array([(h * o).min()]))[0]) >> 64 - DIGIT for o in _ODD[:MIN_HASHES]]
    rest = xxhash.xxh64_intdigest(int(set_id).to_bytes(8, "little", signed=True))
    digits += [rest >> DIGIT * i & (1 << DIGIT) - 1 for i in range(DIGITS - len(digits))]
    return sum(d << DIGIT * (DIGITS - 1 - i) for i, d in enumerate(digits))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _objects(values) -> pd.Series:
    return pd.Series(list(values), dtype=object)


def _rows(docs: DataFrame) -> DataFrame:
    """``id, row, text``: row tells rows apart by doc_id and text; id is the doc_id as a string, which
    pandas keeps exact beside missing ones."""
    d = columns(docs, doc_id="long", text="string")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64("doc_id", "text").alias("row"), "text")


def document_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, row, n, name, keys`` per row: the set's size, its 128-bit name and its class keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [shingle_hashes(t, shingle) for t in f["text"]]
            yield pd.DataFrame({"id": f["id"].to_numpy(), "row": f["row"].to_numpy(), "n": [len(h) for h in sets],
                                "name": _objects(xxhash.xxh128_digest(h.tobytes()) for h in sets),
                                "keys": _objects(_signed(class_keys(h, percent)) for h in sets)})

    out = _rows(docs).mapInPandas(run, "id string, row long, n long, name binary, keys array<long>")
    return out.select(F.col("id").cast("long").alias("doc_id"), "row", "n", "name", "keys")


def clusters(nodes: DataFrame) -> DataFrame:
    """``nodes(id, keys)`` to ``(id, cluster, score)`` of the sets that share a key with another, transitively; the
    score is the number of shared keys, each as often as there are sets that have it."""
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = materialize(keyed.join(shared, "key").select("id", "first", "n"), "shared_keys")
    score = met.groupBy("id").agg(F.sum("n").alias("score"))
    edges = met.where("id <> first").select(F.col("id").alias("src"), F.col("first").alias("dst"))
    return components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(score, "id")


def clustered_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``wanted(id, cluster, score, name, row)`` to ``id, cluster, score, path, hashes``, read again from the texts."""
    plane = docs.sparkSession.sparkContext.broadcast(bit_plane(wanted, F.pmod("row", F.lit(WANTED_BITS)), WANTED_BITS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[in_plane(plane.value, f["row"].to_numpy() % WANTED_BITS)]
            sets = [shingle_hashes(t, shingle) for t in f["text"]]
            yield pd.DataFrame({"row": f["row"].to_numpy(), "name": _objects(xxhash.xxh128_digest(h.tobytes()) for h in sets),
                                "hashes": _objects(_signed(h) for h in sets)})

    read = _rows(docs).mapInPandas(run, "row long, name binary, hashes array<long>")

    @F.pandas_udf("long")
    def place(hashes: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([path_of(np.array(h, np.int64).view(np.uint64), i) for h, i in zip(hashes, ids)], dtype="int64")

    one = read.join(wanted, ["row", "name"]).groupBy("id", "cluster", "score").agg(F.first("hashes").alias("hashes"))
    return one.select("id", "cluster", "score", place("hashes", "id").alias("path"), "hashes")


def _prefix(path: str, depth: str) -> Column:
    return F.expr(f"shiftright({path}, {DIGIT} * ({DIGITS} - {depth}))")


def tree_nodes(sets: DataFrame) -> DataFrame:
    """``cluster, depth, prefix, n, best, leaf`` of all nodes: those with more than ``LEAF`` sets and
    their children; best is the set of the highest score (ties: smallest id)."""
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("of_cluster"))
    below = (sets.select("id", "cluster", "score", "path").join(sizes, "cluster")
             .select("id", "cluster", "score", "path", F.explode(F.expr(
                 f"sequence(0, if(of_cluster > {LEAF}, {DIGITS}, 0))")).alias("depth"))
             .groupBy("cluster", "depth", _prefix("path", "depth").alias("prefix"))
             .agg(F.count("*").alias("n"), F.min(F.struct(-F.col("score"), F.col("id").alias("id"))).alias("best"))
             .withColumn("best", F.col("best.id")))
    below = materialize(below.withColumn("leaf", (F.col("n") <= LEAF) | (F.col("depth") == DIGITS)), "prefixes")
    inner = below.where("not leaf").select("cluster", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    child = below.withColumn("up", F.shiftright("prefix", DIGIT)).join(inner, ["cluster", "depth", "up"], "left_semi").drop("up")
    return below.where("depth = 0").unionByName(child)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    k = int((large[at] == small).sum())
    return 100 * k >= percent * (len(a) + len(b) - k)


def _bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(sets), width // 8), np.uint8)
    for row, h in zip(out, sets):
        bit = (h & np.uint64(width - 1)).astype(np.int64)
        np.bitwise_or.at(row, bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8))
    return out


def _width(n: int) -> int:
    return max(MIN_BITS, 1 << (BITS_PER_TOKEN * max(n, 1) - 1).bit_length())


def leaf_links(ids_a, sets_a, ids_b, sets_b, percent: int) -> list[tuple[int, int]]:
    """Links between the sets of two leaves (or of one with itself), which hold ``LEAF`` sets each at
    most: the overlap bound per pair, then the exact test; pairs that are united already are passed."""
    width = _width(max(len(h) for h in (*sets_a, *sets_b)))
    bits_a, bits_b = _bitmaps(sets_a, width), _bitmaps(sets_b, width)
    count_a, count_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (bits_a, bits_b))
    parent = {i: i for i in (*ids_a, *ids_b)}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    out = []
    same = ids_a is ids_b
    for x in range(len(ids_a)):
        for y in range(x + 1 if same else 0, len(ids_b)):
            n, m = len(sets_a[x]), len(sets_b[y])
            both = int(np.bitwise_count(bits_a[x] & bits_b[y]).sum())
            most = min(n, m, n - int(count_a[x]) + both, m - int(count_b[y]) + both)
            if (100 + percent) * most < percent * (n + m):
                continue
            a, b = top(ids_a[x]), top(ids_b[y])
            if a != b and _linked(sets_a[x], sets_b[y], percent):
                parent[b] = a
                out.append((ids_a[x], ids_b[y]))
    return out


def _unpacked(sets) -> tuple[list[int], list[np.ndarray]]:
    return [int(s["id"]) for s in sets], [np.array(s["hashes"], np.int64).view(np.uint64) for s in sets]


def _join_leaves(pairs: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` of two leaves' sets (b null: the leaf itself) to links ``src, dst``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            links = []
            for a, b in zip(f["a"], f["b"]):
                ids, sets = _unpacked(a)
                ids_b, sets_b = (ids, sets) if b is None else _unpacked(b)
                links += leaf_links(ids, sets, ids_b, sets_b, percent)
            yield pd.DataFrame(links, columns=["src", "dst"])

    return pairs.mapInPandas(run, "src long, dst long")


def _leaves(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cluster, depth, prefix, sets``: the leaves with their sets."""
    big = nodes.where("leaf and depth > 0").groupBy("cluster").agg(
        F.collect_set("depth").alias("depths"))  # at most DIGITS
    at = (sets.join(big, "cluster", "left")
          .withColumn("depth", F.explode(F.coalesce("depths", F.array(F.lit(0)))))
          .withColumn("prefix", _prefix("path", "depth")))
    return (at.join(nodes.where("leaf").select("cluster", "depth", "prefix"), ["cluster", "depth", "prefix"])
            .groupBy("cluster", "depth", "prefix").agg(F.collect_list(F.struct("id", "hashes")).alias("sets")))


def _signatures(leaves: DataFrame, nodes: DataFrame, widths: DataFrame) -> DataFrame:
    """``nodes`` with ``bits, low, high, fewest, slack``, OR-combined bottom-up; a node is combined from its at most
    64 children, a leaf from its at most ``LEAF`` sets."""
    schema = ("cluster long, depth int, prefix long, bits binary, low long, high long, fewest long, slack long")

    def of_leaf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for c, d, p, w, s in zip(f["cluster"], f["depth"], f["prefix"], f["width"], f["sets"]):
                _, sets = _unpacked(s)
                bits, n = _bitmaps(sets, int(w)), [len(h) for h in sets]
                count = np.bitwise_count(bits).sum(1, dtype=np.int64)
                rows.append((c, d, p, np.bitwise_or.reduce(bits).tobytes(), min(n), max(n), count.min(),
                             (np.array(n) - count).max()))
            yield pd.DataFrame(rows, columns=["cluster", "depth", "prefix", "bits", "low", "high", "fewest", "slack"])

    def of_node(f: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in f["bits"]])
        one = f.iloc[:1]
        return pd.DataFrame({"cluster": one["cluster"], "depth": one["depth"] - 1, "prefix": one["prefix"] // (1 << DIGIT),
                             "bits": [bits.tobytes()], "low": f["low"].min(), "high": f["high"].max(),
                             "fewest": f["fewest"].min(), "slack": f["slack"].max()})

    leaf = materialize(leaves.join(widths, "cluster").mapInPandas(of_leaf, schema), "signatures")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    level, done = leaf.where(F.col("depth") == deepest), leaf
    for depth in range(deepest, 0, -1):
        up = materialize(level.groupBy("cluster", "depth", F.shiftright("prefix", DIGIT)).applyInPandas(of_node, schema),
                         "signatures")
        done = done.unionByName(up)
        level = up.unionByName(leaf.where(F.col("depth") == depth - 1))
    return nodes.join(done, ["cluster", "depth", "prefix"])


def _possible(percent: int):
    """A mapInPandas function that keeps the node pairs whose maximum possible overlap allows a link."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            both = np.array([int(np.bitwise_count(np.frombuffer(a, np.uint8) & np.frombuffer(b, np.uint8)).sum())
                             for a, b in zip(f["bits_a"], f["bits_b"])], np.int64)
            most = np.minimum.reduce([f["high_a"], f["high_b"], f["slack_a"] + both, f["slack_b"] + both])
            keep = (100 + percent) * most >= percent * (f["low_a"] + f["low_b"])
            yield f.loc[keep.to_numpy() if hasattr(keep, "to_numpy") else keep, ["cluster", "a", "b"]]

    return run


def _traverse(nodes: DataFrame, percent: int) -> DataFrame:
    """``nodes(node, up, cluster, leaf, bits, low, high, fewest, slack, one)`` to the pairs of leaves
    ``(cluster, a, b)``, a < b, that may hold a link; one: the only class of the node's sets, or null."""
    child = nodes.select("cluster", "node", "up", "leaf", "low", "high", "one")
    stay = nodes.where("leaf").select("cluster", "node", F.col("node").alias("up"), "leaf", "low", "high", "one")
    step = child.where("up is not null").unionByName(stay)
    left = step.select("cluster", *[F.col(c).alias(c + "_a") for c in ("node", "up", "leaf", "low", "high", "one")])
    right = step.select("cluster", *[F.col(c).alias(c + "_b") for c in ("node", "up", "leaf", "low", "high", "one")])
    bits = nodes.select("cluster", "node", "bits", "low", "high", "slack")
    of = {s: bits.select("cluster", F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("bits", "low", "high", "slack")])
          for s in "ab"}
    pairs = nodes.where("up is null").select("cluster", F.col("node").alias("a"), F.col("node").alias("b"), "leaf")
    ended = None
    while True:
        if pairs.isEmpty():
            return ended if ended is not None else pairs.select("cluster", "a", "b")
        met = (pairs.select("cluster", F.col("a").alias("up_a"), F.col("b").alias("up_b")).join(left, ["cluster", "up_a"])
               .join(right, ["cluster", "up_b"])
               .where("up_a <> up_b or node_a < node_b or (node_a = node_b and not leaf_a)")
               .where("not coalesce(one_a = one_b, false)")
               .where(f"100 * least(high_a, high_b) >= {percent} * greatest(low_a, low_b)")
               .select("cluster", F.col("node_a").alias("a"), F.col("node_b").alias("b"),
                       (F.col("leaf_a") & F.col("leaf_b")).alias("leaf")))
        tested = met.where("a <> b").select("cluster", "a", "b").join(of["a"], ["cluster", "a"]).join(of["b"], ["cluster", "b"])
        kept = tested.mapInPandas(_possible(percent), "cluster long, a long, b long")
        pairs = materialize(met.where("a = b").unionByName(met.where("a <> b").join(kept, ["cluster", "a", "b"], "left_semi")),
                            "node_pairs")
        out = pairs.where("leaf and a <> b").select("cluster", "a", "b")
        ended = out if ended is None else ended.unionByName(out)
        pairs = pairs.where("not leaf")


def _join_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs(src, dst)``; there are few different ``dst``."""
    one = F.array(F.struct("id", "hashes"))
    left = sets.select(F.col("id").alias("src"), one.alias("a"))
    right = sets.join(pairs.select(F.col("dst").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("dst"), one.alias("b"))
    return _join_leaves(pairs.join(right, "dst").join(left, "src").select("a", "b"), percent)


def set_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``sets(id, cluster, score, path, hashes)`` to links ``(src, dst)`` that connect all linked sets."""
    nodes = materialize(tree_nodes(sets), "tree")
    leaves = materialize(_leaves(sets, nodes), "leaves", compression="zstd")
    own = leaves.where(F.size("sets") > 1).select(F.col("sets").alias("a"), F.lit(None).cast(leaves.schema["sets"].dataType).alias("b"))
    near = materialize(_join_leaves(own, percent), "links")
    big = nodes.where("depth = 0 and not leaf").select("cluster", "best")
    if big.isEmpty():
        return near
    large = sets.join(big.select("cluster"), "cluster", "left_semi")
    tree = nodes.join(big.select("cluster"), "cluster", "left_semi")
    parents = tree.select("cluster", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("best").alias("dst"))
    ladder = (tree.withColumn("up", F.shiftright("prefix", DIGIT)).join(parents, ["cluster", "depth", "up"])
              .select(F.col("best").alias("src"), "dst"))
    star = large.select("cluster", F.col("id").alias("src")).join(big, "cluster").select("src", F.col("best").alias("dst"))
    steps = materialize(ladder.union(star).where("src <> dst").distinct(), "steps")
    near = near.unionByName(materialize(_join_sets(steps, large, percent), "links"))
    classes = components(near).select(F.col("node").alias("id"), "component")
    members = materialize(large.select("id", "cluster").join(classes, "id", "left")
                          .select("id", "cluster", F.coalesce("component", "id").alias("class")), "members")
    open_ = members.groupBy("cluster").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    if open_.isEmpty():
        return near
    # the class so far comes first in the paths, so that few nodes hold several classes
    high = DIGIT * (DIGITS - CLASS_DIGITS)
    by_class = F.shiftleft(F.pmod(F.xxhash64("class"), F.lit(1 << DIGIT * CLASS_DIGITS)), high)
    again = materialize(large.join(members.join(open_.select("cluster"), "cluster", "left_semi").drop("cluster"), "id")
                        .withColumn("path", by_class.bitwiseOR(F.shiftright("path", DIGIT * CLASS_DIGITS))), "open_sets", compression="zstd")
    held = (again.select("cluster", "path", "class", F.explode(F.sequence(F.lit(0), F.lit(DIGITS))).alias("depth"))
            .groupBy("cluster", "depth", _prefix("path", "depth").alias("prefix"))
            .agg(F.min("class").alias("low_class"), F.max("class").alias("high_class")))
    held = tree_nodes(again).join(held, ["cluster", "depth", "prefix"])
    held = materialize(held.withColumn("one", F.when(F.col("low_class") == F.col("high_class"), F.col("low_class")))
                       .drop("low_class", "high_class").withColumn("node", F.monotonically_increasing_id()), "held")
    leaves = materialize(_leaves(again, held), "leaves", compression="zstd")
    width = F.udf(_width, "long")
    widths = again.groupBy("cluster").agg(F.max(F.size("hashes")).alias("n")).select("cluster", width("n").alias("width"))
    signed = _signatures(leaves, held, widths)
    parent = held.select("cluster", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("p"), F.col("node").alias("up"))
    signed = materialize(signed.withColumn("p", F.shiftright("prefix", DIGIT)).join(parent, ["cluster", "depth", "p"], "left"), "signed")
    pairs = materialize(_traverse(signed, percent), "leaf_pairs")
    full = held.where("leaf").join(leaves, ["cluster", "depth", "prefix"]).select("cluster", "node", "sets")
    both = (pairs.join(full.select("cluster", F.col("node").alias("a"), F.col("sets").alias("sa")), ["cluster", "a"])
            .join(full.select("cluster", F.col("node").alias("b"), F.col("sets").alias("sb")), ["cluster", "b"])
            .select(F.col("sa").alias("a"), F.col("sb").alias("b")))
    mixed = full.join(held.where("one is null").select("cluster", "node"), ["cluster", "node"]).select(
        F.col("sets").alias("a"), F.lit(None).cast(leaves.schema["sets"].dataType).alias("b"))
    return near.unionByName(materialize(_join_leaves(both.unionByName(mixed), percent), "links"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row.

    component_id is the smallest doc_id reachable over links of at least ``percent`` per cent Jaccard
    similarity, the document's own included. Documents without a word have no shingles and are linked with
    nothing; repeated rows and equal texts have one set; a row without doc_id takes no part in the
    minimum (its component_id is that of the others, or null); rows of one doc_id are linked by
    their texts only; an empty table gives an empty result; extra columns are ignored.
    """
    rows = materialize(document_sets(docs, shingle, percent), "sets")
    nodes = materialize(rows.where("n > 0").groupBy("name").agg(
        F.min("doc_id").alias("first_doc"), F.min("row").alias("row"), F.first("keys").alias("keys"))
        .withColumn("id", F.monotonically_increasing_id()), "nodes")
    cluster = materialize(clusters(nodes), "clusters")
    wanted = materialize(nodes.select("id", "name", "row").join(cluster, "id"), "wanted")
    sets = materialize(clustered_sets(docs, wanted, shingle), "hashes", compression="zstd")
    classes = components(set_links(sets, percent))
    named = nodes.select("id", "name", "first_doc").join(classes.withColumnRenamed("node", "id"), "id", "left").select(
        "name", "first_doc", F.coalesce("component", "id").alias("class"))
    named = materialize(named, "classes")
    smallest = named.groupBy("class").agg(F.min("first_doc").alias("component_id"))
    linked = rows.where("n > 0").select("doc_id", "n", "name").join(named.join(smallest, "class").select("name", "component_id"), "name")
    return (linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
            .unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))


def near_copies_sql(shingle: int = SHINGLE, percent: int = PERCENT) -> str:
    """The same by definition in DuckDB's SQL, over ``documents``: all pairs that share a shingle are counted."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(shingle))
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - {shingle - 2}), lambda i: {run}) END) AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
           GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
          WHERE 100 * k >= {percent} * (p.n + q.n - k)),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM sizes UNION SELECT steps.y, reach.other FROM reach JOIN steps ON steps.x = reach.node),
least_id AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id FROM sizes JOIN least_id ON node = doc_id"""
