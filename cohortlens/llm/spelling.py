"""Spelling variants: words one edit apart, found by walking a trie as a relational frontier.

The trie is a table of edges ``(depth, node, ch, child)``, one per prefix that the vocabulary has
(nodes are named by depth and a 64-bit hash of the prefix). A frontier row is a state
``(word, position, node, edits)``: the word's first ``position`` letters have been matched with the
prefix of ``node`` at the cost of ``edits`` edits. Level by level the frontier is joined with the
edges that leave its nodes:

* the edge's letter is the word's next letter: both move on, no edit;
* it is another letter, and no edit is used yet: the letter replaces the word's next one, or it
  is inserted before it. A deletion is an insertion seen from the other word, and a replacement is
  walked from the smaller letter only.

A state with one edit that has used up its word at a node where a word ends is a pair of near
words.

Near the root every letter branches and nothing can be told apart yet, so edits are only walked in a
word's second half: a word enters the frontier at the node of its first half. Edits in the first
half are the second-half edits of the reversed words, which have a trie of their own.

Edges carry what lies below them: the number of words, the lengths that are left, the letters of the
next three places as 64-bit sets; states that cannot end are not written. Below a node with one
word nothing is walked: the rest of the two words is compared at once, so the levels are those where
words branch, not all letters of the longest word. The edges of a level are one partition of the edge table;
the planner broadcasts them if their files are small enough, and joins by node otherwise, where a
node has few states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import ascii_lower
from cohortlens.session import materialize, scratch_path

LETTERS = r"A-Za-zÀ-ÿ"
MIN_LETTERS = 5
MIN_COUNT = 3
PLANTED_ONE_IN = 97
RATIO = 2
AHEAD = 3  # places whose letters an edge knows


def vocabulary(docs: DataFrame, one_in: int = PLANTED_ONE_IN) -> DataFrame:
    """``(word, n)``: runs of letters of all texts, A-Z lower-cased; where ``one_in`` divides the CRC
    of ``<doc_id>:<run>``, one letter of the run is left out."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{MIN_LETTERS},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("")).alias("id"),
                       docs["text"].cast("string").alias("text"))
    return (rows.select("id", run.alias("run")).withColumn("run", ascii_lower(F.col("run")))
            .withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
            .withColumn("at", F.expr("cast(h % length(run) as int)"))
            .select(F.expr(f"if(h % {one_in} = 0, concat(left(run, at), substr(run, at + 2)), run)").alias("word"))
            .where(F.length("word") >= MIN_LETTERS)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT))


def _node(depth: str) -> str:
    return f"xxhash64({depth}, left(word, {depth}))"


def _letter_bit(place: str) -> str:
    return f"shiftleft(1L, ascii(substr(word, {place}, 1)) & 63)"


def _starts(backward: bool) -> tuple[str, str]:
    """SQL: the first places at which a letter may be replaced, and before which one may be inserted. Of the places
    0..L-1 of a word forward walks take those from L div 2 on, backward walks the others."""
    return ("length(word) - length(word) div 2", "length(word) - length(word) div 2 + 1") if backward else (
        "length(word) div 2", "length(word) div 2")


def trie(words: DataFrame, start: str) -> DataFrame:
    """The edges that leave nodes with several words, written as one partition per depth of the node. A word takes part from one level above its start, as near words are at most one letter longer. Per edge:
    ``below`` (words under the child), ``leaf`` (one of them), ``ends`` (the word that ends there), ``lens`` and
    ``ahead1..3`` (sets of the lengths and letters that follow)."""
    entry = F.struct("word", "n")
    steps = words.select("word", "n", F.explode(F.expr(f"sequence(greatest({start} - 1, 0), length(word))")).alias("depth"))
    edges = materialize(
        steps.selectExpr("word", "n", "depth", _node("depth") + " AS node", "substr(word, depth + 1, 1) AS ch",
                         _node("depth + 1") + " AS child", "length(word) - depth - 1 AS rest",
                         *[_letter_bit(f"depth + {1 + k}") + f" AS bit{k}" for k in range(1, AHEAD + 1)])
        .groupBy("depth", "node", "ch", "child")
        .agg(F.count("*").alias("below"), F.min(entry).alias("leaf"), F.max(F.when(F.col("rest") == 0, entry)).alias("ends"),
             F.bit_or(F.expr("shiftleft(1L, greatest(least(rest, 62), 0))")).alias("lens"),
             *[F.bit_or(f"bit{k}").alias(f"ahead{k}") for k in range(1, AHEAD + 1)]), "trie_steps")
    # an edge without a letter is a word that ends at the node
    branching = edges.groupBy("depth", "node").agg(F.sum("below").alias("words")).where("words > 1").drop("words")
    path = scratch_path(words.sparkSession, "trie_edges")
    (edges.where("ch <> ''").join(branching, ["depth", "node"], "left_semi").repartition("depth")
     .write.partitionBy("depth").parquet(path))
    return words.sparkSession.read.schema(edges.schema).parquet(path)


STEP = """case when ch = c then array(named_struct('to', position + 1, 'cost', edits))
               when edits = 0 and c <> '' and ch > c and position >= {insert_from}
                    then array(named_struct('to', position + 1, 'cost', 1), named_struct('to', position, 'cost', 1))
               when edits = 0 and c <> '' and ch > c then array(named_struct('to', position + 1, 'cost', 1))
               when edits = 0 and position >= {insert_from} then array(named_struct('to', position, 'cost', 1)) end"""
FOUND = """case when cost = 1 and below = 1 and substr(leaf.word, depth + 2) = substr(word, to + 1) then leaf
                when cost = 1 and below > 1 and to = length(word) then ends end"""
LIVE = " and ".join(["below > 1 and (cost = 0 or (to < length(word)",
                     "getbit(lens, least(length(word) - to, 62)) = 1",
                     *[f"(length(word) - to < {k} or {_letter_bit(f'to + {k}')} & ahead{k} <> 0)"
                       for k in range(1, AHEAD + 1)]]) + "))"


def _level(states: DataFrame, edges: DataFrame, depth: int, insert_from: str) -> DataFrame:
    """The next frontier, ``word, n, position, node, edits`` (node null: the state has ended) and
    ``near``: the word that a state has reached with one edit."""
    met = (states.join(edges, "node").withColumn("c", F.expr("substr(word, position + 1, 1)"))
           .withColumn("move", F.explode(F.expr(STEP.format(insert_from=insert_from))))
           .select("word", "n", "move.to", "move.cost", "child", "below", "leaf", "ends", "lens",
                   *[f"ahead{k}" for k in range(1, AHEAD + 1)], F.lit(depth).alias("depth")))
    return (met.selectExpr("word", "n", "to AS position", f"if({LIVE}, child, null) AS node", "cost AS edits",
                           f"{FOUND} AS near").where("node is not null or near is not null"))


def _walk(words: DataFrame, backward: bool) -> DataFrame | None:
    """``word, n, near``: the near words met by edits behind the start (words reversed if ``backward``)."""
    start, insert_from = _starts(backward)
    edges = trie(words, start)
    entering = materialize(words.selectExpr("word", "n", f"{start} AS position", _node(f"({start})") + " AS node", "0 AS edits"), "entering")
    # depths at which words enter and nodes branch: at most one per length of a word
    todo = sorted(r[0] for r in entering.groupBy("position").count().join(
        edges.groupBy(F.col("depth").alias("position")).count(), "position", "left_semi").collect())
    found, states, depth = None, None, -1
    while todo or states is not None:
        depth = depth + 1 if states is not None else todo[0]
        if todo and todo[0] == depth:
            todo.pop(0)
            new = entering.where(F.col("position") == depth)
            states = new if states is None else states.unionByName(new)
        level = materialize(_level(states, edges.where(F.col("depth") == depth).drop("depth"), depth, insert_from), "frontier")
        ended = level.where("near is not null").select("word", "n", "near")
        found = ended if found is None else found.unionByName(ended)
        states = level.where("node is not null").drop("near")
        if states.isEmpty():
            states = None
    return found


def near_words(words: DataFrame) -> DataFrame:
    """``words(word, n)`` (distinct) to ``word, n, near, near_n``: all ordered pairs of words that differ by one
    inserted, deleted or replaced letter."""
    turned = materialize(words.select(F.reverse("word").alias("word"), "n"), "turned")
    pairs = words.sparkSession.createDataFrame([], "word string, n long, near string, near_n long")
    for found, back in ((_walk(words, False), False), (_walk(turned, True), True)):
        if found is not None:
            turn = F.reverse if back else F.col
            pairs = pairs.unionByName(found.select(turn("word").alias("word"), "n", turn("near.word").alias("near"),
                                                   F.col("near.n").alias("near_n")))
    # an insertion into a run of equal letters may be met from both ends; hashed names are never trusted alone
    pairs = pairs.where(F.levenshtein("word", "near") == 1).distinct()
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, form)`` to ``(word, root)`` by pointer doubling: every round doubles the steps a word
    has followed; counts at least double along a chain, so there are few rounds."""
    jump = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not jump.where("moved").isEmpty():
        ahead = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jump = materialize(jump.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return jump.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words(word, n)`` to ``word, form, root, n, n_near, form_n``; see ``group_spellings``."""
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    own = F.col("best.minus") <= -ratio * F.col("n")
    named = materialize(words.join(near, "word", "left").select(
        "word", F.when(own, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(own, -F.col("best.minus")).alias("form_n")), "forms")
    roots = _roots(named.where("form is not null").select("word", "form"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame) -> DataFrame:
    """One row per word of at least ``MIN_LETTERS`` letters and ``MIN_COUNT`` occurrences in all texts:
    ``word, form, root, n, n_near, form_n``.

    form is the near word with most occurrences (ties: smallest in code-point order) if it has at
    least twice the word's own, else null; root is the end of the chain of forms (the word itself
    without a form); n_near counts the near words. Null and empty texts have no words; a missing
    doc_id counts as an empty string where letters are left out; repeated rows count as often as they come; an
    empty table gives an empty result; extra columns are ignored.
    """
    return variants(materialize(vocabulary(docs), "vocabulary"))
