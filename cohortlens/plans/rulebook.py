"""One rule interface for the cleaning jobs: ordered steps that judge every row in one pass.

A job is a raw table and a set of ``Step``s. A step finds its hits over the current values (earlier fixes
are visible to later steps) and drops, fixes, flags or merges; a row that a step has dropped is
passed over by the later ones. The order is schema and formats (19, 20), drops (13-18, 26, 32, 33),
fixes (21-25, 27-31), then the cross-table rules (1-12); ``after`` declares where one step needs
another before it and goes first.

``judge`` keeps dropped rows beside the others: ``dropped_by`` (the rule that dropped the row), ``rule_hits`` (one
bit per rule) and a count per rule. Cleaned rows (``kept``), rule counts (``findings``) and the rejected
rows (``rejected``) are read from that one frame; ``publish_job`` counts while it writes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohortlens.session import discard, materialize, used_up

PARSE, DROPS, FIXES = (19, 20), (13, 14, 15, 16, 17, 18, 26, 32, 33), (21, 22, 23, 24, 25, 27, 28, 29, 30, 31)
Maker = Callable[[], Column]


@dataclass(frozen=True)
class Step:
    """``does``: drop, fix, flag or dedupe. ``hit`` gives the condition (null: no hit). ``sets`` are new
    column values of the rows that are still there; ``flag`` names a boolean column of the hits. ``attach`` (one function or
    several) joins reference columns first (it never changes the number of rows), ``keys`` and ``order`` are a dedupe's; ``ends``
    are columns that no later step needs."""

    rule: int
    does: str
    hit: Maker | None = None
    sets: Mapping[str, Maker] = field(default_factory=dict)
    flag: str | None = None
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    attach: Callable | tuple[Callable, ...] = ()
    ends: tuple[str, ...] = ()
    after: tuple[int, ...] = ()


@dataclass(frozen=True)
class Job:
    """A table's raw rows and steps; ``raw(t)`` is the input, ``columns`` the cleaned table's (None: all). ``wide``: most steps
    shuffle all rows, so that findings are better taken step by step (``written_steps``)."""

    table: str
    raw: Callable
    steps: tuple[Step, ...]
    columns: tuple[str, ...] | None = None
    wide: bool = False


def rank(rule: int) -> int:
    return 0 if rule in PARSE else 1 if rule in DROPS else 2 if rule in FIXES else 3


def in_order(steps: Sequence[Step]) -> list[Step]:
    """Steps by rank and rule number, each behind the steps it declares (which must be in the job)."""
    by_rule = {s.rule: s for s in steps}
    if len(by_rule) != len(steps):
        raise ValueError("a rule occurs twice in one job")
    graph = TopologicalSorter({s.rule: s.after for s in steps})
    graph.prepare()  # a cycle raises
    out, ready = [], []
    while graph.is_active():
        ready += graph.get_ready()
        ready.sort(key=lambda r: (rank(r), r))
        rule = ready.pop(0)
        if rule not in by_rule:
            raise ValueError(f"rule {rule} is declared as needed but is not in the job")
        out.append(by_rule[rule])
        graph.done(rule)
    return out


def _count(rule: int) -> str:
    return f"_rule{rule:02d}"


def _is_count(column: str) -> bool:
    return column == "_rows" or column.startswith("_rule")


def _merge(df: DataFrame, step: Step) -> DataFrame:
    """One row per key: the first by ``order``, then by the other columns. Rows already dropped are merged with
    identical ones only; counts are summed. Grouped minimum: partial on the map side."""
    marks = [c for c in df.columns if _is_count(c)]
    data = [c for c in df.columns if c not in (*marks, *step.keys, "_gone")]
    ordered = [*step.order, *[c for c in data if c not in step.order]]
    own = F.when(F.col("_gone").isNotNull(), F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(ordered)]))
    first = F.min(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(ordered)])).alias("_first")
    one = (df.groupBy(*step.keys, "_gone", own.alias("_own"))
           .agg(first, F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in marks]))
    there = F.col("_gone").isNull()
    return one.select(*step.keys, *[F.col(f"_first._{i}").alias(c) for i, c in enumerate(ordered)], "_gone",
                      *[c for c in marks if c != "_rows"], F.when(there, 1).otherwise(F.col("_rows")).cast("long").alias("_rows"),
                      F.when(there, F.col("_n") - 1).otherwise(0).cast("long").alias(_count(step.rule)))


def judge(t, job: Job, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The job's rows with the values of all fixes, flags, ``dropped_by``, ``rule_hits`` and a count
    ``_ruleNN`` per rule (``_rows``: how many input rows a dropped row stands for). ``cut`` is given the raw rows and
    those after each join and merge, and may write them (``written_steps``)."""
    df = cut(job.raw(t)).withColumns({"_gone": F.lit(None).cast("int"), "_rows": F.lit(1).cast("long")})
    steps = in_order(job.steps)
    for s in steps:
        for attach in s.attach if isinstance(s.attach, tuple) else (s.attach,):
            df = cut(attach(t, df))
        there = F.col("_gone").isNull()
        if s.does == "dedupe":
            df = cut(_merge(df, s))
        else:
            hit = F.coalesce(s.hit(), F.lit(False)) & there if s.hit else F.lit(False)
            df = df.withColumn(_count(s.rule), hit.cast("long"))
            hit = F.col(_count(s.rule)) > 0
            if s.sets:
                df = df.withColumns({c: F.when(there, v()).otherwise(F.col(c)) if c in df.columns else v()
                                     for c, v in s.sets.items()})
            if s.does == "drop":
                df = df.withColumn("_gone", F.when(hit, F.lit(s.rule)).otherwise(F.col("_gone")))
            if s.flag:
                df = df.withColumn(s.flag, hit)
        df = df.drop(*s.ends)
    hits = [F.when(F.col(_count(s.rule)) > 0, F.lit(1 << s.rule)).otherwise(F.lit(0)).cast("long") for s in steps]
    mask = hits[0]
    for h in hits[1:]:
        mask = mask.bitwiseOR(h)
    return df.withColumn("rule_hits", mask).withColumnRenamed("_gone", "dropped_by")


def written_steps() -> Callable[[DataFrame], DataFrame]:
    """A ``cut`` for ``judge`` that writes rows which a step has shuffled and deletes the table of the step before: on disk are
    one step's shuffles and two tables, whatever the number of steps."""
    last: list[DataFrame] = []

    def cut(df: DataFrame) -> DataFrame:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if not any(x in plan for x in ("Join ", "Aggregate ", "Window ")):
            return df
        out = materialize(df, "step", compression="zstd")
        discard(*last)
        last[:] = [out]
        return out

    return cut


def cleaned_columns(judged: DataFrame, job: Job) -> list[str]:
    return list(job.columns or [c for c in judged.columns if not _is_count(c) and c not in ("dropped_by", "rule_hits")])


def kept(judged: DataFrame, job: Job) -> DataFrame:
    return judged.where(F.col("dropped_by").isNull()).select(*cleaned_columns(judged, job))


def rejected(judged: DataFrame, job: Job) -> DataFrame:
    """The rows that a rule dropped, as they stood when it did, with the rule."""
    return judged.where(F.col("dropped_by").isNotNull()).select(*cleaned_columns(judged, job), "dropped_by")


def _totals(job: Job) -> list[Column]:
    return [F.coalesce(F.sum(_count(s.rule)), F.lit(0)).alias(_count(s.rule)) for s in job.steps]


def findings(judged: DataFrame, job: Job) -> DataFrame:
    """``source_table, rule_id, disposition, findings``: one row per rule, from one aggregate over the rows."""
    rows = F.array(*[F.struct(F.lit(job.table).alias("source_table"), F.lit(s.rule).alias("rule_id"),
                              F.lit(s.does).alias("disposition"), F.col(_count(s.rule)).alias("findings"))
                     for s in in_order(job.steps)])
    return judged.agg(*_totals(job)).select(F.inline(rows))


def written_findings(t, job: Job) -> DataFrame:
    """``findings``, counted and written now by a query of their own; nothing else that the job has written stays."""
    with used_up() as keep:
        judged = judge(t, job, written_steps()) if job.wide else judge(t, job)
        return keep(materialize(findings(judged, job), "found"))


def clean(t, job: Job) -> DataFrame:
    return kept(judge(t, job), job)


def publish_job(t, job: Job, write: Callable[[DataFrame], object]) -> dict[int, int]:
    """Writes the cleaned rows and returns the findings per rule, counted by the write itself: one scan."""
    seen = Observation(f"rules_{job.table}")
    judged = judge(t, job).observe(seen, *_totals(job))
    write(kept(judged, job))
    got = seen.get
    return {s.rule: got[_count(s.rule)] for s in in_order(job.steps)}


def in_reference(flag: str, reference: Callable, pairs: Sequence[tuple[str, str]]) -> Callable:
    """An ``attach``: boolean column ``flag``, whether ``reference(t)`` has the row's key (null keys: not).
    The reference is reduced to distinct keys first, so no row is multiplied."""

    def attach(t, df: DataFrame) -> DataFrame:
        names = [f"_k{i}" for i in range(len(pairs))]
        ref = (reference(t).select(*[F.col(r).alias(n) for (_, r), n in zip(pairs, names)]).distinct()
               .withColumn(flag, F.lit(True)))
        on = [F.col(left) == F.col(n) for (left, _), n in zip(pairs, names)]
        return df.join(ref, on, "left").drop(*names).withColumn(flag, F.coalesce(flag, F.lit(False)))

    return attach
