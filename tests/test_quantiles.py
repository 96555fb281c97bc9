"""The distributed exact quantile equals Spark's exact percentile (linear interpolation)."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 0.98, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), rng.random() * 100 if rng.random() > 0.1 else float(rng.randint(0, 3)))
            for _ in range(5000)]
    rows += [("d", 5.0)] * 3 + [("e", 1.0)] + [("f", None)]
    return spark.createDataFrame(rows, "g string, v double")


def _expected(df, by):
    agg = F.percentile("v", F.array(*[F.lit(p) for p in PROBS])).alias("q")
    d = df.where(F.col("v").isNotNull())
    rows = (d.groupBy(*by).agg(agg) if by else d.agg(agg)).collect()
    return {(r.g if by else None): r.q for r in rows}


@pytest.mark.parametrize("accuracy", [100000, 40])
def test_grouped_selection_is_exact(data, accuracy):
    got = {r.g: r.q for r in exact_quantiles(data, "v", PROBS, ["g"], accuracy=accuracy).collect()}
    exp = _expected(data, ["g"])
    assert set(got) == set(exp)
    for g in exp:
        assert got[g] == pytest.approx(exp[g], abs=1e-9)


def test_global_selection_is_exact(data):
    r = exact_quantiles(data, "v", PROBS, accuracy=40).first()
    assert r.q == pytest.approx(_expected(data, [])[None], abs=1e-9)
    assert r.n == 5004


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("miss", ["all at the maximum", "all at the minimum"])
def test_exact_whatever_the_sketch_says(data, by, miss, monkeypatch):
    """A sketch whose ranks are off makes ranges wider; it neither fails the query nor changes its result."""
    end = F.max if miss == "all at the maximum" else F.min
    monkeypatch.setattr(F, "percentile_approx", lambda c, ps, accuracy: F.array_repeat(end(c), len(ps)))
    got = {(r.g if by else None): r.q for r in exact_quantiles(data, "v", PROBS, by, accuracy=40).collect()}
    exp = _expected(data, by)
    assert set(got) == set(exp)
    for g in exp:
        assert got[g] == pytest.approx(exp[g], abs=1e-9)


def test_no_job_and_no_group_only_shuffle(spark, data):
    plan = exact_quantiles(data, "v", PROBS, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "hashpartitioning(g#" in plan and "_v#" in plan


def test_five_number_exact_and_sketch_paths(spark, data):
    from cohortlens.operators.stats import five_number
    exact = {r.g: r for r in five_number(data, "g", "v").collect()}
    sketch = {r.g: r for r in five_number(data, "g", "v", approx=True).collect()}
    assert set(exact) == set(sketch) == {"a", "b", "c", "d", "e"}
    for g, r in exact.items():
        assert r.minimum <= r.q1 <= r.median <= r.q3 <= r.maximum
        assert sketch[g].n == r.n and sketch[g].minimum == r.minimum and sketch[g].maximum == r.maximum
    assert exact["d"].outliers == 0 and exact["d"].q1 == exact["d"].q3 == 5.0
