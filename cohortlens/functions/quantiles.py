"""Exact percentiles (linear interpolation) from sketched brackets, one count and a thin slice.

``percentile`` keeps every distinct value of a group in one aggregation
buffer, and a full sort shuffles every value.  Here three steps find the same
numbers:

1. a mergeable quantile sketch per group (KLL) gives for each requested
   percentile two values between which its rank should lie;
2. one aggregate counts, per group and bracket, the values below it and at its
   two ends; only values strictly inside a bracket (``2 * MARGIN`` of a group
   each) leave the map side, as distinct ``(value, count)`` rows;
3. the ranks asked for are at an end of the bracket, or are found by a running
   count over its slice.

The counts of step 2 prove each bracket: where a rank lies outside (a sketch
has its error bound with high probability only), the group is counted again
with an open bracket.  Groups of up to ``SKETCH_K`` values get an open bracket
at once.

The interpolation is the usual ``v[lo] + (v[hi] - v[lo]) * (pos - lo)`` with
``pos = (n - 1) * p``, which equals Spark's ``percentile`` and DuckDB's
``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.joins import bounded_broadcast
from cohortlens.session import shared_checkpoint_dir

#: Size of the sketch, and half a bracket's width as a part of the group: about twice the error of a sketch of this size.
SKETCH_K, MARGIN = 8000, 0.0009


def exact_percentiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probabilities: Sequence[float],
    sketch_k: int = SKETCH_K,
    margin: float = MARGIN,
) -> DataFrame:
    """One row per group and probability: ``(*group_cols, p, value, n)``.

    Null values are ignored; groups without values produce no rows.  NaN counts as the largest value.
    """
    groups, ps = list(group_cols), [float(p) for p in probabilities]
    shared_checkpoint_dir(df.sparkSession)
    values = df.select(*groups, F.col(value_col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    edges = F.array(*(F.lit(max(0.0, p - margin)) for p in ps), *(F.lit(min(1.0, p + margin)) for p in ps))
    sketch = values.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.isnan("v")).alias("numbers"),
        F.kll_sketch_agg_double("v", F.lit(sketch_k)).alias("sketch"),
    )
    # a group without a number has an empty sketch
    open_ = (F.col("n") <= sketch_k) | (F.col("numbers") == 0)
    ends = F.when(~open_, F.kll_sketch_get_quantile_double("sketch", edges))
    sketch = sketch.select(*groups, "n", ends.alias("q"))
    brackets = sketch.selectExpr(*_names(groups), "n", *_ends(ps, sketched=True)).checkpoint()
    counts = _counted(values, groups, brackets, ps)
    missed = _missed(counts, groups, brackets, ps)
    if not missed.isEmpty():
        missed = missed.checkpoint()
        again = brackets.join(missed, groups, "left_semi").selectExpr(*_names(groups), "n", *_ends(ps, sketched=False)).checkpoint()
        brackets = brackets.join(missed, groups, "left_anti").unionByName(again)
        counts = counts.join(missed, groups, "left_anti").unionByName(_counted(values, groups, again, ps))
    return _at_ranks(counts, groups, brackets, ps)


# The steps below are SQL text: a column for each bracket and count would cost more to build than the small frames cost to run.
_LOW, _HIGH = "double('-Infinity')", "double('NaN')"


def _names(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _ends(ps: list[float], sketched: bool) -> list[str]:
    """Bracket ends ``lo<i>``, ``hi<i>``; open ones are minus infinity, and NaN, which sorts behind all numbers."""
    n = len(ps)
    if not sketched:
        return [f"{_LOW} AS lo{i}" for i in range(n)] + [f"{_HIGH} AS hi{i}" for i in range(n)]
    return [f"coalesce(q[{i}], {_LOW}) AS lo{i}" for i in range(n)] + [f"coalesce(q[{n + i}], {_HIGH}) AS hi{i}" for i in range(n)]


def _counted(values: DataFrame, groups: list[str], brackets: DataFrame, ps: list[float]) -> DataFrame:
    """Per group, how many values lie below and at the ends of each bracket; a row of its own for each distinct value in a slice."""
    inside = [f"(lo{i} < v AND v < hi{i})" for i in range(len(ps))]
    tests = {"below": "v < lo{i}", "at_lo": "v = lo{i}", "at_hi": "v = hi{i}", "inside": "lo{i} < v AND v < hi{i}"}
    counts = [F.expr(f"count_if({test.format(i=i)}) AS {part}{i}") for part, test in tests.items() for i in range(len(ps))]
    located = values.join(bounded_broadcast(brackets.drop("n")), groups)
    # values of no slice fall into one row of each group, combined on the map side
    return located.groupBy(*groups, F.expr(f"CASE WHEN {' OR '.join(inside)} THEN v END AS sv")).agg(F.expr("count(1) AS c"), *counts).checkpoint()


_PARTS = ("below", "at_lo", "at_hi", "inside")


def _targets(counts: DataFrame, groups: list[str], brackets: DataFrame, ps: list[float]) -> DataFrame:
    """One row for each group and probability: its two ranks and its bracket's counts."""
    sums = [F.expr(f"sum({part}{i}) AS {part}{i}") for part in _PARTS for i in range(len(ps))]
    rows = [
        f"named_struct('i', {i}, 'p', double('{p!r}'), {', '.join(f"'{c}', {c}{i}" for c in ('lo', 'hi', *_PARTS))})" for i, p in enumerate(ps)
    ]
    targets = counts.groupBy(*groups).agg(*sums).join(bounded_broadcast(brackets), groups)
    targets = targets.selectExpr(*_names(groups), "n", f"inline(array({', '.join(rows)}))")
    targets = targets.selectExpr("*", "floor(double(n - 1) * p) AS r0", "below + at_lo AS base")
    return targets.selectExpr("*", "double(n - 1) * p - r0 AS frac", "least(r0 + 1, n - 1) AS r1")


def _missed(counts: DataFrame, groups: list[str], brackets: DataFrame, ps: list[float]) -> DataFrame:
    """Groups with a rank outside its bracket (both ends of a bracket of one value are the same rows)."""
    held = "r0 >= below AND r1 < base + if(lo = hi, 0, inside + at_hi)"
    return _targets(counts, groups, brackets, ps).filter(f"NOT ({held})").select(*groups).distinct()


def _at_ranks(counts: DataFrame, groups: list[str], brackets: DataFrame, ps: list[float]) -> DataFrame:
    """The interpolated values."""
    # a slice holds a few thousandths of its group: its running count is one window
    hits = ", ".join(f"CASE WHEN inside{i} > 0 THEN {i} END" for i in range(len(ps)))
    sliced = counts.filter("sv IS NOT NULL").selectExpr(*_names(groups), "sv", "c", f"explode(filter(array({hits}), i -> i IS NOT NULL)) AS i")
    before = f"sum(c) OVER (PARTITION BY {', '.join([*_names(groups), 'i'])} ORDER BY sv ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    sliced = sliced.selectExpr(*_names(groups), "i", "sv", "c", f"{before} AS end").selectExpr(*_names(groups), "i", "sv", "end - c AS start", "end")
    joined = _targets(counts, groups, brackets, ps).join(sliced, [*groups, "i"], "left")
    within = [f"max(CASE WHEN start <= {r} - base AND {r} - base < end THEN sv END) AS in_{r}" for r in ("r0", "r1")]
    kept = [f"first({c}) AS {c}" for c in ("n", "lo", "hi", "r0", "r1", "frac", "base", "inside")]
    picked = joined.groupBy(*groups, "p").agg(*(F.expr(x) for x in (*kept, *within)))
    value = "CASE WHEN {r} - base < 0 THEN lo WHEN {r} - base < inside THEN in_{r} ELSE hi END AS v_{r}"
    picked = picked.selectExpr("*", value.format(r="r0"), value.format(r="r1"))
    # equal values need no difference, which would be NaN for infinite ones
    return picked.selectExpr(*_names(groups), "p", "if(v_r0 = v_r1, v_r0, v_r0 + (v_r1 - v_r0) * frac) AS value", "n")
