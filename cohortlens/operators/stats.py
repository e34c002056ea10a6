"""Feature statistics per tier: histogram, box-plot quantiles, correlations.

All three keep valid values only (present, not NaN, not negative).  Histogram
and box plot start from the scored frame in long form ``(risk, field, v)``
(``unpivot``); their exact quantiles come from ``exact_percentiles`` (sketched
brackets, one count, a thin slice).  The correlation matrix is a sum of one
block of Gram sums for each partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import fixed, valid_number
from cohortlens.functions.quantiles import exact_percentiles
from cohortlens.operators.scoring import SCORED_FEATURES

HISTOGRAM_BUCKETS = 20
# Box-plot percentiles (p1, quartiles, p99) and their names.
BOX_PERCENTILES = {"min": 0.01, "q1": 0.25, "median": 0.50, "q3": 0.75, "max": 0.99}
#: A variance below this part of the mean square is taken for rounding.
CONSTANT_SHARE = 1e-12
DEFAULT_BOX_FIELDS = SCORED_FEATURES[:6]


def long_values(scored: DataFrame, fields: Sequence[str] = SCORED_FEATURES) -> DataFrame:
    """``(risk, field, v)`` for every valid value of the given fields."""
    wide = scored.select(F.col("risk").cast("int").alias("risk"), *[F.col(f).cast("double").alias(f) for f in fields])
    long = wide.unpivot(["risk"], list(fields), "field", "v")
    return long.filter(valid_number(F.col("v")) & F.col("risk").isin(0, 1, 2, 3))


def _bucket_of(v, lo, width, n_buckets: int):
    """Index i with ``lo + i*w <= v < lo + (i+1)*w`` using the exact edges.

    The division gives a candidate; the two neighbours are checked against
    the edges computed the same way the chart labels them, so float rounding
    cannot move a value into a different bucket than the edge comparison.
    """
    guess = F.floor((v - lo) / width).cast("int")
    expr = None
    for delta in (-1, 0, 1):
        i = guess + delta
        edge_lo = lo + i.cast("double") * width
        edge_hi = lo + (i + 1).cast("double") * width
        hit = (i >= 0) & (i < n_buckets) & (edge_lo <= v) & (v < edge_hi)
        expr = (F.when if expr is None else expr.when)(hit, i)
    return expr


def feature_histogram(
    scored: DataFrame, fields: Sequence[str] = SCORED_FEATURES, n_buckets: int = HISTOGRAM_BUCKETS
) -> DataFrame:
    """Equal-width buckets between p1 and p99 per field, counted per tier.

    Values below p1 are dropped; values at or above p99 are added to the last
    bucket.  If p1 equals p99 the range is ``[p1, p1 + 1)``.
    """
    values = long_values(scored, fields)
    pct = exact_percentiles(values, ["field"], "v", [0.01, 0.99])
    bounds = pct.groupBy("field").agg(
        F.max(F.when(F.col("p") == 0.01, F.col("value"))).alias("lo"),
        F.max(F.when(F.col("p") == 0.99, F.col("value"))).alias("hi0"),
    )
    bounds = bounds.select(
        "field",
        "lo",
        F.when(F.col("lo") == F.col("hi0"), F.col("lo") + 1).otherwise(F.col("hi0")).alias("hi"),
    ).withColumn("width", (F.col("hi") - F.col("lo")) / F.lit(n_buckets))

    # bounds has one row per field: broadcast is bounded by the field list.
    located = values.join(F.broadcast(bounds), "field").select(
        "field",
        "risk",
        _bucket_of(F.col("v"), F.col("lo"), F.col("width"), n_buckets).alias("in_range"),
        F.when(F.col("v") >= F.col("hi"), F.lit(n_buckets - 1)).alias("overflow"),
    )
    hits = located.select(
        "field", "risk", F.explode(F.array("in_range", "overflow")).alias("bucket")
    ).filter(F.col("bucket").isNotNull())
    counts = hits.groupBy("field", "bucket").agg(
        *[F.count(F.when(F.col("risk") == t, F.lit(1))).alias(name) for t, name in ((0, "safe"), (1, "watch"), (2, "high"), (3, "crit"))]
    )
    grid = bounds.select("field", "lo", "width", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))).alias("bucket"))
    edge_lo = F.col("lo") + F.col("bucket").cast("double") * F.col("width")
    edge_hi = F.col("lo") + (F.col("bucket") + 1).cast("double") * F.col("width")
    # counts has at most one row per field and bucket: the broadcast side.
    return (
        grid.join(F.broadcast(counts), ["field", "bucket"], "left")
        .select(
            "field",
            "bucket",
            edge_lo.alias("bucket_lo"),
            edge_hi.alias("bucket_hi"),
            F.concat(fixed(edge_lo, 2), F.lit("–"), fixed(edge_hi, 2)).alias("label"),
            *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("safe", "watch", "high", "crit")],
        )
        .orderBy("field", "bucket")
    )


def feature_boxplot(scored: DataFrame, fields: Sequence[str] = DEFAULT_BOX_FIELDS) -> DataFrame:
    """p1 / p25 / p50 / p75 / p99 per field and tier (exact, interpolated)."""
    values = long_values(scored, fields)
    pct = exact_percentiles(values, ["field", "risk"], "v", list(BOX_PERCENTILES.values()))
    return (
        pct.groupBy("field", F.col("risk").alias("tier"))
        .agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for name, p in BOX_PERCENTILES.items()])
        .orderBy("field", "tier")
    )


def _gram_sums(centres: Sequence[float]):
    """Masked Gram sums of one partition: joint counts, sums, squares and products of the centred fields, one row."""
    import numpy as np
    import pyarrow as pa

    n, middle = len(centres), np.array(centres)

    def run(batches):
        sums = np.zeros((4, n, n))
        for batch in batches:
            x = np.empty((batch.num_rows, n))
            for j in range(n):
                x[:, j] = batch.column(j).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            there = x >= 0  # a NaN compares false
            x = np.where(there, x - middle, 0.0)
            mask = there.astype(np.float64)
            sums += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def feature_correlation(scored: DataFrame, fields: Sequence[str] = SCORED_FEATURES) -> DataFrame:
    """Pearson r for every field pair (upper triangle), pairwise complete.

    A pair uses the rows where both values are valid.  A constant or empty
    pair gives 0 instead of a division error.  Each partition returns one block
    of masked Gram sums (matrix products over its rows); blocks are merged by
    addition, so no row is multiplied and only the blocks are shuffled.  Values
    are centred at the fields' means first, which keeps the sums stable.
    """
    fields = list(fields)
    spark, n = scored.sparkSession, len(fields)
    wide = scored.select(*(F.col(f).cast("double").alias(f) for f in fields))
    valid = [F.when(valid_number(F.col(f)), F.col(f)) for f in fields]
    means = wide.agg(*(F.coalesce(F.avg(v), F.lit(0.0)).alias(f) for f, v in zip(fields, valid, strict=True))).first()
    centres = [float(m) if math.isfinite(m) else 0.0 for m in means]
    blocks = wide.mapInArrow(_gram_sums(centres), "sums array<double>")
    merged = blocks.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    # one row for each of the four numbers of a pair of fields, in either order
    cell = F.col("at") % (n * n)
    kind, a, b = F.floor(F.col("at") / (n * n)), F.floor(cell / n), cell % n
    i, j = F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b")
    first = a <= b

    def of(k: int, forward: bool = True) -> Column:
        return F.max(F.when((kind == k) & (first if forward else ~first), F.col("x")))

    moments = merged.filter(a != b).groupBy(i, j).agg(
        of(0).alias("n"), of(1).alias("sx"), of(1, False).alias("sy"), of(2).alias("sxx"), of(2, False).alias("syy"), of(3).alias("sxy")
    )
    both = F.col("n")
    cov = F.try_divide(F.col("sxy"), both) - F.try_divide(F.col("sx"), both) * F.try_divide(F.col("sy"), both)

    def deviation(total: str, squares: str) -> Column:
        mean_square = F.try_divide(F.col(squares), both)
        variance = mean_square - F.pow(F.try_divide(F.col(total), both), 2)
        # what rounding leaves of a constant field is no deviation
        return F.when(variance > mean_square * CONSTANT_SHARE, F.sqrt(variance)).otherwise(0.0)

    names = spark.createDataFrame(
        [(i, j, fields[i], fields[j]) for i, j in combinations(range(n), 2)],
        "a int, b int, feature_x string, feature_y string",
    )
    r = F.coalesce(F.try_divide(cov, deviation("sx", "sxx") * deviation("sy", "syy")), F.lit(0.0))
    # Both sides hold at most one row per pair; the moments are the build side
    # so the left outer join (pairs without valid rows give 0) needs no shuffle.
    return names.join(F.broadcast(moments), ["a", "b"], "left").select("feature_x", "feature_y", r.alias("r"))
