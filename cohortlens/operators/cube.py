"""Summary cube with exact distinct students: any set of visible modules without the scored rows.

A student counts with the worst tier among the *visible* enrollments, so
counts of single modules cannot be added up.  Sets can: the cube keeps, for
each module, presentation, tier and withdrawal flag, the set of its students as
bitmaps of student numbers, and the number of enrollments.  The students with
tier ``t`` or worse in any cells are the union of the cells' bitmaps of tiers
``t`` and up, so four unions give the count of every worst tier, exactly.

Numbers are dealt in the order of each student's first module and
presentation: the students of a cell lie close together and its bitmaps (one
for 32,768 numbers) are few and full.  Building the cube shuffles the scored
rows once on the student and once, as bitmaps, on the cell; a summary reads
the cells of the visible modules alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import clamp_tier
from cohortlens.functions.positions import with_positions

CELL = ["code_module", "code_presentation", "tier", "withdrew"]


def _with_id(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("id").isNotNull() & (F.col("id") != ""))


def student_numbers(scored: DataFrame) -> DataFrame:
    """``id`` and ``number`` (1 to the number of students), in the order of first module and presentation."""
    first = F.min(F.struct(F.coalesce("code_module", F.lit("")).alias("m"), F.coalesce("code_presentation", F.lit("")).alias("p")))
    students = _with_id(scored).groupBy("id").agg(first.alias("first"))
    numbered = with_positions(students, [F.col("first.m"), F.col("first.p"), F.col("id")])
    return numbered.select("id", F.col("position").alias("number"))


def summary_cube(scored: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """One row per cell and block of 32,768 student numbers: ``students`` (bitmap) and ``enrollments``.

    Enrollments without a student id count as enrollments alone (their block is null).
    """
    numbers = student_numbers(scored) if numbers is None else numbers
    rows = scored.select(
        "id",
        F.coalesce("code_module", F.lit("")).alias("code_module"),
        F.coalesce("code_presentation", F.lit("")).alias("code_presentation"),
        clamp_tier(F.col("risk")).alias("tier"),
        (F.coalesce("withdrew_early", F.lit(0)) == 1).cast("int").alias("withdrew"),
    ).join(numbers, "id", "left")
    block = F.bitmap_bucket_number("number").alias("block")
    return rows.groupBy(*CELL, block).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("students"), F.count(F.lit(1)).alias("enrollments")
    )


def payload_summary(
    cube: DataFrame,
    modules: Sequence[str] | None = None,
    presentation: str | None = None,
    tiers: Iterable[int] | None = None,
    withdrew: int | None = None,
) -> DataFrame:
    """Enrollments, unique students and their count per worst tier over the visible cells (one row, zeros if empty).

    An empty module list means all modules; further filters as in ``student_filter``.
    """
    cells = cube
    if modules:
        cells = cells.filter(F.col("code_module").isin(list(modules)))
    if presentation:
        cells = cells.filter(F.col("code_presentation") == presentation)
    tiers = sorted(set(tiers or []))
    if tiers:
        cells = cells.filter(F.col("tier").isin(tiers))
    if withdrew is not None:
        cells = cells.filter(F.col("withdrew") == int(withdrew))
    # a cell of tier t belongs to "tier 0 or worse" up to "tier t or worse"
    reach = cells.select("block", "students", "enrollments", F.explode(F.sequence(F.lit(0), F.col("tier"))).alias("least"))
    sets = reach.groupBy("least", "block").agg(F.bitmap_or_agg("students").alias("students"), F.sum("enrollments").alias("enrollments"))
    sizes = sets.select("least", "enrollments", F.when(F.col("block").isNotNull(), F.bitmap_count("students")).otherwise(0).alias("n"))

    def at_least(tier: int, value: str = "n"):
        return F.coalesce(F.sum(F.when(F.col("least") == tier, F.col(value))), F.lit(0))

    return sizes.agg(
        at_least(0, "enrollments").cast("long").alias("enrollments"),
        *(at_least(t).cast("long").alias(f"n{t}") for t in range(4)),
    ).select(
        "enrollments",
        F.col("n0").alias("unique_students"),
        (F.col("n0") - F.col("n1")).alias("safe"),
        (F.col("n1") - F.col("n2")).alias("watch"),
        (F.col("n2") - F.col("n3")).alias("high_risk"),
        F.col("n3").alias("critical"),
    )
