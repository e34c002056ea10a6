"""Key quality checks on the raw tables.

The feature joins assume unique enrollment keys and drop submissions whose
assessment is unknown; these checks make both visible.  Duplicate counts are
``groupBy(...).count()`` (partial aggregation).  Orphans are counted per key
first, map-side, and the distinct keys alone are anti-joined, so a hot key is
one row of the join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.sources.schemas import ENROLLMENT_KEYS


def _duplicates(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return groups.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows")
    ).select(F.lit(table).alias("table"), F.lit("duplicate_keys").alias("check"), "groups", "rows")


def _orphans(df: DataFrame, ref: DataFrame, keys: list[str], table: str, check: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    missing = counts.join(ref.select(*keys).distinct(), keys, "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows")).select(
        F.lit(table).alias("table"), F.lit(check).alias("check"), F.lit(None).cast("long").alias("groups"), "rows"
    )


def key_quality(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table, check, groups, rows)`` for duplicate keys and orphan rows."""
    checks = [
        _duplicates(tables["student_info"], ENROLLMENT_KEYS, "student_info"),
        _duplicates(tables["student_registration"], ENROLLMENT_KEYS, "student_registration"),
        _duplicates(tables["vle"], ["id_site"], "vle"),
        _duplicates(tables["assessments"], ["id_assessment"], "assessments"),
        _duplicates(tables["courses"], ["code_module", "code_presentation"], "courses"),
        _orphans(tables["student_assessment"], tables["assessments"], ["id_assessment"], "student_assessment",
                 "unknown_assessment"),
        _orphans(tables["student_vle"], tables["vle"], ["id_site"], "student_vle", "unknown_site"),
        _orphans(tables["student_registration"], tables["student_info"], ENROLLMENT_KEYS, "student_registration",
                 "unknown_enrollment"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
