"""Stored feature groups in one storage-partitioned layout: assembling them again shuffles nothing.

Demographics, clicks, assessments and registration are written as tables that
are bucketed and sorted by the enrollment key, all with the same number of
buckets.  A join of them pairs bucket with bucket.  One group can be written
again (new clicks, say) and the feature table assembled without touching the others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from cohortlens.operators import features
from cohortlens.operators.features import KEYS

BUCKETS = 32
# Group name -> how it comes from the source tables.
GROUPS: dict[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = {
    "demographics": lambda t: features.demographic_features(t["student_info"]),
    "clicks": lambda t: features.vle_features(t["student_vle"], t["vle"], t["courses"]),
    "assessments": lambda t: features.assessment_features(t["student_assessment"], t["assessments"]),
    "registration": lambda t: features.registration_features(t["student_registration"]),
}


def store_group(rows: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Writes one group as table ``table`` under ``path``, one file for each bucket."""
    writer = rows.repartition(buckets, *KEYS).write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, *KEYS).sortBy(*KEYS).saveAsTable(table)


def store_groups(tables: Mapping[str, DataFrame], prefix: str, root: str, buckets: int = BUCKETS) -> None:
    """Writes all groups as tables ``<prefix>_<group>``."""
    for name, build in GROUPS.items():
        store_group(build(tables), f"{prefix}_{name}", f"{root}/{name}", buckets)


def assemble_stored(spark: SparkSession, prefix: str) -> DataFrame:
    """The feature table from the stored groups; every join meets rows of equal buckets in place."""
    base, clicks, assess, reg = (spark.table(f"{prefix}_{name}") for name in GROUPS)
    static = base.join(assess.hint("merge"), KEYS, "left").join(reg.hint("merge"), KEYS, "left")
    return features.assembled(static, clicks.hint("merge"))


def drop_groups(spark: SparkSession, prefix: str) -> None:
    """Forgets the tables; their files belong to the folder they were written to."""
    for name in GROUPS:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")
