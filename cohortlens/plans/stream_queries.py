"""Registered queries: the streaming refreshes (re-aimed reload loop)."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame

from cohortlens.plans.core_queries import _SCORED_DOUBLES, CLAMP, KEYS_SQL, VALID_ID, tables
from cohortlens.plans.registry import register
from cohortlens.session import scratch_path, shuffles_released
from cohortlens.sources import snapshots
from cohortlens.sources.schemas import SCHEMAS
from cohortlens.streaming import activity_refresh, scored_refresh

ARRIVING_FILES = 4
#: A file is one Parquet row group as a rule, which one task reads and combines whole: more rows go to another file.
FILE_ROWS = 500_000


def write_arrivals(clicks: DataFrame, folder: str, batches: int) -> int:
    """Writes the clicks on all cores, as files for so many micro-batches; returns the files of one."""
    spark = clicks.sparkSession
    parts = batches * math.ceil(spark.sparkContext.defaultParallelism / batches)
    cols = [f.name for f in SCHEMAS["student_vle"].fields]
    with shuffles_released(spark):
        clicks.select(*cols).repartition(parts).write.option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
    files = sum(name.endswith(".parquet") for name, _ in snapshots.listed(spark, folder))
    return math.ceil(files / batches)


@register(
    "stream_activity_refresh",
    oracle=f"""SELECT {KEYS_SQL}, total_clicks, active_days, active_weeks, forum_clicks, quiz_clicks,
       resource_clicks, clicks_per_day, engagement_ratio FROM vle_feat""",
    doubles=["clicks_per_day", "engagement_ratio"],
    survey_ids="S1",
)
def q_stream_activity_refresh(spark, sf_dir):
    """Click files arrive in several parts; the stream's final state must equal
    the batch click features over the same rows."""
    t = tables(spark, sf_dir)
    root = scratch_path(spark, "stream")
    source = os.path.join(root, "clicks")
    files = write_arrivals(t["student_vle"], source, ARRIVING_FILES)
    query = activity_refresh.start_activity_refresh(
        spark, source, t["vle"], os.path.join(root, "out"), checkpoint=os.path.join(root, "checkpoint"),
        max_files_per_trigger=files,  # one micro-batch per arriving part
    )
    query.awaitTermination()
    return activity_refresh.current_activity(spark, os.path.join(root, "out"), t["courses"])


# One run of the scored refresh per application and input folder: both queries read its tables.
_REFRESHED: dict[tuple[str, str], scored_refresh.ScoredRefresh] = {}


def _scored_refresh(spark, sf_dir):
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _REFRESHED:
        t = tables(spark, sf_dir)
        root = scratch_path(spark, "scored-stream")
        source, out = os.path.join(root, "clicks"), os.path.join(root, "out")
        files = write_arrivals(t["student_vle"], source, ARRIVING_BATCHES)
        query = scored_refresh.start_scored_refresh(
            spark, source, t, out, checkpoint=os.path.join(root, "checkpoint"), max_files_per_trigger=files
        )
        query.awaitTermination()
        _REFRESHED[key] = scored_refresh.refreshed(spark, out, t["courses"])
    return _REFRESHED[key]


ARRIVING_BATCHES = 3


@register("scored_refresh_rows", oracle="SELECT * FROM scored", doubles=_SCORED_DOUBLES, survey_ids="S1")
def q_scored_refresh_rows(spark, sf_dir):
    """The scored table after three micro-batches of clicks, each of which updates the changed enrollments alone."""
    return _scored_refresh(spark, sf_dir).current_scored()


@register(
    "scored_refresh_summary",
    ctes=f""", worst AS (SELECT id, max({CLAMP}) AS risk FROM scored WHERE {VALID_ID} GROUP BY id)""",
    oracle="""SELECT count(*) AS unique_students, count(*) FILTER (WHERE risk = 0) AS safe,
       count(*) FILTER (WHERE risk = 1) AS watch, count(*) FILTER (WHERE risk = 2) AS high_risk,
       count(*) FILTER (WHERE risk = 3) AS critical FROM worst""",
    survey_ids="S1 I4",
)
def q_scored_refresh_summary(spark, sf_dir):
    """The tier summary kept by differences of old and new worst tiers."""
    return _scored_refresh(spark, sf_dir).current_summary()
