"""The activity stream: two refreshes with new files, compaction, and a restart from a new checkpoint."""

import os

from cohortlens.operators.features import vle_features
from cohortlens.plans.core_queries import tables
from cohortlens.sources.schemas import SCHEMAS
from cohortlens.streaming import activity_refresh as stream
from tests.conftest import SF_SMALL

KEYS = ["id_student", "code_module", "code_presentation"]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_refreshes_compaction_and_restart(spark, tmp_path):
    t = tables(spark, SF_SMALL)
    columns = [f.name for f in SCHEMAS["student_vle"].fields]
    clicks = t["student_vle"].select(*columns)
    source, out, checkpoint = (str(tmp_path / x) for x in ("clicks", "out", "checkpoint"))

    def refresh(checkpoint):
        stream.start_activity_refresh(spark, source, t["vle"], out, checkpoint, max_files_per_trigger=1).awaitTermination()
        return stream.current_activity(spark, out, t["courses"])

    first, second = clicks.filter("id_student % 2 = 0"), clicks.filter("id_student % 2 = 1 OR id_site % 3 = 0")
    first.repartition(3).write.parquet(source)
    got = refresh(checkpoint)
    want = vle_features(first, t["vle"], t["courses"])
    assert _rows(got.select(*want.columns)) == _rows(want)

    second.repartition(2).write.mode("append").parquet(source)
    want = vle_features(first.unionByName(second), t["vle"], t["courses"])
    got = refresh(checkpoint)
    assert _rows(got.select(*want.columns)) == _rows(want)
    assert spark.conf.get(stream.PROVIDER, "none") != stream.ROCKSDB  # the caller's setting is put back
    assert list((tmp_path / "checkpoint" / "state").rglob("*.zip"))  # files of the RocksDB store

    epochs = [x for x in os.listdir(f"{out}/updates/generation=0") if x.startswith("epoch=")]
    stream.compact(spark, out)
    left = [x for x in os.listdir(f"{out}/updates/generation=0") if x.startswith("epoch=")]
    assert len(left) == 1 < len(epochs)
    assert _rows(stream.current_activity(spark, out, t["courses"]).select(*want.columns)) == _rows(want)

    # a new checkpoint starts over; its lower epoch numbers win over the old generation's
    got = refresh(str(tmp_path / "checkpoint2"))
    assert _rows(got.select(*want.columns)) == _rows(want)
    assert os.path.isdir(f"{out}/updates/generation=1")
