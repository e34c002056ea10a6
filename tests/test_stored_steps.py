"""Steps that write what later ones read: their shuffle files go with them, and nothing stored is stored again."""

import pytest
from pyspark.sql import DataFrameWriter

from cohortlens.plans import core_queries, evaluation_queries
from cohortlens.session import RELEASE, shuffles_released
from tests.conftest import SF_SMALL


def test_stored_steps_release_their_shuffle_files(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.symlink_to(SF_SMALL)
    asked, write = {}, DataFrameWriter.parquet

    def recorded(self, path, *args, **kw):
        asked.update({name: spark.conf.get(RELEASE) for name in ("/scored-", "/rule-predictions-", "/running-totals-", "/evaluations-") if name in path})
        return write(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    frame = core_queries.scored_frame(spark, str(folder))
    evaluation_queries.stored(spark, str(folder))
    assert len(asked) == 4 and set(asked.values()) == {"true"} and spark.conf.get(RELEASE) == "false"
    assert frame.storageLevel.useMemory and not frame.storageLevel.useDisk
    core_queries.refresh(spark, str(folder))


def test_the_setting_is_put_back_after_a_failure(spark):
    with pytest.raises(ValueError), shuffles_released(spark):
        raise ValueError
    assert spark.conf.get(RELEASE) == "false"
