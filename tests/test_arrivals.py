"""The files that a micro-batch reads: small ones, the same number of micro-batches, all rows."""

from pyspark.sql import functions as F

from cohortlens.plans import stream_queries
from cohortlens.sources.schemas import SCHEMAS


def test_a_micro_batch_reads_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 50)
    cols = [(F.col("id") if f.name == "id_student" else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["student_vle"].fields]
    folder = str(tmp_path / "clicks")
    files = stream_queries.write_arrivals(spark.range(10_000).select(*cols), folder, 4)
    rows = spark.read.parquet(folder)
    sizes = [r["count"] for r in rows.groupBy(F.col("_metadata.file_path").alias("file")).count().collect()]
    assert max(sizes) <= 50 and 3 * files < len(sizes) <= 4 * files
    assert rows.count() == rows.select("id_student").distinct().count() == 10_000
