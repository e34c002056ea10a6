"""The SQL of the training-data queries gives the same rows, on the smallest tables and on planted secrets."""

import duckdb
import pytest

from cohortlens.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.llm.fixtures import edge_texts
from tests.llm.test_scans import SECRETS


def _rows(columns, records):
    order = sorted(columns)
    return order, sorted((tuple(r[columns.index(c)] for c in order) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    with duckdb.connect() as con:
        for t in ("documents", "benchmark", "conversations", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
        sql = con.sql(ORACLES[name])
        want = _rows(sql.columns, sql.fetchall())
    got = QUERIES[name](spark, SF_SMALL)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == want and want[1]


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op4_exact_dedup", "op5_benchmark_decontamination", "op7_secret_scan"])
def test_query_equals_its_sql_on_awkward_texts(spark, tmp_path, name):
    texts = [t for _, t in SECRETS] + [t for _, t in edge_texts() if t is None or ("\x00" not in t and len(t) < 5000)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    words = (texts[-3] or "").split()
    items = [(0, " ".join(words[2:20])), (1, "alpha"), (2, None), (3, "one two"), (4, "a " * 15)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        sql = con.sql(ORACLES[name])
        want = _rows(sql.columns, sql.fetchall())
    got = QUERIES[name](spark, str(tmp_path))
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == want
