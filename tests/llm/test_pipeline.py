"""The pipeline against a brute-force version, and the registered queries."""

import re

import public_tokenizers

import __spark_entry__
import corpus_pipeline
from cohortlens.llm.sentencepiece_codec import codec
from tests.conftest import SF_SMALL
from tests.llm.test_dedup import brute_components
from tests.llm.test_scans import brute_hits
from tests.llm.fixtures import FOLD


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding",
    ]


def test_every_operator_is_registered_once():
    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def brute_pipeline(docs, items):
    """doc_id -> piece count; the network decides the language only, never whether a text with letters stays."""
    kept = {i: t for i, t in docs if t is not None and any(c.isalpha() for c in t)}
    last = {t.translate(FOLD): i for i, t in sorted(kept.items())}
    kept = {i: t for i, t in kept.items() if last[t.translate(FOLD)] == i}
    groups = brute_components(list(kept.items()), 5, 4, 5)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    hits = brute_hits(kept.items(), items)
    peer = codec(public_tokenizers.path("piece_bpe_32k.model")).peer
    return {i: len(peer.encode(t)) for i, t in kept.items() if not hits[i][1]}


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    out = got.collect()
    assert {r.doc_id: r.n_pieces for r in out} == brute_pipeline([tuple(r) for r in docs], [tuple(r) for r in items])
    assert all(r.parity and r.round_trip for r in out)


def test_stages_with_nulls_copies_and_an_empty_table(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(60))
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first().text
    rows = [
        (1, None, None, "a", None), (2, "", "en", None, 0), (3, "12 34", "en", "a", 5), (4, long, "en", "a", 1), (4, long, "en", "a", 1),
        (5, long.upper(), None, None, None), (6, long + " more", "en", "a", 1), (7, "Avant. " + item, "fr", "b", 9), (8, "kept text", "en", None, 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF_SMALL)
            if k < 4:
                assert out.columns == docs.columns
            path = str(tmp_path / f"{len(table)}-{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert {r.doc_id for r in docs.collect()} == ({5, 8} if table else set())


def test_guard_stands_in_the_entry_alone():
    for module in (corpus_pipeline, *(__import__(f"cohortlens.llm.{m}", fromlist=["x"]) for m in ("queries", "common", "ngram_join"))):
        assert not re.search(r"except \(?(ImportError|ModuleNotFoundError)", open(module.__file__).read())


def test_documents_stay_where_no_language_could_be_learned(spark):
    rows = [(1, "clean text", None, "a", 10), (2, "日本語", None, "a", 3), (3, "12 34", None, "a", 5), (4, None, None, "a", None), (5, "", None, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.identified(spark, docs, SF_SMALL).collect()
    assert {(r.doc_id, r.lang) for r in got} == {(1, "und"), (2, "und")}


def test_rows_without_an_id_are_judged_by_themselves(spark, tmp_path):
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first().text
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(None, "Before. " + item), (None, "clean text of its own"), (3, "other words here"), (3, "Again. " + item), (None, long), (9, long + " more"), (None, "clean second")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    near = stages["n-gram Jaccard join"](spark, docs, SF_SMALL)
    assert sorted((r.doc_id, r.text) for r in near.filter("text LIKE 'word%'").collect()) == [(9, long + " more")]
    clean = stages["benchmark decontamination"](spark, docs, SF_SMALL)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(((i, t) for i, t in rows if item not in t), key=str)
