"""Spelling variants, the quality classifier and hard negatives against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import hard_negatives, quality_classifier, spelling_variants
from cohortlens.llm.queries import op11_spelling_variants, op12_quality_classifier, op13_hard_negatives
from tests.conftest import SF_SMALL
from tests.llm.fixtures import FOLD, edge_texts, frame

# ---------------------------------------------------------------- spelling variants


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio=10):
    form, rows = {}, []
    for w, n in counts.items():
        near = [v for v in counts if abs(len(v) - len(w)) < 2 and is_near(v, w)]
        best = min(near, key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        rows.append((w, n, len(near)))
    out = []
    for w, n, near in rows:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near, counts.get(form[w])))
    return sorted(out, key=str)


def planted_counts(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def result(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def word_documents(seed=4):
    rng = random.Random(seed)
    stems = ["information", "organise", "Élémentaire", "strasse", "misspelling", "übermäßig", "x" * 300]
    texts = []
    for i in range(400):
        w = list(rng.choice(stems[: 1 + i % 7]))
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice("aeinsàXÿ") * rng.randint(0, 1)
        texts.append(" ".join("".join(w) for _ in range(rng.choice([1, 2, 30]))))
    return [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, texts[3]), (8, None), (9, ""), (9, texts[3])]


@pytest.mark.parametrize("sizes", [(512, 1024, 1_000_000), (4, 3, 50)])
def test_spelling_query_equals_brute_force(spark, tmp_path, monkeypatch, sizes):
    for name, size in zip(("CELL_WORDS", "BLOCK_WORDS", "PIECE_CHARS"), sizes, strict=True):
        monkeypatch.setattr(spelling_variants, name, size)
    docs = word_documents() + [(i, t) for i, t in edge_texts() if not t or len(t) < 5000]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    want = variants(planted_counts(docs))
    assert result(op11_spelling_variants(spark, str(tmp_path))) == want
    assert sum(f is not None for _, f, *_ in want) > 20 and any(f not in (None, r) for _, f, r, *_ in want)


def test_spelling_of_counts(spark):
    rows = [("colour", 5), ("color", 60), ("color", 40), ("colr", 9), ("coolr", 1), ("colorr", 1), (None, 4), ("", 3), ("日本語", 50), ("日本", 2), ("night", None), ("a" * 70000, 30), ("a" * 69999, 1)]
    counts = {}
    for w, n in rows:
        if w and n is not None:
            counts[w] = counts.get(w, 0) + n
    got = spelling_variants.spelling_variants(spark.createDataFrame(rows, "word string, n long"))
    assert result(got) == variants(counts)
    assert spelling_variants.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_more_letters_than_slots(spark):
    words = [chr(0x4E00 + i) + "abc" + chr(0x4E00 + (i * 7) % 300) for i in range(300)] + ["abc" + chr(0x4E00 + i) for i in range(40)]
    counts = {w: 1 + 20 * (i % 3) for i, w in enumerate(words)}
    assert result(spelling_variants.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == variants(counts)


def test_spelling_query_without_documents(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert op11_spelling_variants(spark, str(tmp_path)).count() == 0


# ---------------------------------------------------------------- quality


def test_quality_on_held_out_documents(spark):
    rows = op12_quality_classifier(spark, SF_SMALL.replace("0.001", "0.01")).collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet(SF_SMALL.replace("0.001", "0.01") + "/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [r.predicted == marks[r.doc_id] for r in rows if r.held_out and r.doc_id in marks]
    assert len(judged) > 50 and sum(judged) >= 0.95 * len(judged)


def test_quality_never_reads_labels_of_held_out_rows(spark, tmp_path):
    docs = [(i, ("Good plain words stand here. " if i % 3 else "@@ junk @@ ") * (1 + i % 5)) for i in range(300)]
    frame(spark, docs, clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    scores = []
    for flip in (False, True):
        marks = [(i, int(bool(i % 3)) ^ int(flip and zlib.crc32(str(i).encode()) % 4 == 2), 0) for i in range(300)]
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        scores.append(sorted((r.doc_id, r.score) for r in op12_quality_classifier(spark, str(tmp_path)).collect()))
    assert scores[0] == scores[1]
    assert all((s >= 0.7) == bool(i % 3) for i, s in scores[0])


def test_sparse_vectors_of_pieces_equal_those_of_whole_texts(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", "Cd ", "%%", " ", "\n", "é", "x1 ", "!! ", "Der "]) for _ in range(rng.randint(0, 400))) for _ in range(40)]
    texts += [None, "", "x" * 3000 + " y", "   "]
    whole = quality_classifier.sparse_vectors(pa.array(texts))
    monkeypatch.setattr(quality_classifier, "PIECE_BYTES", 64)
    for a, b in zip(whole, quality_classifier.sparse_vectors(pa.array(texts)), strict=True):
        assert np.allclose(a, b)


def test_one_update_equals_the_formulas():
    state = quality_classifier.FollowTheLeader.fresh()
    z, n = {}, {}
    q = quality_classifier
    rng = np.random.default_rng(5)
    for _ in range(50):
        slots = rng.choice(30, 5, replace=False)
        values, target = rng.normal(size=5), float(rng.integers(2))
        w = {}
        for s in slots:
            pull = (q.BETA + math.sqrt(n.get(s, 0))) / q.ALPHA + q.L2
            w[s] = 0.0 if abs(z.get(s, 0)) <= q.L1 else -(z[s] - math.copysign(q.L1, z[s])) / pull
        p = 1 / (1 + math.exp(-sum(w[s] * v for s, v in zip(slots, values, strict=True))))
        for s, v in zip(slots, values, strict=True):
            g = (p - target) * v
            sigma = (math.sqrt(n.get(s, 0) + g * g) - math.sqrt(n.get(s, 0))) / q.ALPHA
            z[s], n[s] = z.get(s, 0) + g - sigma * w[s], n.get(s, 0) + g * g
        state.learn(slots, values, target, 1.0)
    assert np.allclose([state.z[s] for s in z], list(z.values())) and np.allclose([state.n[s] for s in n], list(n.values()))


def test_quality_edge_cases(spark):
    docs = frame(spark, edge_texts() + [(None, "a b"), (None, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    empty = quality_classifier.train_quality(docs, none)
    assert {r.score for r in quality_classifier.score_quality(docs, empty).collect()} == {0.5}
    marks = spark.createDataFrame([(4, 1), (4, 0), (4, 1), (10, 0), (11, None), (None, 1), (999, 1), (60, 1)], "doc_id long, quality int")
    weights = quality_classifier.train_quality(docs, marks)
    got = quality_classifier.score_quality(docs, weights).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    assert quality_classifier.score_quality(frame(spark, []), weights).count() == 0


# ---------------------------------------------------------------- hard negatives


def mined(rows, scale=256):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [min(max(math.floor(scale * x), -(2**63)), 2**63 - 1) for x in v], label))
    out = []
    for a, (i, q, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = []
        for b, (j, r, other) in enumerate(kept):
            if b != a:
                s = sum(x * y for x, y in zip(q, r, strict=False))
                scored.append((-min(max(s, -(2**63)), 2**63 - 1), math.inf if j is None else j, j, other == label))
        scored.sort(key=lambda t: t[:2])
        for p, _, positive, _ in [t for t in scored if t[3]][:5]:
            found = [t for t in scored if not t[3] and 80 * -p <= 100 * -t[0] <= 100 * -p]
            out += [(i, positive, k + 1, t[2], -p, -t[0]) for k, t in enumerate(found[:5])]
    return sorted(out, key=str)


def vectors(seed, n=600, size=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    rows = [(i, (centres[i % 6] * rng.choice([0.2, 1]) + rng.normal(size=size)).tolist(), int(rng.integers(4))) for i in range(n)]
    rows += [(100, rows[0][1], 1), (100, rows[0][1], 1), (None, rows[200][1], 1), (None, rows[200][1], 2), (700, [], 1), (800, rows[3][1][:5], 2)]
    rows += [(900, None, 1), (1000, rows[5][1], None), (1100, [float("nan")] * size, 1), (1200, [None] * size, 1), (1300, [float("inf")], 1), (1400, [0.0] * size, 1)]
    return rows + [(1501 + i, rows[300][1], 3 if i % 2 else 0) for i in range(60)]


def got_rows(df):
    return sorted(((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=str)


@pytest.mark.parametrize("sizes", [(16384, 64), (97, 2)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "ROWS", sizes[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", sizes[1])
    rows = vectors(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, row string")
    want = mined(rows)
    assert got_rows(hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0)) == want and len(want) > 50


def test_hard_negatives_pack_no_block_into_a_row(spark, monkeypatch):
    packed, kept = [], hard_negatives.checkpointed

    def stored(df):
        packed.extend(f.name for f in df.schema if f.dataType.simpleString().startswith("array<struct<") and "q:" in f.dataType.simpleString())
        return kept(df)

    monkeypatch.setattr(hard_negatives, "checkpointed", stored)
    df = spark.createDataFrame(vectors(1), "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0).count() > 50 and packed == []


def test_hard_negatives_of_large_numbers_and_text_labels(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.choice([1e9, 3e7, 1.5, -2e8, 1e30 if i == 7 else 0.0], 4)], int(rng.integers(3))) for i in range(120)]
    df = spark.createDataFrame([(i, v, f"l{label}") for i, v, label in rows], "vec_id long, embedding array<double>, label string")
    assert got_rows(hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0)) == mined(rows)


def test_hard_negatives_without_rows_or_anchors(spark):
    df = spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine_hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_hard_negative_query_is_the_brute_force_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert got_rows(op13_hard_negatives(spark, SF_SMALL)) == mined(rows)


@pytest.mark.parametrize("part", [0.0, 3.0, 8.0])
def test_index_search_loses_no_row(part):
    rng = np.random.default_rng(6)
    m = np.floor(rng.normal(size=(300, 30)) * np.linspace(4, 0.1, 30))
    index = hard_negatives.Index(m, part)
    for a in np.floor(rng.normal(size=(40, 30)) * 3):
        limit = max(part * np.sqrt((a * a).sum()), 1.0)
        found, scores = index.search(a, limit, np.ones(300, bool))
        want = np.flatnonzero(m @ a >= limit)
        assert sorted(index.order[found]) == want.tolist() and (m[index.order[found]] @ a == scores).all()
    assert part == 0 or index.entries.min() < index.entries.max()
