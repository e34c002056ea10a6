"""Token counts, the SentencePiece codec, language ID and LM scoring."""

import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import language_id, lm_scoring
from cohortlens.llm.queries import op3_language_id
from cohortlens.llm.sentencepiece_codec import BPE, UNIGRAM, Codec, Model, codec, sentencepiece_codec
from cohortlens.llm.token_counts import token_counts
from tests.conftest import SF_SMALL
from tests.llm.fixtures import CLASHES, edge_texts, frame

ODD = ["a", " ", "  ", "\n", "\t", "▁", "é", "日", "😀", "the", "<0x0A>", "<s>", "</s>", "<unk>", "aaa", "12", "\x00", "-", "ing", "'s", " ", "\x1c", "<|endoftext|>", "<|endof", "²."]


def odd_texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, name):
    rows = edge_texts() + [(500 + i, t) for i, t in enumerate(odd_texts(1))]
    path = public_tokenizers.path(name)
    texts = [t or "" for _, t in rows]
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
    else:
        from tokenizers import Tokenizer

        want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(frame(spark, rows), path).collect()]
    assert sorted(got, key=str) == sorted(((i, len(t.encode()), n) for (i, _), t, n in zip(rows, texts, want, strict=True)), key=str)
    assert token_counts(frame(spark, []), path).count() == 0


def test_codec_equals_sentencepiece_and_round_trips(spark):
    rows = edge_texts() + [(500 + i, t) for i, t in enumerate(odd_texts(2))]
    path = public_tokenizers.path("piece_bpe_32k.model")
    peer = codec(path).peer
    got = sentencepiece_codec(frame(spark, rows), path)
    assert [c for c in got.columns if c in CLASHES] == CLASHES
    want = sorted((i, peer.encode(t or ""), peer.decode(peer.encode(t or "")), "▁" not in (t or "")) for i, t in rows)
    out = got.collect()
    assert sorted((r.doc_id, r.piece_ids, r.decoded, r.round_trip) for r in out) == want
    assert all(r.parity and r.n_pieces == len(r.piece_ids) for r in out)
    assert sentencepiece_codec(frame(spark, []), path).count() == 0


def test_decoding_any_ids_equals_sentencepiece():
    own, rng = codec(public_tokenizers.path("piece_bpe_32k.model")), np.random.default_rng(4)
    for _ in range(200):
        ids = rng.integers(3, 32_000, rng.integers(0, 12))
        ids = ids[~own.is_byte[ids]]  # runs of loose bytes are not text
        assert own.decode(ids) == own.peer.decode(ids.tolist())


def _message(pieces, model_type, **flags):
    """A model message: pieces of (text, score, type), the trainer's and the normaliser's settings."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def chunk(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    out = b""
    for text, score, kind in pieces:
        out += chunk(1, chunk(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(kind))
    out += chunk(2, varint(3 << 3) + varint(model_type) + varint(35 << 3) + varint(int(flags.get("byte_fallback", True))))
    norm = b"".join(varint(k << 3) + varint(int(flags.get(name, True))) for k, name in ((3, "dummy"), (4, "collapse"), (5, "escape")))
    return out + chunk(3, chunk(1, b"identity") + norm)


@pytest.mark.parametrize("collapse", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
@pytest.mark.parametrize("model_type", [UNIGRAM, BPE])
def test_rebuilt_models_equal_sentencepiece(model_type, dummy, collapse):
    """Hand-made unigram and pair-merging models, with byte fallback, all white-space settings."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "aa", "aaa", "▁▁", "cab", "é", "éa"]
    pieces += [(w, -1.0 - 0.37 * k, 1) for k, w in enumerate(words)]
    message = _message(pieces, model_type, dummy=dummy, collapse=collapse)
    own, rng = Codec(message), random.Random(7)
    assert Model.parse(message).collapse_spaces == collapse
    texts = ["".join(rng.choice(["a", "b", "c", " ", "  ", "é", "x", "\n", "▁", "日"]) for _ in range(rng.randint(0, 15))) for _ in range(400)]
    ids, same = own.encode(texts)
    assert [x.tolist() for x in ids] == own.peer.encode(texts)
    assert all(same)


def test_language_gradient_is_the_numerical_one():
    net = language_id.Network.fresh(["x", "y", "z"])
    rng = np.random.default_rng(1)
    data, first, size = rng.integers(97, 110, 300).astype(np.uint8), np.array([0, 64, 128, 200]), np.array([64, 64, 30, 5])
    text, there = language_id._block(data, first, size)
    label = np.array([0, 1, 2, 1])
    _, g = net.gradient(text, there, label)
    for name in net.w:
        w = net.w[name]
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 1e-2
        up, _ = net.gradient(text, there, label)
        w[at] = old - 1e-2
        down, _ = net.gradient(text, there, label)
        w[at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3 + 0.03 * abs(g[name][at]), name


def test_language_labels_do_not_depend_on_the_block(spark):
    net = language_id.Network.fresh(["x", "y"])
    texts = ["ab" * n for n in (1, 40, 64, 65, 300)] + [""]
    alone = np.concatenate([language_id.document_probabilities(net, pa.array([t])) for t in texts])
    assert np.allclose(alone, language_id.document_probabilities(net, pa.array(texts)), atol=1e-5)


def test_language_held_out_accuracy_and_no_leak(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = op3_language_id(spark, SF_SMALL).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 30 and np.mean([r.lang == r.lang_pred for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    # other labels and names in the held-out quarter change nothing
    from cohortlens.llm.queries import held_out

    a = language_id.train_language_id(docs.filter(~held_out()))
    b = language_id.train_language_id(docs.withColumn("lang", F.when(held_out(), "zz").otherwise(F.col("lang"))).filter(~held_out()))
    assert a.languages == b.languages and all((a.w[k] == b.w[k]).all() for k in a.w)


def test_language_edge_cases(spark):
    net = language_id.Network.fresh(["x", "y"])
    out = language_id.identify_languages(frame(spark, edge_texts()), net)
    assert [c for c in out.columns if c in CLASHES and c != "score"] == [c for c in CLASHES if c != "score"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[7][0] in "xy"
    assert language_id.identify_languages(frame(spark, []), net).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None), (2, None, "x")], "doc_id long, text string, lang string")
    nothing = language_id.train_language_id(unlabelled)
    assert [r.lang_pred for r in language_id.identify_languages(unlabelled, nothing).collect()] == ["und", "und"]


def test_lm_gradient_is_the_numerical_one():
    net, rng = {k: v.astype(np.float64) for k, v in lm_scoring.fresh_network().items()}, np.random.default_rng(2)
    near, token, weight = rng.integers(0, 64, (4, 50)), rng.integers(0, 64, 50), rng.random(50)
    _, g = lm_scoring.gradient(net, near, token, weight)
    for name in net:
        at = np.unravel_index(np.abs(g[name]).argmax(), net[name].shape)
        old = net[name][at]
        net[name][at] = old + 1e-5
        up, _ = lm_scoring.gradient(net, near, token, weight)
        net[name][at] = old - 1e-5
        down, _ = lm_scoring.gradient(net, near, token, weight)
        net[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-5, name


def test_lm_scores_are_sums_of_conditionals():
    """Against a direct evaluation of the network, token by token."""
    net, table = lm_scoring.fresh_network(), np.arange(128, dtype=np.uint8) % 62 + 2
    texts = ["hello world", "", "a", "ab" * 40]
    codes, at = lm_scoring._padded_codes(texts, table)
    got = lm_scoring.Scorer(net).log_probabilities(codes, at)
    want = []
    for t in texts:
        c = [0, 0, *(int(table[ord(x)]) for x in t), 0, 0]
        for i in range(2, len(c) - 2):
            h = np.tanh(sum(net["near"][k][c[i + o]] for k, o in enumerate((-2, -1, 1, 2))) + net["bias"])
            z = h @ net["out"] + net["base"]
            want.append(z[c[i]] - np.log(np.exp(z).sum()))
    assert np.allclose(got, want, atol=1e-4)


def test_lm_training_counts_every_window_and_fits_the_corpus(spark):
    rows = [(i, "the cat sat on the mat. " * 4) for i in range(150)] + [(200, "zqx vkj qqz"), (201, None), (202, ""), (203, "ΑΒΓ 日本")]
    got = {r.doc_id: r for r in lm_scoring.score_documents(frame(spark, rows)).collect()}
    assert got[0].mean_log_likelihood > -0.3  # an untrained network gives log(1 / 64), about -4.2
    assert (got[201].n_tokens, got[201].log_likelihood, got[201].mean_log_likelihood) == (0, 0.0, 0.0)
    assert got[0].log_likelihood == got[149].log_likelihood and got[203].n_tokens == 6
    assert lm_scoring.score_documents(frame(spark, [])).count() == 0
    texts = frame(spark, rows).select(F.col("text").alias("_text"))
    table = lm_scoring.code_table(texts)
    shared = spark.sparkContext.broadcast(table)
    counted = texts.mapInArrow(lm_scoring._count_windows(shared), "w int, n long").agg(F.sum("n")).first()[0]
    assert counted == sum(len(t) for _, t in rows if t)


def test_lm_training_ignores_the_order_of_windows():
    rng = np.random.default_rng(5)
    w, n = rng.permutation(1 << 14)[:3000].astype(np.int32), rng.integers(1, 9, 3000)
    a = lm_scoring.train_shard(lm_scoring.fresh_network(), w, n, 0)
    order = rng.permutation(3000)
    b = lm_scoring.train_shard(lm_scoring.fresh_network(), w[order], n[order], 0)
    assert all((a[k] == b[k]).all() for k in a)


def test_lm_tells_fluent_from_shuffled_text_of_a_minority_script(spark):
    rng = np.random.default_rng(4)
    latin = [chr(c) for c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0xE0, 0xF7), *range(0xF8, 0xFF))]
    assert len(latin) > 62
    fluent = "мамамыларамуипапапилчай" * 8
    rows = [(i, "".join(rng.choice(latin, 3000))) for i in range(60)] + [(100 + i, fluent) for i in range(30)]
    rows.append((200, "".join(rng.permutation(list(fluent)))))
    got = {r.doc_id: r.mean_log_likelihood for r in lm_scoring.score_documents(frame(spark, rows)).collect()}
    assert got[100] > got[200] + 0.5


def test_lm_codes_and_shares_of_many_characters():
    characters = np.arange(0x4E00, 0x4E00 + 5000)
    table, rare = lm_scoring._code_table(characters), lm_scoring.rare_shares(characters, np.arange(5000, 0, -1))
    assert len(np.unique(table[characters[: lm_scoring.VOCABULARY]])) == lm_scoring.VOCABULARY and table[-1] == lm_scoring.OTHER
    assert abs(np.exp(rare[characters[lm_scoring.VOCABULARY :]]).sum() - 1) < 1e-9
    net = lm_scoring.fresh_network(4096)
    codes, at = lm_scoring._padded_codes(["".join(map(chr, characters[:300]))], table)
    w = lm_scoring._windows(codes, at, 12)
    assert (((w >> 24) & 4095) == codes[at]).all() and w.min() >= 0
    wide = lm_scoring.Scorer(net).log_probabilities(codes, at)
    h = np.tanh(sum(net["near"][k][codes[at + o]] for k, o in enumerate((-2, -1, 1, 2))))
    assert np.allclose(wide, (h @ net["out"])[np.arange(300), codes[at]] - np.log(np.exp(h @ net["out"]).sum(1)), atol=1e-4)
    again = lm_scoring.unflat(lm_scoring.flat(net))
    assert all((again[k] == net[k]).all() for k in net)


def test_language_id_learns_every_label(spark):
    rows = [(i, f"text of label {i % 300} " + chr(97 + i % 26) * 5, f"l{i % 300:03}") for i in range(900)]
    net = language_id.train_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.languages == [f"l{i:03}" for i in range(300)]


def test_language_sample_of_rows_without_ids_is_bounded(spark, monkeypatch):
    docs = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    seen = []
    monkeypatch.setattr(language_id, "train_network", lambda languages, segments, labels: seen.append(len(segments)) or language_id.Network.fresh(languages))
    language_id.train_language_id(docs)
    assert 500 < seen[0] <= language_id.SEGMENTS_PER_LANGUAGE


def test_document_probabilities_equal_a_naive_forward_pass():
    net = language_id.Network.fresh(["a", "b", "c"])
    rng = np.random.default_rng(3)
    texts = ["", "x", "héllo wörld " * 9, "1234", "".join(chr(97 + i) for i in rng.integers(0, 26, 200))]
    got = language_id.document_probabilities(net, pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        total, letters = np.zeros(3), 0
        for at in range(0, len(data), language_id.SEGMENT):
            piece = data[at : at + language_id.SEGMENT]
            alone = np.tile(net.w["c"].astype(float), (len(piece), 1))
            for d, order in (("f", range(len(piece))), ("b", range(len(piece) - 1, -1, -1))):
                h = np.zeros(language_id.HIDDEN)
                for t in order:
                    z, r = (1 / (1 + np.exp(-(net.w[f"x{d}{g}"][piece[t]] + h @ net.w[f"u{d}{g}"]))) for g in "zr")
                    new = np.tanh(net.w[f"x{d}n"][piece[t]] + r * (h @ net.w[f"u{d}n"]))
                    h = z * h + (1 - z) * new
                    alone[t] += h @ net.w[f"o{d}"]
            p = np.exp(alone - alone.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            inside = language_id._LETTER[piece]
            total += p[inside].sum(0)
            letters += inside.sum()
        assert np.allclose(row, total / max(1, letters), atol=1e-5)
