"""Language ID by a bidirectional gated recurrent network over bytes.

Texts are read as UTF-8 bytes in segments of ``SEGMENT`` bytes.  One gated
recurrent layer runs over each segment forwards, another backwards; both states
together label every byte position with a language.  A document's probability
of a language is the mean of its letter positions' probabilities, over the whole text.

The network is trained in numpy by backpropagation through time, on the driver,
from a bounded sample of labelled documents: ``PER_LANGUAGE`` documents of each
language in expectation, chosen by a hash of their id and text, at most
``SEGMENTS_PER_DOCUMENT`` segments of each, spread over the text, and at most
``SEGMENTS_PER_LANGUAGE`` segments of a language.  Every label is learned.  Prediction
runs in the tasks over whole texts, in blocks of ``BLOCK`` segments.

Edge cases: a null text and a text without letters get ``und`` with score 0; a
text of any length is read whole, in bounded memory; rows with null language
or null text are not learned from; without any labelled row every document is
``und``; ties between languages go to the one that sorts first; repeated rows
get equal results; an empty table gives an empty result; extra columns pass
through, and the result columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import checkpointed, ship_package, text_bytes, text_steps, with_columns

SEGMENT, HIDDEN, BLOCK = 64, 16, 4096
PER_LANGUAGE, SEGMENTS_PER_DOCUMENT = 1000, 3
#: A language's sample is cut to this many segments (the smallest hashes stay) before it reaches the driver.
SEGMENTS_PER_LANGUAGE = 3000
STEPS, BATCH, RATE, SEED = 240, 256, 0.02, 20
UNKNOWN = "und"
_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_GATES = "zrn"


def segment_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all texts: first byte, length, and the text's number."""
    sizes = np.diff(offsets)
    counts = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = offsets[text] + nth * SEGMENT
    return first, np.minimum(SEGMENT, offsets[text + 1] - first), text


def _block(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, segment) bytes, and which positions exist; padding comes last."""
    step = np.arange(SEGMENT)[:, None]
    there = step < size
    return np.where(there, data[np.minimum(first + step, len(data) - 1)], 0).astype(np.intp), there


@dataclass
class Network:
    """Weights by name: ``x`` (by byte) and ``u`` (by state) of each direction (f, b) and gate (z, r, n); ``o``, ``c`` for the labels.

    ``z`` keeps the old state, ``r`` scales the recurrent part of the candidate ``n``.
    """

    languages: list[str]
    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str]) -> Network:
        rng = np.random.default_rng(SEED)
        w = {}
        for d in "fb":
            for g in _GATES:
                w[f"x{d}{g}"] = rng.normal(0, 0.3, (256, HIDDEN))
                w[f"u{d}{g}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN))
            w[f"o{d}"] = rng.normal(0, 0.3, (HIDDEN, len(languages)))
        w["c"] = np.zeros(len(languages))
        return cls(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def run(self, d: str, text: np.ndarray, there: np.ndarray, out: np.ndarray, keep: list | None = None) -> None:
        """Adds the direction's part of every position's label scores to out; keep gets every step's states."""
        w, n = self.w, text.shape[1]
        h = np.zeros((n, HIDDEN), np.float32)
        z, r, c, m = (np.empty_like(h) for _ in range(4))
        half = np.float32(0.5)
        padded = not there.all()
        for t in range(SEGMENT) if d == "f" else range(SEGMENT - 1, -1, -1):
            if keep is not None:
                z, r, c, m = (np.empty_like(h) for _ in range(4))
            for gate, into in (("z", z), ("r", r)):
                np.take(w[f"x{d}{gate}"], text[t], axis=0, out=into, mode="clip")
                np.matmul(h, w[f"u{d}{gate}"], out=c)
                into += c
                into *= half
                np.tanh(into, out=into)
                into += 1
                into *= half
            np.matmul(h, w[f"u{d}n"], out=m)
            np.take(w[f"x{d}n"], text[t], axis=0, out=c, mode="clip")
            c += r * m
            np.tanh(c, out=c)
            before = h
            h = h - c
            h *= z
            h += c
            if padded and d == "b":
                h *= there[t][:, None]
            out[t] += h @ w[f"o{d}"]
            if keep is not None:
                keep.append((t, before, z, r, c, m, h))

    def scores(self, text: np.ndarray, there: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Label scores of every position, (position, segment, language), before the softmax."""
        out = np.empty((*text.shape, len(self.languages)), np.float32)
        out[:] = self.w["c"]
        for d in "fb":
            self.run(d, text, there, out, None if keep is None else keep.setdefault(d, []))
        return out

    def gradient(self, text: np.ndarray, there: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the letter positions, and its gradient by backpropagation through time."""
        keep: dict = {}
        p, total = exponentials(self.scores(text, there, keep))
        p /= total[:, :, None]
        counts = there & _LETTER[text]
        n, positions = np.arange(len(label)), max(1, counts.sum())
        loss = -np.log(np.maximum(p[:, n, label], 1e-9))[counts].sum() / positions
        p[:, n, label] -= 1
        p *= (counts / positions)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["c"] = p.sum((0, 1))
        for d in "fb":
            w, dh = self.w, np.zeros((len(label), HIDDEN), p.dtype)
            for t, before, z, r, c, m, h in reversed(keep[d]):
                g[f"o{d}"] += h.T @ p[t]
                dh = (dh + p[t] @ w[f"o{d}"].T) * there[t][:, None]
                dc = dh * (1 - z) * (1 - c * c)
                inner = {"z": dh * (before - c) * z * (1 - z), "r": dc * m * r * (1 - r), "n": dc}
                dh = dh * z
                for gate in _GATES:
                    np.add.at(g[f"x{d}{gate}"], text[t], inner[gate])
                    through = inner[gate] * r if gate == "n" else inner[gate]
                    g[f"u{d}{gate}"] += before.T @ through
                    dh += through @ w[f"u{d}{gate}"].T
        return float(loss), g


def exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the label scores (states are within -1 and 1, so they stay small), and each position's sum."""
    np.exp(np.clip(x, -60, 60, out=x), out=x)
    return x, x @ np.ones(x.shape[-1], x.dtype)


def train_network(languages: list[str], segments: list[bytes], labels: np.ndarray) -> Network:
    """Adam over shuffled batches; deterministic for given segments in a given order."""
    net, rng = Network.fresh(languages), np.random.default_rng(SEED)
    mean = {k: np.zeros_like(v) for k, v in net.w.items()}
    square = {k: np.zeros_like(v) for k, v in net.w.items()}
    size = np.array([len(s) for s in segments])
    data = np.frombuffer(b"".join(segments), np.uint8)
    first = np.cumsum(size) - size
    order = rng.permutation(len(segments))
    for t in range(1, STEPS + 1):
        if len(order) < min(BATCH, len(segments)):
            order = np.concatenate([order, rng.permutation(len(segments))])
        part, order = order[:BATCH], order[BATCH:]
        _, g = net.gradient(*_block(data, first[part], size[part]), labels[part])
        norm = max(1.0, float(np.sqrt(sum((v.astype(np.float64) ** 2).sum() for v in g.values()))))
        rate = RATE * (1 - 0.9 * t / STEPS) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        for k, v in g.items():
            v /= norm
            mean[k] += 0.1 * (v - mean[k])
            square[k] += 0.01 * (v * v - square[k])
            net.w[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-6)).astype(np.float32)
    return net


def _sampled_segments(batches):
    """At most SEGMENTS_PER_DOCUMENT segments of each text, spread evenly over it."""
    for batch in text_steps(batches):
        data, offsets = text_bytes(batch.column(1))
        first, size, text = segment_bytes(data, offsets)
        rows = []
        for i, (a, b) in enumerate(zip(np.searchsorted(text, np.arange(batch.num_rows)), np.searchsorted(text, np.arange(batch.num_rows), side="right"), strict=True)):
            for j in sorted({a + (b - a) * k // SEGMENTS_PER_DOCUMENT for k in range(SEGMENTS_PER_DOCUMENT)}) if b > a else ():
                rows.append((i, j))
        take = pa.array([i for i, _ in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(2).take(take),
                batch.column(3).take(take),
                pa.array([j for _, j in rows], pa.int64()),
                pa.array([data[first[j] : first[j] + size[j]].tobytes() for _, j in rows], pa.binary()),
            ],
            names=["lang", "place", "nth", "segment"],
        )


def train_language_id(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """A network for the languages of ``labelled``; ids only choose the sample."""
    ship_package(labelled.sparkSession)
    rows = labelled.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    )
    rows = rows.filter(F.col("_text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    counts = checkpointed(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    place = F.xxhash64(F.col("_id").cast("string"), "_text")
    # one row for each label, all of which the network holds
    sample = rows.withColumn("place", place).join(F.broadcast(counts), "lang").filter(F.pmod("place", F.lit(1 << 20)) * F.col("n") < PER_LANGUAGE * (1 << 20))
    segments = sample.select("_id", "_text", "lang", "place").mapInArrow(_sampled_segments, "lang string, place long, nth long, segment binary")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "nth", "segment"))
    found = segments.withColumn("rank", first).filter(F.col("rank") <= SEGMENTS_PER_LANGUAGE).collect()
    if not found:
        return Network.fresh([])
    languages = sorted(r.lang for r in counts.select("lang").collect())
    index = {lang: j for j, lang in enumerate(languages)}
    rows = sorted((r.lang, r.place, r.nth, bytes(r.segment)) for r in found)
    return train_network(languages, [r[3] for r in rows], np.array([index[r[0]] for r in rows]))


def document_probabilities(net: Network, texts: pa.Array) -> np.ndarray:
    """Mean probability of each language over the letter positions of each whole text; 0 where there are none."""
    data, offsets = text_bytes(texts)
    first, size, text = segment_bytes(data, offsets)
    sums, counts = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    for at in range(0, len(first), BLOCK):
        f, s = first[at : at + BLOCK], size[at : at + BLOCK]
        block, there = _block(data, f, s)
        letters = (there & _LETTER[block]).astype(np.float32)
        e, total = exponentials(net.scores(block, there))
        np.add.at(sums, text[at : at + BLOCK], np.einsum("tbl,tb->bl", e, letters / total))
        np.add.at(counts, text[at : at + BLOCK], letters.sum(0))
    return sums / np.maximum(counts, 1)[:, None]


def identify_languages(docs: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row's kept columns (all by default) with ``lang_pred`` and ``score`` (the predicted language's probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def predict(texts: pa.Array, _) -> list[pa.Array]:
        import regex

        net, letter = shared.value, regex.compile(r"\p{L}")
        known = np.array([t is not None and letter.search(t) is not None for t in texts.to_pylist()], bool)
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if net.languages and known.any():
            p = document_probabilities(net, texts)
            lang = [net.languages[j] if k else UNKNOWN for j, k in zip(p.argmax(1), known, strict=True)]
            score = np.where(known, np.clip(p.max(1), 0, 1), 0.0)
        return [pa.array(lang, pa.string()), pa.array(score)]

    return with_columns(docs, text_col, T.StructType().add("lang_pred", "string").add("score", "double"), predict, keep)
