"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A token is a run of letters and digits or a run of other printable characters,
lower-cased in A-Z.  Features are the hashes of its n-grams in ``BUCKETS``
slots: of one and two words, and of one to three word classes (kinds of the
first and last character, and whether the word repeats the one before).  A
document is a sparse vector of log(1 + count) with length one in each of the
two families, and a bias; its score is the logistic function of the sparse dot
product with the weights.

Training reads at most ``PER_CLASS`` documents of each label (those with the
smallest hashes; texts over ``TRAINING_BYTES`` are not learned from), on the
driver, in ``EPOCHS`` passes of per-coordinate follow-the-regularised-leader
updates; rows weigh as much as their label's share of all labels asks.
Scoring runs in the tasks over whole texts, a long one in pieces of
``PIECE_BYTES`` that overlap by three words.

Edge cases: a null text counts as empty and gets the score of the bias alone,
as a text without tokens does; several labels of one document are averaged;
null labels and labels of missing documents are not learned from; without any
label every score is 0.5; rows that share an id share the label; repeated rows
get equal scores; an unbroken run of any length is one token, held whole; an
empty table gives an empty result; extra columns pass through, and the result
column replaces one of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import mix, ship_package, text_bytes, text_steps, with_columns, words

#: Slots of the hashed n-grams; the weights are broadcast (1 MB).
BUCKETS = 1 << 18
PER_CLASS, TRAINING_BYTES, PIECE_BYTES = 2000, 1 << 15, 1 << 20
EPOCHS, ALPHA, BETA, L1, L2, SEED = 4, 0.5, 1.0, 0.02, 0.2, 12
_BIAS = BUCKETS
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: 0 other, 1 lower case, 2 upper case, 3 digit, 4 not ASCII; marks count as themselves.
_KIND = np.arange(256, dtype=np.uint64) + np.uint64(8)
for _b in range(256):
    _KIND[_b] = 4 if _b >= 0x80 else 1 if chr(_b).islower() else 2 if chr(_b).isupper() else 3 if chr(_b).isdigit() else _KIND[_b]
_REPEAT = np.uint64(1 << 20)


def _ngrams(h: np.ndarray, place: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Slot of the n-gram that ends at each token; -1 where the text has fewer tokens before it."""
    out = np.full(len(h), salt, np.uint64)
    for back in range(size - 1, -1, -1):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + np.roll(h, back))
    return np.where(place >= size - 1, (out & np.uint64(BUCKETS - 1)).astype(np.int64), -1)


def _counts(data: np.ndarray, offsets: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, family, slot) and how often each occurs; n-grams ending in the first ``skip`` tokens are left out."""
    kind = _LETTER[data]
    turn = np.zeros(len(data), bool)
    turn[1:] = kind[1:] != kind[:-1]
    h, starts, ends, first = words(data, offsets, ~_SPACE, turn)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    place = np.arange(len(h)) - first[text]
    shape = _KIND[data[starts]] * np.uint64(512) + _KIND[data[ends - 1]]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    shape = shape + _REPEAT * same.astype(np.uint64)
    keys = []
    for family, hashes, sizes in ((0, h, (1, 2)), (1, mix(shape), (1, 2, 3))):
        for size in sizes:
            slot = _ngrams(hashes, place, size, size + 10 * family)
            there = (slot >= 0) & (place >= skip)
            keys.append(((text[there] * 2 + family) << 18) + slot[there])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key >> 19, key & (2 * BUCKETS - 1), n


def _next_space(data: np.ndarray, at: int) -> int:
    while at < len(data):
        hit = np.flatnonzero(_SPACE[data[at : at + 65536]])
        if len(hit):
            return at + int(hit[0])
        at += 65536
    return len(data)


def _pieces(data: np.ndarray):
    """(bytes, number of tokens at their start that an earlier piece has counted) of one long text."""
    at, back, skip = 0, 0, 0
    while at < len(data):
        at = _next_space(data, at + PIECE_BYTES)
        piece = data[back:at]
        yield piece, skip
        tail = piece[-PIECE_BYTES // 2 :] if len(piece) > PIECE_BYTES else piece
        turns = np.append(False, _LETTER[tail[1:]] != _LETTER[tail[:-1]])
        _, starts, _, _ = words(tail, np.array([0, len(tail)]), ~_SPACE, turns)
        if len(starts) < 4 and len(tail) < len(piece):
            tail = piece
            _, starts, _, _ = words(tail, np.array([0, len(tail)]), ~_SPACE, np.append(False, _LETTER[tail[1:]] != _LETTER[tail[:-1]]))
        skip = min(3, len(starts))  # two for the n-grams, one for what the first of them repeats
        back = at - len(tail) + int(starts[-skip]) if skip else at


def sparse_vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, slot and value of every feature but the bias; both families of a text have length one."""
    data, offsets = text_bytes(texts)
    long = np.flatnonzero(np.diff(offsets) > PIECE_BYTES)
    if len(long):
        found = []
        for i in range(len(texts)):
            totals = np.zeros(2 * BUCKETS, np.int64)
            for piece, skip in _pieces(data[offsets[i] : offsets[i + 1]]):
                _, slot, n = _counts(piece, np.array([0, len(piece)]), skip)
                totals[slot] += n
            slot = np.flatnonzero(totals)
            found.append((np.full(len(slot), i), slot, totals[slot]))
        text, slot, n = (np.concatenate(x) for x in zip(*found, strict=True))
    else:
        text, slot, n = _counts(data, offsets)
    value = np.log1p(n)
    group = text * 2 + (slot >> 18)
    norms = np.sqrt(np.bincount(group, value * value, 2 * len(texts)))
    return text, slot & (BUCKETS - 1), value / norms[group]


@dataclass
class FollowTheLeader:
    """Per-coordinate state of the proximal updates: gradient sums less the pull of earlier weights, and squared gradients."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def fresh(cls) -> FollowTheLeader:
        return cls(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1))

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        l1 = np.where(slots == _BIAS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, values: np.ndarray, target: float, weight: float) -> None:
        """One update; no slot occurs twice."""
        w = self.weights(slots)
        g = weight * (logistic(float(w @ values)) - target) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + g * g


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _training_vectors(batches):
    """Rows with the slots and values of their texts."""
    for batch in text_steps(batches):
        text, slot, value = sparse_vectors(batch.column("_text"))
        ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
        at = range(batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("place"),
                batch.column("target"),
                pa.array([slot[ends[i] : ends[i + 1]].astype("<i4").tobytes() for i in at], pa.binary()),
                pa.array([value[ends[i] : ends[i + 1]].astype("<f4").tobytes() for i in at], pa.binary()),
            ],
            names=["place", "target", "slots", "vals"],
        )


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learned from the labelled documents (label 1 is good); empty without labels.

    Ids find the label and place a document in the sample; they are no feature.
    """
    ship_package(docs.sparkSession)
    marks = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("y")).filter("y IN (0, 1) AND _id IS NOT NULL")
    marks = marks.groupBy("_id").agg(F.avg("y").alias("target")).withColumn("good", F.col("target") >= 0.5)
    totals = {r.good: r["count"] for r in marks.groupBy("good").count().collect()}
    found = []
    for good in sorted(totals):
        chosen = marks.filter(F.col("good") == F.lit(good)).orderBy(F.xxhash64("_id"), "_id").limit(PER_CLASS)
        rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
        rows = rows.filter(F.octet_length("_text") <= TRAINING_BYTES).join(F.broadcast(chosen), "_id")
        rows = rows.select("_text", F.xxhash64(F.col("_id").cast("string"), "_text").alias("place"), "target")
        vectors = rows.mapInArrow(_training_vectors, "place long, target double, slots binary, vals binary")
        mine = vectors.orderBy("place", "slots").limit(PER_CLASS).collect()
        found += [(r.place, r.target, np.frombuffer(r.slots, "<i4"), np.frombuffer(r.vals, "<f4"), totals[good] / len(mine)) for r in mine]
    if not found:
        return np.zeros(0, np.float32)
    scale = np.mean([r[4] for r in found])
    found.sort(key=lambda r: (r[0], r[1]))
    rng, state = np.random.default_rng(SEED), FollowTheLeader.fresh()
    prepared = []
    for _, target, slots, vals, weight in found:
        own, where = np.unique(slots, return_inverse=True)  # both families share the slots
        prepared.append((np.append(own, _BIAS), np.append(np.bincount(where, vals, len(own)), 1.0), target, weight / scale))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(prepared)):
            state.learn(*prepared[i])
    return state.weights(np.arange(BUCKETS + 1)).astype(np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row's kept columns (all by default) with ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(texts: pa.Array, _) -> list[pa.Array]:
        weights = shared.value
        if not len(weights):
            return [pa.array(np.full(len(texts), 0.5))]
        text, slot, value = sparse_vectors(texts)
        return [pa.array(logistic(np.bincount(text, value * weights[slot], len(texts)) + float(weights[_BIAS])))]

    return with_columns(docs, text_col, T.StructType().add("score", "double"), score, keep)
