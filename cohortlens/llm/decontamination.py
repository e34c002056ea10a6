"""Benchmark decontamination by winnowing.

A word run of ``SPAN`` words holds ``WINDOW = SPAN - GRAM + 1`` hashed runs of
``GRAM`` words; winnowing keeps the smallest hash of every ``WINDOW``
neighbours (the rightmost of equals).  The same span gives the same smallest
hash in a document and in a benchmark item, so joining the kept fingerprints
finds every shared span of ``SPAN`` words or more.

Every fingerprint carries the word hashes around it (``SPAN - GRAM`` to either
side).  A joined pair is extended word by word to both sides; it is a hit if
the equal words reach ``SPAN``, and the extended span's words are hit words.
An item of fewer than ``SPAN`` words has one fingerprint, the hash of all its
words, which is compared with all runs of that length in the documents.

Both sides are reduced before the join: a task first drops fingerprints that
are not in a bitmap of the benchmark's fingerprints (``BITS`` bits, the same
size at any benchmark size), equal fingerprints with equal surroundings are one
row per document with a list of places, and one row per distinct fingerprint
and surroundings on the benchmark side.  The join itself is an equi-join on the fingerprint;
Spark broadcasts the benchmark side when it is small, and shuffles both when
it is not.

Edge cases: null and empty texts, and texts without words, have no words and
are never hit; items without words occur nowhere; equal item ids are one item;
every document row is judged by itself, also rows that share an id or have none;
empty tables give an empty result, or clean documents; other columns are not
read.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import checkpointed, grams, keyed, mix, text_bytes, text_steps, word_mask, words

SPAN, GRAM = 10, 5
SIDE, WINDOW = SPAN - GRAM, SPAN - GRAM + 1
BITS = 1 << 22
#: Words are runs of ASCII letters and digits and of all characters above ASCII.
WORD = word_mask(lambda b: b >= 0x80 or chr(b).isalnum())
_FINGERPRINT = "key long, around array<long>"


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the kept hashes: the smallest of each WINDOW neighbours, the rightmost of equals."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    shifted = np.lib.stride_tricks.sliding_window_view(h[::-1], WINDOW)
    least = len(h) - 1 - (np.arange(len(shifted)) + shifted.argmin(axis=1))
    return np.unique(least)


def whole_key(h: np.ndarray, n: int) -> np.ndarray:
    """Keys of all runs of n words, for items of fewer than SPAN words; apart from the keys of fingerprints."""
    return mix(grams(h, n) ^ np.uint64(0x94D049BB133111EB))


def _around(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The word hashes from SIDE before to SIDE behind each fingerprint; 0 beyond the text."""
    padded = np.concatenate([np.zeros(SIDE, np.uint64), np.maximum(h, np.uint64(1)), np.zeros(SIDE, np.uint64)])
    return padded[at[:, None] + np.arange(SPAN + SIDE)]


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(BITS - 1)).astype(np.int64)


def _lists(rows: np.ndarray, width: int) -> pa.ListArray:
    ends = np.arange(0, rows.size + 1, width, dtype=np.int32) if width else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1).view(np.int64)))


def _item_rows(batches):
    """Every item's fingerprints; a short item has its own key, its length, and nothing around it."""
    for batch in text_steps(batches):
        data, offsets = text_bytes(batch.column(1))
        h, _, _, at = words(data, offsets, WORD)
        for i in range(batch.num_rows):
            own = h[at[i] : at[i + 1]]
            if not len(own):
                continue
            if len(own) < SPAN:
                key, around, short = whole_key(own, len(own)), pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.int64())), len(own)
            else:
                k = grams(own, GRAM)
                kept = winnow(k)
                key, around, short = k[kept], _lists(_around(own, kept), SPAN + SIDE), 0
            item = pa.array([batch.column(0)[i].as_py()] * len(key), batch.column(0).type)
            yield pa.RecordBatch.from_arrays(
                [item, pa.array(key.view(np.int64)), around, pa.array(np.full(len(key), short, np.int32))], names=["item", "key", "around", "short"]
            )


def _document_rows(bitmap, shorts: list[int]):
    """One row per document and distinct fingerprint of the bitmap, with its places; and one with the word count."""

    def run(batches):
        # rows are numbered: a number tells rows apart that share an id
        seen, numbers = bitmap.value, itertools.count(TaskContext.get().partitionId() << 40)
        for batch in text_steps(batches):
            data, offsets = text_bytes(batch.column(1))
            h, _, _, at = words(data, offsets, WORD)
            row = np.array([next(numbers) for _ in range(batch.num_rows)], np.int64)
            doc, key, around, places, counts = [], [], [], [], []
            for i in range(batch.num_rows):
                own = h[at[i] : at[i + 1]]
                k = grams(own, GRAM)
                kept = winnow(k)
                kept = kept[seen[_slots(k[kept])]]
                if len(kept):
                    near = _around(own, kept)
                    _, first, group = np.unique(near, axis=0, return_index=True, return_inverse=True)
                    for g, j in enumerate(first):
                        doc.append(i)
                        key.append(k[kept[j]])
                        around.append(near[j].view(np.int64))
                        places.append(kept[group.reshape(-1) == g] if len(first) > 1 else kept)
                for n in shorts:
                    w = whole_key(own, n)
                    found = np.flatnonzero(seen[_slots(w)])
                    if len(found):
                        distinct, group = np.unique(w[found], return_inverse=True)
                        order = np.argsort(group, kind="stable")
                        for g, part in enumerate(np.split(found[order], np.cumsum(np.bincount(group))[:-1])):
                            doc.append(i)
                            key.append(distinct[g])
                            around.append(np.zeros(0, np.int64))
                            places.append(part)
                counts.append(len(own))
            n = batch.num_rows
            lists = lambda parts: pa.array([*parts, *[None] * n], pa.list_(pa.int64()))
            of = np.array([*doc, *range(n)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row[of]),
                    batch.column(0).take(pa.array(of)),
                    pa.array([*[None] * len(doc), *counts], pa.int64()),
                    pa.array([*(int(np.int64(np.uint64(x))) if x < 1 << 63 else int(x) - (1 << 64) for x in map(int, key)), *[None] * n], pa.int64()),
                    lists(around),
                    lists(places),
                ],
                names=["row", "doc", "n_words", "key", "around", "places"],
            )

    return run


def _reach(step: int) -> str:
    """SQL: how many words next to the fingerprint are equal in d and b, going by step (-1 or 1)."""
    first = SIDE if step < 0 else SIDE + GRAM + 1  # element_at counts from 1
    tests = []
    for j in range(SIDE):
        at = first + step * j
        tests.append(f"WHEN element_at(d, {at}) <> element_at(b, {at}) OR element_at(d, {at}) = 0 THEN {j}")
    return f"CASE {' '.join(tests)} ELSE {SIDE} END"


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``spans`` (hit spans, first and last word) and ``items`` (sorted by text) of every document row."""
    spark = docs.sparkSession
    item_kind, doc_kind = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    marks = keyed(items, item_col, item_text_col).mapInArrow(_item_rows, f"item {item_kind}, {_FINGERPRINT}, short int")
    marks = checkpointed(marks.groupBy("key", "around", "short").agg(F.collect_set("item").alias("items")))

    taken = marks.select(F.col("key").bitwiseAND(F.lit(BITS - 1)).alias("slot")).distinct().toArrow().column(0).to_numpy()
    bitmap = np.zeros(BITS, bool)
    bitmap[taken] = True
    shorts = sorted(r.short for r in marks.filter("short > 0").select("short").distinct().collect())
    rows = keyed(docs, id_col, text_col).mapInArrow(
        _document_rows(spark.sparkContext.broadcast(bitmap), shorts), f"row long, doc {doc_kind}, n_words long, {_FINGERPRINT}, places array<long>"
    )
    rows = checkpointed(rows)

    joined = rows.filter("key is not null").select("row", "key", F.col("around").alias("d"), "places")
    joined = joined.join(marks.select("key", F.col("around").alias("b"), "short", "items"), "key").filter("(size(d) = 0) = (short > 0)")
    left = F.when(F.col("short") > 0, 0).otherwise(F.expr(_reach(-1)))
    right = F.when(F.col("short") > 0, F.col("short")).otherwise(GRAM + F.expr(_reach(1)))
    hits = joined.select("row", "places", "items", "short", left.alias("left"), right.alias("right"))
    hits = hits.filter((F.col("short") > 0) | (F.col("left") + F.col("right") >= SPAN))

    found = hits.select("row", F.explode("items").alias("item")).distinct()
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))
    spans = hits.select("row", "left", "right", F.explode("places").alias("at"))
    spans = spans.groupBy("row", (F.col("at") - F.col("left")).alias("first")).agg(F.max(F.col("at") + F.col("right")).alias("past"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "past"))).alias("spans"))
    # words covered by the spans, in order of their first words
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("past")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["past"] - F.greatest(s["past"], x["first"]))).alias("n"),
            F.greatest(s["past"], x["past"]).alias("past"),
        ),
    )["n"]
    out = rows.filter("key is null").select("row", "doc", "n_words").join(spans, "row", "left").join(found, "row", "left")
    return out.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.coalesce(covered, F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<first:long,past:long>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
