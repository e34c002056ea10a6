"""Substring dedup over sliding sentence spans.

A text is cut into sentences: at line breaks and at words that end in ``.``,
``!``, ``?`` or such a mark of another script, also with closing quotes or
brackets behind it.  Each ideograph, kana, Thai or Lao letter is a word.
Sentences of over ``CUT_ABOVE`` words are cut by content: before a word whose
hash with the word before it is the least among ``REACH`` places on both sides, so that a
passage gets the same cuts behind any words.  What is still over
``SENTENCE_WORDS`` long (periodic text, few minima) is cut at the least hash
within that many words, from its own start on.  Every run of at least
``MIN_SENTENCES`` consecutive sentences with at least ``MIN_WORDS`` words that
is the shortest from its first or to its last sentence is hashed (words after
lower-casing A-Z, white space ignored).  The shortest runs from and to every
sentence cover each sentence of a longer repeated passage.

The hashes are joined globally.  The first place of a run stays: the document
with the smallest id, and in it the earliest place.  At all other places the
run's sentences are removed.

Three scans of the texts: the first shuffles (hash, id) alone, and groups them
with map-side partial minima and counts; runs found in several documents are
marked in a bitmap of fixed size (8 MB) by which the second scan emits only
candidates, which an equi-join with the repeated hashes confirms; the third
removes sentences.  Repeats within one document need no shuffle.

Edge cases: null text is empty and stays null in ``clean_text``; texts with
fewer than MIN_SENTENCES sentences or MIN_WORDS words have no runs; rows with
equal ids count as one document and are each cleaned; rows without an id only
lose repeats within themselves; extra columns pass
through, the result columns replace columns of the same name; an empty table
gives an empty result.  Runs are compared by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import SLOTS, checkpointed, keyed, mix, slot_bitmap, text_bytes, text_steps, with_columns, word_mask, words

MIN_SENTENCES, MIN_WORDS, SENTENCE_WORDS = 2, 20, 25
#: Longer sentences are cut by content, at hashes that are least among so many places on both sides.
CUT_ABOVE, REACH = 12, 3
_WORD = word_mask(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
_END = word_mask(lambda b: b in b".!?")
_CLOSING = word_mask(lambda b: b in b"\"')]}")


def _marks(characters: str) -> dict[int, np.ndarray]:
    """UTF-8 of the characters as numbers, by length."""
    coded = [c.encode() for c in characters]
    return {n: np.array([int.from_bytes(c) for c in coded if len(c) == n]) for n in (2, 3)}


_END_MARKS, _CLOSING_MARKS = _marks("؟۔…।॥。！？．｡"), _marks("»”’›」』）】》〉〕｣")
_ODD = 0xD1342543DE82EF95
_UP: np.ndarray = np.zeros(0, np.uint64)
_DOWN: np.ndarray = np.zeros(0, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, 1 << 16)
        tables = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _UP, _DOWN = tables
    return _UP, _DOWN


def script_words(data: np.ndarray) -> np.ndarray | None:
    """Marks the bytes where a character of a script without spaces begins: ideographs, kana, Thai and Lao letters."""
    if not len(data) or data.max() < 0xE0:
        return None
    b1, b2 = np.append(data[1:], [0]), np.append(data[2:], [0, 0])[: len(data)]
    out = (data >= 0xE3) & (data <= 0xE9)
    # the space, commas, ends and closing brackets stay with the word before them
    out &= ~((data == 0xE3) & (b1 == 0x80) & np.isin(b2, [0x80, 0x81, 0x82, 0x83, 0x89, 0x8B, 0x8D, 0x8F, 0x91, 0x95]))
    out |= (data == 0xEF) & (b1 == 0xBC) & (b2 == 0x88)
    out |= (data == 0xF0) & (b1 >= 0xA0)
    # vowel and tone marks stay with their letter
    thai = ((b1 == 0xB8) & (b2 != 0xB1) & ((b2 < 0xB4) | (b2 > 0xBA))) | ((b1 == 0xB9) & (b2 < 0x87))
    lao = ((b1 == 0xBA) & (b2 != 0xB1) & ((b2 < 0xB4) | (b2 > 0xBC))) | ((b1 == 0xBB) & (b2 < 0x88))
    return out | ((data == 0xE0) & (thai | lao))


def closing_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word ends in an end mark, with closing quotes and brackets behind it or none."""
    out = _END[data[ends - 1]]
    left = np.flatnonzero(_CLOSING[data[ends - 1]] | (data[ends - 1] >= 128))
    at = ends[left] - 1
    while len(left):
        b = data[at].astype(np.int64)
        two = (data[np.maximum(at - 1, 0)].astype(np.int64) << 8) | b
        three = (data[np.maximum(at - 2, 0)].astype(np.int64) << 16) | two
        done = _END[b] | np.isin(two, _END_MARKS[2]) | np.isin(three, _END_MARKS[3])
        out[left[done]] = True
        width = np.where(_CLOSING[b], 1, np.where(np.isin(two, _CLOSING_MARKS[2]), 2, np.where(np.isin(three, _CLOSING_MARKS[3]), 3, 0)))
        on = ~done & (width > 0) & (at - width >= starts[left])
        left, at = left[on], at[on] - width[on]
    return out


def content_starts(h: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin a sentence, with the word count at the end; long sentences are cut by content."""
    n = len(h)
    if not n:
        return np.zeros(1, np.int64)
    begins = np.zeros(n, bool)
    begins[0] = True
    begins[1:] = closes[:-1]
    first = np.flatnonzero(begins)
    sizes = np.diff(np.append(first, n))
    if sizes.max() <= CUT_ABOVE:
        return np.append(first, n)
    value = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    value[1:] = mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])
    least = np.repeat(sizes > CUT_ABOVE, sizes)
    for k in range(1, min(REACH, n - 1) + 1):
        least[k:] &= value[k:] < value[:-k]
        least[:-k] &= value[:-k] <= value[k:]
    first = np.flatnonzero(begins | least)
    sizes = np.diff(np.append(first, n))
    more = []
    for i in np.flatnonzero(sizes > SENTENCE_WORDS):
        a, b = int(first[i]), int(first[i] + sizes[i])
        while b - a > SENTENCE_WORDS:
            part = value[a + REACH : a + SENTENCE_WORDS + 1]
            a += REACH + int(np.argmin(part))
            more.append(a)
    return np.append(np.sort(np.append(first, np.array(more, np.int64))), n)


def runs(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and end sentence (exclusive) of the text's shortest runs, in order."""
    n = len(bounds) - 1
    i = np.arange(n + 1)
    end = np.maximum(np.searchsorted(bounds, bounds + MIN_WORDS), i + MIN_SENTENCES)
    begin = np.minimum(np.searchsorted(bounds, bounds - MIN_WORDS, side="right") - 1, i - MIN_SENTENCES)
    pairs = np.concatenate([(i * (n + 2) + end)[end <= n], (begin * (n + 2) + i)[begin >= 0]])
    first, past = np.divmod(np.unique(pairs), n + 2)
    up, down = _tables(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    a, b = bounds[first], bounds[past]
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)), first, past


def _sentences(texts: pa.Array):
    """Per text its word hashes, byte starts of the words, and sentence bounds."""
    data, offsets = text_bytes(texts)
    h, starts, ends, at = words(data, offsets, _WORD, script_words(data))
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    closes = closing_words(data, starts, ends)
    closes[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    for i in range(len(texts)):
        part = slice(at[i], at[i + 1])
        yield h[part], starts[part] - offsets[i], content_starts(h[part], closes[part])


def _first_places(h: np.ndarray) -> np.ndarray:
    return np.sort(np.unique(h, return_index=True)[1])


def _hashes(batches):
    for batch in text_steps(batches):
        docs, found = [], []
        for i, (h, _, bounds) in enumerate(_sentences(batch.column(1))):
            own = np.unique(runs(h, bounds)[0])
            docs.append(np.full(len(own), i))
            found.append(own)
        take = pa.array(np.concatenate(docs), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate(found).view(np.int64))], names=["doc", "h"])


def _candidates(bitmap):
    """The runs whose hash is marked: each one's first place in its document."""

    def run(batches):
        bits = bitmap.value
        for batch in text_steps(batches):
            docs, found, first, past = [], [], [], []
            for i, (h, _, bounds) in enumerate(_sentences(batch.column(1))):
                own, a, b = runs(h, bounds)
                slot = (own & np.uint64(SLOTS - 1)).astype(np.int64)
                at = np.flatnonzero((bits[slot >> 3] >> (slot & 7)) & 1)
                at = at[_first_places(own[at])]
                docs.append(np.full(len(at), i))
                found.append(own[at])
                first.append(a[at])
                past.append(b[at])
            take = pa.array(np.concatenate(docs), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    pa.array(np.concatenate(found).view(np.int64)),
                    pa.array(np.concatenate(first), pa.int32()),
                    pa.array(np.concatenate(past), pa.int32()),
                ],
                names=["doc", "h", "first", "past"],
            )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_sentences``, ``n_removed``, ``removed`` (sentence numbers) and ``clean_text``."""
    spark = docs.sparkSession
    texts = keyed(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    hashes = texts.mapInArrow(_hashes, f"doc {kind}, h long")
    # the same id again is the same document, so a run is repeated if its smallest and largest id differ
    repeated = hashes.groupBy("h").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last")).filter("keeper <> last").select("h", "keeper")
    repeated = checkpointed(repeated)
    bitmap = spark.sparkContext.broadcast(slot_bitmap(repeated, "h"))
    places = texts.mapInArrow(_candidates(bitmap), f"doc {kind}, h long, first int, past int")
    extra = places.join(repeated, "h").filter("doc <> keeper").groupBy("doc").agg(F.collect_set(F.struct("first", "past")).alias("_spans"))

    new = T.StructType().add("n_sentences", "long").add("n_removed", "long").add("removed", T.ArrayType(T.IntegerType())).add("clean_text", "string")

    def clean(texts: pa.Array, spans: pa.Array) -> list[pa.Array]:
        counts, removed, cleaned, spans = [], [], [], spans.to_pylist()
        for i, (h, starts, bounds) in enumerate(_sentences(texts)):
            n = len(bounds) - 1
            own, first, past = runs(h, bounds)
            gone = np.zeros(n + 1, np.int64)
            again = np.ones(len(own), bool)
            again[_first_places(own)] = False
            pairs = [*zip(first[again], past[again], strict=True), *((s["first"], s["past"]) for s in spans[i] or ())]
            if pairs:
                a, b = np.array(pairs).T
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
            gone = np.flatnonzero(np.cumsum(gone)[:n] > 0)
            text = texts[i].as_py()
            if len(gone):
                raw = text.encode()
                edges = np.append(starts[bounds[:-1]], len(raw))
                edges[0] = 0
                text = b"".join(raw[edges[j] : edges[j + 1]] for j in np.setdiff1d(np.arange(n), gone)).decode()
            counts.append(n)
            removed.append(gone.tolist())
            cleaned.append(text)
        sizes = [len(x) for x in removed]
        return [pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(cleaned, pa.string())]

    joined = docs.alias("d").join(extra.alias("e"), F.col(f"d.`{id_col}`") == F.col("e.doc"), "left")
    names = [f"c{i}" for i in range(len(docs.columns))]
    packed = joined.select(*(F.col(f"d.`{c}`").alias(x) for c, x in zip(docs.columns, names, strict=True)), "e._spans")
    out = with_columns(packed, names[docs.columns.index(text_col)], new, clean, names, F.col("_spans"))
    kept = [(x, c) for x, c in zip(names, docs.columns, strict=True) if c not in new.names]
    return out.select(*(F.col(x).alias(c) for x, c in kept), *new.names)
