"""Spelling variant grouping: near words by blocked Gram matrices of letter counts.

Two words are near if one inserted, deleted or replaced code point turns one
into the other.  Each word is a vector of letter counts; products of such
blocks (numpy) give the squared distances of all their words, which is 1 for a
near pair of adjacent lengths and 0 or 2 for one of equal length.  Pairs at most
two apart are verified on the letters themselves.

Blocks are cells: the letters are dealt into ``k`` groups, and a cell holds the
words with the same number of letters of each group (so of one length).  A near
word lies in the same cell, in a cell one letter up in one group, or one up in
one group and one down in another; only these blocks are multiplied, and every
pair of words meets in one of them.  ``k`` grows until a word's cell
holds ``CELL_WORDS`` words on average, so the work per word does not grow
with the vocabulary; a cell over ``BLOCK_WORDS`` words or ``BLOCK_BYTES`` is
cut into several blocks by a hash, all pairs of which meet.

A word's form is its near word of largest count (ties: smallest in code-point
order) if that is at least ``ratio`` times its own; its root is the end of the
chain of forms, found by pointer doubling.

Edge cases: null and empty texts have no words; rows that repeat a document
count again; a null word or count takes no part, and counts of one word are
added up; a word of any length is a block of its own at worst; over ``SLOTS``
letters, rare ones share a count (more pairs are then verified, none is lost); an
empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import checkpointed, ship_package

CELL_WORDS, BLOCK_WORDS, BLOCK_BYTES = 512, 1024, 1 << 20
FIRST_GROUPS, MOST_GROUPS, SLOTS = 3, 16, 128
#: Word pairs that one task compares, more or less.
TASK_PAIRS = 1 << 27
#: A longer text is cut behind the run of letters that this many characters end in.
PIECE_CHARS = 1_000_000


def letter_runs(text: Column, letters: str, least: int) -> Column:
    """Maximal runs of ``letters`` (a character class) of at least ``least`` code points, as an array; for ``explode``d ``pieces``."""
    return F.regexp_extract_all(text, F.lit(f"[{letters}]{{{least},}}"), F.lit(0))


def pieces(text: Column, letters: str) -> Column:
    """The text in an array of pieces; no run of letters is cut."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE_CHARS}}}[{letters}]*+"), F.lit(0))
    return F.when(F.length(text) > PIECE_CHARS, cut).otherwise(F.array(text))


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words one after the other, and their lengths."""
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4"), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _letter_counts(batches):
    for batch in batches:
        codes, n = np.unique(_codes(batch.column(0))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(n.astype(np.int64))], names=["code", "n"])


def _cells(vocabulary: DataFrame, slot_of, k: int) -> DataFrame:
    """The vocabulary with each word's letters per group; letters are dealt to the groups to and fro by frequency."""

    def run(batches):
        slots = slot_of.value
        at = np.arange(SLOTS) % (2 * k)
        group = np.where(at < k, at, 2 * k - 1 - at)
        for batch in batches:
            codes, sizes = _codes(batch.column("word"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            counts = np.bincount(row * k + group[slots[codes]], minlength=len(sizes) * k).astype(np.int32)
            cell = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * k), pa.array(counts))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), cell], names=["word", "n", "cell"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, cell array<int>")


def _steps(k: int) -> Column:
    """What to add to a cell to reach the cells of its near words: nothing, one up, or one up and an earlier one down."""
    steps = [[0] * k]
    for i in range(k):
        steps.append([int(g == i) for g in range(k)])
        steps += [[int(g == i) - int(g == j) for g in range(k)] for j in range(i)]
    return F.array(*(F.array(*map(F.lit, s)) for s in steps))


def near_pairs(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of two blocks: ``x`` and ``y`` hold code points (one word a row), ``xs`` and ``ys`` the letters' slots.

    The words of ``y`` are as long as those of ``x`` or one longer.
    """
    real = np.float32 if y.shape[1] <= 4096 else np.float64  # sums of squares stay exact

    def counts(s: np.ndarray) -> np.ndarray:
        flat = np.arange(len(s))[:, None] * SLOTS + s
        return np.bincount(flat.ravel(), minlength=len(s) * SLOTS).reshape(len(s), SLOTS).astype(real)

    cx, cy = counts(xs), counts(ys)
    distance = cx @ cy.T
    distance *= -2
    distance += (cx * cx).sum(1)[:, None]
    distance += (cy * cy).sum(1)
    at = np.flatnonzero(distance.ravel() <= 2)
    a, b = at // len(y), at % len(y)
    found = []
    step = max(1, (1 << 20) // max(1, y.shape[1]))
    for s in range(0, len(a), step):
        p, q = x[a[s : s + step]], y[b[s : s + step]]
        if x.shape[1] == y.shape[1]:
            found.append((p != q).sum(1) == 1)
        else:
            head = np.logical_and.accumulate(p == q[:, :-1], axis=1).sum(1)
            tail = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(1)
            found.append(head + tail >= x.shape[1])
    keep = np.concatenate(found) if found else np.zeros(0, bool)
    return a[keep], b[keep]


def _best(own: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (own, other): the distinct own ones, how many others each has, and its other of largest n (first in order on ties)."""
    order = np.lexsort((other, -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    return own[first], np.diff(np.append(first, len(own))), other[first]


def _compare(slot_of):
    """Per pair of blocks, each word with its near words' number and the most frequent one."""

    def block(words, ns, slots, i):
        own = words[i].values
        codes, sizes = _codes(own)
        codes = codes.reshape(len(sizes), int(sizes[0]))
        return own, ns[i].values.to_numpy(zero_copy_only=False), codes, slots[codes]

    def run(batches):
        slots = slot_of.value
        for batch in batches:
            columns = [batch.column(j) for j in range(5)]
            out = []
            for i in range(batch.num_rows):
                xw, xn, x, xs = block(columns[0], columns[1], slots, i)
                yw, yn, y, ys = block(columns[2], columns[3], slots, i)
                a, b = near_pairs(x, y, xs, ys)
                if columns[4][i].as_py():  # a block with itself: each pair once
                    a, b = a[a < b], b[a < b]
                for own, other, ow, tw, tn in ((a, b, xw, yw, yn), (b, a, yw, xw, xn)):
                    word, n, top = _best(own, other, tn)
                    if len(word):
                        out.append((ow.take(pa.array(word)), pa.array(n.astype(np.int64)), pa.array(tn[top]), tw.take(pa.array(top))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in zip(*out, strict=True)], names=["word", "n_near", "top_n", "top"])

    return run


def spelling_variants(counts: DataFrame, ratio: int = 10, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of the counts."""
    spark = counts.sparkSession
    ship_package(spark)
    vocabulary = counts.select(F.col(f"`{word_col}`").alias("word"), F.col(f"`{n_col}`").cast("long").alias("n"))
    vocabulary = vocabulary.filter("word <> '' AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = checkpointed(vocabulary)
    letters = vocabulary.select("word").mapInArrow(_letter_counts, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    ranked = [r.code for r in letters.orderBy(F.desc("n"), "code").collect()]  # at most the code points there are
    lookup = np.zeros(max(ranked, default=0) + 1, np.int16)
    lookup[ranked] = np.arange(len(ranked)) % SLOTS
    slot_of = spark.sparkContext.broadcast(lookup)

    k = FIRST_GROUPS
    while True:
        placed = _cells(vocabulary, slot_of, k)
        size = F.aggregate("cell", F.lit(0).cast("long"), lambda a, b: a + b)
        cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("length", size)
        cells = checkpointed(cells)
        total = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("square")).first()
        if k == MOST_GROUPS or (total.square or 0) <= CELL_WORDS * (total.n or 0):
            break
        k += 1
    blocks_of = F.ceil(F.greatest(F.col("n") / BLOCK_WORDS, F.col("n") * F.col("length") * 4 / BLOCK_BYTES)).cast("int")
    cells = checkpointed(cells.select("cell", F.greatest(blocks_of, F.lit(1)).alias("blocks")))

    block = F.pmod(F.xxhash64("word"), F.col("blocks").cast("long")).cast("int").alias("block")
    member = F.sort_array(F.collect_list(F.struct("word", "n")))
    blocks = placed.join(cells, "cell").select("cell", block, "word", "n").groupBy("cell", "block").agg(member.alias("m"))
    blocks = checkpointed(blocks.select("cell", "block", F.col("m.word").alias("words"), F.col("m.n").alias("ns")))

    steps = cells.select(F.col("cell").alias("x"), F.col("blocks").alias("bx"), F.posexplode(_steps(k)).alias("at", "step"))
    steps = steps.withColumn("y", F.zip_with("x", "step", lambda a, b: a + b)).filter("array_min(y) >= 0")
    pairs = steps.join(cells.toDF("y", "by"), "y").select(
        "x", "y", "at", F.explode(F.sequence(F.lit(0), F.col("bx") - 1)).alias("i"), "by"
    )
    pairs = pairs.select("x", "y", "at", "i", F.explode(F.sequence(F.when(F.col("at") == 0, F.col("i")).otherwise(0), F.col("by") - 1)).alias("j"))
    compared = (total.square or 0) * (1 + k + k * (k - 1) / 2)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(compared / TASK_PAIRS))
    left = pairs.join(blocks.toDF("x", "i", "xw", "xn"), ["x", "i"]).select("y", "j", "xw", "xn", ((F.col("at") == 0) & (F.col("i") == F.col("j"))).alias("same"))
    both = left.repartition(tasks, "y", "j").join(blocks.toDF("y", "j", "yw", "yn").hint("shuffle_merge"), ["y", "j"])
    near = both.select("xw", "xn", "yw", "yn", "same").mapInArrow(_compare(slot_of), "word string, n_near long, top_n long, top string")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("top_n")).alias("less"), "top")).alias("best"))
    known = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.top").alias("top"), (-F.col("best.less")).alias("top_n"))
    formed = F.col("top_n") >= ratio * F.col("n")
    known = checkpointed(known.select("word", "n", "n_near", F.when(formed, F.col("top")).alias("form"), F.when(formed, F.col("top_n")).alias("form_n")))

    up = checkpointed(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = up.alias("a").join(up.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        further = checkpointed(further.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")))
        moved, up = not further.filter("moved").isEmpty(), further.select("word", "root")
        if not moved:
            break
    return known.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
