"""Hard-negative mining: threshold joins over an inverted index with suffix-norm bounds.

Vectors are scaled and floored to integers; a score is their inner product.  For
each anchor the highest-scoring rows of its label are its positives, and for
each positive the highest-scoring rows of other labels within a window below
its score are the hard negatives.

Both searches are threshold joins of the anchors with all rows.  Dimensions are
ordered by their energy over all rows and taken in segments.  A row's index
entries end where the norm of its remaining suffix is too small for any anchor
of the block to reach its threshold by it; a row without entries is never
touched.  An anchor adds up partial scores along the segments and drops a row
as soon as its partial score and the product of the two remaining norms stay
below the anchor's threshold.  What is left is scored exactly.

Thresholds start high and are lowered only for the anchors whose windows are
not full yet: for positives by halves of the anchor's norm times the rows' root
mean square norm, and without a threshold in the end; for negatives down to the
window's lower end.  Rows below a threshold rank behind those found, so full
windows are final.

Rows lie in blocks of about ``ROWS``, anchors in groups of about ``TASK_WORK``
multiplications with a block, both dealt by hash; blocks and groups are shuffled
as plain rows, which Spark can spill, and a Python worker holds one block and one
group at a time.  It returns at most a window's rows for each anchor, window and block.  Nothing but counts, the rows'
squared sum and one number for each dimension reaches the driver.

Edge cases: rows with a null label, a null vector, or any null or non-finite
component take no part; a null id is no anchor's and sorts last among ties;
rows that share an id are rows of their own (an anchor never meets itself, but
meets its twin); missing components of a shorter vector count as 0; an empty
vector scores 0; products beyond 53 bits are computed in whole numbers, and
scores beyond 63 bits are cut to the largest; negative positives have no
window; labels that are no integers are compared by a 64-bit hash; an empty
table, and one without anchors, give an empty result; further columns play no
part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import checkpointed, ship_package

ROWS, ANCHORS, SEGMENT = 16384, 64, 8
#: Thresholds of the positives' rounds, as parts of norm times root mean square norm; then none.
LADDER = (0.5, 0.25, 0.125)
#: First threshold of the negatives, in hundredths of the smallest positive's score; then the window's lower end.
FIRST_NEGATIVES = 95
#: Multiplications of one block with one group, more or less: a block is shuffled once for each group.
TASK_WORK = 1 << 30
#: Blocks times groups for each core, at least, while a group has ``ANCHORS``.
TASKS_PER_CORE = 2
_LEAST, _MOST = 1 - 2**63, 2**63 - 1


def usable(vector: Column) -> Column:
    """No null, NaN or infinite component."""
    infinite = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != infinite))


def _matrix(column: pa.Array, dimensions: np.ndarray) -> np.ndarray:
    """Vectors as rows, in the order of the dimensions, short ones filled up with 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), len(dimensions)), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out[:, dimensions]


def _energy(batches):
    for batch in batches:
        sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        m = _matrix(batch.column(0), np.arange(int(sizes.max(initial=0)))).astype(np.float64)
        total = (m * m).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["dimension", "energy"])


def _suffix_norms(m: np.ndarray) -> np.ndarray:
    """Norm of what each vector has from each segment on; the last column is 0."""
    squares = m.astype(np.float64) ** 2
    parts = [squares[:, s : s + SEGMENT].sum(1) for s in range(0, m.shape[1], SEGMENT)]
    sums = np.zeros((len(m), len(parts) + 1))
    for s in range(len(parts) - 1, -1, -1):
        sums[:, s] = sums[:, s + 1] + parts[s]
    return np.sqrt(sums)


class Index:
    """Inverted index of one block of rows for thresholds of at least ``part`` times an anchor's norm.

    Rows are sorted by how many segments they have entries in, so that the
    entries of a segment are those of the first ``size[segment]`` rows.
    """

    def __init__(self, vectors: np.ndarray, part: float):
        norms = _suffix_norms(vectors)
        entries = (norms[:, :-1] * (1 + 1e-9) + 1e-6 >= part).sum(1)
        self.order = np.argsort(-entries, kind="stable")
        self.vectors, self.norms = vectors[self.order], norms[self.order]
        self.entries = entries[self.order]
        self.size = [int(np.searchsorted(-self.entries, -s, side="left")) for s in range(norms.shape[1] - 1)]

    def search(self, anchor: np.ndarray, threshold: float, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Wanted rows (places in the sorted block) that score at least the threshold, and their scores."""
        norms = _suffix_norms(anchor[None])[0]
        live = np.flatnonzero(wanted)
        if threshold > 0:
            live = live[: np.searchsorted(live, self.size[0] if self.size else 0)]
        partial = np.zeros(len(live), self.vectors.dtype)
        done = np.zeros(0, live.dtype)
        for s in range(len(self.size)):
            if threshold > 0:  # rows whose entries end here keep their bound until they are verified
                n = int(np.searchsorted(live, self.size[s]))
                done, live, partial = np.concatenate([done, live[n:]]), live[:n], partial[:n]
            at = slice(s * SEGMENT, (s + 1) * SEGMENT)
            partial = partial + self.vectors[live, at] @ anchor[at]
            if threshold > -math.inf:
                rest = self.norms[live, s + 1] * norms[s + 1]
                keep = partial + rest * (1 + 1e-9) + 1e-6 >= threshold
                live, partial = live[keep], partial[keep]
        found = np.concatenate([live, done])
        scores = np.concatenate([partial, self.vectors[done] @ anchor])  # the omitted dimensions are added here
        keep = scores >= threshold
        return found[keep], scores[keep]


def _clip(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(s), _LEAST), _MOST) for s in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)


def _join(dimensions: np.ndarray, top: int, positives: bool, size: int):
    """Meets the anchors and rows of one task, ``size`` anchors of like thresholds at a time; the best ``top`` rows of each anchor and window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, r = ({name: t[name].combine_chunks() for name in t.column_names} for t in (left, right))
        out = [(np.zeros(0, np.int64),) * 4]
        if left.num_rows and right.num_rows:
            anchors, vectors = _matrix(a["q"], dimensions), _matrix(r["q"], dimensions)
            width = max(1, len(dimensions)) * float(np.abs(anchors.astype(np.float64)).max(initial=0)) * float(np.abs(vectors.astype(np.float64)).max(initial=0))
            kind = np.float64 if width < 2**53 else object
            norms = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
            anchors, vectors = anchors.astype(kind), vectors.astype(kind)
            limits = a["threshold"].to_numpy(zero_copy_only=False).astype(np.float64)  # NaN stands for none
            limits = np.where(np.isnan(limits), -math.inf, limits)
            parts = np.where(limits > 0, limits / np.maximum(norms, 1e-300), -math.inf)
            by_part = np.argsort(parts, kind="stable")
        for start in range(0, left.num_rows if right.num_rows else 0, size):
            mine = by_part[start : start + size]
            index = Index(vectors, float(parts[mine[0]]))
            row, label = (r[name].to_numpy()[index.order] for name in ("row", "label"))
            ids = r["id"].fill_null(_MOST).to_numpy()[index.order]
            for j in mine:
                same = label == a["label"][j].as_py()
                me = a["row"][j].as_py()
                found, scores = index.search(anchors[j], limits[j], (same & (row != me)) if positives else ~same)
                scores = _clip(scores)
                order = np.lexsort((row[found], ids[found], -scores))
                found, scores = found[order], scores[order]
                for w, upper, lower in [(0, _MOST, _LEAST)] if positives else [(w["rank"], w["upper"], w["lower"]) for w in a["windows"][j].as_py()]:
                    keep = np.flatnonzero((scores <= upper) & (scores >= lower))[:top]
                    out.append((np.full(len(keep), me), np.full(len(keep), w), scores[keep], index.order[found[keep]]))
        me, w, scores, place = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
        place = pa.array(place)
        return pa.table({"anchor": me, "window": pa.array(w.astype(np.int32)), "score": scores, "id": r["id"].take(place), "hit": r["row"].take(place)})

    return run


def _meet(anchors: DataFrame, rows: DataFrame, n_rows: int, n_blocks: int, dimensions: np.ndarray, top: int, positives: bool) -> DataFrame:
    """Best rows of each anchor (``row``, ``label``, ``q``, ``threshold``, ``windows``) and window, numbered by ``place``."""
    n_anchors = anchors.count()
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-n_anchors * n_rows * max(1, len(dimensions)) // (TASK_WORK * n_blocks)), -(-TASKS_PER_CORE * cores // n_blocks))
    groups = max(1, min(-(-n_anchors // ANCHORS), groups))
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group")
    left = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), group, "row", "label", "q", "threshold", "windows")
    right = rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "row", "id", "label", "q")
    met = left.groupBy("block", "group").cogroup(right.groupBy("block", "group"))
    hits = met.applyInArrow(_join(dimensions, top, positives, ANCHORS), "anchor long, window int, score long, id long, hit long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "hit")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    A negative of a positive with score p scores between ``window`` hundredths of p.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    label, vector = F.col(f"`{label_col}`"), F.col(f"`{vector_col}`")
    integral = isinstance(vectors.select(label).schema[0].dataType, T.IntegralType)
    rows = vectors.filter(label.isNotNull() & usable(vector)).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        (label.cast("long") if integral else F.xxhash64(label)).alias("label"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("q"),
        F.coalesce(is_anchor & F.col(f"`{id_col}`").isNotNull(), F.lit(False)).alias("is_anchor"),
    )
    rows = checkpointed(rows)  # the row numbers are fixed from here on
    energy = rows.select("q").mapInArrow(_energy, "dimension int, energy double").groupBy("dimension").agg(F.sum("energy").alias("energy")).collect()
    dimensions = np.array([r.dimension for r in sorted(energy, key=lambda r: (-r.energy, r.dimension))], np.int64)
    n_rows = rows.count()
    n_blocks = max(1, -(-n_rows // ROWS))
    mean = math.sqrt(sum(r.energy for r in energy) / max(1, n_rows))
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")
    blocks = rows.withColumn("block", block)
    anchors = checkpointed(rows.filter("is_anchor").select(F.col("row"), F.col("id").alias("anchor_id"), "label", "q"))

    none = F.lit(None).cast("array<struct<rank:int,upper:long,lower:long>>")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    open_, parts = anchors, []
    for part in (*LADDER, None):
        limit = F.lit(None).cast("double") if part is None else F.least(norm * (part * mean), F.lit(9e18))  # scores are cut beyond
        asked = open_.select("row", "label", "q", limit.alias("threshold"), none.alias("windows"))
        hits = checkpointed(_meet(asked, blocks, n_rows, n_blocks, dimensions, positives, True))
        full = hits.filter(F.col("place") == positives).select(F.col("anchor").alias("row"))
        parts.append(hits if part is None else hits.join(full.withColumnRenamed("row", "anchor"), "anchor", "left_semi"))
        open_ = checkpointed(open_.join(full, "row", "left_anti"))
        if open_.isEmpty():
            break
    chosen = parts[0]
    for more in parts[1:]:
        chosen = chosen.union(more)
    low, high = window
    edge = F.ceil(F.col("score").cast("decimal(20,0)") * low / 100).cast("long")
    top_edge = F.floor(F.col("score").cast("decimal(20,0)") * high / 100).cast("long")
    chosen = chosen.select("anchor", F.col("place").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), edge.alias("lower"), top_edge.alias("upper"))
    chosen = checkpointed(chosen.filter("lower <= upper"))

    parts, unfilled = [], chosen
    for last in (False, True):
        asked = unfilled.groupBy("anchor").agg(
            F.min(F.col("lower") if last else F.greatest("lower", F.ceil(F.col("upper").cast("decimal(20,0)") * FIRST_NEGATIVES / 100).cast("long"))).cast("double").alias("threshold"),
            F.collect_list(F.struct(F.col("window").alias("rank"), "upper", "lower")).alias("windows"),
        )
        asked = anchors.join(asked, F.col("row") == F.col("anchor")).select("row", "label", "q", "threshold", "windows")
        hits = checkpointed(_meet(checkpointed(asked), blocks, n_rows, n_blocks, dimensions, negatives, False))
        full = hits.filter(F.col("place") == negatives).select("anchor", "window")
        parts.append(hits if last else hits.join(full, ["anchor", "window"], "left_semi"))
        unfilled = checkpointed(unfilled.join(full, ["anchor", "window"], "left_anti"))
        if unfilled.isEmpty():
            break
    mined = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    mined = mined.select("anchor", "window", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = mined.join(chosen, ["anchor", "window"]).join(anchors.select(F.col("row").alias("anchor"), "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
