"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import scratch_path

#: Text bytes that one numpy step handles (one longer text is a step alone), and of an Arrow batch that Spark sends a worker.
STEP_BYTES, BATCH_BYTES = 1 << 18, 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there; lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Slots of ``without_ids``: 2 MB broadcast at most.
ID_SLOTS = 1 << 17


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column of ``ids``.

    The slots of the ids (hash modulo ID_SLOTS) are broadcast; rows in free slots
    stay where they are, and only the others are shuffled for the exact anti-join.
    """
    ids = checkpointed(ids.toDF("_gone").distinct())

    def slot(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(ID_SLOTS))

    own = F.col(f"d.`{id_col}`")
    taken = F.broadcast(ids.select(slot(F.col("_gone")).alias("_slot")).distinct())
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    free = docs.alias("d").join(taken, slot(own) == F.col("_slot"), "left_anti").select(*columns)
    rest = docs.alias("d").join(taken, slot(own) == F.col("_slot"), "left_semi").join(ids, own == F.col("_gone"), "left_anti")
    return free.union(rest.select(*columns))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers (Spark's own file distribution), once per application.

    Arrow batches are held to BATCH_BYTES unless the session asks for less: texts
    differ in length by orders of magnitude, so a row count does not bound them.
    """
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(context, "_cohortlens_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="cohortlens-package-")  # the driver serves it to the executors until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "cohortlens.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(archive)
    context._cohortlens_shipped = True


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that most operators read, under private names."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))


def text_steps(batches, texts=lambda batch: batch.column("_text")) -> Iterator[pa.RecordBatch]:
    """Slices of the Arrow batches with at most STEP_BYTES of text (or one row)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(texts(batch)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + STEP_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def with_columns(docs: DataFrame, text_col: str, new: T.StructType, make, kept: list[str] | None = None, extra: Column | None = None) -> DataFrame:
    """The kept columns (all by default, under any names) with new ones computed in Arrow batches.

    ``make(texts, extra)`` gets the step's texts and extra column and returns the
    new columns' arrays.  New columns replace kept ones of the same name.
    """
    ship_package(docs.sparkSession)
    kept = [c for c in (docs.columns if kept is None else kept) if c not in new.names]
    row = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    inside = kept.index(text_col) if text_col in kept else None
    text = F.lit(None).cast("string") if inside is not None else F.col(f"`{text_col}`")
    extra = F.lit(None).cast("int") if extra is None else extra
    packed = docs.select(F.struct(*row).alias("row"), text.alias("_text"), extra.alias("extra"))

    def texts(batch):
        return batch.column("_text") if inside is None else batch.column("row").field(inside)

    def run(batches):
        for batch in text_steps(batches, texts):
            arrays = make(texts(batch), batch.column("extra"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=["row", *(f"n{i}" for i in range(len(arrays)))])

    schema = T.StructType([packed.schema["row"], *(T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new))])
    out = packed.mapInArrow(run, schema)
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)), *(F.col(f"n{i}").alias(f.name) for i, f in enumerate(new)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes one after the other, and n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# ---------------------------------------------------------------- word hashes

_WORD_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_WORD_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 4096)
        table_ = np.full(size, base, np.uint64)
        table_[0] = 1
        _powers[name] = have = np.multiply.accumulate(table_)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


#: Bits of the bitmaps that carry a set of slots to the tasks: 8 MB each, however many members the set has.
SLOTS = 1 << 26


def slot_bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """Bytes of a bitmap in which bit ``value mod SLOTS`` of every value of the column is set."""
    slot = F.pmod(F.col(column), F.lit(SLOTS)) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bits = np.zeros((SLOTS // 32768, 4096), np.uint8)
    for part in parts.toLocalIterator():
        bits[part.bucket - 1] = np.frombuffer(part.bits, np.uint8)
    return bits.reshape(-1)


def word_mask(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], bool)


def words(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray, splits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts after lower-casing A-Z: hashes, byte starts, byte ends, and n + 1 word offsets.

    A word also ends before each byte marked in ``splits``.
    """
    n = len(data)
    inside = mask[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    if splits is not None:
        border[:n] |= splits
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    last = inside
    last = last.copy()
    last[:-1] &= ~inside[1:] | border[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[_FOLD[data]] * _power_table("up", _WORD_BASE, n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power_table("down", _INVERSE, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k consecutive word hashes; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[j : len(h) - k + 1 + j])
    return out


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
