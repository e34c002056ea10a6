"""Exact dedup by progressive refinement (DataFrame functions only).

Groups by byte length, then by a hash of the first bytes, then by the hash of
the whole text.  After each of the first two levels only documents whose group
has at least two members go on; the whole text is normalised and hashed for
those alone.  Documents that the second level excludes stay where they are: they
are neither hashed nor shuffled.

Which groups survive a level reaches the scan as a bitmap of ``SLOTS`` slots
(group hash modulo ``SLOTS``) in buckets of 4 KB, so the broadcast has the same
bound at every input size.  A slot shared by chance only lets a document through
to the next level; the last level compares whole-text hashes, so the result is
exact.

Groups of more rows than half a task's share (fewer than twice the tasks) are
broadcast, and their rows are dealt out evenly; the others meet their rows by
shuffle.

Edge cases: null text counts as empty; all empty texts are one group; rows that
share text and the group's largest id are all kept; a null id stays only where
its group has no other; extra columns pass through unchanged, and the three
result columns replace columns of the same name; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import SLOTS, ascii_lower, checkpointed

PREFIX_CHARS = 64
#: Slots of one bucket of Spark's bitmap functions.
BUCKET_SLOTS = 8 * 4096


def _slot(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(SLOTS))


def _crowded(rows: DataFrame, *keys: str) -> DataFrame:
    """Bitmap, a row for each bucket, of the slots of the key groups with two rows or more (8 MB at most)."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    slot = _slot(*(F.col(k) for k in keys)) + 1
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits")
    return checkpointed(groups.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(bits))


def _marked(rows: DataFrame, crowd: DataFrame, *parts: Column) -> tuple[DataFrame, Column]:
    """``rows`` beside the buckets of their slots, and whether the slot is set there."""
    slot = _slot(*parts)
    position = F.pmod(slot, F.lit(BUCKET_SLOTS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("crowd._bits"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(crowd).alias("crowd"), F.floor(slot / BUCKET_SLOTS) + 1 == F.col("crowd._bucket"), "left")
    return joined, F.coalesce(F.getbit(byte, F.pmod(position, F.lit(8))), F.lit(0)) == 1


def _head(text: Column) -> Column:
    return F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``_sha``, ``_keep`` (largest id) and ``_size`` of every group of two or more equal texts; the bitmap of the second level."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), F.octet_length(text).alias("_len"))
    by_length, found = _marked(rows, _crowded(rows, "_len"), F.col("_len"))
    begun = by_length.filter(found).select("_id", "_text", "_len", _head(F.col("_text")).alias("_head"))
    crowd = _crowded(begun, "_len", "_head")
    by_head, found = _marked(begun, crowd, F.col("_len"), F.col("_head"))
    whole = by_head.filter(found).select("_id", F.sha2(ascii_lower(F.col("_text")), 256).alias("_sha"))
    groups = whole.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    return checkpointed(groups.filter("_size > 1")), crowd


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sha_col: str | None = None) -> DataFrame:
    """Every row of ``docs`` with ``keep_id`` (the id that stays), ``group_size`` and ``kept``.

    ``sha_col`` names a column that already holds the whole-text hash; else it is
    computed for the rows that the second level lets through.
    """
    groups, crowd = exact_groups(docs, id_col, text_col)
    taken = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept")]
    text = F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))
    sha = F.col(f"d.`{sha_col}`") if sha_col else F.sha2(ascii_lower(text), 256)
    marked, found = _marked(docs.alias("d"), crowd, F.octet_length(text), _head(text))
    own = [F.col(f"d.`{c}`").alias(f"c{i}") for i, c in enumerate(taken)]
    alone = marked.filter(~found).select(*own, F.col(f"d.`{id_col}`").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = (groups.agg(F.sum("_size")).first()[0] or 0) / (2 * tasks)
    heavy, light = groups.filter(F.col("_size") > limit).alias("h"), groups.filter(F.col("_size") <= limit).alias("l")
    rest = marked.filter(found).select(*own, F.col(f"d.`{id_col}`").alias("_id"), sha.alias("_sha")).alias("r")
    rest = rest.join(F.broadcast(heavy), F.col("r._sha") == F.col("h._sha"), "left")
    # rows of heavy groups have their answer; a key of their own deals them out
    key = F.when(F.col("h._sha").isNull(), F.col("r._sha")).otherwise(F.concat(F.lit("#"), F.monotonically_increasing_id()))
    rest = rest.select("r.*", F.col("h._keep").alias("_keep"), F.col("h._size").alias("_size"), key.alias("_key")).alias("r")
    rest = rest.join(light, F.col("r._key") == F.col("l._sha"), "left")
    keep = F.coalesce("r._keep", "l._keep", "r._id")
    rest = rest.select(
        *(f"r.c{i}" for i in range(len(taken))),
        keep.alias("keep_id"),
        F.coalesce("r._size", "l._size", F.lit(1)).alias("group_size"),
        keep.eqNullSafe(F.col("r._id")).alias("kept"),
    )
    return alone.union(rest).toDF(*taken, "keep_id", "group_size", "kept")
