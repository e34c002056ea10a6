"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The rows of the matrix are the distinct n-gram sets (equal sets are one row,
represented by the smallest id of their documents), its columns the n-grams,
ordered from rare to frequent.  Two rows link when their Jaccard similarity is
at least ``num / den``.  The pairs are found and counted in three steps:

* Head block.  A row's first ``n - ceil(n * num / den) + 1`` columns: linked
  rows share one of these, so the join on the column, and on the size band of
  the larger row (``head_keys``), finds every pair with a chance.  At a shared
  column the rows have ``r1`` and ``r2`` columns left; an overlap above
  ``min(r1, r2)`` is impossible, and a link needs an overlap of
  ``num / (num + den) * (n1 + n2)``.  Pairs below that bound are discarded.
* Hashed blocks.  Two rows whose column counts in a block differ in parity
  differ in at least one column there, so the number of such blocks, of
  ``BLOCKS``, bounds what the rows do not share.  Linked rows differ in at most
  ``(den - num) / (num + den) * (n1 + n2)`` columns; pairs beyond are discarded.
* Product.  The columns are cut into ``PRODUCT_BLOCKS`` blocks by their hash.
  Block after block the shared columns of the surviving pairs are counted and
  added to the overlap; what the later blocks can still add is at most the
  smaller row's number of columns there.  Pairs whose overlap cannot reach the
  bound any more are discarded after each block; after the last one nothing is
  left to add, so the bound decides.

Groups of near copies do not produce all their pairs.  In a first product
each row meets only the row of its column with the fewest columns before it
(the one with the least of its own), and the links found are contracted to
components.  The second product takes only pairs whose components still
differ, and tests their parities (folded to half the blocks) inside the join,
so a group that the first product joined costs nothing more and near misses
do not come out as rows.  Pairs that neither product forms are either below the bound or already connected.

Column order: tasks count their n-grams in chunks and report those seen three
times or more in a chunk; the ``HEAVY_ROWS`` most frequent in sum get a level
(the logarithm of the count) and come last, all others are level 0.  The order
only has to be the same everywhere for exact results; the table (2 MB at most)
keeps n-grams that many documents share out of the head block.

Sets are sets of 64-bit n-gram hashes.

Edge cases: null and empty texts, and texts without words, have an empty set
and link with nothing; a text with fewer than ``k`` words has its whole word
sequence as its only n-gram; repeated rows, and different texts under one id,
are documents of their own; rows without an id link like others, and a component
without any id has none; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import SLOTS, checkpointed, grams, mix, ship_package, slot_bitmap, text_bytes, text_steps, word_mask, words
from cohortlens.llm.components import components

#: Words are runs of anything but space and 0x09-0x0D.
WORD = word_mask(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
HEAVY_ROWS = 1 << 17
CHUNK_GRAMS, CHUNK_TIMES = 1 << 21, 3
#: Column blocks of the parity bound: 256 bytes a row.
BLOCKS = 2048
#: Column blocks in which overlaps are accumulated.
PRODUCT_BLOCKS = 4


def gram_sets(texts: pa.Array, k: int):
    """The sorted distinct n-gram hashes of each text."""
    data, offsets = text_bytes(texts)
    h, _, _, at = words(data, offsets, WORD)
    for i in range(len(at) - 1):
        own = h[at[i] : at[i + 1]]
        yield np.unique(grams(own, min(k, len(own)))) if len(own) else own


def _profile(k: int):
    """Per document its set size and a 128-bit hash of the set; per chunk the n-grams that it repeats."""

    names = ["_id", "doc", "n", "s1", "s2", "h", "times"]

    def run(batches):
        chunk, size = [], 0

        def repeated():
            h, times = np.unique(np.concatenate(chunk), return_counts=True)
            often = times >= CHUNK_TIMES
            h, times = h[often].view(np.int64), times[often]
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(h), pa.array(times)], names=names)

        for batch in text_steps(batches):
            rows = []
            for own in gram_sets(batch.column(1), k):
                rows.append((len(own), own.sum(dtype=np.uint64), mix(own ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)))
                chunk.append(own)
                size += len(own)
            n, s1, s2 = (np.array(c, np.uint64).view(np.int64) for c in zip(*rows, strict=True))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.int64()), pa.array(n), pa.array(s1), pa.array(s2), none, none], names=names
            )
            if size >= CHUNK_GRAMS:
                yield repeated()
                chunk, size = [], 0
        if chunk:
            yield repeated()

    return run


def band(n: np.ndarray | int, num: int, den: int) -> np.ndarray:
    """Number of the size band; sizes of linked rows are in the same or in neighbouring bands."""
    return np.floor(np.log(n) / np.log(den / num) + 1e-9).astype(np.int64)


def head_keys(own: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a row's head block, and how many of its columns come before each.

    A key is a column with the size band of the pair's larger row.  A row has
    every head column with its own band, and a column with ``i`` before it also
    with the bands of the larger rows that a link through it allows:
    ``m <= (den * n - (num + den) * i) / num``.
    """
    n = len(own)
    if not n:
        return own.view(np.int64), np.zeros(0, np.int32)
    before = np.arange(n - -(-n * num // den) + 1)
    most = np.maximum((den * n - (num + den) * before) // num, n)
    first = band(n, num, den)
    parts, places = [], []
    for step in range(int(band(most[0], num, den) - first) + 1):
        at = before[band(most, num, den) >= first + step]
        parts.append(mix(own[at] ^ mix(np.full(len(at), int(first) + step + 1, np.uint64))))
        places.append(at)
    return np.concatenate(parts).view(np.int64), np.concatenate(places).astype(np.int32)


def _heads(k: int, num: int, den: int, heavy):
    """Per document its set size, parities, and the keys of its head block, rarest columns first."""

    def run(batches):
        table, levels = heavy.value
        for batch in text_steps(batches):
            keys, places, ns, odd = [], [], [], []
            for own in gram_sets(batch.column(1), k):
                odd.append(parities(own.view(np.int64)))
                ns.append(len(own))
                if len(own) and len(table):
                    at = np.minimum(np.searchsorted(table, own), len(table) - 1)
                    own = own[np.argsort(np.where(table[at] == own, levels[at], 0), kind="stable")]
                key, place = head_keys(own, num, den)
                keys.append(key)
                places.append(place)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(ns, pa.int32()), _lists(odd), _lists(keys), _lists(places)],
                names=["rid", "n", "odd", "key", "before"],
            )

    return run


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def column_blocks(own: np.ndarray) -> list[np.ndarray]:
    """A row's columns in each block of the product."""
    block = own % np.uint64(PRODUCT_BLOCKS)
    return [own[block == b].view(np.int64) for b in range(PRODUCT_BLOCKS)]


def _blocked_sets(k: int, wanted):
    """The sets of the documents whose slot is marked, a list for each block, with the number of columns of the later blocks."""

    def run(batches):
        bits = wanted.value
        for batch in text_steps(batches):
            slot = np.mod(batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(), SLOTS)
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7)) & 1 > 0))
            if not batch.num_rows:
                continue
            rows = [column_blocks(own) for own in gram_sets(batch.column(1), k)]
            sizes = np.array([[len(part) for part in row] for row in rows])
            columns = [batch.column(0).cast(pa.int64()), pa.array(sizes.sum(axis=1))]
            for b in range(PRODUCT_BLOCKS):
                columns += [_lists([row[b] for row in rows]), pa.array(sizes[:, b + 1 :].sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "n", *(f"{c}{b}" for b in range(PRODUCT_BLOCKS) for c in ("grams", "later"))])

    return run


def parities(grams: np.ndarray) -> np.ndarray:
    """One bit for each of BLOCKS column blocks: whether the row has an odd number of columns there."""
    odd = np.bincount(grams & (BLOCKS - 1), minlength=BLOCKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 9, den: int = 10
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``row_key`` and ``keep_key`` of every document row (ids are integers).

    ``component_id`` is the smallest id reachable by links, the document's own
    included (null where none has an id).  ``row_key`` is a hash of id and text, and
    ``keep_key`` that of the component's first row by id.
    """
    spark = docs.sparkSession
    ship_package(spark)
    # rows are known by a hash of id and text: rows without an id, or of different texts under one id, stay apart
    key = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))
    rows = docs.select(key.alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{id_col}`").cast("long").alias("doc"))
    texts = rows.select("_id", "_text")
    profile = checkpointed(rows.mapInArrow(_profile(k), "_id long, doc long, n long, s1 long, s2 long, h long, times long"))
    sizes = profile.filter("n is not null").select("_id", "doc", "n", "s1", "s2")

    often = profile.filter("h is not null").groupBy("h").agg(F.sum("times").alias("times"))
    often = often.orderBy(F.desc("times"), "h").limit(HEAVY_ROWS).toArrow()
    h = often.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    levels = np.log2(np.maximum(1, often.column("times").to_numpy())).astype(np.int8)
    heavy = spark.sparkContext.broadcast((h[order], levels[order]))

    first = F.struct(F.col("doc").isNull().alias("none"), "doc", F.col("_id").alias("key"))
    rows = sizes.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("_id").alias("rid"), F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"))
    rows = checkpointed(rows)
    heads = texts.mapInArrow(_heads(k, num, den, heavy), "rid long, n int, odd array<long>, key array<long>, before array<int>")
    heads = checkpointed(heads.join(rows.select("rid"), "rid", "left_semi"))

    entries = heads.select("rid", "n", F.explode(F.arrays_zip("key", "before")).alias("e"))
    entries = entries.select(F.col("e.key").alias("key"), "rid", "n", (F.col("n") - F.col("e.before")).alias("r"))
    often = entries.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key")
    shared = checkpointed(entries.join(often, "key", "left_semi"))

    def chance(n1: str, r1: str, n2: str, r2: str):
        return F.expr(f"{num + den} * least({r1}, {r2}) >= {num} * (cast({n1} as long) + {n2})")

    def parity_chance(odd1: Column, odd2: Column, n1: Column, n2: Column) -> Column:
        apart = F.aggregate(F.zip_with(odd1, odd2, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
        return F.lit(num + den) * apart <= (den - num) * (n1.cast("long") + n2)

    def side(rows: DataFrame, key: str, *columns: str) -> DataFrame:
        return rows.select(F.col("rid").alias(key), *(F.col(c).alias(f"{c}_{key}") for c in columns))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that pass the parity bound and whose overlap, accumulated block by block, reaches the bound."""
        pairs = pairs.join(side(heads, "x", "n", "odd"), "x").join(side(heads, "y", "n", "odd"), "y")
        pairs = pairs.filter(parity_chance(F.col("odd_x"), F.col("odd_y"), F.col("n_x"), F.col("n_y")))
        pairs = checkpointed(pairs.select("x", "y"))
        wanted = spark.sparkContext.broadcast(slot_bitmap(pairs.select("x").union(pairs.select("y")), "x"))
        lists = ", ".join(f"grams{b} array<long>, later{b} long" for b in range(PRODUCT_BLOCKS))
        sets = checkpointed(texts.mapInArrow(_blocked_sets(k, wanted), f"rid long, n long, {lists}"))
        pairs = pairs.withColumn("overlap", F.lit(0))
        for b in range(PRODUCT_BLOCKS):
            part = sets.select("rid", "n", F.col(f"grams{b}").alias("grams"), F.col(f"later{b}").alias("later"))
            both = pairs.join(side(part, "x", "n", "grams", "later"), "x").join(side(part, "y", "n", "grams", "later"), "y")
            both = both.withColumn("overlap", F.col("overlap") + F.size(F.array_intersect("grams_x", "grams_y")))
            both = both.filter(F.expr(f"{num + den} * (overlap + least(later_x, later_y)) >= {num} * (n_x + n_y)"))
            pairs = checkpointed(both.select("x", "y", "overlap"))
        return pairs.select("x", "y")

    lead = shared.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("r")).alias("before"), "rid", "n", "r")).alias("lead"))
    star = shared.join(lead, "key").filter(F.col("rid") != F.col("lead.rid")).filter(chance("n", "r", "lead.n", "lead.r"))
    star = checkpointed(star.select(F.least("rid", "lead.rid").alias("x"), F.greatest("rid", "lead.rid").alias("y")).distinct())
    near = checkpointed(linked(star))
    label = components(near)
    open_ = shared.join(label.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    ends = open_.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("n").alias("low"), F.max("r").alias("high"))
    # an entry goes on if a row of the key's smallest size and largest rest would have a chance with it
    least = F.expr(f"greatest(low, ceil(cast(n as long) * {num} / {den}))")
    open_ = open_.join(ends.filter("a <> b").drop("a", "b"), "key").filter(
        (num + den) * F.least("r", "high") >= num * (F.col("n").cast("long") + least)
    )
    open_ = checkpointed(open_.drop("low", "high"))
    # both halves of the parity bits laid on each other still bound the difference from below
    folded = F.zip_with(F.slice("odd", 1, BLOCKS // 128), F.slice("odd", BLOCKS // 128 + 1, BLOCKS // 128), lambda a, b: a.bitwiseXOR(b))
    open_ = open_.join(heads.select("rid", folded.alias("odd")), "rid")
    one, two = open_.alias("one"), open_.alias("two")
    more = one.join(
        two,
        (F.col("one.key") == F.col("two.key"))
        & (F.col("one.rid") < F.col("two.rid"))
        & (F.col("one.component") != F.col("two.component"))
        & chance("one.n", "one.r", "two.n", "two.r")
        & parity_chance(F.col("one.odd"), F.col("two.odd"), F.col("one.n"), F.col("two.n")),
    )
    more = more.select(F.col("one.rid").alias("x"), F.col("two.rid").alias("y")).distinct()
    more = checkpointed(more.join(star, ["x", "y"], "left_anti"))
    if not more.isEmpty():
        label = components(near.union(linked(more)))

    placed = rows.join(label.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    placed = checkpointed(placed.join(least, "component").select("n", "s1", "s2", "copies", F.col("least.doc").alias("component_id"), F.col("least.key").alias("keep_key")))
    # sets of more rows than half a task's share, fewer than twice the tasks, are broadcast; the others meet their rows by shuffle
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = (placed.agg(F.sum("copies")).first()[0] or 0) / (2 * tasks)
    heavy, light = placed.filter(F.col("copies") > limit).drop("copies"), placed.filter(F.col("copies") <= limit).drop("copies")
    some = sizes.filter("n > 0").join(F.broadcast(heavy), ["n", "s1", "s2"], "left")
    columns = [F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("_id").alias("row_key"), "keep_key"]
    hot = some.filter("keep_key is not null").select(*columns)
    rest = some.filter("keep_key is null").drop("component_id", "keep_key").join(light, ["n", "s1", "s2"]).select(*columns)
    alone = sizes.filter("n = 0").withColumns({"component_id": F.col("doc"), "keep_key": F.col("_id")}).select(*columns)
    return hot.unionByName(rest).unionByName(alone)
