"""Selection, search, sort, page and top-k over the scored frame.

Top-k lists use ``orderBy(...).limit(k)``, which Spark plans as a
per-partition top-k followed by a merge of k rows per partition
(``TakeOrderedAndProject``): no global sort, no single-partition window.
The representative row per student is a ``min`` over a struct, which is an
ordinary aggregate with map-side partial aggregation, so a student with a
huge number of enrollments never lands in one task as raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import clamp_tier
from cohortlens.functions.positions import TOPK_ROWS, ordered_slice
from cohortlens.sources.schemas import ENROLLMENT_KEYS
from cohortlens.sources.sorted_store import SortedStore, write_sorted

# Fields the student table can be sorted by, and page sizes.
SORT_FIELDS = [
    "id", "code_module", "score", "submission_rate", "engagement_ratio",
    "active_days", "clicks", "risk", "withdrew_early",
]
PAGE_SIZES = [25, 50, 100]
TIE_KEYS = ["id", "code_module", "code_presentation"]


# ── visibility, filters, search ────────────────────────────────────────────


def visible_rows(scored: DataFrame, modules: Sequence[str] | None = None) -> DataFrame:
    """Rows of the modules a user may see; an empty list means all modules."""
    if not modules:
        return scored
    return scored.filter(F.coalesce("code_module", F.lit("")).isin(list(modules)))


def student_filter(
    scored: DataFrame,
    module: str | None = None,
    presentation: str | None = None,
    tiers: Iterable[int] | None = None,
    withdrew: int | None = None,
) -> DataFrame:
    """Chain of optional equality / set filters (pushed into the scan)."""
    rows = scored
    if module:
        rows = rows.filter(F.col("code_module") == module)
    if presentation:
        rows = rows.filter(F.col("code_presentation") == presentation)
    tiers = sorted(set(tiers or []))
    if tiers:
        rows = rows.filter(F.col("risk").isin(tiers))
    if withdrew is not None:
        rows = rows.filter(F.col("withdrew_early") == int(withdrew))
    return rows


def student_search(scored: DataFrame, text: str, columns: Sequence[str] = ("id",)) -> DataFrame:
    """Case-insensitive literal substring match on any of ``columns``.

    ``contains`` is a literal match, so ``%`` and ``_`` match themselves.
    The default searches the id only; pass the id, module and presentation
    columns for the wider browser-side search.
    """
    if not text:
        return scored
    needle = F.lit(text.lower())
    cond = None
    for c in columns:
        hit = F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle)
        cond = hit if cond is None else (cond | hit)
    return scored.filter(cond)


# ── sort and page ──────────────────────────────────────────────────────────


def sort_keys(sort_by: str = "risk", order: str = "desc", tie: str = "server") -> list[Column]:
    """Sort expressions for the student table.

    ``risk`` sorts by (tier, -score) reversed for descending: worst tier
    first and, inside a tier, the lowest score first; ascending gives the
    reverse.  ``tie="score_asc"`` always breaks tier ties by ascending score.
    Remaining ties are broken by the enrollment key so pages are stable.
    """
    if sort_by not in SORT_FIELDS:
        sort_by = "risk"
    desc = order == "desc"
    value = F.coalesce(F.col(sort_by), F.lit(0)) if sort_by not in ("id", "code_module") else F.col(sort_by)
    keys = [value.desc() if desc else value.asc()]
    if sort_by == "risk":
        score = F.coalesce(F.col("score"), F.lit(0.0))
        if tie == "score_asc" or desc:
            keys.append(score.asc())
        else:
            keys.append(score.desc())
    keys += [F.col(k).asc() for k in TIE_KEYS]
    return keys


def student_sort(scored: DataFrame, sort_by: str = "risk", order: str = "desc", tie: str = "server") -> DataFrame:
    return scored.orderBy(*sort_keys(sort_by, order, tie))


def page_bounds(total_records: int, page: int, page_size: int) -> tuple[int, int]:
    """Clamp ``page`` into ``1..total_pages`` (at least one page)."""
    total_pages = math.ceil(total_records / page_size) if total_records > 0 else 1
    return max(1, min(page, total_pages)), total_pages


def student_page(
    rows: DataFrame,
    page: int = 1,
    page_size: int = 50,
    sort_by: str = "risk",
    order: str = "desc",
    topk_rows: int = TOPK_ROWS,
) -> DataFrame:
    """One page of the sorted rows with its position and page metadata columns.

    The row count is one scalar action.  A page ending within the first
    ``topk_rows`` positions is a per-partition top-k (offset + limit); a
    deeper page numbers the rows with a distributed range sort, so no task
    ever merges more than a page's worth of rows.
    """
    if page_size not in PAGE_SIZES:
        page_size = 50
    total = rows.count()
    page, total_pages = page_bounds(total, page, page_size)
    sliced = ordered_slice(rows, sort_keys(sort_by, order), (page - 1) * page_size, page_size, topk_rows)
    return (
        sliced.withColumn("page", F.lit(page))
        .withColumn("total_pages", F.lit(total_pages))
        .withColumn("total_records", F.lit(total).cast("long"))
    )


def store_sorted(rows: DataFrame, root: str, sort_by: str = "risk", order: str = "desc") -> None:
    """Stores the rows in a table order, once, for ``stored_page``."""
    write_sorted(rows, sort_keys(sort_by, order), root)


def stored_page(store: SortedStore, page: int = 1, page_size: int = 50) -> DataFrame:
    """``student_page`` from rows stored in its order: a page at any depth reads the parts that hold it."""
    if page_size not in PAGE_SIZES:
        page_size = 50
    total = store.total()
    page, total_pages = page_bounds(total, page, page_size)
    return (
        store.slice((page - 1) * page_size, page_size)
        .withColumn("position", F.col("position").cast("int"))
        .withColumn("page", F.lit(page))
        .withColumn("total_pages", F.lit(total_pages))
        .withColumn("total_records", F.lit(total).cast("long"))
    )


# ── lookups and top-k ──────────────────────────────────────────────────────


def student_lookup(
    scored: DataFrame, student_id: str, module: str | None = None, presentation: str | None = None
) -> DataFrame:
    """First enrollment of a student (optionally of one module/presentation)."""
    rows = scored.filter(F.col("id") == str(student_id))
    if module:
        rows = rows.filter(F.col("code_module") == module)
    if presentation:
        rows = rows.filter(F.col("code_presentation") == presentation)
    return rows.orderBy("code_module", "code_presentation").limit(1)


def store_by_student(scored: DataFrame, root: str) -> None:
    """Stores the rows sorted by student, module and presentation, once, for ``stored_lookup``."""
    write_sorted(scored, [F.col(c).asc() for c in TIE_KEYS], root, key_columns=TIE_KEYS)


def stored_lookup(store: SortedStore, student_id: str, module: str | None = None, presentation: str | None = None) -> DataFrame:
    """``student_lookup`` by key: reads the one part that holds the student's first row.

    A presentation without a module is no leading key: then all parts of the student are read.
    """
    key = {"id": str(student_id)}
    if module:
        key["code_module"] = module
        if presentation:
            key["code_presentation"] = presentation
    rows = store.lookup(first_only=bool(module) or not presentation, **key)
    if presentation:
        rows = rows.filter(F.col("code_presentation") == presentation)
    return rows.orderBy("code_module", "code_presentation").limit(1)


def representative_row(scored: DataFrame) -> DataFrame:
    """One row per student: worst tier, then lowest score, module, presentation, row key.

    ``min`` over ``struct(-tier, score, module, presentation, row key)`` is a
    plain aggregate of the sort keys alone, so partial aggregation bounds the
    work per task even for a student with very many enrollments; the row's
    other columns are joined back on student and row key.  ``risk`` is the
    worst tier.
    """
    rows = scored.filter(F.col("id").isNotNull() & (F.col("id") != ""))
    ranked = F.struct(
        (-clamp_tier(F.col("risk"))).alias("neg_risk"),
        F.coalesce(F.col("score"), F.lit(100.0)).alias("sort_score"),
        F.coalesce(F.col("code_module"), F.lit("")).alias("sort_module"),
        F.coalesce(F.col("code_presentation"), F.lit("")).alias("sort_presentation"),
        F.col("row_key"),
    )
    best = rows.groupBy("id").agg(F.min(ranked).alias("pick"))
    best = best.select(F.col("id").alias("_id"), F.col("pick.row_key").alias("_key"), (-F.col("pick.neg_risk")).alias("_risk"))
    payload = [c for c in rows.columns if c != "risk"]
    picked = rows.join(best, (F.col("id") == F.col("_id")) & (F.col("row_key") == F.col("_key")))
    return picked.select(*payload, F.col("_risk").alias("risk")).dropDuplicates(["id"])


def attention_list(scored: DataFrame, k: int = 10) -> DataFrame:
    """High-risk and critical enrollments: withdrawn first, worst tier, lowest score."""
    return (
        scored.filter(F.col("risk") >= 2)
        .orderBy(
            F.col("withdrew_early").desc(),
            F.col("risk").desc(),
            F.coalesce(F.col("score"), F.lit(0.0)).asc(),
            *[F.col(c).asc() for c in TIE_KEYS],
        )
        .limit(k)
    )


def top_at_risk_students(scored: DataFrame, k: int = 50) -> DataFrame:
    """Top ``k`` students (representative rows) with tier >= 2, worst first.

    A student whose worst tier is at least 2 has the representative row among
    the rows of such tiers, so the other rows are dropped before the aggregate.
    """
    reps = representative_row(scored.filter(clamp_tier(F.col("risk")) >= 2))
    return (
        reps.orderBy(F.col("risk").desc(), F.coalesce(F.col("score"), F.lit(100.0)).asc(), F.col("id").asc())
        .limit(k)
    )


__all__ = [
    "ENROLLMENT_KEYS",
    "attention_list",
    "page_bounds",
    "representative_row",
    "sort_keys",
    "store_by_student",
    "store_sorted",
    "stored_lookup",
    "stored_page",
    "student_filter",
    "student_lookup",
    "student_page",
    "student_search",
    "student_sort",
    "top_at_risk_students",
    "visible_rows",
]
