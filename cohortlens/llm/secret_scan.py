"""Secret scan with multipart credential linking (DataFrame functions only).

Base kinds are found by pattern alone (``BASE``).  Weak kinds (``WEAK``) are
texts that mean little by themselves: a 40-character mixed-case key and an
endpoint address.  A weak candidate is reported only when a complementary part
lies in its scope: an interval join on (document, cell) keeps candidates whose
scope of ``SCOPE`` code points to either side holds a part of the kinds named
for it.  Each part stands in its own cell and the candidate looks into the
cells its scope touches, so a join key never holds more than the parts of one
stretch of one document, and the join is a semi-join: no pairs come out.

Spark's functions give matches without their places, so places are summed up:
the pieces between matches (``split``) and the matches (``regexp_extract_all``)
alternate, and their lengths in code points give every start and end, in
chunks of ``CHUNK`` matches, so the time of a long text grows in proportion to
it.  Spans cover the whole match; ends are exclusive.  All patterns run once;
the spans are written, and the join reads them.

Edge cases: null text counts as empty and has no spans; equal spans of
different kinds are reported for each kind; every row is scanned and linked by
itself, also rows that share an id or have none; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import checkpointed

SCOPE = 400
#: Matches that one step sums up.
CHUNK = 256
#: Kind, pattern, and the test a match must pass, in the order in which equal starts are reported (fixed values).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20),
    ("hex", "[0-9a-f]{24,}", lambda m: F.lit(True)),  # shorter runs never match, so most texts skip the walk
]
#: A run of 40 key characters with upper case, lower case and a digit; an address with a host.
WEAK = [
    ("key40", "[A-Za-z0-9+/]{40,}", lambda m: (F.length(m) == 40) & m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")),
    ("endpoint", "(?:https?|s3|jdbc:[a-z]+|ftp)://[A-Za-z0-9.:@/_-]+", lambda m: F.length(m) >= 10),
]
#: What must stand in the scope of a weak candidate: an identifier for a key, a secret for an endpoint.
COMPLEMENTS = {"key40": ["access"], "endpoint": ["assign", "access", "hex"]}
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
_ORDER = {kind: k for k, (kind, _, _) in enumerate(BASE + WEAK)}


def _spans(text: Column, kind: str, pattern: str, passes) -> Column:
    """Array of (start, rank, kind, end) of the pattern's matches that pass, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def length(x: Column) -> Column:
        return x["gap"] + F.length(x["m"])

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), F.lit(_ORDER[kind]).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(passes(x["m"]), F.concat(state["spans"], F.array(one))).otherwise(state["spans"]).alias("spans"))

    def walked(steps: Column) -> Column:
        return F.aggregate(steps, zero, step)["spans"]

    def chunk(steps: Column, i: Column) -> Column:
        return F.slice(steps, i * CHUNK + 1, F.lit(CHUNK))

    def in_chunks(steps: Column) -> Column:
        """Each chunk is walked from 0 and then moved to where it starts: arrays grow within a chunk alone."""
        chunks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int"))
        sums = F.transform(chunks, lambda i: F.aggregate(chunk(steps, i), F.lit(0), lambda s, x: s + length(x)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        moved = F.zip_with(
            chunks,
            F.slice(starts, 1, F.size(chunks)),
            lambda i, at: F.transform(
                walked(chunk(steps, i)),
                lambda s: F.struct((s["start"] + at).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + at).alias("end")),
            ),
        )
        return F.flatten(moved)

    # one value bound to a name: the array of matches is made once, however often it is read
    spans = F.element_at(F.transform(F.array(steps), lambda s: F.when(F.size(s) > CHUNK, in_chunks(s)).otherwise(walked(s))), 1)
    # a text without a match skips the walk
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, by start and then kind as listed, comma-joined."""
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, one array of spans for each base kind, and ``linked``: the weak spans that a complementary part confirms."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("_text"))
    spans = [_spans(F.col("_text"), *kind).alias(kind[0]) for kind in BASE]
    weak = F.concat(*(_spans(F.col("_text"), *kind) for kind in WEAK)).alias("weak")
    # numbered when written: a number tells rows apart that share an id
    rows = checkpointed(rows.select("doc_id", *spans, weak).withColumn("_row", F.monotonically_increasing_id()))

    candidates = rows.filter(F.size("weak") > 0)
    weak = candidates.select("_row", F.explode("weak").alias("s"))
    cells = F.sequence(F.floor((F.col("s.start") - SCOPE) / SCOPE), F.floor((F.col("s.end") + SCOPE) / SCOPE))
    weak = weak.select("_row", "s", F.explode(cells).alias("cell"))
    parts = candidates.select("_row", F.explode(F.concat(*(F.col(kind) for kind, _, _ in BASE))).alias("p"))
    parts = parts.select("_row", "p", F.explode(F.sequence(F.floor(F.col("p.start") / SCOPE), F.floor((F.col("p.end") - 1) / SCOPE))).alias("cell"))
    wants = F.lit(False)
    for kind, complements in COMPLEMENTS.items():
        wants = wants | ((F.col("s.kind") == kind) & F.col("p.kind").isin(complements))
    near = (F.col("p.start") < F.col("s.end") + SCOPE) & (F.col("p.end") > F.col("s.start") - SCOPE)
    apart = (F.col("p.start") >= F.col("s.end")) | (F.col("p.end") <= F.col("s.start"))
    linked = weak.alias("w").join(
        parts.alias("q"), (F.col("w._row") == F.col("q._row")) & (F.col("w.cell") == F.col("q.cell")) & wants & near & apart, "left_semi"
    )
    linked = linked.select("_row", "s").distinct().groupBy("_row").agg(F.collect_list("s").alias("linked"))
    out = rows.drop("weak").join(linked, "_row", "left").drop("_row")
    return out.withColumn("linked", F.coalesce("linked", F.array().cast(_SPANS)))
