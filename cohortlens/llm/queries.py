"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import ascii_lower, table
from cohortlens.llm.decontamination import decontaminate
from cohortlens.llm.exact_dedup import exact_dedup
from cohortlens.llm.hard_negatives import mine_hard_negatives
from cohortlens.llm.language_id import identify_languages, train_language_id
from cohortlens.llm.lm_scoring import score_documents
from cohortlens.llm.ngram_join import ngram_jaccard_join
from cohortlens.llm.quality_classifier import score_quality, train_quality
from cohortlens.llm.secret_scan import ASSIGN, SCOPE, scan_secrets, span_text
from cohortlens.llm.sentencepiece_codec import sentencepiece_codec
from cohortlens.llm.spelling_variants import letter_runs, pieces, spelling_variants
from cohortlens.llm.substring_dedup import substring_dedup
from cohortlens.llm.token_counts import token_counts
from cohortlens.llm.tool_calls import chat_messages, turns_as_messages

QUERIES, ORACLES = {}, {}
TOKEN_LIMIT = 1024


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(ascii_lower(F.col("text")), 256))
    return exact_dedup(docs, sha_col="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op4_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
),
g AS (
  SELECT DISTINCT w.r, len(ws) < 3 AS short, array_to_string(CASE WHEN len(ws) < 3 THEN ws ELSE ws[i:i + 2] END, ' ') AS gram
  FROM w, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS p(i)
),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
links AS (
  SELECT x.r AS a, y.r AS b FROM g x JOIN g y ON x.gram = y.gram AND x.short = y.short AND x.r <> y.r
  JOIN n nx ON nx.r = x.r JOIN n ny ON ny.r = y.r
  GROUP BY x.r, y.r, nx.n, ny.n HAVING 100 * count(*) >= 90 * (nx.n + ny.n - count(*))
),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (r) JOIN least USING (r)
"""


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = f"regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op5_benchmark_decontamination"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
  FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p(i) WHERE len(ws) > 0
),
sizes AS (SELECT DISTINCT n FROM items),
spots AS (
  SELECT d.r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM d, sizes, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS p(i)
),
hits AS (SELECT r, i, items.n AS n, item_id FROM spots JOIN items ON spots.k = items.k AND spots.n = items.n),
covered AS (
  SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits), unnest(range(0, n)) AS q(j) GROUP BY r
),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.size("linked").cast("long").alias("n_linked"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.concat(base, "linked")).alias("spans"),
    )


def _parts_sql(kind: str, rank: int, pattern: str, test: str) -> str:
    """Spans of a pattern: the texts between its matches and the matches alternate."""
    pattern = pattern.replace("'", "''")
    at = "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT r, CAST({at} AS BIGINT) AS s, {rank} AS rank, '{kind}' AS kind, CAST({at} AS BIGINT) + length(ms[i]) AS e
    FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps
          FROM d), unnest(range(1, len(ms) + 1)) AS m(i) WHERE {test.format(m='ms[i]', p=pattern)}"""


_KINDS = [
    ("assign", ASSIGN, "length(regexp_extract({m}, '{p}', 2)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length({m}) >= 20"),
    ("hex", "[0-9a-f]{24,}", "true"),
    ("key40", "[A-Za-z0-9+/]{40,}", "length({m}) = 40 AND regexp_matches({m}, '[A-Z]') AND regexp_matches({m}, '[a-z]') AND regexp_matches({m}, '[0-9]')"),
    ("endpoint", "(?:https?|s3|jdbc:[a-z]+|ftp)://[A-Za-z0-9.:@/_-]+", "length({m}) >= 10"),
]
ORACLES["op7_secret_scan"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS ({" UNION ALL ".join(_parts_sql(k, i, p, t) for i, (k, p, t) in enumerate(_KINDS))}),
linked AS (
  SELECT DISTINCT w.* FROM parts w JOIN parts q ON w.r = q.r AND w.rank > 2 AND q.rank < 3 AND (w.kind = 'endpoint' OR q.kind = 'access')
    AND q.s < w.e + {SCOPE} AND q.e > w.s - {SCOPE} AND (q.s >= w.e OR q.e <= w.s)
),
spans AS (
  SELECT r, rank < 3 AS base, s, rank, kind || ':' || s || ':' || e AS t, kind FROM parts WHERE rank < 3
  UNION ALL SELECT r, false, s, rank, kind || ':' || s || ':' || e, kind FROM linked
),
sums AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         count(*) FILTER (NOT base) AS n_linked, string_agg(t, ',' ORDER BY s, rank) FILTER (base) AS b, string_agg(t, ',' ORDER BY s, rank) AS a
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_linked, 0) AS n_linked,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN sums USING (r)
"""


def held_out():
    """A quarter of the documents, never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train_language_id(docs.filter(~held_out()))
    return identify_languages(docs, net, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    ids = F.array_join(F.transform("piece_ids", lambda x: x.cast("string")), ",")
    return coded.select("doc_id", "n_pieces", "n_byte_pieces", F.sha2(ids, 256).alias("ids_sha256"), "round_trip", "parity")


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = substring_dedup(docs)
    return cleaned.select("doc_id", "n_sentences", "n_removed", "removed", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


REPLY = {"reply": {"prompt": (("STRING",), True), "turn": (("BIGINT",), True)}}


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_messages(turns_as_messages(table(spark, sf_dir, "conversations")), REPLY)


ORACLES["op8_chat_formatting"] = """
WITH RECURSIVE m AS (SELECT *, ((length(text) + turn) % 8 + 8) % 8 AS k FROM conversations),
calls AS (
  SELECT conv_id, turn, role, text, conv_id || '-' || turn AS call_id,
         CASE k WHEN 0 THEN conv_id || '-' || (turn + 2) WHEN 1 THEN conv_id || '-' || (turn - 2) END AS after
  FROM m WHERE role = 'user'
),
nodes AS (SELECT conv_id, call_id, min(turn) AS turn FROM calls GROUP BY ALL),
edges AS (
  SELECT DISTINCT c.conv_id, c.call_id, n.call_id AS dep, n.turn FROM calls c JOIN nodes n ON n.conv_id = c.conv_id AND n.call_id = c.after
),
sizes AS (SELECT conv_id, count(*) AS n FROM nodes GROUP BY conv_id),
walk AS (
  SELECT conv_id, call_id, call_id AS dep, turn, 0 AS far FROM nodes
  UNION
  SELECT w.conv_id, w.call_id, e.dep, e.turn, w.far + 1
  FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.call_id = w.dep JOIN sizes s ON s.conv_id = w.conv_id AND w.far < s.n
),
-- a walk of n steps over n calls passes one of them twice
places AS (
  SELECT w.conv_id, w.call_id, max(far) >= any_value(n) AS cyclic, max({'p': w.turn, 'b': far}) AS key
  FROM walk w JOIN sizes s USING (conv_id) GROUP BY w.conv_id, w.call_id
),
answers AS (
  SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, min({'turn': turn, 'content': text}) AS answer
  FROM conversations WHERE role = 'assistant' GROUP BY 1, 2
),
parts AS (SELECT *, strpos(text, chr(10)) AS line FROM calls),
formed AS (
  SELECT *, CASE WHEN text IS NULL THEN to_json({'turn': turn})
                 WHEN line = 0 THEN to_json({'prompt': text, 'turn': turn})
                 ELSE to_json({'prompt': text[:line - 1], 'rest': text[line + 1:], 'turn': turn}) END AS arguments
  FROM parts
)
SELECT c.conv_id, c.turn, c.role, c.call_id, 'reply' AS name, a.answer IS NOT NULL AS answered, a.answer.turn AS answer_turn, NULL AS answers,
       coalesce(line = 0, false) AS valid, CASE WHEN cyclic THEN c.turn ELSE key.p END AS position,
       CASE WHEN cyclic THEN 0 ELSE key.b END AS bump, cyclic,
       to_json({'answers': NULL, 'call': {'arguments': c.arguments, 'id': c.call_id, 'name': 'reply', 'result': a.answer.content},
                'content': c.text, 'role': c.role, 'turn': c.turn})::varchar AS json
FROM formed c JOIN places p ON p.conv_id = c.conv_id AND p.call_id = c.call_id LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.call_id = c.call_id
UNION ALL
SELECT m.conv_id, m.turn, m.role, NULL, NULL, NULL, NULL, n.call_id, NULL, m.turn, 0, false,
       to_json({'answers': n.call_id, 'call': NULL, 'content': m.text, 'role': m.role, 'turn': m.turn})::varchar
FROM m LEFT JOIN nodes n ON m.role = 'assistant' AND n.conv_id = m.conv_id AND n.call_id = m.conv_id || '-' || (m.turn - 1)
WHERE m.role IS DISTINCT FROM 'user'
"""


LETTERS = "A-Za-z\u00C0-\u00FF"
WORD_LETTERS, WORD_COUNT, TYPO_EVERY = 7, 2, 31


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    parts = docs.select("doc_id", F.explode(pieces(F.col("text"), LETTERS)).alias("part"))
    runs = parts.select("doc_id", F.explode(letter_runs(F.col("part"), LETTERS, WORD_LETTERS)).alias("run"))
    runs = runs.select(ascii_lower(F.col("run")).alias("run"), "doc_id")
    runs = runs.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % TYPO_EVERY == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= WORD_LETTERS)
    return spelling_variants(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= WORD_COUNT))


GOOD = 0.7


@query
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train_quality(docs.filter(~held_out()), table(spark, sf_dir, "labels").filter(~held_out()))
    scored = score_quality(docs, weights, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r <> b.r
),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST, other) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.r = p.r AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.r, p.other ORDER BY n.score DESC, n.id NULLS LAST, n.other)
QUALIFY row_number() OVER w <= 5
"""
