"""Token counts by a map-side two-tier lookup.

Texts are cut into pre-tokens in the task that reads them.  The token length
of a pre-token comes from a broadcast table of frequent pre-tokens (tier one)
or from a cache that each Python worker keeps across its tasks, filled by
encoding the misses in batches (tier two).  No pre-token of the corpus is
shuffled and nothing but the counts leaves the tasks.

The broadcast table is primed from a bounded sample of rows (``PRIMING_ROWS``
in expectation) and holds at most ``TABLE_ROWS`` pre-tokens.  It only decides which tier answers: both tiers
give the tokenizer's own length, so counts are exact whatever the table holds.

A ``.json`` file is read with the tokenizers library, a ``.model`` file with
sentencepiece.  Special strings inside a text are handled as the library does
by default.  A vocabulary whose pre-tokenizer is not the byte-level pattern is
encoded text by text by the library itself.

Edge cases: null text counts as empty and has 0 tokens; other columns are not
read; an empty table gives an empty result; repeated rows are counted each.
"""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import keyed, text_steps

PRIMING_ROWS = 2000
TABLE_ROWS = 32_768
#: Entries of the newer of the worker cache's two halves, and characters of one of its keys.
CACHE_ROWS, CACHE_CHARS = 250_000, 64
#: The byte-level pattern of the vocabulary file (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """The lengths of texts under one vocabulary; one per Python worker."""

    def __init__(self, path: str):
        import regex

        #: Tier one with the newer half of tier two, and the older half.
        self.look: dict[str, int] | None = None
        self.older: dict[str, int] = {}
        self.cut = self.special = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in self.pieces.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lengths = lambda texts: [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        spec = json.loads(self.library.to_str())
        before = spec.get("pre_tokenizer") or {}
        plain = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
        if plain and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
            self.cut = regex.compile(PATTERN).findall
            names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
            self.special = regex.compile("|".join(map(regex.escape, names))) if names else None

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The text's pre-tokens, and how many special strings stand between them."""
        if self.special is None or not self.special.search(text):
            return self.cut(text), 0
        parts = self.special.split(text)
        return [x for part in parts for x in self.cut(part)], len(parts) - 1

    def counts(self, texts: list[str], table: dict[str, int]) -> list[int]:
        if self.cut is None:
            return self.lengths(texts)
        if self.look is None:
            self.look = dict(table)
        look, cut = self.look, [self.pre_tokens(t) for t in texts]
        missed = set().union(*(pre for pre, _ in cut)).difference(look)
        kept = {x: self.older[x] for x in missed if x in self.older}
        look.update(kept)
        missed = [x for x in missed if x not in kept]
        if missed:
            look.update(zip(missed, self.lengths(missed), strict=True))
        out = [special + sum(map(look.__getitem__, pre)) for pre, special in cut]
        for x in missed:
            if len(x) > CACHE_CHARS:
                del look[x]
        if len(look) > len(table) + CACHE_ROWS:
            self.older, self.look = look, dict(table)
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def frequent_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a bounded sample of rows; {} if the vocabulary has no pre-tokens."""
    if encoder(path).cut is None:
        return {}
    every = max(1, docs.count() // PRIMING_ROWS)
    rows = keyed(docs, id_col, text_col).filter(F.pmod(F.xxhash64("_id"), F.lit(every)) == 0).select("_text")

    def tally(batches):
        seen: Counter = Counter()
        for batch in text_steps(batches):
            for text in batch.column(0).to_pylist():
                seen.update(x for x in encoder(path).pre_tokens(text or "")[0] if len(x) <= CACHE_CHARS)
        top = seen.most_common(TABLE_ROWS)
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array([x for x, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    tallies = rows.mapInArrow(tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [r.piece for r in tallies.filter("n > 1").orderBy(F.desc("n"), "piece").limit(TABLE_ROWS).collect()]
    return dict(zip(top, encoder(path).lengths(top), strict=True)) if top else {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, path, id_col, text_col))
    kind = docs.schema[id_col].dataType

    def count(batches):
        own, table = encoder(path), frequent.value
        for batch in text_steps(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(own.counts(texts, table), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return keyed(docs, id_col, text_col).mapInArrow(count, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long")
