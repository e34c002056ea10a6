"""Small documents with the awkward cases, and brute-force helpers."""

import random
import re

from pyspark.sql import types as T

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns named like the operators' own.
CLASHES = ["n", "h", "key", "rid", "doc", "keep", "_sha", "_keep", "_size", "_id", "_spans", "__spans", "kept", "score", "places", "item"]


def words_of(text):
    return re.findall(r"[^\x20\t-\r]+", (text or "").translate(FOLD))


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "zeta", "éta", "theta", "iota"]) + str(rng.randint(0, 40)) for _ in range(n))


def edge_texts(seed=3):
    """(doc_id, text) rows: nulls, empty and blank texts, one very long, copies, near copies, repeated rows, odd characters."""
    rng = random.Random(seed)
    base = ". ".join(sentence(rng, 12) for _ in range(10)) + "."
    words = base.split(" ")
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, base), (5, base.upper()), (6, base), (4, base), (7, "one"), (8, "one two"), (9, "One  two\n")]
    for k in range(12):
        edited = list(words)
        for _ in range(k % 4):
            edited[rng.randrange(len(edited))] = f"edit{rng.randint(0, 9)}"
        rows.append((10 + k, " ".join(edited)))
    rows += [(30, "\n".join(sentence(rng, 9) + "." for _ in range(2500))), (31, "a a a a a a a a a a a a a a a a a a. " * 8), (32, "ÀÉÎ 日本語。 \x00 \x1c x ▁▁ 😀 <|endoftext|>tail <s>")]
    passage = " ".join(sentence(rng, 11) + "." for _ in range(6))
    rows += [(40 + k, sentence(rng, 20) + ".\n" + passage + "\n" + sentence(rng, 15) + ".") for k in range(5)]
    rows += [(60 + k, sentence(rng, rng.randint(1, 60))) for k in range(25)]
    return rows


def frame(spark, rows, clashes=True):
    """The rows with extra columns, some of them null."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    extra = CLASHES if clashes else []
    for name in extra:
        schema = schema.add(name, T.StringType())
    return spark.createDataFrame([(*r, *(None if (i + j) % 3 else name for j, name in enumerate(extra))) for i, r in enumerate(rows)], schema)
