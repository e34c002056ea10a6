"""LM scoring by masked pseudo-likelihood.

Tokens are characters after lower-casing: all that the documents hold, and one
for the text's border.  The network has a code for each, up to ``VOCABULARY`` of
them; those after the most frequent 4,094 share a class, and such a token's
probability is its class's times its share of the class's occurrences.
A bidirectional window network predicts every token from the ``SIDE`` tokens
on both of its sides: the neighbours' vectors, one table per place, are added up,
go through tanh, and give the token's probability among all tokens.  A document's score is
the sum of the log-probabilities of all its tokens, each conditioned on its
neighbours, over the whole text.

Training uses every window of the corpus.  Tasks count their windows in chunks
and the counts are summed by window, so a window's weight is its number of
occurrences.  The table of counted windows is dealt to shards by hash; each round every shard
trains a copy of the network in numpy on its own windows, in order of the
window and with a fixed seed, and Spark averages the copies, weighted by the
shards' occurrences.  Only the character counts and the averaged network
(``5 * HIDDEN`` numbers per code) reach the driver.

Edge cases: null and empty texts have no tokens, a sum of 0 and a mean of 0;
repeated rows are scored one by one and count as often as they occur; other columns
are not read; an empty table gives an empty result; ties in the character
counts go to the smaller code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import checkpointed, keyed, text_steps

SIDE, HIDDEN, CODE_BITS = 2, 24, 6
#: A window of five codes of so many bits still is one 64-bit number.
MOST_BITS = 12
BORDER, OTHER = 0, 1
CODES = 1 << CODE_BITS
VOCABULARY = (1 << MOST_BITS) - 2
CHUNK = 1 << 21
ROUNDS, SHARD_ROWS, STEPS, BATCH, RATE, SEED = 3, 1 << 20, 100, 2048, 0.02, 9
BLOCK, PAIRED = 1 << 14, 256


def _shapes(codes: int) -> dict[str, tuple[int, ...]]:
    return {"near": (2 * SIDE, codes, HIDDEN), "bias": (HIDDEN,), "out": (HIDDEN, codes), "base": (codes,)}


def code_bits(codes: int) -> int:
    return max(CODE_BITS, (codes - 1).bit_length())


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers of the lower-cased texts one after the other, and their lengths."""
    low = [t.lower() for t in texts]
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in low], np.int64)


def _padded_codes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts with SIDE border codes before, between and behind them, and the places of the tokens."""
    characters, sizes = _characters(texts)
    codes = table[np.minimum(characters, len(table) - 1)]
    at = np.arange(len(codes)) + np.repeat(SIDE * np.arange(1, len(sizes) + 1), sizes)
    out = np.full(len(codes) + SIDE * (len(sizes) + 1), BORDER, table.dtype)
    out[at] = codes
    return out, at


def _count_characters(batches):
    seen: dict[int, int] = {}
    for batch in text_steps(batches):
        characters, _ = _characters([t for t in batch.column(0).to_pylist() if t])
        low = np.bincount(np.minimum(characters, 0x3000), minlength=0x3001)
        for c in np.flatnonzero(low[:0x3000]):
            seen[int(c)] = seen.get(int(c), 0) + int(low[c])
        if low[0x3000]:
            for c, n in zip(*np.unique(characters[characters >= 0x3000], return_counts=True), strict=True):
                seen[int(c)] = seen.get(int(c), 0) + int(n)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["c", "n"])


def character_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts, the most frequent first, and their counts."""
    counts = texts.select("_text").mapInArrow(_count_characters, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    c, n = counts.column("c").to_numpy(), counts.column("n").to_numpy()
    order = np.lexsort((c, -n))
    return c[order], n[order]


def _code_table(characters: np.ndarray) -> np.ndarray:
    top = characters[:VOCABULARY]
    table = np.full(top.max(initial=0) + 2, OTHER, np.uint8 if len(top) + 2 <= 256 else np.uint16)
    table[top] = np.arange(2, 2 + len(top))
    return table


def code_table(texts: DataFrame) -> np.ndarray:
    """Code of every character number; the last entry stands for all beyond the table."""
    return _code_table(character_counts(texts)[0])


def rare_shares(characters: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log of each character's share of the occurrences without a code of their own, by character number; empty if all have one."""
    rare, n = characters[VOCABULARY:], counts[VOCABULARY:]
    if not len(rare):
        return np.zeros(0)
    shares = np.zeros(rare.max() + 1)
    shares[rare] = np.log(n / n.sum())
    return shares


def _windows(codes: np.ndarray, at: np.ndarray, bits: int = CODE_BITS) -> np.ndarray:
    """Every token with its neighbours as one number, the leftmost neighbour highest."""
    out = np.zeros(len(at), np.int32 if bits <= CODE_BITS else np.int64)
    for k in range(-SIDE, SIDE + 1):
        out = (out << bits) | codes[at + k].astype(out.dtype)
    return out


def _count_windows(table):
    def run(batches):
        chunk, size, bits = [], 0, code_bits(int(table.value.max()) + 1)

        def counted():
            w, n = np.unique(np.concatenate(chunk), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w), pa.array(n, pa.int64())], names=["w", "n"])

        for batch in text_steps(batches):
            texts = [t for t in batch.column(0).to_pylist() if t]
            if texts:
                chunk.append(_windows(*_padded_codes(texts, table.value), bits))
                size += len(chunk[-1])
            if size >= CHUNK:
                yield counted()
                chunk, size = [], 0
        if chunk:
            yield counted()

    return run


def fresh_network(codes: int = CODES) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return {k: (rng.normal(0, 0.2, shape) if len(shape) > 1 else np.zeros(shape)).astype(np.float32) for k, shape in _shapes(codes).items()}


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].reshape(-1) for k in _shapes(0)])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    shapes = _shapes((len(values) - HIDDEN) // ((2 * SIDE + 1) * HIDDEN + 1))
    ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
    return {k: part.reshape(s).astype(np.float32) for (k, s), part in zip(shapes.items(), np.split(values, ends[:-1]), strict=True)}


def gradient(net: dict[str, np.ndarray], near: np.ndarray, token: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted cross entropy of the tokens given their neighbours (place, example), and its gradient."""
    h = np.tanh(sum(net["near"][k][near[k]] for k in range(2 * SIDE)) + net["bias"])
    p = np.exp(h @ net["out"] + net["base"])
    p /= p.sum(1, keepdims=True)
    n = np.arange(len(token))
    loss = float(-(weight * np.log(np.maximum(p[n, token], 1e-12))).sum())
    p[n, token] -= 1
    p *= weight[:, None]
    back = (p @ net["out"].T) * (1 - h * h)
    g = {"out": h.T @ p, "base": p.sum(0), "bias": back.sum(0), "near": np.zeros_like(net["near"])}
    for k in range(2 * SIDE):
        np.add.at(g["near"][k], near[k], back)
    return loss, g


def train_shard(net: dict[str, np.ndarray], windows: np.ndarray, counts: np.ndarray, step: int) -> dict[str, np.ndarray]:
    """Adam over the shard's windows, one pass and STEPS steps at least; the windows' order does not matter."""
    order = np.argsort(windows)
    windows, counts = windows[order], counts[order]
    bits = code_bits(len(net["base"]))
    rng = np.random.default_rng(SEED + step)
    order = rng.permutation(len(windows))
    mean = {k: np.zeros_like(v) for k, v in net.items()}
    square = {k: np.zeros_like(v) for k, v in net.items()}
    steps = max(STEPS, -(-len(order) // BATCH))
    for t in range(1, steps + 1):
        part = np.take(order, np.arange((t - 1) * BATCH, t * BATCH) if len(order) > BATCH else np.arange(len(order)), mode="wrap")
        digits = [(windows[part] >> (bits * k)) & ((1 << bits) - 1) for k in range(2 * SIDE, -1, -1)]
        weight = counts[part].astype(np.float32)
        _, g = gradient(net, np.array(digits[:SIDE] + digits[SIDE + 1 :]), digits[SIDE], weight / weight.sum())
        rate = RATE / (1 + step) * (1 - 0.8 * t / steps) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        for k, v in g.items():
            mean[k] += 0.1 * (v - mean[k])
            square[k] += 0.01 * (v * v - square[k])
            net[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-6)).astype(np.float32)
    return net


def train_network(texts: DataFrame, table: np.ndarray) -> dict[str, np.ndarray]:
    """The window network of all texts (column ``_text``)."""
    context = texts.sparkSession.sparkContext
    codes = max(CODES, int(table.max()) + 1)
    kind = "int" if code_bits(codes) <= CODE_BITS else "long"
    counted = texts.select("_text").mapInArrow(_count_windows(context.broadcast(table)), f"w {kind}, n long")
    counted = checkpointed(counted.groupBy("w").agg(F.sum("n").alias("n")))
    shards = max(1, -(-counted.count() // SHARD_ROWS))
    dealt = checkpointed(counted.repartition(shards, "w"))
    net = fresh_network(codes)
    for step in range(ROUNDS):
        start = context.broadcast(flat(net))

        def train(batches, start=start, step=step):
            found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if found:
                w, n = (np.concatenate(x) for x in zip(*found, strict=True))
                total = int(n.sum())
                values = flat(train_shard(unflat(start.value), w, n, step)).astype(np.float64) * total
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values), pa.array(np.full(len(values), total, np.int64))],
                    names=["k", "v", "total"],
                )

        mean = dealt.mapInArrow(train, "k int, v double, total long").groupBy("k").agg((F.sum("v") / F.sum("total")).alias("v"))
        found = mean.toArrow()
        if not found.num_rows:
            return net
        net = unflat(found.column("v").to_numpy()[np.argsort(found.column("k").to_numpy())])
    return net


class Scorer:
    """Log-probabilities of tokens; neighbours on one side are looked up as one number."""

    def __init__(self, net: dict[str, np.ndarray]):
        self.net = net
        near = net["near"]
        self.codes = len(net["base"])
        self.paired = self.codes <= PAIRED
        if self.paired:
            self.left = (near[0][:, None] + near[1][None] + net["bias"]).reshape(-1, HIDDEN)
            self.right = (near[2][:, None] + near[3][None]).reshape(-1, HIDDEN)
        self.ones = np.ones(self.codes, np.float32)

    def log_probabilities(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.float32)
        wide = codes.astype(np.intp)
        block = max(1, BLOCK * CODES // self.codes)
        for i in range(0, len(at), block):
            own = at[i : i + block]
            if self.paired:
                h = np.take(self.left, wide[own - 2] * self.codes + wide[own - 1], axis=0)
                h += np.take(self.right, wide[own + 1] * self.codes + wide[own + 2], axis=0)
            else:
                h = sum(near[wide[own + o]] for near, o in zip(self.net["near"], (-2, -1, 1, 2), strict=True)) + self.net["bias"]
            np.tanh(h, out=h)
            logits = h @ self.net["out"]
            logits += self.net["base"]
            token = logits[np.arange(len(own)), wide[own]]
            np.exp(logits, out=logits)
            out[i : i + block] = token - np.log(logits @ self.ones)
        return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``log_likelihood`` (sum) and ``mean_log_likelihood`` of every row."""
    texts = keyed(docs, id_col, text_col)
    characters, counts = character_counts(texts)
    table, rare = _code_table(characters), rare_shares(characters, counts)
    net = train_network(texts, table)
    shared = docs.sparkSession.sparkContext.broadcast((table, net, rare))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        table, net, rare = shared.value
        scorer = Scorer(net)
        for batch in text_steps(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            codes, at = _padded_codes(texts, table)
            logs = scorer.log_probabilities(codes, at).astype(np.float64)
            if len(rare):
                logs += np.where(codes[at] == OTHER, rare[np.minimum(_characters(texts)[0], len(rare) - 1)], 0)
            sums = np.concatenate([[0.0], np.cumsum(logs)])
            sizes = np.array([len(t.lower()) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            total = sums[ends] - sums[ends - sizes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(total), pa.array(total / np.maximum(sizes, 1))],
                names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"],
            )

    return texts.mapInArrow(score, f"doc_id {kind}, n_tokens long, log_likelihood double, mean_log_likelihood double")
