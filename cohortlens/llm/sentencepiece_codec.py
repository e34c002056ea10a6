"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf message) is read field by field: pieces with scores
and types, the model type, and the normaliser's settings.  From these the
tokenizers library gets the same model: unigram scores, or for a pair-merging
model the merges in the order of the scores; byte pieces as fallback for
unknown characters; the normaliser's character map, white-space rules and the
metaspace marker for spaces.

Where no piece holds a marker behind another character (nor a letter beside a
non-letter), no piece crosses from one word to the next, so a text's pieces are
its words' pieces one after the other.  Each Python worker therefore keeps the pieces of words it has seen;
the unseen words of a batch are encoded together, by several threads.  Every
word that enters this cache is also encoded by the sentencepiece library, and
a document's ``parity`` tells whether all its words agreed.  A model without
that property is encoded, and compared, text by text.

Decoding joins the pieces' bytes (byte pieces give their byte), turns markers
into spaces and removes the leading one that encoding added.

Edge cases: null text counts as empty and has no pieces; text that holds the
marker character itself decodes to a space there, so ``round_trip`` is false;
what the normaliser changes is not restored; repeated rows are encoded one by
one; extra columns pass through, result columns replace those of the same
name; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortlens.llm.common import with_columns

MARK = "▁"
#: Piece types and model types of the message (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2
#: Words of the newer of the cache's two halves, and characters of a word that is kept.
CACHE_ROWS, CACHE_CHARS = 80_000, 64
_codecs: dict[tuple[str, int], "Codec"] = {}


# ------------------------------------------------------------- model message


def _fields(message: bytes):
    """(number, value) of every field; a value is an int, or bytes for the fixed and delimited kinds."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(message):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield number, message[at : at + size]
        at += size


@dataclass
class Model:
    """What the model file says; defaults are the message's own."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    collapse_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, message: bytes) -> Model:
        model = cls()
        for number, value in _fields(message):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append(piece.get(1, b"").decode())
                model.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                model.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                model.model_type = trainer.get(3, UNIGRAM)
                model.byte_fallback = bool(trainer.get(35, 0))
                model.suffix_marker = bool(trainer.get(24, 0))
            elif number == 3:
                norm = dict(_fields(value))
                model.char_map = norm.get(2, b"")
                model.dummy_prefix, model.collapse_spaces, model.escape_spaces = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        return model

    def words(self) -> str | None:
        """A pattern that cuts a normalised text where no piece can cross, so the parts can be encoded one by one; or None.

        A piece over a cut would hold the two characters beside it next to each other.
        """
        normal = [p for p, t in zip(self.pieces, self.types, strict=True) if t == NORMAL]
        letter = r"\p{L}"
        if not self.escape_spaces or not self.byte_fallback or any(MARK in p.lstrip(MARK) for p in normal):
            return None
        mixed = regex.compile(rf"{letter}[^{letter}{MARK}]|[^{letter}{MARK}]{letter}|.\n|\n.", regex.DOTALL)
        if any(mixed.search(p) for p in normal):
            return f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        return f"{MARK}*(?:{letter}+|[^{letter}{MARK}]+)|{MARK}+"

    def library(self):
        """The model of the tokenizers library with this model's pieces."""
        from tokenizers import models

        if self.model_type == UNIGRAM:
            vocabulary = list(zip(self.pieces, self.scores, strict=True))
            return models.Unigram(vocabulary, unk_id=self.types.index(UNKNOWN), byte_fallback=self.byte_fallback)
        if self.model_type != BPE:
            raise ValueError(f"model type {self.model_type} has no counterpart")
        ids = {p: i for i, p in enumerate(self.pieces)}
        usable = {p for p, t in zip(self.pieces, self.types, strict=True) if t == NORMAL}
        merges = []
        for p in usable:
            halves = ((p[:k], p[k:]) for k in range(1, len(p)))
            merges += [(-self.scores[ids[p]], ids[p], ids[a], ids[b], a, b) for a, b in halves if a in usable and b in usable]
        merges = [m[-2:] for m in sorted(merges)]
        unknown = self.pieces[self.types.index(UNKNOWN)]
        return models.BPE(ids, merges, unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)


class Codec:
    """Encoder and decoder of one model file, with a worker's cache of words."""

    def __init__(self, message: bytes, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece
        from tokenizers import Tokenizer, normalizers

        self.model, self.threads = Model.parse(message), threads
        if USER_DEFINED in self.model.types or self.model.suffix_marker:
            raise ValueError("user-defined pieces and suffix markers are not supported")
        self.backend = Tokenizer(self.model.library())
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=message)
        self.char_map = normalizers.Precompiled(self.model.char_map) if self.model.char_map else None
        pattern = self.model.words()
        self.cut = pattern and regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        raw = []
        for p, t in zip(self.model.pieces, self.model.types, strict=True):
            raw.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, " ").encode())
            if t == UNKNOWN:
                raw[-1] = " ⁇ ".encode()
        self.raw = raw
        self.is_byte = np.array([t == BYTE for t in self.model.types])

    def normalise(self, text: str) -> str:
        model = self.model
        if self.char_map is not None:
            text = self.char_map.normalize_str(text)
        if model.collapse_spaces:
            text = re.sub(" {2,}", " ", text).strip(" ")
        if not text:
            return text
        if model.dummy_prefix:
            text = " " + text
        if not model.escape_spaces:
            return text
        text = text.replace(" ", MARK)
        return text.rstrip(MARK) if model.collapse_spaces else text

    def _ids(self, normal: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.int32).tobytes() for x in self.backend.encode_batch_fast(normal, add_special_tokens=False)]

    def _peer_ids(self, words: list[str]) -> list[bytes]:
        """The sentencepiece library's pieces of normalised words.

        It puts the first marker before each text itself; a word without one is
        encoded behind a line break, which is in no other piece.
        """
        lead = self.model.dummy_prefix
        before = [w[1:] if lead and w[0] == MARK else "\n" + w for w in words]
        skip = len(self.peer.encode("\n"))
        found = self.peer.encode(before, num_threads=self.threads)
        bare = [self.peer.piece_to_id(MARK)]
        out = [bare if lead and w == MARK else x if lead and w[0] == MARK else x[skip:] for w, x in zip(words, found, strict=True)]
        return [np.array(x, np.int32).tobytes() for x in out]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Piece ids of each text, and whether both libraries agree on them."""
        normal = [self.normalise(t) for t in texts]
        if self.cut is None:
            own = self._ids(normal)
            peer = [np.array(x, np.int32).tobytes() for x in self.peer.encode(texts, num_threads=self.threads)]
            return [np.frombuffer(x, np.int32) for x in own], [x == y for x, y in zip(own, peer, strict=True)]
        cut = [self.cut(t) for t in normal]
        cache = self.cache
        missed = set().union(*cut).difference(cache)
        kept = {w: self.older[w] for w in missed if w in self.older}
        cache.update(kept)
        missed = [w for w in missed if w not in kept]
        if missed:
            own, peer = self._ids(missed), self._peer_ids(missed)
            cache.update(zip(missed, own, strict=True))
            self.wrong.update(w for w, x, y in zip(missed, own, peer, strict=True) if x != y)
        ids = [np.frombuffer(b"".join(map(cache.__getitem__, words)), np.int32) for words in cut]
        same = [not self.wrong or self.wrong.isdisjoint(words) for words in cut]
        for w in missed:
            if len(w) > CACHE_CHARS:
                del cache[w]
        if len(cache) > CACHE_ROWS:
            self.older, self.cache = cache, {}
        return ids, same

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        data = b"".join([raw[i] for i in ids.tolist()])
        if self.model.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode(errors="replace")


def codec(path: str, threads: int = THREADS) -> Codec:
    if (path, threads) not in _codecs:
        with open(path, "rb") as f:
            _codecs[path, threads] = Codec(f.read(), threads)
    return _codecs[path, threads]


def sentencepiece_codec(docs: DataFrame, path: str, text_col: str = "text", threads: int = THREADS, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of ``docs`` (all by default) with ``piece_ids``, ``n_pieces``, ``n_byte_pieces``, ``decoded``, ``round_trip`` and ``parity``.

    ``path`` is the model file on every machine.
    """
    new = T.StructType().add("piece_ids", T.ArrayType(T.IntegerType())).add("n_pieces", "long").add("n_byte_pieces", "long")
    new = new.add("decoded", "string").add("round_trip", "boolean").add("parity", "boolean")

    def run(texts: pa.Array, _) -> list[pa.Array]:
        own, texts = codec(path, threads), [t or "" for t in texts.to_pylist()]
        ids, same = own.encode(texts)
        decoded = [own.decode(x) for x in ids]
        sizes = np.array([len(x) for x in ids], np.int64)
        return [
            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(ids))),
            pa.array(sizes),
            pa.array([int(own.is_byte[x].sum()) for x in ids], pa.int64()),
            pa.array(decoded, pa.string()),
            pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_()),
            pa.array(same, pa.bool_()),
        ]

    return with_columns(docs, text_col, new, run, keep)
