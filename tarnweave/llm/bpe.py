"""Byte-level BPE encoding and decoding.

A sentencepiece BPE model is serialised straight from the vocabulary's ranks: each token is a piece whose bytes are
mapped to one character each, scored by its negative rank, under identity normalisation. Merging the best-scored
neighbours, leftmost first, is then merging by lowest rank. Pre-tokens are cut by the vocabulary's pattern and encoded
one by one; decoding maps ids back to bytes.

Cases: a null or empty text has no ids and decodes to no bytes; null ids decode to no bytes; repeated rows are encoded
each; an input column named like an output column is replaced. A vocabulary must hold all 256 single bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

#: Entries of a worker's memo of pre-tokens; it starts anew when full, which changes no result.
MEMO = 400_000
#: Byte b stands in the model as the character of this code point plus b.
FIRST_CHAR = 0x100
_CHARS = "".join(chr(FIRST_CHAR + b) for b in range(256))


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def as_chars(token: bytes) -> str:
    return token.decode("latin-1").translate(_CHARS)


def serialise(vocabulary: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """The sentencepiece model, and the rank of each of its pieces."""
    if any(bytes([b]) not in vocabulary for b in range(256)):
        raise ValueError("a byte-level vocabulary needs all 256 single bytes")
    model = model_pb2.ModelProto()
    order = sorted(vocabulary.items(), key=lambda x: x[1])
    for token, rank in order:
        model.pieces.add(piece=as_chars(token), score=-float(rank), type=model_pb2.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=model_pb2.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.unk_id = model_pb2.TrainerSpec.BPE, len(model.pieces), len(order)
    spec.bos_id = spec.eos_id = spec.pad_id = -1
    plain = model.normalizer_spec
    plain.name, plain.add_dummy_prefix, plain.remove_extra_whitespaces, plain.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString(), [rank for _, rank in order]


class Cutter:
    """Cuts a text into pre-tokens as `pattern` does. The common pattern gets an equal one for re, which is several
    times as fast: with the classes spelt out for texts within the first 65,536 code points."""

    def __init__(self, pattern: str):
        self.all = regex.compile(pattern).findall
        self.plane = None
        letter, number, space = r"\p{L}", r"\p{N}", r"\s"
        if pattern == rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{space}{letter}{number}]+|{space}+(?!\S)|{space}+":
            plane = "".join(map(chr, range(0x10000)))
            a, b, c = (_ranges(regex.findall(x, plane)) for x in (letter, number, space))
            self.plane = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{a}]+| ?[{b}]+| ?[^{c}{a}{b}]+|[{c}]+(?![^{c}])|[{c}]+").findall

    def __call__(self, text: str) -> list[str]:
        if self.plane and (text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)):
            return self.plane(text)
        return self.all(text)


def _ranges(chars: list[str]) -> str:
    at = np.array([ord(c) for c in chars])
    breaks = np.flatnonzero(np.diff(at) > 1)
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]]))


class Encoder:
    """One vocabulary's encoder in a worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks(path)
        model, self.piece_rank = serialise(self.ranks)
        self.same = self.piece_rank == list(range(len(self.piece_rank)))
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = Cutter(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}

    def learn(self, tokens: set[str]) -> None:
        """Put the ids of new pre-tokens into the memo."""
        hard = []
        for t in tokens:
            rank = self.ranks.get(t.encode("utf-8", "surrogatepass"))
            if rank is None:
                hard.append(t)
            else:
                self.memo[t] = (rank,)  # a pre-token that is a token is never merged from parts
        found = self.sp.encode([as_chars(t.encode("utf-8", "surrogatepass")) for t in hard], num_threads=1) if hard else []
        for t, ids in zip(hard, found):
            self.memo[t] = tuple(ids) if self.same else tuple(self.piece_rank[i] for i in ids)

    def __call__(self, text: str) -> np.ndarray:
        tokens = self.cut(text)
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = set(tokens).difference(self.memo)
        if new:
            self.learn(new)
        return np.fromiter(chain.from_iterable(map(self.memo.__getitem__, tokens)), np.int32)


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(2)
def pieces(path: str) -> list[bytes]:
    """Token bytes by rank."""
    known = ranks(path)
    out = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        out[rank] = token
    return out


def _others(df: DataFrame, new: str) -> list[T.StructField]:
    return [f for f in df.schema if f.name.lower() != new.lower()]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", drop_text: bool = False) -> DataFrame:
    """df with the column `ids` (array of int): the ids of the whole `text`. Narrow: no shuffle."""
    kept = [f for f in _others(df, ids) if not (drop_text and f.name == text)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path, pattern)
        for batch in batches:
            texts, first, got, size = batch.column(text), 0, [], 0
            for i in range(batch.num_rows):
                got.append(one(texts[i].as_py() or ""))
                size += len(got[-1])
                if size > 1 << 20 or i + 1 == batch.num_rows:
                    at = np.r_[0, np.cumsum([len(x) for x in got])].astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(got)))
                    own = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names), column], [*names, ids])
                    first, got, size = i + 1, [], 0

    need = list(dict.fromkeys([*names, text]))
    return df.select(*[f"`{n}`" for n in need]).mapInArrow(run, T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", drop_ids: bool = False) -> DataFrame:
    """df with the column `decoded` (binary): the bytes that the ids stand for. An id out of range fails."""
    kept = [f for f in _others(df, decoded) if not (drop_ids and f.name == ids)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for batch in batches:
            column, first, got, size = batch.column(ids), 0, [], 0
            for i in range(batch.num_rows):
                value = column[i].values
                own_ids = value.to_numpy(zero_copy_only=False).tolist() if value is not None else []
                if own_ids and min(own_ids) < 0:
                    raise ValueError("negative token id")
                got.append(b"".join(map(known.__getitem__, own_ids)))
                size += len(got[-1])
                if size > 4 << 20 or i + 1 == batch.num_rows:
                    own = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names), pa.array(got, pa.binary())], [*names, decoded])
                    first, got, size = i + 1, [], 0

    need = list(dict.fromkeys([*names, ids]))
    return df.select(*[f"`{n}`" for n in need]).mapInArrow(run, T.StructType([*kept, T.StructField(decoded, T.BinaryType())]))
