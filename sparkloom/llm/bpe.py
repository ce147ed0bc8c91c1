"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised from the rank vocabulary.

No model is trained: the ``ModelProto`` is written field by field. Every token becomes a piece whose bytes are mapped
to printable characters, its score is the negative rank, and the normaliser is the identity. sentencepiece then merges,
in each pre-token, the pair with the best score first, which is the rule of byte-level BPE by ranks.

Null texts count as empty. An empty text has no ids and decodes to no bytes. Rows that repeat give the same result
each; extra columns are ignored by :func:`encode_texts` unless named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.kernel import chunks

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids one worker remembers; beyond that it forgets them all and goes on.
REMEMBERED = 600_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    keep = set(shown)
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes are length-delimited, floats fixed32, integers varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of ``base64 rank`` lines."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be dense from 0")
    return [found[i] for i in range(len(found))]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE ``ModelProto``: piece 0 is the obligatory unknown piece, piece ``r + 1`` has rank ``r``."""
    letters = byte_alphabet()
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    parts = [_field(1, unknown)]
    for rank, token in enumerate(tokens):
        text = "".join(letters[b] for b in token)
        parts.append(_field(1, _field(1, text.encode()) + _field(2, -float(rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(parts) + _field(2, trainer) + _field(3, plain)


class ByteBpe:
    """Encoder and decoder for one rank vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.pieces = sentencepiece.SentencePieceProcessor()
        self.pieces.LoadFromSerializedProto(serialise_model(self.tokens))
        self.map = {i: c for i, c in enumerate(byte_alphabet())}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens not seen before: a token of the vocabulary is itself, all others go to sentencepiece at once."""
        raw = [t.encode() for t in fresh]
        found = {t: struct.pack("<I", rank) for t, r in zip(fresh, raw, strict=True) if (rank := self.whole.get(r)) is not None}
        rest = [t for t in fresh if t not in found]
        split = self.pieces.encode([t.encode().decode("latin-1").translate(self.map) for t in rest], num_threads=1)
        found.update((t, struct.pack(f"<{len(ids)}I", *[i - 1 for i in ids])) for t, ids in zip(rest, split, strict=True))
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers."""
        cut = [self.split(t) for t in texts]
        fresh = set().union(*cut).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = set().union(*cut)
        self.known.update(self._learn(list(fresh)))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, then ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and ``decoded`` (the bytes of the decoded ids).

    A narrow map: no shuffle, memory bounded by one Arrow batch.
    """
    path = path or public_tokenizers.path(DEFAULT_RANKS)
    keep = list(keep)
    # positions, not names: an extra column may bear any name
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    fields = [T.StructField(f"k{i}", source.schema[i].dataType) for i in range(len(keep))]
    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for a, b, texts in chunks(batch.column(len(keep))):
                part = batch.slice(a, b - a)
                ids = bpe.encode_all(texts.to_pylist())
                back = [bpe.decode(x) for x in ids]
                cols = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(back, pa.binary())], names=schema.names)

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", "n_tokens", "decoded")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, derived from :func:`encode_texts`."""
    e = encode_texts(docs, path)
    return e.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def reference_digest(text: str | None, encode) -> tuple[int, str, str]:
    """What :func:`digests` must give for one text, from any other encoder (for tests)."""
    ids = encode(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
