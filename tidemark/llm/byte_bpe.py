"""Byte-level BPE on sentencepiece.

A BPE model is serialised straight from a rank file: each token's bytes are mapped to one character each, a piece's
score is its negative rank, and normalisation is the identity. Merging by highest score is then merging by lowest rank.
Pre-tokens are encoded one by one, and decoding maps every id back to its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Distinct pre-tokens that a worker remembers; it forgets all of them beyond that. Longer ones are not remembered.
CACHE, CACHED_LENGTH = 400_000, 64
_FIRST = 3  # <unk>, <s>, </s> come before the tokens


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """A character for each byte, none of them white space or special to sentencepiece."""
    return [chr(0x4E00 + b) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes_field(1, _bytes_field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _int_field(3, kind))


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto of kind BPE whose id of a token is its rank's place plus 3."""
    chars = byte_characters()
    out = [_piece("<unk>", 0, 2), _piece("<s>", 0, 3), _piece("</s>", 0, 3)]
    out += [_piece("".join(chars[b] for b in token), -float(rank), 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _int_field(3, 2) + _int_field(4, len(ranks) + _FIRST) + _int_field(35, 0)
    normaliser = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return b"".join([*out, _bytes_field(2, trainer), _bytes_field(3, normaliser)])


class ByteBpe:
    """encode() and decode() by a rank file, without special tokens."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.get)
        self.rank_at = [self.ranks[t] for t in self.tokens]
        self.bytes_of = {self.ranks[t]: t for t in self.tokens}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.pattern = regex.compile(pattern)
        self.mapped = dict(enumerate(byte_characters()))

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ranks of one pre-token: its own if it has one, else by merging."""
        if (own := self.ranks.get(piece)) is not None:
            return [own]
        return [self.rank_at[i - _FIRST] for i in self.model.encode(piece.decode("latin-1").translate(self.mapped))]

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Known(dict):
    """Pre-token -> (number of ids, decimal ids joined by commas, decoded bytes)."""

    def __init__(self, coder: ByteBpe):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str):
        ids = self.coder.encode_piece(piece.encode())
        out = len(ids), ",".join(map(str, ids)), self.coder.decode(ids)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=2)
def _known(path: str, pattern: str) -> _Known:
    return _Known(ByteBpe(path, pattern))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_tokens, ids_sha256, decoded_sha256.

    A null text is the empty one: 0 ids and the digest of nothing. Repeated rows and null ids keep their own rows; other
    columns are ignored. One pass over the rows without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path, pattern)
        get, find = known.__getitem__, known.coder.pattern.findall
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column(1):
                found = list(map(get, find(text.as_py() or "")))
                n.append(sum(x[0] for x in found))
                ids.append(hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
