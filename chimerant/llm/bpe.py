"""Byte-level BPE encoding and decoding through a sentencepiece model built straight from a rank vocabulary.

Every byte is mapped to one printable character, every token of the vocabulary becomes a piece of such characters with
the score -rank, and the normaliser is the identity. sentencepiece's BPE then merges the best-scored adjacent pair,
leftmost first: the same merges as byte-level BPE by ranks. Pre-tokens are encoded one by one; decoding maps ids back
to bytes.

Defined results: a null or empty text has no tokens, the empty id list and the empty decoding; repeated rows give
repeated results; an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First of the 256 characters that stand for bytes; none of them is white space or combines with its neighbours.
BYTE_BASE = 0x4E00
#: Pre-tokens whose ids a task remembers before it starts afresh.
CACHE_SIZE = 400_000
#: Pre-tokens of one text that are worked on at a time.
BLOCK = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: base64 of the token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def byte_chars() -> list[str]:
    return [chr(BYTE_BASE + b) for b in range(256)]


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece BPE model of a rank vocabulary; piece i has the i-th smallest rank, the last piece is unknown."""
    chars = byte_chars()
    pieces = b"".join(_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for token, rank in sorted(ranks.items(), key=lambda x: x[1]))
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(ranks)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1) + _field(45, b"<unk>")
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes with the built model; made once in each task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.by_piece = sorted(ranks.values())
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.map = {b: BYTE_BASE + b for b in range(256)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        outer = self

        class Known(dict):
            def __missing__(self, pre_token: str) -> tuple[int, ...]:
                if len(self) >= CACHE_SIZE:
                    self.clear()
                out = self[pre_token] = outer.encode_pre_token(pre_token.encode("utf-8", "surrogatepass"))
                return out

        self.known = Known()

    def encode_pre_token(self, raw: bytes) -> tuple[int, ...]:
        if (rank := self.ranks.get(raw)) is not None:
            return (rank,)
        return tuple(self.by_piece[i] for i in self.model.encode(raw.decode("latin-1").translate(self.map)))

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, some pre-tokens at a time, so that a huge text needs little memory."""
        if len(text) <= BLOCK:
            pre = self.pattern.findall(text)
            yield list(chain.from_iterable(map(self.known.__getitem__, pre)))
            return
        matches = self.pattern.finditer(text)
        while pre := [m.group() for m in islice(matches, BLOCK)]:
            yield list(chain.from_iterable(map(self.known.__getitem__, pre)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.blocks(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) to doc_id, n_tokens, ids_sha256, decoded_sha256, and ids array<int> if asked for."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(vocabulary), pattern)
        names = {rank: b"%d" % rank for rank in codec.ranks.values()}
        for batch in batches:
            counts, id_hashes, byte_hashes, lists = [], [], [], []
            for value in batch.column(1):
                n, ids_hash, bytes_hash, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in codec.blocks(value.as_py() or ""):
                    if ids:
                        ids_hash.update((b"," if n else b"") + b",".join(map(names.__getitem__, ids)))
                        bytes_hash.update(codec.decode(ids))
                        n += len(ids)
                        if with_ids:
                            kept.extend(ids)
                counts.append(n)
                id_hashes.append(ids_hash.hexdigest())
                byte_hashes.append(bytes_hash.hexdigest())
                lists.append(kept)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(byte_hashes, pa.string())]
            names_out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names_out.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names_out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
