"""Byte-level BPE through a sentencepiece model that is serialised directly from a vocabulary of ranks."""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import id_and_text, pick, slices, texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokens of the 50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of a generation of the cache; when it is full, those of the one before that weren't met again go.
_CACHE_WORDS = 75_000


def byte_characters() -> list[str]:
    """A printable character for each byte: its own where Latin-1 prints it, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


_TO_CHARACTER = dict(enumerate(byte_characters()))
_TO_BYTE = {ord(c): b for b, c in _TO_CHARACTER.items()}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a file of base64 tokens and ranks, in the order of their ranks."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"ranks of {path} have gaps")
    return [token for _, token in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialize_model(tokens: list[bytes]) -> bytes:
    """A BPE model: the piece of rank r has id r, score -r; the unknown piece comes last and is never used, as each byte is a piece."""
    missing = [b for b in range(256) if bytes([b]) not in set(tokens)]
    if missing:
        raise ValueError(f"bytes that aren't tokens: {missing}")
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = token.decode("latin-1").translate(_TO_CHARACTER).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, -float(len(tokens))) + _field(3, 2))
    no_id = (1 << 64) - 1
    out += _field(2, _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(k, no_id) for k in (41, 42, 43)))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class ByteBpe:
    """Encoder and decoder of one Python worker."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        size = self.processor.get_piece_size() - 1
        self.bytes = [self.processor.id_to_piece(i).translate(_TO_BYTE).encode("latin-1") for i in range(size)]
        self.known: dict[str, bytes] = {}  # the ids as 32-bit numbers
        self.older: dict[str, bytes] = {}
        self.length = np.array([len(x) for x in self.bytes] + [0])
        self.lossy: set[str] = set()  # pre-tokens whose ids don't give them back

    def encode(self, bodies: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether they give it back.

        They do if its pre-tokens make up the text and each is had back from its ids, as decoding joins bytes of ids;
        a pre-token is decoded once, when it is first encoded.
        """
        words = [self.split(t) for t in bodies]
        every = set().union(*words)
        if len(self.known) > _CACHE_WORDS:
            self.older, self.known = self.known, {}
            self.lossy &= self.older.keys() | every
        new = []
        for w in every.difference(self.known):
            if (ids := self.older.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = ids
        if new:
            self._learn(new)
        find = self.known.__getitem__
        ids = [np.frombuffer(b"".join(map(find, w)), np.int32) for w in words]
        return ids, ["".join(w) == t and self.lossy.isdisjoint(w) for w, t in zip(words, bodies)]

    def _learn(self, new: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in new]
        found = self.processor.encode([r.decode("latin-1").translate(_TO_CHARACTER) for r in raw], num_threads=1)
        ends = np.cumsum([len(ids) for ids in found])
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))
        packed, at = flat.tobytes(), [0, *(4 * ends).tolist()]
        self.known.update((w, packed[a:b]) for w, a, b in zip(new, at, at[1:]))
        # All in one: the bytes of all ids in turn, and how many there are of each pre-token.
        total = np.concatenate([[0], np.cumsum(self.length[flat])])[ends]
        sizes = np.cumsum([len(r) for r in raw])
        if not np.array_equal(total, sizes) or b"".join(map(self.bytes.__getitem__, flat.tolist())) != b"".join(raw):
            self.lossy.update(w for w, r, ids in zip(new, raw, found) if b"".join(map(self.bytes.__getitem__, ids)) != r)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _lists(ids: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in ids]))


def _encoded(bpe: ByteBpe, column: pa.Array) -> tuple[list[np.ndarray | None], list[bool | None]]:
    """Ids of each text, and whether they give it back; None for nulls."""
    bodies = texts(column)
    found = zip(*bpe.encode([t for t in bodies if t is not None]))
    ids, same = zip(*((None, None) if t is None else next(found) for t in bodies))
    return list(ids), list(same)


def encode_documents(
    docs: DataFrame, model: bytes, pattern: str = PATTERN, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """A row (doc_id, n_tokens, token_ids, lossless) for every row; ``lossless`` says that decoding the ids gave the text again.

    Texts are cut into pre-tokens by ``pattern``, which must match every character; each byte of one becomes a character,
    and sentencepiece merges them. An empty text has no tokens; a null text has null in all columns but the id. Strings of
    special tokens in a text are ordinary text. Bytes that aren't UTF-8 are replaced first. Very long texts are encoded whole;
    repeated rows repeat theirs, a null id stays null, an empty table gives no rows. Other columns, of any name, are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(model, pattern)
        for batch in slices(batches, 1, 1 << 20):
            ids, same = _encoded(bpe, batch.column(1))
            count = pa.array([None if x is None else len(x) for x in ids], pa.int64())
            yield pa.record_batch(
                [batch.column(0), count, _lists(ids), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "token_ids", "lossless"],
            )

    rows = id_and_text(docs, doc_id, text)
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, token_ids array<int>, lossless boolean")


def decode_documents(rows: DataFrame, model: bytes, ids: str = "token_ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) of lists of ids; a null list gives a null text, ids outside the vocabulary are an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(model)
        for batch in batches:
            out = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = pick(rows, doc_id=doc_id, ids=ids).select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(decode, "doc_id long, text string")


def with_tokens(docs: DataFrame, model: bytes, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` and ``n_tokens``, which replace columns of those names; all rows and other columns are kept. Raises if a text can't be had back from its ids."""
    names = [n for n in docs.columns if n not in ("token_ids", "n_tokens")]
    at = names.index(text)
    packed = pick(docs, **{f"c{i}": n for i, n in enumerate(names)})
    schema = T.StructType(
        [*packed.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(model, pattern)
        for batch in slices(batches, at, 1 << 20):
            ids, same = _encoded(bpe, batch.column(at))
            if False in same:
                raise ValueError("a text can't be had back from its tokens")
            count = pa.array([None if x is None else len(x) for x in ids], pa.int64())
            yield pa.record_batch([*batch.columns, _lists(ids), count], names=[*batch.schema.names, "token_ids", "n_tokens"])

    return packed.mapInArrow(encode, schema).toDF(*names, "token_ids", "n_tokens")
