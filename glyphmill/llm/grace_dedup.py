"""Exact deduplication by Grace hash partitioning and open-addressing tables over complete content."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh_dir, pick

#: Hash bits that one level of spilling uses, and the levels that a 128-bit hash allows.
_BITS, _LEVELS = 4, 32


class ContentTable:
    """Open addressing with linear probing; keys are complete texts, the hash only says where to look."""

    def __init__(self, capacity: int = 1024):
        size = 1 << max(4, (2 * capacity - 1).bit_length())
        self.mask, self.slots = size - 1, np.full(size, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        self.mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = k

    def insert(self, h: int, content: bytes) -> tuple[int, bool]:
        """The number of this content, and whether it is new."""
        at = h & self.mask
        while (k := int(self.slots[at])) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k, False
            at = (at + 1) & self.mask
        self.slots[at] = k = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        if 2 * k > self.mask:
            self._grow()
        return k, True


class Spill:
    """Files of one level of one bucket, in the shared folder."""

    def __init__(self, base: str, schema: pa.Schema):
        self.fs, root = pafs.FileSystem.from_uri(base)
        self.path = f"{root}-{uuid.uuid4().hex}"
        self.fs.create_dir(self.path, recursive=True)
        self.schema, self.open = schema, {}

    def add(self, digit: int, batch: pa.RecordBatch) -> None:
        if digit not in self.open:
            sink = self.fs.open_output_stream(f"{self.path}/{digit}")
            options = pa.ipc.IpcWriteOptions(compression="lz4")
            self.open[digit] = (sink, pa.ipc.new_stream(sink, self.schema, options=options))
        self.open[digit][1].write_batch(batch)

    def close(self) -> list[int]:
        for sink, writer in self.open.values():
            writer.close()
            sink.close()
        return sorted(self.open)

    def read(self, digit: int) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_stream(f"{self.path}/{digit}") as source:
            yield from pa.ipc.open_stream(source)

    def drop(self) -> None:
        self.fs.delete_dir(self.path)


def _hashed(batch: pa.RecordBatch, column: int) -> tuple[list[int], list[bytes]]:
    contents = [v.as_buffer().to_pybytes() for v in batch.column(column)]
    return [xxhash.xxh3_128_intdigest(c) for c in contents], contents


class GraceDedup:
    """Recursion over buckets. Column 0 holds the ids, ``column`` the texts, neither null.

    With ``keep_rows``, of the rows of a text that of the least id is returned. Else a row has a list of further ids in column 2,
    and what is returned are pairs (id, least id) for all ids of a text but one that is the least.
    """

    def __init__(self, base: str, column: int, budget: int, keep_rows: bool):
        self.base, self.column, self.budget, self.keep_rows = base, column, budget, keep_rows

    def combine(self, batches: Iterable[pa.RecordBatch], window: int = 16 << 20) -> Iterator[pa.RecordBatch]:
        """What a partition sends on: each text once for every ``window`` bytes read, so a text that is everywhere isn't sent as often as it is there."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > window:
                yield from self._combined(held)
                held, size = [], 0
        if held:
            yield from self._combined(held)

    def _combined(self, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, slot, least = self._grouped(batches)
        keep = np.zeros(len(slot), bool)
        keep[least] = True
        rest = np.flatnonzero(~keep)
        rest = rest[np.argsort(slot[rest], kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(slot[rest], minlength=len(least)))])
        at = 0
        for batch in batches:
            own = keep[at : at + batch.num_rows]
            kept = batch.filter(pa.array(own))
            if self.keep_rows:
                yield kept
            else:
                slots = slot[at : at + batch.num_rows][own]
                lists = [ids[rest[ends[k] : ends[k + 1]]] for k in slots]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int64), *lists])
                yield pa.record_batch([*kept.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["k", "text", "ids"])
            at += batch.num_rows

    def run(self, batches: Iterable[pa.RecordBatch], level: int = 0, again: Callable[[], Iterator[pa.RecordBatch]] | None = None) -> Iterator[pa.RecordBatch]:
        """The bucket whose rows are ``batches``, which ``again`` reads anew."""
        held, size, source = [], 0, iter(batches)
        for batch in source:
            held.append(batch)
            size += batch.nbytes
            if size > self.budget:
                break
        else:
            if held:
                yield from self.table(held)
            return
        if level == _LEVELS:
            held.clear()
            yield from self.unsplittable(again)
            return
        spill, same, only = Spill(self.base, held[0].schema), True, None
        try:
            for batch in self._chain(held, source):
                hashes, _ = _hashed(batch, self.column)
                only = hashes[0] if only is None and hashes else only
                same = same and all(h == only for h in hashes)
                digit = np.array([(h >> (128 - _BITS * (level + 1))) & ((1 << _BITS) - 1) for h in hashes])
                for d in np.unique(digit):
                    spill.add(int(d), batch.take(pa.array(np.flatnonzero(digit == d))))
            for d in spill.close():
                yield from self.run(spill.read(d), _LEVELS if same else level + 1, lambda d=d: spill.read(d))
        finally:
            spill.drop()

    @staticmethod
    def _chain(held: list[pa.RecordBatch], source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        while held:
            yield held.pop(0)
        yield from source

    def unsplittable(self, again: Callable[[], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        """A bucket of one hash, read as a stream twice: first for the least id of each content, then for the rows. Of a content, one copy is held and no ids."""
        table, best, row = ContentTable(16), [], 0
        for batch in again():
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, (h, content) in enumerate(zip(*_hashed(batch, self.column))):
                k, new = table.insert(h, content)
                if new:
                    best.append((int(ids[i]), row))
                elif ids[i] < best[k][0]:
                    best[k] = (int(ids[i]), row)
                row += 1
        row, value, place = 0, np.array([i for i, _ in best], np.int64), np.array([r for _, r in best], np.int64)
        for batch in again():
            slot = np.array([table.insert(h, content)[0] for h, content in zip(*_hashed(batch, self.column))], np.int64)
            first = place[slot] == np.arange(row, row + len(slot))
            row += len(slot)
            if self.keep_rows:
                yield batch.filter(pa.array(first))
            else:
                yield from self._pairs([batch], value[slot], first)

    def _grouped(self, batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id of each row, the number of its content, and for each content the row with its least id."""
        table = ContentTable(sum(b.num_rows for b in batches))
        slot: list[int] = []
        least: list[int] = []
        ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches])
        for batch in batches:
            for h, content in zip(*_hashed(batch, self.column)):
                row = len(slot)
                k, new = table.insert(h, content)
                slot.append(k)
                if new:
                    least.append(row)
                elif ids[row] < ids[least[k]]:
                    least[k] = row
        return ids, np.array(slot, np.int64), np.array(least, np.int64)

    def table(self, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, slot, least = self._grouped(batches)
        first = np.zeros(len(slot), bool)
        first[least] = True
        if not self.keep_rows:
            yield from self._pairs(batches, ids[least][slot], first)
            return
        at = 0
        for batch in batches:
            yield batch.filter(pa.array(first[at : at + batch.num_rows]))
            at += batch.num_rows

    @staticmethod
    def _pairs(batches: list[pa.RecordBatch], original: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The ids in ``batches`` with the originals of their rows; of the rows that are ``first``, only the further ids."""
        at = 0
        for batch in batches:
            here = slice(at, at + batch.num_rows)
            at += batch.num_rows
            own, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            count = np.diff(lists.offsets.to_numpy())
            copy = ~first[here]
            if copy.any() or count.any():
                ids = np.concatenate([own[copy], lists.flatten().to_numpy(zero_copy_only=False)])
                of = np.concatenate([original[here][copy], np.repeat(original[here], count)])
                yield pa.record_batch([pa.array(ids), pa.array(of)], names=["doc_id", "duplicate_of"])


def exact_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = 96 << 20
) -> DataFrame:
    """A row (doc_id, duplicate_of) for every row that repeats the complete text of another.

    ``duplicate_of`` is the least id of those with the text; that document itself has no row. Each partition sends on a text that
    it holds several times once, with the ids of all its rows. The first level of partitioning is a shuffle by content hash; a bucket of more than ``bucket_bytes`` is split again into spill files
    in the shared folder by further bits of another hash, until it fits, and texts are compared byte by byte.
    A bucket that holds one text only isn't split but read as a stream. Empty texts are copies of each other. Null texts aren't
    copies of anything, and rows with a null id can't be named: neither has a row. If rows share the least id
    as well, one of them counts as the original, and the others are listed with their own id. An empty table gives no rows. Other
    columns, of any name, are not read.
    """
    base = fresh_dir(docs.sparkSession, "grace")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from GraceDedup(base, 1, bucket_bytes, False).combine(batches)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from GraceDedup(base, 1, bucket_bytes, False).run(batches)

    rows = pick(docs, doc_id=doc_id, text=text)
    rows = rows.select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string")).where("k is not null and text is not null")
    sent = rows.mapInArrow(local, "k long, text string, ids array<long>").repartition(F.xxhash64("text"))
    return sent.mapInArrow(copies, "doc_id long, duplicate_of long")


def drop_exact_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = 96 << 20
) -> DataFrame:
    """``docs`` with one row for each text, that of the least id; all columns go through unchanged.

    Rows with a null text are all kept, as are columns of any name. A null id counts as larger than any other;
    of rows that tie, one is kept. Otherwise as ``exact_duplicates``.
    """
    base = fresh_dir(docs.sparkSession, "grace")
    names, schema = docs.columns, docs.schema
    at = names.index(text) + 1
    packed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    order = F.coalesce(F.col(f"c{names.index(doc_id)}").cast("long"), F.lit(2**63 - 1)).alias("k")
    inner = T.StructType([T.StructField("k", T.LongType()), *packed.schema.fields])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from GraceDedup(base, at, bucket_bytes, True).combine(batches)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from GraceDedup(base, at, bucket_bytes, True).run(batches)

    body = f"c{at - 1}"
    split = packed.select(order, "*")
    sent = split.where(F.col(body).isNotNull()).mapInArrow(local, inner).repartition(F.xxhash64(body))
    kept = sent.mapInArrow(sift, inner)
    return kept.union(split.where(F.col(body).isNull())).drop("k").toDF(*[f.name for f in schema])
