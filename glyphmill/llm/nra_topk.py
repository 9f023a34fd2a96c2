"""Exact top-k by aggregation of sorted lists without random access."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh_dir, pick, remove, small

#: Parts of each list that are read when bounds are compared, half of each part from either end.
DEPTHS = (0.0, 0.125, 0.25, 0.5, 0.625, 0.75, 0.875, 0.9375, 1.0)
#: Queries of a block that are answered side by side.
_BATCH = 256
#: Items of a block by which it is judged how many a depth leaves, before bounds of all are made.
_SAMPLE = 128
#: As many entries are read in order in the time that it takes to look up one.
_LOOKUP = 8


def ranked(items: np.ndarray) -> np.ndarray:
    """The rank of each item in the sorted list of each dimension, in the narrowest type that holds it."""
    order = np.argsort(items.T, axis=1, kind="stable")
    ranks = np.empty(order.shape, np.min_scalar_type(len(items)))
    np.put_along_axis(ranks, order, np.arange(len(items), dtype=ranks.dtype)[None, :], axis=1)
    return np.ascontiguousarray(ranks.T)


class Lists:
    """Items as one list for each dimension, sorted by value and read from both ends inwards.

    After a depth the unread values of a list lie between the two places reached. So an item's score with a query is bounded: what was
    read of it is exact, and the rest differs from the middles of both places by no more than its distance from them times the query's length.
    """

    def __init__(self, items: np.ndarray, ranks: np.ndarray | None = None):
        self.items = items
        self.n, self.dim = items.shape
        #: The rank of each item in each list.
        self.ranks = ranked(items) if ranks is None else ranks
        self._ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._bounds: dict[int, np.ndarray] = {}
        self._samples: dict[int, np.ndarray] = {}

    @cached_property
    def _sorted(self) -> np.ndarray:
        found = np.empty_like(self.items)
        np.put_along_axis(found, self.ranks.astype(np.int64), self.items, axis=0)
        return found

    def left(self, depth: int) -> tuple[int, int]:
        """The first and the last rank that aren't read at this depth; none if the first is greater."""
        each = int(np.ceil(self.n * DEPTHS[depth] / 2))
        return each, self.n - 1 - each

    def ends(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The middle between the places reached in each list, and half their distance."""
        if depth not in self._ends:
            a, b = self.left(depth)
            none = np.zeros(self.dim, np.float32)
            low, high = (self._sorted[a], self._sorted[b]) if a <= b else (none, none)
            self._ends[depth] = (low + high) / 2, (high - low) / 2
        return self._ends[depth]

    def _bounded(self, depth: int, rows: slice) -> np.ndarray:
        a, b = self.left(depth)
        unread = (self.ranks[rows] >= a) & (self.ranks[rows] <= b)
        middle, half = self.ends(depth)
        far = np.sqrt(unread @ (half.astype(np.float64) ** 2))
        return np.hstack([np.where(unread, middle, self.items[rows]), far[:, None].astype(np.float32)])

    def bounds(self, depth: int) -> np.ndarray:
        """For each item the middles of what its values may be, and the distance to the farthest vector that it may be."""
        if depth not in self._bounds:
            self._bounds[depth] = self._bounded(depth, slice(None))
        return self._bounds[depth]

    def sample(self, depth: int) -> np.ndarray:
        """Those bounds for some of the items, spread over the block."""
        if depth not in self._samples:
            self._samples[depth] = self._bounded(depth, slice(None, None, max(1, self.n // _SAMPLE)))
        return self._samples[depth]

    def read(self, depth: int) -> int:
        """Entries that are read up to a depth."""
        a, b = self.left(depth)
        return self.dim * (self.n - max(0, b - a + 1))


class Best:
    """The k best items so far of each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.item = np.zeros((len(ids), 0), np.int64)
        self.score = np.zeros((len(ids), 0))
        #: What a score must reach, as far as is known.
        self.least = np.full(len(ids), -np.inf)
        #: Entries read in lists, entries of items looked up in the end, and those that there are.
        self.read = self.resolved = self.all = 0

    def search(self, ids: np.ndarray, lists: Lists) -> None:
        """Takes in the items of a block."""
        self.all += len(self.ids) * lists.n * lists.dim
        for at in range(0, len(self.ids), _BATCH):
            rows = np.arange(at, min(at + _BATCH, len(self.ids)))
            with np.errstate(over="ignore", invalid="ignore"):  # see slack
                q, i = self._candidates(rows, lists, ids)
            self._merge(rows, q, i, ids, lists)

    def _candidates(self, rows: np.ndarray, lists: Lists, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, item) that may be among the k best, all that tie with the last included.

        A query reads on until what is sure (lower bounds, or the blocks before) parts it from so many items that looking up the rest
        takes less than reading one step more. Before that, bounds of single items are no use while even one that was seen in no list could qualify,
        or while a sample of the items shows that too many are left.
        """
        queries = self.queries[rows]
        weights = np.abs(queries)
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1, keepdims=True)).astype(np.float32)
        upper, lower = np.hstack([queries, length]), np.hstack([queries, -length])
        # What two scores in single precision may be off, bounds included; where they might overflow, nothing is left out.
        most = 2 * np.sqrt(lists.dim) * length[:, 0].astype(np.float64) * max(1e-30, float(np.abs(lists.items).max(initial=0)))
        slack = np.where(most < 1e37, (1e-5 + 3e-7 * lists.dim) * most + 1e-30, np.inf)
        least = self.least[rows]
        others = min(self.k + 1, lists.n)  # one may be the query itself
        open_, found = np.arange(len(rows)), []
        for depth in range(len(DEPTHS)):
            if not len(open_):
                break
            last = depth == len(DEPTHS) - 1
            middle, half = lists.ends(depth)
            unseen = queries[open_] @ middle + weights[open_] @ half  # the most that an item can have that was seen in no list
            if depth == 0:  # nothing is read: the whole block may be out of question
                open_ = open_[~(unseen < (least - slack)[open_])]
                continue
            unknown = ~np.isfinite(least[open_])
            step = 0 if last else (lists.read(depth + 1) - lists.read(depth)) / lists.dim
            ready = np.full(len(open_), True) if last else (unseen < least[open_]) | unknown
            if not last:
                ready[ready] = self._left(upper[open_[ready]], lower[open_[ready]], least[open_[ready]], lists, depth) <= step / np.where(unknown[ready], 1, _LOOKUP)
            some, unknown = open_[ready], unknown[ready]
            if not len(some):
                continue
            items = lists.items if last else lists.bounds(depth)
            width = items.shape[1]
            bar = least[some]
            if unknown.any() and lists.n > self.k:
                sure = lower[some[unknown], :width] @ items.T
                bar[unknown] = np.partition(sure, lists.n - others, axis=1)[:, lists.n - others]
            score = upper[some, :width] @ items.T
            at = np.flatnonzero(~(score < (bar - slack[some]).astype(np.float32)[:, None]))
            q, i = np.divmod(at, lists.n)
            stop = np.full(len(some), True) if last else np.bincount(q, minlength=len(some)) <= step
            kept = stop[q]
            q, i = some[q[kept]], i[kept]
            found.append(self._looked_up(rows, q, i, lists, slack, least))
            self.read += int(stop.sum()) * lists.read(depth)
            self.resolved += 0 if last else len(i) * lists.dim
            open_ = np.concatenate([open_[~ready], some[~stop]])
            open_.sort()
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return rows[np.concatenate([q for q, _ in found])], np.concatenate([i for _, i in found])

    def _left(self, upper: np.ndarray, lower: np.ndarray, least: np.ndarray, lists: Lists, depth: int) -> np.ndarray:
        """About how many items each query has to look up after a depth, by a sample."""
        items = lists.sample(depth)
        bar = least.copy()
        unknown = ~np.isfinite(bar)
        if unknown.any():
            place = len(items) - max(1, min(len(items), (self.k + 1) * len(items) // lists.n))
            bar[unknown] = np.partition(lower[unknown] @ items.T, place, axis=1)[:, place]
        return (~(upper @ items.T < bar.astype(np.float32)[:, None])).sum(axis=1) * (lists.n / len(items))

    def _looked_up(self, rows: np.ndarray, q: np.ndarray, i: np.ndarray, lists: Lists, slack: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs, in the order of queries, that scores in single precision still leave among the k best."""
        if not len(q):
            return q, i
        score = np.empty(len(q), np.float32)
        for a in range(0, len(q), 1 << 14):
            part = slice(a, a + (1 << 14))
            score[part] = np.einsum("ij,ij->i", self.queries[rows[q[part]]], lists.items[i[part]])
        bar = least - slack
        begin = np.flatnonzero(np.diff(q, prepend=-1))
        count = np.diff(begin, append=len(q))
        many = count > self.k + 1  # one may be the query itself
        if many.any():
            table = np.full((int(many.sum()), int(count.max())), -np.inf, np.float32)
            table[np.arange(table.shape[1]) < count[many][:, None]] = score[np.repeat(many, count)]
            own = q[begin[many]]
            best = np.partition(table, table.shape[1] - self.k - 1, axis=1)[:, -self.k - 1]
            bar[own] = np.fmax(bar[own], best - 2 * slack[own])
        kept = ~(score < bar[q].astype(np.float32))
        return q[kept], i[kept]

    def _merge(self, rows: np.ndarray, q: np.ndarray, i: np.ndarray, ids: np.ndarray, lists: Lists) -> None:
        """Scores the candidates and keeps the k best of each query, ties by id."""
        other = self.ids[q] != ids[i]
        q, i = q[other], i[other]
        score = np.empty(len(q))
        for a in range(0, len(q), 1 << 16):
            part = slice(a, a + (1 << 16))
            score[part] = np.einsum("ij,ij->i", self.queries[q[part]].astype(np.float64), lists.items[i[part]].astype(np.float64))
        old = np.repeat(rows, (self.score[rows] > -np.inf).sum(axis=1))
        kept = self.score[rows] > -np.inf
        q, item, score = np.concatenate([old, q]), np.concatenate([self.item[rows][kept], ids[i]]), np.concatenate([self.score[rows][kept], score])
        order = np.lexsort((item, -score, q))
        q, item, score = q[order], item[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        if self.score.shape[1] < self.k:
            more = self.k - self.score.shape[1]
            self.score = np.hstack([self.score, np.full((len(self.ids), more), -np.inf)])
            self.item = np.hstack([self.item, np.zeros((len(self.ids), more), np.int64)])
        self.score[rows] = -np.inf
        self.score[q[best], place[best]], self.item[q[best], place[best]] = score[best], item[best]
        self.least[rows] = self.score[rows, self.k - 1]


def _lead(rows: DataFrame) -> DataFrame:
    """(dim, lead): the dimension in which vectors of each length vary most."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(0).offsets.to_numpy()
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            length = np.diff(ends)
            for dim in np.unique(length):
                begin = ends[:-1][length == dim] - ends[0]
                x = flat[begin[:, None] + np.arange(dim)]
                yield pa.record_batch(
                    [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([len(x)] * dim, pa.int64()), pa.array(x.sum(axis=0)), pa.array((x * x).sum(axis=0))],
                    names=["dim", "j", "n", "s", "ss"],
                )

    parts = rows.select("v").mapInArrow(sums, "dim int, j int, n long, s double, ss double")
    spread = parts.groupBy("dim", "j").agg((F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")).alias("spread"))
    return spread.groupBy("dim").agg(F.max_by("j", F.struct("spread", "j")).alias("lead"))


@lru_cache(4)
def _block(uri: str, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and their ranks in the lists."""
    fs, path = pafs.FileSystem.from_uri(uri)
    found = pq.read_table(path, filesystem=fs, columns=["ids", "mat", "ranks", "dim"]).slice(row, 1)
    dim = found["dim"][0].as_py()
    ids, mat, ranks = (found[name][0].as_py() for name in ("ids", "mat", "ranks"))
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(mat, np.float32).reshape(-1, dim), np.frombuffer(ranks, np.min_scalar_type(len(ids))).reshape(-1, dim)


def top_k(
    vectors: DataFrame, k: int = 10, block: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """A row (vec_id, rank, neighbor_id, score) for each of the k vectors with the greatest dot product with each vector, itself left out.

    Every row is a query. Vectors are put in blocks of about ``block`` by ranges of the dimension that varies most, which is the only
    shuffle, and written to the shared folder together with their sorted lists. A task answers the queries of one block: it reads the
    blocks of items one after another, its own first, and keeps the k best. In each block the values of each dimension form a sorted list,
    which is read in steps from both ends; lower and upper bounds follow from the places reached, and a query stops when outsiders can't
    qualify any more and the scores of what is left are sooner looked up than a further step is read. Blocks that can't hold a better item
    are not read at all. What is looked up is scored in single precision, and what this leaves in double, as are final scores. Where bounds
    part items late, as with isotropic vectors, most of the lists is read; then steps are matrix products, and one for an earlier depth is
    made only if an item seen in no list can't qualify there and a sample of the items says that few are left.

    Equal scores are ranked by id. Vectors that are null, empty or hold nulls, infinities or NaN, and rows with a null id,
    take no part; vectors of unlike length aren't compared. Of rows that share an id, that with the greatest
    vector counts. With fewer than k others, all are listed; an empty table gives no rows. Other columns are not read. The result is
    computed at once and kept by a checkpoint; the blocks are deleted.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, id=vec_id, v=embedding).select(F.col("id").cast("long"), F.col("v").cast("array<float>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & finite)
    rows = cut(rows.groupBy("id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v")))
    n = rows.count()
    schema = "vec_id long, rank long, neighbor_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    leads = small(cut(_lead(rows)))
    placed = rows.join(leads, "dim").select("dim", F.element_at("v", F.col("lead") + 1).alias("key"), "id", "v")
    placed = placed.repartitionByRange(-(-n // block), "dim", "key", "id").select("dim", "id", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def made(dim: int) -> pa.RecordBatch:
            ids, mats = map(np.concatenate, held.pop(dim))
            ranks = ranked(mats.reshape(-1, dim))
            return pa.record_batch(
                [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([ids.tobytes()]), pa.array([mats.tobytes()]), pa.array([ranks.tobytes()])],
                names=["dim", "n", "ids", "mat", "ranks"],
            )

        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                for a in range(0, own.num_rows, block):
                    part = own.slice(a, block)
                    ids, mats = held.setdefault(dim, ([], []))
                    if ids and sum(map(len, ids)) + part.num_rows > 2 * block:
                        yield made(dim)
                        ids, mats = held.setdefault(dim, ([], []))
                    ids.append(part.column(1).to_numpy().astype(np.int64))
                    mats.append(part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32))
        for dim in list(held):
            yield made(dim)

    base = fresh_dir(spark, "lists")
    placed.mapInArrow(pack, "dim int, n long, ids binary, mat binary, ranks binary").write.option("compression", "none").parquet(base)
    meta = spark.read.parquet(base).select("dim", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    index = sorted(map(tuple, meta.collect()))  # a row for each block

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine in batch.column(0).to_pylist():
                dim, *place = index[mine]
                same = [b for b, (d, *_) in enumerate(index) if d == dim]
                at = same.index(mine)
                best = Best(*_block(*place)[:2], k)
                for other in same[at:] + same[:at]:
                    ids, *lists = _block(*index[other][1:])
                    best.search(ids, Lists(*lists))
                there = best.score > -np.inf
                q, rank = np.nonzero(there)
                yield pa.record_batch(
                    [pa.array(best.ids[q]), pa.array(rank + 1), pa.array(best.item[there]), pa.array(best.score[there])], names=["vec_id", "rank", "neighbor_id", "score"]
                )

    found = cut(spark.range(0, len(index), 1, len(index)).mapInArrow(answer, schema))
    remove(spark, base)
    return found.select("vec_id", "rank", "neighbor_id", F.round("score", 6).alias("score"))
